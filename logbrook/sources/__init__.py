"""Log files as tables and streams, and made-up inputs."""
