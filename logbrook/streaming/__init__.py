"""The continuous monitor."""
