"""Command line: watch a folder and print a report every interval."""

from __future__ import annotations

import argparse
import os
import signal
import sys
import tempfile
import threading


def at_least_one(name: str):
    def parse(text: str) -> int:
        value = int(text)
        if value < 1:
            raise argparse.ArgumentTypeError(f"{name} must be at least 1, got {value}")
        return value

    return parse


def folder(text: str) -> str:
    if not text.strip():
        raise argparse.ArgumentTypeError("watchPath cannot be empty")
    if not os.path.isdir(text):
        raise argparse.ArgumentTypeError(f"watchPath does not exist: {text}")
    return os.path.abspath(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logbrook", description="Statistics of growing log files")
    p.add_argument("watchPath", type=folder, help="folder to watch")
    p.add_argument("--workers", "-w", type=at_least_one("--workers"), default=os.cpu_count(), help="local cores")
    p.add_argument("--queue-capacity", "-q", type=at_least_one("--queue-capacity"), default=10000, help="file events admitted per interval")
    p.add_argument("--report-interval-seconds", "-r", type=at_least_one("--report-interval-seconds"), default=2)
    p.add_argument("--topk", "-k", type=at_least_one("--topk"), default=10, help="message keys in a report")
    p.add_argument("--checkpoint", default=None, help="folder that keeps the position between runs")
    return p


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .streaming.monitor import start_monitor

    try:
        spark = SparkSession.builder.master(f"local[{options.workers}]").appName("logbrook").config("spark.sql.shuffle.partitions", str(options.workers)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
        checkpoint = options.checkpoint or tempfile.mkdtemp(prefix="logbrook-")
        query = start_monitor(spark, options.watchPath, checkpoint, options.report_interval_seconds, options.topk, options.queue_capacity)
        print(f"Started: WatchPath={options.watchPath} Workers={options.workers} QueueCapacity={options.queue_capacity} ReportIntervalSeconds={options.report_interval_seconds} TopK={options.topk}", flush=True)
        stopping = threading.Event()
        for sign in (signal.SIGINT, signal.SIGTERM):
            signal.signal(sign, lambda *_: stopping.set())
        while not stopping.is_set() and query.isActive:
            stopping.wait(0.5)
        failed = query.exception()
        query.stop()
        if failed is None:  # what came since the last interval
            start_monitor(spark, options.watchPath, checkpoint, options.report_interval_seconds, options.topk, options.queue_capacity, once=True).awaitTermination()
        spark.stop()
        return 0 if failed is None else 1
    except Exception as problem:
        print(f"Error: {problem}", file=sys.stderr)
        return 1
