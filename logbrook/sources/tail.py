"""A streaming source of a folder's file events and the byte ranges that each trigger appends.

The driver only lists the folder and looks for the last line end of grown files; executors read the ranges
(`files.read_ranges`). An offset holds each file's range, so a trigger can be replayed exactly, and lines
without their end are left for later, so there is no carry to keep. Every trigger moves the offset and gives a Tick
row, so intervals without events are reported too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "kind string, path string, old_path string, generation int, start long, end long, status string, processable boolean, published long, dropped long"
LOOK = 65536


def last_line_end(path: str, start: int, size: int) -> int:
    """Where the last complete line of [start, size) ends; start if none does."""
    with open(path, "rb") as file:
        at = size
        while at > start:
            begin = max(start, at - LOOK)
            file.seek(begin)
            found = file.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return start


def processable(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in (".log", ".txt") or name.lower() in (".log", ".txt")


def listing(folder: str) -> dict[str, tuple[int, int, int]]:
    """Size, change time and inode of each plain file of the folder."""
    found = {}
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                if entry.is_file():
                    s = entry.stat()
                    found[entry.path] = (s.st_size, s.st_mtime_ns, s.st_ino)
            except OSError:
                continue
    return found


def advanced(state: dict, folder: str, capacity: int, latest: bool = False) -> dict:
    """The state after one more look at the folder; `events` of the new state are what happened since.

    Events beyond the capacity are dropped, the newest first, and leave the file's state as it was, so that the next
    event of that file reads all its bytes. A file that shrank is read from its start, and so is one that took another's name.
    """
    files, epochs = dict(state["files"]), dict(state["epochs"])
    events: list[list] = []
    published, dropped, errors = state["published"], state["dropped"], state.get("errors", 0)
    try:
        now = listing(folder)
    except OSError:
        errors += 1  # counted in the offset, which progress reports show
        now = {path: (f["size"], f["mtime"], f["inode"]) for path, f in files.items()}
    gone = [path for path, f in files.items() if path not in now or now[path][2] != f["inode"]]  # also replaced under its name
    came = [path for path in now if path not in files or path in gone]
    by_inode = {files[path]["inode"]: path for path in gone}
    moved = {path: by_inode.pop(now[path][2]) for path in came if now[path][2] in by_inode}
    steps = [("Deleted", path, None) for path in gone if path not in moved.values()]
    steps += [("Renamed", path, old) for path, old in moved.items()]  # before a new file takes the old name
    steps += [("Created", path, None) for path in came if path not in moved]
    steps += [("Modified", path, None) for path in now if path in files and path not in gone and (now[path][0], now[path][1]) != (files[path]["size"], files[path]["mtime"])]
    for kind, path, old in steps:
        if len(events) >= capacity:
            dropped += 1
            continue
        published += 1
        for dead in [path] if kind == "Deleted" else [old] if old else []:
            files.pop(dead, None)
            epochs[dead] = epochs.get(dead, 0) + 1
        if kind == "Deleted":
            events.append([kind, path, None, epochs[path], 0, 0, "NoData", processable(path)])
            continue
        size, mtime, inode = now[path]
        before = files.get(path, {}).get("offset", 0)
        start, end, status = before, before, "NoData"
        if processable(path):
            if size < before:
                start, status = 0, "TruncatedReset"
            try:
                end = size if latest else last_line_end(path, start, size)
                status = status if status == "TruncatedReset" or end == start else "ReadSome"
            except FileNotFoundError:
                end, status = start, "FileNotFound"
            except PermissionError:
                end, status = start, "AccessDenied"
            except OSError:
                end, status = start, "IoError"
            if latest:
                start = end
        files[path] = {"size": size, "mtime": mtime, "inode": inode, "offset": end}
        events.append([kind, path, old, epochs.get(path, 0) + 1, start, end, status, processable(path)])
    return {"tick": state["tick"] + 1, "files": files, "epochs": epochs, "published": published, "dropped": dropped, "errors": errors, "events": events}


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = os.path.abspath(options["path"])
        self.capacity = int(options.get("queuecapacity", options.get("queueCapacity", "10000")))
        self.latest = options.get("startingoffsets", options.get("startingOffsets", "earliest")) == "latest"
        if self.capacity < 1:
            raise ValueError("queueCapacity must be at least 1")

    def initialOffset(self) -> dict:
        return {"tick": 0, "files": {}, "epochs": {}, "published": 0, "dropped": 0, "errors": 0, "events": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = advanced(start, self.folder, self.capacity, self.latest and start["tick"] == 0)
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [(*event, None, None) for event in end["events"]]
        return iter([*rows, ("Tick", None, None, None, None, None, None, None, end["published"], end["dropped"])])


class TailDataSource(DataSource):
    """`spark.readStream.format("log_tail").load(folder)`; options queueCapacity and startingOffsets (earliest or latest)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options)
