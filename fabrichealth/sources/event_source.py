"""Event arrays as a Spark data source, in batch and as a stream with offsets: ``spark.read.format("fabric_events")``.

A path holds JSON files, each an array of one-key events or a scenario with such an array. Events of a file come in
order of their time, those of equal time in the file's order. As a stream the files are taken in order of their names and an
offset counts files, so a restart goes on at the first file that was not read. ``files_per_batch`` bounds a batch.
Files are read through the file system that the path names, in tasks. A file that is no JSON, or above the fixed sizes of a
scenario, is an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fabrichealth.sources.landed import MAX_BYTES, MAX_EVENTS

NAME = "fabric_events"
SCHEMA = (
    "file string, position long, timestamp_ns long, kind string, cpu int, bytes_req long, bytes_alloc long, latency_ns long, numa_node int, bytes_freed long, irq int, "
    "budget long, work_done long, len long, queue_pair_num long, is_error boolean, opcode int, port_num int, counter_kind string, counter_value long"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass
class FilePart(InputPartition):
    name: str


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The .json and .txt files at or below a folder in order of their paths, relative to it; "" for a file itself."""
    from pyarrow import fs

    system, place = _filesystem(path)
    if system.get_file_info(place).type == fs.FileType.File:
        return [""]
    found = system.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True))
    names = [f.path.removeprefix(place.rstrip("/")).lstrip("/") for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if n.endswith((".json", ".txt")) and not n.rsplit("/", 1)[-1].startswith(("_", ".")))


def events_of(root: str, name: str):
    """The events of a file in order of time, as tuples of SCHEMA."""
    path = f"{root.rstrip('/')}/{name}" if name else root
    system, place = _filesystem(path)
    if system.get_file_info(place).size > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    with system.open_input_stream(place) as stream:
        found = json.loads(stream.read().decode())
    found = found["events"] if isinstance(found, dict) else found
    if len(found) > MAX_EVENTS:
        raise ValueError(f"{path} has more than {MAX_EVENTS} events")
    rows = []
    for position, event in enumerate(found):
        (kind, fields), *_ = event.items()
        counter = fields.get("counter") or {}
        own = {**fields, "file": name or path.rsplit("/", 1)[-1], "position": position, "kind": kind, "counter_kind": next(iter(counter), None), "counter_value": next(iter(counter.values()), None)}
        rows.append(tuple(own.get(name) for name in FIELDS))
    yield from sorted(rows, key=lambda r: (r[2], r[1]))


class EventReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [FilePart(f) for f in listed(self.path)]

    def read(self, partition):
        yield from events_of(self.path, partition.name)


class EventStreamReader(DataSourceStreamReader):
    """Offsets count files; ``latestOffset`` goes on by ``files_per_batch`` at most."""

    def __init__(self, path: str, files_per_batch: int):
        self.path, self.files_per_batch, self.given = path, files_per_batch, None

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        there = len(listed(self.path))
        self.given = there if self.given is None or not self.files_per_batch else min(there, self.given + self.files_per_batch)
        return {"files": self.given}

    def partitions(self, start, end):
        self.given = end["files"]
        return [FilePart(f) for f in listed(self.path)[start["files"] : end["files"]]]

    def commit(self, end):
        pass

    def read(self, partition):
        yield from events_of(self.path, partition.name)


class EventSource(DataSource):
    """``path``: a folder or file; ``files_per_batch``: for streams, 0 for all there is."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EventReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventStreamReader(self.options["path"], int(self.options.get("files_per_batch", "0")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; another source is added the same way, under a name of its own."""
    spark.dataSource.register(EventSource)
