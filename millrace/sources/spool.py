"""A polling source over a spool folder of JSON lines, as a Python data source.

Each micro-batch takes at most ``maxPerPoll`` messages, in the order of file names and lines; the offset is a
file and a place in it, so a poll opens only the files that it reads from and reads no byte twice. Written
lines must not change; a last line without its end is not taken until it is a whole object, a line that is no
JSON is a message without fields whose ``payload`` is the line.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "message_id string, correlation_id string, ts string, headers string, payload string"
FIELDS = ("message_id", "correlation_id", "ts", "headers", "payload")
MAX_PER_POLL = 100


def _row(line: str) -> tuple:
    try:
        one = json.loads(line)
    except ValueError:
        one = None
    if not isinstance(one, dict):
        return (None,) * (len(FIELDS) - 1) + (line,)
    return tuple(None if one.get(k) is None else one[k] if isinstance(one[k], str) else json.dumps(one[k]) for k in FIELDS)


class SpoolReader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most = folder, most

    def _from(self, start: dict) -> Iterator[tuple[tuple, dict]]:
        """Messages from an offset on, each with the offset after it."""
        for path in sorted(Path(self.folder).glob("*.jsonl")):
            if path.name < start["file"]:
                continue
            with path.open("rb") as f:
                at = f.seek(start["at"] if path.name == start["file"] else 0)
                for raw in f:
                    if not raw.endswith(b"\n") and _row(raw.decode("utf-8", "replace"))[:4] == (None,) * 4:
                        break
                    at += len(raw)
                    if line := raw.decode("utf-8", "replace").strip():
                        yield _row(line), {"file": path.name, "at": at}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for row, end in self._from(start):  # noqa: B007  the last one is the end
            rows.append(row)
            if len(rows) == self.most:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        upto = (end["file"], end["at"])
        return (row for row, _ in itertools.takewhile(lambda x: (x[1]["file"], x[1]["at"]) <= upto, self._from(start)))


class SpoolSource(DataSource):
    """``spark.readStream.format("spool").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: object) -> SpoolReader:  # noqa: N802
        return SpoolReader(self.options["path"], int(self.options.get("maxPerPoll", MAX_PER_POLL)))


SOURCES: dict[str, type[DataSource]] = {"spool": SpoolSource}


class UnsupportedSourceError(ValueError):
    """A source that is neither known here nor to Spark."""


def register(spark: SparkSession) -> None:
    """Make the sources known to the session."""
    for source in SOURCES.values():
        spark.dataSource.register(source)


def source_of(name: str) -> type[DataSource]:
    """The source with this name."""
    if name not in SOURCES:
        raise UnsupportedSourceError(name)
    return SOURCES[name]
