"""Event-stream parser: whole captures as rows in, events out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_EVENT = 1 << 20
SCHEMA = "stream_id string, seq long, event_id string, event string, data string, retry_ms long, error string"


def parse(text: str, most: int = MAX_EVENT) -> Iterator[tuple[str, str, str, int | None, str | None]]:
    """Events as (last id, name, data, retry, error) of a stream.

    A byte-order mark is skipped; lines end with CR, LF or both; lines from a colon on are comments; an id
    with NUL is ignored and a valid one stays for later events; an event without data is none; a tail
    without its blank line is dropped. Too large an event ends the stream with an error.
    """
    text = text.removeprefix("\ufeff")
    lines = re.split("\r\n|\r|\n", text)
    # what follows the last line end isn't a line yet
    last, name, data, size, retry = "", "", [], 0, None
    for line in lines[:-1]:
        if not line:
            if data:
                yield last, name or "message", "\n".join(data), retry, None
            name, data, size = "", [], 0
            continue
        key, _, value = line.partition(":")
        value = value.removeprefix(" ")
        size += len(line.encode())
        if size > most:
            yield last, name or "message", "", retry, "too_large"
            return
        if key == "data":
            data.append(value)
        elif key == "event":
            name = value
        elif key == "id" and "\0" not in value:
            last = value
        elif key == "retry" and value.isascii() and value.isdigit():
            retry = int(value)


def parse_streams(captures: DataFrame, most: int = MAX_EVENT) -> DataFrame:
    """Events of ``captures(stream_id, text)``; a null capture has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(sid, n, *e) for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, e in enumerate(parse(text or "", most), 1)]
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["stream_id", "seq", "event_id", "event", "data", "retry_ms", "error"])

    return captures.selectExpr("cast(stream_id as string) as stream_id", "text").mapInArrow(each, SCHEMA)
