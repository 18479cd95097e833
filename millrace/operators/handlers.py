"""Handlers in Python: one message at a time, each on its own.

A handler that raises fails its message, never the job: the message gets an error that settlement understands
and the others go on. For rules that columns can express there is no need of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .flow import NoFunctionError, split


class PermanentError(Exception):
    """A message that no further attempt can help."""


class RetryAfterError(Exception):
    """A message to try again after so many seconds."""

    def __init__(self, seconds: float) -> None:
        super().__init__(f"retry after {seconds} s")
        self.seconds = seconds


def handled(df: DataFrame, handler: Callable[[dict], object] | None, result: str, inputs: list[str] | None = None) -> DataFrame:
    """Add ``result`` (what the handler returns, of the given type), ``error`` (null, ``permanent``,
    ``retry_after`` or, for any other exception or a result of another type, ``transient``), ``error_text`` and
    ``wait`` (seconds that a retry asks for). ``inputs`` are the columns that the handler sees (all)."""
    if handler is None:
        raise NoFunctionError("nothing to call")
    kind = T._parse_datatype_string(result)
    added = [("result", kind), ("error", T.StringType()), ("error_text", T.StringType()), ("wait", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    arrow, names = to_arrow_type(kind), df.columns
    seen = [names.index(c) for c in (inputs or names)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in seen]
            out: list[list] = [[], [], [], []]
            for row in zip(*values):
                found = error = text = wait = None
                try:
                    found = handler(dict(zip((names[i] for i in seen), row)))
                    pa.array([found], arrow)
                except PermanentError as e:
                    found, error, text = None, "permanent", str(e)
                except RetryAfterError as e:
                    found, error, text, wait = None, "retry_after", str(e), float(e.seconds)
                except Exception as e:  # a handler's fault is its message's
                    found, error, text = None, "transient", f"{type(e).__name__}: {e}"
                for c, v in zip(out, (found, error, text, wait)):
                    c.append(v)
            arrays = [*batch.columns, pa.array(out[0], arrow), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(n for n, _ in added)])

    return df.mapInArrow(each, schema)


def split_by(df: DataFrame, splitter: Callable[[dict], Iterable] | None, element: str, inputs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A message for each element that a function gives for a message, stamped like any split; and the messages
    on which it failed. No elements, no messages."""
    done = handled(df, splitter and (lambda row: list(splitter(row))), f"array<{element}>", inputs)
    children = split(F.col("result"))(done.where("error is null")).drop("result", "error", "error_text", "wait")
    return children, done.where("error is not null").drop("result")
