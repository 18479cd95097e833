"""Payload codecs: what a payload is on the wire.

A codec is anything with ``encode(payload)`` and ``decode(wire)`` over columns; ``decode`` gives the value and
whether the wire could not be read, which is an error of its message.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Codec(Protocol):
    """Two column functions."""

    def encode(self, payload: Column) -> Column: ...

    def decode(self, wire: Column) -> tuple[Column, Column]: ...


class UnexpectedCodecError(ValueError):
    """A codec for an adapter whose payloads are values already."""


@dataclass(frozen=True)
class Json:
    """Payloads of a type as JSON; a null payload is the text ``null``. The wire must be one whole JSON value,
    fields that the type doesn't have are ignored, and a value of another type is an error."""

    schema: str

    def encode(self, payload: Column) -> Column:
        text = F.to_json(F.array(payload))
        return F.substring(text, F.lit(2), F.length(text) - 2).cast("binary")

    def decode(self, wire: Column) -> tuple[Column, Column]:
        text = F.when(F.is_valid_utf8(wire.cast("string")), wire.cast("string")) if hasattr(F, "is_valid_utf8") else wire.cast("string")
        # in an array, so that values other than objects can be read too
        read = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {self.schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        bad = F.try_parse_json(text).isNull() | read["_bad"].isNotNull()
        return F.when(~bad, read["v"]), F.coalesce(bad, F.lit(True))


class Bytes:
    """Bytes as they are, in both directions; null stays null."""

    def encode(self, payload: Column) -> Column:
        return payload.cast("binary")

    def decode(self, wire: Column) -> tuple[Column, Column]:
        return wire.cast("binary"), F.lit(False)


def resolve(live: bool, codec: Codec | None, schema: str) -> Codec | None:
    """The codec of an adapter: none for live values, for which none may be given; else the one given, or JSON
    of the schema."""
    if live and codec is not None:
        raise UnexpectedCodecError("payloads of this adapter are values already")
    return None if live else codec or Json(schema)
