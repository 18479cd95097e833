"""Vectorised handling of text columns: Arrow string arrays as flat byte buffers in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text (one row at least), so temporaries stay small."""
    offsets = column(batch, "text")[1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its rows in them (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: their starts, ends and rows."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    keep = inside[cut[:-1]] if len(cut) > 1 else np.zeros(0, bool)
    starts, ends = cut[:-1][keep], cut[1:][keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal bytes have equal hashes in every process."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    at, size = starts[order], lens[order]
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    for k in range(min(int(size[0]) if len(size) else 0, 48)):
        n = int(np.searchsorted(-size, -k, "left"))
        h[:n] = (h[:n] ^ raw[at[:n] + k]) * np.uint64(0x100000001B3)
    for i in range(int(np.searchsorted(-size, -48, "left"))):
        h[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
