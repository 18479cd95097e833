"""Ordered folds: rules whose next state depends on the last one and that have no closed form.

One task folds a key at a time over Arrow batches sorted by key and order, so a key of any length needs the
memory of one batch and of its state; only rules that are sequential by nature are written this way. Columns
that a rule doesn't read stay in Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The state of a key (None at its start) and a run of values of each input give the next state and the outputs.
Step = Callable[..., tuple[object, tuple]]


def fold(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, out: dict[str, str]) -> DataFrame:
    """Add the columns of ``out`` to every row: ``step(state, *lists)`` is called for each run of rows of a
    key with a list for each of ``inputs``, and gives the next state and a list for each of ``out``."""
    names, added = df.columns, list(out)
    schema = T.StructType([*df.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in out.items()]])
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[out[k]] for k in added]
    at, wanted = names.index(key), [names.index(c) for c in inputs]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun = None, None, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(at).dictionary_encode()
            ids = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), n]
            values = [batch.column(i).to_pylist() for i in wanted]
            columns: list[list] = [[] for _ in added]
            for low, high in zip(cuts, cuts[1:]):
                now = codes.dictionary[ids[low]].as_py() if ids[low] >= 0 else None
                if not begun or now != current:
                    state, current, begun = None, now, True
                state, found = step(state, *(v[low:high] for v in values))
                for c, f in zip(columns, found):
                    c.extend(f)
            arrays = [*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    dealt = df.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(each, schema)
