"""Columns worked out by array functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def ddl(df: DataFrame) -> str:
    """The schema of a table as text, with quoted names."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _array(values: np.ndarray, kind: pa.DataType, missing: np.ndarray) -> pa.Array:
    if pa.types.is_list(kind):
        flat = pa.array(np.ascontiguousarray(values).reshape(-1), kind.value_type)
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        lists = pa.ListArray.from_arrays(offsets, flat)
        return pa.array(lists.to_pylist(), kind, mask=missing) if missing.any() else lists
    return pa.array(np.asarray(values), kind, mask=missing)


def computed(df: DataFrame, inputs: Sequence[str], outputs: Mapping[str, str], function: Callable[..., tuple[np.ndarray, ...] | np.ndarray]) -> DataFrame:
    """Adds the columns ``outputs`` (name to type), the result of ``function`` over the arrays of ``inputs``.

    Rows in which an input is null get nulls. Columns of the same names are replaced.
    """
    kept = [c for c in df.columns if c not in outputs]
    kinds = [_KINDS[t] for t in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            missing = np.zeros(batch.num_rows, bool)
            for c in columns:
                missing |= c.is_null().to_numpy(zero_copy_only=False)
            arrays = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
            found = function(*arrays)
            found = found if isinstance(found, tuple) else (found,)
            out = [_array(v, k, missing) for v, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *out], names=[*kept, *outputs])

    schema = ", ".join([*([ddl(df.select(*[f"`{c}`" for c in kept]))] if kept else []), *[f"`{k}` {t}" for k, t in outputs.items()]])
    return df.mapInArrow(run, schema)
