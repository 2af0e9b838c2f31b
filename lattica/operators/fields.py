"""Work on whole fields: a field's cells meet in one row, and NumPy takes batches of fields at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells handled at once by a task, about.
CELLS = 500_000


def on_fields(
    df: DataFrame, size: dict[str, int], keys: list[str], values: list[str], kernel: Callable[[np.ndarray], list[np.ndarray]], axes: dict[str, int], names: list[str], missing: float = 0.0
) -> DataFrame:
    """(keys, axes, names): what kernel gives for the fields of each value. One shuffle, by field.

    size: the two axes of a field and their lengths. kernel: an array (fields, *size) -> arrays (fields, *axes), as many as there are
    names for one value; names: for all values in turn. Missing cells and nulls are `missing`; NaN in a result is null; cells outside the size are
    left out. A field, not the archive, has to fit in a task.
    """
    (y, h), (x, w) = size.items()
    (a, n_a), (b, n_b) = axes.items()
    each = len(names) // len(values)
    at = (F.col(y) * w + F.col(x)).cast("int").alias("at")
    inside = df.where(F.col(y).between(0, h - 1) & F.col(x).between(0, w - 1))
    packed = inside.groupBy(*keys).agg(F.collect_list(F.struct(at, *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)])).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = max(1, CELLS // (h * w))
        for batch in batches:
            for part in (batch.slice(k, per) for k in range(0, len(batch), per)):
                cells = part.column(len(keys))
                row = np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                out = [part.column(k).take(pa.array(np.repeat(np.arange(len(part)), n_a * n_b))) for k in range(len(keys))]
                out += [pa.array(np.tile(i, len(part)).astype(np.int32)) for i in (np.repeat(np.arange(n_a), n_b), np.tile(np.arange(n_b), n_a))]
                for k in range(len(values)):
                    field = np.full((len(part), h * w), missing)
                    given = flat.field(k + 1).to_numpy(zero_copy_only=False)
                    field[row, flat.field(0).to_numpy()] = np.where(np.isnan(given), missing, given)
                    made = kernel(field.reshape(-1, h, w))
                    assert len(made) == each
                    out += [pa.array(np.ascontiguousarray(m, float).ravel(), from_pandas=True) for m in made]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, a, b, *names])

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{c}` int" for c in axes] + [f"`{c}` double" for c in names]
    return packed.mapInArrow(run, ", ".join(kinds))
