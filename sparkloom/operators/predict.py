"""States of series by any predictor the caller brings: built once a worker, fed whole series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predictor = Callable[[np.ndarray], np.ndarray]


def padded(x: np.ndarray, multiple: int) -> np.ndarray:
    """x with its end mirrored (the last value not twice) up to the next multiple beyond its length; a series of one value repeats it."""
    return np.pad(x, (0, multiple - len(x) % multiple), mode="reflect" if len(x) > 1 else "edge")


def predicted(df: DataFrame, keys: Sequence[str], order: str, y: str, build: Callable[[], Predictor], out: Sequence[str] = ("state",), multiple: int = 32) -> DataFrame:
    """df(keys, order, y) -> (keys, order, out): what the predictor gives for each sample of each series.

    `build()` makes the predictor once in each worker, with whatever model, library or device it needs; its argument is one series as
    float32, mirrored at its end to a multiple of samples, missing values as 0; its result has one row for each name of `out` (or is flat
    for one) and the argument's length.  A series is one row of arrays; batches of series stream through the worker.
    """
    kinds = dict(df.dtypes)
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(y).cast("double").alias("v")))).alias("r"))
    packed = packed.select(*keys, F.col("r.o").alias(order), F.col("r.v").alias("__y"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", *(f"{c} double" for c in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = build()
        for batch in batches:
            series, places = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            flat = np.nan_to_num(series.values.to_numpy(zero_copy_only=False)).astype(np.float32)
            bounds = series.offsets.to_numpy()
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                got = np.atleast_2d(np.asarray(predict(padded(flat[a:b], multiple)), dtype=float))
                if got.shape[0] < len(out) or got.shape[1] < b - a:
                    raise ValueError(f"the predictor gave {got.shape} for {b - a} samples of {len(out)} outputs")
                found.append(got[: len(out), : b - a])
            rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))
            values = np.concatenate([np.empty((len(out), 0)), *found], axis=1)
            heads = [batch.column(i).take(rows) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*heads, places.values.slice(bounds[0], bounds[-1] - bounds[0]), *map(pa.array, values)], [*keys, order, *out])

    return packed.mapInArrow(run, schema)
