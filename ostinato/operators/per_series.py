"""Kernels over whole series: one narrow pass over Arrow batches, with an error column instead of a failed job."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string


def seed_of(series_id: str) -> int:
    """A seed that depends on the series alone, so that a result doesn't depend on its place in a table."""
    return zlib.crc32(str(series_id).encode()) & 0x7FFFFFFF


def spread(arrays: DataFrame, partitions: int | None = None) -> DataFrame:
    """Series dealt evenly over tasks by a hash of their id: before kernels whose cost outweighs a shuffle."""
    spark = arrays.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return arrays.repartition(n, F.xxhash64("series_id", F.lit("spread")))


def apply(arrays: DataFrame, fn: Callable[[np.ndarray, np.ndarray, int], dict], schema: str, least: int = 6, extra: str | None = None) -> DataFrame:
    """The rows of an array-form table with the fields that fn(t, y, seed) returns, and ``error``.

    Series that are null, too short, of unlike lengths, or hold a missing value get nulls and say why, as do series for
    which fn raises. The value of a column ``extra`` is handed to fn as a fourth argument. Columns besides series_id, t and y pass through, unless a field has their name.
    """
    fields: StructType = _parse_datatype_string(schema)
    names = [f.name for f in fields]
    arrays = arrays.select(*[c for c in arrays.columns if c not in (*names, "error")])
    at = {c: arrays.columns.index(c) for c in ("series_id", "t", "y", *([extra] if extra else []))}

    def one(k: str, t: list | None, y: list | None, *more) -> dict:
        if (why := _unfit(t, y, least)) is not None:
            return {"error": why}
        try:
            return fn(np.array(t, float), np.array(y, float), seed_of(k), *more)
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError) as e:
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(k, t, y, *more) for k, t, y, *more in zip(*(batch.column(i).to_pylist() for i in at.values()), strict=True)]
            cols = [pa.array([_plain(r.get(f.name)) for r in rows], to_arrow_type(f.dataType)) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array([r.get("error") for r in rows], pa.string())], [*batch.schema.names, *names, "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.schema)
    return arrays.mapInArrow(run, f"{kept}, {schema}, error string")


def apply_many(arrays: DataFrame, fn: Callable[[np.ndarray, np.ndarray, list[int]], list[dict]], schema: str, least: int = 6, block: int = 32) -> DataFrame:
    """As ``apply``, with fn(t, rows of y, seeds) for up to ``block`` series of the same times at once.

    Blocks of the same times are of equal sizes, to one. fn must give a series the same fields whatever it shares a block with. Where it raises for a block, each of its series is tried alone.
    """
    fields: StructType = _parse_datatype_string(schema)
    names = [f.name for f in fields]
    arrays = arrays.select(*[c for c in arrays.columns if c not in (*names, "error")])
    at = {c: arrays.columns.index(c) for c in ("series_id", "t", "y")}

    def several(t: np.ndarray, ys: list[np.ndarray], keys: list[str]) -> list[dict]:
        try:
            return fn(t, np.stack(ys), [seed_of(k) for k in keys])
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError) as e:
            if len(ys) == 1:
                return [{"error": f"{type(e).__name__}: {e}"}]
            return [r for y, k in zip(ys, keys, strict=True) for r in several(t, [y], [k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = [{}] * batch.num_rows
            same: dict[bytes, list] = {}
            for i, (k, t, y) in enumerate(zip(*(batch.column(j).to_pylist() for j in at.values()), strict=True)):
                if (why := _unfit(t, y, least)) is not None:
                    rows[i] = {"error": why}
                else:
                    same.setdefault(np.array(t, float).tobytes(), []).append((i, k, np.array(y, float)))
            for times, members in same.items():
                parts = -(-len(members) // block)
                for p in range(parts):
                    some = members[len(members) * p // parts : len(members) * (p + 1) // parts]
                    for (i, _, _), r in zip(some, several(np.frombuffer(times), [y for _, _, y in some], [k for _, k, _ in some]), strict=True):
                        rows[i] = r
            cols = [pa.array([_plain(r.get(f.name)) for r in rows], to_arrow_type(f.dataType)) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array([r.get("error") for r in rows], pa.string())], [*batch.schema.names, *names, "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.schema)
    return arrays.mapInArrow(run, f"{kept}, {schema}, error string")


def _unfit(t: list | None, y: list | None, least: int) -> str | None:
    """Why a series can't be worked on."""
    if t is None or y is None:
        return "no series"
    if len(t) != len(y):
        return "times and values differ in number"
    if len(y) < least:
        return f"fewer than {least} points"
    if np.isnan(np.array(t, float)).any() or np.isnan(np.array(y, float)).any():
        return "values are missing"
    return None


def _plain(x):
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    return x
