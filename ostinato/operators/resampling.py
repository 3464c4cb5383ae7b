"""Permutations and resamples of tables of any size: drawn by rule from keys and seeds, so each task makes its part of a replicate on its own.

A permutation is a keyed bijection of row numbers, a resample is counts drawn from the top down; what leaves a task are sums of replicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, permutations that a task works on at once, and rounds of the bijection.
CHUNK, TOGETHER, ROUNDS = 4096, 64, 6
#: Permutations for which a chunk's values travel to another chunk once.
SHARED = 1024
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def permuted(x: np.ndarray, n: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    """Where numbers below n go under the permutation of each key, or with ``back`` where they come from: (keys, numbers).

    A Feistel network over the least even number of bits that holds n; numbers that leave the range go on until they are back in it.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, bits = _U((1 << half) - 1), _U(half)
    at = np.broadcast_to(x.astype(_U), (len(keys), len(x))).copy()
    with np.errstate(over="ignore"):
        rounds = [_mix(keys.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(i + 1)) for i in range(ROUNDS)]

    def once(v: np.ndarray, row: np.ndarray) -> np.ndarray:
        a, b = v >> bits, v & low
        for k in rounds[::-1] if back else rounds:
            with np.errstate(over="ignore"):
                a, b = (b ^ (_mix(a + k[row]) & low), a) if back else (b, a ^ (_mix(b + k[row]) & low))
        return (a << bits) | b

    row, col = (i.ravel() for i in np.indices(at.shape))
    while len(row):
        at[row, col] = once(at[row, col], row)
        out = at[row, col] >= _U(n)
        row, col = row[out], col[out]
    return at.astype(np.int64)


def numbered_chunks(df: DataFrame, cols: list[str]) -> tuple[DataFrame, int]:
    """Rows as chunks (chunk, one array for each column), numbered by their places: CHUNK in each but the last; and the number of rows.

    Numbers follow a hash of the values and then the values, so they are the same however often they are made. The driver sees one count for each
    partition.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.select(*cols).repartition(parts, F.xxhash64(*cols)).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    count = dict(dealt.groupBy(part.alias("p")).count().collect())
    first = np.cumsum([0, *(count.get(p, 0) for p in range(parts))]).tolist()
    number = place + F.element_at(F.lit(first), (part + 1).cast("int"))
    chunk = F.floor(number / CHUNK)
    rows = dealt.select(chunk.alias("chunk"), F.struct((number % CHUNK).alias("n"), *cols).alias("r"))
    g = rows.groupBy("chunk").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return g.select("chunk", *[F.col("r")[c].alias(c) for c in cols]), first[-1]


def permuted_resultants(df: DataFrame, a: str, b: str, n: int, seed: int) -> tuple[DataFrame, int]:
    """A row for each of n permutations of the partners: permutation, and the sums of cosines and sines of a - b (c1, s1) and a + b (c2, s2); and the number of rows.

    For every SHARED permutations each value travels once to each chunk where it has a partner, however many it has there; the task that holds a chunk's
    values and those of its partners finds who is whose by the way back. So what travels to a chunk is all values at most, and never more than a value for each of its
    rows and permutations: a task holds SHARED * CHUNK values at most.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    chunks, size = numbered_chunks(rows, ["a", "b"])
    blocks, targets = -(-n // SHARED), -(-size // CHUNK)

    def keys_of(block: int) -> Iterator[np.ndarray]:
        for lo in range(block * SHARED, min((block + 1) * SHARED, n), TOGETHER):
            yield np.arange(lo, min(lo + TOGETHER, (block + 1) * SHARED, n))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, values, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                v = values.values.to_numpy()
                own = np.arange(len(v))
                if 4 * targets <= SHARED:  # nearly every value has a partner in every chunk
                    pairs = ((t, own) for t in range(targets))
                else:
                    to = [np.unique(permuted(chunk * CHUNK + own, size, k + (seed << 20)) // CHUNK * CHUNK + own) for k in keys_of(block)]
                    met = np.unique(np.concatenate(to))
                    at, ends = met // CHUNK, np.flatnonzero(np.diff(met // CHUNK)) + 1
                    pairs = ((int(at[i[0]]), met[i] % CHUNK) for i in np.split(np.arange(len(met)), ends))
                for target, place in pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([target], pa.int64()), pa.array([block], pa.int64()), pa.array([chunk], pa.int64()), pa.array([place.astype(np.uint16).tobytes() if len(place) < len(v) else b""]), pa.array([v[place].tobytes()])], ["chunk", "block", "source", "place", "held"])

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (chunk, block), own, number, held = (k.as_py() for k in key), None, [], []
        for batch in batches:
            for source, place, values in zip(batch["source"].to_pylist(), batch["place"], batch["held"], strict=True):
                values = np.frombuffer(values.as_buffer(), float)
                if source < 0:
                    own = values
                else:
                    place = np.frombuffer(place.as_buffer(), np.uint16).astype(np.int64)
                    number.append(source * CHUNK + (place if len(place) else np.arange(len(values))))  # none: all of the chunk
                    held.append(values)
        number, held = np.concatenate(number), np.concatenate(held)
        order = np.argsort(number, kind="stable")
        number, held = number[order], held[order]
        for k in keys_of(block):
            source = permuted(chunk * CHUNK + np.arange(len(own)), size, k + (seed << 20), back=True)
            y = held[source if len(number) == size else np.searchsorted(number, source)]
            sums = [f(z).sum(axis=1) for z in (own - y, own + y) for f in (np.cos, np.sin)]
            yield pa.RecordBatch.from_arrays([pa.array(k), *[pa.array(x) for x in sums]], ["permutation", "c1", "s1", "c2", "s2"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, values, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([block], pa.int64()), pa.array([-1], pa.int64()), pa.array([b""]), pa.array([values.values.to_numpy().tobytes()])], ["chunk", "block", "source", "place", "held"])

    kind = "chunk bigint, block bigint, source bigint, place binary, held binary"
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long"))).alias("block")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    pieces = chunks.select("chunk", "b", block).repartition(4 * parts, "chunk", "block").mapInArrow(send, kind)
    met = pieces.unionByName(chunks.select("chunk", "a", block).mapInArrow(packed, kind)).repartition(4 * parts, "chunk", "block")
    sums = met.groupBy("chunk", "block").applyInArrow(gather, "permutation bigint, c1 double, s1 double, c2 double, s2 double").groupBy("permutation")
    return sums.agg(*[F.sum(c).alias(c) for c in ("c1", "s1", "c2", "s2")]), size


# --- resamples of means --------------------------------------------------------------------------------------------


#: Parts among which a group's chunks are dealt for each block of replicates.
DEALT = 16


def _below(counts: np.ndarray, replicate: np.random.Generator, total: int) -> np.ndarray:
    """How many of the total of a resample come from each part."""
    return replicate.multinomial(total, counts / counts.sum())


def mean_replicates(df: DataFrame, value: Column, keys: list[str], n: int, seed: int) -> DataFrame:
    """Keys, replicate, rows and mean of each of n resamples of a group's values; null and NaN are left out.

    Equal values are one with a count. A group's values are cut in about as many chunks as a chunk has values (256 at least), so a group of any size is spread over tasks. For
    a replicate each task draws, from the same seed, how many of the resample fall in each chunk, once for all its chunks of a group, and then which values of its own chunks.
    """
    rows = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    sizes = same.groupBy(*keys).agg(F.count("*").alias("_d")).withColumn("_m", F.ceil(F.col("_d") / F.greatest(F.lit(256.0), F.sqrt("_d"))))
    null_safe = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]

    def meet(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
        on = null_safe or [F.lit(True)]
        return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in cols])

    chunk = F.pmod(F.xxhash64("_v"), F.col("_m"))
    chunks = meet(same, sizes, "_m").groupBy(*keys, chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_x"), F.sum("_c").alias("_t"))
    all_chunks = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", "_t"))).alias("_all"))
    chunks = meet(chunks, all_chunks, "_all").withColumn("_group", F.xxhash64(F.lit(seed), *keys))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    blocks = min(16, n)
    work = chunks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    work = work.repartition(4 * parts, F.col("_group"), F.col("_block"), F.pmod("_chunk", F.lit(DEALT))).sortWithinPartitions("_group", "_block")
    work = work.select(*keys, "_chunk", F.col("_x._v").alias("_v"), F.col("_x._c").alias("_c"), F.col("_all._chunk").alias("_ids"), F.col("_all._t").alias("_ts"), "_group", "_block")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    p = len(keys)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, falls = None, np.empty((0, 0), int)
        for batch in batches:
            for i in range(batch.num_rows):
                own, v, c, ids, ts, group, block = (batch.column(p + j)[i] for j in range(7))
                v, c, ids, ts = (x.values.to_numpy() for x in (v, c, ids, ts))
                mine, total, held = int(np.searchsorted(ids, own.as_py())), int(ts.sum()), int(c.sum())
                ends = np.cumsum(c)
                mark = group.as_py() & 0xFFFFFFFFFFFFFFFF
                replicates = np.arange(n * block.as_py() // blocks, n * (block.as_py() + 1) // blocks)
                if last != (mark, block.as_py()):
                    last = mark, block.as_py()
                    falls = np.stack([_below(ts.astype(float), np.random.default_rng([mark, int(r)]), total) for r in replicates]) if len(ts) > 1 else np.full((len(replicates), 1), total)
                sums = np.empty(len(replicates))
                for j, r in enumerate(replicates):
                    k = int(falls[j, mine])
                    rng = np.random.default_rng([mark, int(r), own.as_py() + 1])
                    if held > 4 * len(v):
                        sums[j] = rng.multinomial(k, c / held) @ v
                    else:
                        sums[j] = v[np.searchsorted(ends, rng.integers(0, held, k), "right")].sum()
                kept = [batch.column(j).take(pa.array([i] * len(replicates))) for j in range(p)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(replicates), pa.array(sums), pa.array(np.full(len(replicates), total))], [*keys, "replicate", "sum", "rows"])

    drawn = work.mapInArrow(draw, ", ".join(filter(None, [kinds, "replicate bigint, sum double, rows bigint"])))
    g = drawn.groupBy(*keys, "replicate").agg(F.sum("sum").alias("sum"), F.max("rows").alias("rows"))
    return g.select(*keys, "replicate", "rows", (F.col("sum") / F.col("rows")).alias("mean"))
