"""Importance resampling towards a target distribution, over hashed word features.

External sort-count: texts become packed streams of uint16 buckets with the offsets of their documents, written once. Each
task sorts its streams in blocks and run-length encodes them, Spark adds the runs; later the gains of the buckets are gathered along the same
streams and summed by document with ``np.add.reduceat``. A task holds a block and one count for each bucket.

The draw is a Gumbel top-k: the score of a document is its weight plus noise from a hash of its id, so it doesn't depend on other rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, settings
from ._words import ALNUM, LOWER, Words, chunks

BUCKETS = 10_000
SEED = 2024
#: A document is in the draw from so many features on, of which this percentage is drawn.
LEAST_FEATURES, PERCENT = 20, 10
#: Words of more bytes are hashed one by one, the others side by side, byte after byte.
LONG_WORD = 48
#: Rows of an Arrow batch of texts and of one of blocks, and the bytes of text that a block is cut at.
ROWS_PER_BATCH, BLOCKS_PER_BATCH, BLOCK = 500, 50, 1 << 20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_of_words(w: Words) -> np.ndarray:
    """The unsigned crc32 of the folded bytes of each word."""
    lens = w.ends - w.starts
    out = np.full(len(lens), 0xFFFFFFFF, np.uint32)
    order = np.argsort(lens, kind="stable")
    first = np.searchsorted(lens[order], np.arange(LONG_WORD + 2))
    short = order[: first[-1]]
    at, crc, data = w.starts[short], out[short], w.fold[w.data]
    for i in range(int(lens[short].max(initial=0))):
        rest = slice(first[i + 1], None)  # those of more than i bytes
        c = crc[rest]
        crc[rest] = _CRC[(c ^ data[at[rest] + i]) & 0xFF] ^ (c >> 8)
    out[short] = ~crc
    for j in order[first[-1] :]:
        out[j] = zlib.crc32(data[w.starts[j] : w.ends[j]].tobytes())
    return out


def streams(docs: DataFrame, doc_id: str | None = None, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents: ids (null without doc_id), offsets of each document's features with the end of the last, stream (uint16, little-endian).

    A null or empty text has no features. A text of any length stays in one block, whose stream takes two bytes a word.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbers of 16 bits")
    key = F.col(doc_id) if doc_id else F.lit(None).cast("long")
    docs = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1), BLOCK):
                w = Words(data, offs, ALNUM, LOWER)
                stream = (crc32_of_words(w) % np.uint32(buckets)).astype("<u2")
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, hi - lo], ids), pa.array([w.docs.tolist()], pa.list_(pa.int64())), pa.array([stream.tobytes()], pa.binary())], ["ids", "offsets", "stream"])

    return docs.mapInArrow(run, f"ids array<{kind}>, offsets array<bigint>, stream binary")


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs (bucket, count) of several blocks as one, in order."""
    bucket, count = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(bucket, kind="stable")
    bucket, count = bucket[order], count[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return bucket[first], np.add.reduceat(count, first)


def sort_count(blocks: DataFrame) -> DataFrame:
    """How often each bucket occurs in all streams: bucket, n. Buckets that don't occur have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for stream in batch.column(0):
                x = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                if not len(x):
                    continue
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                held.append((x[first].astype(np.int64), np.diff(np.r_[first, len(x)])))
                if len(held) >= 16:
                    held = [_merged(held)]
        if held:
            bucket, count = _merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(count)], ["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    with settings(blocks.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BLOCKS_PER_BATCH):
        for r in sort_count(blocks).collect():  # one number for each bucket at most
            out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, floored, with one added to each count."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight: the floored mean of the gains of each document's features, 0 without any."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, stream in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                x, at = gain[np.frombuffer(stream.as_buffer(), "<u2")], offsets.values.to_numpy()
                n = np.diff(at)
                some = n > 0  # reduceat gives an empty document the gain of the next one
                total = np.zeros(len(n), np.int64)
                if some.any():
                    total[some] = np.add.reduceat(x, at[:-1][some])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_features", "weight"])

    return blocks.select("ids", "offsets", "stream").mapInArrow(run, f"doc_id {kind}, n_features bigint, weight bigint")


def noise(seed: int = SEED, doc_id: str = "doc_id") -> Column:
    """Thousandths of Gumbel noise from the hash of the seed and the id as text (a null id: no text), floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, least: int = LEAST_FEATURES, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id (of its own type), n_features, weight, score, rank: one row for each row of docs; rank is null where a document isn't drawn.

    Of the documents of ``least`` features or more the given percentage (floored) with the highest scores is drawn; of equal scores that of the smaller
    doc_id is first (null ids before all; rows that repeat an id in the order of the input). Null and empty texts have no features, weight 0
    and aren't drawn unless least is 0. An empty target or an empty docs counts nothing. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    blocks = scratch.save(streams(docs, doc_id, text, buckets), "streams", ROWS_PER_BATCH)
    gain = gains(_counts(blocks, buckets), _counts(scratch.save(streams(target, None, text, buckets), "target", ROWS_PER_BATCH), buckets))
    scored = weights(blocks, gain).withColumn("score", (F.col("weight") + noise(seed)).cast("long")).withColumn("row", F.monotonically_increasing_id())
    scored = scratch.save(scored, "scored", BLOCKS_PER_BATCH)
    scratch.drop(blocks)
    able = F.col("n_features") >= least
    # scores are thousandths of logarithms: the number of distinct ones doesn't grow with the input
    by_score = sorted(scored.where(able).groupBy("score").count().collect(), reverse=True)
    drawn = sum(n for _, n in by_score) * percent // 100
    lowest, above = None, 0
    for score, n in by_score:
        if above >= drawn:
            break
        lowest, above = score, above + n
    none = F.lit(None).cast("long")
    if lowest is None:
        return scored.select("doc_id", "n_features", "weight", "score", none.alias("rank"))
    top = able & (F.col("score") >= lowest)
    ranked = scratch.numbered(scored.where(top), "ranked", F.desc("score"), F.asc("doc_id"), F.asc("row"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).unionByName(scored.where(~top).select(*out, none.alias("rank")))
