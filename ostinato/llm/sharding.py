"""Sharding by a minimax contiguous partition: documents in the order of a digest, equal texts as one atomic group.

The smallest capacity for which the ordered groups fit in so many shards is found by bisection with a greedy check, and the shards
are cut there: no shard is larger than that, and within it cuts lie as near as they can to equal shares of what is left.

The driver never holds all groups. It holds segments of the order (all groups whose digests share a prefix) and their bytes. Filling
shards by whole segments bounds the capacity from above, filling them as if segments could be cut anywhere from below; where
the two differ, only the segments that a cut may fall in are split by a longer prefix. So its memory follows the number of shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Of a digest's 16 bytes, so many name a segment at first, and one more each time that it is split.
FIRST_PREFIX = 2
#: A segment of several groups is split at once if it has more than this share of a mean shard.
FINE = 1024


class Segments:
    """Bytes of consecutive segments, whether each is one group, and their prefixes."""

    def __init__(self, prefix: list[bytes], size: np.ndarray, whole: np.ndarray):
        self.prefix, self.size, self.whole = prefix, size, whole
        self.ends = np.concatenate([[0], np.cumsum(size)])

    def __len__(self) -> int:
        return len(self.size)

    @property
    def total(self) -> int:
        return int(self.ends[-1])

    def replaced(self, gone: np.ndarray, other: Segments) -> Segments:
        """With others in place of some."""
        keep = [i for i in range(len(self)) if not gone[i]]
        rows = [(self.prefix[i], int(self.size[i]), bool(self.whole[i])) for i in keep] + list(zip(other.prefix, other.size.tolist(), other.whole.tolist(), strict=True))
        rows.sort()
        return Segments([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool))

    def at(self, place: int) -> int:
        """The last boundary not beyond a place."""
        return int(np.searchsorted(self.ends, place, "right")) - 1


def _filled(s: Segments, capacity: int, shards: int, fluid: bool) -> list[int]:
    """Places, in bytes, at which shards filled one after the other end: by whole segments, or cutting those of several groups anywhere."""
    out, at = [], 0
    for _ in range(shards):
        i = s.at(at + capacity)
        end = int(s.ends[i])
        if fluid and i < len(s) and not s.whole[i]:
            end = at + capacity
        out.append(at := min(end, s.total))
    return out


def _least(s: Segments, shards: int, fluid: bool) -> int:
    """The smallest capacity whose shards take all."""
    lo, hi = -(-s.total // shards), s.total
    while lo < hi:
        mid = (lo + hi) // 2
        if _filled(s, mid, shards, fluid)[-1] >= s.total:
            hi = mid
        else:
            lo = mid + 1
    return lo


def capacity(s: Segments, shards: int) -> tuple[int, int, np.ndarray]:
    """Bounds of the smallest capacity, and the segments to split while they differ."""
    lo, hi = _least(s, shards, True), _least(s, shards, False)
    split = np.zeros(len(s), bool)
    if lo < hi:
        for a, b in zip(_filled(s, lo, shards, False), _filled(s, hi, shards, True), strict=True):
            split[s.at(a) : min(s.at(b), len(s) - 1) + 1] = True
    return lo, hi, split & ~s.whole


def cuts(s: Segments, shards: int, most: int) -> tuple[list[int], np.ndarray]:
    """The first segment of each shard with the end of the last, none over ``most``, and the segments to split before that is exact.

    From the right, shards filled up say where so many of them must begin at the latest; from the left, each cut lies
    between that and a full shard, as near as it can to an equal share of what is left (of two as near, the first).
    """
    split = np.zeros(len(s), bool)

    def boundary(place: int, up: bool = False) -> int:
        i = s.at(place)
        if i < len(s) and s.ends[i] < place:
            split[i] = True
            return i + up
        return i

    latest = [len(s)]
    for _ in range(shards - 1):
        latest.append(boundary(max(0, int(s.ends[latest[-1]]) - most), up=True))
    out = [0]
    for left in range(shards, 0, -1):
        here, rest = int(s.ends[out[-1]]), s.total - int(s.ends[out[-1]])
        full = boundary(here + most)
        share = boundary(here + rest // left)
        off = lambda i, here=here, rest=rest, left=left: abs(left * (int(s.ends[min(i, len(s))]) - here) - rest)
        best = share if share >= len(s) or off(share) <= off(share + 1) else share + 1
        out.append(max(out[-1], min(max(best, latest[left - 1]), full)))
    return out, split & ~s.whole


def _segments(rows: DataFrame, length: int, within: list[bytes] | None = None) -> Segments:
    """Segments of a prefix of so many bytes, of all rows or of those that share one of some prefixes a byte shorter."""
    if within is not None:
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(bytearray(p),) for p in within], "p binary")), F.substring("digest", 1, length - 1) == F.col("p"))
    out = rows.groupBy(F.substring("digest", 1, length).alias("p")).agg(F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("whole")).toArrow()
    order = sorted(zip(map(bytes, out["p"].to_pylist()), out["size"].to_pylist(), out["whole"].to_pylist(), strict=True))
    return Segments([r[0] for r in order], np.array([r[1] for r in order], np.int64), np.array([r[2] for r in order], bool))


def _finer(rows: DataFrame, s: Segments, split: np.ndarray) -> Segments:
    """With each of some segments split by one more byte of the digest."""
    for length in sorted({len(s.prefix[i]) for i in np.flatnonzero(split)}):
        gone = np.array([split[i] and len(s.prefix[i]) == length for i in range(len(s))])
        new = _segments(rows, length + 1, [s.prefix[i] for i in np.flatnonzero(gone)])
        s, keep = s.replaced(gone, new), {p for i, p in enumerate(s.prefix) if split[i] and not gone[i]}
        split = np.array([p in keep for p in s.prefix])
    return s


def bounds(rows: DataFrame, shards: int) -> list[bytes]:
    """The prefix at which each shard but the first begins, from rows (digest binary, size long); b"" begins at the end of all."""
    s = _segments(rows, FIRST_PREFIX)
    if not len(s):
        return [b""] * (shards - 1)
    while (large := ~s.whole & (s.size > s.total // shards // FINE)).any():
        s = _finer(rows, s, large)
    while True:
        _, most, split = capacity(s, shards)
        if not split.any():
            break
        s = _finer(rows, s, split)
    while True:
        out, split = cuts(s, shards, most)
        if not split.any():
            break
        s = _finer(rows, s, split)
    return [s.prefix[i] if i < len(s) else b"" for i in out[1:-1]]


def shard_of(digest: Column, starts: list[bytes]) -> Column:
    """The shard of a digest: how many of the other shards begin at or before it. A prefix is before all digests that it begins."""
    return sum((F.when(digest >= F.lit(bytearray(b)), 1).otherwise(0) for b in starts if b), F.lit(0)).cast("int")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), _digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (of its own type), size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    Rows of equal texts, null and empty ones together, are one group and share a shard; groups are ordered by the text's MD5, so a
    row's shard follows from its text and the bounds alone, and copies, however many, are never gathered. Slots number a shard's rows from 0
    by digest, doc_id (null first) and place in the input; rows that repeat an id or a whole row each have their own.
    A shard may be empty where there are fewer groups than shards, or none. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.save(_rows(docs, doc_id, text), "rows")
    starts = bounds(rows, shards)
    rows = rows.withColumn("shard", shard_of(F.col("digest"), starts))
    n = dict(rows.groupBy("shard").count().collect())
    first = np.cumsum([0, *(n.get(k, 0) for k in range(shards - 1))]).tolist()
    out = scratch.numbered(rows, "ordered", "digest", "doc_id", "row")
    slot = F.col("place") - F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Writes docs, all their columns, as one folder ``shard=k`` of Parquet files a shard; returns shard, rows, bytes of those that have rows.

    One pass finds the bounds, one writes: no row is shuffled, as its text says where it goes. A column named shard is an error.
    """
    if "shard" in docs.columns:
        raise ValueError("docs have a column named shard")
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.save(docs.select((F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + ROW_BYTES).cast("long").alias("size"), _digest(F.col(text)).alias("digest")), "rows")
    at = lambda d: shard_of(d, starts)
    starts = bounds(rows, shards)
    docs.withColumn("shard", at(_digest(F.col(text)))).write.mode("errorifexists").partitionBy("shard").parquet(path)
    return rows.groupBy(at(F.col("digest")).alias("shard")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
