"""Substring deduplication by recompression.

A round of recompression names runs of one symbol, then pairs of adjacent symbols: a symbol belongs to the left or the
right class by a bit of its name, and a run of a left symbol followed by a run of a right one gets the name of the pair.
Names are fingerprints of the round and of the names below, so they are the same in all documents without a dictionary,
and rounds are a narrow map. Whether two symbols join depends on them alone: a symbol is determined by its own words and one
symbol beside it on each side in every round, so equal stretches of words get equal symbols but for some at their edges.

Long repeats: rounds go on until symbols are longer than a window, LONG words or more. Spark counts their names over all
documents; an occurrence of a shared symbol that isn't the first one is a verified repeat of all its windows.

Edges of repeats, and short ones: every other window of 20 words is represented by symbols that it determines by itself, UNITS of
them in a row, of the highest level that the window holds, the least by hash. Windows represented by the same occurrence make a
stretch. Only symbols that occur more than once in all documents can belong to a repeated window; one pre-aggregated
count finds them. The words of a stretch are named as one symbol more: equal names verify a repeat of the whole stretch, and
only where the symbols stand in unlike stretches are their windows compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch, row_key

WINDOW = 20
#: Words from which on a symbol is long and joins no other.
LONG = 32
#: Symbols in a row that represent a window, by their level (0: words).
UNITS = (6, 5, 4)
#: Occurrences beyond which a symbol's rows are not dealt by the symbol.
HOT = 1000
BATCH = 500
_U = np.uint64


class Level:
    """Symbols after some rounds: first word, name, and the words from lo to hi that determine it.

    A symbol whose edge a document's end decides has a lo or hi outside of the document: no window determines it.
    """

    def __init__(self, at: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.at, self.name, self.lo, self.hi = at, name, lo, hi


def _round(x: Level, docs: np.ndarray, r: int, most: int | None = None) -> Level:
    """One round over the symbols of all documents (first words in docs): runs, then pairs. With most, symbols of so many words stay."""
    at, name = x.at, x.name
    n = len(at)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, docs)] = True
    free = ~first[1:n]  # between a symbol and the next one
    if most is not None:
        small = np.diff(np.append(at, docs[-1])) < most
        free &= small[:-1] & small[1:]
    with np.errstate(over="ignore"):
        right = (W.mix(name ^ (_U(r) * _U(0x632BE59BD9B4E019))) & _U(1)).astype(bool)
        equal = (name[1:] == name[:-1]) & free
        pair = ~right[:-1] & right[1:] & free
        run = np.flatnonzero(np.append(True, ~equal))  # first symbol of each run
        length = np.diff(np.append(run, n)).astype(_U)
        named = np.where(length > 1, W.mix(name[run] * _U(0xC2B2AE3D27D4EB4F) + length * _U(0x165667B19E3779F9) + _U(r)), name[run])
        tied = np.append(pair[run[1:] - 1], False)  # a run with the next one
        both = W.mix(named[:-1] * _U(0x9FB21C651E98DF25) + named[1:] + _U(r))
    named = np.where(tied, np.append(both, _U(0)), named)
    keep = np.append(True, ~tied[:-1])
    start, named = run[keep], named[keep]
    end = np.append(start[1:], n)
    lo = np.where(first[start], at[start] - 1, x.lo[start - 1])
    hi = np.where(first[end], np.append(at, docs[-1])[end] + 1, x.hi[np.minimum(end, n - 1)])
    return Level(at[start], named, lo, hi)


def symbols(h: np.ndarray, docs: np.ndarray) -> list[Level]:
    """Levels 0 to len(UNITS) - 1 of the words h of documents with first words docs[:-1]; no symbol crosses the end of a document."""
    i = np.arange(len(h))
    out = [Level(i, h, i, i + 1)]
    for r in range(1, len(UNITS)):
        out.append(_round(out[-1], docs, r) if len(h) else out[-1])
    return out


def long_symbols(h: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, name) of symbols of ``least`` words or more, after as many rounds as it takes."""
    i = np.arange(len(h))
    x, r, still = Level(i, h, i, i), 0, 0
    while len(x.at) and still < 8:  # a round that joins nothing may be chance: other bits follow
        r, before = r + 1, len(x.at)
        x = _round(x, docs, r, LONG)
        still = still + 1 if len(x.at) > 0.99 * before else 0
    end = np.append(x.at[1:], docs[-1])[: len(x.at)]
    long = end - x.at >= least
    return x.at[long], end[long], x.name[long]


def _least(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of value[a:b] for each of many ranges that aren't empty, by doubling."""
    out = np.zeros(len(a), value.dtype)
    size = (b - a).astype(np.int64)
    step, k = 1, 0
    while len(a):
        mine = np.flatnonzero((size >= step) & (size < 2 * step))
        out[mine] = np.minimum(value[a[mine]], value[b[mine] - step])
        if not (size >= 2 * step).any():
            return out
        value = np.minimum(value[:-step], value[step:])
        step, k = 2 * step, k + 1
    return out


def anchors(h: np.ndarray, docs: np.ndarray, window: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end, name) of stretches of windows that one occurrence of some symbols in a row represents.

    skip: whether a window takes no part. Two equal windows are never in one stretch: their symbols stand in unlike places.
    """
    n = len(h)
    inside = np.zeros(max(0, n - window + 1), bool)
    for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True):
        inside[a : max(a, b - window + 1)] = True
    if skip is not None:
        inside &= ~skip[: len(inside)]
    w = np.flatnonzero(inside)
    if not len(w):
        return w, w, np.zeros(0, _U)
    place, name = np.full(len(w), -1, np.int64), np.zeros(len(w), _U)
    levels = symbols(h, docs)
    for r in range(len(UNITS) - 1, -1, -1):
        x, k = levels[r], UNITS[r]
        if len(x.at) < k:
            continue
        units = W.mix(W.grams(x.name, k) ^ (_U(r + 1) * _U(0x2545F4914F6CDD1D % 2**63)))
        lo, hi = x.lo[: len(units)], x.hi[k - 1 :]
        todo = np.flatnonzero(place < 0)
        a = np.searchsorted(lo, w[todo], "left")
        b = np.searchsorted(hi, w[todo] + window, "right")
        held = b > a
        todo, a, b = todo[held], a[held], b[held]
        # the upper half of a name, then the place: of equal names the first in the window
        best = (_least((units & ~_U(0xFFFFFFFF)) | np.arange(len(units), dtype=_U), a, b) & _U(0xFFFFFFFF)).astype(np.int64)
        place[todo], name[todo] = best * len(UNITS) + r, units[best]
    new = np.append(True, (place[1:] != place[:-1]) | (w[1:] != w[:-1] + 1))
    s = np.flatnonzero(new)
    return w[s], w[np.append(s[1:], len(w)) - 1] + 1, name[s]


def _skipped(known: pa.Array, lo: int, docs: np.ndarray, window: int) -> np.ndarray:
    """The windows inside verified repeats, from lists [start, end, start, end, ...] of words of each document from row lo on."""
    part = known.slice(lo, len(docs) - 1)
    n = np.asarray(part.value_lengths().fill_null(0)).astype(np.int64)
    at = np.asarray(part.flatten()).astype(np.int64) + np.repeat(docs[:-1], n)
    edge = np.zeros(int(docs[-1]) + 2, np.int64)
    np.add.at(edge, at[0::2], 1)
    np.add.at(edge, at[1::2] - window + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _long_rows(window: int):
    """Long symbols: name, a second fingerprint of the words, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in W.chunks(batch.column(1)):
                w = W.Words(data, offs, W.SPACED)
                h = w.hashes()
                s, e, name = long_symbols(h, w.docs, window)
                check = (W.runs(W.mix(h ^ _U(0x5DEECE66D)), s, e) >> _U(33)).astype(np.int32)
                d = np.searchsorted(w.docs, s, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(check), batch.column(0).take(pa.array(lo + d)), pa.array((s - w.docs[d]).astype(np.int32)), pa.array((e - w.docs[d]).astype(np.int32))], ["name", "check", "doc_id", "start", "end"])

    return run


def _anchor_rows(window: int):
    """Stretches of windows with their symbol, their place (32 times the first window, and their number), and all their words as one fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in W.chunks(batch.column(1)):
                w = W.Words(data, offs, W.SPACED)
                h = w.hashes()
                s, e, name = anchors(h, w.docs, window, _skipped(batch.column(2), lo, w.docs, window))
                d = np.searchsorted(w.docs, s, "right") - 1
                content = W.runs(h, s, e + window - 1)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(lo + d)), pa.array((s - w.docs[d]) * 32 + e - s)], ["symbol", "content", "doc_id", "start"])

    return run


def _window_rows(window: int):
    """Of documents with some stretches: every window of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in W.chunks(batch.column(1)):
                w = W.Words(data, offs, W.SPACED)
                h = w.hashes()
                s, e = _picked(w.docs, batch.column(2), lo)
                n = e - s
                at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                full, check = (W.runs(x, at, at + window) for x in (h, W.mix(h ^ _U(0x5DEECE66D))))
                d = np.searchsorted(w.docs, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array((check >> _U(33)).astype(np.int32)), batch.column(0).take(pa.array(lo + d)), pa.array(at - w.docs[d])], ["window", "check", "doc_id", "start"])

    return run


def _picked(docs: np.ndarray, places: pa.Array, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows and ends of the stretches listed for each document from row lo on, as words of the chunk."""
    part = places.slice(lo, len(docs) - 1)
    n = np.asarray(part.value_lengths().fill_null(0)).astype(np.int64)
    at = np.asarray(part.flatten()).astype(np.int64)
    s = (at >> 5) + np.repeat(docs[:-1], n)
    return s, s + (at & 31)


def _removed(window: int, texts: bool):
    """Marks: for each document the words that repeated windows cover, and what is left."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, shared, first, mixed, firsts = (batch.column(i) for i in (2, 3, 4, 5, 6))
            copy = np.asarray(batch.column(7).fill_null(False).cast(pa.int8())).astype(bool)
            n_words, n_removed, digest, kept = [], [], [], []
            for lo, hi, data, offs in W.chunks(batch.column(1)):
                w = W.Words(data, offs, W.SPACED)
                n = np.diff(w.docs)
                gone = np.zeros(len(w) + 1, np.int64)
                if any(np.asarray(c.slice(lo, hi - lo).value_lengths().fill_null(0)).any() for c in (known, shared)):
                    edge = np.zeros(len(w) + 2, np.int64)
                    for column, step in ((shared, 1), (first, -1), (mixed, 1)):
                        a, b = _picked(w.docs, column, lo)
                        np.add.at(edge, a, step)
                        np.add.at(edge, b, -step)
                    mark = np.cumsum(edge[:-1]) > 0
                    f = firsts.slice(lo, hi - lo)
                    k = np.asarray(f.value_lengths().fill_null(0)).astype(np.int64)
                    mark[np.asarray(f.flatten()).astype(np.int64) + np.repeat(w.docs[:-1], k)] = False
                    at = np.flatnonzero(mark | _skipped(known, lo, w.docs, window)[: len(mark)])
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                keep = np.cumsum(gone[:-1]) == 0
                for d in np.flatnonzero(copy[lo:hi] & (n >= window)).tolist():
                    keep[w.docs[d] : w.docs[d + 1]] = False
                total = np.concatenate([[0], np.cumsum(keep)])
                left = total[w.docs[1:]] - total[w.docs[:-1]]
                n_words.append(n)
                n_removed.append(n - left)
                for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True):
                    k = keep[a:b]
                    text = W.joined(data, w.starts[a:b][k], w.ends[a:b][k])
                    digest.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        kept.append(text)
            cols = [batch.column(0), pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64)), pa.array(np.concatenate(n_removed) if n_removed else np.zeros(0, np.int64)), pa.array(digest, pa.string())]
            cols += [pa.array(kept, pa.binary()).cast(pa.string())] * texts
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return run


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text (kept words joined by one space).

    Words are what stands between white space, unchanged. A word goes if a window of ``window`` consecutive words covers it
    whose sequence also starts earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input.
    Null and empty texts have no words; an empty table gives an empty one. A document equal, as a text, to one of a smaller id
    goes whole without a comparison of its windows. Rows equal in id and text are one document: they are judged alike, and
    none repeats the other. Of rows that repeat an id with another text that with the smaller digest is earlier. Rows with a
    null id can't be ordered: they keep all their words and their row. Ids are whole numbers, also as texts; any other text is an error.
    Names and windows are compared by 95 bits of fingerprint.
    """
    if window < max(UNITS) or window > LONG:
        raise ValueError(f"window must be from {max(UNITS)} to {LONG}")
    scratch = Scratch(docs.sparkSession, "recompress")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    own, kind = row_key(docs, "id", "text")
    d = docs.select(own.alias("doc_id"), "id", "text")
    key = d.select("doc_id", F.unhex(F.md5("text")).alias("key")).where("doc_id is not null and key is not null")
    first = key.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.save(first, "texts-twice")
    copies = scratch.spread_join(key, first, "key", F.col("doc_id")).where("doc_id > first")
    copies = scratch.save(copies.select("doc_id").distinct(), "copies")
    # joins with texts shuffle at every size (but for Spark's own choice on tables of some megabytes): cost grows in proportion
    origin = d.select("doc_id", "text").where("doc_id is not null").join(copies, "doc_id", "left_anti")
    if kind != "bigint":
        origin = origin.dropDuplicates(["doc_id"])

    place = F.struct("doc_id", "start")
    long = scratch.save(origin.mapInArrow(_long_rows(window), f"name bigint, check int, doc_id {kind}, start int, end int"), "long", BATCH)
    first = long.groupBy("name", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    known = long.join(first, ["name", "check"]).where(place > F.col("first"))
    known = scratch.save(known.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("known")), "known")
    scratch.drop(long)

    rows = origin.join(known, "doc_id", "left").select("doc_id", "text", "known").mapInArrow(_anchor_rows(window), f"symbol bigint, content bigint, doc_id {kind}, start bigint")
    rows = scratch.save(rows, "stretches", BATCH)
    twice = scratch.save(rows.groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    # rows of hot symbols meet a table of one in HOT rows at most and stay where they are
    hot = scratch.small(scratch.save(twice.where(F.col("n") > HOT).select("symbol"), "hot"))
    shared = rows.join(hot, "symbol", "left_semi").unionByName(rows.join(hot, "symbol", "left_anti").join(twice.where(F.col("n") <= HOT).select("symbol"), "symbol"))
    shared = scratch.save(shared, "shared")
    scratch.drop(rows, twice)
    # of equal stretches all but the first go whole; first ones are compared by windows where a symbol stands in unlike ones
    unlike = shared.groupBy("symbol").agg((F.min("content") < F.max("content")).alias("mixed"))
    first = shared.groupBy("symbol", "content").agg(F.min(place).alias("x")).join(unlike, "symbol")
    first = first.groupBy("x.doc_id").agg(F.collect_list("x.start").alias("first"), F.collect_list(F.when(F.col("mixed"), F.col("x.start"))).alias("mixed"))
    stretches = shared.groupBy("doc_id").agg(F.collect_list("start").alias("shared")).join(first, "doc_id", "left")
    stretches = scratch.save(stretches.join(known, "doc_id", "full").select("doc_id", "known", "shared", "first", "mixed"), "by-document")
    scratch.drop(shared, known)

    some = stretches.where(F.size("mixed") > 0).select("doc_id", "mixed")
    windows = origin.join(some, "doc_id").select("doc_id", "text", "mixed").mapInArrow(_window_rows(window), f"window bigint, check int, doc_id {kind}, start bigint")
    firsts = windows.groupBy("window", "check").agg(F.min(place).alias("x"))
    firsts = scratch.save(firsts.groupBy("x.doc_id").agg(F.collect_list("x.start").alias("firsts")), "firsts", BATCH)
    none = [F.lit(None).cast(f"array<{'int' if c == 'known' else 'bigint'}>").alias(c) for c in ("known", "shared", "first", "mixed", "firsts")]
    marks = stretches.join(firsts, "doc_id", "left").withColumn("copy", F.lit(False))
    marks = marks.unionByName(copies.select("doc_id", *none, F.lit(True).alias("copy")))
    out = d.join(marks, "doc_id", "left").select("id", "text", "known", "shared", "first", "mixed", "firsts", "copy")
    return out.mapInArrow(_removed(window, texts), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)
