"""Line deduplication by a join of deletion neighbourhoods.

Lines are sequences of words; two lines are near if one word is put in, left out or changed. Equal lines are joined by
their fingerprints. For the rest, a line of n words emits the n variants with one word left out: equal variants that
lack the same position differ in that word only, and a variant equal to a whole line differs from it by a deletion; so
the edit bound needs no other pairs, and the earliest line of each key is partner enough for all its lines. Partners
are verified by their edit distance.

Before that, a filter keeps the lines that can have a partner: one edit leaves the first or the last half of a line
as it was, so a line whose halves (two keys, or four) occur in no other line emits no variants.

With ``edit_every`` = E the bound grows: lines may differ in one edit, and in one for each E units of the longer. k edits
leave a stretch of (n - k) / (k + 1) units or more as it was, so from 2 E units on two near lines share a stretch of
(2 E - 2) / 3 units, from 4 E units on one of (4 E - 4) / 5, and winnowing picks the same gram of it in both, at places at
most k apart. The first line of each
gram is tried as a partner before the others are. Units are words, or characters in lines of few words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch, fresh, row_key

#: Words of the shortest line that can be a duplicate, and of the shortest to which the edit bound of one word applies.
MIN_WORDS, MIN_EDIT_WORDS = 2, 8
#: Units of a line for each edit that the registered queries allow; characters of their shortest line of few words.
EDIT_EVERY, MIN_CHARS = 20, 20
#: Lines of a gram beyond which they are compared in tiles, and lines of a tile.
MANY, TILE = 64, 2048
BATCH = 500
#: Bytes of texts whose lines are named at once, if no text is longer.
LINE_CHUNK = 1 << 20
_SALT = (np.uint64(0), np.uint64(0x27D4EB2F165667C5))


def split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines with the end of the last, and the first line of each text with the end of the last."""
    brk = np.flatnonzero(data == 10) + 1
    at = np.unique(np.concatenate([offs, brk]))
    first = np.searchsorted(at, offs)
    # a text that ends in a line break has an empty last line, which has no words and no place in ``at``; an empty text none
    return at, first


def _lines(data: np.ndarray, offs: np.ndarray):
    at, first = split(data, offs)
    w = W.Words(data, offs, W.SPACED)
    return at, first, w, np.searchsorted(w.starts, at)


def _chars(w: W.Words, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the characters of lines, given by their words and the first word of each with the end of the last,
    joined by one space; and the first character of each line with the end of the last."""
    data, at = W.spaced(w, words, first)
    start = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    nth = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    code = np.add.reduceat(data.astype(np.uint64) << (8 * nth).astype(np.uint64), start)
    return W.mix(code + np.uint64(0x1B873593)), np.searchsorted(start, at)


def _units(w: W.Words, h: np.ndarray, lw: np.ndarray, least_edit: int, min_chars: int | None):
    """(lines, units, first unit of each line, end of its units, whether they are characters) of lines with an edit bound."""
    n = np.diff(lw)
    k = np.flatnonzero(n >= least_edit)
    yield k, h, lw[k], lw[k + 1], 0
    if min_chars is not None:
        k = np.flatnonzero((n > 0) & (n < least_edit))
        words = np.repeat(lw[k] - np.concatenate([[0], np.cumsum(n[k])[:-1]]), n[k]) + np.arange(n[k].sum()) if len(k) else np.zeros(0, np.int64)
        c, at = _chars(w, words, np.concatenate([[0], np.cumsum(n[k])]))
        ok = np.diff(at) >= min_chars
        yield k[ok], c, at[:-1][ok], at[1:][ok], 1


def _winnow(h: np.ndarray, a: np.ndarray, b: np.ndarray, every: int, unit: int, places: bool) -> tuple[np.ndarray, ...]:
    """(line, key) of grams of lines h[a:b], picked so that near lines, the longer of 2 every units or more, share one.

    k edits leave a stretch of (n - k) / (k + 1) units: 2 (every - 1) / 3 at least, and 4 (every - 1) / 5 where the longer has
    4 every units or more. The longer the stretch the fewer grams it takes; lines that can be in both cases pick for both.
    The stretches that start at some places of a line, the line's own, are so many and disjoint that one of them is as it was in each
    line within the bound: near lines share a gram that is one of the own picks of either. The lowest bit of a key says so.
    With places: (line, key, place, own), the lowest bit 0.
    """
    n, parts = b - a, []
    gram = max(1, -(-2 * (every - 1) // 3) - 3) if unit else -(-2 * (every - 1) // 3) // 2
    g = W.mix(W.grams(h, gram) ^ _SALT[unit] ^ np.uint64(0x7A3D70B1)) & ~np.uint64(1)
    for m, some in ((2, n < 4 * every), (4, n >= 4 * (every - 1))):
        stretch = -(-m * (every - 1) // (m + 1))
        wide = stretch - gram + 1
        count = np.where(some, np.maximum(n - stretch + 1, 0), 0)
        if not count.sum():
            continue
        line = np.repeat(np.arange(len(a)), count)
        i = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        rel, size = i - a[line], n[line]
        most = size // (every - 1)
        own = (rel % stretch == 0) & (rel // stretch <= most) | (size // stretch <= most)
        if places:
            at = i + np.lib.stride_tricks.sliding_window_view(g, wide).argmin(axis=1)[i]
            parts.append((line, g[at], at - a[line], own))
            continue
        least, w = g, 1
        while w < wide:
            step = min(w, wide - w)
            least, w = np.minimum(least[:-step], least[step:]), w + step
        key = least[i]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        parts.append((line[new], key[new] | np.logical_or.reduceat(own, np.flatnonzero(new)).astype(np.uint64)))
    none = np.zeros(0, np.int64)
    empty = (none, none.view(np.uint64), none, none.astype(bool))[: 4 if places else 2]
    return tuple(np.concatenate([e, *x]) for e, x in zip(empty, zip(*parts), strict=True)) if parts else empty


def _line_rows(least: int, least_edit: int, every: int | None = None, min_chars: int | None = None):
    """Lines: name, check, doc_id, line, n, whether an equal one stands above it in the document, and the keys of halves and grams
    that lines with a partner share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, offs in W.chunks(batch.column(1), LINE_CHUNK):
                _, first, w, lw = _lines(data, offs)
                n = np.diff(lw)
                h = w.hashes()
                keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for k, u, a, b, unit in _units(w, h, lw, least_edit, min_chars):
                    m = b - a
                    if every:
                        long = m >= 2 * every - 2
                        line, key = _winnow(u, a[long], b[long], every, unit, False)
                        keys.append(key)
                        of.append(k[long][line])
                        short = m < 2 * every
                        a, b, m, k = a[short], b[short], m[short], k[short]
                    for q, some in ((m // 2, m > 0), ((m + 1) // 2, m % 2 == 1)):
                        for s, e, salt in ((a, a + q, 0x51ED270B), (b - q, b, 0x2C1B3C6D)):
                            keys.append(W.mix(W.runs(u, s, e) ^ np.uint64(salt) ^ _SALT[unit])[some] | np.uint64(1))
                            of.append(k[some])
                of = np.concatenate(of)
                keys = np.concatenate(keys)[np.argsort(of, kind="stable")]
                held = np.bincount(of, minlength=len(n))
                k = np.flatnonzero((n >= least) | (held > 0))
                name = W.runs(h, lw[k], lw[k + 1])
                check = (W.runs(W.mix(h ^ np.uint64(0x5DEECE66D)), lw[k], lw[k + 1]) >> np.uint64(33)).astype(np.int32)
                d = np.searchsorted(first, k, "right") - 1
                by = np.lexsort((k, check, name, d))
                same = np.zeros(len(k), bool)
                same[by[1:]] = (name[by[1:]] == name[by[:-1]]) & (check[by[1:]] == check[by[:-1]]) & (d[by[1:]] == d[by[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held[k])]), pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(check), ids.take(pa.array(lo + d)), pa.array((k - first[d]).astype(np.int32)), pa.array(n[k].astype(np.int32)), pa.array(same), lists], ["name", "check", "doc_id", "line", "n", "again", "keys"])

    return run


def _picker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of listed lines, joined by one space."""
    for batch in batches:
        for lo, hi, data, offs in W.chunks(batch.column(1)):
            _, first, w, lw = _lines(data, offs)
            want = batch.column(2).slice(lo, hi - lo)
            doc = np.repeat(np.arange(hi - lo), np.asarray(want.value_lengths().fill_null(0)))
            line = np.asarray(want.flatten()).astype(np.int64)
            a, n = lw[first[doc] + line], lw[first[doc] + line + 1] - lw[first[doc] + line]
            at = np.concatenate([[0], np.cumsum(n)])
            text, ends = W.spaced(w, np.repeat(a - at[:-1], n) + np.arange(at[-1]), at)
            text = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc)), pa.array(line.astype(np.int32)), text, pa.array(n.astype(np.int32))], ["doc_id", "line", "text", "n"])


def _spans(col: pa.Array, least_edit: int, min_chars: int | None):
    """(lo, units) of texts that are one line each: the first row of a chunk, and its lines' units."""
    for lo, _, data, offs in W.chunks(col):
        w = W.Words(data, offs, W.SPACED)
        yield lo, _units(w, w.hashes(), w.docs, least_edit, min_chars)


def _variants(least_edit: int, every: int | None, min_chars: int | None):
    """Keys of a line: its own as a whole (kind 0), and with each unit left out, for deletions (1) and changes (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = batch.column(0), batch.column(1)
            for lo, some in _spans(batch.column(2), least_edit, min_chars):
                for k, u, a, b, unit in some:
                    short = (b - a < 2 * every) if every else np.ones(len(k), bool)
                    k, first, end = k[short], a[short], b[short]
                    n = end - first
                    of = np.repeat(np.arange(len(k)), n)
                    docs = np.concatenate([[0], np.cumsum(n)])
                    h = u[np.repeat(first - docs[:-1], n) + np.arange(docs[-1])]
                    up, down = W._WORDS(len(h) + 2)
                    with np.errstate(over="ignore"):
                        total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
                        i = np.arange(len(h))
                        a, b = docs[of], docs[of + 1]
                        # the units before i stay, those after it move up by one place
                        rest = (total[i] - total[a]) * down[a] + (total[b] - total[i + 1]) * down[a] * down[1]
                        gone = W.mix(rest + (n[of] - 1).astype(np.uint64))
                        whole = W.runs(h, docs[:-1], docs[1:])
                        changed = W.mix(gone ^ W.mix((i - a + 1).astype(np.uint64)))
                    # equal neighbours give equal variants: once is enough for deletions
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                    key = (np.concatenate([whole, gone[new], changed]) ^ _SALT[unit]).view(np.int64)
                    who = lo + k[np.concatenate([np.arange(len(n)), of[new], of])]
                    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(n), int(new.sum()), len(h)])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), ids.take(pa.array(who)), nos.take(pa.array(who))], ["key", "kind", "doc_id", "line"])

    return run


def _grams(least_edit: int, every: int, min_chars: int | None):
    """Winnowed grams of the lines of 2 every - 2 units or more: key, its first and last place, the line's units, own, doc_id, line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = batch.column(0), batch.column(1)
            for lo, some in _spans(batch.column(2), least_edit, min_chars):
                for k, u, a, b, unit in some:
                    long = b - a >= 2 * every - 2
                    k, a, b = k[long], a[long], b[long]
                    of, key, place, own = _winnow(u, a, b, every, unit, True)
                    by = np.lexsort((place, key, of))
                    of, key, place, own = of[by], key[by], place[by], own[by]
                    new = np.ones(len(of), bool)
                    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
                    s = np.flatnonzero(new)
                    e = np.append(s[1:], len(of))[: len(s)] - 1
                    who = lo + k[of[s]]
                    yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(place[s].astype(np.int32)), pa.array(place[e].astype(np.int32)), pa.array((b - a)[of[s]].astype(np.int32)), pa.array(np.logical_or.reduceat(own, s) if len(s) else own), ids.take(pa.array(who)), nos.take(pa.array(who))], ["key", "lo", "hi", "n", "own", "doc_id", "line"])

    return run


def near(a: list[str], b: list[str]) -> bool:
    """Whether the edit distance of two sequences of words is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def within(a, b, k: int) -> bool:
    """Whether the edit distance of two sequences is at most k: the furthest place on each diagonal after each edit."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    reach: dict[int, int] = {}
    for e in range(k + 1):
        now = {}
        for d in range(max(-e, n - m - (k - e), -m), min(e, n - m + (k - e), n) + 1):  # a's place less b's
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2)) if e else 0
            i = min(i, n, m + d)
            if i < max(0, d):
                continue
            while i < n and i - d < m and a[i] == b[i - d]:
                i += 1
            now[d] = i
        if now.get(n - m, -1) >= n:
            return True
        reach = now
    return False


def bound(n: int, every: int | None) -> int:
    """Edits that two lines may differ in, the longer of n units."""
    return max(1, n // every) if every else 1


def _parts(text: str, least_edit: int) -> list[str] | str:
    """Units of a line: words, or characters where there are few words."""
    w = text.split(" ")
    return w if len(w) >= least_edit else text


def _verifier(least_edit: int, every: int | None):
    def alike(a: str, b: str) -> bool:
        if every is None:
            return near(a.split(" "), b.split(" "))
        x, y = _parts(a, least_edit), _parts(b, least_edit)
        return type(x) is type(y) and within(x, y, bound(max(len(x), len(y)), every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([alike(a, b) for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("doc_id", "line")], ["doc_id", "line"])

    return run


def _tile(least_edit: int, every: int):
    """(doc_id, line) of the lines asked for in a tile that have an earlier one in it within the bound.

    Units that one line has and the other lacks need an edit each: only pairs of lines that lack no more
    than the bound are verified.
    """

    def run(t: pa.Table) -> pa.Table:
        ids = [tuple(v.values()) if isinstance(v, dict) else v for v in t["doc_id"].to_pylist()]
        where = list(zip(ids, t["line"].to_pylist(), strict=True))
        x = [_parts(v, least_edit) for v in t["text"].to_pylist()]
        n = np.array([len(v) for v in x])
        by = np.argsort(n, kind="stable")  # lines within the bound are as long, or nearly: a stretch of this order
        asked, other = np.asarray(t["asked"]), np.asarray(t["other"])[by]
        flat, codes = [], {}
        for q in by:
            seen: dict = {}
            for u in x[q]:
                seen[u] = seen.get(u, 0) + 1
                flat.append(codes.setdefault((u, seen[u]), len(codes)))
        n = n[by]
        flat, first = np.array(flat), np.concatenate([[0], np.cumsum(n)])
        has, out = np.zeros(len(codes), np.int32), []
        for at in np.flatnonzero(asked[by]).tolist():
            p, size = by[at], n[at]
            lo = int(np.searchsorted(n, size - max(1, size // every)))
            hi = int(np.searchsorted(n - np.maximum(1, n // every), size, "right"))
            longer = np.maximum(size, n[lo:hi])
            most = np.maximum(1, longer // every)
            mine = flat[first[at] : first[at + 1]]
            has[mine] = 1
            lack = longer - np.add.reduceat(has[flat[first[lo] : first[hi]]], first[lo:hi] - first[lo])
            has[mine] = 0
            for j in np.flatnonzero(other[lo:hi] & (lack <= most)).tolist():
                q = by[lo + j]
                if where[q] < where[p] and type(x[q]) is type(x[p]) and within(x[p], x[q], int(most[j])):
                    out.append(p)
                    break
        return t.select(["doc_id", "line"]).take(pa.array(out, pa.int64()))

    return run


def _kind(df: DataFrame) -> str:
    """The type of the key of documents."""
    return df.schema["doc_id"].dataType.simpleString()


def _verified(met: DataFrame, texts: DataFrame, least_edit: int, every: int | None, scratch: Scratch) -> DataFrame:
    """(doc_id, line) of the pairs (doc_id, line, pd, pl) within the edit bound."""
    pairs = met.join(texts.select("doc_id", "line", F.col("text").alias("ta")), ["doc_id", "line"])
    pairs = pairs.join(texts.select(F.col("doc_id").alias("pd"), F.col("line").alias("pl"), F.col("text").alias("tb")), ["pd", "pl"])
    return scratch.save(pairs.select("doc_id", "line", "ta", "tb").mapInArrow(_verifier(least_edit, every), f"doc_id {_kind(texts)}, line int"), "near", BATCH)


def _near_long(texts: DataFrame, least_edit: int, every: int, min_chars: int | None, scratch: Scratch) -> list[DataFrame]:
    """(doc_id, line) of lines of which an earlier one is within the edit bound, the longer of 2 every units or more."""
    kinds = f"key bigint, lo int, hi int, n int, own boolean, doc_id {_kind(texts)}, line int"
    long = texts.where((F.col("n") >= 2 * every - 2) | (F.col("n") < least_edit))
    rows = scratch.save(long.select("doc_id", "line", "text").mapInArrow(_grams(least_edit, every, min_chars), kinds), "grams", BATCH)
    me, at = F.struct("doc_id", "line"), ["doc_id", "line"]
    best = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "line", "n")).alias("p")).where("copies > 1").drop("copies")
    edits = lambda a, b: F.floor(F.greatest(a, b) / every)
    first = rows.join(best, "key").where(F.struct("p.doc_id", "p.line") < me)
    first = scratch.save(first.select(*at, "n", F.col("p.doc_id").alias("pd"), F.col("p.line").alias("pl"), F.col("p.n").alias("pn")).distinct(), "firsts")
    sure = _verified(first.where(F.abs(F.col("n") - F.col("pn")) <= edits("n", "pn")).select(*at, "pd", "pl"), texts, least_edit, every, scratch)
    # the lines left meet all earlier ones of their own grams; those of many lines in tiles
    left = scratch.save(first.select(*at).distinct().join(sure, at, "left_anti"), "left")
    mine = scratch.save(rows.where("own").join(left, at, "left_semi"), "own")
    many = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > MANY).join(mine.select("key").distinct(), "key", "left_semi")
    many = scratch.save(many, "many")
    other = rows.select("key", *[F.col(c).alias(f"p{c[0]}" if c in at else f"p_{c}") for c in ("lo", "hi", "n", "doc_id", "line")])
    both = mine.join(scratch.small(many), "key", "left_anti").join(other, "key").where(F.struct("pd", "pl") < me).where(F.abs(F.col("n") - F.col("p_n")) <= edits("n", "p_n"))
    both = both.where((F.col("lo") <= F.col("p_hi") + edits("n", "p_n")) & (F.col("p_lo") <= F.col("hi") + edits("n", "p_n")))
    both = both.select(*at, "pd", "pl").distinct().join(first.select(*at, "pd", "pl"), [*at, "pd", "pl"], "left_anti")
    more = _verified(scratch.save(both, "pairs"), texts, least_edit, every, scratch)
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    part = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "line"), tiles).cast("int")
    across = F.explode(F.sequence(F.lit(0), tiles - 1))
    asks = mine.join(scratch.small(many), "key").withColumn("i", part(1)).select("key", *at, "i", across.alias("j"), F.lit(True).alias("asked"), F.lit(False).alias("other"))
    others = rows.join(scratch.small(many), "key").withColumn("j", part(2)).select("key", *at, across.alias("i"), "j", F.lit(False).alias("asked"), F.lit(True).alias("other"))
    dealt = asks.unionByName(others).groupBy("key", "i", "j", *at).agg(F.max("asked").alias("asked"), F.max("other").alias("other")).join(texts.drop("n"), at)
    met = dealt.groupBy("key", "i", "j").applyInArrow(_tile(least_edit, every), f"doc_id {_kind(texts)}, line int")
    tiled = scratch.save(met.distinct(), "tiled")
    scratch.drop(rows, first, left, mine, many)
    return [sure, more, tiled]


def _near_lines(docs: DataFrame, rows: DataFrame, distinct: DataFrame, least_edit: int, every: int | None, min_chars: int | None, scratch: Scratch) -> DataFrame:
    """(doc_id, line) of first lines that have an earlier one within the edit bound, verified."""
    keys = rows.select(F.explode("keys").alias("key"), "name")
    keys = keys.select(F.expr("key & -2").alias("key"), F.expr("key & 1").alias("own"), "name")
    # keys of more than one line, from sums of fixed size; the lines of a key that many share are dealt over tasks
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi")
    shared = scratch.save(shared.select("key", "n", F.lit(True).alias("shared")), "shared")
    names = scratch.spread_join(keys.where("own = 1").select("key", "name"), shared, "key", F.col("name")).where("shared").select("name").distinct()
    chosen = distinct.where(F.col("n") >= (least_edit if min_chars is None else 1)).join(names, "name", "left_semi")
    chosen = scratch.save(chosen.groupBy("doc_id").agg(F.collect_list("line").alias("want")), "chosen")
    texts = docs.join(scratch.small(chosen), "doc_id").select("doc_id", "text", "want").mapInArrow(_picker, f"doc_id {_kind(docs)}, line int, text string, n int")
    texts = scratch.save(texts, "texts", BATCH)
    short = texts.where(F.col("n") < 2 * every) if every else texts
    rows = scratch.save(short.select("doc_id", "line", "text").mapInArrow(_variants(least_edit, every, min_chars), f"key bigint, kind tinyint, doc_id {_kind(docs)}, line int"), "variants", BATCH)
    me = F.struct("doc_id", "line")
    least = lambda k: F.min(F.when(F.col("kind") == k, me))
    best = rows.groupBy("key").agg(F.count("*").alias("n"), least(0).alias("whole"), least(1).alias("gone"), least(2).alias("changed")).where("n > 1").drop("n")
    best = best.where("changed is not null or (whole is not null and gone is not null)")
    met = rows.join(best, "key").withColumn("partner", F.when(F.col("kind") == 2, F.col("changed")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("gone")))
    met = met.where(F.col("partner") < me).groupBy("doc_id", "line").agg(F.min("partner").alias("p"))
    met = scratch.save(met.select("doc_id", "line", F.col("p.doc_id").alias("pd"), F.col("p.line").alias("pl")), "partners")
    scratch.drop(rows)
    out = _verified(met, texts, least_edit, every, scratch)
    for more in _near_long(texts, least_edit, every, min_chars, scratch) if every else []:
        out = out.unionByName(more)
    scratch.drop(texts, met, chosen)
    return out


def _cutter(text_at: int, gone_at: int, texts: bool):
    """Texts without the listed lines; with them their numbers of lines, of lines that went, and the digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, gone = batch.column(text_at), batch.column(gone_at)
            n_lines, digest, kept = [], [], []
            for lo, _, data, offs in W.chunks(column):
                breaks = np.searchsorted(np.flatnonzero(data == 10), offs)
                n_lines.append(np.where(np.diff(offs) > 0, np.diff(breaks) + 1, 0))
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    raw = data[a:b].tobytes()
                    if (g := gone[lo + i].as_py()) is not None:
                        out = set(g)
                        raw = b"\n".join(x for j, x in enumerate(raw.split(b"\n")) if j not in out)
                        if texts:
                            kept.append((lo + i, raw))
                    digest.append(hashlib.sha256(raw).hexdigest())
            if kept:  # other texts stay as they are
                at, new = zip(*kept, strict=True)
                mask = np.zeros(batch.num_rows, bool)
                mask[list(at)] = True
                column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array(new, pa.binary()).cast(column.type))
            n_removed = gone.value_lengths().fill_null(0).cast(pa.int64())
            held = [(column if i == text_at else c, x) for i, (c, x) in enumerate(zip(batch.columns, batch.schema.names, strict=True)) if i != gone_at and (texts or i != text_at)]
            new = [pa.array(np.concatenate(n_lines) if n_lines else np.zeros(0, np.int64), pa.int64()), n_removed, pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in held), *new], [*(x for _, x in held), "n_lines", "n_removed", "kept_sha256"])

    return run


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_edit_words: int = MIN_EDIT_WORDS, edit_every: int | None = None, min_chars: int | None = None, texts: bool = True) -> DataFrame:
    """The rows of docs with their text cut (without it unless texts), and n_lines, n_removed, kept_sha256 (of the text that is left, in UTF-8).

    Lines end at line feeds. A line goes if an earlier one (of a smaller doc_id, or above it in the document) has the same
    words or, where both have ``min_edit_words`` words or more, words within one edit: one put in, left out or changed.
    With ``edit_every`` they may differ in one edit for each so many words of the longer, and in one at least. With ``min_chars``
    two lines of fewer words than ``min_edit_words``, both of so many characters or more, are held to the same bound over their
    characters (words joined by one space).
    Lines are judged on the input, so partners needn't be kept themselves.
    Lines of fewer than ``min_words`` words, empty ones among them, stay. White space between words doesn't count.
    Null texts stay null and have no lines; an empty table gives an empty one. Rows with a null id keep all their lines. Rows
    equal in id and text are in one place: neither is earlier, and both are cut alike. Of rows that repeat an id with another
    text that with the smaller digest is earlier. Ids are whole numbers, also as texts; any other text is an error. Columns of the new
    names are replaced; all others stay.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed", "kept_sha256")])
    docs = docs.withColumn(text, F.col(text).cast("string"))
    key, kind = row_key(docs, doc_id, text)
    d = docs.select(key.alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    if kind != "bigint":
        d = d.dropDuplicates(["doc_id"])
    rows = scratch.save(d.mapInArrow(_line_rows(min_words, min_edit_words, edit_every, min_chars), f"name bigint, check int, doc_id {kind}, line int, n int, again boolean, keys array<bigint>"), "rows", BATCH)
    # a line comes once from a document, so its least document has its first place: sums of fixed size, no sort
    counted = rows.where((F.col("n") >= min_words) & ~F.col("again")).drop("keys")
    distinct = counted.groupBy("name", "check").agg(F.min("doc_id").alias("doc_id"), F.min_by("line", "doc_id").alias("line"), F.min("n").alias("n"), F.count("*").alias("copies"))
    distinct = scratch.save(distinct, "distinct")
    first = distinct.where("copies > 1").select("name", "check", F.col("doc_id").alias("first"))
    again = counted.join(first, ["name", "check"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "line")
    again = again.unionByName(rows.where((F.col("n") >= min_words) & F.col("again")).select("doc_id", "line"))
    gone = again.unionByName(_near_lines(d, rows, distinct, min_edit_words, edit_every, min_chars, scratch))
    gone = scratch.save(gone.groupBy(F.col("doc_id").alias("k")).agg(F.collect_set("line").alias("g")), "gone")
    scratch.drop(rows, distinct)
    # the input's columns travel in one struct, so that no name of theirs meets one of ours
    out = docs.select(key.alias("k"), F.struct(*docs.columns).alias("row")).join(scratch.small(gone), "k", "left").select("row.*", F.col("g"))
    names = [*docs.columns, fresh("g", docs.columns)]
    out = out.toDF(*names)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if texts or f.name != text)
    return out.mapInArrow(_cutter(names.index(text), len(names) - 1, texts), f"{kinds}n_lines bigint, n_removed bigint, kept_sha256 string")
