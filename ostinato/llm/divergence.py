"""Audit of how sources of one language differ in their words: distances of all pairs of sources, and the terms each one overuses.

Terms by upper bounds: a group's terms lie in buckets of their counts; a bucket's largest probability in the group less its smallest in the
language bounds the excess of all its terms. Buckets are evaluated best first, in rounds over all groups at once, until no bucket that
hasn't been seen can reach a group's k-th value: those whose bound is strictly below it are never evaluated.

Pairs by postings: a term's posting lists the groups that have it. A pair's distance starts as if neither had any term; each
posting adds what its groups' own counts change against every other group, and what groups in it together change besides.
Postings are cut in tiles of groups, sums leave a task, never pairs of a posting.

All numbers are integers: probabilities are billionths, floored by long division in steps of a thousand, exact to 9 * 10^15 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import SMALL_BYTES, Scratch
from ._words import LOWER, Words, chunks

#: A term is kept in a language from so many of its documents on.
LEAST_DOCS = 30
#: Added to each count.
PRIOR = 5
#: Terms reported of a group.
TOP = 50
#: Groups in a tile of a posting, on average.
TILE = 128
#: Bytes of text worked on at once, and rows of an Arrow batch of texts.
CHUNK, ROWS_PER_BATCH = 1 << 22, 1000
#: Matrices of sums that a task holds before it hands them on.
HELD = 16
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a chunk of documents, once each, and for each document and term in it: document, term, occurrences."""
    w = Words(data, offs, LETTERS, LOWER)
    own = LOWER[data[LETTERS[data]]]  # words side by side
    ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own)]).dictionary_encode()
    n = max(1, len(coded.dictionary))
    key, count = np.unique(w.doc_of_word() * n + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return coded.dictionary, key // n, key % n, count


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), df (documents with it), and a row of a null term for each group with its documents as df.

    Nulls are empty texts. Each task counts by chunk; Spark adds the counts within the task before it shuffles them.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()

            def rows(g: np.ndarray, term: pa.Array, n: np.ndarray, df: np.ndarray, langs=langs, sources=sources) -> pa.RecordBatch:
                k = len(sources.dictionary)
                return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(g // k)), sources.dictionary.take(pa.array(g % k)), term, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

            g, df = np.unique(group, return_counts=True)
            yield rows(g, pa.nulls(len(g), pa.string()), np.zeros(len(g), np.int64), df)
            for lo, _, data, offs in chunks(batch.column(2), CHUNK):
                terms, doc, term, count = _terms(data, offs)
                if not len(term):
                    continue
                key = group[lo + doc] * len(terms) + term
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                words = pc.cast(terms.take(pa.array(key[first] % len(terms))), pa.string())
                yield rows(key[first] // len(terms), words, np.add.reduceat(count[order], first), np.diff(np.r_[first, len(key)]))

    out = docs.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(count: str, total: str, kinds: str, prior: int = PRIOR) -> Column:
    """1 + floor(10^9 (count + prior) / (total + prior kinds)), of SQL expressions; 0 where there are no terms."""
    over, part, out = f"({total} + {prior} * {kinds})", f"({count} + {prior})", "1"
    for unit in (1_000_000, 1_000, 1):
        out += f" + ({part} * 1000) div {over} * {unit}"
        part = f"(({part} * 1000) % {over})"
    return F.expr(f"case when {kinds} > 0 then {out} else 0L end")


class Audit:
    """Kept terms and groups of a corpus, as written tables.

    groups: lang, source, total (occurrences of kept terms), kinds (kept terms of the language), lang_total, none (the probability of
    a term that the group lacks), tile, place. terms: lang, source, term, n, p (in the group), q (in the language), tile, place.
    """

    def __init__(self, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, tile: int = TILE):
        self.scratch = s = Scratch(docs.sparkSession, "divergence")
        counts = s.save(term_counts(docs, lang, source, text), "counts", ROWS_PER_BATCH)
        kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"))
        kept = s.save(kept.where(F.col("df") >= least_docs).drop("df"), "kept")
        own = s.save(counts.drop("df").join(s.small(kept), ["lang", "term"]), "own")
        langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
        groups = counts.where(F.col("term").isNull()).select("lang", "source")
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
        langs = s.save(langs, "langs")
        totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = groups.join(s.small(langs), "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "kinds", "lang_total"])
        groups = groups.withColumn("none", probability("0", "total", "kinds")).withColumn("tile", F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / tile)).cast("int"))
        groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang", "tile").orderBy("source")) - 1)
        self.groups = s.save(groups.drop("sources"), "groups")
        self.tiled = not self.groups.where("tile > 0").isEmpty()
        own = own.join(s.small(self.groups), ["lang", "source"]).withColumn("p", probability("n", "total", "kinds")).withColumn("q", probability("lang_n", "lang_total", "kinds"))
        self.terms = s.save(own.select("lang", "source", "term", "n", "p", "q", "tile", "place"), "terms")
        s.drop(counts, kept)


_GROUP = ["lang", "source"]


def top_terms(audit: Audit, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group the k terms whose probability most exceeds the language's, ties by the term.

    Groups of fewer such terms have fewer rows.
    """
    s = audit.scratch
    # buckets of one count up to 31, then of a sixteenth of a power of two: some 1,000 for a group at most
    terms = audit.terms.withColumn("_e", F.length(F.bin("n")) - 1).withColumn("bucket", F.expr("_e * 16 + shiftright(n * 16, _e) - 16")).drop("_e")
    bounds = terms.groupBy(*_GROUP, "bucket").agg(F.count("*").alias("size"), (F.max("p") - F.min("q")).alias("bound")).where(F.col("bound") > 0)
    before = Window.partitionBy(*_GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    unseen = s.save(bounds.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), "bounds")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= k)
    best, reach, now = None, k, F.col("before") < k
    while True:
        chosen = s.save(unseen.where(now).select(*_GROUP, "bucket"), "chosen")
        if best is not None and chosen.isEmpty():
            return best
        found = terms.join(s.small(chosen), [*_GROUP, "bucket"]).where("p > q").select(*_GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        best = s.save(ranked(found if best is None else found.unionByName(best.drop("rank"))), "best")
        kth = s.save(best.groupBy(*_GROUP).agg(F.count("*").alias("have"), F.min("value").alias("kth")), "kth")
        reach *= 4
        # a full group looks at all that can still reach its k-th value; another goes on along its bounds
        rest = unseen.where(~now).select(*_GROUP, "bucket", "size", "bound", "before").join(s.small(kth), _GROUP, "left")
        rest = rest.where((F.coalesce("have", F.lit(0)) < k) | (F.col("bound") >= F.col("kth"))).withColumn("full", F.coalesce(F.col("have") >= k, F.lit(False))).drop("have", "kth")
        unseen, now = s.save(rest, "unseen"), F.col("full") | (F.col("before") < reach)


def _distances(rows: DataFrame) -> DataFrame:
    """lang, u, v (numbers of groups, u < v), value: what postings change of pairs' distances.

    rows: lang, ta, tb (tiles), xa, xb (their groups' probabilities of a term they lack), ea, eb (entries of one term: place, p).
    """

    def dense(entries: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        p, has = np.zeros((len(entries), width), np.int64), np.zeros((len(entries), width), bool)
        flat = entries.flatten()
        row = np.repeat(np.arange(len(entries)), pc.fill_null(pc.list_value_length(entries), 0).to_numpy())
        at = flat.field("place").to_numpy()
        p[row, at], has[row, at] = flat.field("p").to_numpy(), True
        return p, has

    def out(held: dict) -> pa.RecordBatch:
        lang, u, v, value = [], [], [], []
        for (name, ta, tb), m in held.items():
            a, b = np.nonzero(m)
            i, j = (ta << 16) + a, (tb << 16) + b
            ok = i != j
            lang += [name] * int(ok.sum())
            u.append(np.minimum(i, j)[ok]), v.append(np.maximum(i, j)[ok]), value.append(m[a, b][ok])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), cat(u), cat(v), cat(value)], ["lang", "u", "v", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for key in dict.fromkeys(keys):
                rows = batch.filter(pa.array([k == key for k in keys]))
                xa, xb = (rows.column(i)[0].values.to_numpy().astype(np.int64) for i in (3, 4))
                (pa_, has), (pb, both) = dense(rows.column(5), len(xa)), dense(rows.column(6), len(xb))
                m = held.setdefault(key, np.zeros((len(xa), len(xb)), np.int64))
                for a in np.flatnonzero(has.any(axis=0)):
                    on = has[:, a]
                    p, q, later = pa_[on, a][:, None], pb[on], (key[2] << 16) + np.arange(len(xb)) > (key[1] << 16) + a
                    alone, none = np.abs(p - xb), np.abs(xa[a] - xb)
                    m[a] += (alone - none).sum(axis=0) + np.where(both[on] & later, np.abs(p - q) - alone - np.abs(q - xa[a]) + none, 0).sum(axis=0)
            if len(held) > HELD:
                yield out(held)
                held = {}
        yield out(held)

    return rows.mapInArrow(run, "lang string, u bigint, v bigint, value bigint").groupBy("lang", "u", "v").agg(F.sum("value").alias("value"))


def pairs(audit: Audit) -> DataFrame:
    """lang, source, item, value, rank: of each group all other groups of its language, the most distant first, ties by the name."""
    s, g = audit.scratch, audit.groups
    lists = audit.terms.groupBy("lang", "term", "tile").agg(F.collect_list(F.struct(F.col("place"), "p")).alias("e"))
    tiles = s.save(g.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("place", "none")))["none"].alias("x")), "tiles")
    few = s.size(tiles) <= SMALL_BYTES
    of = lambda k: (F.broadcast if few else lambda x: x)(tiles.withColumnsRenamed({"tile": f"t{k}", "x": f"x{k}"}))
    a = lists.withColumnsRenamed({"tile": "ta", "e": "ea"}).join(of("a"), ["lang", "ta"])
    if audit.tiled:
        a = s.save(a.join(of("b"), "lang"), "postings")
        a = a.join(lists.withColumnsRenamed({"tile": "tb", "e": "eb"}), ["lang", "term", "tb"], "left")
    else:
        a = a.withColumn("tb", F.col("ta")).withColumn("xb", F.col("xa")).withColumn("eb", F.col("ea"))
    moved = s.save(_distances(a.select("lang", "ta", "tb", "xa", "xb", "ea", "eb")), "moved")
    number = F.shiftleft(F.col("tile").cast("long"), 16) + F.col("place")
    g = g.select("lang", "source", number.alias("id"), "none", "kinds")
    both = g.join(g.select("lang", F.col("source").alias("item"), F.col("id").alias("other"), F.col("none").alias("other_none")), "lang").where(F.col("id") != F.col("other"))
    both = both.withColumn("u", F.least("id", "other")).withColumn("v", F.greatest("id", "other")).join(moved, ["lang", "u", "v"], "left")
    both = both.select(*_GROUP, "item", (F.col("kinds") * F.abs(F.col("none") - F.col("other_none")) + F.coalesce("value", F.lit(0))).alias("value"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")))


def report(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of language and source all others of the language by their distance
    (part ``pair``) and up to k terms that it overuses (part ``term``).

    A distance is the sum over the language's kept terms of the absolute difference of the two groups' probabilities, in billionths.
    A null language, source or text is an empty one. Groups without words, or of a language without kept terms (all distances 0), have
    their pairs and no terms; a language of one source has no pairs. Repeated rows count again. Other columns are ignored; without rows nothing is returned.
    """
    audit = Audit(docs, lang, source, text, least_docs)
    cols = lambda df, part: df.select(*_GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return cols(pairs(audit), "pair").unionByName(cols(top_terms(audit, k), "term"))
