"""MinHash near-duplicates by a chosen-path set similarity join.

Each document is a set of word shingles with TOKENS minwise tokens. In each of TREES independent trees a document
follows, from every node it is in, the tokens that the node's own hash selects (some PICKS of its TOKENS), so
documents that share tokens meet in nodes and others part. Nodes are compared from the top: each member against
the node's first (a star), confirmed on the full sets; a node whose members then lie in one component is done,
whatever its size. What is left of a small node is compared exhaustively. Of a large one in which few members are
outside its main component, those are compared with each other and, once for all nodes, with that component, in
tiles. Other large nodes branch again, and after LEVELS levels are compared exhaustively in tiles of bounded size,
so depth limits no result.

A pair at the threshold misses a tree with a probability of 0.22 at the first level and of at most 0.42 at any
depth: ten trees miss it with 3e-7 to 2e-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._scratch import Scratch, connected_components, fresh

SHINGLE, SIMILARITY = 5, 75
TOKENS, TREES, PICKS, LEVELS, SMALL = 64, 10, 2.0, 4, 512
#: Bins of a set's sketch, and the standard deviations under the threshold at which a pair isn't confirmed any more.
BINS, DEVIATIONS = 512, 4.5
#: Members outside a large node's main component up to which they are compared with that component instead of branching, and
#: sketches compared for a component at most.
OUTSIDE, WORK = 1024, 1 << 30
BATCH = 500

_MUL = W.seeds(TOKENS, 1)
_TREES = W.mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(0xABCDEF))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle fingerprints): of k words, or of all words of a text with fewer; empty without words."""
    for lo, _, data, offs in W.chunks(texts):
        w = W.Words(data, offs, W.SPACED, W.LOWER)
        h = w.hashes()
        g = W.grams(h, k)
        n = np.diff(w.docs)
        short = np.flatnonzero((n > 0) & (n < k))
        whole = dict(zip(short.tolist(), W.runs(h, w.docs[short], w.docs[short + 1]), strict=True)) if len(short) else {}
        for d, (a, b) in enumerate(zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True)):
            if b - a >= k:
                yield lo + d, np.unique(g[a : b - k + 1])
            else:
                yield lo + d, np.array([whole[d]] if d in whole else [], np.uint64)


def tokens(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    low = np.full(TOKENS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            low = np.minimum(low, (s[i : i + 4096, None] * _MUL).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte of the least fingerprint in each bin of a set, 0 in empty bins; s is sorted, so bins are stretches of it."""
    out = np.zeros(BINS, np.uint8)
    at = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    out[at[first]] = ((s[first] >> np.uint64(8)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def promising(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches of sets of na and nb elements can be at the threshold.

    Of the bins that either fills, the share with equal bytes estimates the similarity; bins draw elements of the union without
    putting them back, so the estimate is sharp for small sets.
    """
    used = ((a | b) > 0).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    j = percent / 100
    union = (na + nb) / (1 + j)
    left = np.clip((union - used) / np.maximum(union, 1), 0, 1)
    slack = DEVIATIONS * np.sqrt(j * (1 - j) / np.maximum(used, 1) * left) + 2 / np.maximum(used, 1)
    return (same >= (j - slack) * used) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig, bins = [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(tokens(s).tobytes() if len(s) else None)
                bins.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bins, pa.binary())], ["doc_id", "n_shingles", "set_key", "tokens", "sketch"])

    return run


def _tokens_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u4").reshape(len(col), TOKENS)


def _branch(first: bool):
    """Children of nodes: (node, id, tokens) to (node, id), or (id, tokens) at the roots of all trees."""
    limit = np.uint64(PICKS / TOKENS * 2**64)
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ids = np.asarray(part.column("id"))
                t = W.mix(_tokens_of(part.column("tokens")).astype(np.uint64) | place)
                above = [np.broadcast_to(x, (len(ids), 1)) for x in _TREES[:TREES]] if first else [np.asarray(part.column("node")).view(np.uint64)[:, None]]
                for node in above:
                    with np.errstate(over="ignore"):
                        child = W.mix(t ^ (node * np.uint64(0x9E3779B97F4A7C15)))
                    d, j = np.nonzero(child < limit)
                    # the selecting hash is small by choice: another names the child
                    yield pa.RecordBatch.from_arrays([pa.array(W.mix(child[d, j]).view(np.int64)), pa.array(ids[d])], ["node", "id"])

    return run


def _similar(percent: int):
    """Pairs (a, b) whose sketches ta, tb, of sets of na, nb elements, are promising."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("ta", "tb"))
                hit = pa.array(promising(a, b, np.asarray(batch.column("na")), np.asarray(batch.column("nb")), percent))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ("a", "b")], ["a", "b"])

    return run


def _exhaust(percent: int):
    """Promising pairs of different components within (members of) a node or pair of tiles.

    Members of the largest component are compared with the others only: what lies outside it decides the work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("members"):
                m = row.as_py()
                ids, comp, side, n = (np.array([x[k] for x in m]) for k in ("id", "comp", "side", "n_shingles"))
                t = np.frombuffer(b"".join(x["sketch"] for x in m), np.uint8).reshape(-1, BINS)
                names, sizes = np.unique(comp, return_counts=True)
                large = comp == names[int(np.argmax(sizes))]
                out_a, out_b = [], []
                for i in np.flatnonzero(~large).tolist():
                    other = np.flatnonzero((comp != comp[i]) & (large | (ids > ids[i])) & ((side != side[i]) | ~side.any()))
                    near = other[promising(t[other], t[i], n[other], n[i], percent)]
                    out_a += np.minimum(ids[near], ids[i]).tolist()
                    out_b += np.maximum(ids[near], ids[i]).tolist()
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for _, s in shingle_sets(batch.column(1), k)], pa.binary())], ["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["u", "v"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int, scratch: Scratch):
        self.docs, self.k, self.percent, self.scratch = docs, k, percent, scratch

    def sets(self) -> DataFrame:
        d = self.docs.mapInArrow(_signer(self.k), "doc_id bigint, n_shingles bigint, set_key binary, tokens binary, sketch binary")
        return self.scratch.save(d, "sets", BATCH)

    def nodes(self, rows: DataFrame, first: bool) -> DataFrame:
        """Members of nodes with two or more: node, id, first (of the node), size."""
        m = rows.mapInArrow(_branch(first), "node bigint, id bigint")
        size = m.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
        size = self.scratch.save(size.withColumn("n", F.col("size")), "sizes")
        out = self.scratch.save(self.scratch.spread_join(m, size, "node", F.col("id")).where("first is not null"), "nodes", 8 * BATCH)
        self.scratch.drop(size)
        return out

    def similar(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        side = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"t{c}"), F.col("n_shingles").alias(f"n{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar(self.percent), "a bigint, b bigint")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough, as links (u, v)."""
        ids = self.scratch.save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        d = self.docs.join(self.scratch.small(ids), self.docs.doc_id == ids.id, "left_semi").select("doc_id", "text")
        sets = self.scratch.save(d.mapInArrow(_setter(self.k), "id bigint, shingles binary"), "shingles", BATCH)
        side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
        found = self.scratch.save(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_confirm(self.percent), "u bigint, v bigint"), "links", 256)
        self.scratch.drop(ids, sets)
        return found

    def exhaustive(self, members: DataFrame, reps: DataFrame) -> DataFrame:
        """Promising pairs between components of nodes of ``size`` members, in tiles of some SMALL: (a, b)."""
        tiles = F.ceil(F.col("size") / SMALL).cast("int")
        m = members.join(reps.select("id", "sketch", "n_shingles"), "id").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
        m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        one = F.struct("id", "comp", "sketch", "n_shingles", ((F.col("tile") > F.col("other")).cast("int")).alias("side"))
        groups = m.groupBy("node", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y")).agg(F.collect_list(one).alias("members"))
        return groups.select("members").mapInArrow(_exhaust(self.percent), "a bigint, b bigint")

    def against(self, meet: DataFrame, comp: DataFrame, reps: DataFrame) -> DataFrame:
        """Promising pairs of documents outside a component (id, comp, main, n_main, n_out) with that component's, in tiles."""
        reps = reps.select("id", "sketch", "n_shingles")
        tiles, blocks = (F.ceil(F.col(c) / SMALL).cast("int") for c in ("n_main", "n_out"))
        place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        one = lambda side: F.struct("id", "comp", "sketch", "n_shingles", F.lit(side).alias("side")).alias("m")
        out = meet.withColumn("block", place(blocks)).withColumn("tile", each(tiles)).join(reps, "id").select("main", "tile", "block", one(0))
        mains = meet.select("main", "n_main", "n_out").distinct()
        own = comp.select("id", F.col("component_id").alias("main")).join(mains, "main").withColumn("comp", F.col("main")).withColumn("tile", place(tiles)).withColumn("block", each(blocks)).join(reps, "id").select("main", "tile", "block", one(1))
        groups = out.unionByName(own).groupBy("main", "tile", "block").agg(F.collect_list("m").alias("members"))
        return groups.select("members").mapInArrow(_exhaust(self.percent), "a bigint, b bigint")

    def components(self, reps: DataFrame) -> DataFrame:
        sc = self.scratch
        members = self.nodes(reps.select("id", "tokens"), True)
        tested = links = None
        for level in range(1, LEVELS + 1):
            stars = members.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
            if tested is not None:
                stars = stars.join(tested, ["a", "b"], "left_anti")
            stars = sc.save(self.similar(stars, reps), "stars", 2 * BATCH)
            found = self.confirm(stars)
            links = found if links is None else links.unionByName(found)
            tested = stars if tested is None else tested.unionByName(stars)
            comp = connected_components(links, sc)
            m = members.join(comp, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id", "size", "first")
            parts = m.groupBy("node", "comp").agg(F.count("*").alias("c"))
            mixed = parts.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("k")).where("k > 1")
            mixed = mixed.select("node", F.col("top.comp").alias("main"), "size", (F.col("size") - F.col("top.c")).alias("outside"))
            mixed = sc.save(mixed.withColumn("n", F.col("size")), "mixed")
            open_ = sc.save(sc.spread_join(m, mixed, "node", F.col("id")).where("main is not null"), "open")
            large = open_.where(F.col("size") > SMALL)
            meet = large.where((F.col("outside") <= OUTSIDE) & (F.col("comp") != F.col("main"))).select("id", "comp", "main").distinct()
            sizes = comp.groupBy(F.col("component_id").alias("main")).agg(F.count("*").alias("n_main"))
            sizes = sizes.join(meet.groupBy("main").agg(F.count("*").alias("n_out")), "main").where(F.col("n_main") * F.col("n_out") <= WORK)
            meet = sc.save(meet.join(sizes, "main"), "meet")
            near = meet.select("main").distinct().withColumn("near", F.lit(True))
            large = sc.save(large.join(near, "main", "left").withColumn("near", F.coalesce("near", F.lit(False)) & (F.col("outside") <= OUTSIDE)), "large")
            last = level == LEVELS
            pairs = self.exhaustive(open_.where(F.col("size") <= SMALL).select("node", "id", "comp", "size"), reps)
            if not large.isEmpty():
                outs = large.where(F.col("near") & (F.col("comp") != F.col("main"))).select("node", "id", "comp", F.col("outside").alias("size"))
                pairs = pairs.unionByName(self.exhaustive(outs, reps)).unionByName(self.against(meet, comp, reps))
            far = large.where(~F.col("near")).select("node", "id", "comp", "size")
            if last:
                pairs = pairs.unionByName(self.exhaustive(far, reps))
            pairs = sc.save(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs", 32)
            done = last or far.isEmpty()
            if not pairs.isEmpty():
                more = self.confirm(pairs)
                if done and more.isEmpty():
                    return comp
                links, tested = links.unionByName(more), tested.unionByName(pairs)
            elif done:
                return comp
            sc.drop(members)
            if done:
                break
            members = self.nodes(far.join(reps.select("id", "tokens"), "id").select("node", "id", "tokens"), False)
        return connected_components(links, sc)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept.

    Words are what stands between white space, A-Z in lower case. Documents link where 100 * intersection >= percent * union
    of their sets of ``shingle``-word shingles; a shorter text is one shingle. Texts that are null or without words link with
    nothing. Equal sets are joined by their digest and enter the trees once; every other link is confirmed on full sets.
    Rows with a null id link with nothing and keep their row, with a null component. Rows of one id are one document, which links
    as any of its texts does: all stay, with its component. Ids are whole numbers, also as texts; any other text is an error. An empty
    table gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "chosen-path")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    join = _Join(docs, shingle, percent, scratch)
    sets = join.sets()
    scratch.scale(sets)
    one = F.min(F.struct("doc_id", "n_shingles", "tokens", "sketch")).alias("x")
    reps = sets.where("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(one)
    reps = scratch.save(reps.select("set_key", F.col("x.doc_id").alias("id"), "x.n_shingles", "x.tokens", "x.sketch"), "reps")
    whole, sets = sets, scratch.save(sets.select("doc_id", "n_shingles", "set_key"), "keys")
    scratch.drop(whole)
    comp = join.components(reps)
    own = reps.select("set_key", "id").join(comp, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("comp"))
    out = sets.select("doc_id", "n_shingles", "set_key").join(own, "set_key", "left")
    comp_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """docs with one document of each component of near-duplicates, the smallest id; same columns, whatever their names."""
    name = fresh("gone", docs.columns)
    gone = near_duplicates(docs, doc_id, **kw).where("not kept").select(F.col("doc_id").alias(name))
    scratch = Scratch(docs.sparkSession, "gone")
    gone = scratch.small(scratch.save(gone.distinct(), "ids"))
    return docs.join(gone, docs[doc_id].cast("long") == gone[name], "left_anti")
