"""Sharding, resampling and the audit of sources against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ostinato.llm import _words, divergence, resample, sharding

# --- sharding ------------------------------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    """By trying every capacity that a run of groups can have."""

    def fits(c):
        used, room = 0, 0
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    runs = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    return next(c for c in runs if fits(c))


def whole(sizes):
    return sharding.Segments([i.to_bytes(4, "big") for i in range(len(sizes))], np.array(sizes, np.int64), np.ones(len(sizes), bool))


@pytest.mark.parametrize("seed", range(40))
def test_capacity_and_cuts(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([8, rng.randint(8, 60), rng.randint(8, 60), 400]) for _ in range(rng.randint(1, 30))]
    shards = rng.randint(1, 8)
    s = whole(sizes)
    lo, hi, split = sharding.capacity(s, shards)
    assert lo == hi == least_capacity(sizes, shards) and not split.any()
    at, split = sharding.cuts(s, shards, lo)
    assert not split.any() and at[0] == 0 and at[-1] == len(sizes) and at == sorted(at) and len(at) == shards + 1
    assert max(sum(sizes[a:b]) for a, b in zip(at, at[1:])) == lo


def texts_with_copies(n=1500, seed=1):
    rng = random.Random(seed)
    out = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 80)))) for i in range(n)]
    hot = "the same passage " * 20
    out += [(n + i, hot) for i in range(n // 2)] + [(2 * n + i, out[i][1]) for i in range(0, 100, 3)]
    return out + [(3 * n, None), (3 * n + 1, ""), (3 * n + 2, "ü" * 5000), (None, "no id"), (7, "another text"), (7, "another text")]


def test_prefixes_are_split_where_cuts_may_fall(spark, monkeypatch):
    """Coarse segments, split only on demand, end in the cuts of all groups."""
    docs = spark.createDataFrame(texts_with_copies(), "doc_id bigint, text string")
    rows = sharding._rows(docs, "doc_id", "text").cache()
    groups = sorted((bytes(r.digest), r.s) for r in rows.groupBy("digest").agg(F.sum("size").alias("s")).collect())
    s = whole([g for _, g in groups])
    for shards in (1, 5, 24):
        most = sharding.capacity(s, shards)[0]
        want = [groups[i][0] if i < len(groups) else b"" for i in sharding.cuts(s, shards, most)[0][1:-1]]
        for first, fine in ((2, 1024), (1, 1)):
            monkeypatch.setattr(sharding, "FIRST_PREFIX", first)
            monkeypatch.setattr(sharding, "FINE", fine)
            got = sharding.bounds(rows, shards)
            assert len(got) == shards - 1 and all(w.startswith(g) if g else not w for g, w in zip(got, want))


def test_shards_hold_every_row_once(spark):
    data = texts_with_copies()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("size", F.lit("theirs")).withColumn("shard", F.lit(-1))
    rows = sharding.shard(docs, 24).collect()
    assert len(rows) == len(data)
    plain = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((k, len(plain(t)) + 8, zlib.crc32(plain(t))) for k, t in data)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(by) <= set(range(24)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    home = defaultdict(set)
    for r in rows:
        home[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in home.values())
    group = Counter()
    for _, t in data:
        group[hashlib.md5(plain(t)).digest()] += len(plain(t)) + 8
    assert max(sum(r.size for r in v) for v in by.values()) == least_fast([group[k] for k in sorted(group)], 24)


def least_fast(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        c, used, room = (lo + hi) // 2, 0, 0
        for s in sizes:
            if s > room:
                used, room = used + 1, (lo + hi) // 2
            room -= s
        lo, hi = (lo, c) if used <= shards else (c + 1, hi)
    return lo


def test_shards_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert sharding.shard(none).count() == 0
    few = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", None)], "doc_id string, text string")
    rows = {r.doc_id: r for r in sharding.shard(few, 5).collect()}
    assert len({rows[k].shard for k in ("a", "b", None)}) == 1 and [rows[k].slot for k in (None, "a", "b")] == [0, 1, 2] and rows["c"].shard != rows["a"].shard
    with pytest.raises(ValueError):
        sharding.shard(few, 0)


def test_shards_as_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = {r.shard: (r.rows, r.bytes) for r in sharding.write_shards(docs, f"file://{tmp_path}/out", 6).collect()}
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.collect()))
    want = {r.doc_id: r.shard for r in sharding.shard(docs, 6).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    assert made == {r.shard: (r.n, r.b) for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 8).alias("b")).collect()}


# --- resampling ----------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())


def test_crc32_of_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcXYZ019 ,.é漢") for _ in range(rng.randint(0, 300))) for _ in range(50)] + ["w" * 500 + " " + "v" * 49 + " " + "u" * 48, "", None]
    for _, _, data, offs in _words.chunks(pa.array(texts, pa.string())):
        w = _words.Words(data, offs, _words.ALNUM, _words.LOWER)
        assert resample.crc32_of_words(w).tolist() == [zlib.crc32(x) for t in texts for x in words(t)]


def resampled(docs, target, buckets, least, percent, seed):
    stream = lambda t: [zlib.crc32(w) % buckets for w in words(t)]
    s, t = Counter(b for _, x in docs for b in stream(x)), Counter(b for x in target for b in stream(x))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    rows = []
    for k, x in docs:
        f = stream(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for i, r in enumerate(able):
        r.append(i + 1 if i < len(able) * percent // 100 else None)
    return sorted((tuple(r if len(r) == 5 else [*r, None]) for r in rows), key=str)


@pytest.mark.parametrize(("kind", "percent"), [("bigint", 10), ("string", 35), ("bigint", 100), ("bigint", 0)])
def test_resampling_by_hand(spark, kind, percent):
    rng = random.Random(percent)
    vocabulary = ["alpha", "Beta", "gamma9", "délta", "x" * 70, "zeta", "eta"]
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"doc-{i}")
    docs = [(name(i), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)] + [(name(500), None), (name(501), ""), (None, "alpha " * 40), (name(3), "beta, " * 30), (name(3), "beta, " * 30)]
    target = ["gamma9 gamma9 eta", None, "", "Zeta zeta unseen"]
    a = spark.createDataFrame(docs, f"doc_id {kind}, text string").withColumn("weight", F.lit("theirs")).withColumn("ids", F.lit(0)).repartition(5)
    b = spark.createDataFrame([(x,) for x in target], "text string")
    got = sorted((tuple(r) for r in resample.resample(a, b, buckets=50, percent=percent).collect()), key=str)
    assert got == resampled(docs, target, 50, 20, percent, resample.SEED)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, "c " * 30)], "doc_id bigint, text string")
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    assert sorted(map(tuple, resample.resample(docs, none, percent=50).collect())) == resampled([tuple(r) for r in docs.collect()], [], resample.BUCKETS, 20, 50, resample.SEED)
    with pytest.raises(ValueError):
        resample.streams(docs, buckets=1 << 17)


def test_streams_are_packed_buckets(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, "three")], "doc_id bigint, text string").coalesce(1)
    (r,) = resample.streams(docs, "doc_id", buckets=1000).collect()
    assert r.ids == [1, 2, 3] and r.offsets == [0, 3, 3, 4]
    assert np.frombuffer(r.stream, "<u2").tolist() == [zlib.crc32(w) % 1000 for w in (b"one", b"two", b"two", b"three")]


# --- audit of sources ----------------------------------------------------------------------------------------------


def audited(docs, least, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    group, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        group[lang or "", source or ""].update(term(text))
        df[lang or ""].update(set(term(text)))
    rows = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = {s: c for (g, s), c in group.items() if g == lang}
        v, whole_lang = len(kept), Counter()
        for c in mine.values():
            whole_lang.update(c)

        def p(c, t, kept=kept, v=v):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v)

        for s, c in mine.items():
            pair = [(sum(abs(p(c, t) - p(d, t)) for t in kept), o) for o, d in mine.items() if o != s]
            over = [(p(c, t) - p(whole_lang, t), t) for t in kept if c[t] and p(c, t) > p(whole_lang, t)]
            for part, found, most in (("pair", pair, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                rows += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(rows)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"word{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(40)] + ["Ünder", "ünder", "漢字", "rare" * 30]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, "xx"]), rng.choice(["s1", "s2", "s3", "s4", "s5", None, "é"])
        some = vocabulary[: rng.randint(3, 44)]
        text = None if lang == "xx" and rng.random() < 0.3 else " ".join(rng.choice(some).upper() if rng.random() < 0.2 else rng.choice(some) for _ in range(rng.randint(0, 40)))
        out.append((lang, source, text))
    return out + [("de", "only", "einzig " * 5), ("zz", "a", "12 345"), ("zz", "b", None), ("en", "s1", "worda " * 2000)] + [("fr", "s2", "gleich gleich anders")] * 40


@pytest.mark.parametrize(("seed", "tile", "top"), [(1, 128, 50), (2, 2, 3), (3, 1, 1), (4, 3, 7)])
def test_audit_by_hand(spark, seed, tile, top):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    a = divergence.Audit(df, least_docs=4, tile=tile)
    assert a.tiled == (tile < 128)
    rows = [(r.lang, r.source, "pair", r.item, r.value, r.rank) for r in divergence.pairs(a).collect()] + [(r.lang, r.source, "term", r.item, r.value, r.rank) for r in divergence.top_terms(a, top).collect()]
    assert sorted(rows) == audited(docs, 4, top)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.report(df).count() == 0
    bare = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.report(bare).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_probabilities_of_large_counts(spark):
    """Exact where the product is far beyond 64 bits."""
    rows = [(0, 10, 3), (5 * 10**14, 10**15, 10**6), (10**15 - 1, 10**15, 1), (7, 7, 1), (0, 0, 0)]
    df = spark.createDataFrame(rows, "c bigint, n bigint, v bigint").select("*", divergence.probability("c", "n", "v").alias("p"))
    for r in df.collect():
        assert r.p == (1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) if r.v else 0)
