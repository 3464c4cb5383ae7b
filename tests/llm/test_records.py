"""Packing, archives, rules, vectors and pieces: round trips and brute force."""

import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ostinato.llm import _scratch, ego_join, packing, spm, url_filter, warc
from ostinato.llm._scratch import Scratch, connected_components
from ostinato.llm.queries import PIECES, RANKS, RANKS_END, RULES, tokenizer_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = packing.best_fit_decreasing(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 50 for r in rows)
    room = []  # the plain rule: the open row with the least room that suffices
    for s in sorted(sizes, reverse=True):
        fit = [r for r in room if r >= s]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - s)
        else:
            room.append(50 - s)
    assert len(room) == len(rows)


def test_packing_is_lossless(spark, sf, tmp_path):
    import public_tokenizers

    extra = spark.createDataFrame([(None, "null id"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "long " * 5000)], "doc_id bigint, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra)
    packed = packing.pack(docs, tokenizer_path(RANKS), public_tokenizers.PATTERN, RANKS_END, length=512).cache()
    enc = packing.byte_bpe(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    parts: dict = {}
    for r in packed.collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(k, []).append((o, ids[a:b]))
    for r in docs.collect():
        ids = np.concatenate([p for _, p in sorted(parts[r.doc_id], key=lambda x: x[0])])
        assert ids[-1] == RANKS_END and enc.decode(ids[:-1].tolist()) == (r.text or "")
    m = packing.write_matrices(packed, f"file://{tmp_path}/m", 512, segment=1 << 17).collect()
    total = 0
    for x in m:
        ids, cuts, resets = packing.read_matrix(x.path, x.rows, x.bytes_per_id, 512)
        total += sum(c[-1] for c in cuts)
        assert ids.shape == (x.rows, 512) and all((packing.position_ids(c.tolist(), 512)[r] == 0).all() for c, r in zip(cuts, resets))
    assert len(m) > 4 and total == packed.agg(F.sum("n_tokens")).first()[0]
    plain = lambda df: sorted(tuple(map(str, (r.input_ids, r.cu_seqlens, r.doc_ids, r.offsets, r.n_tokens))) for r in df.collect())
    args = (tokenizer_path(RANKS), public_tokenizers.PATTERN, RANKS_END, 512)
    twice = docs.unionByName(docs).withColumn("input_ids", F.lit(1))
    back = packing.pack_to_files(docs, *args)
    assert plain(back) == plain(packed) and all(r.resets == np.flatnonzero(packing.position_ids(r.cu_seqlens, 512) == 0).tolist() for r in back.collect())
    assert packing.pack_to_files(twice, *args).agg(F.sum("n_tokens")).first()[0] == 2 * total and packing.pack_to_files(docs.limit(0), *args).count() == 0
    assert packing.pack(docs.limit(0), tokenizer_path(RANKS), public_tokenizers.PATTERN, RANKS_END).count() == 0


def test_registered_packing_is_lossless(spark, sf):
    """The query's own rows, put together by their offsets, are the ids of every document."""
    import public_tokenizers

    from ostinato.llm import queries

    enc = packing.byte_bpe(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    parts: dict = {}
    for r in queries.op1_packing(spark, sf).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == packing.LENGTH and (ids[r.n_tokens :] == RANKS_END).all() and set(r.cu_seqlens) <= {*r.resets, packing.LENGTH}
        for k, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(k, []).append((o, ids[a:b]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(parts) == len(docs)
    for r in docs:
        assert np.concatenate([p for _, p in sorted(parts[r.doc_id], key=lambda x: x[0])]).tolist() == [*enc.encode_ordinary(r.text or ""), RANKS_END]


def test_warc_round_trip(spark, monkeypatch):
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "u\r\nv", "same"), (4, "x", None), (6, "x", ""), (7, "é", "é" * 50_000), (None, "x", "same"), (None, "x", "lost"), (None, "x", "lost"), (8, "z", "other"), (8, "z", "other")]
    pages = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "page_id bigint, url string, html string, digest int, first int").repartition(3)
    want = []
    for a, _, c in rows:
        raw = (c or "").encode()
        first = min((x for x, _, y in rows if x is not None and (y or "") == (c or "")), default=None)
        ref = first if first is not None and a != first else None
        want.append((a, len(raw), warc.digest_of(raw), "response" if ref is None else "revisit", ref))
    key = lambda r: tuple(str(x) for x in r)
    for small, hot in ((_scratch.SMALL_BYTES, 1000), (0, 1000), (0, 2)):
        monkeypatch.setattr(_scratch, "SMALL_BYTES", small)
        monkeypatch.setattr(_scratch, "HOT", hot)
        got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_is_sequential_and_strict():
    payloads = [b"a" * 10, b"", bytes(range(256)) * 300]
    members = [warc.record(i, "http://x/", p, None, warc.digest_of(p)) for i, p in enumerate(payloads)]
    read = [warc.parse(m) for m in warc.members(io.BytesIO(b"".join(members)), block=7)]
    assert [r["payload"] for r in read] == payloads
    with pytest.raises(warc.Corrupt):
        list(warc.members(io.BytesIO(members[2][:-9])))
    plain = zlib.decompress(members[0], 31)
    with pytest.raises(warc.Corrupt):
        warc.parse(plain.replace(b"aaaa", b"aaab"))
    with pytest.raises(warc.Corrupt):
        warc.parse(plain + b"x")


def test_url_rules(spark):
    urls = {1: "http://EX.Example.NET/en/x?y", 2: "http://example.net/en", 3: "https://a.net/", 4: "http://a.net", 5: "x://sub.example.com/de/1#a", 6: "http://notexample.com/de/", 7: None, 8: "no scheme/net/", 9: "http://b.org/fr/?q", 10: "http://b.org/FR/", 11: "a://b://c.net/", 12: ""}
    pages = spark.createDataFrame([(k, u, "h") for k, u in urls.items()], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    want = {1: ("ex.example.net", "/en/x", "example.net/en/"), 2: ("example.net", "/en", "net/"), 3: ("a.net", "/", "net/"), 4: ("a.net", "", None), 5: ("sub.example.com", "/de/1", "example.com/de/"), 6: ("notexample.com", "/de/", None), 7: ("", "", None), 8: ("", "", None), 9: ("b.org", "/fr/", "org/fr/"), 10: ("b.org", "/FR/", None), 11: ("b:", "//c.net/", None), 12: ("", "", None)}
    assert {k: (r.host, r.path, r.rule) for k, r in got.items()} == want
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[1].verdict == "allow" and got[5].verdict == "block"
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_suffixes(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "www.x.com": ("x.com", "com"), "x.com": ("x.com", "com"), "com": ("com", "com"), "q.gov.br": ("q.gov.br", "gov.br"), "co.uk": ("co.uk", "co.uk"), "me.github.io": ("me.github.io", "github.io"), "a.b.org:80": ("b.org", "org"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "m.co.com": ("co.com", "com")}
    df = spark.createDataFrame([(k,) for k in want], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", url_filter.registered_domain(F.col("h")).alias("d"), url_filter.suffix(F.col("h")).alias("s")).collect()}
    assert got == want


def test_reputation_decides(spark, monkeypatch):
    """Pages of a host that is mostly bad are blocked, its unlisted ones too; a host with one bad page is not; clean ones stay."""
    rows = [(i, f"http://casino.example.com/p/{i}") for i in range(30)] + [(100 + i, f"http://ok.example.com/p/{i}") for i in range(30)] + [(200, "http://ok.example.com/casino/1"), (300, None), (300, None), (301, "http://x.net"), (302, "http://one-casino.example.org/")]
    rows += [(400 + i, f"http://x.net/{i}") for i in range(20)]
    pages = spark.createDataFrame([(a, b, 1.0, "m") for a, b in rows], "page_id bigint, url string, mean double, n string").repartition(4)
    for small, hot in ((_scratch.SMALL_BYTES, 1000), (0, 10)):
        monkeypatch.setattr(_scratch, "SMALL_BYTES", small)
        monkeypatch.setattr(_scratch, "HOT", hot)
        got = [(r.page_id, r.verdict, r.rule) for r in url_filter.judge(pages, RULES).collect()]
        verdict = {k: v for k, v, _ in got}
        assert len(got) == len(rows) and all(verdict[i] == "block" for i in range(30)) and all(verdict[100 + i] == "allow" for i in range(30)) and verdict[200] == "allow"
        assert (301, "block", None) in got and verdict[302] == "allow" and verdict[300] == "allow"


def test_reputation_shrinks(spark):
    rows = [("big.example.com", 1)] * 60 + [("big.example.com", 0)] * 2 + [("one.example.com", 1)] + [("good.example.org", 0)] * 50 + [(None, 1), ("x.org", None)]
    r = {x.host: x for x in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert r["big.example.com"].bound > 0.5 > r["good.example.org"].bound and r["one.example.com"].bound < r["big.example.com"].bound
    assert 0 < r["one.example.com"].mean < 1 and "x.org" not in r


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:10] + rng.normal(0, 0.05, (10, 16)), np.repeat(base[:1], 30, axis=0), base[5:6] * 3])
    rows = [(int(i * 2 + 1), v.tolist()) for i, v in enumerate(x)] + [(900, None), (902, []), (904, [0.0] * 16), (906, [math.nan] + [1.0] * 15), (908, [None] + [1.0] * 15), (910, [1e308] * 16), (912, [math.inf] + [0.0] * 15)]
    df = spark.createDataFrame([(a, b, 3) for a, b in rows], "vec_id bigint, embedding array<double>, cell int").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    ids = np.arange(len(x)) * 2 + 1
    comp = ids.copy()
    for _ in ids:
        comp = np.array([min(comp[i], comp[s[i]].min(initial=10**9)) for i in range(len(x))])
    for block in (512, 8, 3):
        got = {r.vec_id: r for r in ego_join.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows)
        assert all((got[k].n_links, got[k].component_id) == (int(n), int(c)) for k, n, c in zip(ids.tolist(), s.sum(axis=1), comp))
        assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 914, 2))
    assert ego_join.near_duplicates(df.limit(0)).count() == 0


def test_equal_vectors_and_repeated_ids(spark):
    """Many equal vectors, many rows of one id, and null ids: no link is lost whatever the block."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3, 8))
    rows = [(7 if i < 200 else 1000 + i, v[0].tolist()) for i in range(500)] + [(7, v[1].tolist()), (3, (v[1] * 2).tolist()), (None, v[0].tolist()), (None, None), (4, v[2].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    for block in (1, 512):
        got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in ego_join.near_duplicates(df, block=block).collect())
        want = [(7 if i < 200 else 1000 + i, 499, 7, i < 200) for i in range(500)] + [(7, 1, 3, False), (3, 1, 3, True), (4, 0, 4, True)]
        assert [g for g in got if g[0]] == sorted(want) and sum(not g[0] for g in got) == 2 and all(g[1] == 0 and g[3] for g in got if not g[0])


def test_many_blocks_in_a_partition(spark):
    """Chains of near vectors over hundreds of blocks, against all pairs."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 4)), 8, axis=0)
    x += np.cumsum(rng.normal(0, 0.04, x.shape), axis=0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    got = {r.vec_id: r.n_links for r in ego_join.near_duplicates(spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "vec_id bigint, embedding array<double>"), block=2).collect()}
    assert [got[i] for i in range(len(x))] == s.sum(axis=1).tolist() and s.sum() > 500


def _shuffled(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_blocks_travel_no_more_often_in_a_larger_table(spark):
    """Four times the vectors in four times the blocks shuffle about four times the bytes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 512))
    bytes_of = []
    for n in (200, 800):
        df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x[:n])], "vec_id bigint, embedding array<double>").repartition(4)
        before = _shuffled(spark)
        assert ego_join.near_duplicates(df, block=4).where("n_links = 0").count() == n
        bytes_of.append(_shuffled(spark) - before)
    assert bytes_of[1] < 6 * bytes_of[0], bytes_of


def test_waves_of_small_squares(spark, monkeypatch):
    """Squares that memory cuts, in several waves, with forests folded often: all links, as of all pairs."""
    for name, value in (("SIDE_BYTES", 400), ("WAVE_BYTES", 1), ("WAITING", 3), ("BATCH_BYTES", 1)):
        monkeypatch.setattr(ego_join, name, value)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 4)), 8, axis=0)
    x += np.cumsum(rng.normal(0, 0.04, x.shape), axis=0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    comp = np.arange(len(x))
    for _ in comp:
        comp = np.array([comp[near].min() for near in s])
    got = {r.vec_id: (r.n_links, r.component_id) for r in ego_join.near_duplicates(spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "vec_id bigint, embedding array<double>"), block=3).collect()}
    assert [got[i] for i in range(len(x))] == list(zip((s.sum(axis=1) - 1).tolist(), comp.tolist(), strict=True))


def test_components(spark):
    r = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = chain + star + [(7, 7), (None, 3), (3, 9), (9, 3)]
    r.shuffle(edges)
    c = connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"))
    got = {x.id: x.component_id for x in c.collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 3: 3, 9: 3}


def test_pieces(spark, sf):
    import sentencepiece

    path = tokenizer_path(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "  two  spaces \n\ttab \u2581 under"), (10**9 + 3, "🙂 日本 \u0000 e\u0301")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumn("ids", F.lit(1))
    for r, t in zip(spm.encode(docs, path).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        text = t.text or ""
        assert r.ids == sp.encode(text, add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids) and r.n_tokens == len(r.ids)
        raw = text.encode()
        assert r.starts[1:] == r.ends[:-1] and r.ends[-1] == len(raw) and r.starts[0] == 0
        for i, a, b in zip(r.ids, r.starts, r.ends):
            if not sp.is_control(i) and not sp.is_byte(i) and not sp.is_unknown(i):
                assert sp.id_to_piece(i).replace("\u2581", " ").strip() == raw[a:b].decode().replace("\u2581", " ").strip()


def test_character_map():
    """Longest prefixes through a small double array, built by the public layout: units of label, offset and value."""
    units = np.zeros(1024, np.uint32)
    root = 256
    units[0] = root << 10
    rules = {b"a": 0, b"ab": 2, b"\xc3\xa9": 5}
    strings = b"x\0yz\0e\0"
    base = {b"": root, b"a": 512, b"ab": 0x240, b"\xc3": 640, b"\xc3\xa9": 0x2C0}

    def put(prefix: bytes, byte: int) -> None:
        child = prefix + bytes([byte])
        at = base[prefix] ^ byte
        units[at] = byte | ((base[child] ^ at) << 10) | (256 if child in rules else 0)
        if child in rules:
            units[base[child]] = rules[child] | 1 << 31

    for word in rules:
        for i in range(len(word)):
            put(word[:i], word[i])
    blob = struct.pack("<I", len(units) * 4) + units.tobytes() + strings
    text, at = spm.CharacterMap(blob).apply("abacéb".encode())
    assert text == b"yzxceb" and at.tolist() == [0, 0, 2, 3, 4, 6, 7]
