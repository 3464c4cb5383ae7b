"""The pipeline: every stage against brute force on the smallest tables, and on nulls, empties, repeats, clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ostinato.llm import lines, quality
from ostinato.llm.queries import ACCEPT, PIECES, table, tokenizer_path

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def near_groups(sets, percent=75):
    """The smallest id that links reach, for each id."""
    comp = {k: k for k in sets}

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = [k for k in sorted(sets) if sets[k]]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                comp[q] = p
    return {k: top(k) for k in sets}


def cut_lines(texts):
    """Texts by the operator's rule, over all pairs of lines: equal words, or edits within the bound."""
    earlier, out = [], {}
    for k, t in sorted(texts.items()):
        keep = []
        for x in t.split("\n"):
            w = SPACED.findall(x)
            u = w if len(w) >= 8 else " ".join(w) if len(" ".join(w)) >= 20 else None
            near = lambda v, u=u: u is not None and type(u) is type(v) and lines.within(u, v, max(1, max(len(u), len(v)) // 20))
            if not (w and any(w == e or near(v) for e, v in earlier)):
                keep.append(x)
            earlier.append((w, u))
        out[k] = (t, "\n".join(keep))
    return {k: y for k, (x, y) in out.items() if x == y or y.strip(" ")}


def without_passages(text, windows):
    w = [(m.start(), m.end(), m[0]) for m in ALNUM.finditer(lower(text))]
    hit = [False] * len(w)
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(x[2] for x in w[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
    if w and sum(hit) > len(w) / 2:
        return None
    spans, i = [], 0
    while i < len(w):
        j = i
        while j < len(w) and hit[j]:
            j += 1
        if j > i:
            spans.append((w[i][0], w[j - 1][1]))
        i = max(j, i + 1)
    for a, b in reversed(spans):
        text = text[:a] + text[b:]
    return text


def test_every_stage_by_brute_force(spark, sf):
    import sentencepiece

    d = table(spark, sf, "documents")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    docs = d
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        got.append({r.doc_id: r for r in docs.collect()})
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    rest = {r.doc_id: r for r in d.collect()}
    model = quality.fit(d, table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    texts = {k: r.text for k, r in rest.items() if scores[k] >= ACCEPT}
    assert {k: r.text for k, r in got[0].items()} == texts and 0 < len(texts) < len(rest)
    texts = cut_lines(texts)
    assert {k: r.text for k, r in got[1].items()} == texts
    sets = {}
    for k, t in texts.items():
        w = SPACED.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = near_groups(sets)
    texts = {k: t for k, t in texts.items() if comp[k] == k}
    assert {k: r.text for k, r in got[2].items()} == texts
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = ALNUM.findall(lower(r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    texts = {k: x for k, t in texts.items() if (x := without_passages(t, windows)) is not None}
    assert {k: r.text for k, r in got[3].items()} == texts
    for k, r in got[3].items():
        assert (r.lang, r.source, r.n_chars) == (rest[k].lang, rest[k].source, len(r.text))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    assert set(got[4]) == set(texts)
    for k, r in got[4].items():
        ids = sp.encode(texts[k], add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded_sha256) == (ids, len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r.doc_id: r.n_tokens for r in P.run(spark, sf).collect()} == {k: r.n_tokens for k, r in got[4].items()}


@pytest.mark.parametrize("name,stage", P.STAGES[1:4])
def test_stages_on_odd_rows(spark, sf, name, stage):
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(None, base), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, base), (4, base), (5, "x " * 30_000), (6, base + " more"), (6, "other text altogether")]
    names = ["score", "n_words", "spans", "items", "n_removed", "n_lines", "kept_sha256", "_gone", "gone", "rest", "g", "k", "row"]
    docs = spark.createDataFrame([(a, b, "en", "web", len(b or ""), *range(len(names))) for a, b in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    assert all([r[n] for n in names] == list(range(len(names))) and r.lang == "en" for r in got)
    ids = sorted(r.doc_id or 0 for r in got)
    gone = {"line dedup": [6], "minhash near-dedup": [6, 6], "benchmark decontamination": []}[name]
    want = sorted(a or 0 for a, _ in rows)
    for k in gone:
        want.remove(k)
    assert ids == want
    assert stage(spark, docs.limit(0), sf).count() == 0 and {r.text for r in got if r.doc_id in (1, 2, 3)} == {None, "", " \n\t"}


def test_first_and_last_stage_on_odd_rows(spark, sf):
    rows = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, "x " * 30_000)]
    docs = spark.createDataFrame([(a, b, "en", "web", 0, 0.5, 1) for a, b in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids int")
    out = P.quality_classifier(spark, table(spark, sf, "documents").withColumn("score", F.lit(0.5)).withColumn("ids", F.lit(1)).unionByName(docs), sf)
    assert out.columns[-2:] == ["score", "ids"] and {(r.score, r.ids) for r in out.collect()} == {(0.5, 1)}
    last = P.sentencepiece(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in last.collect())[:4] == [(0, 4), (1, 2), (2, 2), (2, 2)] and P.sentencepiece(spark, docs.limit(0), sf).count() == 0


def test_tables_that_stay_are_packed_tightly(spark):
    """A stage's table is smaller than with the session's codec, holds the same rows, and the setting is as before."""
    from ostinato.llm._scratch import Scratch

    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 97}" for j in range(300)), "en", "s", 0) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    own = Scratch(spark, "test")
    out = P._kept(own, P._packed(docs), docs)
    plain = own.save(out, "plain")
    assert own.size(out) < 0.8 * own.size(plain) and spark.conf.get("spark.sql.parquet.compression.codec") == before == "snappy"
    assert sorted(r[:4] for r in out.collect()) == sorted(r[:4] for r in docs.collect())


def test_stages_leave_no_table_of_their_own(spark, sf):
    """Of what stages after the first write, only the small tables stay that their unwritten results read; a whole run leaves its last table."""
    import pathlib

    from ostinato.llm import _scratch

    def left(before):
        return [f for r in _scratch._ROOTS - before for f in pathlib.Path(r.removeprefix("file://")).glob("*/*.parquet")]

    docs = table(spark, sf, "documents").limit(120).localCheckpoint()
    for _, stage in P.STAGES[1:]:
        before = set(_scratch._ROOTS)
        out = stage(spark, docs, sf)
        files = left(before)
        assert {f.name for f in files} <= {f.rsplit("/", 1)[1] for f in out.inputFiles()} and sum(f.stat().st_size for f in files) < 40_000
        assert out.count() > 0 and out.count() == out.toArrow().num_rows
    before = set(_scratch._ROOTS)
    out = P.run(spark, sf)
    assert {f.name for f in left(before)} == {f.rsplit("/", 1)[1] for f in out.inputFiles()} and out.count() > 0


def test_first_stage_leaves_no_table(spark, sf):
    """Its result lies on the disk once, where its caller writes it, and not a second time through all later stages."""
    import pathlib

    from ostinato.llm import _scratch

    before = set(_scratch._ROOTS)
    out = P.quality_classifier(spark, table(spark, sf, "documents"), sf)
    assert not [f for r in _scratch._ROOTS - before for f in pathlib.Path(r.removeprefix("file://")).glob("*/*.parquet")]
    assert all(f.endswith("/documents.parquet") for f in out.inputFiles()) and out.count() > 0
