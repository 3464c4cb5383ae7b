"""Operators on texts against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ostinato.llm import _words as W
from ostinato.llm import chosen_path, decontaminate, lines, quality, recompress

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def corpus(seed=5):
    """Texts with copies, near copies, shared passages, runs, periods, odd characters, and one long one."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "naïve", "日本", "a"]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = make(60)
    docs = [" ".join(make(r.randint(1, 200))) for _ in range(30)]
    docs += [None, "", " \n\t ", "one", "a b c d", "a b c d", docs[0], docs[0], "x " * 90, "p q " * 60, "\x1c odd\x85sep\u00a0arators"]
    docs += [" ".join(make(20) + passage + make(15)), "\n".join([" ".join(passage), " ".join(make(40))]), " ".join(make(3000) + passage)]
    base = make(150)
    for _ in range(12):
        c = list(base)
        for _ in range(r.randint(0, 6)):
            c[r.randrange(len(c))] = r.choice(vocab)
        docs.append(" ".join(c))
    line = " ".join(make(12))
    docs += [line + "\n" + " ".join(make(9)), " ".join(make(9)) + "\n" + line, line.replace("w", "W", 1) + " more\nZu und.", "Zu und.\n\nZu und."]
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(k, t, 7, "en") for k, t in rows], "doc_id bigint, text string, n_words int, lang string").repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def test_recompression_of_hot_texts(docs, texts, monkeypatch):
    """Copies of one text are dealt over tasks where no table is broadcast: the same documents go."""
    from ostinato.llm import _scratch

    want = sorted(tuple(r) for r in recompress.deduplicate(docs).collect())
    monkeypatch.setattr(_scratch, "SMALL_BYTES", 0)
    monkeypatch.setattr(_scratch, "HOT", 1)
    assert sorted(tuple(r) for r in recompress.deduplicate(docs).collect()) == want
    assert len({t for _, t in texts if t}) < len([t for _, t in texts if t])


def test_recompression(docs, texts):
    got = {r.doc_id: r for r in recompress.deduplicate(docs).collect()}
    seen = set()
    for k, t in texts:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(a for a, b in zip(w, gone, strict=True) if not b)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text, got[k].kept_sha256) == (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 500


codes_of = lambda codes: W.mix(np.array(codes, np.uint64) + np.uint64(99))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=120), st.integers(1, 40))
def test_equal_windows_have_equal_anchors(codes, cut):
    h, docs = codes_of(codes), np.unique([0, min(cut, len(codes)), len(codes)])
    s, e, name = recompress.anchors(h, docs, 20)
    of = {i: (n, k) for k, (a, b, n) in enumerate(zip(s, e, name)) for i in range(a, b)}
    by = {}
    for a, b in zip(docs[:-1], docs[1:]):
        for i in range(a, b - 19):
            assert by.setdefault(tuple(codes[i : i + 20]), of[i][0]) == of[i][0]
            for j in range(a, i):  # equal windows are in two stretches
                assert codes[i : i + 20] != codes[j : j + 20] or of[i][1] != of[j][1]
    assert len(of) == sum(max(0, b - a - 19) for a, b in zip(docs[:-1], docs[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30), st.lists(st.integers(0, 50), min_size=30, max_size=80), st.lists(st.integers(0, 50), max_size=30))
def test_equal_stretches_have_equal_symbols_inside(left, middle, right):
    """Symbols that the words of a passage determine are the same wherever the passage stands, on every level."""
    alone, within = (recompress.symbols(codes_of(x), np.array([0, len(x)])) for x in (middle, left + middle + right))
    for a, b in zip(alone, within):
        inside = lambda x, lo, hi: {(int(p) - lo, int(n), int(u) - lo, int(v) - lo) for p, n, u, v in zip(x.at, x.name, x.lo, x.hi) if u >= lo and v <= hi}
        assert inside(a, 0, len(middle)) == inside(b, len(left), len(left) + len(middle))


def test_runs_and_pairs_are_named():
    h = codes_of([7] * 6 + [1, 2] * 5 + [7] * 6 + [3])
    one = recompress._round(recompress.symbols(h, np.array([0, len(h)]))[0], np.array([0, len(h)]), 1)
    runs = [(a, n) for a, b, n in zip(one.at, [*one.at[1:], len(h)], one.name) if b - a >= 6 and a in (0, 16)]
    assert len(one.at) < 16 and len(runs) >= 1
    r = random.Random(1)
    words = [r.randrange(1000) for _ in range(400)]
    s, e, name = recompress.long_symbols(codes_of(words + [5] * 9 + words), np.array([0, 809]), 20)
    assert (e - s >= 20).all() and len(set(name.tolist())) < 0.75 * len(name)
    seen = {}
    for a, b, n in zip(s, e, name):
        x = (words + [5] * 9 + words)[a:b]
        assert seen.setdefault(n, x) == x


def test_near_duplicates(docs, texts):
    got = {r.doc_id: r for r in chosen_path.near_duplicates(docs).collect()}
    sets = {}
    for k, t in texts:
        w = SPACED.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), comp[k], comp[k] == k) for k in sets}
    kept = chosen_path.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k in sets if comp[k] == k)


def test_large_node_paths(docs, texts, monkeypatch):
    """The same links when nodes count as large, branch, and end in tiles, and when tables count as large and nodes as hot."""
    from ostinato.llm import _scratch

    want = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs).collect()}
    monkeypatch.setattr(_scratch, "SMALL_BYTES", 0)
    monkeypatch.setattr(_scratch, "HOT", 3)
    for name, value in (("SMALL", 2), ("OUTSIDE", 1), ("LEVELS", 2)):
        monkeypatch.setattr(chosen_path, name, value)
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs).collect()} == want
    monkeypatch.setattr(chosen_path, "OUTSIDE", 1024)
    assert {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs).collect()} == want


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.80, each a group of its own: all are found, none below is linked."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    rows, near = [], 0
    for i in range(400):
        base = [r.choice(vocab) for _ in range(r.randint(60, 300))]
        other = list(base)
        shingles = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        alike = lambda: len(shingles(base) & shingles(other)) / len(shingles(base) | shingles(other))
        while alike() > 0.80:
            other[r.randrange(len(other))] = r.choice(vocab)
        near += 100 * len(shingles(base) & shingles(other)) >= 75 * len(shingles(base) | shingles(other))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert near > 300 and sum(not x.kept for x in got) == near and all(x.component_id in (x.doc_id, x.doc_id - 1) for x in got)


def test_lines(docs, texts):
    got = {r.doc_id: r for r in lines.deduplicate(docs).collect()}
    earlier: list[tuple] = []
    words = lambda x: SPACED.findall(x)
    for k, t in texts:
        keep = []
        for x in (t or "").split("\n"):
            w = words(x)
            gone = len(w) >= 2 and any(e == w or (len(w) >= 8 and len(e) >= 8 and lines.near(e, w)) for e in earlier)
            earlier.append(w)
            if not gone:
                keep.append(x)
        assert got[k].text == (None if t is None else "\n".join(keep)), k
        assert got[k].lang == "en"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_edit_bound(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (a[i] != b[j]))
    assert lines.near(a, b) == (d[-1, -1] <= 1)


def items(spark, texts):
    w = [ALNUM.findall(lower(t)) for _, t in texts if t]
    long = max(w, key=len)
    rows = [(1, " ".join(long[5:40])), (2, " ".join(long[10:22]).upper()), (10, " ".join(long[100:104])), (3, None), (4, "..."), (5, " ".join(long[5:40])), (6, "a"), (7, "never seen before")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontamination(spark, docs, texts):
    table = items(spark, texts)
    windows = {}
    for r in table.collect():
        w = ALNUM.findall(lower(r.text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    for shard in (100_000, 20):
        got = {r.doc_id: r for r in decontaminate.report(docs, table, shard_words=shard).collect()}
        for k, t in texts:
            w = ALNUM.findall(lower(t))
            hit, found = set(), set()
            for n in {len(x) for x in windows}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        found |= windows[tuple(w[i : i + n])]
            ids = ",".join(sorted(map(str, found)))
            r = got[k]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    assert any(r.contaminated for r in got.values())
    clean = decontaminate.decontaminate(docs, table, max_coverage=1.0)
    assert clean.columns == docs.columns
    spans = {r.doc_id: r.spans for r in decontaminate.match(docs, table).collect()}
    for r in clean.collect():
        raw = (dict(texts)[r.doc_id] or "").encode()
        for x in reversed(spans[r.doc_id]):
            raw = raw[: x.byte_start] + raw[x.byte_end :]
        assert (r.text or "") == raw.decode()
    assert decontaminate.report(docs, table.limit(0)).where("contaminated").count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert recompress.deduplicate(none).count() == chosen_path.near_duplicates(none).count() == lines.deduplicate(none).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(none, model).count() == 0
    assert {round(r.score, 6) for r in quality.score(docs, model).collect()} == {0.5}


def test_null_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")], "doc_id bigint, text string")
    r = chosen_path.near_duplicates(df).collect()
    assert sorted((x.doc_id or 0, x.component_id, x.kept) for x in r) == [(0, None, True), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert lines.deduplicate(df.withColumn("text", F.lit("one two three"))).count() == 4
    assert recompress.deduplicate(df).count() == 4


def test_repeated_ids(spark):
    """Rows of one id with unlike texts are unlike documents; rows equal in both are one."""
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(5, "l1 aa bb\nx y z"), (5, "unique first line\n" + base), (5, "unique first line\n" + base), (6, base + "\nx y z"), (6, "short"), (None, base), (7, "short")]
    df = spark.createDataFrame([(a, b, "q", 1) for a, b in rows], "doc_id bigint, text string, _gone string, k int").repartition(3)
    order = sorted({(a, hashlib.md5(b.encode()).digest(), b) for a, b in rows if a})
    seen, want, windows, removed = set(), {}, set(), {}
    for a, _, b in order:
        want[a, b] = "\n".join(x for x in b.split("\n") if (x not in seen, seen.add(x))[0])
        w = b.split()
        own = [tuple(w[i : i + 20]) for i in range(len(w) - 19)]
        removed[a, b] = len({j for i, x in enumerate(own) if x in windows for j in range(i, i + 20)})
        windows.update(own)
    got = lines.deduplicate(df, min_words=1, edit_every=20, min_chars=20)
    assert sorted((r.doc_id or 0, r.text, r._gone, r.k) for r in got.collect()) == sorted((a or 0, want[a, b] if a else b, "q", 1) for a, b in rows)
    assert sorted((r.doc_id or 0, r.n_removed) for r in recompress.deduplicate(df).collect()) == sorted((a or 0, removed[a, b] if a else 0) for a, b in rows)


def test_items_of_any_type(spark, docs, texts):
    """Text ids sorted as strings, null ids not listed, one long item in pieces, and two passes: the same hits."""
    long = " ".join(ALNUM.findall(lower(max((t or "" for _, t in texts), key=len))))
    rows = [("b10", long[:400]), ("b9", long[:400]), (None, long[500:900]), ("c", long.replace(" ", "\n"))]
    table = spark.createDataFrame(rows, "item_id string, text string")
    a = {r.doc_id: r for r in decontaminate.report(docs, table).collect()}
    for conf in ({"shard_words": 25}, {"shard_words": 400}):
        old, decontaminate.SHARDS = decontaminate.SHARDS, 3
        try:
            assert {r.doc_id: r for r in decontaminate.report(docs, table, **conf).collect()} == a
        finally:
            decontaminate.SHARDS = old
    best = max(a.values(), key=lambda r: r.n_hit)
    assert best.n_items == 3 and best.items_sha256 == hashlib.sha256(b"b10,b9,c").hexdigest() and best.n_hit == best.n_words


def test_quality_learns_held_out(spark):
    r = random.Random(0)
    good = [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(30, 300))) for _ in range(300)]
    bad = [" ".join(["###", f"w{r.randint(0, 3)}"] * r.randint(20, 150)) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows] + [(9999, None), (9998, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows] + [(0, 0), (None, 1), (5000, 7)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    s = {x.doc_id: (x.score, x.h) for x in quality.score(docs, model).select("doc_id", "score", quality.held_out().alias("h")).collect()}
    test = [(s[i][0] >= 0.7) == (c == 1) for i, _, c in rows if s[i][1]]
    assert len(test) > 50 and np.mean(test) > 0.95
    assert s[9999][0] == s[9998][0] and len(s) == 602


def test_gradients():
    rng = np.random.default_rng(0)
    m = quality.train([rng.normal(size=(3, quality.FEATURES)).astype(np.float32) for _ in range(4)], np.array([0.0, 1, 0, 1]))
    x, first, y = rng.normal(size=(5, quality.FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(m.score(x, first)) + (1 - y) * np.log(1 - m.score(x, first)))
    g = m.gradients(x, first, y)
    for k, w in m.weights.items():
        i = tuple(0 for _ in w.shape)
        old = w[i]
        w[i] = old + 1e-5
        up = loss()
        w[i] = old - 1e-5
        down = loss()
        w[i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), k


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=10), st.text("ab", max_size=10), st.integers(0, 5))
def test_within(a, b, k):
    assert lines.within(a, b, k) == (distance(a, b) <= k)


def edited(r, base, n, vocab):
    out = list(base)
    for _ in range(n):
        i, how = r.randrange(len(out)), r.randrange(3)
        out[i : i + (how != 0)] = [] if how == 1 else [r.choice(vocab)]
    return out


def lines_by_brute_force(texts, min_words, chars):
    earlier, gone = [], {}
    for k, t in texts:
        for i, x in enumerate(t.split("\n")):
            w = SPACED.findall(x)
            u = w if len(w) >= 8 else " ".join(w) if chars and len(" ".join(w)) >= 20 else None
            near = lambda v, u=u: u is not None and type(v) is type(u) and abs(len(u) - len(v)) <= max(1, max(len(u), len(v)) // 20) and distance(u, v) <= max(1, max(len(u), len(v)) // 20)
            if len(w) >= min_words and w and any(w == e or near(v) for e, v in earlier):
                gone.setdefault(k, set()).add(i)
            earlier.append((w, u))
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in texts}


def test_lines_bound_grows_with_the_line(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for n in (8, 12, 19, 37, 38, 39, 40, 41, 48, 59, 60, 61, 80, 119, 160, 300):
        base = [r.choice(vocab) for _ in range(n)]
        rows += [" ".join(base), *(" ".join(edited(r, base, e, vocab)) for e in (1, 1, 2, 2, 3, 4, n // 20, n // 20, n // 20 + 1))]
    rows += [" ".join(["x"] * 60), " ".join(["x"] * 62), " ".join(["x", "y"] * 30)]
    # the least stretch that is left: 13 words, at each place
    for lo in (0, 13, 27):
        base = [r.choice(vocab) for _ in range(40)]
        rows += [" ".join(base), " ".join("new" if i in {13, 26} else x for i, x in enumerate(base)), " ".join("odd" if i in {lo, 39 - lo} else x for i, x in enumerate(base))]
    r.shuffle(rows)
    texts = [(i, "\n".join(rows[3 * i : 3 * i + 3])) for i in range(-(-len(rows) // 3))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in lines.deduplicate(df, edit_every=20).collect()}
    assert got == lines_by_brute_force(texts, 2, False)
    assert got != {x.doc_id: x.text for x in lines.deduplicate(df).collect()}


def test_lines_of_few_words(spark):
    r = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(300)] + list("aé😀")
    rows = ["once", "once", " once\t", "two words", "two  words", "短い行", "短い行", "", ""]
    for n in (19, 20, 21, 38, 39, 40, 41, 60, 80, 150):
        base = [r.choice(han) for _ in range(n)]
        rows += ["".join(base), "".join(base), *("".join(edited(r, base, e, han)) for e in (1, 1, 2, 3, n // 20))]
    base = list("https://example.org/a/rather/long/path?with=some&more=values of it")
    rows += ["".join(edited(r, base, e, "xyz ")) for e in (0, 1, 2, 3, 4)]
    rows += ["a few words in a line here", "a few words in a line there", "a few words in a line there now"]
    r.shuffle(rows)
    texts = [(i, "\n".join(rows[3 * i : 3 * i + 3])) for i in range(-(-len(rows) // 3))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in lines.deduplicate(df, min_words=1, edit_every=20, min_chars=20).collect()}
    assert got == lines_by_brute_force(texts, 1, True)
    assert sum(len(t) for t in got.values()) < sum(len(x.text) for x in lines.deduplicate(df).collect())


def test_lines_in_tiles(spark, monkeypatch):
    """A gram of many lines, most of them beyond the bound of the first one."""
    monkeypatch.setattr(lines, "MANY", 3)
    monkeypatch.setattr(lines, "TILE", 20)
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(100)]
    texts = [(i, " ".join(edited(r, base, r.randint(0, 7), vocab))) for i in range(70)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.text for x in lines.deduplicate(df, edit_every=20).collect()}
    assert got == lines_by_brute_force(texts, 2, False)
    assert 3 < sum(t == "" for t in got.values()) < 67
