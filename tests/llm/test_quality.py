"""The quality query against plain loops: features of each passage counted byte by byte, attention summed passage by passage."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from ostinato.llm import _words as W
from ostinato.llm import quality, queries


def fingerprint(word):
    for _, _, data, offs in W.chunks(pa.array([word], pa.binary())):
        return int(W.Words(data, offs, W.SPACED).hashes()[0])


def plain_passages(text):
    raw = (text or "").encode()
    words = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    per = max(1, -(-len(words) // quality.PASSAGE))
    for k in range(per):
        mine = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
        lo = 0 if k == 0 else mine[0].start()
        hi = len(raw) if k + 1 == per else words[(k + 1) * quality.PASSAGE].start()
        size, m = max(1, hi - lo), max(1, len(mine))
        shares = [0.0] * quality.N_CLASSES
        for byte in raw[lo:hi]:
            shares[next((i for i, c in enumerate(quality._CLASSES) if byte in c), len(quality._CLASSES))] += 1 / size
        tokens = [w.group() for w in mine]
        length = [len(t) for t in tokens]
        mean = sum(length) / m
        stats = [
            math.log1p(len(tokens)) / 4, len(set(tokens)) / m, sum(a == b for a, b in zip(tokens, tokens[1:])) / m, sum(a == b for a, b in zip(tokens, tokens[2:])) / m, mean / 8,
            math.sqrt(max(0, sum(x * x for x in length) / m - mean * mean)) / 8, sum(x > 16 for x in length) / m, math.log1p(per) / 5, math.log1p(size / m) / 4,
        ]
        hashed = [0.0] * quality.BUCKETS
        for t in tokens:
            h = fingerprint(t)
            hashed[h % quality.BUCKETS] += (1 if h >> 40 & 1 else -1) / math.sqrt(m) / 4
        yield np.array([*shares, *stats, *hashed])


def plain_score(model, text):
    w, seen = model.weights, []
    for x in plain_passages(text):
        x = np.clip((x - model.centre) / model.scale, -8, 8)
        h = np.tanh(x @ w["w"] + w["b"])
        gate = np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"])))
        seen.append((float(gate @ w["a"]), h))
    top = max(e for e, _ in seen)
    weight = [math.exp(e - top) for e, _ in seen]
    z = sum(a * h for a, (_, h) in zip(weight, seen)) / sum(weight)
    return 1 / (1 + math.exp(-float(np.ravel(z @ w["c"] + w["d"])[0])))


def test_query_scores_as_plain_loops(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, queries.table(spark, sf, "labels"))
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    some = sorted(texts, key=lambda k: (len(texts[k] or ""), k))
    for k in [*some[:15], *some[len(some) // 2 : len(some) // 2 + 15], *some[-2:]]:
        want = plain_score(model, texts[k])
        assert got[k].score == pytest.approx(want, abs=2e-5) and got[k].predicted == (got[k].score >= queries.ACCEPT)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ü\t漢  x"), (4, "w" * 5000)], "doc_id bigint, text string")
    for r in quality.score(odd, model, keep_text=True).collect():
        assert r.score == pytest.approx(plain_score(model, r.text), abs=2e-5)
