"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its words and characters; a gated attention, learned
from the labels of documents alone, weighs the passages, and the weighted representation is scored. Scoring is a
narrow pass over whole texts; the model is fitted on the driver on a bounded, documented sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

PASSAGE, BUCKETS, HIDDEN, ATTENTION = 64, 64, 24, 12
#: Labelled documents the model is fitted on at most (those least by hash of their id), and passes over them.
SAMPLE, EPOCHS, RATE, BAGS, DECAY = 4000, 30, 3e-3, 64, 1e-4
#: Character classes of which a passage's shares are features.
_CLASSES = [[*range(65, 91)], [*range(97, 123)], [*range(48, 58)], [*range(128, 256)], [32], [10, 13], [9], [44, 46], [33, 63], [35, 37, 42, 61, 95, 126], [124, 47, 92, 38], [60, 62], [40, 41, 91, 93, 123, 125], [34, 39, 58, 59], [36, 43, 45, 64, 94, 96]]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[_c] = _i
N_CLASSES = len(_CLASSES) + 1
STATS = 9
FEATURES = N_CLASSES + STATS + BUCKETS


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of a chunk, and the first passage of each document with the end of the last.

    A passage is PASSAGE words with what stands between and after them; a text without words is one passage.
    """
    w = W.Words(data, offs, W.SPACED)
    n = np.diff(w.docs)
    per = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(n)), per)
    k = np.arange(total) - first[doc]
    lo = w.docs[doc] + k * PASSAGE
    hi = np.minimum(lo + PASSAGE, w.docs[doc + 1])
    has = hi > lo
    starts = np.append(w.starts, len(data))
    b_lo = np.where((k == 0) | ~has, offs[doc], starts[lo])
    b_hi = np.where(k + 1 == per[doc], offs[doc + 1], starts[np.minimum(hi, len(w))])
    size = np.maximum(1, b_hi - b_lo)

    place = np.repeat(np.arange(total), b_hi - b_lo)
    shares = np.bincount(place * N_CLASSES + _CLASS_OF[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES) / size[:, None]

    words = hi - lo
    m = np.maximum(1, words)
    h = w.hashes()
    of = np.repeat(np.arange(total), words)
    length = (w.ends - w.starts).astype(float)
    sums = lambda x: np.bincount(of, x, minlength=total)
    same = np.zeros(len(h))
    second = np.zeros(len(h))
    if len(h) > 2:
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        second[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
    with np.errstate(over="ignore"):
        own = np.sort(W.mix(h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(2**40 - 1) | (of.astype(np.uint64) << np.uint64(40)))
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    distinct = np.bincount((own[fresh] >> np.uint64(40)).astype(np.int64), minlength=total)
    mean = sums(length) / m
    stats = np.column_stack([np.log1p(words) / 4, distinct / m, sums(same) / m, sums(second) / m, mean / 8, np.sqrt(np.maximum(0, sums(length**2) / m - mean**2)) / 8, sums(length > 16) / m, np.log1p(per)[doc] / 5, np.log1p(size / m) / 4])

    bucket = of * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(bucket, sign, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.sqrt(m)[:, None] / 4
    return np.hstack([shares, stats, hashed]).astype(np.float32), first


@dataclass
class Model:
    """Weights of the encoder, of the gated attention and of the scorer, with the features' centre and scale."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        h = np.tanh(x @ w["w"] + w["b"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["a"]
        lo, n = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, lo), n))
        a = e / np.repeat(np.add.reduceat(e, lo), n)
        z = np.add.reduceat(a[:, None] * h, lo, axis=0)
        logit = z @ w["c"] + w["d"]
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, first)
        n = np.diff(first)
        d_logit = (f["p"] - y) / len(y)
        d_z = d_logit[:, None] * w["c"]
        wide = np.repeat(d_z, n, axis=0)
        d_a = (wide * f["h"]).sum(axis=1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, first[:-1]), n))
        d_tg = d_e[:, None] * w["a"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * wide + d_t @ w["v"].T + d_g @ w["u"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ d_in, "b": d_in.sum(axis=0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_g, "a": (f["t"] * f["g"]).T @ d_e, "c": f["z"].T @ d_logit, "d": d_logit.sum(keepdims=True)}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["p"]


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Adam over mini-batches of bags. Without bags of both labels the score is the share of label 1 everywhere."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"w": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": init(HIDDEN, ATTENTION), "u": init(HIDDEN, ATTENTION), "a": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1)}
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        w["c"], w["d"] = np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    x = np.vstack(bags)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-2, w)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BAGS):
            pick = order[i : i + BAGS]
            first = np.concatenate([[0], np.cumsum([len(bags[j]) for j in pick])])
            grad = model.gradients(np.vstack([bags[j] for j in pick]), first, y[pick])
            step += 1
            for k, g in grad.items():
                g = g + DECAY * w[k] * (w[k].ndim > 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offs in W.chunks(batch.column(1)):
            x, first = passages(data, offs)
            out += [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["doc_id", "bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows that aren't held out, those least by a hash of their id.

    Labels other than 0 and 1, null ids, and ids with labels of both kinds are left out. An id that isn't a whole number is an error.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    some = own.join(texts.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").select("id", "label").limit(sample)
    some = docs.sparkSession.createDataFrame(some.collect(), "id bigint, label int")
    rows = texts.join(F.broadcast(some), "id").select("id", "text", "label").mapInArrow(_bags, "doc_id bigint, bag binary, label int").toArrow()
    order = np.argsort(np.asarray(rows["doc_id"].combine_chunks()), kind="stable")
    bags = [np.frombuffer(rows["bag"][int(i)].as_buffer(), np.float32).reshape(-1, FEATURES) for i in order]
    return train(bags, np.asarray(rows["label"].combine_chunks())[order].astype(float))


def _scorer(model, at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, data, offs in W.chunks(batch.column(at)):
                rest = [batch.column(i).slice(lo, hi - lo) for i in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(m.score(*passages(data, offs)))], [*(batch.schema.names[i] for i in keep), "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows of docs with a column score, from 0 to 1, higher where label 1 is likelier; without the text unless asked for.

    Only the text is an input. Null and empty texts are scored as one passage without words. Every row stays, equal texts
    get equal scores, and an empty table gives an empty one; a column named score is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != "score"])
    docs = docs.withColumn(text, F.col(text).cast("string"))
    keep = [i for i, c in enumerate(docs.columns) if keep_text or c != text]
    schema = "".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}, " for i in keep) + "score double"
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), keep), schema)
