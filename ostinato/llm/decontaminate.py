"""Benchmark decontamination with a generalised suffix automaton of the test items.

Automata of the normalised items are built on the driver, each from a shard of bounded size, and broadcast as flat
arrays; documents stream through all of them in one pass, and the length of the longest match that ends at each
word tells which words lie in an occurrence of a window. Before an automaton sees a word, a vectorised test drops
the words that no occurrence can hold: a match of two words or more needs every adjacent pair in it to be adjacent
in some item. Documents are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _words as W
from ._scratch import Scratch

WINDOW = 10
#: Words of items in one automaton: some 130 MB on the driver while it is built, 10 MB in a worker. And automata in one pass over
#: the documents, some 320 MB in a worker: only suites of more than 8 M words make a second pass.
SHARD_WORDS, SHARDS = 250_000, 32

SPANS = "array<struct<word_start:int,word_end:int,byte_start:int,byte_end:int>>"


class Automaton:
    """All substrings of some word sequences, with the items whose windows end in each state.

    It is built with a dictionary for each state and kept as flat arrays, 40 bytes or so for a word: transitions sorted by state
    and code, suffix links, lengths, and the items of states. Items are numbers; their names stay with the caller.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.window = window
        self.vocab = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        coded = [(k, np.searchsorted(self.vocab, h).tolist()) for k, h in items if len(h)]
        nxt, link, length = self._build([c for _, c in coded])
        v = max(1, len(self.vocab))
        pairs = [np.asarray(c[:-1], np.int64) * v + np.asarray(c[1:], np.int64) for _, c in coded if len(c) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.least = min([window, *(len(c) for _, c in coded)])

        def holding(state: int, n: int) -> int:
            """The state of the last n words of the longest match of a state."""
            while length[link[state]] >= n:
                state = link[state]
            return state

        whole: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for k, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = nxt[state][c]
                if i + 1 >= window:
                    whole.setdefault(holding(state, window), set()).add(k)
            if len(codes) < window:
                short.setdefault(holding(state, len(codes)), []).append((len(codes), k))
        # by rising length, so that a state's shorter suffixes are known before it
        n = len(nxt)
        has_short, window_state = np.zeros(n, bool), np.full(n, -1, np.int32)
        for s in sorted(range(n), key=length.__getitem__):
            up = link[s]
            has_short[s] = s in short or (up >= 0 and has_short[up])
            if length[s] >= window:
                window_state[s] = window_state[up] if length[up] >= window else s
        self.at = np.concatenate([[0], np.cumsum([len(d) for d in nxt])]).astype(np.int32)
        order = [sorted(d) for d in nxt]
        self.code = np.fromiter((c for o in order for c in o), np.int32, int(self.at[-1]))
        self.to = np.fromiter((d[c] for d, o in zip(nxt, order, strict=True) for c in o), np.int32, int(self.at[-1]))
        self.link, self.length, self.window_state, self.has_short = np.array(link, np.int32), np.array(length, np.int32), window_state, has_short
        self.whole, self.short = {s: sorted(x) for s, x in whole.items()}, short

    @staticmethod
    def _build(sequences: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
        """Transitions, suffix links and lengths of the states."""
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def split(p: int, c: int, q: int) -> int:
            twin = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = twin
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = twin
                p = link[p]
            return twin

        for codes in sequences:
            last = 0
            for c in codes:
                q = nxt[last].get(c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                    continue
                state = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = state
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[state] = q if length[q] == length[p] + 1 else split(p, c, q)
                last = state
        return nxt, link, length

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, and whether each is a word of the items."""
        if not len(self.vocab):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return at, self.vocab[at] == h

    def segments(self, code: np.ndarray, known: np.ndarray, first_of_doc: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words, long enough for a window, in which all adjacent pairs are adjacent in items."""
        n = len(code)
        if not n or not len(self.vocab):
            return []
        tied = np.zeros(n + 1, bool)  # word i belongs with word i-1
        pair = code[:-1] * len(self.vocab) + code[1:]
        both = np.flatnonzero(known[:-1] & known[1:])
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair[both]), len(self.pairs) - 1)
            tied[both[self.pairs[at] == pair[both]] + 1] = True
        tied[first_of_doc[first_of_doc < n]] = False
        lo = np.flatnonzero(~tied[:n])
        hi = np.append(lo[1:], n)
        long = (hi - lo >= self.least) & known[lo]
        return list(zip(lo[long].tolist(), hi[long].tolist(), strict=True))

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, end, items) of each window that occurs, in order of their ends."""
        first, code, to, link, length = (memoryview(x) for x in (self.at, self.code, self.to, self.link, self.length))
        window, has_short, window_state = self.window, self.has_short, self.window_state
        state = n = 0
        for i, c in enumerate(codes):
            while True:
                lo, hi = first[state], first[state + 1]
                j = bisect_left(code, c, lo, hi)
                if j < hi and code[j] == c:
                    state, n = to[j], n + 1
                    break
                if not state:
                    n = 0
                    break
                state = link[state]
                n = length[state]
            if n >= window:
                yield i + 1 - window, i + 1, self.whole[int(window_state[state])]
            if n and has_short[state]:
                q = state
                while q > 0:
                    for m, k in self.short.get(q, ()):
                        if m <= n:
                            yield i + 1 - m, i + 1, [k]
                    q = link[q]


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, data, offs in W.chunks(pa.array(texts, pa.large_string())):
        w = W.Words(data, offs, W.ALNUM, W.LOWER)
        h = w.hashes()
        out += [h[a:b] for a, b in zip(w.docs[:-1].tolist(), w.docs[1:].tolist(), strict=True)]
    return out


def _pieces(h: np.ndarray, window: int, most: int) -> Iterator[np.ndarray]:
    """A long item in pieces of ``most`` words that overlap by all but one of a window: no window is lost."""
    at, most = 0, max(most, 2 * window)
    while len(h) - at > most:
        yield h[at : at + most]
        at += most - window + 1
    yield h[at:]


def _shards(items: DataFrame, item_id: str, item_text: str, window: int, shard_words: int) -> Iterator[tuple[Automaton, list]]:
    """Automata of bounded size with the names of their items; the driver holds one shard of items at a time."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    held: list[tuple[int, np.ndarray]] = []
    names: list = []
    size = 0
    for r in rows.toLocalIterator():
        for h in _pieces(_item_words([r.t])[0], window, shard_words):
            if not len(h):
                continue
            held.append((len(names), h))
            names.append(r.i)
            size += len(h)
            if size >= shard_words:
                yield Automaton(held, window), names
                held, names, size = [], [], 0
    yield Automaton(held, window), names


def _matcher(shards: list, text_at: int, n_in: int, more: bool, item_type: pa.DataType):
    """A function over Arrow batches that adds n_words, spans and items, or extends them: one pass for all automata."""
    keys = ("word_start", "word_end", "byte_start", "byte_end")
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in keys]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: list[tuple[Automaton, list]] = [s.value for s in shards]
        for batch in batches:
            counts, spans, items = [], [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for lo, _, data, offs in W.chunks(batch.column(text_at)):
                w = W.Words(data, offs, W.ALNUM, W.LOWER)
                counts.append(np.diff(w.docs))
                h = w.hashes()
                for auto, names in loaded:
                    code, known = auto.codes(h)
                    for a, b in auto.segments(code, known, w.docs[:-1]):
                        d = int(np.searchsorted(w.docs, a, "right")) - 1
                        base, own = int(w.docs[d]), []
                        for s, e, found in auto.stream(code[a:b].tolist()):
                            items[lo + d].update(names[k] for k in found)
                            s, e = s + a, e + a
                            # occurrences come in order of their ends; one that starts inside the last joins it
                            while own and s - base <= own[-1][1]:
                                s = min(s, own.pop()[0] + base)
                            own.append((s - base, e - base, int(w.starts[s] - offs[d]), int(w.ends[e - 1] - offs[d])))
                        spans[lo + d] += own
            cols = [batch.column(i) for i in range(n_in)]
            if more:
                for d, (was, had) in enumerate(zip(batch.column(n_in + 1).to_pylist(), batch.column(n_in + 2).to_pylist(), strict=True)):
                    spans[d] += [tuple(x.values()) for x in was]
                    items[d].update(had)
            cols += [
                pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
                pa.array([[dict(zip(keys, x, strict=True)) for x in _union(s)] for s in spans], kind),
                pa.array([sorted(found - {None}) for found in items], pa.list_(item_type)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:n_in], "n_words", "spans", "items"])

    return run


def _union(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


def match(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs with what of each text occurs in the items, in three columns that replace any of their names.

    n_words (long): words of the text; A-Z are lower-cased, and letters, digits and all beyond ASCII make words.
    spans: disjoint stretches of words inside occurrences of windows, as word and byte positions (of the UTF-8 text).
    items (array of the item_id's own type): ids of the items with occurring windows, ascending.
    A window is ``window`` consecutive words of an item, or the whole of a shorter item that has a word.
    Null and empty texts have no words and no spans; null items, or items without a word, have no windows; an
    empty table of items finds nothing. Items with equal texts are all reported; an item with a null id makes spans
    and is not listed. Rows keep their number, whatever their ids: no id of a document is read.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ("n_words", "spans", "items")])
    names, n_in = docs.columns, len(docs.columns)
    item_type = items.schema[item_id].dataType
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, n_words bigint, spans {SPANS}, items array<{item_type.simpleString()}>"
    scratch, out = Scratch(spark, "decontaminate"), docs
    send = spark.sparkContext.broadcast
    for i, shards in enumerate(batched((send(x) for x in _shards(items, item_id, item_text, window, shard_words)), SHARDS)):
        if i:
            out = scratch.save(out, "pass")
        out = out.mapInArrow(_matcher(list(shards), names.index(text), n_in, i > 0, to_arrow_type(item_type)), schema)
    return out


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see ``match``)."""
    m = match(docs.select(doc_id, text), items, text, **kw)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["word_end"] - s["word_start"])
    as_text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return m.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut(text: str):
    """The text without its spans, as an expression over its UTF-8 bytes."""
    raw = F.encode(F.col(text), "UTF-8")
    start = F.struct(F.lit(0).alias("at"), F.lit(bytearray()).alias("kept"))
    step = lambda a, s: F.struct(s["byte_end"].alias("at"), F.concat(a["kept"], F.substring(raw, a["at"] + 1, s["byte_start"] - a["at"])).alias("kept"))
    rest = lambda a: F.decode(F.concat(a["kept"], F.substring(raw, a["at"] + 1, F.length(raw) - a["at"])), "UTF-8")
    return F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col(text))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_words: int = 0, max_coverage: float = 0.5, **kw) -> DataFrame:
    """docs without what occurs in the items: same columns, fewer rows.

    A text loses each span of more than ``max_words`` words; a document whose spans cover more than
    ``max_coverage`` of its words goes as a whole. Null texts stay as they are.
    """
    m = match(docs, items, text, **kw)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["word_end"] - s["word_start"])
    m = m.where((F.col("n_words") == 0) | (n_hit <= F.lit(max_coverage) * F.col("n_words")))
    m = m.withColumn("spans", F.filter("spans", lambda s: s["word_end"] - s["word_start"] > max_words))
    return m.withColumn(text, _cut(text)).select(*[c for c in docs.columns if c in m.columns])
