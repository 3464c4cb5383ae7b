"""Token ids packed into rows of one length by best-fit-decreasing.

Each task tokenises its documents and packs them in blocks of bounded size. Documents longer than a row are split,
nothing is cut off; pieces go in order of length into the open row with the least room that suffices, found in a
segment tree over the rooms. A block's result depends on its documents alone, so a lost task is run again as it was.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from .warc import open_file

LENGTH = 2048
#: Tokens that a task gathers before it packs them.
BLOCK_TOKENS = 4 << 20
#: Bytes of a file of ids before the next is begun.
SEGMENT = 16 << 20


class Rooms:
    """Open rows by the room they have left, under a segment tree that finds the least room of some size or more."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.base
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least this size; it is no longer open."""
        i = size + self.base
        while not self.count[i]:
            while i & 1:  # up from a right child
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.base:
            i *= 2
            if not self.count[i]:
                i += 1
        room = i - self.base
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of pieces (positions in sizes, each from 1 to length), fullest possible by best-fit-decreasing."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str):
    """A byte-level tokenizer from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


SCHEMA = "input_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, offsets array<int>, n_tokens int"


def _pack(pieces: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, kind: str) -> Iterator[pa.RecordBatch]:
    """pieces: (document, position of its first token in it, ids)."""
    rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
    for lo in range(0, len(rows), 512):
        ids, cuts, docs, offs, used = [], [], [], [], []
        for row in rows[lo : lo + 512]:
            own = [pieces[i] for i in row]
            out = np.full(length, pad, kind)
            flat = np.concatenate([p[2] for p in own])
            out[: len(flat)] = flat
            ids.append(out.tobytes())
            cuts.append(np.cumsum([0, *(len(p[2]) for p in own)]).tolist())
            docs.append([p[0] for p in own])
            offs.append([p[1] for p in own])
            used.append(len(flat))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(cuts, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(offs, pa.list_(pa.int32())), pa.array(used, pa.int32())], ["input_ids", "cu_seqlens", "doc_ids", "offsets", "n_tokens"])


def _packer(path: str, pattern: str, end: int, length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(path, pattern)
        kind = "<u2" if max(enc.n_vocab, end + 1) <= 1 << 16 else "<u4"
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*enc.encode_ordinary(text.as_py() or ""), end], kind)
                pieces += [(k.as_py(), i, ids[i : i + length]) for i in range(0, len(ids), length)]
                held += len(ids)
                if held >= block:
                    yield from _pack(pieces, length, end, kind)
                    pieces, held = [], 0
        if pieces:
            yield from _pack(pieces, length, end, kind)

    return run


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``length`` ids: input_ids (binary, little-endian, 16 bits an id where the vocabulary allows, else 32),
    cu_seqlens (cumulative lengths of the pieces from 0: position ids begin anew at each but the last), doc_ids and offsets
    (document of each piece and the place of its first token in it), n_tokens (the rest is filled with end_id).

    Every document ends in end_id; a null or empty text is that id alone. Pieces of one document, put together by their
    offsets, are its ids again. A null doc_id stays null; repeated rows are packed each; an id that isn't a whole number is an error. An
    empty table gives no row.
    The file of ranks has to be readable on every executor.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_packer(ranks_path, pattern, end_id, length, block_tokens), SCHEMA)


def position_ids(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Positions that begin anew at each piece, and at the filling."""
    cuts = np.unique([*cu_seqlens, length])
    return np.arange(length) - np.repeat(cuts[:-1], np.diff(cuts))


_ROW = [("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("n_tokens", pa.int32())]
ROW_SCHEMA = "input_ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, offsets array<int>, n_tokens int"
MANIFEST = "path string, rows bigint, bytes_per_id int"


def _ragged(rows: list, kind: str) -> bytes:
    """An index of the rows (rows + 1 places), then their values, as integers of one kind."""
    flat = [np.asarray(r, kind) for r in rows]
    return np.concatenate([np.cumsum([0, *map(len, flat)]).astype(kind), *flat]).tobytes()


def _matrix_writer(root: str, length: int, segment: int):
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, held, done = None, "", 0, [], []

        def close() -> None:
            nonlocal out, size, held
            out.close()
            cuts, docs, offs = (list(x) for x in zip(*held, strict=True))
            resets = [np.flatnonzero(position_ids(c, length) == 0) for c in cuts]
            parts = {"cu": _ragged(cuts, "<i4"), "resets": _ragged(resets, "<i4"), "docs": _ragged([[0 if k is None else k for k in r] for r in docs], "<i8"), "nulls": _ragged([[k is None for k in r] for r in docs], "<i4"), "offsets": _ragged(offs, "<i4")}
            for kind, raw in parts.items():
                with open_file(f"{name}.{kind}.bin", "wb") as f:
                    f.write(raw)
            done.append((name, len(held), size // len(held) // length))
            out, size, held = None, 0, []

        for batch in batches:
            ids, *rest = (batch.column(c).to_pylist() for c in ("input_ids", "cu_seqlens", "doc_ids", "offsets"))
            for row, *own in zip(ids, *rest, strict=True):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}"
                    out = open_file(f"{name}.ids.bin", "wb")
                out.write(row)
                size += len(row)
                held.append(own)
                if size >= segment:
                    close()
        if out is not None:
            close()
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["path", "rows", "bytes_per_id"])

    return run


def write_matrices(packed: DataFrame, root: str, length: int = LENGTH, segment: int = SEGMENT) -> DataFrame:
    """Raw files in a shared folder, a group for each ``segment`` bytes of ids: ``.ids.bin`` a matrix of rows x length ids, ``.cu.bin``
    and ``.resets.bin`` the cumulative lengths and the positions where position ids begin anew, ``.docs.bin``, ``.nulls.bin`` and
    ``.offsets.bin`` the documents of the pieces (0 where ``nulls`` says null) and the places of their first tokens, each as
    integers after an index of the rows (rows + 1 of them). Returns a lazy manifest (path, rows, bytes_per_id): materialise it
    once; files that it doesn't name are of lost tasks. No rows, no files.
    """
    return packed.mapInArrow(_matrix_writer(root, length, segment), MANIFEST)


def _whole(name: str) -> bytes:
    with open_file(name, "rb") as f:
        return f.read()


def _unragged(name: str, rows: int, kind: str) -> list[np.ndarray]:
    x = np.frombuffer(_whole(name), kind)
    at, rest = x[: rows + 1], x[rows + 1 :]
    return [rest[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def read_matrix(path: str, rows: int, bytes_per_id: int, length: int = LENGTH) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ids, cumulative lengths and resets of one group of files."""
    ids = np.frombuffer(_whole(f"{path}.ids.bin"), f"<u{bytes_per_id}").reshape(rows, length)
    return ids, _unragged(f"{path}.cu.bin", rows, "<i4"), _unragged(f"{path}.resets.bin", rows, "<i4")


def _matrix_reader(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rows, width in zip(*(batch.column(c).to_pylist() for c in ("path", "rows", "bytes_per_id")), strict=True):
                ids, cuts, resets = read_matrix(path, rows, width, length)
                docs, nulls, offs = (_unragged(f"{path}.{k}.bin", rows, t) for k, t in (("docs", "<i8"), ("nulls", "<i4"), ("offsets", "<i4")))
                for lo in range(0, rows, 512):
                    part = slice(lo, lo + 512)
                    named = [pa.array(d, pa.int64(), mask=n.astype(bool)) for d, n in zip(docs[part], nulls[part], strict=True)]
                    own = [[x.tobytes() for x in ids[part]], cuts[part], resets[part], [x.to_pylist() for x in named], offs[part], [int(c[-1]) for c in cuts[part]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(own, _ROW, strict=True)], [k for k, _ in _ROW])

    return run


def read_matrices(manifest: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of all matrices that a manifest names, in no order: input_ids, cu_seqlens, resets, doc_ids, offsets, n_tokens."""
    return manifest.mapInArrow(_matrix_reader(length), ROW_SCHEMA)


def pack_to_files(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, length: int = LENGTH, **kw) -> DataFrame:
    """Pack, write the matrices into the shared folder, and read them back: the rows of ``read_matrices`` (see ``pack``)."""
    scratch = Scratch(docs.sparkSession, "packing")
    manifest = scratch.save(write_matrices(pack(docs, ranks_path, pattern, end_id, length, **kw), scratch.path("matrices"), length), "manifest")
    return read_matrices(manifest.repartition(max(1, manifest.count())), length)
