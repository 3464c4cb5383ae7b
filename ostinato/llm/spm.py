"""SentencePiece encoding with byte spans of every piece in the original text, and decoding.

The normaliser is applied by longest prefixes through the compiled character map of the model (a double
array), and records for every normalised byte the original byte it came from; pieces are then projected
through that alignment. Segmentation and decoding are the sentencepiece library's.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W

SPACE = "▁".encode()
CHUNK = 1 << 19


class CharacterMap:
    """The longest-prefix replacements of a compiled character map; an empty one replaces nothing."""

    def __init__(self, blob: bytes):
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4")
            self.strings = blob[4 + n :]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """The replacement at a position and the bytes it stands for; an unmapped character stands for itself."""
        best = None
        if len(self.units):
            unit = int(self.units[0])
            pos = (unit >> 10) << ((unit & 512) >> 6)
            for i in range(at, len(raw)):
                pos ^= raw[i]
                if pos >= len(self.units):
                    break
                unit = int(self.units[pos])
                if unit & 0x800000FF != raw[i]:
                    break
                pos ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit & 256:
                    best = (int(self.units[pos]) & 0x7FFFFFFF, i + 1 - at)
        if best:
            value = self.strings[best[0] : self.strings.index(b"\0", best[0])]
            return value, best[1]
        n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + n], n

    def apply(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced bytes, and for each of them and for their end the original byte where its character starts."""
        if not len(self.units):
            return raw, np.arange(len(raw) + 1)
        out, source, at = [], [], 0
        while at < len(raw):
            value, n = self.longest(raw, at)
            out.append(value)
            source += [at] * len(value)
            at += n
        return b"".join(out), np.array([*source, at])


class Model:
    """A sentencepiece model with its normaliser's settings."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        control, byte = 3, 6  # kinds of pieces in the public model format
        self.width = np.array([0 if p.type == control else 1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces])
        self.unknown = self.sp.unk_id()

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes with the original byte of each, and of the end."""
        text, at = self.map.apply(raw)
        b = np.frombuffer(text, np.uint8)
        if self.squeeze:
            blank = b == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(b) else np.zeros(0, bool)
            if len(b) and keep.any() and b[np.flatnonzero(keep)[-1]] == 32:
                keep[np.flatnonzero(keep)[-1]] = False
            b, at = b[keep], np.append(at[:-1][keep], at[-1])
        if self.prefix and len(b):
            b = np.append(b, np.uint8(32)) if self.suffix else np.append(np.uint8(32), b)
            at = np.append(at, at[-1]) if self.suffix else np.append(at[0], at)
        if self.escape:
            wide = np.where(b == 32, 3, 1)
            first = np.cumsum(wide) - wide
            out = np.repeat(b, wide)
            for i, v in enumerate(SPACE):
                out[first[b == 32] + i] = v
            return out.tobytes(), np.append(np.repeat(at[:-1], wide), at[-1])
        return b.tobytes(), at

    def spans(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans of pieces: disjoint, in order; begin and end pieces are empty.

        Bytes that the normaliser drops belong to the piece before them; unknown pieces take what is left between their neighbours.
        """
        _, at = self.normalise(raw)
        width = self.width[ids]
        if (ids == self.unknown).any():
            width = self._unknown_widths(raw, ids, width)
        end = np.minimum(np.cumsum(width), len(at) - 1)
        start = np.concatenate([[0], end[:-1]])
        return at[start], at[end]

    def _unknown_widths(self, raw: bytes, ids: np.ndarray, width: np.ndarray) -> np.ndarray:
        pieces = self.sp.encode(raw.decode(), out_type=str)
        inner = np.flatnonzero((width > 0) | (ids == self.unknown))
        width = width.copy()
        if len(inner) == len(pieces):
            for i, p in zip(inner.tolist(), pieces, strict=True):
                width[i] = len(p.encode()) if ids[i] == self.unknown else width[i]
        return width


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _encoder(path: str, text_at: int, bos: bool, eos: bool, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = batch.column(text_at)
            if texts.null_count:
                texts = texts.fill_null("")
            for lo, hi, data, offs in W.chunks(texts, CHUNK):
                part = texts.slice(lo, hi - lo).to_pylist()
                coded = m.sp.encode(part, add_bos=bos, add_eos=eos, num_threads=1)
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns) if i != text_at]
                names = [x for i, x in enumerate(batch.schema.names) if i != text_at]
                n = pa.array([len(x) for x in coded], pa.int64())
                raw_ids = [np.asarray(x, "<u4") for x in coded]
                starts, ends = zip(*[m.spans(data[offs[i] : offs[i + 1]].tobytes(), x) for i, x in enumerate(raw_ids)], strict=True)
                if digest:
                    tiled = [int((s[1:] == e[:-1]).all() and (not len(e) or e[-1] == offs[i + 1] - offs[i])) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
                    cols = [n, pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in raw_ids]), pa.array([hashlib.sha256(m.sp.decode(x).encode()).hexdigest() for x in coded]), pa.array(tiled, pa.int32())]
                    new = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_tile"]
                else:
                    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in raw_ids])]), pa.int32())
                    cols = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), pa.int32())) for x in (raw_ids, starts, ends)]
                    cols = [n, *cols, pa.array([m.sp.decode(x) for x in coded])]
                    new = ["n_tokens", "ids", "starts", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays(rest + cols, names + new)

    return run


def encode(docs: DataFrame, model_path: str, text: str = "text", bos: bool = True, eos: bool = True, digest: bool = False) -> DataFrame:
    """The rows of docs with their text replaced by its encoding; columns of the new names are replaced.

    ids, starts, ends (arrays of int): piece ids and the byte span of each piece in the UTF-8 text; decoded: the library's
    decode(ids). With digest: n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256, and
    spans_tile (1 where the spans follow each other without a gap to the end of the text).
    A null text is an empty one; an empty text has the begin and end ids alone.
    The model's path has to be readable on every executor.
    """
    new = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_tile int" if digest else "n_tokens bigint, ids array<int>, starts array<int>, ends array<int>, decoded string"
    names = {x.split()[0] for x in new.split(", ")}
    docs = docs.select(*[c for c in docs.columns if c == text or c not in names])
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text)
    return docs.mapInArrow(_encoder(model_path, docs.columns.index(text), bos, eos, digest), rest + new)
