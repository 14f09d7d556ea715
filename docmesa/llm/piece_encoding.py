"""SentencePiece encoding and decoding that keeps the byte span of every piece.

The normaliser walks the model's compiled character map by longest prefix and records, for
every normalised byte, the byte of the source it came from. Pieces are laid over the
normalised text, and their ends go through that record to spans of the source's bytes.

Only bytes that begin a key of the map are walked from; what lies between stands for itself and
goes over, with its record, in whole runs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"


class CharsMap:
    """A compiled character map: a double array of 32-bit units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        self.firsts = np.zeros(256, dtype=bool)  # bytes that begin a key
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{n // 4}I", blob, 4))
            self.replacements = blob[4 + n :]
            root = _offset(self.units[0])
            self.firsts = np.array([(root ^ c) < len(self.units) and self.units[root ^ c] & 0x800000FF == c for c in range(256)])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Bytes of the longest key that begins at `at`, and what replaces them."""
        best, units = (0, None), self.units
        if not units:
            return best
        node = _offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return best


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


class Spans(NamedTuple):
    ids: np.ndarray  # int32
    begin: np.ndarray  # int64, bytes of the source
    end: np.ndarray
    decoded: str


class OffsetEncoder:
    """Encodes texts with a model given by its bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the same model on text that is normalised already
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.byte = np.array([p.type == 6 for p in proto.pieces])  # its surface in the library is empty, or at the last byte the character
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces])  # normalised bytes

    def runs(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """What the map makes of the bytes, and for each byte of that the byte it came from."""
        x = np.frombuffer(data, dtype=np.uint8)
        parts, came, at = [], [], 0
        for k in np.flatnonzero(self.map.firsts[x] & (x & 0xC0 != 0x80)).tolist() if self.map.units else ():
            if k < at:
                continue  # within a key
            n, piece = self.map.longest(data, k)
            if piece is None:
                continue
            parts += [x[at:k], np.frombuffer(piece, dtype=np.uint8)]
            same = piece == data[k : k + n]
            came += [np.arange(at, k), np.arange(k, k + n) if same else np.full(len(piece), k)]
            at = k + n
        return np.concatenate([*parts, x[at:]]), np.concatenate([*came, np.arange(at, len(x))])

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source it came from."""
        data = text.encode()
        body, came = self.runs(data)
        blank = np.frombuffer(BLANK.encode() if self.escape else b" ", dtype=np.uint8)
        if self.squeeze:  # of blanks in a row the first stays, but none at the head
            space = body == 32
            keep = ~(space & np.append(True, space[:-1])) if len(body) else space
            body, came = body[keep], came[keep]
        dummy = self.dummy and len(data) > 0 and (len(body) > 0 or not self.squeeze)
        if dummy:
            body, came = np.append(np.uint8(32), body), np.append(came[:1] if self.squeeze else 0, came)
        space = body == 32
        wide = np.where(space, len(blank), 1)
        out, came = np.repeat(body, wide), np.repeat(came, wide)
        first = (np.cumsum(wide) - wide)[space]
        for k, c in enumerate(blank):
            out[first + k] = c
        made = out.tobytes()
        while self.squeeze and made.endswith(blank.tobytes()):
            made = made[: -len(blank)]
        return made, np.append(came[: len(made)], len(data)).astype(np.int64)

    def encode(self, text: str) -> Spans:
        """Ids, byte spans and the decoded text. An empty text has no pieces. Should the pieces of a model not
        lie on the normalised text, each has the span of the whole text."""
        normal, came = self.normalise(text)
        found = self.whole.encode(text, num_threads=1)
        ids = np.array(found, dtype=np.int32)
        cut = np.append(0, np.cumsum(self.size[ids], dtype=np.int64))
        if cut[-1] != len(normal):  # unknown pieces have no length of their own
            pieces = self.bare.encode(normal.decode(), return_type="proto").pieces
            cut = np.append(0, np.cumsum([1 if self.byte[p.id] else len(p.surface.encode()) for p in pieces], dtype=np.int64))
        if cut[-1] != len(normal) or len(cut) != len(ids) + 1:
            return Spans(ids, np.zeros(len(ids), dtype=np.int64), np.full(len(ids), came[-1]), self.whole.decode(found))
        spot = came[cut]
        return Spans(ids, spot[:-1], spot[1:], self.whole.decode(found))


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ids, begin and end (bytes of the UTF-8 source, end exclusive) and the decoded text.

    Null text counts as empty; an empty text has no pieces and decodes to the empty text. Rows
    with equal or null ids each give a row. Other input columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder(model)
        for b in batches:
            got = [encoder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.ids for g in got], pa.list_(pa.int32())), pa.array([g.begin for g in got], pa.list_(pa.int64())), pa.array([g.end for g in got], pa.list_(pa.int64())), pa.array([g.decoded for g in got], pa.string())], names=["id", "ids", "begin", "end", "decoded"])

    return df.select(df[id_col], df[text_col]).mapInArrow(rows, f"`{id_col}` {kind}, ids array<int>, begin array<bigint>, end array<bigint>, decoded string")


def digest_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() with its arrays and texts digested where they are made: n_tokens, ids_sha256 (decimal ids joined
    by commas), decoded_sha256, n_bytes and spans_sha256 (little-endian 64-bit ends of the spans). Edge cases as there."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = OffsetEncoder(model), lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                got = encoder.encode(t or "")
                values = len(got.ids), sha(str(got.ids.tolist())[1:-1].replace(" ", "").encode()), sha(got.decoded.encode()), int(got.end[-1]) if len(got.end) else 0, sha(got.end.tobytes())
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_sha256"])

    return df.select(df[id_col], df[text_col]).mapInArrow(rows, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, spans_sha256 string")
