"""Removing repeated passages with a logarithmic family of suffix arrays.

A suffix array here holds suffixes cut to `length` bytes in lexicographic order, each once, with
the smallest document it begins in. New batches of documents, in ascending order, get a suffix
array of their own, which is merge-scanned against the arrays of the existing levels for matches
of the whole length; levels of the same size are merged, so n batches keep log n arrays.

Arrays over every byte of a corpus would be several times its size. So a sieve goes first, which
loses nothing: of the k-grams in a window of `length` bytes, the one with the least hash is the
window's anchor, so equal windows have equal anchors at equal places. Consecutive windows with
one anchor form a segment. Only hashes of anchors and segments are shuffled.
 * An anchor in one document only: its windows are in no other document.
 * A segment that is, as a whole, in a smaller document: all its windows are.
 * What is left, segments that share their anchor, and half of a window's other bytes on one side of it, with
   a different segment of another document, has its text sent to the family of arrays for its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.llm.common import materialise, partitions, release, tidy, unused

#: Bytes of an anchor, at least; bytes hashed at once; bytes kept of an anchor's hash beside its bucket's two, and of a segment's
#: (128 bits in all decide that segments are equal); hash bases.
GRAM, SLICE, ANCHOR, SEGMENT = 16, 1 << 20, 6, 8
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Suffixes in a batch of the index family.
BATCH = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(1, n), dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * (out[have - 1] * base)
        have += step
    return out


_tables: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    if int(base) not in _tables or len(_tables[int(base)]) < n:
        _tables[int(base)] = _powers(base, 1 << max(16, int(n).bit_length()))
    return _tables[int(base)][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Segments(NamedTuple):
    """start: first window; windows: how many; anchor: its place behind start; two hashes."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor_hash: np.ndarray
    segment_hash: np.ndarray
    left: np.ndarray  # 16 bits of the anchor with what is on its left, 0 where the segment has not enough of it
    right: np.ndarray


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Segments:
    """Segments of the documents data[offsets[i]:offsets[i + 1]]; starts count from the document's first byte."""
    n, k = len(data), min(length, max(GRAM, length - 200))
    w = length - k + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return Segments(none, none, none, *(none.astype(np.uint64) for _ in range(4)))
    with np.errstate(over="ignore"):
        x = data.astype(np.uint64) + np.uint64(1)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(x * _power_table(_BASE, n), out=s[1:])
        gram = (s[k:] - s[:-k]) * _power_table(_inverse(int(_BASE)), n - k + 1)
        gram = _mix(gram)
        least = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        have = 1
        while have < w:  # least over w neighbours, by doubling
            step = min(have, w - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        least = (least & _LOW).astype(np.int64)  # one for each window of the batch
        doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
        inside = np.arange(n - length + 1) + length <= offsets[1:][doc_of]
        new = np.empty(len(least), dtype=bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (doc_of[1:] != doc_of[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(least))
        keep = inside[first]
        first, last = first[keep], last[keep]
        at = least[first]
        t = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(x * _power_table(_BASE2, n), out=t[1:])
        whole = (t[last + length - 1] - t[first]) * _power_table(_inverse(int(_BASE2)), n)[first]
        whole = _mix(whole + _mix((at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
        # a window holds its anchor and, on one side of it at least, half of the rest
        half = -(-(length - k) // 2)
        inverse = _power_table(_inverse(int(_BASE)), n)

        def side(begin: np.ndarray, inside: np.ndarray) -> np.ndarray:
            begin = np.where(inside, begin, 0)
            h = _mix((s[begin + k + half] - s[begin]) * inverse[begin]) >> np.uint64(48)
            return np.where(inside, np.maximum(h, np.uint64(1)), np.uint64(0))

        left = side(at - half, at - half >= first) if n >= k + half else np.zeros(len(at), dtype=np.uint64)
        right = side(at, at + k + half <= last - 1 + length) if n >= k + half else left
        return Segments(doc_of[first], first - offsets[:-1][doc_of[first]], last - first, gram[at], whole, left, right)


class Level(NamedTuple):
    keys: np.ndarray  # S<length>, ascending, each once
    docs: np.ndarray  # the smallest document of each


class SuffixLevels:
    """The index family. Batches must come in ascending order of document; a document may go on in the next batch."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """keys: suffixes of a batch, cut to S<length>. Returns which of them also begin in a smaller document."""
        order = np.argsort(keys, kind="stable")  # docs ascend, so the first of equals has the smallest
        sorted_keys, sorted_docs = keys[order], docs[order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
        head = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        own = Level(sorted_keys[head], np.minimum.reduceat(sorted_docs, head) if len(head) else sorted_docs)
        smallest = own.docs.copy()
        for level in self.levels:
            same, at = merge_scan(level.keys, own.keys)[1:]
            smallest[same] = np.minimum(smallest[same], level.docs[at])
        found = np.zeros(len(keys), dtype=bool)
        found[order] = smallest[run] < sorted_docs
        if len(head):
            self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-1].keys) * 2 > len(self.levels[-2].keys):
            self.merge()
        return found

    def merge(self) -> None:
        """One ascending array of the two youngest: what the older has not goes in at its place."""
        b, a = self.levels.pop(), self.levels.pop()
        place, same, at = merge_scan(a.keys, b.keys)
        docs = a.docs.copy()
        docs[at] = np.minimum(docs[at], b.docs[same])
        self.levels.append(Level(np.insert(a.keys, place[~same], b.keys[~same]), np.insert(docs, place[~same], b.docs[~same])))


def merge_scan(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two ascending arrays side by side: where each of the new stands among the old, which of the new are there, and where these are."""
    place = np.searchsorted(old, new)
    same = np.zeros(len(new), dtype=bool)
    inside = place < len(old)
    same[inside] = old[place[inside]] == new[inside]
    return place, same, place[same]


def suffix_keys(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` bytes from each start, as one array of S<length>; an equal length makes ending zeros harmless."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    return np.ascontiguousarray(view[starts]).view(f"S{length}").ravel()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return body, offsets - offsets[0]


def _packed(key: np.ndarray, n: int, columns: dict[str, np.ndarray], name: str) -> pa.RecordBatch:
    """One row for each key below n that occurs: the key and, for each column, its values as bytes."""
    order = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[order], np.arange(n + 1))
    there = np.flatnonzero(np.diff(cut))
    out = [pa.array(there, pa.int32())]
    for v in columns.values():
        v = np.ascontiguousarray(v[order])
        out.append(pa.array([v[cut[i] : cut[i + 1]].tobytes() for i in there], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=[name, *columns])


def _slices(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first document, bytes skipped of it): documents together up to SLICE bytes, longer ones in
    overlapping slices. A segment that a slice cuts looks different from its copies, so the arrays compare it."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        size = int(offsets[j] - offsets[i])
        for skip in range(0, max(1, size - length + 1), SLICE) if size > SLICE else (0,):
            end = min(size, skip + SLICE + length - 1) if size > SLICE else size
            part = offsets[i : j + 1] - offsets[i] if size <= SLICE else np.array([0, end - skip])
            yield data[offsets[i] + skip : offsets[i] + end], part, i, skip
        i = j


def _sieve_rows(length: int, buckets: int):
    """buckets: up to 65536."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _bytes_of(b.column(2))
            found = []  # of each slice only what is sent: bucket, document and the block's bytes
            for part, cut, first, skip in _slices(data, offsets, length):
                s = segments(part, cut, length)
                # the low bits choose the bucket; the block has others
                key = ((s.anchor_hash & np.uint64(65535)).astype(np.int64) * buckets >> 16).astype(np.uint16)
                columns = (s.anchor_hash >> np.uint64(16), ANCHOR), (s.segment_hash, SEGMENT), (s.left, 2), (s.right, 2), (s.start + skip, 4), (s.windows, 1), (s.doc + first, 2)
                block = np.empty((len(key), sum(n for _, n in columns)), dtype=np.uint8)
                at = 0
                for v, n in columns:
                    block[:, at : at + n] = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]
                    at += n
                found.append((key, block))
            key = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.uint16)
            if len(key):
                block = np.concatenate([f[1] for f in found])
                del found
                doc = np.ascontiguousarray(block[:, -2:]).view("<u2").ravel()
                yield _table_rows(key, buckets, block, doc, b.column(0).to_numpy(), b.column(1).to_numpy())
                del key, block, doc
            tidy()

    return rows


def _table_rows(key, n, block, doc, ids, rows_) -> pa.RecordBatch:
    """Blocks by key; the batch's table of documents goes along, only those that occur under the key."""
    order = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[order], np.arange(n + 1))
    there = np.flatnonzero(np.diff(cut))
    blocks, tables = [], []
    for i in there:
        part = order[cut[i] : cut[i + 1]]
        used, place = np.unique(doc[part], return_inverse=True)
        mine = block[part].copy()
        mine[:, -2:] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
        blocks.append(np.ascontiguousarray(mine.T).tobytes())
        tables.append(np.stack([ids[used], rows_[used]]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blocks, pa.binary()), pa.array(tables, pa.binary())], names=["bucket", "block", "docs"])


def _read_blocks(table: pa.Table) -> list[np.ndarray]:
    """Anchor, segment, left, right, start, windows, doc_id, row key of all blocks, each in its own narrow kind."""
    sizes = (ANCHOR, SEGMENT, 2, 2, 4, 1, 2)
    kinds = ["<u8", "<u8", "<u2", "<u2", "<u4", "u1", "<i8", "<i8"]
    blocks, tables = table["block"], table["docs"]
    counts = [len(x.as_buffer()) // sum(sizes) for x in blocks]
    out = [np.empty(sum(counts), dtype=k) for k in kinds]
    to = 0
    for block, docs, n in zip(blocks, tables, counts, strict=True):
        x = np.frombuffer(block.as_buffer(), dtype=np.uint8).reshape(sum(sizes), -1)
        ids, rows_ = np.frombuffer(docs.as_buffer(), dtype=np.int64).reshape(2, -1)
        at = 0
        for size, o in zip(sizes[:-1], out, strict=False):
            wide = np.zeros((n, o.dtype.itemsize), dtype=np.uint8)
            wide[:, :size] = x[at : at + size].T
            o[to : to + n] = wide.view(o.dtype).ravel()
            at += size
        place = np.ascontiguousarray(x[at : at + 2].T).view("<u2").ravel()
        out[6][to : to + n], out[7][to : to + n] = ids[place], rows_[place]
        to += n
    return out


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


_MARKS = "target int, open boolean, row binary, start binary, windows binary, anchor binary"


def _sieve_group(buckets: int):
    """Marks: segments whose windows are all in a smaller document (anchor 0), and segments that the arrays must look at."""

    def group(table: pa.Table) -> pa.Table:
        columns = _read_blocks(table)
        del table
        order = np.lexsort((columns[6], columns[1], columns[0]))
        for k in range(len(columns)):  # one after the other, so that only one is there twice
            columns[k] = columns[k][order]
        anchor, segment, left, right, start, windows, doc, row = columns
        del order
        fresh = _heads(anchor, segment)
        head, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        smallest = doc[head]  # of the segment
        whole = doc > smallest[run]
        # different segments with the anchor and a side of it in common, in documents that differ
        open_ = np.zeros(len(head), dtype=bool)
        for side in (left[head], right[head]):
            order = np.lexsort((side, anchor[head]))
            new = _heads(anchor[head][order], side[order])
            at, of = np.flatnonzero(new), np.cumsum(new) - 1
            if len(at):
                differ = np.minimum.reduceat(smallest[order], at) < np.maximum.reduceat(smallest[order], at)
                open_[order] |= differ[of] & (side[order] > 0)
        ask = ~whole & open_[run]
        made = []
        for flag, pick in ((False, np.flatnonzero(whole)), (True, np.flatnonzero(ask))):
            made.append(_marks(row[pick], start[pick], windows[pick], anchor[pick], flag, buckets))
        tidy()
        return pa.concat_tables(made)

    return group


def _marks(row, start, windows, anchor, flag: bool, buckets: int) -> pa.Table:
    packed = _packed(row % buckets, buckets, {"row": row, "start": start.astype("<u4"), "windows": windows.astype("<u4"), "anchor": anchor.astype("<u4")}, "target")
    return pa.Table.from_batches([packed]).add_column(1, "open", pa.array([flag] * packed.num_rows, pa.bool_()))


def _read_marks(table: pa.Table):
    """Row keys in ascending order with the start, windows and anchor of each mark."""
    kinds = (("row", "<i8"), ("start", "<u4"), ("windows", "<u4"), ("anchor", "<u4"))
    columns = [np.concatenate([np.frombuffer(x, dtype=k) for x in table[c].to_pylist()] or [np.zeros(0, dtype=k)]) for c, k in kinds]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _text_rows(buckets: int):
    """Documents by bucket, those of a batch in one compressed block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).to_pylist()
            target = keys % buckets
            order = np.argsort(target, kind="stable")
            cut = np.searchsorted(target[order], np.arange(buckets + 1))
            there = np.flatnonzero(np.diff(cut))
            heads, blobs = [], []
            for i in there:
                part = order[cut[i] : cut[i + 1]]
                mine = [texts[k] for k in part]
                heads.append(np.stack([ids[part], keys[part], np.array([len(t) for t in mine], dtype=np.int64)]).tobytes())
                blobs.append(pack.compress(b"".join(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(heads, pa.binary()), pa.array(blobs, pa.binary())], names=["target", "head", "blob"])

    return rows


def _read_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    heads, texts = [np.zeros((3, 0), dtype=np.int64)], []
    for head, blob in zip(table["head"].to_pylist(), table["blob"].to_pylist(), strict=True):
        heads.append(np.frombuffer(head, dtype=np.int64).reshape(3, -1))
        data, at = unpack.decompress(blob), 0
        for n in heads[-1][2].tolist():
            texts.append(data[at : at + n])
            at += n
    ids, keys, _ = np.concatenate(heads, axis=1)
    return ids, keys, texts


def _cut(data: bytes, covered: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What stays when the windows at `covered` go, bytes removed, runs removed."""
    if len(covered) == 0:
        return data, 0, 0
    covered = np.unique(covered)
    ends = covered + length
    breaks = np.flatnonzero(covered[1:] > ends[:-1])
    begin, end = covered[np.append(0, breaks + 1)], ends[np.append(breaks, len(covered) - 1)]
    kept = b"".join(data[a:b] for a, b in zip(np.append(0, end), np.append(begin, len(data)), strict=True))
    return kept, len(data) - len(kept), len(begin)


def _windows(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """All starts of runs of windows."""
    windows = windows.astype(np.int64)
    return np.repeat(start.astype(np.int64) - np.append(0, np.cumsum(windows)[:-1]), windows) + np.arange(int(windows.sum()))


def _settle(data: bytes, covered: np.ndarray, length: int, give: str) -> tuple[bytes, tuple[int, int, int]]:
    kept, removed, spans = _cut(data, covered, length)
    if give == "sha256":
        kept = hashlib.sha256(kept).digest()
    elif give == "text":
        kept = kept.decode("utf-8", "ignore").encode()  # a cut may lie within a character
    return kept, (len(data), removed, spans)


_PARTS = "target int, n bigint, parts binary"


def _open_group(length: int, buckets: int):
    """The text of the open segments, for the bucket of their anchor."""

    def group(packed: pa.Table, marks: pa.Table) -> pa.Table:
        row, start, windows, anchor = _read_marks(marks)
        ids, keys, texts = _read_texts(packed)
        low, high = np.searchsorted(row, keys, "left"), np.searchsorted(row, keys, "right")
        sent: dict[int, list[tuple]] = {}
        for i in np.flatnonzero(high > low).tolist():
            a, b, doc, key, data = low[i], high[i], int(ids[i]), int(keys[i]), texts[i]
            for x, n, g in zip(start[a:b].tolist(), windows[a:b].tolist(), anchor[a:b].tolist(), strict=True):
                sent.setdefault(g % buckets, []).append((doc, key, x, n, data[x : x + n + length - 1]))
        heads = [np.array([p[:4] for p in parts], dtype=np.int64).tobytes() + b"".join([p[4] for p in parts]) for parts in sent.values()]
        return pa.table({"target": pa.array(list(sent), pa.int32()), "n": pa.array([len(p) for p in sent.values()], pa.int64()), "parts": pa.array(heads, pa.binary())})

    return group


def _array_group(length: int, buckets: int):
    """The index family of one bucket: marks for the windows of open segments that begin in a smaller document."""

    def group(table: pa.Table) -> pa.Table:
        heads, bodies = [], []
        for n, blob in zip(table["n"].to_pylist(), table["parts"].to_pylist(), strict=True):
            heads.append(np.frombuffer(blob[: 32 * n], dtype=np.int64).reshape(-1, 4))
            bodies.append(np.frombuffer(blob[32 * n :], dtype=np.uint8))
        head, data = np.concatenate(heads), np.concatenate(bodies)
        size = head[:, 3] + length - 1
        begin = np.append(0, np.cumsum(size)[:-1])
        order = np.argsort(head[:, 0], kind="stable")
        head, begin = head[order], begin[order]
        edge = np.append(0, np.cumsum(head[:, 3]))
        levels, rows_, starts = SuffixLevels(length), [], []
        at = 0
        while at < len(head):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + BATCH, "right")) - 1)
            part = head[at:to]
            places = _windows(begin[at:to], part[:, 3])
            found = levels.add(suffix_keys(data, places, length), np.repeat(part[:, 0], part[:, 3]))
            rows_.append(np.repeat(part[:, 1], part[:, 3])[found])
            starts.append(_windows(part[:, 2], part[:, 3])[found])
            at = to
        row, start = np.concatenate(rows_), np.concatenate(starts)
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        del levels, data, bodies
        tidy()
        return _marks(row[first], start[first], np.diff(np.append(first, len(row))), np.zeros(len(first)), False, buckets)

    return group


_KEPT = "id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, row bigint"


def _cut_group(length: int, give: str):
    """Documents without the bytes that their marks cover."""

    def group(packed: pa.Table, marks: pa.Table) -> pa.Table:
        row, start, windows, _ = _read_marks(marks)
        ids, keys, texts = _read_texts(packed)
        low, high = np.searchsorted(row, keys, "left"), np.searchsorted(row, keys, "right")
        kept, sizes = [], []
        for data, a, b in zip(texts, low.tolist(), high.tolist(), strict=True):
            k, size = _settle(data, _windows(start[a:b], windows[a:b]) if b > a else start[:0], length, give)
            kept.append(k)
            sizes.append(size)
        counts = np.array(sizes, dtype=np.int64).reshape(-1, 3)
        del texts
        tidy()
        return pa.table({"id": pa.array(ids), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(counts[:, 0]), "n_removed": pa.array(counts[:, 1]), "n_spans": pa.array(counts[:, 2]), "row": pa.array(keys)})

    return group


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", give: str = "bytes") -> DataFrame:
    """One row per input row: the id, kept (binary, the bytes that stay, or their SHA-256, or without characters cut
    in two, as `give` says: bytes, sha256 or text), n_bytes, n_removed, n_spans, row (a hash of id and text).

    A byte goes if it lies in a string of `length` bytes that also begins in a row with a smaller id;
    strings are judged on the input. Null text counts as empty. Rows with equal ids do not match each other.
    Rows with a null id come before all others: they lose nothing, and the others lose what those
    hold. Texts shorter than `length` stay whole; an empty table gives no rows; other columns are left out.
    """
    spark: SparkSession = df.sparkSession
    n = partitions(spark)
    least = -(1 << 63)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(least)).alias("id"), text.alias("text"))
    base = base.select("id", F.xxhash64("id", "text").alias("row"), "text")
    blocks = base.mapInArrow(_sieve_rows(length, n), "bucket int, block binary, docs binary")
    marks = materialise(blocks.groupBy("bucket").applyInArrow(_sieve_group(n), _MARKS), "marks")
    del blocks
    release(spark)
    texts = base.mapInArrow(_text_rows(n), "target int, head binary, blob binary")
    parts = materialise(texts.groupBy("target").cogroup(marks.filter("open").groupBy("target")).applyInArrow(_open_group(length, n), _PARTS), "segments")
    release(spark)
    hits = materialise(parts.groupBy("target").applyInArrow(_array_group(length, n), _MARKS), "marks")
    release(spark)
    every = texts.groupBy("target").cogroup(marks.filter("not open").unionByName(hits).groupBy("target")).applyInArrow(_cut_group(length, give), _KEPT)
    return every.select(F.nullif(F.col("id"), F.lit(least)).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans", "row")


def repeat_digests(df: DataFrame, length: int = 50) -> DataFrame:
    """remove_repeats() with kept_sha256 (lowercase hex) for the bytes that stay."""
    out = remove_repeats(df, length, give="sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def without_repeats(df: DataFrame, length: int = 50) -> DataFrame:
    """df with the texts that remove_repeats() leaves and n_chars to match; other columns, and null texts, are as they were."""
    least = F.lit(-(1 << 63))
    row, stays = unused(df, "row", "stays")
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = df.withColumn(row, F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), least), text))
    kept = remove_repeats(df, length, give="text").select(F.col("row").alias(row), F.col("kept").cast("string").alias(stays)).dropDuplicates([row])
    joined = keyed.withColumn("text", F.when(F.col("text").isNotNull(), F.lit(""))).join(kept, row)
    changed = joined.withColumn("text", F.when(F.col("text").isNotNull(), F.col(stays)))
    if "n_chars" in df.columns:
        changed = changed.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    return changed.select(*df.columns)
