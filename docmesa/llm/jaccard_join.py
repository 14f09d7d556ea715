"""Exact Jaccard self-join over word shingles, with skipping by relations between sets.

Equal sets are one class. Classes find each other in index lists: the shingles of a set are dealt
by hash into one part more than two linked sets can differ in, so these have an equal part. A list
holds the sets with one part in common, each with its position: how many of its shingles are in parts before that one.
 * Index level: a list's members are in blocks by size and position. Of two sets that meet at positions p and q, with n and m
   shingles, at most min(p, q) + min(n - p, m - q) can be common; a block whose sizes and positions
   allow no link with another is skipped whole, and so are pairs that their own positions or bitmaps rule out.
 * Answer level: each list's members are first compared with its smallest member alone. What that tells of two of them is
   derived, not compared: with overlaps o and r with a set of h shingles, two sets have at least o + r - h in common, and at most
   r + (n - o). Sets that are linked by then share their answers: only pairs of different components are looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmesa.llm.common import materialise, partitions, tidy, unused
from docmesa.llm.components import components

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Members of a block of a list, and of a block of one that is split over tasks.
BLOCK, DEAL = 512, 4096
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in UTF-8; ASCII letters in lower case, words end at ASCII white space."""
    x = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    space = _SPACE[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        s = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(x)), out=s[1:])
        return mix((s[end] - s[begin]) * _power(_INVERSE, len(x) + 1)[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Ascending distinct hashes of the shingles; of a shorter text the whole as one; nothing without words."""
    h = word_hashes((text or "").encode("utf-8", "replace"))
    if not len(h):
        return h
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def digest(tokens: np.ndarray) -> str:
    """128 bits of a set, as text; the node of its class."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
        return f"{int(a):016x}{int(b):016x}"


class Scheme(NamedTuple):
    """How sets of a size class, and of the next larger one, are dealt into parts."""

    index: int
    parts: int
    spare: int  # equal parts that two linked sets have at least, less one


class Threshold(NamedTuple):
    """Jaccard of at least top / bottom."""

    top: int
    bottom: int

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.bottom * both >= self.top * (a + b - both)

    def differ(self, total: int) -> int:
        """In how many elements two linked sets with `total` elements together can differ."""
        need = -(-self.top * total // (self.top + self.bottom))
        return total - 2 * need

    def largest(self, size: int) -> int:
        return size * self.bottom // self.top

    def classes(self, most: int) -> list[int]:
        """Smallest sizes of the classes, up to the size `most`."""
        out = [1]
        while out[-1] <= most:
            out.append(self.largest(out[-1]) + 1)
        return out

    def scheme(self, index: int, smallest: int) -> Scheme:
        high = self.largest(smallest)
        total = high + self.largest(high)
        most = max(self.differ(t) for t in range(max(2, total - 2), total + 1))
        parts = most + 1
        if most:
            for _ in range(4):  # room for parts without elements
                parts = most + 1 + math.ceil(1.3 * parts * math.exp(-smallest / parts) + 0.5)
        return Scheme(index, parts, parts - most - 1)


class Schemes:
    """The schemes of sets by size, made as sizes come up."""

    def __init__(self, threshold: Threshold):
        self.threshold, self.edges, self.made = threshold, [1], {}

    def of(self, size: int) -> list[Scheme]:
        """Own class and the one below, without those where only equal sets link."""
        if self.edges[-1] <= size:
            self.edges = self.threshold.classes(size)
        c = int(np.searchsorted(self.edges, size, "right")) - 1
        out = []
        for i in (c, c - 1):
            if i >= 0 and (i == c or size <= self.threshold.largest(self.edges[i + 1] - 1)):
                if i not in self.made:
                    self.made[i] = self.threshold.scheme(i, self.edges[i])
                if self.made[i].parts > 1:
                    out.append(self.made[i])
        return out


def placed(tokens: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and positions: one for each part with elements, and for the empty ones where these may be all that is equal."""
    with np.errstate(over="ignore"):
        part = (mix(tokens + np.uint64(scheme.index)) % np.uint64(scheme.parts)).astype(np.int64)
        value = mix(tokens ^ np.uint64(0xA0761D6478BD642F))
        low = np.bincount(part, (value & np.uint64(0xFFFFFFFF)).astype(float), scheme.parts).astype(np.uint64)
        high = np.bincount(part, (value >> np.uint64(32)).astype(float), scheme.parts).astype(np.uint64)
        count = np.bincount(part, minlength=scheme.parts)
        out = mix(low + (high << np.uint64(32)) + mix(np.arange(scheme.parts, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(scheme.index + 1)))
    before = np.cumsum(count) - count
    keep = slice(None) if (count == 0).sum() > scheme.spare else count > 0
    return out[keep], before[keep]


def signatures(tokens: np.ndarray, scheme: Scheme) -> np.ndarray:
    return placed(tokens, scheme)[0]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each bit, packed; a power of two of at least 64 and twice the size."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    count = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8))


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmaps (rows) as they would be with `size` bytes. Bits are by the low bits of hashes, so halves lie on each other."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


# --- dataflow

def features(df: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n_shingles and node of rows with doc_id, text, row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.string())], names=["doc_id", "row", "n_shingles", "node"])

    return df.select("doc_id", "text", "row").mapInArrow(rows, "doc_id bigint, row bigint, n_shingles bigint, node string")


def _postings(words: int, threshold: Threshold, buckets: int):
    """Packed postings by bucket: 6 bytes of signature, 2 for the row of the block's table of nodes (16 bytes and
    8 of document id each), 4 of position. Of equal sets in a batch one gives postings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(threshold)
        for b in batches:
            nodes: dict[str, int] = {}
            found, owner, places, ids = [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = shingle_set(t, words)
                if not len(tokens) or (node := digest(tokens)) in nodes:
                    continue
                for scheme in schemes.of(len(tokens)):
                    s, before = placed(tokens, scheme)
                    found.append(s)
                    places.append(before.astype("<u4"))
                    owner.append(np.full(len(s), len(nodes), dtype=np.uint16))
                nodes[node] = len(nodes)
                ids.append((1 << 63) - 1 if doc is None else doc)
            if not found:
                continue
            sig, own, spot = np.concatenate(found), np.concatenate(owner), np.concatenate(places)
            table = np.concatenate([np.frombuffer(bytes.fromhex("".join(nodes)), dtype=np.uint8).reshape(-1, 16), np.array(ids, dtype=">i8").view(np.uint8).reshape(-1, 8)], axis=1)
            key = (sig & np.uint64(65535)).astype(np.int64) * buckets >> 16
            order = np.argsort(key, kind="stable")
            cut = np.searchsorted(key[order], np.arange(buckets + 1))
            there = np.flatnonzero(np.diff(cut))
            blocks, tables = [], []
            for i in there:
                part = order[cut[i] : cut[i + 1]]
                used, place = np.unique(own[part], return_inverse=True)
                block = np.concatenate([(sig[part] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], place.astype("<u2").view(np.uint8).reshape(-1, 2), spot[part].view(np.uint8).reshape(-1, 4)], axis=1)
                blocks.append(np.ascontiguousarray(block.T).tobytes())
                tables.append(table[used].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blocks, pa.binary()), pa.array(tables, pa.binary())], names=["bucket", "block", "nodes"])
            tidy()

    return rows


_LISTS = "list bigint, node string, hub string, position bigint"


def _lists(table: pa.Table) -> pa.Table:
    """Members of the lists with more than one node: (0, node, hub, 0) for each member beside the hub, which has the smallest document;
    lists of three and more also as (list, node, hub, position), under a number that depends on the members alone."""
    sigs, nodes, ids, spots = [], [], [], []
    for block, names in zip(table["block"].to_pylist(), table["nodes"].to_pylist(), strict=True):
        x = np.frombuffer(block, dtype=np.uint8).reshape(12, -1)
        sigs.append(np.concatenate([x[:6], np.zeros((2, x.shape[1]), dtype=np.uint8)]).T.copy().view("<u8").ravel())
        table_ = np.frombuffer(names, dtype=">u8").reshape(-1, 3)[x[6:8].T.copy().view("<u2").ravel()]
        spots.append(x[8:].T.copy().view("<u4").ravel())
        nodes.append(table_[:, :2])
        ids.append(table_[:, 2].astype(np.uint64).view(np.int64))
    sig, node, doc, spot = np.concatenate(sigs), np.concatenate(nodes).astype(np.uint64), np.concatenate(ids), np.concatenate(spots)
    # only signatures that come twice are sorted with their nodes
    order = np.argsort(sig, kind="stable")
    again = sig[order][1:] == sig[order][:-1]
    multi = np.zeros(len(sig), dtype=bool)
    multi[1:] |= again
    multi[:-1] |= again
    pick = order[multi]
    sig, node, doc, spot = sig[pick], node[pick], doc[pick], spot[pick]
    order = np.lexsort((doc, node[:, 1], node[:, 0], sig))
    sig, node, doc, spot = sig[order], node[order], doc[order], spot[order]
    fresh = np.ones(len(sig), dtype=bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]).any(axis=1)
    sig, node, doc, spot = sig[fresh], node[fresh], doc[fresh], spot[fresh]
    order = np.lexsort((doc, sig))
    sig, node, spot = sig[order], node[order], spot[order]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(sig)))
    of = np.cumsum(head) - 1
    text = [f"{a:016x}{b:016x}" for a, b in node.tolist()]
    members = np.flatnonzero(~head)
    pairs = {(text[start[of[i]]], text[i]) for i in members.tolist()}
    with np.errstate(over="ignore"):
        number = np.add.reduceat(mix(node[:, 0] ^ mix(node[:, 1])), start) if len(start) else np.zeros(0, dtype=np.uint64)
    number = (number >> np.uint64(1)).astype(np.int64) | 1
    larger, seen = [], set()
    for k in np.flatnonzero(size > 2).tolist():
        if (n := int(number[k])) not in seen:
            seen.add(n)
            larger += [(n, text[i], text[start[k]], int(spot[i])) for i in range(start[k], start[k] + size[k])]
    columns = list(zip(*([(0, b, a, 0) for a, b in pairs] + larger), strict=True)) or [[], [], [], []]
    tidy()
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["list", "node", "hub", "position"])


def _bits_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), b.column(1)], names=["node", "n", "bits", "text"])

    return rows


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places bitmaps differ: at most as many as their sets do."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _possible(threshold: Threshold):
    """Pairs (a, b) with the most that they can have in common by sizes and bitmaps, and whether that suffices."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most, ok = [], []
            for n, m, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                p, q = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
                size = min(len(p), len(q))
                most.append(min(n, m, (n + m - int(apart(fold(p, size), fold(q, size)))) // 2))
                ok.append(threshold.linked(most[-1], n, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(most, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "both", "open"])

    return rows


def _verified(words: int, threshold: Threshold):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for b in batches:
            both, linked = [], []
            for hub, x, y in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if hub != last:
                    last, last_set = hub, shingle_set(x, words)
                other = shingle_set(y, words)
                at = np.minimum(np.searchsorted(last_set, other), len(last_set) - 1)
                both.append(int((last_set[at] == other).sum()))
                linked.append(threshold.linked(both[-1], len(last_set), len(other)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])

    return rows


def verify(pairs: DataFrame, texts: DataFrame, words: int, threshold: Threshold) -> DataFrame:
    """Of the pairs (a, b): both, linked, exact. Where sizes and bitmaps rule a link out, both is the most that they leave and not exact. texts: node, n, bits, text."""
    side = lambda x, *c: texts.select(F.col("node").alias(x), *[F.col(k).alias(f"{x}_{k}") for k in c])
    small = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
    seen = materialise(small.mapInArrow(_possible(threshold), "a string, b string, both bigint, open boolean"), "seen")
    full = seen.filter("open").select("a", "b").join(side("b", "text"), "b").join(side("a", "text"), "a").select("a", "b", "a_text", "b_text")
    compared = full.mapInArrow(_verified(words, threshold), "a string, b string, both bigint, linked boolean").withColumn("exact", F.lit(True))
    return compared.unionByName(seen.filter("not open").select("a", "b", "both", F.lit(False).alias("linked"), F.lit(False).alias("exact")))


class Members(NamedTuple):
    """Of a block of a list: sizes, positions, components, bitmaps; overlap with the list's first set, at most and at least; that set's size."""

    n: np.ndarray
    position: np.ndarray
    root: np.ndarray
    bits: list[bytes]
    most: np.ndarray
    least: np.ndarray
    hub: int

    def ordered(self) -> tuple[np.ndarray, Members]:
        order = np.lexsort((self.position, self.n))
        return order, Members(*(v[order] for v in self[:3]), [self.bits[k] for k in order], self.most[order], self.least[order], self.hub)

    def part(self, a: int, b: int) -> Members:
        return Members(*(v[a:b] for v in self[:6]), self.hub)


def compare(left: Members, right: Members, same: bool, threshold: Threshold, counts: Counter) -> Iterator[tuple[int, int, bool]]:
    """(i, j, sure) of pairs of different components, one from each side, that may be linked, or are for sure by what is known of them and the first set.
    same: left and right are one. counts: what was skipped and derived."""
    p, left = left.ordered()
    q, right = (p, left) if same else right.ordered()
    total = lambda n, m: -(-threshold.top * (n + m) // (threshold.top + threshold.bottom))  # noqa: E731  what linked sets have in common at least
    for i in range(0, len(p), BLOCK):
        a = left.part(i, i + BLOCK)
        for j in range(i if same else 0, len(q), BLOCK):
            b = right.part(j, j + BLOCK)
            if b.n[0] > threshold.largest(int(a.n[-1])) or a.n[0] > threshold.largest(int(b.n[-1])):
                counts["blocks of other sizes"] += 1
                continue
            if min(a.position.max(), b.position.max()) + min((a.n - a.position).max(), (b.n - b.position).max()) < total(a.n[0], b.n[0]):
                counts["blocks at other positions"] += 1
                continue
            n, m = a.n[:, None], b.n[None, :]
            need = total(n, m)
            near = (m * threshold.top <= n * threshold.bottom) & (n * threshold.top <= m * threshold.bottom) & (a.root[:, None] != b.root[None, :])
            if same and i == j:
                near &= np.triu(np.ones(near.shape, dtype=bool), 1)
            met = np.minimum(a.position[:, None], b.position[None, :]) + np.minimum((a.n - a.position)[:, None], (b.n - b.position)[None, :])
            counts["pairs at other positions"] += int((near & (met < need)).sum())
            near &= met >= need
            top = np.minimum(b.most[None, :] + (a.n - a.least)[:, None], a.most[:, None] + (b.n - b.least)[None, :])
            counts["answers derived"] += int((near & (top < need)).sum())
            near &= top >= need
            sure = a.least[:, None] + b.least[None, :] - a.hub >= need
            u, v = np.nonzero(near)
            if not len(u):
                continue
            size = min(map(len, (a.bits[0], b.bits[0])))  # sizes ascend
            x = np.stack([fold(np.frombuffer(k, dtype=np.uint8), size) for k in a.bits])
            y = np.stack([fold(np.frombuffer(k, dtype=np.uint8), size) for k in b.bits])
            for s in range(0, len(u), 1 << 16):
                g, h = u[s : s + (1 << 16)], v[s : s + (1 << 16)]
                known = sure[g, h]
                ok = known | (apart(x[g], y[h]) <= a.n[g] + b.n[h] - 2 * need[g, h])
                counts["links derived"] += int(known.sum())
                yield from zip(p[i + g[ok]].tolist(), q[j + h[ok]].tolist(), known[ok].tolist(), strict=True)


_MEMBERS = ["list", "i", "j", "side", "node", "root", "n", "bits", "position", "most", "least", "hub_n"]


def _cross(threshold: Threshold):
    """Pairs from different components of the blocks of lists that are dealt to a bucket."""

    def group(table: pa.Table) -> pa.Table:
        key = np.stack([table[c].to_numpy() for c in ("list", "i", "j")])
        order = np.lexsort(key[::-1])
        node, root = np.array(table["node"].to_pylist(), dtype=object), np.unique(table["root"].to_pylist(), return_inverse=True)[1]
        n, position, most, least, hub, side = (table[c].to_numpy() for c in ("n", "position", "most", "least", "hub_n", "side"))
        bits = table["bits"].to_pylist()
        out: dict[tuple[str, str], bool] = {}
        for part in np.split(order, np.flatnonzero((np.diff(key[:, order]) != 0).any(axis=0)) + 1):
            of = lambda rows: Members(n[rows], position[rows], root[rows], [bits[k] for k in rows], most[rows], least[rows], int(hub[rows[0]]))  # noqa: B023, E731
            left, right = part[side[part] != 1], part[side[part] == 1]
            same = bool((side[part] == 2).all())
            if not len(left) or not (same or len(right)):
                continue
            for i, j, sure in compare(of(left), of(left if same else right), same, threshold, Counter()):
                a, b = node[left[i]], node[(left if same else right)[j]]
                pair = (min(a, b), max(a, b))
                out[pair] = out.get(pair, False) or sure
        tidy()
        return pa.table({"a": pa.array([x for x, _ in out], pa.string()), "b": pa.array([y for _, y in out], pa.string()), "sure": pa.array(list(out.values()), pa.bool_())})

    return group


def linked_classes(df: DataFrame, words: int, threshold: Threshold, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Features of all rows (doc_id, n_shingles, node), and node, root of the classes with links."""
    spark = df.sparkSession
    n = partitions(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))  # rows that share it are the same
    every = materialise(features(rows, words), "features")
    blocks = rows.select("doc_id", "text").mapInArrow(_postings(words, threshold, n), "bucket int, block binary, nodes binary")
    found = materialise(blocks.groupBy("bucket").applyInArrow(_lists, _LISTS), "lists")
    pairs = materialise(found.filter("list = 0").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # one row of each class that has a partner gives its text
    chosen = every.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    own = rows.join(chosen, "row").select("node", "text").mapInArrow(_own_text(words), "node string, text string").dropDuplicates(["node"])
    texts = materialise(own.mapInArrow(_bits_rows(words), "node string, n bigint, bits binary, text string"), "texts")
    known = materialise(verify(pairs, texts, words, threshold), "known")
    first = known.filter("linked").select("a", "b")
    labels = components(first)
    lists = found.filter("list != 0").distinct().join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lists = materialise(lists, "members")
    open_ = lists.groupBy("list").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("members")).filter("p != q").select("list", "members")
    members = lists.join(open_, "list").join(texts.select("node", "n", "bits"), "node").join(texts.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")
    members = members.join(known.select(F.col("a").alias("hub"), F.col("b").alias("node"), "both", "exact"), ["hub", "node"], "left")
    own = F.col("node") == F.col("hub")
    members = members.withColumn("most", F.when(own, F.col("n")).otherwise(F.coalesce("both", F.col("n")))).withColumn("least", F.when(own, F.col("n")).when(F.col("exact"), F.col("both")).otherwise(0))
    # lists longer than a deal are split into blocks, and pairs of blocks are dealt to tasks of their own
    blocks = F.ceil(F.col("members") / DEAL).cast("int")
    split = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt = split.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": side}).select(*_MEMBERS).withColumn("bucket", F.pmod(F.xxhash64("list", "i", "j"), F.lit(4 * n)))
    cross = dealt.groupBy("bucket").applyInArrow(_cross(threshold), "a string, b string, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))
    cross = materialise(cross.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross")
    second = verify(cross.filter("not sure").select("a", "b"), texts, words, threshold).filter("linked").select("a", "b")
    return every, components(first.unionByName(second).unionByName(cross.filter("sure").select("a", "b")))


def _own_text(words: int):
    """Rows whose text is of the node they stand for: rows with equal ids may have other texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [digest(s) == node if len(s := shingle_set(t, words)) else False for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows


def jaccard_components(df: DataFrame, words: int = 5, top: int = 8, bottom: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (the smallest id reachable over links of Jaccard top / bottom or more).

    Null text counts as empty; sets without elements link with nothing, and such a row is its own
    component. Rows with equal ids are judged by their own texts. Rows with a null id take part
    and give null as component where no linked row has an id. Other columns are left out.
    """
    every, labels = linked_classes(df, words, Threshold(top, bottom), id_col, text_col)
    classes = every.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return every.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, words: int = 5, top: int = 8, bottom: int = 10) -> DataFrame:
    """The rows of df, with all their columns, less those whose component has a row with a smaller doc_id.

    Rows without words stay. Of rows of a component with equal ids the one whose text hashes lowest stays, a null id
    counts as the greatest, and rows with equal id and text are one.
    """
    every, labels = linked_classes(df, words, Threshold(top, bottom), "doc_id", "text")
    rooted = every.filter("node is not null").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    (row,) = unused(df, "row")
    kept = rooted.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.row").alias(row))
    gone = rooted.select(F.col("row").alias(row)).distinct().join(kept, row, "left_anti")
    return df.withColumn(row, F.xxhash64(F.col("doc_id").cast("bigint"), "text")).join(gone, row, "left_anti").dropDuplicates([row]).drop(row)
