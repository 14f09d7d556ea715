"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Trees are flattened into arrays of split feature, threshold, children and value, and all rows
of a batch walk down together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmesa.llm.common import map_texts

#: Labelled rows that a model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 80, 4, 64, 0.15, 1.0, 1.0

_SYMBOLS = b"#$%&*|<>{}[]=~^\\/_@+"
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "stop": b".", "comma": b",", "shout": b"!", "ask": b"?", "symbol": _SYMBOLS, "pipe": b"|", "other": bytes(range(128, 256))}
_MASK = np.array([[c in v for c in range(256)] for v in _CLASSES.values()], dtype=float).T
NAMES = ["log_bytes", *_CLASSES, "entropy", "log_words", "word_length", "word_spread", "unique_words", "top_word", "next_same", "unique_pairs", "capital_words", "shouted_words", "alpha_words", "log_lines", "line_length", "unique_lines", "open_ends", "shortest_words"]


def statistics(text: str) -> np.ndarray:
    """The features of a text; all 0 for an empty one."""
    out = np.zeros(len(NAMES))
    data = text.encode("utf-8", "replace")
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    most = Counter(words).most_common(1)[0][1] if words else 0
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    out[0] = np.log1p(len(data))
    out[1 : 1 + len(_CLASSES)] = counts @ _MASK / len(data)
    out[1 + len(_CLASSES) :] = [
        -(p * np.log2(p)).sum(), np.log1p(len(words)), lengths.mean(), lengths.std(), len(set(words)) / n, most / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, len(pairs)), sum(map(str.istitle, words)) / n, sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n, np.log1p(len(lines)), len(text) / k, len(set(lines)) / k,
        sum(x.rstrip()[-1] not in ".!?:;\"'" for x in lines) / k, (lengths <= 2).mean(),
    ]
    return out


class Trees(NamedTuple):
    """Nodes of all trees in one row of arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            score += self.value[node]
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts logistic loss on binned features. With one label only, or no rows, the trees are empty and the base tells the label."""
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if len(np.unique(y)) > 1:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        score = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            first = len(parts["value"])
            roots.append(first)
            at = np.full(len(y), first)
            _leaf(parts, g.sum(), h.sum())
            level = [first]
            for _ in range(DEPTH):
                slot = {node: i for i, node in enumerate(level)}
                inside = np.isin(at, level)
                rows = np.flatnonzero(inside)
                place = np.array([slot[a] for a in at[rows]], dtype=np.int64)
                gs = np.stack([np.bincount(place * BINS + b[rows], g[rows], len(level) * BINS).reshape(-1, BINS) for b in binned])
                hs = np.stack([np.bincount(place * BINS + b[rows], h[rows], len(level) * BINS).reshape(-1, BINS) for b in binned])
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
                gain[(hl < LEAST) | (ht - hl < LEAST)] = -1
                fresh = []
                for node, i in slot.items():
                    f, b = np.unravel_index(np.argmax(gain[:, i]), gain[:, i].shape)
                    if gain[f, i, b] <= 1e-6 or b >= len(cuts[f]):
                        continue
                    parts["feature"][node], parts["threshold"][node] = int(f), float(cuts[f][b])
                    mine = at == node
                    low = mine & (binned[f] <= b)
                    for side, part in (("left", low), ("right", mine & ~low)):
                        parts[side][node] = len(parts["value"])
                        at[part] = len(parts["value"])
                        fresh.append(len(parts["value"]))
                        _leaf(parts, g[part].sum(), h[part].sum())
                level = fresh
                if not level:
                    break
            score += np.array(parts["value"])[at]
    return Trees(np.array(parts["feature"], dtype=np.int64), np.array(parts["threshold"], dtype=float), np.array(parts["left"], dtype=np.int64), np.array(parts["right"], dtype=np.int64), np.array(parts["value"], dtype=float), np.array(roots, dtype=np.int64), base)


def _leaf(parts: dict[str, list], g: float, h: float) -> None:
    me = len(parts["value"])
    for k, v in (("feature", 0), ("threshold", 0.0), ("left", me), ("right", me), ("value", -RATE * g / (h + SHRINK))):
        parts[k].append(v)


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on labelled documents outside the held-out fold, on at most sample_rows of them.

    labels: doc_id, quality (0 or 1; other values and nulls teach nothing). Repeated labels of an id count once, the greatest.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = usable.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = documents.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # sample_rows rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # an id may stand for many rows, so these are bounded as well before they come to the driver, as statistics and not as texts
    made = chosen.select("doc_id", "text", "quality").mapInArrow(rows, "doc_id bigint, quality int, x array<double>")
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(sample_rows).collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in got]).reshape(-1, len(NAMES)), np.array([r.quality for r in got], dtype=float))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def score_documents(documents: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null text counts as empty and is scored as such; a null
    id is not held out; repeated ids are scored one by one; an empty table gives no rows; other columns are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.predict(x))], names=["doc_id", "score"])

    scored = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(rows, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold; null text is judged as empty."""

    def change(texts: list[str | None]) -> list[str | None]:
        p = trees.predict(np.array([statistics(t or "") for t in texts]).reshape(-1, len(NAMES)))
        return [t if q >= threshold else None for t, q in zip(texts, p, strict=True)]

    return map_texts(documents.withColumn("text", F.coalesce("text", F.lit(""))), change)
