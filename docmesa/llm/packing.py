"""Packing documents into sequences by non-negative least squares over a length histogram.

Each document's ids are cut into full windows and a rest. Rests shorter than a quarter of the
window are strung together, where they are read, into items of at least that length. The
histogram of item lengths (in steps of STEP tokens, so of fixed size) goes to the driver, which
enumerates the combinations of at most four steps that fill a window, solves
for how often to repeat each by non-negative least squares, rounds down, and packs what is
left greedily. Items then find their sequence by their rank within their length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmesa.llm.common import materialise

#: Tokens in a step of the histogram, and parts that the ranks within a length are counted in.
STEP, PARTS = 16, 64
#: Chunks whose ids a worker keeps, at most; words tokenized at once.
CACHE_CHUNKS, TOGETHER = 1_400_000, 2000
#: A comma or stop that is not directly behind a letter or digit, so that it belongs to a run of marks.
_IN_RUN = re.compile(r"(?:[^\w ]|_)[,.] ")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Ids of whole texts from a tokenizer that splits at blanks and line ends, and between letters and ASCII marks.

    The ids of chunks between blanks are kept in two generations: when the younger is full, it becomes the
    older, whose chunks are kept on only if they come again. Texts that hold the string of one of
    the tokenizer's added tokens go to it whole.
    """

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def raw(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Of words of letters: many in one text, whose ids are cut where a word ends. One that does not fit that goes alone."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                data = ids.tobytes()
                at = [0, *(4 * cut).tolist()]
                out += [data[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                out += self.raw(part)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [[] if any(a in t for a in self.added) else _chunks(t) for t in texts]
        self.learn(set().union(*split))
        cache = self.cache
        return [b"".join([cache[w] for w in words]) if words else self.raw([t])[0] for t, words in zip(texts, split, strict=True)]

    def learn(self, chunks: set[str]) -> None:
        if 2 * len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        missing = chunks - cache.keys()
        known = missing & older.keys()
        cache.update([(w, older[w]) for w in known])
        missing -= known
        # most are ASCII letters, perhaps with marks behind them
        plain = [w for w in missing if w.isascii() and w.isalpha()]
        missing.difference_update(plain)
        pairs = [(w, w.rstrip(_MARKS)) for w in missing]
        parts = [(w, c.lower(), w[len(c) :]) for w, c in pairs if c.isascii() and c.isalpha()]
        parts += [(w, c, w[len(c) :]) for w, c in pairs if not c.isascii() and _letters(c)]
        rest = missing.difference([p[0] for p in parts])
        letters = {w.lower() for w in plain}
        letters.update([p[1] for p in parts])
        rest.update([p[2] for p in parts if p[2]])
        words, others = list(letters - cache.keys()), list(rest - cache.keys())
        cache.update(zip(words, self.words(words), strict=True))
        cache.update(zip(others, self.raw(others), strict=True))
        cache.update([(w, cache[w.lower()]) for w in plain])
        cache.update([(w, cache[core] + cache[tail] if tail else cache[core]) for w, core, tail in parts])


def _chunks(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are those of the text: cut at blanks. Latin
    text is also put in lower case, as the tokenizer does, and cut before commas and stops where it cuts."""
    text = text.replace("\n", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    text = text.lower()
    if not _IN_RUN.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _letters(word: str) -> bool:
    """Letters that stay letters in lower case and composed."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word.lower()).isalpha())


_shared: dict[str, WordIds] = {}


def word_ids(definition: str) -> WordIds:
    """One for each worker, whose tasks go on with what earlier ones have learned."""
    if definition not in _shared:
        _shared.clear()
        _shared[definition] = WordIds(definition)
    return _shared[definition]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |ax - b|, by the active set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    gradient = a.T @ b
    for _ in range(3 * a.shape[1]):
        if free.all() or gradient[~free].max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free[np.argmax(np.where(free, -np.inf, gradient))] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                break
            low = free & (s <= 0)
            x += np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)) * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def combinations(size: int, least: int) -> list[tuple[int, ...]]:
    """Descending steps, each at least `least` and at most four of them, whose sum is `size`."""
    found = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < 4:
            for n in range(min(most, left), least - 1, -1):
                if left - n == 0 or left - n >= least:
                    extend((*head, n), left - n, n)

    extend((), size, size)
    return found


def plan(histogram: dict[int, int], size: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """(steps of the items of a sequence, how many such sequences) that use up the histogram. size, least: in steps."""
    left, made = dict(histogram), []

    def take(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            made.append((combo, times))
            for n in combo:
                left[n] -= times

    combos = [c for c in combinations(size, least) if all(histogram.get(n) for n in c)]
    if combos:
        rows = sorted(n for n, c in histogram.items() if c)
        at = {n: i for i, n in enumerate(rows)}
        a = np.zeros((len(rows), len(combos)))
        for j, c in enumerate(combos):
            for n in c:
                a[at[n], j] += 1
        x = nnls(a, np.array([histogram[n] for n in rows], dtype=float))
        for j in np.argsort(-x, kind="stable"):
            take(combos[j], int(min([np.floor(x[j] + 1e-6), *(left[n] // combos[j].count(n) for n in combos[j])])))
    while any(left.values()):
        combo, room = [], size
        for n in sorted((n for n, c in left.items() if c), reverse=True):
            k = min(left[n], room // n)
            combo += [n] * k
            room -= n * k
        take(tuple(combo), min(left[n] // combo.count(n) for n in combo))
    return made


def items(df: DataFrame, definition: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row per item: its tokens, step and pieces."""
    kind = df.schema[id_col].dataType.simpleString()
    arrow = pa.schema([("doc_id", _arrow(df, id_col)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("at", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mark, short = word_ids(definition), np.array([end_id], dtype="<u4").tobytes(), window // 4
        held: list[tuple] = []
        room = 0

        def packed(out: list[list[tuple]]) -> pa.RecordBatch:
            tokens = [sum(p[2] for p in item) for item in out]
            pieces = pa.array([[dict(zip(arrow.names, p, strict=True)) for p in item] for item in out], pa.list_(pa.struct(list(arrow))))
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([-(-n // STEP) for n in tokens], pa.int32()), pieces], names=["tokens", "step", "pieces"])

        for b in batches:
            out: list[list[tuple]] = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, made in zip(b.column(0).to_pylist(), ids(texts), strict=True):
                data = memoryview(made + mark)
                n = len(data) // 4
                for s in range(0, n, window):
                    k = min(window, n - s)
                    piece = (doc, s, k, zlib.crc32(data[4 * s : 4 * (s + k)]), n)
                    if k >= short:
                        out.append([(*piece, 0)])
                    else:
                        held.append((*piece, room))
                        room += k
                        if room >= short:
                            out.append(held)
                            held, room = [], 0
            if out:
                yield packed(out)
        if held:
            yield packed([held])

    return df.select(df[id_col], df[text_col]).mapInArrow(rows, f"tokens bigint, step int, pieces array<struct<doc_id:{kind},start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,at:bigint>>")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def pack_documents(df: DataFrame, definition: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    definition: a tokenizer as JSON text. window: a multiple of 4 * STEP. Each id of each row's
    text, and end_id behind it, lies in exactly one piece; the pieces of a sequence follow each
    other without gaps. Null text counts as empty and is the end id alone; rows with equal or
    null ids are packed one by one; an empty table gives no rows; other columns are left out.
    """
    assert window % (4 * STEP) == 0
    made = materialise(items(df, definition, end_id, window, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("pieces"), F.lit(PARTS)).cast("int")), "packing")
    counts = {(r.step, r.part): r["count"] for r in made.groupBy("step", "part").count().collect()}  # at most window / STEP * PARTS rows
    histogram: dict[int, int] = {}
    for (step, _), n in counts.items():
        histogram[step] = histogram.get(step, 0) + n
    # where each combination's items begin among those of their step
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    # items below a quarter of the window are the last of their task: few, and packed greedily
    for combo, times in plan(histogram, window // STEP, window // 4 // STEP):
        for k, step in enumerate(combo):
            slots.setdefault(step, []).append((used.get(step, 0), first, k, times))
            used[step] = used.get(step, 0) + times
        first += times
    before: dict[tuple[int, int], int] = {}
    for step in histogram:
        total = 0
        for part in range(PARTS):
            before[step, part] = total
            total += counts.get((step, part), 0)
    tables = {s: tuple(np.array(x) for x in zip(*v, strict=True)) for s, v in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps, parts, ranks = (b.column(i).to_numpy() for i in (2, 3, 4))
            sequence, slot = np.zeros(len(steps), dtype=np.int64), np.zeros(len(steps), dtype=np.int32)
            for s in np.unique(steps):
                here = steps == s
                rank = ranks[here] - 1 + np.array([before[int(s), int(p)] for p in parts[here]])
                start, seq, k, _ = tables[int(s)]
                i = np.searchsorted(start, rank, side="right") - 1
                sequence[here], slot[here] = seq[i] + rank - start[i], k[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sequence), pa.array(slot)], names=["tokens", "pieces", "sequence_id", "slot"])

    kind = made.schema["pieces"].dataType.simpleString()
    ranked = made.select("tokens", "pieces", "step", "part", F.row_number().over(Window.partitionBy("step", "part").orderBy(F.xxhash64("pieces"), F.col("pieces")[0]["doc_id"], F.col("pieces")[0]["start"])).alias("rank"))
    placed = ranked.mapInArrow(place, f"tokens bigint, pieces {kind}, sequence_id bigint, slot int")
    base = F.coalesce(F.sum("tokens").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = placed.withColumn("base", base).select("sequence_id", "base", F.explode("pieces").alias("p"))
    return laid.select(*[F.col(f"p.{c}").alias(id_col if c == "doc_id" else c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], "sequence_id", (F.col("base") + F.col("p.at")).alias("offset"))
