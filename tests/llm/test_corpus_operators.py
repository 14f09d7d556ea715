"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmesa.llm import embedding_dedup, fingerprints, html_extraction, jaccard_join, packing, pii, piece_encoding, quality, suffix_dedup, warc
from docmesa.llm.common import prepare
from docmesa.llm.queries import tokenizer_path

WORDS = "the of and Einung für que réelle ser tion over lazy dog brown jumps quick und le".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(("", "", ",", ".")) for _ in range(n))


def texts(seed=1):
    """Random prose with exact copies, near copies, shared passages, an empty, a null and a long text."""
    r = random.Random(seed)
    out = [prose(r, r.randint(3, 120)) for _ in range(30)]
    shared = prose(r, 40)
    for k in range(0, 30, 4):
        out[k] = out[k] + " " + shared + " " + prose(r, 9)
    for k in range(5):
        words = out[10 + k].split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    return [*out, out[3], out[3], "", None, " ", "a b", prose(r, 9000), "x" * 3000, "日本語 テキスト " * 20, "\x00 odd \x1c bytes here"]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or ""), 1.0) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids, repeated rows, a null id."""
    rows = [(1, "one two three four five six seven " * 5), (1, "one two three four five six seven " * 5), (2, "one two three four five six seven " * 5), (2, "other text entirely"), (None, "one two three four five six seven " * 5), (3, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1


def test_statistics_of_any_text():
    for t in texts():
        x = quality.statistics(t or "")
        assert x.shape == (len(quality.NAMES),) and np.isfinite(x).all()
    assert not quality.statistics("").any()


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.fit(x[:1000], y[:1000]).predict(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.9
    assert (quality.fit(x[:5], np.ones(5)).predict(x) > 0.7).all()
    assert np.allclose(quality.fit(x[:0], y[:0]).predict(x), 0.5)


def test_quality_held_out(spark, docs, odd):
    r = random.Random(3)
    rows = [(i, prose(r, 60) if i % 2 else "!! ".join(w.upper() for w in prose(r, 60).split()), i % 2) for i in range(400)]
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(x[0], x[2], 0) for x in rows] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    trees = quality.train(d, labels)
    got = quality.score_documents(d, trees).collect()
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([g.predicted == g.doc_id % 2 for g in held]) > 0.95
    assert quality.score_documents(docs, trees).count() == docs.count() and quality.score_documents(odd, trees).count() == 6
    assert quality.score_documents(docs.limit(0), trees).count() == 0
    assert {r.doc_id for r in quality.keep_good(d, trees).collect()} == {g.doc_id for g in got if g.predicted}


def test_trees_equal_a_plain_walk():
    """The vectorised traversal against one row and one node at a time."""
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    trees = quality.fit(x[:300], (x[:300, 0] * x[:300, 1] > 0).astype(float))
    for row, p in zip(x, trees.predict(x), strict=True):
        score = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            score += trees.value[node]
        assert abs(p - 1 / (1 + np.exp(-score))) < 1e-12


def test_sample_of_one_id(spark):
    """An id with more rows than the bound gives no more rows than that."""
    rows = [(1, f"text {k}") for k in range(300)] + [(k, prose(random.Random(k), 9)) for k in range(2, 40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id bigint, quality int, toxic int")
    seen = []
    original, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or original(x, y)
    try:
        quality.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, sample_rows=25)
    finally:
        quality.fit = original
    assert seen == [25]


# --- 2


def removed_by_hand(rows, length=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mask = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], i) < i:
                mask[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[i] = (len(b), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~mask])).hexdigest())
    return out


def test_repeats_against_all_windows(docs):
    got = as_dict(suffix_dedup.repeat_digests(docs))
    want = removed_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert {k: (v.n_bytes, v.n_removed, v.n_spans, v.kept_sha256) for k, v in got.items()} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_repeats_odd_rows(odd):
    got = suffix_dedup.remove_repeats(odd).collect()
    by = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.n_bytes) for r in got)
    assert by == [(-1, 0, 170), (1, 170, 170), (1, 170, 170), (2, 0, 19), (2, 170, 170), (3, 0, 0)]
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_levels_merge_and_match():
    r = random.Random(5)
    levels, seen = suffix_dedup.SuffixLevels(4), {}
    for doc in range(40):
        keys = np.array(["".join(r.choice("ab") for _ in range(4)).encode() for _ in range(r.randint(1, 9))], dtype="S4")
        found = levels.add(keys, np.full(len(keys), doc))
        assert found.tolist() == [seen.get(k, doc) < doc for k in keys.tolist()]
        for k in keys.tolist():
            seen.setdefault(k, doc)
    assert len(levels.levels) <= 8


def test_long_document_in_slices(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    data = np.frombuffer(prose(random.Random(1), 400).encode(), dtype=np.uint8)
    starts = []
    for part, cut, first, skip in suffix_dedup._slices(data, np.array([0, len(data)]), 50):
        s = suffix_dedup.segments(part, cut, 50)
        starts += [w + skip for a, n in zip(s.start, s.windows) for w in range(a, a + n)]
    assert sorted(starts) == list(range(len(data) - 49))


# --- 3


@pytest.fixture(scope="module")
def labeller():
    return html_extraction.train(pages=500, rounds=6)


def test_blocks():
    b = html_extraction.blocks("<nav><a href=x>Me&amp;nu</a></nav><article><h1>T <b>b</b>old</h1><p>one<br>two<p>three<ul><li>x<li>y</ul><!-- c --><script>'</p>'</script>&copy end <tag")
    assert [x.text for x in b] == ["Me&nu", "T bold", "one two", "three", "x", "y", "© end"]
    assert b[0].linked == 5 and "nav" in b[0].path and b[2].path[-1] == "p"
    assert html_extraction.blocks("") == [] and html_extraction.blocks("<p") == [] and [x.text for x in html_extraction.blocks("a < b")] == ["a < b"]


def test_vectors_of_whole_blocks():
    """What differs after the 40th word, the 200th or 2,000th character, the fourth word of a class or 23 names further out is seen."""
    vector = lambda page: html_extraction.vectors(html_extraction.blocks(page))[0]
    many = "word " * 400
    for a, b in (
        (f"<p>{'word ' * 50}end", f"<p>{'word ' * 50}comments"),
        (f"<p>{many}end one", f"<p>{many}end two"),
        (f"<p>{many}one two", f"<p>{many}ONE TWO"),
        (f"<p>{many * 2}", f"<p>{many * 3}"),
        ('<div class="a b c d footer"><p>text', '<div class="a b c d article"><p>text'),
        (f"<aside>{'<div>' * 30}<p>text", f"<article>{'<div>' * 30}<p>text"),
    ):
        assert not np.array_equal(vector(a), vector(b))
    words = vector(f"<p>{many}")[html_extraction.PATH + html_extraction.LEAF :][: html_extraction.WORDS]
    assert abs(np.linalg.norm(words) - 1) < 1e-5


def test_labeller_held_out(labeller):
    good = total = 0
    for page in html_extraction.invented(150, 99):
        x, y = html_extraction.labelled(page)
        if len(y):
            p = labeller.probabilities(*html_extraction.padded([x]))[0]
            good, total = good + ((p >= 0.5) == (y > 0)).sum(), total + len(y)
    assert good / total > 0.97


def test_extraction_of_rows(spark, labeller):
    page = "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Title here</h1><p>Body text of the article, which is long enough.</p></article><footer>&copy; site</footer></body></html>"
    d = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "y"), (2, "v", "", "z"), (3, "w", "<p>" + "word " * 20000, "z")], "page_id bigint, url string, html string, text string")
    got = html_extraction.extract_main_text(d, labeller).collect()
    assert [g.text for g in got if g.page_id == 1] == ["Title here Body text of the article, which is long enough."] * 2
    assert all(g.n_chars == len(g.text) for g in got) and [g.text for g in got if g.page_id in (None, 2)] == ["", ""]
    assert html_extraction.extract_main_text(d.limit(0), labeller).count() == 0


# --- 4


def test_chunked_framing():
    for n in (0, 1, 8192, 8193, 50000):
        payload = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(payload)) == payload


def test_archive_round_trip(spark):
    prepare(spark)
    long = "<p>é" * 40000
    rows = [(5, "u", "same"), (3, "u\n", "same"), (9, None, "same"), (4, "u", long), (6, "u", long), (7, "u", None), (8, "u", ""), (3, "u", "same"), (None, "u", "same"), (10, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload_bytes int").repartition(3)
    got = warc.round_trip(d).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((-1 if i is None else i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i is None or first[h or ""] == i else "revisit", -1 if i is None or first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert sorted((-1 if g.page_id is None else g.page_id, g.payload_bytes, g.payload_digest, g.record_type, -1 if g.refers_to is None else g.refers_to) for g in got) == want
    assert warc.round_trip(d.limit(0)).count() == 0


def test_missing_segment_is_an_error(spark):
    d = spark.createDataFrame([(1, "u", "y" * 200000)], "page_id bigint, url string, html string")
    path = "file:///tmp/docmesa-test-" + hashlib.md5(str(random.random()).encode()).hexdigest()
    warc.write_archives(d, path)
    found = warc.read_records(spark.read.parquet(path))
    assert found.count() == 4
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(found.filter("segment != 2 or segment is null")).collect()


# --- 5


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_pieces_equal_the_library(spark, docs, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    for g in piece_encoding.encode_documents(docs, model).join(docs.select(F.col("doc_id").alias("d"), "text"), F.expr("doc_id = d")).collect():
        t = g.text or ""
        assert list(g.ids) == lib.encode(t) and g.decoded == lib.decode(lib.encode(t))
        assert list(g.begin)[1:] == list(g.end)[:-1] and (g.end[-1] if g.ids else 0) == len(t.encode())
    assert piece_encoding.digest_documents(docs.limit(0), model).count() == 0


def test_pieces_of_odd_texts(model):
    import sentencepiece

    lib, e = sentencepiece.SentencePieceProcessor(model_proto=model), piece_encoding.OffsetEncoder(model)
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(list("ab  \n\té日▁😀\x00")) for _ in range(r.randint(0, 20)))
        g = e.encode(t)
        assert g.ids.tolist() == lib.encode(t) and g.decoded == lib.decode(lib.encode(t))
        assert (int(g.end[-1]) if len(g.end) else 0) == len(t.encode())


def walked(e, text):
    """Normalisation byte by byte: longest keys, a blank mark in front and for blanks, squeezed if the model asks for it."""
    data, out, came, prev, at = text.encode(), bytearray(), [], e.squeeze, 0
    blank = "▁".encode() if e.escape else b" "
    first = e.dummy
    while at < len(data):
        n, piece = e.map.longest(data, at)
        same = piece is None
        if same:
            n = next(k for k in range(1, 5) if at + k == len(data) or data[at + k] & 0xC0 != 0x80)
            piece = data[at : at + n]
        for k in range(len(piece)):
            if piece[k : k + 1] == b" " and prev and e.squeeze:
                continue
            if first:
                out, came, first = out + blank, came + [at] * len(blank), False
            prev = piece[k : k + 1] == b" "
            c = blank if prev else piece[k : k + 1]
            out, came = out + c, came + [at + k if same or piece == data[at : at + n] else at] * len(c)
        if first and not e.squeeze:
            out, came, first = out + blank, came + [at] * len(blank), False
        at += n
    while e.squeeze and out.endswith(blank):
        del out[-len(blank) :], came[-len(blank) :]
    return bytes(out), [*came, len(data)]


def test_alignment_of_runs_equals_a_walk(model):
    """Whole runs against a walk byte by byte, for the model in use and for maps, squeezing and no escape."""
    from sentencepiece import sentencepiece_model_pb2

    r = random.Random(14)
    made = ["".join(r.choice(["AB", "A", "é", "Z", " ", "  ", "x", "▁", "日", "\n", "B"]) for _ in range(r.randint(0, 14))) for _ in range(600)]
    for squeeze in (False, True):
        for table in ({}, {b"AB": b"c", b"A": b"a ", "é".encode(): b"ee", b"Z": b" ", b"x": b"x"}):
            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(model)
            proto.normalizer_spec.precompiled_charsmap = compiled(table) if table else b""
            proto.normalizer_spec.remove_extra_whitespaces = squeeze
            e = piece_encoding.OffsetEncoder(proto.SerializeToString())
            for t in [*made, *([t or "" for t in texts()] if not table else [])]:
                normal, came = e.normalise(t)
                want, want_came = walked(e, t)
                assert normal == want and came.tolist() == want_came, t
                g = e.encode(t)
                assert g.ids.tolist() == e.whole.encode(t) and (g.begin <= g.end).all() and (not len(g.end) or squeeze or g.end[-1] == len(t.encode()))


def test_compiled_map_and_alignment(model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.precompiled_charsmap = compiled({b"AB": b"c", b"A": b"a", "é".encode(): b"ee", b"Z": b""})
    e = piece_encoding.OffsetEncoder(proto.SerializeToString())
    assert e.map.longest(b"ABx", 0) == (2, b"c") and e.map.longest(b"Ax", 0) == (1, b"a") and e.map.longest(b"x", 0) == (0, None)
    normal, came = e.normalise("xABéZA b")
    assert normal.decode() == "▁xceea▁b" and came.tolist() == [0, 0, 0, 0, 1, 3, 3, 6, 7, 7, 7, 8, 9]
    g = e.encode("xABéZA b")
    assert int(g.end[-1]) == len("xABéZA b".encode()) and (g.begin <= g.end).all()


def compiled(table):
    """A double array over the keys, and the replacements."""
    import struct

    units, used, values, blob = [0] * 4096, {0}, {}, b""
    for k, v in table.items():
        values[k] = len(blob)
        blob += v + b"\0"
    units[0] = 0

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in table if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in table
        labels = ([0] if leaf else []) + kids
        base = next(b for b in range(256, 4096 - 256, 256) if all((b ^ c) not in used for c in labels) and b not in used)
        used.update(base ^ c for c in labels)
        units[node] = (units[node] & 0xFF) | ((base ^ node) << 10) | (256 if leaf else 0)
        if leaf:
            units[base] = values[prefix] | 0x80000000
        for c in kids:
            units[base ^ c] = c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    trie = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie)) + trie + blob


# --- 6


def test_fingerprints(spark, docs):
    got, rows = as_dict(fingerprints.edited_fingerprints(docs)), sorted((r.doc_id, r.text or "") for r in docs.collect())
    by_text = {}
    for k, (i, t) in enumerate(rows):
        n, g = rows[(k + 1) % len(rows)][1], got[i]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, g.fingerprint) == g.fingerprint
    assert len(set(by_text.values())) >= len(by_text) - 2  # empty and blank are the same when folded
    d = spark.createDataFrame([(1, "Ａbc  É"), (2, " abc é "), (3, "ABC É"), (4, "abd")], "doc_id bigint, text string")
    f = {r.doc_id: r for r in fingerprints.edited_fingerprints(d).collect()}
    assert f[1].fingerprint == f[2].fingerprint == f[3].fingerprint != f[4].fingerprint and f[1].near_next == 1.0 and f[3].near_next == 0.0
    assert fingerprints.edited_fingerprints(d.limit(0)).count() == 0 and fingerprints.edited_fingerprints(d.limit(1)).first().near_next == 1.0


def test_caseless_equivalents(spark):
    """The canonical form is stable: what folding decomposes is composed again."""
    import unicodedata

    def form(t):
        n = unicodedata.normalize
        return re.sub("[\\s\x1c-\x1f]+", " ", n("NFKC", n("NFKC", n("NFD", t).casefold()).casefold())).strip(" ")

    r = random.Random(4)
    pool = [chr(c) for c in [*range(32, 0x500), *range(0x1E00, 0x2000), *range(0x2100, 0x2180), *range(0xFB00, 0xFB07), *[0x301, 0x308, 0x345] * 30, 0x1100, 0x1161]]
    rows = [(0, "\u03aa\u0301 x"), (1, "\u0390 x"), (2, "a\x85b"), (3, "a b")] + [(k, "".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for k in range(4, 3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = d.select("doc_id", "text", fingerprints.canonical(F.col("text")).alias("c")).withColumn("again", fingerprints.canonical(F.col("c"))).collect()
    assert all(g.c == g.again == form(g.text) for g in got)
    prints = {g.doc_id: g.fingerprint for g in fingerprints.fingerprint_documents(d.filter("doc_id < 4")).collect()}
    assert prints[0] == prints[1] and prints[2] == prints[3]


def test_clashing_digests(spark, monkeypatch):
    """With a hash that nearly always clashes, fingerprints and edited fingerprints are equal just where forms are."""
    monkeypatch.setattr(fingerprints, "wide", lambda form: (F.length(form).cast("bigint"), F.lit(7).cast("bigint")))
    for few in (10_000, 0):
        monkeypatch.setattr(fingerprints, "FEW", few)
        texts_ = ["ab cd", "ab ef", "AB CD", "xy zw", "ab cd", "ab", "cd", ""]
        d = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
        got = sorted(fingerprints.edited_fingerprints(d).collect())
        edited = [t[: len(t) - len(t) // 2] + texts_[(k + 1) % len(texts_)][: len(t) // 2] for k, t in enumerate(texts_)]
        form = lambda t: " ".join(t.casefold().split())
        every = [(form(t), g.fingerprint) for t, g in zip(texts_, got, strict=True)] + [(form(t), g.edited_fingerprint) for t, g in zip(edited, got, strict=True)]
        assert all((a[0] == b[0]) == (a[1] == b[1]) for a in every for b in every)


def test_places_of_many_bounds(spark):
    cuts = list(range(0, 3000, 7))
    d = spark.range(-5, 3010).select("id", fingerprints._place(cuts, F.col("id")).alias("p"))
    assert all(r.p == sum(c <= r.id for c in cuts) for r in d.collect())
    assert spark.range(3).select(fingerprints._place([], F.col("id")).alias("p")).first().p == 0


def test_fingerprints_odd_rows(odd):
    assert fingerprints.edited_fingerprints(odd).count() == 6 and fingerprints.fingerprint_documents(odd).count() == 6


# --- 7


def test_near_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    rows = []
    for k in range(400):
        v = base[k % 60] + r.normal(size=16) * (0.02 if k % 3 else 1.0)
        rows.append((k, [float(np.float32(x)) for x in v], k % 60 % 4))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 1), (1004, rows[5][1], None), (1005, rows[5][1], rows[5][2]), (1005, rows[5][1], rows[5][2]), (1006, [1.0] * 3, 1), (1007, [float("inf")] * 16, 1), (None, rows[5][1], rows[5][2])]
    d = spark.createDataFrame([(*x, "c") for x in rows], "vec_id bigint, embedding array<float>, label int, component_id string")
    got = embedding_dedup.near_duplicates(d).collect()
    assert len(got) == len(rows)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = []
    for _, e, label in rows:
        ok = e and None not in e and np.isfinite(e).all() and np.any(e) and label is not None
        unit.append(np.array(e) / np.linalg.norm(e) if ok else None)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (v, *_) in enumerate(rows):
        if v is not None:
            names[find(i)] = min(v, names.get(find(i), v))
    want = sorted((-1 if v is None else v, links[i], names.get(find(i), -1)) for i, (v, *_) in enumerate(rows))
    assert sorted((-1 if g.vec_id is None else g.vec_id, g.n_links, -1 if g.component_id is None else g.component_id) for g in got) == want
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_lone_links_in_labels_of_many_shards(spark):
    """Few links, each of a lone pair just above the threshold: a small sample meets none, a few trees lose some."""
    r = np.random.default_rng(6)
    x = r.normal(size=(24000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 160, 2):
        side = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        x[k + 1] = 0.932 * x[k] + (1 - 0.932**2) ** 0.5 * side / np.linalg.norm(side)
    label = np.where(np.arange(len(x)) < 20000, 1, 2)
    x, label = x.astype(np.float32), label
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = {k: 0 for k in range(len(x))}
    for s in range(0, len(x), 1000):
        i, j = np.nonzero(unit[s : s + 1000] @ unit.T >= 0.93)
        for p, q in zip((i + s).tolist(), j.tolist(), strict=True):
            links[p] += p != q and label[p] == label[q]
    assert sum(links.values()) == 160
    d = spark.createDataFrame([(k, v, n) for k, (v, n) in enumerate(zip(x.tolist(), label.tolist(), strict=True))], "vec_id bigint, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(d).collect()
    assert {g.vec_id: g.n_links for g in got} == links
    assert all(g.component_id == (g.vec_id - g.vec_id % 2 if g.n_links else g.vec_id) for g in got)
    assert {g.audit_recall for g in got} == {1.0}


def test_audit_measures_what_is_missing(spark):
    """Links of many copies with no edge found: the audit says 0, and says nothing where no point has a link."""
    r = np.random.default_rng(8)
    x = r.normal(size=(2000, 16))
    x[1:1000:2] = x[0:1000:2] + r.normal(size=(500, 16)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, 1 if k < 1000 else 2, 1, v.tobytes(), 128) for k, v in enumerate(x)]
    points = spark.createDataFrame(rows, "id bigint, label bigint, w bigint, v binary, size int")
    sizes = {(1, 128): 1000, (2, 128): 1000}
    none = spark.createDataFrame([], "node bigint, root bigint")
    assert embedding_dedup.audit(points, none, sizes, 0.99) == {(1, 128): 0.0, (2, 128): None}
    whole = spark.createDataFrame([(k, k - k % 2) for k in range(1000)], "node bigint, root bigint")
    assert embedding_dedup.audit(points, whole, sizes, 0.99) == {(1, 128): 1.0, (2, 128): None}


def test_descent_finds_near_rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8))
    x[150:] = x[:150] + r.normal(size=(150, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, like = embedding_dedup.descend(x, 0.93)
    found = {(min(i, j), max(i, j)) for i in range(300) for j, s in zip(near[i], like[i]) if s >= 0.93 and i != j}
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))}
    assert len(found & true) >= 0.95 * len(true) and found <= true


# --- 8

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_hand(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def weights():
    return pii.train()


def test_base_spans():
    r = random.Random(6)
    for _ in range(8000):
        t = "".join(r.choice("0123456789..--  ++()@@ab%_é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == base_by_hand(t)
    for t in ("1" * 50000, "a" * 50000 + "@", "1." * 20000, "+1" * 20000):
        assert pii.base_spans(t) is not None


def test_octets_of_any_length(weights):
    """Runs of digits longer than an int may be read from."""
    long = "1" * 5000
    assert pii.base_spans(long + ".1.1.1") == pii.base_spans("1.1.1." + long) == [] and pii.base_spans("0" * 5000 + "255.1.1.1") == [("ip", 0, 5009)]
    assert [pii.octet(x) for x in ("", "0", "000", "255", "256", "0255", "1000", "99")] == [True, True, True, True, False, True, False, True]
    assert pii.all_spans(f"{long}.1.1.1 and 10.0.0.1", weights)[0] == [("ip", 5011, 5019)]


def test_many_short_groups(weights):
    """Chains of many groups take time in proportion to their length."""
    import time

    begin = time.process_time()
    base, every = pii.all_spans("1.2." * 40000, weights)
    assert len(base) == 20000 and time.process_time() - begin < 30


def test_decoder_against_every_segmentation():
    """On small lattices: the best sum over all sets of segments that do not overlap."""
    r = random.Random(12)
    for _ in range(300):
        points = sorted(r.sample(range(30), r.randint(2, 7)))
        found = [(a, b, r.choice(pii.KINDS), (f"f{r.randrange(6)}", f"g{r.randrange(6)}")) for a in points for b in points if a < b and r.random() < 0.5]
        if not found:
            continue
        weights_ = {f"{c}{k}": r.uniform(-2, 2) for c in "fg" for k in range(6)}
        worth = lambda x: sum(weights_[f] for f in x[3])

        top = max(0.0, best_of(found, worth))
        got = pii.decode(found, weights_)
        assert all(p[2] <= q[1] for p, q in zip(got, got[1:], strict=False))
        score = sum(max(worth(x) for x in found if (x[2], x[0], x[1]) == g) for g in got)
        assert abs(score - top) < 1e-9


def best_of(found, worth):
    """The greatest worth of any subset without overlaps, by trying all."""
    if not found:
        return 0.0
    head, *rest = found
    apart = [x for x in rest if x[1] <= head[0] or x[0] >= head[1]]
    return max(best_of(rest, worth), worth(head) + best_of(apart, worth))


def test_field_held_out(weights):
    hit = extra = missed = 0
    for t, gold in pii.invented(400, 321):
        got = set(pii.all_spans(t, weights)[1])
        hit, extra, missed = hit + len(got & set(gold)), extra + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_clean_text_stays(weights):
    for t in ("On 2024-05-17 about 1,200 of 35 items (3.14 %) in version 1.2.3 cost 99.95.", "ISBN 978-3-1614-8410-0", "rows 1 2 3 4 5 6 7 8 9 10 11 12", "look at example.com", ""):
        assert pii.all_spans(t, weights)[1] == pii.base_spans(t)


def test_spans_of_rows(spark, docs, odd, weights):
    d = spark.createDataFrame([(1, "mail me@x.org or +1 (415) 555-2671, call (415) 555-2671."), (1, None), (None, "ip 10.0.0.1 card 4111 1111 1111 1111"), (2, "")], "doc_id bigint, text string")
    got = pii.find_personal_data(d, weights).collect()
    assert (got[0].n_email, got[0].n_phone) == (1, 1) and "phone:41:55" in got[0].spans and got[1].spans == "" and (got[2].n_ip, got[2].n_card) == (1, 1)
    assert got[0].base_sha256 == hashlib.sha256(b"email:5:13,phone:17:34").hexdigest()
    masked = [r.text for r in pii.mask_personal_data(d, weights).collect()]
    assert masked == ["mail <EMAIL> or <PHONE>, call <PHONE>.", None, "ip <IP> card <CARD>", ""]
    assert pii.find_personal_data(docs, weights).count() == docs.count() and pii.find_personal_data(odd.limit(0), weights).count() == 0


# --- 9


def sets_by_hand(t, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("words,top,bottom", [(3, 90, 100), (5, 8, 10), (1, 6, 10)])
def test_jaccard_components(docs, words, top, bottom):
    got = as_dict(jaccard_join.jaccard_components(docs, words, top, bottom))
    sets = {r.doc_id: sets_by_hand(r.text, words) for r in docs.collect()}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: (got[i].n_shingles, got[i].component_id) for i in ids} == {i: (len(sets[i]), find(i)) for i in ids}


def test_lists_lose_no_link():
    """Pairs right at the threshold share a signature, whatever their sizes."""
    r = np.random.default_rng(9)
    for t in (jaccard_join.Threshold(9, 10), jaccard_join.Threshold(8, 10), jaccard_join.Threshold(6, 10)):
        schemes = jaccard_join.Schemes(t)
        for _ in range(400):
            n = int(r.integers(2, 400))
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            m = int(r.integers(len(a), t.largest(len(a)) + 1))
            both = -(-t.top * (len(a) + m) // (t.top + t.bottom))
            if both > len(a):
                continue
            b = np.unique(np.concatenate([r.choice(a, both, replace=False), r.integers(0, 1 << 63, m - both).astype(np.uint64)]))
            if len(np.intersect1d(a, b)) == len(a) == len(b):
                continue
            assert t.linked(len(np.intersect1d(a, b)), len(a), len(b))
            sig = lambda s: {int(x) for c in schemes.of(len(s)) for x in jaccard_join.signatures(s, c)}
            assert sig(a) & sig(b)
            p, q = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
            size = min(len(p), len(q))
            assert jaccard_join.apart(jaccard_join.fold(p, size), jaccard_join.fold(q, size)) <= len(np.setxor1d(a, b))


def members(sets, hub, t, scheme, roots=None, known=True):
    """A list of sets as its members are compared: overlaps with the hub are exact where `known`, else bounds."""
    spot = [int(jaccard_join.placed(s, scheme)[1][0]) for s in sets]
    both = np.array([len(np.intersect1d(s, hub)) for s in sets])
    n = np.array([len(s) for s in sets])
    return jaccard_join.Members(n, np.array(spot), np.array(roots if roots is not None else range(len(sets))), [jaccard_join.bitmap(s).tobytes() for s in sets], both if known else n, both if known else np.zeros(len(sets), dtype=int), len(hub))


def test_derived_answers_and_skipped_blocks(monkeypatch):
    """With and without what is known of the first set, no link is lost; what is derived is right and some blocks and answers are never compared."""
    from collections import Counter

    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    r = np.random.default_rng(21)
    t = jaccard_join.Threshold(8, 10)
    counts = Counter()
    for _ in range(12):
        hub = np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64))
        sets = [hub]
        for k in range(60):
            keep = r.choice(hub, int(len(hub) * r.choice((0.95, 0.85, 0.5, 0.2))), replace=False)
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 1 << 63, int(r.choice((2, 30, 150)))).astype(np.uint64)])))
        scheme = jaccard_join.Scheme(3, 5, 0)
        want = {(i, j) for i in range(len(sets)) for j in range(i) if t.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        for known in (True, False):
            m = members(sets, hub, t, scheme, known=known)._replace(position=np.zeros(len(sets), dtype=int))
            got = {(max(i, j), min(i, j)): sure for i, j, sure in jaccard_join.compare(m, m, True, t, counts)}
            assert want <= set(got) and all(pair in want for pair, sure in got.items() if sure)
            half = len(sets) // 2
            a, b = m.part(0, half), m.part(half, len(sets))
            across = {(half + j, i) for i, j, _ in jaccard_join.compare(a, b, False, t, counts)}
            assert {(i, j) for i, j in want if j < half <= i} <= across
    assert counts["answers derived"] > 1000 and counts["links derived"] > 100 and counts["blocks of other sizes"] > 50


def test_positions_rule_blocks_out(monkeypatch):
    """Sets that share a part, but stand at its far ends: their blocks are skipped; positions are the numbers of shingles before a part."""
    from collections import Counter

    r = np.random.default_rng(22)
    t, scheme = jaccard_join.Threshold(9, 10), jaccard_join.Scheme(2, 7, 0)
    tokens = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    sig, before = jaccard_join.placed(tokens, scheme)
    assert before[0] == 0 and (np.diff(before) > 0).all() and len(sig) == 7 and jaccard_join.signatures(tokens, scheme).tolist() == sig.tolist()
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    n = np.full(16, 100)
    position = np.array([0] * 8 + [60] * 8)
    m = jaccard_join.Members(n, position, np.arange(16), [jaccard_join.bitmap(tokens[:100]).tobytes()] * 16, n, np.zeros(16, dtype=int), 100)
    counts = Counter()
    got = {(max(i, j), min(i, j)) for i, j, _ in jaccard_join.compare(m, m, True, t, counts)}
    assert got == {(i, j) for i in range(16) for j in range(i) if (i < 8) == (j < 8)} and counts["blocks at other positions"] == 4


def test_long_lists_are_dealt(spark, monkeypatch):
    """A group of near copies that are not all linked, in lists longer than a deal."""
    monkeypatch.setattr(jaccard_join, "DEAL", 8)
    r = random.Random(31)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        t = words[:]
        for _ in range(r.choice((1, 3, 6))):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    got = as_dict(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 9, 10))
    sets, parent = {i: sets_by_hand(t, 3) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: got[i].component_id for i in sets} == {i: find(i) for i in sets} and 1 < len({find(i) for i in sets}) < 90


def test_jaccard_odd_rows(odd):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd, 3, 9, 10).collect())
    assert got == [(-1, 7, 1), (1, 7, 1), (1, 7, 1), (2, 1, 2), (2, 7, 1), (3, 0, 3)]
    assert jaccard_join.jaccard_components(odd.limit(0), 3, 9, 10).count() == 0
    kept = sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(odd, 3, 9, 10).collect())
    assert [k[0] for k in kept] == [1, 2, 3] and kept[1][1] == "other text entirely"


# --- 10


@pytest.fixture(scope="module")
def definition():
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_word_ids_equal_the_library(definition):
    ids = packing.WordIds(definition)
    r = random.Random(8)
    made = ["".join(r.choice(list("abZé's  \n.,!#3ßİΣσ́日\x85\x1c\xa0\t&-<|")) for _ in range(r.randint(0, 20))) for _ in range(6000)] + ["a <|endoftext|> b", *[t or "" for t in texts()]]
    for t, got in zip(made, ids(made), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs, odd, definition):
    ids = packing.WordIds(definition)
    pieces = packing.pack_documents(docs, definition, end_id=2).collect()
    for r in docs.collect():
        want = np.append(np.frombuffer(ids([r.text or ""])[0], "<u4"), 2).astype("<u4")
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(odd, definition, end_id=2).count() == 6 and packing.pack_documents(odd.limit(0), definition, end_id=2).count() == 0


def test_least_squares():
    r = np.random.default_rng(3)
    a, x = r.random((20, 30)), np.maximum(0, r.normal(size=30))
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6
    histogram = {64: 900, 100: 500, 128: 300, 156: 500, 192: 300, 256: 10, 3: 1}
    plan = packing.plan(histogram, 256, 64)
    used = {}
    for combo, times in plan:
        assert sum(combo) <= 256
        for n in combo:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    assert sum(t for _, t in plan) <= 1.02 * sum(n * c for n, c in histogram.items()) / 256 + 2
