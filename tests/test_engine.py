"""Operators on hand-made rows."""

import random

import re

import pytest
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.operators import answer as A
from docmesa.operators import blocks as B
from docmesa.operators import catalog as R
from docmesa.operators import chunk as C
from docmesa.operators import dedupe as D
from docmesa.operators import enrich as E
from docmesa.operators import retrieval as V
from docmesa.plans import question as Q
from docmesa.streaming import events as Z


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("Rev. 3/4 of “A”", "rev of a"), ("café — 12 / 30 x", "café x"), ("", ""), ("ﬁre", "fire")])
def test_normalize_for_dedupe(spark, text, want):
    assert one(spark, text, T.normalize_for_dedupe) == want


def test_line_fingerprint(spark):
    assert one(spark, "Page 3 of 12 on 2024-01-05, item 7", T.line_fingerprint) == "page <page> on <date> item <num>"


@pytest.mark.parametrize("token,want", [("valves", "valve"), ("pass", "pass"), ("bus", "bus"), ("_Pipe-", "pipe")])
def test_keyword_token(spark, token, want):
    assert one(spark, token, T.keyword_token) == want


def test_references(spark):
    t = "See section 4.2 and ISO 9001:2015, API 520; tag PSV-1001A and ABC-DEF-01."
    assert one(spark, t, T.standards) == ["API 520", "ISO 9001:2015"]
    assert one(spark, t, T.identifiers) == ["PSV-1001A", "ABC-DEF-01"]
    assert one(spark, t, T.section_references) == ["4.2"]


@pytest.mark.parametrize("key,want", [("A2", "A0002"), ("07", "0007"), ("B", "B"), ("", "")])
def test_revision_sort_key(spark, key, want):
    assert one(spark, key, T.revision_sort_key) == want


def test_heading_stack_equals_a_stack(spark):
    r = random.Random(4)
    rows = [(d, k, r.random() < 0.4, r.randint(1, 6), f"h{k}") for d in range(20) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, block_no int, heading boolean, level int, text string")
    got = {(x.doc_id, x.block_no): x.section_path for x in B.heading_stack(df).collect()}
    stack, doc = [], None
    for d, k, heading, level, text in rows:
        if d != doc:
            stack, doc = [], d
        if heading:
            stack = [s for s in stack if s[0] < level] + [(level, text)]
        assert got[d, k] == [s[1] for s in stack]


@pytest.mark.parametrize("line,want", [("4.2 Pressure relief", True), ("APPENDIX B: Lists", True), ("A. General notes", True), ("Scope", True), ("this is a plain sentence.", False), ("VALVES AND PIPING", True), ("lower case words only", False)])
def test_headings(spark, line, want):
    assert one(spark, line, B.is_heading) is want


def test_noise(spark):
    rows = [(1, p, p, "text", t) for p in range(1, 4) for t in ("Running head of the company", "Page %d of 3" % p, "Real text number %s is kept here" % "abc"[p - 1], "CONFIDENTIAL")]
    df = spark.createDataFrame([(d, i, p, k, t) for i, (d, _, p, k, t) in enumerate(rows)], "doc_id bigint, block_no bigint, page bigint, kind string, text string")
    assert [r.text for r in B.remove_noise(df).orderBy("block_no").collect()] == ["Real text number a is kept here", "Real text number b is kept here", "Real text number c is kept here"]


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b"], ["x", "1"], ["", "2"]],)], "r array<array<string>>").select(B.render_table(F.col("r")).alias("t"))
    text = df.first().t
    assert text == "TABLE:\na | b\n--- | ---\nx | 1\nx | 2"
    p = df.select(*[v.alias(k) for k, v in E.table_parts(F.col("t")).items()]).first()
    assert p.columns == ["a", "b"] and p.rows == ["x | 1", "x | 2"] and p.quality == 0.9


def test_reading_order(spark):
    rows = [(1, i, 1, "text", float(x), float(y), float(x + 100), float(y + 10), 600.0, 800.0) for i, (x, y) in enumerate([(400, 100), (50, 300), (50, 100), (400, 300), (50, 200), (400, 200)])]
    df = spark.createDataFrame(rows, "doc_id bigint, block_no bigint, page bigint, kind string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert [r.block_no for r in B.reading_order(df).orderBy("reading_order").collect()] == [2, 4, 1, 0, 5, 3]


def test_splitting():
    long = ". ".join("word " * 30 + str(k) for k in range(40))
    parts = C.split_text(long)
    assert all(len(p) <= vocab.MAX_CHUNK_CHARS for p in parts) and "39" in parts[-1]
    assert C.split_text("w" * 1700) == ["w" * 1700] and C.split_text("") == [] and len(C.split_text("ab " * 2000)) > 3


def test_chunks(spark):
    rows = [(1, 0, 1, "text", "1 Scope of work", True, "1 Scope of work"), (1, 1, 1, "text", "Body of the first section.", False, "1 Scope of work"), (1, 2, 1, "table", "TABLE:\na | b", False, "1 Scope of work"), (1, 3, 1, "image", "[IMAGE]", False, ""), (1, 4, 2, "text", "2 Other things", True, "2 Other things"), (1, 5, 2, "text", "x" * 1690, False, "2 Other things"), (1, 6, 2, "text", "y" * 100, False, "2 Other things")]
    b = spark.createDataFrame(rows, "doc_id bigint, block_no bigint, page bigint, kind string, text string, heading boolean, section string")
    c = C.links(C.with_ids(C.with_overlap(C.semantic_chunks(b)))).orderBy("chunk_index").collect()
    assert [(x.kind, x.boundary) for x in c] == [("text", "table"), ("table", "table"), ("text", "size_limit"), ("text", "size_limit"), ("text", "semantic_boundary")]
    assert c[0].next_chunk_id == c[1].chunk_id and c[0].previous_chunk_id is None and len({x.chunk_id for x in c}) == 5


def test_keep_first(spark):
    base = "the quick brown fox jumps over the lazy dog near a river bank today with friends"
    rows = [(1, 0, base), (2, 0, base), (3, 0, base + " again"), (4, 0, base + " 12"), (5, 0, "short one"), (6, 0, "short one"), (7, 1, base)]
    df = spark.createDataFrame(rows, "id bigint, doc bigint, text string")
    got = {r.id: (r.kept, r.reason) for r in D.keep_first(df, "id", "doc").collect()}
    assert got[1] == (True, "") and got[2] == (False, "exact_signature") and got[3][1] == "near_duplicate_jaccard" and got[4] == (True, "") and not got[6][0] and got[7] == (True, "")


def test_keep_first_equals_a_walk(spark):
    """Rounds over the table against one item after the other, with copies, chains of near copies and groups."""
    import random

    r = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    made: list[str] = []
    for k in range(160):
        t = r.choice(made).split() if made and r.random() < 0.7 else r.sample(words, r.choice((8, 14, 20, 30)))
        for _ in range(r.choice((0, 0, 1, 2))):
            t[r.randrange(len(t))] = r.choice(words)
        made.append(" ".join(t))
    rows = [(k, k % 3, t) for k, t in enumerate(made)]
    got = {x.id: (x.kept, x.reason) for x in D.keep_first(spark.createDataFrame(rows, "id bigint, doc bigint, text string"), "id", "doc").collect()}
    sets = [(set(t.split()), {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} or {(w,) for w in t.split()}, len(t.split())) for t in made]

    def near(a, b):
        (v, s, m), (w, u, n) = sets[a], sets[b]
        if min(m, n) < vocab.DEDUPE_MIN_WORDS or re.findall(r"\b\d+\b", made[a]) != re.findall(r"\b\d+\b", made[b]):
            return ""
        j, c, x = len(v & w) / len(v | w), len(v & w) / min(len(v), len(w)), len(s & u) / len(s | u)
        return "near_duplicate_jaccard" if j >= 0.9 else "near_duplicate_containment" if c >= 0.92 and x >= 0.72 else "near_duplicate_shingle" if x >= 0.86 else ""

    kept: dict[int, list[int]] = {0: [], 1: [], 2: []}
    for k, g, t in rows:
        why = next(("exact_signature" for a in kept[g] if made[a] == t), "") or next((near(a, k) for a in kept[g] if near(a, k)), "")
        assert got[k] == (not why, why), k
        if not why:
            kept[g].append(k)
    assert len({w for _, w in got.values()}) >= 4


def test_protection(spark):
    """Tables with other columns, other numbers, and other sections are kept apart; a section does not part what has the same numbers."""
    base = "the quick brown fox jumps over the lazy dog near a river bank today with friends"
    rows = [(1, base, "a", False, []), (2, base + " x", "b", False, []), (3, base + " x", "a", False, []), (4, base + " 7", "a", False, []), (5, base + " 7 x", "b", False, []), (6, base + " y z", "a", True, ["p", "q"]), (7, base + " y z", "a", True, ["p", "r"])]
    df = spark.createDataFrame(rows, "id bigint, text string, section string, contains_table boolean, table_columns array<string>")
    prints = D.fingerprints(df)
    assert {(r.a, r.b) for r in D.near_pairs(prints, "id").collect()} == {(1, 3), (4, 5)}
    assert [r.p for r in prints.orderBy("id").select(D.is_protected(F.col("contains_table"), F.col("numbers")).alias("p")).collect()] == [False, False, False, True, True, True, True]


def test_chunks_in_place_equal_chunks_of_blocks(spark):
    """One pass over texts against blocks as rows, windows and groups."""
    texts = ["1 Scope\nbody of it, which goes on for a while and then ends here today.\n1.1 Part\nmore text\n2 Next\n" + "long sentence number one. " * 120, "no heading here", "", None, "A. Letters\n\nx\nAPPENDIX B: Lists\nitem one\nitem two of the list that is longer than the others by far.\n3.1.2 Deep\nend"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a = C.diagnostics(C.with_ids(C.with_overlap(C.document_chunks(d))))
    b = B.lines_as_blocks(d).withColumn("heading", B.is_heading(F.col("text"))).withColumn("level", B.heading_level(F.col("text")))
    b = B.heading_stack(b).withColumn("section", F.array_join("section_path", " > "))
    b = C.diagnostics(C.links(C.with_ids(C.with_overlap(C.semantic_chunks(b)))))
    columns = ["doc_id", "chunk_index", "chunk_id", "text", "section", "boundary", "overlap", "part", "parts", "chunk_score", "previous_chunk_id", "next_chunk_id", "section_position", "section_chunks"]
    assert sorted(map(tuple, a.select(columns).collect()), key=repr) == sorted(map(tuple, b.select(columns).collect()), key=repr) and a.count() > 8


def test_section_ids(spark):
    c = spark.createDataFrame([(1, k, f"c{k:02}", "s", 1, 1) for k in range(20)], "doc_id bigint, chunk_index bigint, chunk_id string, section string, page_start bigint, page_end bigint")
    got = {r.chunk_id: r.same_section_ids for r in C.links(c).collect()}
    first = [f"c{k:02}" for k in range(13)]
    assert all(ids == [x for x in first if x != k][:12] for k, ids in got.items())


@pytest.mark.parametrize("value,unit,want", [("25", "mm", ("mm", "length", "m", 0.025)), ("3", "barg", ("bar", "pressure", "pa", 300000.0)), ("1:100", "", ("", "ratio", "ratio", 0.01)), ("1/0", "", ("", "ratio", "ratio", None)), ("60", "rpm", ("rpm", "frequency", "hz", 1.0)), ("4", "widgets", ("widgets", "other", "widgets", 4.0)), ("7", "", ("", "number", "", 7.0))])
def test_units(spark, value, unit, want):
    r = E.canonical_units(spark.createDataFrame([(value, unit)], "value string, unit string")).first()
    assert (r.normalized_unit, r.family, r.canonical_unit, r.canonical_value) == want


def test_language_and_access(spark):
    df = spark.createDataFrame([(1, "the valve is in the pipe"), (2, "नमस्ते दुनिया"), (3, "Привет мир"), (4, ""), (5, None)], "id int, text string")
    assert [r.language_code for r in E.language(df).orderBy("id").collect()] == ["en", "hi", "ru", "unknown", "unknown"]
    df = spark.createDataFrame([(1, "Company CONFIDENTIAL draft"), (2, "plain"), (3, "controlled copy, mail a@b.com"), (4, None)], "id int, text string")
    got = E.access(df).orderBy("id").collect()
    assert [r.classification for r in got] == ["confidential", "unclassified", "controlled", "unclassified"] and got[2].redactions == ["distribution_notice", "email_address"]
    assert [r.id for r in E.visible_to(E.access(df), ["engineer"]).orderBy("id").collect()] == [2, 4]


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "The Emergency Shutdown (ESD) system and PSV (Pressure Safety Valve), HVAC, XQZ.")], "id int, text string")
    got = {r.abbr: (r.expansion, r.source) for r in E.abbreviations(df, "id").collect()}
    assert got["ESD"][1] == "explicit_definition" and got["PSV"] == ("Pressure Safety Valve", "explicit_definition") and got["HVAC"][1] == "known_dictionary" and got["XQZ"][1] == "unknown_acronym"


QUESTIONS = [("What about page 4?", "follow_up"), ("Is it hot? Why?", "multi_part"), ("Show the table rows", "table_numeric"), ("Is the pump red?", "yes_no"), ("Where is the pump?", "location_section"), ("Compare pumps", "comparison"), ("pump", "messy_language"), ("Explain the pump", "explanation"), ("Is it in a known notion", "yes_no"), ("calculate flow", "calculation"), ("", "messy_language"), (None, "messy_language")]


@pytest.mark.parametrize("question,want", QUESTIONS)
def test_question_types(spark, question, want):
    assert one(spark, question, Q.question_type) == want


def test_every_type_has_a_route_and_profile(spark):
    assert {p[7] for p in vocab.PROFILES} <= set(vocab.ROUTES) and len(vocab.PROFILES) == 40 and len(vocab.ROUTES) == 21
    for kind, *_, route in vocab.PROFILES:
        df = spark.createDataFrame([("zzz",)], "q string")
        assert df.select(Q.question_route(F.col("q"), F.lit(kind)).alias("r")).first().r == route


@pytest.mark.parametrize("pattern,question", [("table", "the table"), ("hybrid", "isolation valve"), ("multimodal", "figure"), ("agentic_iterative", "conflict"), ("time_aware", "latest revision"), ("keyword_sparse", "asme code"), ("graph", "upstream of")])
def test_routes_by_words(spark, pattern, question):
    assert one(spark, question, lambda q: Q.question_route(q, F.lit("direct_fact"))) == pattern


def test_self_query(spark):
    f = Q.self_query(F.col("q"))
    r = spark.createDataFrame([('See section 4.2 on page 7 rev B of "main file" per ISO 9001, table value',)], "q string").select(*[v.alias(k) for k, v in f.items()]).first()
    assert r.sections == ["4.2"] and r.pages == ["7"] and r.revisions == ["B"] and r.quoted == ["main file"] and r.standards == ["ISO 9001"] and r.content_types == ["table"] and "numeric" in r.flags


def test_scores_are_bounded(spark):
    p = Q.plan(spark, "Which relief valve is required in 'section four'?")
    df = spark.createDataFrame([("relief valve shall be required section four " * 50, "relief", 0.9), ("", "", -1.0)], "text string, section string, v double")
    s, sec, v = F.col("text"), F.col("section"), F.col("v")
    got = df.select(V.keyword_score(p, s).alias("k"), V.phrase_score(p, s).alias("p"), V.rerank_score(p, s, sec, v, F.lit(True)).alias("r"), V.capability_score(p, s, {"section": sec}).alias("c"), V.metadata_score(p, sec).alias("m"), V.table_score(p, s, F.lit(True), sec, s, F.lit(9), F.lit(1.0)).alias("t")).collect()
    assert got[0].p == 1.0 and all(0 <= x <= 1 for row in got for x in row) and got[1].k == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, None], "b"), ([0.0, 0.0], "x"), ([float("nan"), 2.0, 1.0, 1.0], "y")], "v array<double>, t string")
    got = [r.u for r in df.select(V.valid_vector(F.col("v"), 3).alias("u")).collect()]
    assert got[0] == [0.6, 0.8, 0.0] and got[1] == [0.0, 0.0, 0.0] and abs(sum(x * x for x in got[2]) - 1) < 1e-12
    v = V.hash_vector("The valve, the pipe.")
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and V.hash_vector("") == [0.0] * V.DIMENSIONS
    texts = spark.createDataFrame([(1, "apache license"), (2, "other words"), (3, "apache license version")], "id bigint, text string")
    s = {r.id: r.s for r in texts.select("id", V.md5_cosine(F.col("text"), "apache license").alias("s")).collect()}
    assert abs(s[1] - 1) < 1e-9 and s[3] > s[2]
    for t in ("a b a b c", "", None, " ", "the " * 9 + "valve"):
        v, q = V.md5_vector(t or ""), V.md5_vector("a valve c")
        got = spark.createDataFrame([(t,)], "t string").select(V.md5_cosine(F.col("t"), "a valve c").alias("s")).first().s
        assert abs(got - sum(x * q.get(k, 0.0) for k, x in v.items())) < 1e-9


def test_expansion(spark):
    rows = [(d * 100 + k, d, k, 1.0 / (d + k + 1), f"{d}.{k} t") for d in range(3) for k in range(8)]
    s = spark.createDataFrame(rows, "id bigint, document_id bigint, chunk_index bigint, score double, section string")
    best = V.ranked(s, 2)
    w = V.with_window(best, s, 2, 8).collect()
    assert {r.id for r in w} >= {0, 1, 2, 3} and w[0].id == 0
    assert [r.section for r in V.siblings_first(V.ranked(s, 10), 4).collect()] == ["0.0 t", "0.1 t", "0.2 t", "0.3 t"]
    assert V.diversified(s.withColumn("section", F.col("document_id").cast("string")), 5).filter("place <= 3").select("section").distinct().count() == 3


def test_graph(spark):
    chain = spark.createDataFrame([("a", "b", "connected to", 1), ("b", "c", "x", 2), ("c", "d", "x", 3), ("d", "e", "x", 4)], "left string, right string, relation string, chunk_id bigint")
    seeds = spark.createDataFrame([("a",)], "node string")
    e = V.both_ways(chain)
    assert {r.node: r.distance for r in V.expanded(e, seeds, 2, 24).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node for r in V.expanded(e, seeds, 3, 32, True).collect()} == set("abcd")
    hub = spark.createDataFrame([("h", f"n{k:03}", "x", k) for k in range(50)], "left string, right string, relation string, chunk_id bigint")
    assert V.expanded(hub, spark.createDataFrame([("h",)], "node string"), 1, 32).count() == 33
    names = spark.createDataFrame([(1, f"e{k:02}") for k in range(11)], "chunk_id bigint, name string")
    assert V.cooccurrence_edges(names).count() == 24


def test_answers(spark):
    c = spark.createDataFrame([(1, "what pressure is required", 1, "The pressure shall be nine bar at all times. Another sentence of no use to anyone here."), (1, "what pressure is required", 2, "A pressure gauge is required near the outlet of the pump.")], "question_id bigint, question string, rank int, text string")
    a = A.extractive(c).first().answer
    assert a.startswith("- A pressure gauge is required near the outlet of the pump. [S2]") and a.count("\n") == 2
    df = spark.createDataFrame([("the relief valve opens", "the relief valve opens at nine bar"), ("", "x"), ("unrelated XQ-11 claim", "words")], "a string, c string")
    got = df.select(A.grounding(A.terms(F.col("a")), A.terms(F.col("c"))).alias("g"), A.hallucination_control(A.terms(F.col("a")), A.terms(F.col("c"))).alias("h")).collect()
    assert [r.g for r in got] == [1.0, 0.0, 0.0] and got[0].h == 1.0 and got[2].h < 0.6


@pytest.mark.parametrize("score,want", [(0.74, "enterprise-ready"), (0.58, "usable-check"), (0.42, "needs-review"), (0.41, "weak")])
def test_grades(spark, score, want):
    assert spark.range(1).select(A.grade(F.lit(score)).alias("g")).first().g == want


def test_catalog(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id bigint, k string, v int")
    assert {(r.k, r.v) for r in R.upserted(rows, ["k"], ["v"]).collect()} == {("a", 2), ("b", 1)}
    fresh = spark.createDataFrame([(None, "c", 9), (None, "d", 8)], "id bigint, k string, v int")
    assert {(r.id, r.k) for r in R.appended(rows, fresh, "k").collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d")}
    docs = spark.createDataFrame([(1,), (2,)], "id bigint")
    chunks = spark.createDataFrame([(1, 1), (1, 2)], "document_id bigint, chunk_index int")
    assert {(r.id, r.chunk_count) for r in R.list_documents(docs, chunks).collect()} == {(1, 2), (2, 0)}


def test_links(spark):
    chunks = spark.createDataFrame([(1, f"c{k}", k, f"4.{k}") for k in range(4)], "doc_id bigint, chunk_id string, chunk_index int, section_id string")
    refs = spark.createDataFrame([(1, "c0", "4.2", "section"), (1, "c1", "4.2", "section"), (1, "c2", "4.2", "section"), (1, "c3", "9.9", "section")], "doc_id bigint, chunk_id string, key string, kind string")
    got = {r.chunk_id: (r.outbound, r.inbound, r.inbound_count) for r in C.document_links(chunks, refs).collect()}
    assert got["c0"] == (["c2"], [], 0) and got["c2"] == ([], ["c0", "c1"], 2) and got["c3"] == ([], [], 0)


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e.repartition(3).write.parquet(src)
    q = Z.type_counts(Z.normalized(Z.read(spark, src))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, Z.type_counts(Z.normalized(e)).collect()))


def test_dead_letters(spark, tmp_path):
    src, dead, seen = str(tmp_path / "in"), str(tmp_path / "dead"), []
    spark.createDataFrame([(1, None, 1, "error", 1.0, "{}"), (2, None, 1, "click", 1.0, "{}")], Z.SCHEMA).write.parquet(src)

    def broken(rows):
        raise ValueError("no")

    Z.publish(Z.read(spark, src), {"*": lambda rows: seen.append(rows.count()), "error": broken}, dead, str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 2 and [(r.event_id, r.handler, r.error) for r in spark.read.parquet(dead).collect()] == [(1, "error", "no")]
