"""Queries against their SQL on rows that the driver's smallest tables do not hold."""

import duckdb
from docmesa.plans.registry import ORACLE, QUERIES


def both(spark, tmp_path, name, table, rows, columns):
    """Rows of the query and of its SQL over a table."""
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect())), sorted(found.fetchall())


ASKED = ["Doñez ñta del osjarr", "Isé la página", "Do you need that valve", "the valueñ of osjarr", "tablé or osjarr plan", "ñtag osjarr plan", "table\x0bosjarr plan", "osjarr plan\x0bis"]


def test_words_end_before_letters_outside_ascii(spark, tmp_path):
    rows = [(k, 0, "user", t) for k, t in enumerate(ASKED)]
    for name in ("question_profiles", "question_routes"):
        got, want = both(spark, tmp_path / name, name, "conversations", rows, "conv_id bigint, turn int, role string, text string")
        assert got == want
    assert want[0][2] == "yes_no" and want[3][3] == "table"


#: Null, blanks of all kinds, long words without vowels, a dotted capital I, and a carriage return or line feed between give and and.
ODD = [None, "", " " * 9, "\t" * 9, "\u00a0" * 9, "\u3000\n" * 5, "\x0b" * 9, "\u2028" * 9, "bcdfghjklmnp xkcdwwwqqqqqtz", "draw\u0130ng of osjarr", "L\u0130ST osjarr plan", "\u00a0what about osjarr", "\t\u2003 \u00a0Is osjarr plan", "\x0bis osjarr plan", "\u2028is osjarr plan", "osjarr that one\u00a0", "also osjarr", "osjarr and plan and zzz give\rand", "osjarr and plan and zzz give\nand", "osjarr and plan give\rand", "osjarr give\rand and also"]


def test_odd_questions_have_the_types_and_routes_of_the_sql(spark, tmp_path):
    rows = [(k, 0, "user", t) for k, t in enumerate(ODD)]
    for name in ("question_profiles", "question_routes"):
        got, want = both(spark, tmp_path / name, name, "conversations", rows, "conv_id bigint, turn int, role string, text string")
        assert got == want
    assert [want[k][2:] for k in (0, 3, 4, 8, 9, 11)] == [("direct_fact", "hybrid"), ("direct_fact", "hybrid"), ("messy_language", "multi_query"), ("direct_fact", "hybrid"), ("image_diagram", "multimodal"), ("follow_up", "memory")]


def test_tokens_in_any_number_give_the_same_score(spark, tmp_path):
    """A cosine of 1/4 by 27 times a third of 1/36 gives a score that lies between two millionths."""
    filler = ["aa"] * 23 + ["bb"] * 6 + ["cc", "dd"]
    rows = [(0, " ".join(["the"] * 27 + filler)), (1, " ".join(filler)), (2, ""), (3, "the " * 9)]
    got, want = both(spark, tmp_path, "route_scores", "documents", rows, "doc_id bigint, text string")
    assert got == want and dict(want)[0] == 137188


def test_numbers_beyond_64_bits(spark, tmp_path):
    """The row stays; its value in millionths is null, where the SQL stops by an overflow."""
    rows = [(1, "111662915952825 m and 25 bar"), (2, "9" * 400 + " mm"), (3, "99999999999999999999:3 m"), (4, "1:4")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.position, r.family, r.canonical_unit, r.canonical_value) for r in QUERIES["numeric_constraints"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, "length", "m", None), (1, 1, "pressure", "pa", 2500000000000), (2, 0, "length", "m", None), (3, 0, "ratio", "ratio", None), (4, 0, "ratio", "ratio", 250000)]
