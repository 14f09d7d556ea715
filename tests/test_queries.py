"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _registry():
    from docmesa.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE


QUERIES, ORACLE = _registry()


#: Queries that plan or search several times.
SLOW = {"chat_answers", "flagship_chat_retrieval", "flagship_table_question", "near_duplicate_keep_first", "planned_queries"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_an_equivalent(spark, name):
    """Rows come, of the stated columns, the same ones a second time; what they hold is tested beside the operators."""
    df = QUERIES[name](spark, SF)
    first = df.collect()
    assert first and set(first[0].asDict()) == set(df.columns) and len(set(df.columns)) == len(df.columns)
    if name not in SLOW:
        assert sorted(map(repr, first)) == sorted(map(repr, QUERIES[name](spark, SF).collect()))


def test_entry(spark):
    import __spark_entry__

    a, b = __spark_entry__.entry(spark).collect(), __spark_entry__.entry(spark).collect()
    assert a and a == b
