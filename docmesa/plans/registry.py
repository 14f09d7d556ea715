"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Tables with much to compute for each row.
HEAVY = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; heavy ones that come in fewer splits than there are cores (a small file with one row group) are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores:
        df = df.repartition(cores)
    return df


def _load() -> None:
    from docmesa.plans import queries_answers, queries_catalog, queries_components, queries_enrich, queries_entities, queries_planning, queries_retrieval, queries_surfaces, queries_text  # noqa: F401


_load()
