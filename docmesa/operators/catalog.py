"""The relational layer: sessions, documents, chunks, chats and logs as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docmesa.sources.storage import written

_L, _S, _D, _T, _B = S.LongType(), S.StringType(), S.DoubleType(), S.TimestampType(), S.BooleanType()


def _table(**columns) -> S.StructType:
    return S.StructType([S.StructField(k, v) for k, v in columns.items()])


#: The persistent tables.
SCHEMAS = {
    "index_sessions": _table(session=_S, created_at=_T, active=_B),
    "documents": _table(id=_L, index_session=_S, filename=_S, content_type=_S, created_at=_T, chunk_count=_L),
    "chunks": _table(id=_L, document_id=_L, index_session=_S, chunk_index=_L, text=_S, embedding=S.ArrayType(S.FloatType()), metadata=S.MapType(_S, _S)),
    "chat_sessions": _table(id=_S, index_session=_S, title=_S, created_at=_T, updated_at=_T),
    "chat_messages": _table(id=_L, session_id=_S, role=_S, text=_S, payload=_S, created_at=_T),
    "chat_history": _table(id=_L, index_session=_S, question=_S, resolved_question=_S, answer=_S, sources=_S, created_at=_T),
    "retrieval_logs": _table(id=_L, index_session=_S, question=_S, answer=_S, top_score=_D, source_count=_L, created_at=_T),
}


def chunks_with_documents(chunks: DataFrame, documents: DataFrame, document_id: int | None = None) -> DataFrame:
    """Chunks joined with their documents, newest document first. Both: with index columns id and document_id."""
    d = documents.withColumnRenamed("id", "document_id")
    joined = chunks.join(d, "document_id")
    return joined if document_id is None else joined.filter(F.col("document_id") == document_id)


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with how many chunks they have, none included. Chunks are counted before the join."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return documents.join(counts, documents["id"] == counts["document_id"], "left").select(documents["*"], F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def list_chat_sessions(messages: DataFrame, limit: int = 30) -> DataFrame:
    """session_id, messages, latest text (at most 88 characters) by (created_at, id), most recent first. limit: 1 to 100."""
    one = F.trim(F.regexp_replace(F.max_by("text", F.struct("created_at", "id")), r"\s+", " "))
    cut = F.when(F.length("latest") <= 88, F.col("latest")).otherwise(F.concat(F.rtrim(F.substring("latest", 1, 85)), F.lit("...")))
    s = messages.groupBy("session_id").agg(F.count("*").alias("messages"), one.alias("latest"), F.max(F.struct("created_at", "id")).alias("last"))
    return s.orderBy(F.desc("last"), "session_id").limit(max(1, min(100, limit))).select("session_id", "messages", cut.alias("preview"))


def chat_session(messages: DataFrame, session_id) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", "id")


def latest(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n rows that come last by the columns, which should end with a key."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(n)


def latest_in_groups(rows: DataFrame, group: list[str], by: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def active_session(sessions: DataFrame) -> DataFrame:
    """The active session that was created last."""
    return sessions.filter("active").agg(F.max_by("session", F.struct("created_at", "session")).alias("session"))


def activate(sessions: DataFrame, session: str, created_at) -> DataFrame:
    """The sessions with a new one, which alone is active."""
    spark = sessions.sparkSession
    fresh = spark.createDataFrame([(session, created_at, True)], SCHEMAS["index_sessions"])
    return sessions.withColumn("active", F.lit(False)).unionByName(fresh)


def appended(rows: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Rows with others behind them, whose ids go on from the largest in the order of a column. The new rows are dealt into ranges, which number their own
    rows and begin where those before them end."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    dealt = written(fresh.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "fresh")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_range").count().select("_range", before.alias("_before"))  # a row for each range
    numbered = dealt.join(F.broadcast(starts), "_range").withColumn("_n", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return rows.unionByName(numbered.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n")).select(*rows.columns))


def upserted(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The latest version of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def reset(rows: DataFrame, session: str | None = None) -> DataFrame:
    """No rows, or those of other sessions."""
    return rows.limit(0) if session is None else rows.filter(F.col("index_session") != session)


def index_status(documents: DataFrame, chunks: DataFrame, logs: DataFrame) -> DataFrame:
    """One row of counts."""
    count = lambda d, name: d.agg(F.count("*").alias(name))
    return count(documents, "documents").crossJoin(count(chunks, "chunks")).crossJoin(count(logs, "logs"))


def ensured_session(sessions: DataFrame, session_id: str, title: str) -> DataFrame:
    """The title of a session, or a new one of at most 56 characters."""
    return sessions.filter(F.col("id") == session_id).agg(F.coalesce(F.max("title"), F.lit(title[:56])).alias("title")).withColumn("id", F.lit(session_id))


def any_like(column: Column, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(v.lower())) for v in values], F.lit(False))


def lookup(chunks: DataFrame, filters: dict[str, list[str]], flags: dict[str, bool] | None = None, terms: tuple[str, ...] = (), limit: int = 80) -> DataFrame:
    """Chunks for which every filtered column holds one of its values, every flag is set as wanted, and the text holds a term; newest document first.

    At most 8 filenames, 12 of any other value and 10 terms count.
    """
    most = {"filename": 8}
    tests = [any_like(F.col(c), v[: most.get(c, 12)]) for c, v in filters.items() if v]
    tests += [F.col(c) == F.lit(want) for c, want in (flags or {}).items()]
    if terms:
        tests.append(any_like(F.col("text"), list(terms[:10])))
    return chunks.filter(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy(F.desc("document_id"), "chunk_index").limit(limit)


def previous_versions(documents: DataFrame, key: str, order: str, n: int = 40) -> DataFrame:
    """(id, previous): for each document up to n earlier ones of the same name, the latest first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    earlier = F.reverse(F.collect_list("id").over(w))
    return documents.withColumn("_earlier", earlier).select("id", F.posexplode("_earlier").alias("rank", "previous")).withColumn("rank", (F.col("rank") + 1).cast("bigint"))


def unseen(rows: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Rows, and those of `more` whose key is not among them."""
    return rows.unionByName(more.join(rows.select(key), key, "left_anti").dropDuplicates([key]).select(*rows.columns))
