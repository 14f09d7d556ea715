"""Queries over the relational layer and events. Customers stand in for owners, orders for documents, line items for chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.operators import catalog as R
from docmesa.plans.registry import query, table
from docmesa.streaming import events as Z


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filename"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("bigint").alias("chunk_index"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("score"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("turn").alias("id"), "role", "text")


@query("SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM lineitem) AS chunks, (SELECT count(*) FROM conversations) AS logs")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index_status(_documents(spark, sf_dir), _chunks(spark, sf_dir), _messages(spark, sf_dir))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, count(l_orderkey) AS chunk_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_documents(_documents(spark, sf_dir).select("id", "status"), _chunks(spark, sf_dir))


@query("SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, o_orderstatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).filter("status = 'F'")
    return R.chunks_with_documents(_chunks(spark, sf_dir), d).select("document_id", "chunk_index", "status")


@query("SELECT document_id, chunk_index FROM (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, o_orderpriority, lower(l_returnflag || ' ' || l_linestatus) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE (lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%high%') AND (t LIKE '%r f%' OR t LIKE '%a f%') ORDER BY document_id DESC, chunk_index LIMIT 80")
def dynamic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.chunks_with_documents(_chunks(spark, sf_dir), _documents(spark, sf_dir))
    return R.lookup(c, {"filename": ["urgent", "high"]}, terms=("r f", "a f")).select("document_id", "chunk_index")


@query("SELECT c_mktsegment AS segment, c_custkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("latest"), "c_acctbal")
    return R.upserted(c, ["segment"], ["c_acctbal", "latest"]).select("segment", "latest")


@query("SELECT max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS session FROM orders WHERE o_orderstatus = 'O'")
def active_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "O").alias("active"))
    return R.active_session(s)


@query("SELECT conv_id AS session_id, n AS messages, CASE WHEN length(p) <= 88 THEN p ELSE rtrim(p[1:85]) || '...' END AS preview FROM (SELECT conv_id, count(*) AS n, trim(regexp_replace(max_by(text, turn), '\\s+', ' ', 'g')) AS p, max(turn) AS t FROM conversations GROUP BY conv_id ORDER BY t DESC, conv_id LIMIT 30)")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.list_chat_sessions(_messages(spark, sf_dir))


@query("SELECT conv_id AS session_id, turn AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_in_groups(_messages(spark, sf_dir), ["session_id"], ["id"], 6).select("session_id", "id")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(_documents(spark, sf_dir), ["created_at", "id"], 50).select("id")


@query("SELECT a.doc_id AS id, b.doc_id AS previous, count(*) OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) AS rank FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id < a.doc_id QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) <= 40")
def history_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return R.previous_versions(d, "source", "id")


@query("SELECT source, count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, max(n_chars) AS longest, min_by(doc_id, struct_pack(a := -n_chars, b := doc_id)) AS longest_id FROM documents GROUP BY source")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.max("n_chars").alias("longest"), F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("longest_id"))


# --- events


@query("SELECT event_type, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY event_type")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.type_counts(Z.normalized(table(spark, sf_dir, "events"))).select("event_type", "events", "first_event", "last_event")


@query("SELECT event_id, event_type, CAST(round(greatest(0.0, least(100.0, value)) * 1e6) AS BIGINT) AS progress, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.normalized(table(spark, sf_dir, "events")).select("event_id", "event_type", T.micro(F.col("progress")).alias("progress"), F.coalesce("k", F.lit(-1)).alias("k"))


@query("SELECT user_id, event_type AS last_stage, event_id AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.last_stage(table(spark, sf_dir, "events"))


@query("SELECT event_id FROM events WHERE value < 0 OR event_type = 'error'")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = Z.routed(table(spark, sf_dir, "events"), (F.col("value") >= 0) & (F.col("event_type") != "error"))
    return bad.select("event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Z.tumbling(table(spark, sf_dir, "events"), "1 hour")
    return w.select("start", "event_type", "n", F.round(F.col("total") * 100).cast("bigint").alias("cents"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.sessions(table(spark, sf_dir, "events"), "1 hour")
