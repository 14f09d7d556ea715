"""Queries over entities, relations, hops, changes, tables in text and the chat flow. Words of the driver's prose stand in for terms of plants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.operators import blocks as B
from docmesa.operators import catalog as R
from docmesa.operators import chat as H
from docmesa.operators import classify as K
from docmesa.operators import entities as E
from docmesa.operators import retrieval as V
from docmesa.plans.queries_enrich import _SCRIPT, _TOTAL
from docmesa.plans.queries_retrieval import line_chunks
from docmesa.plans.registry import query, table

TYPES = [("licence", ["license", "apache", "terms", "copyright"]), ("work", ["work", "version", "software"])]
_TERMS = [(t, k) for k, ts in TYPES for t in ts]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _count(term: str) -> str:
    return f"len(regexp_extract_all(t, '(^|[^a-z0-9]){term}s?([^a-z0-9]|$)'))"


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS canonical, '{k}' AS type, {_count(t)} AS mentions FROM (SELECT doc_id, lower(text) AS t FROM documents)" for t, k in _TERMS) + ") WHERE mentions > 0")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.entities(_documents(spark, sf_dir), "doc_id", types=TYPES).filter("source = 'pattern'").select("doc_id", "canonical", "type", "mentions")


_HITS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS canonical, '{k}' AS type, {_count(t)} AS mentions FROM (SELECT doc_id, lower(text) AS t FROM documents)" for t, k in _TERMS) + ") WHERE mentions > 0"


_PLAIN = "text"
for _p in vocab.STANDARDS:
    _PLAIN = f"regexp_replace({_PLAIN}, '(?i)\\b{_p}', ' ', 'g')"
_TAGS = f"list_slice(list_distinct(list_filter(list_transform(regexp_extract_all({_PLAIN}, '{vocab.IDENTIFIER}'), lambda s: regexp_replace(s, '^[-_]+|[-_]+$', '', 'g')), lambda s: length(s) >= 5)), 1, 30)"
_STANDARDS = "list_slice(list_distinct(" + " || ".join(f"list_transform(regexp_extract_all(text, '(?i)\\b{_p}'), lambda s: upper(s))" for _p in vocab.STANDARDS) + "), 1, 20)"
_SHORT = " + ".join(f"CAST(regexp_matches(text, '\\b{a.upper()}\\b') AS INT)" for a in dict.fromkeys(E.ALIASES))


@query(f"SELECT doc_id, n + s + len(i) + len(g) AS entities, n + s + len(i) + len(g) AS high_confidence, len(i) AS identifiers, len(g) AS standards FROM (SELECT doc_id, ({' + '.join(f'CAST({_count(t)} > 0 AS INT)' for t, _ in _TERMS)}) AS n, ({_SHORT}) AS s, {_TAGS} AS i, {_STANDARDS} AS g FROM (SELECT doc_id, text, lower(text) AS t FROM documents)) WHERE n + s + len(i) + len(g) > 0")
def entity_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.facets(E.entities(_documents(spark, sf_dir), "doc_id", types=TYPES), "doc_id")


@query()
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("under the"), F.lit("connected to")))
    return E.relations(d, E.entities(d, "doc_id", types=TYPES), "doc_id")


@query(f"WITH h AS ({_HITS}) SELECT 'entity:' || canonical AS key, canonical AS label, count(DISTINCT doc_id) AS chunks, count(*) AS mentions FROM h GROUP BY canonical")
def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    found = E.entities(d, "doc_id", types=TYPES).filter("source = 'pattern'")
    nodes, _ = E.graph_records(found, E.relations(d, found, "doc_id"), "doc_id")
    return V.merged_nodes(nodes).select("key", "label", "chunks", "mentions")


@query("""WITH d AS (SELECT doc_id, source, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS previous, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '\\b[0-9]+\\s*/\\s*[0-9]+\\b', ' ', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda w: w != '')) AS w, trim(regexp_replace(regexp_replace(lower(text), '\\b[0-9]+\\s*/\\s*[0-9]+\\b', ' ', 'g'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS n FROM documents),
p AS (SELECT a.doc_id AS id, b.doc_id AS previous, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y, a.n = b.n AS same FROM d a JOIN d b ON a.previous = b.doc_id), s AS (SELECT id, previous, same, CASE WHEN x = 0 AND y = 0 THEN 1.0 WHEN x = 0 OR y = 0 THEN 0.0 ELSE i / (x + y - i) END AS s FROM p)
SELECT id, previous, CAST(round(s * 1e6) AS BIGINT) AS similarity, CASE WHEN same THEN 'unchanged' WHEN s >= 0.82 THEN 'minor_or_format_change' WHEN s >= 0.45 THEN 'possibly_changed' ELSE 'changed' END AS status FROM s""")
def change_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.change_keys(_documents(spark, sf_dir)).withColumnRenamed("doc_id", "id")
    before = R.previous_versions(d.select("id", "source"), "source", "id", n=1).select("id", "previous")
    return E.changes(d, before).select("id", "previous", T.micro(F.col("similarity")).alias("similarity"), "status")


@query()
def promoted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.promote_tables(B.lines_as_blocks(_documents(spark, sf_dir))).filter("kind = 'table'")


_SHARES = ", ".join([f"round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(1, {_TOTAL}), 4)", *[f"round({v} / greatest(1, {_TOTAL}), 4)" for v in _SCRIPT.values()]])
_GLOSSED = " OR ".join(f"contains(text, '{k}')" for k in E.GLOSSARY)


@query(f"WITH s AS (SELECT doc_id, text, [{_SHARES}] AS s FROM documents), n AS (SELECT doc_id, text, CASE WHEN trim(text) != '' AND s[1] > 0 THEN 'en' ELSE 'unknown' END AS language_code, len(list_filter(s, lambda x: x >= 0.12)) > 1 AS needed, {_GLOSSED} AS glossed FROM s) SELECT doc_id, language_code, CASE WHEN NOT needed THEN 'not_required' WHEN glossed THEN 'partial_engineering_glossary_translation' ELSE 'translation_metadata_ready_no_engine' END AS translation_status, CAST(CASE WHEN NOT needed THEN 1.0 WHEN glossed THEN 0.48 ELSE 0.2 END AS DOUBLE) AS translation_confidence FROM n")
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmesa.operators.enrich import language

    return E.translation(language(_documents(spark, sf_dir))).select("doc_id", "language_code", "translation_status", "translation_confidence")


@query("SELECT doc_id, CAST(round(round(least(0.18, (CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'version') AS INT)) / 2.0 * 0.045 * 1.3 + CASE WHEN contains(text, ' | ') THEN 0.025 * 1.3 ELSE 0.0 END + CASE WHEN contains(text, ' | ') OR contains(lower(text), 'license') OR contains(lower(text), 'version') THEN 0.018 ELSE 0.0 END), 5) * 1e6) AS BIGINT) AS score FROM documents")
def decomposition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.decomposition_score([("table_numeric", ["license", "version"], 1.3)], F.col("text"), {"table": F.contains("text", F.lit(" | "))})
    return _documents(spark, sf_dir).select("doc_id", T.micro(s).alias("score"))


@query("SELECT doc_id, CAST(round(round(least(0.22, a * 0.065 + CASE WHEN contains(t, 'semantic context') THEN 0.025 ELSE 0.0 END + (b / 2.0 * 0.065 + CASE WHEN contains(t, 'connected context') THEN 0.025 ELSE 0.0 END) * 1.06 + 0.008 + least(0.06, (CASE WHEN a >= 0.34 OR contains(t, 'semantic context') THEN 1 ELSE 0 END + CASE WHEN b / 2.0 >= 0.34 OR contains(t, 'connected context') THEN 1 ELSE 0 END) * 0.018)), 5) * 1e6) AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS t, CAST(contains(lower(text), 'license') AS INT) AS a, CAST(contains(lower(text), 'version') AS INT) + CAST(contains(lower(text), 'apache') AS INT) AS b FROM documents)")
def hop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.multi_hop_score([("semantic_evidence", "semantic_context", ["license"], 1.0), ("relationship_evidence", "connected_context", ["version", "apache"], 1.06)], F.col("text"), {}, F.lit(1))
    return _documents(spark, sf_dir).select("doc_id", T.micro(s).alias("score"))


@query()
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow for a few kinds of questions; one row each."""
    chunks = line_chunks(spark, sf_dir)
    asked = ["Which license version is required for the apache software?", "Is it safe to operate under the license?", "How confident are you about the license?"]
    rows = []
    for q in asked:
        r = H.chat(chunks, q)
        rows.append((q, r["kind"], r["route"], r["answer"], len(r["sources"]), r["quality"]["grade"], r["quality"]["evidence"]))
    return spark.createDataFrame(rows, "question string, kind string, route string, answer string, sources bigint, grade string, evidence string")
