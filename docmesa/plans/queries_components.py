"""Queries over classes, importance, quality, ontology and rules of wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.operators import classify as K
from docmesa.plans.registry import query, table
from docmesa.sources import readers as S


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _n(terms: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), {_lit(t)}) AS INT)" for t in terms)


_SCORES = ", ".join(f"round(least(1.0, ({_n(terms)}) * {0.11 * w!r} + CASE WHEN ({_n(terms)}) > 0 THEN 0.12 ELSE 0.0 END), 4) AS c{i}" for i, (_, w, terms) in enumerate(K.CLASSES))
_NAMES = "[" + ", ".join(_lit(n) for n, _, _ in K.CLASSES) + "]"
_LIST = "[" + ", ".join(f"c{i}" for i in range(len(K.CLASSES))) + "]"


@query(f"SELECT doc_id, {_NAMES}[list_position(s, list_max(s))] AS document_class, CAST(round(list_max(s) * 1e6) AS BIGINT) AS score, CAST(round(round(least(1.0, 0.35 + list_max(s) * 0.45 + (list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2]) * 0.35), 3) * 1e6) AS BIGINT) AS confidence FROM (SELECT doc_id, {_LIST} AS s FROM (SELECT doc_id, {_SCORES} FROM documents))")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.document_class(_documents(spark, sf_dir), F.col("text"))
    return d.select("doc_id", "document_class", T.micro(F.col("class_score")).alias("score"), T.micro(F.col("class_confidence")).alias("confidence"))


_TITLE = "least(0.2, " + " + ".join(f"CASE WHEN contains(lower(text), {_lit(k)}) THEN {w} ELSE 0.0 END" for k, w in K.TITLE_TERMS.items()) + ")"


@query(f"SELECT doc_id, CAST(round(round(greatest(0.0, least(1.0, 0.12 + {_TITLE} + CASE WHEN contains(text, ' | ') THEN 0.08 ELSE 0.0 END + least(0.1, len(regexp_extract_all(text, '[0-9]+')) * 0.025) - CASE WHEN len(string_split(text, ' ')) < 35 THEN 0.06 ELSE 0.0 END)), 3) * 1e6) AS BIGINT) AS importance FROM documents")
def title_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = {"table": F.contains("text", F.lit(" | ")), "numbers": F.regexp_count("text", F.lit(r"[0-9]+"))}
    return _documents(spark, sf_dir).select("doc_id", T.micro(K.section_importance(F.col("text"), facts, F.size(F.split("text", " ")))).alias("importance"))


_W = K.QUALITY_WEIGHTS
_FULL = sum(v for k, v in _W.items() if k not in ("text_presence", "table", "semantic"))


@query(f"SELECT doc_id, CAST(round(round(least(1.0, {_FULL!r} + {_W['text_presence']} * least(1.0, len(string_split(text, ' ')) / 8.0) + {_W['table']} * CASE WHEN contains(text, ' | ') THEN 0.5 ELSE 1.0 END + {_W['semantic']} * 0.49), 3) * 1e6) AS BIGINT) AS quality, contains(text, ' | ') OR len(string_split(text, ' ')) < 2 AS unanswerable FROM documents")
def ingestion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {k: F.lit(1.0) for k in _W} | {"text_presence": F.least(F.lit(1.0), F.size(F.split("text", " ")) / 8.0), "table": F.when(F.contains("text", F.lit(" | ")), 0.5).otherwise(1.0), "semantic": F.lit(0.49)}
    q = K.ingestion_quality(parts)
    return _documents(spark, sf_dir).select("doc_id", T.micro(q["score"]).alias("quality"), (~q["answerable"]).alias("unanswerable"))


_ASCII = r"regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g')"


@query("SELECT doc_id, " + ", ".join(f"least(8, {' + '.join(f'len(regexp_extract_all(t, {_lit(p)}))' for p in patterns)}) AS {name}" for name, _, patterns in K.RULES if name in ("condition", "permission", "obligation", "numeric_constraint")) + f" FROM (SELECT doc_id, {_ASCII} AS t FROM documents)")
def wording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    h = K.rule_hits(F.col("text"))
    return d.select("doc_id", *[h[k].cast("bigint").alias(k) for k in ("condition", "permission", "obligation", "numeric_constraint")])


def _rule(patterns: list[str]) -> str:
    return f"least(8, {' + '.join(f'len(regexp_extract_all(t, {_lit(p)}))' for p in patterns)})"


_RULED = " + ".join(f"least(0.045, {_rule(patterns)} * {0.014 * weight * (1.35 if name == 'condition' else 1.0)!r})" for name, weight, patterns in K.RULES)


@query(f"SELECT doc_id, CAST(round(round(least(0.18, {_RULED} + least(0.04, (CAST(contains(t, 'license') AS INT) + CAST(contains(t, 'version') AS INT)) * 0.006)), 5) * 1e6) AS BIGINT) AS score FROM (SELECT doc_id, {_ASCII} AS t FROM documents)")
def symbolic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return d.select("doc_id", T.micro(K.symbolic_score(["condition"], ["license", "version"], F.col("text"))).alias("score"))


def _found(terms: list[str]) -> str:
    """How many terms a text has: phrases between other characters than letters and digits, words with a plural s."""
    quote = lambda t: t.replace(".", "\\.")
    one = lambda t: rf"(^|[^a-z0-9]){quote(t)}([^a-z0-9]|$)" if set(t) & set(" -/") else rf"\b{quote(t)}s?\b"
    return "(" + " + ".join(f"CAST(regexp_matches(t, {_lit(one(t))}) AS INT)" for t in dict.fromkeys(terms)) + ")"


_QUESTION = "Which relief valve needs a code?"
_NAMED = K.concepts_of(_QUESTION)
_OWN = " + ".join(f"least(0.06, {_found([n, *s])} * 0.022 + {_found(b)} * 0.012 + {_found(r)} * 0.008)" for n, s, b, r in K.ONTOLOGY if n in _NAMED)


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {_found([n, *s])} > 0 THEN {_lit(n)} END' for n, s, _, _ in K.ONTOLOGY)}], lambda x: x IS NOT NULL), ',') AS concepts, CAST(round(round(least(0.18, {_OWN} + least(0.05, {_found(K.expansion_terms(_NAMED))} * 0.006)), 5) * 1e6) AS BIGINT) AS score FROM (SELECT doc_id, {_ASCII} AS t FROM documents)")
def ontology_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return d.select("doc_id", F.array_join(K.concepts(F.col("text")), ",").alias("concepts"), T.micro(K.ontology_score(_NAMED, F.col("text"))).alias("score"))


@query("SELECT doc_id, CAST(round(round(least(0.20, CASE WHEN doc_id IN (1, 2, 3) THEN 0.14 ELSE 0.0 END + CASE WHEN source = 'src1' THEN 0.035 ELSE 0.0 END + least(0.05, (CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'version') AS INT)) * 0.006)), 5) * 1e6) AS BIGINT) AS score FROM documents")
def memory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {"source_ids": [1, 2, 3], "filenames": ["src1"], "terms": ["license", "version"]}
    return _documents(spark, sf_dir).select("doc_id", T.micro(K.memory_score(plan, F.col("doc_id"), F.col("source"), F.lit(""), F.col("text"))).alias("score"))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_texts(table(spark, sf_dir, "pages"))
