"""Queries over answers: an assistant's turn answers the user's turn before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.operators import answer as A
from docmesa.plans import question as Q
from docmesa.plans.registry import query, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("question", F.lag(F.when(F.col("role") == "user", F.col("text"))).over(w))
    return c.filter("role = 'assistant' and question is not null").select("conv_id", "turn", "question", F.col("text").alias("answer"))


_PAIRS = "(SELECT conv_id, turn, question, text AS answer FROM (SELECT *, lag(CASE WHEN role = 'user' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations) WHERE role = 'assistant' AND question IS NOT NULL)"
_STOPS = ", ".join(f"'{w}'" for w in vocab.STOPWORDS)


def _terms(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9_.&/-]{{2,}}'), lambda t: t NOT IN ({_STOPS})))"


_T = f"(SELECT conv_id, turn, question, answer, {_terms('answer')} AS a, {_terms('question')} AS q FROM {_PAIRS})"


@query(f"SELECT conv_id, turn, CAST(round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, q)) / len(a) END * 1e6) AS BIGINT) AS grounding FROM {_T}")
def grounding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("a", A.terms(F.col("answer"))).withColumn("q", A.terms(F.col("question")))
    return p.select("conv_id", "turn", T.micro(A.grounding(F.col("a"), F.col("q"))).alias("grounding"))


_LOOSE = "list_filter(a, lambda t: NOT list_contains(q, t))"


@query(f"SELECT conv_id, turn, CAST(round((1.0 - least(1.0, len(list_filter({_LOOSE}, lambda t: regexp_matches(t, '[0-9]|[-_/&.]') OR t IN ({', '.join(repr(t) for t in A.TECHNICAL)}))) * 0.18 + len({_LOOSE}) / greatest(1, len(a)) * 0.45)) * 1e6) AS BIGINT) AS control FROM {_T}")
def hallucination_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("a", A.terms(F.col("answer"))).withColumn("q", A.terms(F.col("question")))
    return p.select("conv_id", "turn", T.micro(A.hallucination_control(F.col("a"), F.col("q"))).alias("control"))


_N = "len(list_filter(string_split_regex(trim(answer), '\\s+'), lambda w: w != ''))"


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(question), '^(is|are|does|do|can|shall|should) ') THEN 'yes/no with explanation' WHEN regexp_matches(lower(question), 'list|requirements|constraints|steps|points') THEN 'bullet list' WHEN regexp_matches(lower(question), 'compare|difference|versus|vs') THEN 'comparison' ELSE 'short engineering paragraph' END AS style, {_N} AS words FROM {_PAIRS}")
def answer_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", A.desired_style(F.col("question")).alias("style"), A.n_words(F.col("answer")).cast("bigint").alias("words"))


@query("SELECT o_orderkey AS id, CASE WHEN n = 0 THEN 'not_enough' WHEN q >= 0.82 AND s >= 0.45 THEN 'strong' WHEN q >= 0.6 OR s >= 0.25 THEN 'usable' WHEN q >= 0.35 OR s > 0 THEN 'weak' ELSE 'not_enough' END AS status FROM (SELECT o_orderkey, o_totalprice / 500000 AS s, o_custkey % 5 AS n, (o_orderkey % 100) / 100.0 AS q FROM orders)")
def evidence_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = A.evidence_status(F.col("o_totalprice") / 500000, F.col("o_custkey") % 5, (F.col("o_orderkey") % 100) / 100.0, F.lit("an answer"))
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"))


@query("SELECT c_custkey AS id, CASE WHEN s >= 0.74 THEN 'enterprise-ready' WHEN s >= 0.58 THEN 'usable-check' WHEN s >= 0.42 THEN 'needs-review' ELSE 'weak' END AS grade FROM (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS s FROM customer)")
def answer_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), A.grade((F.col("c_acctbal") + 1000) / 11000).alias("grade"))


@query("WITH c AS (SELECT l_orderkey AS q, l_linenumber AS id, l_extendedprice / 1e5 AS score FROM lineitem), r AS (SELECT *, max(score) OVER (PARTITION BY q) AS top, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM c), a AS (SELECT *, max(CAST(score >= greatest(0.18, top * 0.68) AS INT)) OVER (PARTITION BY q) AS h FROM r) SELECT q AS question_id, id FROM a WHERE (score >= greatest(0.18, top * 0.68) AND r <= 4) OR (h = 0 AND r <= 2)")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("id"), (F.col("l_extendedprice") / 1e5).alias("score"))
    return A.context_window(li, 4).select("question_id", "id")


@query("SELECT source, count(*) AS contexts, count(*) FILTER (WHERE contains(text, ' | ')) AS tables, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS numeric FROM documents GROUP BY source")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.signal_counts(table(spark, sf_dir, "documents"), "source").select("source", "contexts", "tables", "numeric")


@query()
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks and the grade of each answer, its question as context."""
    p = _pairs(spark, sf_dir).withColumn("clean", A.without_citations(F.col("answer"))).withColumn("kind", Q.question_type(F.col("question")))
    p = p.withColumn("a", A.terms(F.col("clean"))).withColumn("q", A.terms(F.col("question")))
    a, q, text, ask = F.col("a"), F.col("q"), F.col("clean"), F.col("question")
    g = A.grounding(a, q)
    checks = {"grounding": g, "hallucination": A.hallucination_control(a, q), "specificity": A.specificity(text, ask), "context": F.least(F.lit(1.0), F.size(F.array_intersect(a, q)) / F.greatest(F.lit(1), F.size(q)) * 0.55 + 0.45), "retrieval": A.retrieval_quality(F.lit(0.5), F.lit(0.5), F.lit(1.0)), "type_fit": A.type_fit(F.col("kind"), ask, text), "over_generation": A.over_generation_control(text, A.n_words(ask), F.col("grounding")), "style": A.style(ask, text)}
    # each check is a column before the grade uses it, so none is computed twice
    p = p.withColumn("grounding", g).withColumns({k: v for k, v in checks.items() if k != "grounding"})
    p = p.withColumn("overall", A.overall({k: F.col(k) for k in checks}))
    return p.select("conv_id", "turn", "kind", *[T.micro(F.col(k)).alias(k) for k in checks], T.micro(F.col("overall")).alias("overall"), A.grade(F.col("overall")).alias("grade"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to benchmark items from the documents that hold half of their words."""
    from docmesa.plans.queries_text import benchmark_overlap

    o = benchmark_overlap(spark, sf_dir)
    r = o.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "doc_id"))).filter("rank <= 4")
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    c = r.join(d, "doc_id").join(b, "item_id").select(F.col("item_id").alias("question_id"), "question", "rank", "text")
    return A.extractive(c)
