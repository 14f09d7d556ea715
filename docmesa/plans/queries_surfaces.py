"""Queries over assembled facts, the texts of the indexes, keyphrases, tables with their contexts and protected duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.operators import blocks as B
from docmesa.operators import chunk as C
from docmesa.operators import dedupe as D
from docmesa.operators import surfaces as U
from docmesa.plans.queries_planning import _lit, _m, _named
from docmesa.plans.queries_text import _PAIRS
from docmesa.plans.registry import query, table


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks; their source is their section."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(1).cast("bigint").alias("chunk_index"), "text", F.col("source").alias("section"))


def _words(terms: list[str]) -> str:
    return " OR ".join(_m("low", rf"\b{T.quoted(t)}\b") for t in terms)


_LOW = "(SELECT doc_id, source, text, lower(text) AS low FROM documents)"
_OBLIGES = "(" + " OR ".join(f"contains(low, {_lit(t)})" for t in vocab.PROHIBITION_TERMS) + f" OR {_words([*vocab.REQUIREMENT_TERMS, *vocab.RECOMMENDATION_TERMS])})"
_FLAGS = f"doc_id, contains(text, ' | ') AS is_table, {_OBLIGES} AS obliges, ({_words(vocab.SAFETY_TERMS)}) AS safety, ({_words(vocab.COMPLIANCE_TERMS)}) AS compliance, regexp_matches(text, '[0-9]') AS numeric"
_LABELS = _named([("compliance", "compliance"), ("definition", _m("low", r"\b(definition|means|refers to|is defined as)\b")), ("numeric_constraint", "numeric"), ("procedure", _m("low", r"\b(procedure|step|sequence|method|workflow)\b")), ("requirement", "obliges"), ("safety", "safety"), ("table", "is_table")])


@query(f"SELECT doc_id, is_table, obliges, safety, compliance, numeric, array_to_string({_LABELS}, '|') AS labels, CAST(round(round(least(1.0, 0.35 + len({_LABELS}) * 0.12), 3) * 1e6) AS BIGINT) AS confidence FROM (SELECT {_FLAGS}, low FROM {_LOW})")
def assembled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assembly finds in each document, from its structs."""
    a = U.assembled(document_chunks(spark, sf_dir))
    return a.select(F.col("id").alias("doc_id"), "grid.is_table", "requirements.obliges", "requirements.safety", "requirements.compliance", F.col("numbers.any").alias("numeric"), F.array_join("labelled.labels", "|").alias("labels"), T.micro(F.col("labelled.confidence")).alias("confidence"))


@query()
def indexed_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of the surfaces of each chunk: words are counted within a chunk, which has a bounded length. An outer explode: the filter inferred for the other would be written out anew at each step below."""
    c = C.document_chunks(table(spark, sf_dir, "documents"))
    c = c.select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"), F.col("doc_id").alias("document_id"), "chunk_index", "text", "section")
    x = U.indexed(U.assembled(c))
    return x.select("id", F.array_join("active", "|").alias("active"), "hybrid.dense_chars", "hybrid.dense_hash", "hybrid.sparse_chars", "hybrid.sparse_hash", F.array_join(F.slice("hybrid.sparse_terms", 1, 10), "|").alias("terms"), F.explode_outer("index").alias("s")).select("id", "active", "dense_chars", "dense_hash", "sparse_chars", "sparse_hash", "terms", "s.*")


@query()
def keyphrases_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyphrases with words of licences, by document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(U.keyphrases(F.col("text"), PHRASE_WORDS)).alias("place", "phrase"))


PHRASE_WORDS = ["license", "version", "software", "work"]


@query("SELECT doc_id, CAST(round(round(least(1.0, 0.35 + CASE WHEN source != '' THEN 0.15 ELSE 0.0 END + 0.1 + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.1 ELSE 0.0 END + CASE WHEN contains(text, ' | ') THEN 0.1 ELSE 0.0 END + CASE WHEN length(trim(text)) >= 40 THEN 0.1 ELSE 0.0 END), 3) * 1e6) AS BIGINT) AS quality FROM documents")
def metadata_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = {"section": F.col("source") != "", "page": F.lit(True), "keywords": F.rlike("text", F.lit("[0-9]")), "table": F.contains("text", F.lit(" | ")), "valid": F.length(F.trim("text")) >= 40}
    return table(spark, sf_dir, "documents").select("doc_id", T.micro(U.metadata_quality(facts)).alias("quality"))


@query()
def table_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with bars as tables of their documents, with what stands around them."""
    b = B.lines_as_blocks(table(spark, sf_dir, "documents"))
    b = b.withColumn("kind", F.when(F.contains("text", F.lit(" | ")), "table").otherwise("text")).withColumn("heading", F.length("text").between(1, 40)).withColumn("section", F.lit("s"))
    return U.table_contexts(b).select("doc_id", "block_no", F.array_join(F.transform("blocks", lambda x: x.cast("string")), ",").alias("blocks"), F.length("text").alias("chars"))


_DIGITS = r"\b[0-9]+(\.[0-9]+)?(\s*[:/]\s*[0-9]+(\.[0-9]+)?)?\b"


@query(f"SELECT p.a, p.b, p.reason FROM ({_PAIRS}) p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b WHERE x.source = y.source OR len(regexp_extract_all(lower(x.text), '{_DIGITS}')) > 0")
def protected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates with sources as sections: only pairs with numbers may be of different ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("section"))
    return D.near_pairs(D.fingerprints(d, composed=False), "doc_id").select("a", "b", "reason")
