"""Canonical exact fingerprints of documents, with DataFrame functions only.

The canonical form of a text is that of compatibility caseless matching (decomposed, then twice case
folded and composed by NFKC, so folding it again changes nothing), runs of white space made one blank, trimmed. Two 64-bit xxhashes with different seeds give a 128-bit digest.
Texts in the same bucket of that digest are compared byte by byte; should two canonical forms
ever share a digest, all but the smallest get their SHA-256 appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmesa.llm.common import materialise, partitions, release

#: Bounds of ranges of ids that are searched together.
STEP = 128
#: Clashing buckets that are broadcast, at most; more are joined by a shuffle.
FEW = 10_000


def canonical(text: Column) -> Column:
    normal = lambda how, x, compatible: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(how), x, F.lit(compatible))
    folded = lambda x: normal("compose", F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True)), True)
    return F.trim(F.regexp_replace(folded(folded(normal("decompose", text, False))), r"[\s\p{Z}\x85]+", " "))


def wide(form: Column) -> tuple[Column, Column]:
    """Two hashes; the literal in front seeds the second."""
    return F.xxhash64(form), F.xxhash64(F.lit("wide"), form)


def as_text(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def clashes(df: DataFrame) -> DataFrame:
    """Buckets of (h1, h2) that hold different canonical forms: h1, h2 and `own`, the least SHA-256 of a form, which keeps the plain digest.

    Forms are compared whole, each once: equal ones are combined before the shuffle, so a bucket with
    a third of all rows sends one row from each task.
    """
    forms = df.select("h1", "h2", "form").distinct()
    return forms.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.sha2("form", 256)).alias("own")).filter("n > 1").drop("n")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, fingerprint. Null text counts as empty; rows with equal
    or null ids each give a row; an empty table gives none; other columns are left out."""
    base = df.select(df[id_col], F.coalesce(df[text_col], F.lit("")).alias("text"))
    rows = _hashed(base)
    named = rows.select(id_col, F.length("text").cast("bigint").alias("n_chars"), "h1", "h2", "sha")
    return _settled(named, materialise(clashes(rows), "clashes"), "h1", "h2", "sha", "fingerprint").select(id_col, "n_chars", "fingerprint")


def _hashed(df: DataFrame) -> DataFrame:
    """df (with the column text) with form, h1, h2 and sha."""
    d = df.withColumn("form", canonical(F.col("text")))
    h1, h2 = wide(F.col("form"))
    return d.withColumn("h1", h1).withColumn("h2", h2).withColumn("sha", F.sha2("form", 256))


def _settled(rows: DataFrame, clash: DataFrame, a: str, b: str, sha: str, name: str) -> DataFrame:
    """rows with the fingerprint for the hashes a, b as the column `name`. clash is a written table, broadcast only if it is small."""
    clash = clash.select(F.col("h1").alias(a), F.col("h2").alias(b), "own")
    if clash.limit(FEW + 1).count() <= FEW:
        clash = F.broadcast(clash)
    plain = as_text(F.col(a), F.col(b))
    other = F.col("own").isNotNull() & (F.col("own") != F.col(sha))
    return rows.join(clash, [a, b], "left").withColumn(name, F.when(other, F.concat(plain, F.lit("-"), sha)).otherwise(plain)).drop("own")


def _place(cuts: list[int], key: Column) -> Column:
    """How many of the ascending cuts are at most the key: whole steps of them first, then those of one step."""
    steps = [cuts[i : i + STEP] for i in range(0, len(cuts), STEP)]
    if not steps:
        return F.lit(0)
    whole = F.size(F.filter(F.array(*[F.lit(s[-1]).cast("bigint") for s in steps]), lambda c: c <= key))
    inside = F.get(F.array(*[F.array(*[F.lit(c).cast("bigint") for c in s]) for s in steps]), whole)
    return F.least(whole * STEP, F.lit(len(cuts))) + F.coalesce(F.size(F.filter(inside, lambda c: c <= key)), F.lit(0))


def with_next(df: DataFrame, id_col: str, columns: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds next_<column>: the values in the next row by ascending (id, text), after the last row those of the first.

    df has the columns id_col and text; `add` gives it more before the rows are dealt out. Null ids come first. Ids are split at quantiles into ranges;
    each range is sorted by itself, and gets the first row of the following range as a guest.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", F.coalesce(F.col(id_col), F.lit(-(1 << 63))))
    n = partitions(spark)
    at = [k / n for k in range(1, n)]
    cuts = keyed.agg(F.percentile_approx("_key", at, 10 * n).alias("c")).first()["c"] if at else []
    cuts = sorted(set(cuts or []))
    keyed = keyed.withColumn("_range", _place(cuts, F.col("_key")))
    heads = [(r["_range"], r["k"]) for r in keyed.groupBy("_range").agg(F.min("_key").alias("k")).orderBy("_range").collect()]  # a row for each range
    if not heads:
        return add(df).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    guest = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(guest, "_key bigint, _to int"))  # a row for each shuffle partition at most
    guests = keyed.join(small, "_key").withColumn("_range", F.col("_to")).drop("_to").withColumn("_guest", F.lit(1))
    every = add(keyed.withColumn("_guest", F.lit(0))).unionByName(add(guests))
    w = Window.partitionBy("_range").orderBy("_guest", "_key", "text")
    return every.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("_guest = 0").drop("_guest", "_range", "_key")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half (rounded down, in code points) is
    replaced by as many first code points of the next document, or all it has.

    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. An
    exact fingerprint's likeness is 1 where both canonical forms are the same and else 0. Null text counts as empty;
    of rows with equal ids the one with the smaller text comes first; null ids come before
    all others; a single row is its own next; an empty table gives no rows; other columns are left out.
    """
    base = df.select(df[id_col].cast("bigint").alias(id_col), F.coalesce(df[text_col], F.lit("")).alias("text"))
    clash = materialise(clashes(_hashed(base)), "clashes")
    release(df.sparkSession)
    rows = with_next(base, id_col, ["text", "h1", "h2"], lambda d: _hashed(d).drop("form"))
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_form", canonical(F.col("edited")))
    e1, e2 = wide(F.col("edited_form"))
    rows = rows.withColumn("e1", e1).withColumn("e2", e2).withColumn("edited_form_sha", F.sha2("edited_form", 256))
    same_edited = F.when((F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2")), F.col("edited_form") == canonical(F.col("text"))).otherwise(F.lit(False))
    same_next = F.when((F.col("next_h1") == F.col("h1")) & (F.col("next_h2") == F.col("h2")), canonical(F.col("next_text")) == canonical(F.col("text"))).otherwise(F.lit(False))
    out = rows.select(id_col, F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", "sha", "e1", "e2", "edited_form_sha", same_edited.cast("double").alias("near_edited"), same_next.cast("double").alias("near_next"))
    out = materialise(out, "fingerprints")
    release(df.sparkSession)
    # edited forms join the buckets by their SHA-256, so that texts with one form have one fingerprint wherever they stand
    shas = out.select("h1", "h2", "sha").unionByName(out.select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("edited_form_sha").alias("sha")))
    more = shas.groupBy("h1", "h2").agg(F.min("sha").alias("own"), F.max("sha").alias("last")).filter("own != last").drop("last")
    clash = materialise(clash.unionByName(more).groupBy("h1", "h2").agg(F.min("own").alias("own")), "clashes")
    out = _settled(_settled(out, clash, "h1", "h2", "sha", "fingerprint"), clash, "e1", "e2", "edited_form_sha", "edited_fingerprint")
    return out.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
