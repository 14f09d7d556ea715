"""Queries over facts about texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.operators import enrich as E
from docmesa.plans.queries_text import LINE
from docmesa.plans.registry import query, table


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_ALL = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_SCRIPT = {n: rf"length(regexp_replace(text, '[^\x{{{a:04X}}}-\x{{{b:04X}}}]', '', 'g'))" for n, _, a, b in vocab.SCRIPTS}
_TOTAL = " + ".join([_ALL, *_SCRIPT.values()])


@query(f"""WITH c AS (SELECT doc_id, text, {_ALL} AS latin, {_TOTAL} AS total, {", ".join(f"{v} AS {k}" for k, v in _SCRIPT.items())}, regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_.-]+') AS w FROM documents),
s AS (SELECT *, round(latin / greatest(1, total), 4) AS latin_ratio, len(list_filter(w, lambda x: x IN ({_quoted(vocab.ENGLISH_WORDS)}))) AS e, len(list_filter(w, lambda x: x IN ({_quoted(vocab.LATIN_TERMS)}))) AS g FROM c),
q AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE least(0.65, (e * 0.75 + g * 0.45) / greatest(1, len(w)) + least(0.18, latin_ratio * 0.18)) END AS score FROM s)
SELECT doc_id, CASE WHEN latin > 0 THEN 'en' ELSE 'unknown' END AS language_code, CASE WHEN latin > 0 THEN 'latin' ELSE '' END AS primary_script, CAST(round(latin_ratio * 1e6) AS BIGINT) AS latin_ratio, CAST(round(score * 1e6) AS BIGINT) AS english_score FROM q""")
def language_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.language(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "language_code", "primary_script", T.micro(F.col("latin_ratio")).alias("latin_ratio"), T.micro(F.col("english_score")).alias("english_score"))


_HIT = {tag: "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")" for tag, _, terms, _ in vocab.ACCESS_RULES}
_LEVEL = "greatest(1, " + ", ".join(f"CASE WHEN {_HIT[tag]} THEN {vocab.ACCESS_LEVELS[c]} ELSE 0 END" for tag, c, _, _ in vocab.ACCESS_RULES) + ")"
_ROLES = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN {_HIT[tag]} AND v = {vocab.ACCESS_LEVELS[c]} THEN [{_quoted(r)}] ELSE []::VARCHAR[] END" for tag, c, _, r in vocab.ACCESS_RULES) + "])))"


@query(f"""WITH l AS (SELECT 'p' || page_id AS id, html AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents), v AS (SELECT *, {_LEVEL} AS v FROM l)
SELECT id, ['public', 'unclassified', 'internal', 'restricted', 'confidential', 'controlled'][v + 1] AS classification, CASE WHEN v <= 1 THEN '{",".join(vocab.OPEN_ROLES)}' ELSE array_to_string({_ROLES}, ',') END AS roles,
CASE WHEN v >= 4 THEN 'require_authorized_role_and_show_citation_only' WHEN v = 3 OR {_HIT['distribution_restricted']} THEN 'require_authorized_role' WHEN v = 2 THEN 'allow_employee_roles' ELSE 'allow' END AS action FROM v""")
def access_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return E.access(p.unionByName(d)).select("id", "classification", F.array_join("allowed_roles", ",").alias("roles"), "action")


@query(r"""SELECT doc_id, regexp_matches(lower(text), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b') AS email, regexp_matches(lower(text), '\b(phone|mobile|tel)\s*[:#]?\s*\+?[0-9][0-9 -]{6,}\b') AS phone FROM documents""")
def redaction_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.access(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_contains("redactions", "email_address").alias("email"), F.array_contains("redactions", "phone_number").alias("phone"))


@query(f"WITH v AS (SELECT doc_id, text, {_LEVEL} AS v FROM documents) SELECT doc_id FROM v WHERE v <= 1 OR list_has_any({_ROLES}, ['engineer'])")
def visible_to_engineer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.visible_to(E.access(table(spark, sf_dir, "documents").select("doc_id", "text")), ["engineer"]).select("doc_id")


@query(r"""SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b([A-Z]{1,6}-[0-9]{1,6}[A-Z]?|[A-Z]{2,}[A-Z0-9_-]*(-[A-Z0-9]+)+|[A-Z]{2,}[0-9]{2,}[A-Z0-9_-]*)\b'), lambda s: length(s) >= 5))), ',') AS identifiers FROM documents""")
def identifiers_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(T.identifiers(F.col("text"))), ",").alias("identifiers"))


@query()
def abbreviation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.abbreviations(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(r"""SELECT doc_id, regexp_extract(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '(?i)\b(?:revision number|revision|rev\.?)\s*[:#]?\s*([A-Z]?[0-9]+[A-Z]?|[A-Z][0-9]?)\b', 1) AS revision, len(list_distinct(regexp_extract_all(text, '\b([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})\b'))) AS dates FROM documents""")
def revisions_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = E.revisions(d.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x")))
    return d.select("doc_id", "revision", F.size("revision_dates").cast("bigint").alias("dates"))


_UNITS = ", ".join(f"('{a}', '{u}', '{f}', '{c}', {x!r})" for a, u in vocab.UNIT_ALIASES.items() for n, f, c, x in vocab.UNITS if n == u)


@query(f"""WITH u(alias, unit, family, canonical, factor) AS (VALUES {_UNITS}), p AS (SELECT p_partkey, p_size, ['mm', 'inch', 'barg', 'degrees', 'rpm', 'percent', 'tonne', 'widget'][p_partkey % 8 + 1] AS raw FROM part)
SELECT p_partkey, coalesce(unit, raw) AS normalized_unit, coalesce(family, 'other') AS family, coalesce(canonical, raw) AS canonical_unit, CAST(round(round(p_size * coalesce(factor, 1.0), 8) * 1e6) AS BIGINT) AS canonical_value FROM p LEFT JOIN u ON u.alias = p.raw""")
def unit_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*[F.lit(x) for x in ("mm", "inch", "barg", "degrees", "rpm", "percent", "tonne", "widget")])
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("value"), F.element_at(raw, (F.col("p_partkey") % 8 + 1).cast("int")).alias("unit"))
    return E.canonical_units(p).select("p_partkey", "normalized_unit", "family", "canonical_unit", T.micro(F.col("canonical_value")).alias("canonical_value"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_quantity / (l_linenumber + 1) * 1e6) AS BIGINT) AS ratio FROM lineitem WHERE l_orderkey % 10 < 10")
def ratio_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int"), F.lit(":"), F.col("l_linenumber") + 1).alias("value"), F.lit("").alias("unit"))
    return E.canonical_units(li).select("l_orderkey", "l_linenumber", T.micro(F.col("canonical_value")).alias("ratio"))


def _without_standards(x: str) -> str:
    for p in vocab.STANDARDS:
        x = f"regexp_replace({x}, '(?i)\\b{p}', ' ', 'g')"
    return x


#: Letters outside ASCII are put out of the way: the two engines differ in whether they are part of a word.
_BARE = _without_standards(r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')")
_UNIT = "(?i)" + vocab.NUMERIC_UNIT
_NUMBERS = f"""WITH u(alias, unit, family, canonical, factor) AS (VALUES {_UNITS}),
t AS (SELECT doc_id, {_BARE} AS t FROM documents), m AS (SELECT doc_id, unnest(range(len(l))) AS position, unnest(l) AS m FROM (SELECT doc_id, regexp_extract_all(t, '{_UNIT}') AS l FROM t)),
v AS (SELECT doc_id, position, {LINE.replace("line", f"regexp_extract(m, '{_UNIT}', 1)", 1)} AS value, trim(regexp_extract(m, '{_UNIT}', 2)) AS unit FROM m),
k AS (SELECT * FROM v WHERE NOT (regexp_matches(value, '^[0-9]{{5,}}$') AND unit = '') AND NOT (regexp_matches(value, '^[0-9]+(?:\\.[0-9]+)+$') AND unit = '') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY position) <= 30),
a AS (SELECT *, regexp_replace(lower(unit), '[^a-z%]+', '', 'g') AS raw, regexp_replace(value, '\\s+', '', 'g') AS w, regexp_matches(value, '[:/]') AS ratio FROM k),
n AS (SELECT a.doc_id, a.position, a.value, a.unit, a.raw, a.w, a.ratio, u.unit AS known, u.family, u.canonical, u.factor, TRY_CAST(a.w AS DOUBLE) AS number FROM a LEFT JOIN u ON u.alias = a.raw)
SELECT doc_id, position, value, unit, coalesce(known, raw) AS normalized_unit, CASE WHEN ratio THEN 'ratio' ELSE coalesce(family, CASE WHEN raw = '' THEN 'number' ELSE 'other' END) END AS family, CASE WHEN ratio THEN 'ratio' WHEN number IS NULL THEN coalesce(known, raw) ELSE coalesce(canonical, known, raw) END AS canonical_unit,
CAST(round(CASE WHEN ratio THEN CASE WHEN CAST(regexp_extract(w, '[/:](.*)$', 1) AS DOUBLE) != 0 THEN CAST(regexp_extract(w, '^([^/:]*)', 1) AS DOUBLE) / CAST(regexp_extract(w, '[/:](.*)$', 1) AS DOUBLE) END ELSE round(number * coalesce(factor, 1.0), 8) END * 1e6) AS BIGINT) AS canonical_value FROM n"""


@query(_NUMBERS)
def numeric_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    c = E.canonical_units(E.numeric_constraints(d, "doc_id"))
    return c.select("doc_id", "position", "value", "unit", "normalized_unit", "family", "canonical_unit", T.micro(F.col("canonical_value")).alias("canonical_value"))


@query(r"""SELECT doc_id, len(list_distinct(list_concat(list_concat(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[A-Za-z0-9_(][A-Za-z0-9_+*/().\- ]*[A-Za-z0-9_)]'), regexp_extract_all(text, '\b[0-9]+(\.[0-9]+)?\s*:\s*[0-9]+(\.[0-9]+)?\b')), regexp_extract_all(text, '(?i)\b[0-9]+(\.[0-9]+)?\s*(mm|cm|m|barg|bar|psi|kpa|mpa|deg|c|hz|kg|ton|inch)\b')))) AS formulas FROM documents""")
def formulas_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(E.formulas(F.col("text"))).cast("bigint").alias("formulas"))


#: The words of the driver's English prose stand in for the engine's vocabulary, which does not occur in it.
_OBLIGE, _SAFE = ["with", "that", "are"], ["for", "from", "was"]


@query(f"""WITH h AS (SELECT doc_id, text, {" + ".join(f"CAST(regexp_matches(lower(text), '\\b{w}\\b') AS INT)" for w in _SAFE)} AS s, ({" OR ".join(f"regexp_matches(lower(text), '\\b{w}\\b')" for w in _OBLIGE)}) AS m FROM documents)
SELECT doc_id, CAST(round(round(least(1.0, s * 0.12 + s * 0.1 + CASE WHEN m AND s > 0 THEN 0.25 ELSE 0.0 END), 3) * 1e6) AS BIGINT) AS safety_score, CASE WHEN least(1.0, s * 0.22 + CASE WHEN m AND s > 0 THEN 0.25 ELSE 0.0 END) >= 0.25 THEN 'strict_citation_required' ELSE 'standard_grounded_answer' END AS policy FROM h""")
def safety_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = {"prohibition": ["zzz"], "requirement": _OBLIGE, "recommendation": []}
    s = E.safety_score(F.col("text"), F.size(E.modality(F.col("text"), v)) > 0, _SAFE)
    return d.select("doc_id", T.micro(s).alias("safety_score"), F.when(s >= 0.25, "strict_citation_required").otherwise("standard_grounded_answer").alias("policy"))


@query(f"""WITH f AS (SELECT doc_id, contains(text, ' | ') AS t, regexp_matches(text, '[0-9]') AS n, regexp_matches(lower(text), '\\b(with|that|are)\\b') AS r, regexp_matches(lower(text), '\\b(for|from)\\b') AS s FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN n THEN 'numeric_constraint' END, CASE WHEN r THEN 'requirement' END, CASE WHEN s THEN 'safety' END, CASE WHEN t THEN 'table' END], lambda x: x IS NOT NULL), ',') AS labels,
CAST(round(round(least(1.0, 0.35 + 0.12 * (CAST(n AS INT) + CAST(r AS INT) + CAST(s AS INT) + CAST(t AS INT))), 3) * 1e6) AS BIGINT) AS confidence FROM f""")
def semantic_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    low = F.lower(t)
    labels = E.semantic_labels(t, F.contains(t, F.lit(" | ")), F.rlike(low, F.lit(r"\b(with|that|are)\b")), F.rlike(low, F.lit(r"\b(for|from)\b")), F.rlike(t, F.lit("[0-9]")), F.lit(False))
    d = table(spark, sf_dir, "documents").select("doc_id", labels.alias("l"))
    return d.select("doc_id", F.array_join("l", ",").alias("labels"), T.micro(E.label_confidence(F.col("l"))).alias("confidence"))


@query("""WITH f AS (SELECT doc_id, len(string_split(text, ' ')) AS w, length(text) AS n, contains(text, ' | ') AS t, regexp_matches(text, '[0-9]') AS d FROM documents),
s AS (SELECT doc_id, round(greatest(0.0, least(1.0, 0.12 + CASE WHEN t THEN 0.14 ELSE 0.0 END + CASE WHEN d THEN 0.12 ELSE 0.0 END + least(0.2, w / 1000.0) - CASE WHEN w < 35 THEN 0.06 ELSE 0.0 END)), 4) AS x FROM f)
SELECT doc_id, CAST(round(x * 1e6) AS BIGINT) AS importance, CASE WHEN x >= 0.78 THEN 'critical' WHEN x >= 0.58 THEN 'high' WHEN x >= 0.36 THEN 'medium' ELSE 'low' END AS label FROM s""")
def section_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, w = F.col("text"), F.size(F.split("text", " "))
    signals = {"table": F.when(F.contains(t, F.lit(" | ")), 0.14).otherwise(0.0), "numbers": F.when(F.rlike(t, F.lit("[0-9]")), 0.12).otherwise(0.0), "length": F.least(F.lit(0.2), w / 1000.0)}
    s = E.importance(signals, w)
    return table(spark, sf_dir, "documents").select("doc_id", T.micro(s).alias("importance"), E.importance_label(s).alias("label"))


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS lines FROM documents), p AS (SELECT doc_id, list_filter(lines, lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[\\s|:-]+$')) AS p FROM l)
SELECT doc_id, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_filter(list_transform(string_split(p[1], '|'), lambda c: trim(c)), lambda c: c != '')) END AS columns, greatest(len(p) - 1, 0) AS rows FROM p""")
def tables_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.table_parts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p["columns"]).cast("bigint").alias("columns"), F.size(p["rows"]).cast("bigint").alias("rows"))


@query("""WITH f AS (SELECT doc_id, length(trim(text)) < 40 AS short, contains(text, ' | ') AS t FROM documents)
SELECT doc_id, CAST(round(round(greatest(0.0, 1.0 - 0.18 * (CASE WHEN short AND NOT t THEN 1 ELSE 0 END + CASE WHEN t THEN 1 ELSE 0 END)), 3) * 1e6) AS BIGINT) AS score, short AND NOT t AS short_chunk, t AS weak_table FROM f""")
def ingestion_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.contains("text", F.lit(" | ")).alias("contains_table"), F.lit(False).alias("has_images"), F.lit("weak").alias("table_integrity"), F.lit(1.0).alias("ocr_confidence"), F.lit(False).alias("safety_critical"), F.lit(False).alias("has_modality"))
    v = E.validation(d)
    return v.select("doc_id", T.micro(F.col("validation_score")).alias("score"), F.array_contains("warnings", "short_chunk").alias("short_chunk"), F.array_contains("warnings", "weak_table_integrity").alias("weak_table"))


@query("""SELECT quality, count(*) AS documents, CAST(round(avg(length(text)) * 1e3) AS BIGINT) AS mean_chars, count(*) FILTER (WHERE contains(text, ' | ')) AS with_tables FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def quality_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("quality").agg(F.count("*").alias("documents"), F.round(F.avg(F.length("text")) * 1e3).cast("bigint").alias("mean_chars"), F.count_if(F.contains("text", F.lit(" | "))).alias("with_tables"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\b(what to tell management|immediate rule for debugging|stage-level failure record|rag frameworks|upload lanes to ingest|retrieval grounded|hallucination control)\\b')""")
def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(T.is_contaminated(F.col("text"))).select("doc_id")


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars FROM pages""")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"(?s)<(script|style)>.*?</(script|style)>", " "), r"<[^>]*>", " "), r"\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("bigint").alias("links"), F.length(F.trim(plain)).cast("bigint").alias("text_chars"))
