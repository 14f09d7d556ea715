"""Facts about a chunk's text as columns: scripts, access, references, numbers, modality, safety, tables, code, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab


# --- language


def script_counts(text: Column, other: Column) -> dict[str, Column]:
    """Characters of each script; those beside Latin letters are counted in `other`, the text without ASCII."""
    count = lambda x, pattern: F.length(F.regexp_replace(x, f"[^{pattern}]+", "")).cast("bigint")
    return {"latin": count(text, "A-Za-z")} | {name: F.when(other == "", F.lit(0).cast("bigint")).otherwise(count(other, rf"\x{{{a:04X}}}-\x{{{b:04X}}}")) for name, _, a, b in vocab.SCRIPTS}


def language(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds language_code, primary_script, latin_ratio, english_score, language_confidence and multilingual.

    The script with most characters leads, ties go to Latin and then by name order of the table. Latin text is English where it has
    enough English words or is Latin nearly throughout; accented Latin letters belong to no script. Null text is unknown.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = df.withColumn("_other", F.regexp_replace(t, r"[\x00-\x7F]+", ""))
    counts = script_counts(t, F.col("_other"))
    d = d.withColumns({f"_{k}": v for k, v in counts.items()})
    total = sum((F.col(f"_{k}") for k in counts), F.lit(0))
    ratio = lambda k: F.round(F.col(f"_{k}") / F.greatest(F.lit(1), total), 4)
    words = T.tokens(F.lower(t))
    known = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws)))
    score = F.least(F.lit(0.65), (known(vocab.ENGLISH_WORDS) * 0.75 + known(vocab.LATIN_TERMS) * 0.45) / F.greatest(F.lit(1), F.size(words)) + F.least(F.lit(0.18), ratio("latin") * 0.18))
    d = d.withColumn("english_score", F.when(F.size(words) == 0, 0.0).otherwise(score)).withColumn("latin_ratio", ratio("latin"))
    best = F.greatest(*[F.col(f"_{k}") for k in counts])
    primary = F.coalesce(*[F.when((F.col(f"_{k}") == best) & (best > 0), F.lit(k)) for k in counts], F.lit(""))
    d = d.withColumn("primary_script", primary)
    codes = F.create_map(*[F.lit(x) for name, code, _, _ in [("latin", "en", 0, 0), *vocab.SCRIPTS] for x in (name, code)])
    english = (F.col("primary_script") == "latin") & ((F.col("english_score") >= 0.24) | (F.col("latin_ratio") >= 0.82))
    own = F.greatest(*[F.when(F.col("primary_script") == k, ratio(k)).otherwise(0.0) for k in counts])
    code = F.when(F.trim(t) == "", "unknown").when(F.col("primary_script") != "", F.element_at(codes, F.col("primary_script"))).otherwise("unknown")
    sure = F.when(F.trim(t) == "", 0.0).when(english, F.least(F.lit(0.96), 0.58 + F.col("english_score") + F.col("latin_ratio") * 0.18)).when(F.col("primary_script") != "", F.least(F.lit(0.94), 0.55 + own * 0.38)).otherwise(0.2)
    many = sum(((ratio(k) >= 0.12).cast("int") for k in counts), F.lit(0)) > 1
    d = d.withColumn("language_code", code).withColumn("multilingual", many)
    d = d.withColumn("language_confidence", F.round(F.when(many & (F.col("language_code") != "unknown"), F.least(sure, F.lit(0.72))).otherwise(sure), 3))
    return d.drop("_other", *[f"_{k}" for k in counts])


# --- access


def access(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds classification, sensitivity, tags, allowed_roles, denied_roles, action and redactions by the rules' terms. Null text is unclassified."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rules = [(tag, cls, roles, T.contains_any(t, terms)) for tag, cls, terms, roles in vocab.ACCESS_RULES]
    level = F.greatest(F.lit(1), *[F.when(hit, vocab.ACCESS_LEVELS[cls]).otherwise(0) for _, cls, _, hit in rules])
    d = df.withColumn("sensitivity", level)
    names = F.create_map(*[F.lit(x) for k, v in vocab.ACCESS_LEVELS.items() for x in (v, k)])
    d = d.withColumn("classification", F.element_at(names, F.col("sensitivity")))
    text_list = lambda xs: F.array(*[F.lit(x) for x in xs])
    controlling = F.flatten(F.array(*[F.when(hit & (F.col("sensitivity") == vocab.ACCESS_LEVELS[cls]), text_list(roles)).otherwise(F.array().cast("array<string>")) for _, cls, roles, hit in rules]))
    allowed = F.when(F.col("sensitivity") <= 1, text_list(vocab.OPEN_ROLES)).otherwise(F.array_sort(F.array_distinct(controlling)))
    tags = F.array_compact(F.array(*[F.when(hit, F.lit(tag)) for tag, _, _, hit in rules], F.when(F.col("sensitivity") > 1, F.col("classification"))))
    d = d.withColumn("allowed_roles", allowed).withColumn("denied_roles", F.array_except(text_list(vocab.KNOWN_ROLES), F.col("allowed_roles"))).withColumn("tags", F.array_sort(F.array_distinct(tags)))
    action = F.when(F.col("sensitivity") >= 4, "require_authorized_role_and_show_citation_only").when((F.col("sensitivity") == 3) | F.array_contains("tags", "distribution_restricted"), "require_authorized_role").when(F.col("sensitivity") == 2, "allow_employee_roles").otherwise("allow")
    mail = F.rlike(t, F.lit(r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"))
    phone = F.rlike(t, F.lit(r"\b(?:phone|mobile|tel)\s*[:#]?\s*\+?\d[\d -]{6,}\b"))
    redactions = F.array_compact(F.array(F.when(F.col("sensitivity") >= 4, "distribution_notice"), F.when(mail, "email_address"), F.when(phone, "phone_number")))
    return d.withColumn("action", action).withColumn("redactions", redactions)


def visible_to(df: DataFrame, roles: list[str]) -> DataFrame:
    """Rows of access() that someone with these roles may see."""
    return df.filter((F.col("sensitivity") <= 1) | F.arrays_overlap("allowed_roles", F.array(*[F.lit(r) for r in roles])))


# --- abbreviations and revisions


def abbreviations(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, abbr, expansion, source, confidence: defined in the text (.94), known (.88), or just used (.35); the first of these counts, 80 at most."""
    t = F.col(text_col)
    a = F.regexp_extract_all(t, F.lit(r"\b([A-Z][A-Za-z][A-Za-z0-9 /&,-]{3,90}?)\s*\(([A-Z][A-Z0-9&/-]{1,12})\)"), F.lit(0))
    b = F.regexp_extract_all(t, F.lit(r"\b([A-Z][A-Z0-9&/-]{1,12})\s*\(([A-Z][A-Za-z][A-Za-z0-9 /&,-]{3,90}?)\)"), F.lit(0))
    pair = lambda s, long, short: F.struct(F.trim(F.regexp_extract(s, short, 1)).alias("abbr"), F.trim(F.regexp_extract(s, long, 1)).alias("expansion"))
    defined = F.concat(F.transform(a, lambda s: pair(s, r"^(.*?)\s*\(", r"\(([^()]*)\)$")), F.transform(b, lambda s: pair(s, r"\(([^()]*)\)$", r"^(.*?)\s*\(")))
    initials = lambda e: F.array_join(F.transform(F.regexp_extract_all(e, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.upper(F.substring(w, 1, 1))), "")
    compact = lambda s: F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")
    known = F.create_map(*[F.lit(x) for k, v in vocab.ABBREVIATIONS.items() for x in (k, v)])
    fits = lambda p: F.contains(initials(p["expansion"]), F.substring(compact(p["abbr"]), 1, 2)) | F.map_contains_key(known, compact(p["abbr"])) | F.startswith(initials(p["expansion"]), compact(p["abbr"]))
    record = lambda abbr, exp, source, c, rank: F.struct(abbr.alias("abbr"), exp.alias("expansion"), F.lit(source).alias("source"), F.lit(c).alias("confidence"), F.lit(rank).alias("rank"))
    used = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(?:P&ID|[A-Z]{2,}(?:[&/-][A-Z0-9]+)*)\b"), F.lit(0)))
    every = F.concat(F.transform(F.filter(defined, fits), lambda p: record(p["abbr"], p["expansion"], "explicit_definition", 0.94, 0)), F.transform(F.slice(used, 1, 100), lambda u: F.when(F.map_contains_key(known, u), record(u, F.element_at(known, u), "known_dictionary", 0.88, 1)).otherwise(record(u, F.lit(""), "unknown_acronym", 0.35, 2))))
    rows = df.select(F.col(id_col), F.explode(every).alias("r")).select(id_col, "r.*")
    best = rows.groupBy(id_col, "abbr").agg(F.min_by(F.struct("expansion", "source", "confidence"), F.struct("rank", "expansion")).alias("b"))
    return best.select(id_col, "abbr", "b.expansion", "b.source", "b.confidence")


def revisions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds revision, its sort key, dates (20 at most), document_identifier and validity_status found in the text."""
    t = T.normalize_line(F.coalesce(F.col(text_col), F.lit("")), composed=False)
    d = df.withColumn("_line", t)
    t = F.col("_line")
    d = d.withColumn("revision", F.regexp_extract(t, r"(?i)\b(?:revision number|revision|rev\.?)\s*[:#]?\s*([A-Z]?\d+[A-Z]?|[A-Z]\d?)\b", 1))
    dates = F.slice(T.unique_preserve(F.regexp_extract_all(t, F.lit(r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"), F.lit(0))), 1, 20)
    d = d.withColumn("revision_dates", dates).withColumn("revision_sort_key", T.revision_sort_key(F.col("revision")))
    d = d.withColumn("document_identifier", F.regexp_extract(t, r"(?i)\b(?:document id|document n\.?|contractor document id|company document id)\s*[:#]?\s*([A-Z0-9_-]{6,})\b", 1))
    return d.withColumn("validity_status", F.trim(F.regexp_extract(t, r"(?i)\b(?:validity status|status)\s*[:#]?\s*([A-Z][A-Z0-9 -]{1,40})\b", 1))).drop("_line")


# --- numbers and units


def unit_table(spark: SparkSession) -> DataFrame:
    """alias, unit, family, canonical_unit, factor; some forty rows."""
    known = {u: (f, c, x) for u, f, c, x in vocab.UNITS}
    return spark.createDataFrame([(a, u, *known[u]) for a, u in vocab.UNIT_ALIASES.items()], "alias string, unit string, family string, canonical_unit string, factor double")


def numeric_constraints(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, position, value, unit of up to 30 numbers; not those inside standards, five digits and more without a unit, and section-like ones."""
    bare = F.coalesce(F.col(text_col), F.lit(""))
    for p in vocab.STANDARDS:
        bare = F.regexp_replace(bare, rf"(?i)\b{p}", " ")
    found = F.regexp_extract_all(bare, F.lit("(?i)" + vocab.NUMERIC_UNIT), F.lit(0))
    rows = df.select(F.col(id_col), F.posexplode(found).alias("position", "m"))
    m = F.col("m")
    rows = rows.select(id_col, "position", T.normalize_line(F.regexp_extract(m, "(?i)" + vocab.NUMERIC_UNIT, 1), composed=False).alias("value"), F.trim(F.regexp_extract(m, "(?i)" + vocab.NUMERIC_UNIT, 2)).alias("unit"))
    v, none = F.col("value"), F.col("unit") == ""
    rows = rows.filter(~(F.rlike(v, F.lit(r"^\d{5,}$")) & none) & ~(F.rlike(v, F.lit(r"^\d+(?:\.\d+)+$")) & none))
    return rows.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "value", "unit"))), 1, 30).alias("c")).select(id_col, F.explode("c").alias("c")).select(id_col, F.col("c.position").cast("bigint").alias("position"), "c.value", "c.unit")


def canonical_units(constraints: DataFrame) -> DataFrame:
    """Adds normalized_unit, family, canonical_unit and canonical_value to rows with value and unit. Ratios give their quotient; no unit is a number."""
    spark = constraints.sparkSession
    c = constraints.withColumn("_alias", F.regexp_replace(F.lower(F.coalesce("unit", F.lit(""))), "[^a-z%]+", ""))
    j = c.join(F.broadcast(unit_table(spark).withColumnsRenamed({"alias": "_alias", "unit": "_unit", "family": "_family", "canonical_unit": "_canonical", "factor": "_factor"})), "_alias", "left")
    value = F.regexp_replace("value", r"\s+", "")
    a, b = F.regexp_extract(value, r"^(\d+(?:\.\d+)?)[/:](\d+(?:\.\d+)?)$", 1).try_cast("double"), F.regexp_extract(value, r"^(\d+(?:\.\d+)?)[/:](\d+(?:\.\d+)?)$", 2).try_cast("double")
    ratio = F.rlike("value", F.lit("[:/]"))
    number = value.try_cast("double")
    unit = F.coalesce("_unit", "_alias")
    j = j.withColumn("normalized_unit", unit).withColumn("family", F.when(ratio, "ratio").otherwise(F.coalesce("_family", F.when(F.col("_alias") == "", "number").otherwise("other"))))
    j = j.withColumn("canonical_unit", F.when(ratio, "ratio").otherwise(F.when(number.isNull(), unit).otherwise(F.coalesce("_canonical", unit))))
    j = j.withColumn("canonical_value", F.when(ratio, F.when(b != 0, a / b)).otherwise(F.round(number * F.coalesce("_factor", F.lit(1.0)), 8)))
    return j.drop("_alias", "_unit", "_family", "_canonical", "_factor")


# --- modality, safety, labels, scores


def modality(text: Column, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """Terms of obligation and recommendation in the text, "prohibition" for any of that; in alphabetical order of their group."""
    v = vocabulary or {"prohibition": vocab.PROHIBITION_TERMS, "requirement": vocab.REQUIREMENT_TERMS, "recommendation": vocab.RECOMMENDATION_TERMS}
    t = F.lower(text)
    parts = [F.when(T.contains_any(t, v["prohibition"]), F.lit("prohibition"))]
    parts += [F.when(T.has_word(t, w), F.lit(w)) for k in ("requirement", "recommendation") for w in sorted(v[k])]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def safety_score(text: Column, mandatory: Column, terms: list[str] | None = None) -> Column:
    """.12 for each safety term, .1 for each hazard term, .25 if the text obliges and has one; at most 1."""
    t = F.lower(text)
    safe = T.word_hits(t, terms or vocab.SAFETY_TERMS)
    hazards = T.word_hits(t, [w for w in (terms or vocab.SAFETY_TERMS) if w != "safety"] + ["must not", "shall not"])
    return F.round(F.least(F.lit(1.0), safe * 0.12 + hazards * 0.1 + F.when(mandatory & (safe > 0), 0.25).otherwise(0.0)), 3)


def semantic_labels(text: Column, table: Column, obliges: Column, safety: Column, numeric: Column, compliance: Column) -> Column:
    t = F.lower(text)
    labels = [F.when(compliance, "compliance"), F.when(F.rlike(t, F.lit(r"\b(definition|means|refers to|is defined as)\b")), "definition"), F.when(numeric, "numeric_constraint"), F.when(F.rlike(t, F.lit(r"\b(procedure|step|sequence|method|workflow)\b")), "procedure"), F.when(obliges, "requirement"), F.when(safety, "safety"), F.when(table, "table")]
    return F.array_compact(F.array(*labels))


def label_confidence(labels: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.35 + F.size(labels) * 0.12), 3)


def importance(signals: dict[str, Column], words: Column) -> Column:
    """.12 and the capped signals (name to column times weight), less .06 under 35 words; 0 to 1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.12 + sum(signals.values(), F.lit(0.0)) - F.when(words < 35, 0.06).otherwise(0.0))), 4)


def importance_label(score: Column) -> Column:
    return F.when(score >= 0.78, "critical").when(score >= 0.58, "high").when(score >= 0.36, "medium").otherwise("low")


def table_parts(text: Column) -> dict[str, Column]:
    """Title, columns, rows and quality of the first table in rendered text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    piped = F.filter(lines, lambda x: F.contains(x, F.lit("|")) & ~F.rlike(x, F.lit(r"^[\s|:-]+$")))
    cells = lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c))
    columns = F.when(F.size(piped) > 0, F.filter(cells(F.get(piped, 0)), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    rows = F.slice(piped, 2, F.greatest(F.size(piped) - 1, F.lit(1)))
    title = F.coalesce(F.get(F.filter(lines, lambda x: F.rlike(x, F.lit(r"(?i)^\s*(?:table|title)\s*[:\d]")) & ~F.contains(x, F.lit("|")) & ~F.rlike(x, F.lit(r"^TABLE:\s*$"))), 0), F.lit(""))
    aligned = F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda r: F.abs(F.size(F.split(r, r"\|")) - F.size(columns)) <= 1)) / F.size(rows)).otherwise(0.0)
    quality = F.when(F.size(piped) == 0, 0.0).otherwise(0.2 + F.when(F.size(columns) > 0, 0.3).otherwise(0.0) + F.when(F.size(rows) > 0, 0.3).otherwise(0.0) + F.when(title != "", 0.1).otherwise(0.0) + 0.1 * aligned)
    return {"title": title, "columns": columns, "rows": rows, "quality": F.round(F.least(F.lit(1.0), quality), 3)}


def table_integrity(quality: Column) -> Column:
    return F.when(quality >= 0.85, "strong").when(quality >= 0.6, "usable").when(quality >= 0.35, "weak").otherwise("none")


def formulas(text: Column) -> Column:
    """Equations, ratios and values with units, 120 at most."""
    equations = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[A-Za-z0-9_(][A-Za-z0-9_+*/().\- ]*[A-Za-z0-9_)]"), F.lit(0))
    ratios = F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\s*:\s*\d+(?:\.\d+)?\b"), F.lit(0))
    units = F.regexp_extract_all(text, F.lit(r"(?i)\b\d+(?:\.\d+)?\s*(?:mm|cm|m|barg|bar|psi|kpa|mpa|deg|c|hz|kg|ton|inch)\b"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(equations, ratios, units)), 1, 120)


def code_snippets(text: Column) -> Column:
    """(language, code) of fenced blocks."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```([A-Za-z0-9_+-]*)\s*\n(.*?)```"), F.lit(0))
    return F.transform(found, lambda s: F.struct(F.lower(F.regexp_extract(s, r"(?s)```([A-Za-z0-9_+-]*)", 1)).alias("language"), F.regexp_extract(s, r"(?s)```[A-Za-z0-9_+-]*\s*\n(.*?)```", 1).alias("code")))


def endpoints(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+(/[A-Za-z0-9_/{}.-]*)"), F.lit(1)))


def sql_tables(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)))


def validation(df: DataFrame) -> DataFrame:
    """Adds warnings and score (1 less .18 for each) from text, contains_table, has_images, table_integrity, ocr_confidence, safety_critical and has_modality."""
    t = F.col("text")
    w = [
        F.when((F.length(F.trim(t)) < 40) & ~F.col("contains_table") & ~F.col("has_images"), "short_chunk"),
        F.when(F.col("contains_table") & ~F.col("table_integrity").isin("strong", "usable"), "weak_table_integrity"),
        F.when(F.col("ocr_confidence") < 0.35, "low_ocr_confidence"),
        F.when(F.col("safety_critical") & ~F.col("has_modality"), "safety_context_without_requirement_modal"),
        F.when(T.is_contaminated(t), "generated_or_debug_text_detected"),
    ]
    return df.withColumn("warnings", F.array_compact(F.array(*w))).withColumn("validation_score", F.round(F.greatest(F.lit(0.0), 1.0 - F.size("warnings") * 0.18), 3))
