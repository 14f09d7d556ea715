"""Classes and quality of chunks from their text and facts, and the score components that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions.text import quoted

# --- document classes (fixed values): class, weight, terms
CLASSES = [
    ("piping_design_philosophy", 1.0, ["piping design philosophy", "pipe routing", "piping system", "piping layout", "valves", "vents", "drains"]),
    ("engineering_specification", 0.95, ["specification", "shall", "requirements", "design basis", "asme", "norsok", "iso", "api"]),
    ("procedure_or_work_instruction", 0.9, ["procedure", "step", "workflow", "instruction", "shall be carried out", "method", "sequence"]),
    ("safety_critical_document", 1.05, ["safety", "shutdown", "emergency", "fire", "explosion", "hazard", "relief", "flare"]),
    ("table_numeric_reference", 0.9, ["table", "slope", "rating", "dimension", "minimum", "maximum", "mm", "bar", "value"]),
    ("inspection_testing_document", 0.85, ["inspection", "testing", "test", "acceptance", "verification", "commissioning", "check"]),
    ("drawing_or_layout_document", 0.8, ["drawing", "layout", "p&id", "pid", "diagram", "figure", "skid", "equipment layout"]),
    ("revision_control_document", 0.75, ["revision", "rev.", "issue", "status", "validity status", "document id"]),
    ("general_engineering_document", 0.55, ["engineering", "design", "equipment", "system", "module", "facility"]),
]
ROUTING_HINTS = {"table_numeric_reference": "table_numeric_retrieval", "safety_critical_document": "safety_window_retrieval", "procedure_or_work_instruction": "procedural_requirement_retrieval", "revision_control_document": "metadata_revision_retrieval", "drawing_or_layout_document": "layout_multimodal_retrieval"}

# --- section importance (fixed values): title term, weight
TITLE_TERMS = {"basis": 0.05, "design": 0.05, "requirement": 0.08, "requirements": 0.08, "safety": 0.1, "shutdown": 0.08, "isolation": 0.08, "valve": 0.06, "valves": 0.06, "relief": 0.08, "vent": 0.06, "drain": 0.06, "slope": 0.07, "pressure": 0.06, "fire": 0.08, "explosion": 0.08, "corrosion": 0.06, "vibration": 0.06, "inspection": 0.05, "testing": 0.05, "standard": 0.05, "code": 0.05}

# --- ingestion quality (fixed values): component, weight; component, threshold, warning
QUALITY_WEIGHTS = {"text_presence": 0.08, "block_extraction": 0.06, "ocr": 0.07, "layout": 0.05, "table": 0.09, "validation": 0.12, "metadata": 0.09, "semantic": 0.07, "entity": 0.06, "numeric": 0.07, "safety": 0.08, "document_classification": 0.05, "hierarchical_embedding": 0.05, "section_importance": 0.04, "image_figure": 0.02}
QUALITY_WARNINGS = [("text_presence", 0.25, "empty_or_near_empty_text"), ("ocr", 0.35, "low_quality_ocr"), ("table", 0.55, "weak_table_quality"), ("metadata", 0.55, "weak_metadata_quality"), ("semantic", 0.45, "weak_semantic_labeling"), ("numeric", 0.6, "numeric_constraints_not_normalized"), ("document_classification", 0.45, "weak_document_classification"), ("hierarchical_embedding", 0.6, "hierarchy_embedding_not_ready")]

# --- ontology (fixed values): concept, synonyms, broader, related
ONTOLOGY = [
    ("valve", ["valves", "manual valve", "actuated valve", "control valve", "isolation valve", "check valve", "globe valve", "butterfly valve"], ["piping component", "flow control"], ["isolation", "throttling", "shut-off", "actuator", "pressure relief"]),
    ("isolation", ["isolate", "isolating", "isolation philosophy", "system isolation", "shutdown isolation"], ["safety function", "operational control"], ["valve", "shutdown", "maintenance", "barrier", "control"]),
    ("pressure relief", ["relief valve", "pressure relief device", "rupture disc", "psv", "relief devices"], ["safety system", "overpressure protection"], ["flare", "vent", "discharge", "safety", "pressure"]),
    ("piping", ["pipe", "pipeline", "piping system", "line", "pipework"], ["mechanical system"], ["routing", "support", "slope", "flexibility", "valve", "drain", "vent"]),
    ("slope", ["sloping", "gradient", "fall", "inclination", "pipe slope"], ["layout requirement"], ["drain", "vent", "direction", "table", "low point", "high point"]),
    ("drain", ["drains", "draining", "operational drain", "closed drain", "open drain"], ["piping function"], ["vent", "slope", "liquid removal", "low point"]),
    ("vent", ["vents", "venting", "operational vent", "atmospheric vent"], ["piping function"], ["drain", "slope", "gas release", "high point"]),
    ("flare", ["flare header", "flare system", "flare line", "discharge to flare"], ["relief system"], ["pressure relief", "vent", "discharge", "safety"]),
    ("safety", ["safe", "hazard", "risk", "emergency", "shutdown", "fire", "explosion"], ["engineering requirement"], ["shall", "must", "relief", "isolation", "fire", "explosion"]),
    ("layout", ["arrangement", "routing", "location", "placement", "orientation"], ["design requirement"], ["piping", "access", "support", "equipment", "maintenance"]),
    ("support", ["pipe support", "supported", "supporting", "restraint", "guide"], ["mechanical integrity"], ["vibration", "load", "flexibility", "piping"]),
    ("vibration", ["vibrations", "vibrating", "dynamic load", "fatigue"], ["mechanical integrity"], ["support", "dead leg", "pump", "compressor", "piping"]),
    ("equipment", ["pump", "compressor", "vessel", "module", "skid", "instrument"], ["plant asset"], ["piping", "layout", "maintenance", "access", "valve"]),
    ("standard", ["code", "specification", "asme", "norsok", "iso", "api", "iec", "requirement"], ["compliance basis"], ["shall", "must", "design code", "engineering requirement"]),
]

# --- rules of wording (fixed values): rule, weight, patterns
RULES = [
    ("obligation", 1.2, [r"\bshall\b", r"\bmust\b", r"\brequired\b", r"\bmandatory\b", r"\bensure\b"]),
    ("prohibition", 1.35, [r"\bshall not\b", r"\bmust not\b", r"\bnot allowed\b", r"\bprohibited\b", r"\bforbidden\b"]),
    ("condition", 1.18, [r"\bif\b", r"\bwhen\b", r"\bwhere\b", r"\bprovided that\b", r"\bin case\b", r"\bsubject to\b"]),
    ("exception", 1.3, [r"\bexcept\b", r"\bunless\b", r"\bexcept where\b", r"\bexcept when\b", r"\bexcept for\b"]),
    ("permission", 0.82, [r"\bmay\b", r"\bcan\b", r"\bpermitted\b", r"\ballowed\b"]),
    ("recommendation", 0.95, [r"\bshould\b", r"\bpreferably\b", r"\brecommended\b"]),
    ("definition", 0.9, [r"\bis defined as\b", r"\bmeans\b", r"\brefers to\b", r"\bshall mean\b"]),
    ("numeric_constraint", 1.28, [r"\b\d+(?:\.\d+)?\s*(?:mm|m|bar|psi|deg|degree|%)\b", r"\b1\s*:\s*\d+\b", r"\bminimum\b", r"\bmaximum\b", r"\bat least\b"]),
    ("safety_critical", 1.25, [r"\bsafety\b", r"\bemergency\b", r"\bshutdown\b", r"\bfire\b", r"\bexplosion\b", r"\bhazard\b", r"\brelief\b"]),
]


def class_scores(text: Column, facts: dict[str, Column] | None = None, lowered: bool = False) -> dict[str, Column]:
    """lowered: whether the text is in lower case already. A score up to 1 for each class: .11 times its weight for each term, .12 if any, and bumps for facts (obliges, safety, table, revision, procedure, requirement)."""
    t, f = text if lowered else F.lower(text), facts or {}
    bumps = {"engineering_specification": [("obliges", 0.16), ("requirement", 0.12)], "safety_critical_document": [("safety", 0.22)], "table_numeric_reference": [("table", 0.14)], "revision_control_document": [("revision", 0.12)], "procedure_or_work_instruction": [("procedure", 0.16)]}
    out = {}
    for name, weight, terms in CLASSES:
        n = T.hits(t, terms)
        score = n * (0.11 * weight) + F.when(n > 0, 0.12).otherwise(0.0)
        for fact, bump in bumps.get(name, []):
            if fact in f:
                score = score + F.when(f[fact], bump).otherwise(0.0)
        out[name] = F.round(F.least(F.lit(1.0), score), 4)
    return out


def document_class(df: DataFrame, text: Column, facts: dict[str, Column] | None = None) -> DataFrame:
    """Adds document_class, its score and confidence, the second class, and a routing hint. Ties go to the class that is listed first."""
    scores = class_scores(text, facts)
    d = df.withColumns({f"_c{i}": s for i, s in enumerate(scores.values())})
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"_c{i}")).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(scores)]))
    d = d.withColumn("_r", ranked)
    first, second = -F.col("_r")[0]["s"], -F.col("_r")[1]["s"]
    hints = F.create_map(*[F.lit(x) for kv in ROUTING_HINTS.items() for x in kv])
    d = d.withColumn("document_class", F.col("_r")[0]["name"]).withColumn("class_score", first).withColumn("second_class", F.when(second >= 0.18, F.col("_r")[1]["name"]).otherwise(""))
    d = d.withColumn("class_confidence", F.round(F.least(F.lit(1.0), 0.35 + first * 0.45 + F.greatest(F.lit(0.0), first - second) * 0.35), 3))
    d = d.withColumn("routing_hint", F.coalesce(F.try_element_at(hints, F.col("document_class")), F.lit("hybrid_engineering_retrieval")))
    return d.drop("_r", *[f"_c{i}" for i in range(len(scores))])


def section_importance(title: Column, facts: dict[str, Column], words: Column) -> Column:
    """From .12: title terms (.2 at most), safety, requirement, table, counts of numbers, references, relations and entities, each capped; to three places."""
    t = F.lower(title)
    hits = F.least(F.lit(0.2), sum((F.when(F.contains(t, F.lit(k)), w).otherwise(0.0) for k, w in TITLE_TERMS.items()), F.lit(0.0)))
    flag = lambda k, w: F.when(facts[k], w).otherwise(0.0) if k in facts else F.lit(0.0)
    count = lambda k, w, cap: F.least(F.lit(cap), facts[k] * w) if k in facts else F.lit(0.0)
    score = 0.12 + hits + flag("safety", 0.16) + count("safety_score", 0.12, 0.12) + flag("requirement", 0.12) + count("requirements", 0.025, 0.08) + flag("table", 0.08) + count("table_quality", 0.08, 0.08) + count("numbers", 0.025, 0.1) + count("references", 0.015, 0.06) + count("relations", 0.012, 0.06) + count("entities", 0.008, 0.06) + flag("procedure_or_requirement", 0.05) - F.when(words < 35, 0.06).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def ingestion_quality(components: dict[str, Column]) -> dict[str, Column]:
    """score, label, warnings, answerable and boost from components of 0 to 1 by name; absent ones count as 0."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((components.get(k, F.lit(0.0)) * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0)))), 3)
    label = F.when(score >= 0.82, "excellent").when(score >= 0.68, "good").when(score >= 0.52, "usable-check").when(score >= 0.38, "weak").otherwise("poor")
    warnings = F.array_compact(F.array(*[F.when(components.get(k, F.lit(0.0)) < t, w) for k, t, w in QUALITY_WARNINGS]))
    hard = T.any_of([components.get(k, F.lit(0.0)) < t for k, t, w in QUALITY_WARNINGS if w in ("empty_or_near_empty_text", "weak_table_quality", "low_quality_ocr")])
    boost = F.greatest(F.lit(-0.06), F.least(F.lit(0.06), (score - 0.5) * 0.12))
    return {"score": score, "label": label, "warnings": warnings, "answerable": ~hard, "boost": F.round(F.when(hard & (boost > 0), boost * 0.4).otherwise(boost), 5)}


# --- ontology


def _term(term: str) -> str:
    """Phrases between other characters than letters and digits, words with a plural s."""
    return rf"(?<![a-z0-9]){quoted(term)}(?![a-z0-9])" if set(term) & set(" -/") else rf"\b{quoted(term)}s?\b"


def term_hits(text: Column, terms: list[str]) -> Column:
    return sum(((F.contains(text, F.lit(t)) & F.rlike(text, F.lit(_term(t)))).cast("int") for t in dict.fromkeys(terms)), F.lit(0))


def concepts(text: Column, low: Column | None = None) -> Column:
    """The names of the concepts that the text has a term for, by their table's order. low: the text in lower case."""
    t = F.lower(text) if low is None else low
    return F.array_compact(F.array(*[F.when(term_hits(t, [name, *synonyms]) > 0, name) for name, synonyms, _, _ in ONTOLOGY]))


def concept_confidence(text: Column) -> dict[str, Column]:
    """.45 for each own, .22 for each broader, .12 for each related term; at most 1."""
    t = F.lower(text)
    return {name: F.round(F.least(F.lit(1.0), term_hits(t, [name, *s]) * 0.45 + term_hits(t, b) * 0.22 + term_hits(t, r) * 0.12), 4) for name, s, b, r in ONTOLOGY}


def concepts_of(question: str) -> list[str]:
    import re

    q = question.lower()
    return [name for name, synonyms, _, _ in ONTOLOGY if any(re.search(_term(t), q) for t in [name, *synonyms])][:10]


def expansion_terms(names: list[str]) -> list[str]:
    """The names with all terms of their concepts, 80 at most."""
    return list(dict.fromkeys(t for n, s, b, r in ONTOLOGY if n in names for t in [n, *s, *b, *r]))[:80]


def ontology_score(names: list[str], text: Column) -> Column:
    """Up to .06 for each asked concept, .05 for expansion terms; .18 in all."""
    t = F.lower(text)
    own = sum((F.least(F.lit(0.06), term_hits(t, [n, *s]) * 0.022 + term_hits(t, b) * 0.012 + term_hits(t, r) * 0.008) for n, s, b, r in ONTOLOGY if n in names), F.lit(0.0))
    return F.round(F.least(F.lit(0.18), own + F.least(F.lit(0.05), term_hits(t, expansion_terms(names)) * 0.006)), 5) if names else F.lit(0.0)


# --- rules of wording


def rule_hits(text: Column, lowered: bool = False) -> dict[str, Column]:
    """How often each rule's patterns occur, 8 at most."""
    t = text if lowered else F.lower(text)
    return {name: F.least(F.lit(8), sum((T.pattern_count(t, p) for p in patterns), F.lit(0))) for name, _, patterns in RULES}


def symbolic_score(asked: list[str], terms: list[str], text: Column, lowered: bool = False) -> Column:
    """.014 for each occurrence times the rule's weight, 1.35 as much for asked rules, .045 at most for a rule; question terms up to .04; .18 in all."""
    hits = rule_hits(text, lowered)
    own = sum((F.least(F.lit(0.045), hits[name] * (0.014 * weight * (1.35 if name in asked else 1.0))) for name, weight, _ in RULES), F.lit(0.0))
    return F.round(F.least(F.lit(0.18), own + F.least(F.lit(0.04), T.hits(text if lowered else F.lower(text), terms) * 0.006)), 5)


# --- further components of a chunk's score


def memory_score(plan: dict[str, list], row_id: Column, filename: Column, section: Column, text: Column) -> Column:
    """What earlier turns cited: the chunk .14, its file .035, sections, entities, standards and terms with caps; .20 in all."""
    t = F.lower(text)
    own = F.when(row_id.isin(plan.get("source_ids") or [-1]), 0.14).otherwise(0.0) + F.when(F.lower(filename).isin([f.lower() for f in plan.get("filenames") or [""]]) & (filename != ""), 0.035).otherwise(0.0)
    parts = [(F.lower(section), "sections", 0.035, 0.08), (t, "entities", 0.012, 0.07), (t, "standards", 0.02, 0.06), (t, "terms", 0.006, 0.05)]
    return F.round(F.least(F.lit(0.20), own + sum((F.least(F.lit(cap), T.hits(where, [x.lower() for x in plan[k]]) * w) for where, k, w, cap in parts if plan.get(k)), F.lit(0.0))), 5)


def share_score(text: Column, groups: list[tuple[list[str], float]], cap: float, bonus: Column | None = None) -> Column:
    """For plans made of groups of terms (hops, subquestions, focus terms): the mean share of a group's terms times its weight, up to a cap."""
    t = F.lower(text)
    groups = [(g, w) for g, w in groups if g]
    mean = sum((T.hits(t, g) / len(g) * w for g, w in groups), F.lit(0.0)) / max(1, len(groups))
    return F.round(F.least(F.lit(cap), mean * cap + (bonus if bonus is not None else F.lit(0.0))), 5)


def class_component(question: str, klass: Column, score: Column, confidence: Column) -> Column:
    """Up to .09 for chunks whose class the question speaks of."""
    import re

    words = list(dict.fromkeys(re.findall(r"[a-z0-9_.-]{2,}", question.lower())))
    label = F.lower(F.replace(klass, F.lit("_"), F.lit(" ")))
    n = T.hits(label, words)
    base = F.least(F.lit(0.04), score * confidence * 0.035)
    if not any(w in question.lower() for w in ("document", "type", "class", "specification", "procedure", "safety", "table")):
        base = F.when(n > 0, base).otherwise(base * 0.45)
    return F.round(F.least(F.lit(0.09), base + F.least(F.lit(0.05), n * 0.012)), 5)


def importance_component(question: str, section: Column, importance: Column) -> Column:
    """Up to .12: .09 of the importance, more for section terms of the question, .55 of it where there are none."""
    import re

    words = list(dict.fromkeys(re.findall(r"[a-z0-9_.-]{2,}", question.lower())))
    n = T.hits(F.lower(section), words)
    return F.round(F.least(F.lit(0.12), importance * 0.09 * F.when(n > 0, 1.0 + F.least(F.lit(0.6), n * 0.15)).otherwise(0.55)), 5)


def graph_component(seed: Column, reached: Column, chunk_score: Column, edges: Column, terms: Column) -> Column:
    """From counts of seed nodes, reached nodes, edges and terms of a chunk, and its score in the graph; .18 at most."""
    return F.round(F.least(F.lit(0.18), F.least(F.lit(0.08), seed * 0.035) + F.least(F.lit(0.07), reached * 0.014) + F.least(F.lit(0.06), chunk_score) + F.least(F.lit(0.035), edges * 0.009) + F.least(F.lit(0.03), terms * 0.006)), 5)


def decomposition_score(parts: list[tuple[str, list[str], float]], text: Column, facts: dict[str, Column]) -> Column:
    """.045 of each part's share of terms and .025 where its type is met, times its weight, and .018 (up to .06) for each part covered; .18 at most. parts: type, terms, weight; facts: table, numeric, safety, section, relations."""
    t = F.lower(text)
    match = lambda p: F.rlike(t, F.lit(p))
    fact = lambda k: facts.get(k, F.lit(False))
    met = {"table_numeric": fact("table") | fact("numeric"), "safety_requirement": fact("safety") | match(r"\b(shall|must|required|safety)\b"), "location_section": fact("section"), "relationship": fact("relations"), "procedure": match(r"\b(step|procedure|sequence|shall|ensure)\b"), "exception": match(r"\b(except|unless|shall not|must not|prohibited|not allowed)\b"), "enumeration": match(r"\b(types?|include|following|listed|categories)\b"), "definition": match(r"\b(is|are|means|defined|refers)\b")}
    total, covered = F.lit(0.0), F.lit(0)
    for kind, terms, weight in parts:
        share, hit = T.hits(t, terms) / max(1, len(terms)), met.get(kind, F.lit(False))
        total = total + (share * 0.045 + F.when(hit, 0.025).otherwise(0.0)) * weight
        covered = covered + F.when((share >= 0.34) | hit, 1).otherwise(0)
    return F.round(F.least(F.lit(0.18), total + F.least(F.lit(0.06), covered * 0.018)), 5)


def multi_hop_score(hops: list[tuple[str, str, list[str], float]], text: Column, facts: dict[str, Column], links: Column) -> Column:
    """.065 of each hop's share of terms, .025 each for its relation and its intent, times its weight; .018 (up to .06) for each hop covered; up to .045 for links; .22 at most. hops: intent, relation, terms, weight."""
    t = F.lower(text)
    met = {"table_numeric_evidence": facts.get("table", F.lit(False)), "metadata_location_evidence": facts.get("section", F.lit(False)), "safety_requirement_evidence": facts.get("safety", F.lit(False)), "relationship_evidence": facts.get("relations", F.lit(False))}
    total, covered = F.lit(0.0), F.lit(0)
    for intent, relation, terms, weight in hops:
        share, related, hit = T.hits(t, terms) / max(1, len(terms)), F.contains(t, F.lit(relation.replace("_", " "))), met.get(intent, F.lit(False))
        total = total + (share * 0.065 + F.when(related, 0.025).otherwise(0.0) + F.when(hit, 0.025).otherwise(0.0)) * weight
        covered = covered + F.when((share >= 0.34) | related | hit, 1).otherwise(0)
    return F.round(F.least(F.lit(0.22), total + F.least(F.lit(0.045), links * 0.008) + F.least(F.lit(0.06), covered * 0.018)), 5)
