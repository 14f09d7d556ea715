"""Vectors, scores, expansion and graphs for ranking chunks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.plans.question import Plan

DIMENSIONS = 384
_EDGES = ".,;:!?()[]{}\"'"

# --- vectors


def dot(vector: Column, query: list[float]) -> Column:
    """Sum of products in double precision over the shorter of both."""
    q = F.array(*[F.lit(float(x)) for x in query])
    n = F.least(F.size(vector), F.lit(len(query)))
    return F.aggregate(F.zip_with(F.slice(vector, 1, n).cast("array<double>"), F.slice(q, 1, n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def valid_vector(vector: Column, size: int) -> Column:
    """Non-finite and null components as 0, cut or filled to the size, with length 1 unless all are 0."""
    v = vector.cast("array<double>")
    filled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.when(F.isnan(F.get(v, i)) | (F.abs(F.get(v, i)) == float("inf")), 0.0).otherwise(F.get(v, i)), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(filled, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(filled, lambda x: x / norm)).otherwise(filled)


def embedding_text(text: Column, kind: str = "passage") -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.concat(F.lit(f"{kind}: "), T.cut_at_blank(t, 12000))


def hash_vector(text: str, size: int = DIMENSIONS) -> list[float]:
    """Tokens by the first four bytes of their 8-byte BLAKE2b as bucket, the parity of the fifth as sign; length 1."""
    v = np.zeros(size)
    for token in text.split():
        token = token.strip(_EDGES).lower()
        if token:
            d = hashlib.blake2b(token.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "little") % size] += 1.0 if d[4] % 2 == 0 else -1.0
    norm = math.sqrt(float(v @ v))
    return (v / norm if norm else v).tolist()


def hash_vectors(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds vector, see hash_vector(); null text counts as empty."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t or ""))

    return df.withColumn("vector", vectors(F.col(text_col)))


def md5_token(token: Column, size: int = DIMENSIONS) -> tuple[Column, Column]:
    """Bucket and sign of a token by its MD5, with built-in functions only."""
    h = F.md5(token.cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % size, F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def md5_counts(text: str, size: int = DIMENSIONS) -> dict[int, float]:
    """The components of a text's vector before it is brought to length 1; whole numbers."""
    out: dict[int, float] = {}
    for token in text.lower().split(" "):
        if token:
            h = hashlib.md5(token.encode()).hexdigest()
            k = int(h[:8], 16) % size
            out[k] = out.get(k, 0.0) + (1.0 if int(h[8:10], 16) % 2 == 0 else -1.0)
    return out


def md5_vector(text: str, size: int = DIMENSIONS) -> dict[int, float]:
    out = md5_counts(text, size)
    norm = math.sqrt(sum(x * x for x in out.values()))
    return {k: x / norm for k, x in out.items()} if norm else out


def md5_cells(text: Column, size: int = DIMENSIONS) -> Column:
    """Each token of a text as its bucket times 2, plus 1 where its sign is negative; ascending."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), lambda t: t != "")
    h = F.transform(tokens, lambda t: F.md5(t.cast("binary")))
    # the tenth hex digit has the parity of the fifth byte
    return F.array_sort(F.transform(h, lambda x: ((F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint") % size) * 2 + (F.call_function("locate", F.substring(x, 10, 1), F.lit("13579bdf")) > 0).cast("int")).cast("int")))


def md5_cosine(text: Column, question: str) -> Column:
    """The cosine of hashed token vectors of a text and a question, within the row: runs of equal buckets in the sorted tokens are the vector's
    components, so nothing is shuffled and no vector is built. Products are summed as whole numbers and divided by the lengths at the end, so
    the order of tokens adds no rounding. 0 for texts without tokens."""
    q = md5_counts(question)
    norm = math.sqrt(sum(x * x for x in q.values())) or 1.0
    weights = F.array(*[F.lit(float(q.get(k, 0.0))) for k in range(DIMENSIONS)])
    start = F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("run"), F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

    def add(s: Column, c: Column) -> Column:
        k, sign = F.shiftright(c, 1), (1 - 2 * (c % 2)).cast("double")
        same = s["k"] == k
        return F.struct(k.alias("k"), F.when(same, s["run"] + sign).otherwise(sign).alias("run"), F.when(same, s["n"]).otherwise(s["n"] + s["run"] * s["run"]).alias("n"), (s["d"] + sign * F.get(weights, k)).alias("d"))

    end = lambda s: F.when(s["n"] + s["run"] * s["run"] > 0, s["d"] / norm / F.sqrt(s["n"] + s["run"] * s["run"])).otherwise(0.0)
    return F.aggregate(md5_cells(text), start, add, end)


# --- components of a score; chunk columns: text, section, and where they are known contains_table, table_text, metadata_text, keywords


def _share(surface: Column, terms: tuple[str, ...]) -> Column:
    return T.hits(surface, list(terms)) / max(1, len(terms)) if terms else F.lit(0.0)


def keyword_score(plan: Plan, surface: Column, sparse: Column | None = None) -> Column:
    if not plan.terms:
        return F.lit(0.0)
    extra = F.size(F.array_intersect(sparse, F.array(*[F.lit(t) for t in plan.terms]))) * 0.7 if sparse is not None else F.lit(0.0)
    phrase = F.contains(surface, F.lit(" ".join(plan.terms))).cast("int")
    return F.least(F.lit(1.0), (T.hits(surface, list(plan.terms)) + extra + phrase) / len(plan.terms))


def phrase_score(plan: Plan, surface: Column) -> Column:
    return _share(surface, plan.phrases)


def rerank_score(plan: Plan, surface: Column, section: Column, vector: Column, table: Column) -> Column:
    n = max(1, len(plan.terms))
    lexical = (T.hits(section, list(plan.terms)) * 1.4 + T.hits(F.substring(surface, 1, 900), list(plan.terms))) / n
    bonus = F.when(table & F.lit(plan.kind == "table_numeric" or plan.route == "table"), 0.16).otherwise(0.0)
    return F.least(F.lit(1.0), lexical * 0.55 + (vector + 1.0) / 2.0 * 0.45 + bonus)


def table_score(plan: Plan, surface: Column, table: Column, title: Column, rows: Column, row_count: Column, quality: Column) -> Column:
    total = _share(surface, plan.terms) * 0.35 + _share(rows, plan.terms) * 0.28 + _share(title, plan.terms) * 0.18 + _share(F.concat_ws(" ", title, rows), plan.phrases) * 0.18 + F.least(F.lit(0.18), row_count * 0.03) + F.least(F.lit(0.1), quality * 0.1)
    return F.when(table, F.least(F.lit(1.0), total)).otherwise(0.0)


def metadata_score(plan: Plan, facts: Column) -> Column:
    return F.when(facts == "", 0.0).otherwise(F.least(F.lit(1.0), _share(facts, plan.terms) * 0.75 + _share(facts, plan.phrases) * 0.25))


def entity_score(plan: Plan, names: Column, quality: Column) -> Column:
    return F.least(F.lit(1.0), (_share(names, plan.terms) * 0.52 + _share(names, plan.phrases) * 0.22) * (0.85 + 0.15 * quality))


def route_score(weights: tuple[float, ...], vector: Column, keyword: Column, phrase: Column, rerank: Column, table: Column, metadata: Column, entity: Column) -> Column:
    parts = (vector, keyword, phrase, rerank, table, metadata)
    return sum((F.lit(w) * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0)) + entity * 0.08


def exact_overlap(question: str, surface: Column) -> Column:
    import re

    terms = tuple(t for t in re.findall(r"[a-z0-9][a-z0-9_.-]{2,}", question.lower()) if t not in vocab.QUESTION_WORDS)
    return _share(surface, terms)


def capability_score(plan: Plan, surface: Column, facts: dict[str, Column]) -> Column:
    """Bumps for what the route's retrievers look for, at most .25. facts: contains_table, section, page, revision, filename as columns."""
    uses = set(plan.retrievers)
    has = lambda k: (F.coalesce(facts[k].cast("string"), F.lit("")) != "") if k in facts else F.lit(False)
    match = lambda p: F.rlike(surface, F.lit(p))
    bumps = [
        (uses & {"keyword", "sparse", "late_interaction"}, exact_overlap(plan.question, surface) * 0.10),
        (uses & {"table"}, F.when(facts.get("contains_table", F.lit(False)), 0.12).otherwise(0.0)),
        (uses & {"section_aware"}, F.when(has("section"), 0.05).otherwise(0.0)),
        (uses & {"document_map"}, F.when(has("page"), 0.04).otherwise(0.0)),
        (uses & {"image_region"}, F.when(match(r"\b(image|figure|diagram|drawing|p&id|layout)\b"), 0.06).otherwise(0.0)),
        (uses & {"time_aware"}, F.when(has("revision") | match(r"\b(rev(?:ision)?|date|version|latest|changed)\b"), 0.06).otherwise(0.0)),
        (uses & {"citation"}, F.when(has("page") | has("filename"), 0.04).otherwise(0.0)),
        (uses & {"symbolic"}, F.when(match(r"\b(shall|must|required|if|when|unless|except|shall not|not allowed)\b"), 0.07).otherwise(0.0)),
        (uses & {"graph", "knowledge_graph", "semantic_graph", "ontology"}, F.when(match(r"\b(system|equipment|valve|piping|drain|flare|pump|vessel|module|instrument|line)\b"), 0.06).otherwise(0.0)),
        (uses & {"metadata"}, F.when(has("filename") | has("revision") | has("section"), 0.05).otherwise(0.0)),
        (uses & {"sql_database"}, F.lit(0.03)),
    ]
    return F.least(F.lit(0.25), sum((b for on, b in bumps if on), F.lit(0.0)))


def self_query_score(wanted: dict[str, list[str]], facts: dict[str, Column]) -> tuple[Column, Column]:
    """(score up to .22 by coverage, whether a hard filter missed). wanted and facts by name; a value counts if the fact's text holds it."""
    asked = {k: v for k, v in wanted.items() if v and k in facts}
    if not asked:
        return F.lit(0.0), F.lit(False)
    hit = {k: T.contains_any(F.lower(facts[k]), [x.lower() for x in v]) for k, v in asked.items()}
    share = sum((h.cast("int") for h in hit.values()), F.lit(0)) / len(asked)
    hard = T.any_of([~h for k, h in hit.items() if k in ("sections", "documents", "standards", "identifiers", "pages", "revisions")])
    return F.when(share > 0, F.least(F.lit(0.22), share * 0.18 + 0.04)).otherwise(0.0), hard


def profile_boost(plan: Plan, surface: Column, facts: dict[str, Column]) -> Column:
    """Bumps by the question's type and the route's flags."""
    match = lambda p: F.rlike(surface, F.lit(p))
    section = F.coalesce(facts.get("section", F.lit("")), F.lit("")) != ""
    exact = {p[0]: p[4] for p in vocab.PROFILES}.get(plan.kind, False)
    rules = [
        (exact and plan.terms, T.contains_any(surface, list(plan.terms)), plan.exact_boost or 0.05),
        (plan.kind in ("exception", "negative"), match(r"\b(except|unless|not|only|prohibited|forbidden|shall not|not allowed)\b"), 0.09),
        (plan.kind in ("conditional", "multi_constraint"), match(r"\b(if|when|where|provided that|in case)\b"), 0.07),
        (plan.kind in ("procedural", "workflow"), match(r"\b(shall|must|required|step|procedure|sequence|ensure)\b"), 0.06),
        (plan.kind in ("safety_critical", "safety_interpretation", "regulation_compliance"), match(r"\b(safety|emergency|shutdown|fire|explosion|relief|hazard|shall|must)\b"), 0.08),
        (plan.kind in ("location_section", "audit_traceability", "meta_document"), section, 0.04),
        (plan.kind == "table_numeric", facts.get("contains_table", F.lit(False)), 0.12),
        ("citation" in plan.flags, F.coalesce(facts.get("page", F.lit(None)).cast("string"), F.lit("")) != "", 0.04),
        ("parent_child" in plan.flags, section, 0.04),
        ("graph" in plan.flags, match(r"\b(system|equipment|valve|piping|drain|flare|pump|vessel|module)\b"), 0.05),
        ("cache" in plan.flags, section, 0.03),
        (plan.phrases, T.contains_any(surface, list(plan.phrases)) if plan.phrases else F.lit(False), 0.05),
    ]
    return sum((F.when(test, bump).otherwise(0.0) for on, test, bump in rules if on), F.lit(0.0))


def hit_score(surface: Column, parts: list[tuple[list[str], float, float]], cap: float) -> Column:
    """The shape shared by memory, ontology, symbolic, decomposition and similar components: for each (terms, weight, cap) the hits times weight up to its cap; capped and rounded to five places."""
    return F.round(F.least(F.lit(cap), sum((F.least(F.lit(c), T.hits(surface, terms) * w) for terms, w, c in parts if terms), F.lit(0.0))), 5)


def interaction_tokens(text: Column) -> Column:
    clean = lambda t: F.regexp_replace(F.replace(F.lower(t), F.lit("&"), F.lit("and")), r"[^a-z0-9_.:/+-]+", "")
    return F.filter(F.transform(T.tokens(text, r"[A-Za-z0-9][A-Za-z0-9_.:/&+-]{1,}"), lambda t: F.regexp_replace(clean(t), r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")), lambda t: t != "")


# --- ranking and expansion; rows: id, document_id, chunk_index, score, section


def ranked(scored: DataFrame, limit: int, keys: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """The best rows; ties by key."""
    return scored.orderBy(F.desc("score"), *keys).limit(limit)


def diversified(scored: DataFrame, limit: int) -> DataFrame:
    """The best row of each of the best sections first, max(2, min(limit, 5)) of them, then the rest by score: adds place, 1 to limit.

    Only the best `limit` rows of each section and then of all matter, which bounds the final sort.
    """
    w = Window.partitionBy("section").orderBy(F.desc("score"), "id")
    top = scored.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit)
    heads = top.filter("nth = 1").orderBy(F.desc("score"), "id").limit(max(2, min(limit, 5))).select("id", F.lit(0).alias("tier"))
    pool = top.orderBy(F.desc("score"), "id").limit(limit + 5).join(heads, "id", "left").unionByName(top.join(heads, "id"), allowMissingColumns=True).dropDuplicates(["id"])
    final = pool.withColumn("tier", F.coalesce("tier", F.lit(1))).orderBy("tier", F.desc("score"), "id").limit(limit)
    return final.withColumn("place", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")).cast("bigint")).drop("nth", "tier")


def tables_first(scored: DataFrame, limit: int) -> DataFrame:
    """Up to two tables with a table score of .2 in front, the rest by score."""
    best = scored.filter("contains_table and table_score >= 0.2").orderBy(F.desc("table_score"), F.desc("phrase_score"), F.desc("keyword_score"), "id").limit(max(1, min(2, limit))).select("id", F.lit(0).alias("tier"))
    return scored.join(F.broadcast(best), "id", "left").orderBy(F.coalesce("tier", F.lit(1)), F.desc("score"), "id").limit(limit).drop("tier")


def section_number(section: Column) -> Column:
    """The numbers in front of a section's title, as an array that sorts by value."""
    n = F.regexp_extract(section, r"^((?:\d+\.)*\d+)", 1)
    return F.when(n != "", F.transform(F.split(n, r"\."), lambda x: x.cast("int")))


def siblings_first(scored: DataFrame, limit: int) -> DataFrame:
    """Up to five rows of the anchor's main section in order of their numbers, then the rest by score. The anchor is the best row with a numbered section."""
    s = scored.withColumn("number", section_number(F.col("section")))
    anchor = s.filter("number is not null").orderBy(F.desc("score"), "id").limit(1).select(F.col("number")[0].alias("major"))
    same = s.join(F.broadcast(anchor), F.col("number")[0] == F.col("major")).orderBy("number", F.desc("score"), "id").limit(max(1, min(5, limit))).select("id", F.lit(0).alias("tier"))
    return s.join(F.broadcast(same), "id", "left").orderBy(F.coalesce("tier", F.lit(1)), F.when(F.col("tier") == 0, F.col("number")), F.desc("score"), "id").limit(limit).drop("tier", "number")


def with_window(best: DataFrame, scored: DataFrame, window: int, limit: int) -> DataFrame:
    """The best rows with the neighbours of the first three, which score at least .82 of theirs."""
    anchors = best.orderBy(F.desc("score"), "id").limit(3).select(F.col("document_id").alias("d"), F.col("chunk_index").alias("at"), F.col("score").alias("s"))
    near = scored.join(F.broadcast(anchors), (F.col("document_id") == F.col("d")) & F.col("chunk_index").between(F.col("at") - window, F.col("at") + window))
    lifted = near.join(best.select("id"), "id", "left_anti").groupBy("id").agg(F.max(F.greatest("score", F.col("s") * 0.82)).alias("lift"))
    extra = scored.join(lifted, "id").withColumn("score", F.col("lift")).drop("lift").dropDuplicates(["id"])
    return best.unionByName(extra.select(*best.columns)).orderBy(F.desc("score"), "id").limit(limit)


def with_links(best: DataFrame, scored: DataFrame, links: DataFrame, limit: int, factor: float = 0.78) -> DataFrame:
    """The best rows with what the first four link to (id, target), which scores at least .78 of theirs."""
    anchors = best.orderBy(F.desc("score"), "id").limit(4).select("id", F.col("score").alias("s"))
    out = links.join(F.broadcast(anchors), "id").select(F.col("target").alias("id"), "s").groupBy("id").agg(F.max("s").alias("s"))
    extra = scored.join(out, "id").join(best.select("id"), "id", "left_anti").withColumn("score", F.greatest("score", F.col("s") * factor)).drop("s").dropDuplicates(["id"])
    return best.unionByName(extra.select(*best.columns)).orderBy(F.desc("score"), "id").limit(limit)


# --- graphs; edges: left, right, relation, chunk_id


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"), *[c for c in edges.columns if c not in ("left", "right")])).distinct()


def relation_weight(relation: Column) -> Column:
    r = F.lower(F.coalesce(relation, F.lit("")))
    return F.when(T.contains_any(r, ["requires", "supports", "connected", "associated", "upstream", "downstream"]), 1.25).when(F.contains(r, F.lit("co_occurs")), 0.75).otherwise(1.0)


def cooccurrence_edges(nodes: DataFrame) -> DataFrame:
    """Edges between the first ten names of a chunk (chunk_id, name) and the three after each."""
    w = Window.partitionBy("chunk_id").orderBy("name")
    n = nodes.distinct().withColumn("r", F.row_number().over(w)).filter("r <= 10")
    a, b = n.select("chunk_id", F.col("name").alias("left"), F.col("r").alias("i")), n.select("chunk_id", F.col("name").alias("right"), F.col("r").alias("j"))
    return a.join(b, "chunk_id").filter((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + 3)).select("left", "right", F.lit("co_occurs").alias("relation"), "chunk_id")


def expanded(edges: DataFrame, seeds: DataFrame, depth: int, per_node: int, weighted: bool = False) -> DataFrame:
    """node, distance: seeds (node) and what is reached over the first edges of each node, level by level without returning.

    A node's edges are cut at per_node, by weight if asked and then by name; the levels are unrolled joins.
    """
    order = [F.desc(relation_weight(F.col("relation"))), "right"] if weighted else ["right"]
    cut = edges.select("left", "right", "relation").distinct().withColumn("r", F.row_number().over(Window.partitionBy("left").orderBy(*order))).filter(F.col("r") <= per_node).select("left", "right")
    seen = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(cut, front["node"] == cut["left"]).select(F.col("right").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def chunk_graph_scores(mentions: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """chunk_id, score: .06 for each seed it mentions, .018 for each other reached node, .012 times weight for each edge of a reached node (24 each); at most .16."""
    m = mentions.distinct().join(reached, mentions["name"] == reached["node"]).select("chunk_id", F.when(F.col("distance") == 0, 0.06).otherwise(0.018).alias("s"))
    w = Window.partitionBy("left").orderBy("right", "chunk_id", "relation")
    e = edges.withColumn("r", F.row_number().over(w)).filter("r <= 24").join(reached, F.col("left") == F.col("node")).select("chunk_id", (0.012 * relation_weight(F.col("relation"))).alias("s"))
    return m.unionByName(e).groupBy("chunk_id").agg(F.least(F.lit(0.16), F.sum("s")).alias("score"))


def merged_nodes(records: DataFrame) -> DataFrame:
    """One row per key of records (key, label, aliases, chunk_id, confidence): its distinct aliases, number of chunks, longest label, best
    confidence. Which chunks these are is node_chunks(): a node that a third of all chunks mention has no list of them in a row."""
    names = records.select("key", F.explode_outer("aliases").alias("alias")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    chunks = node_chunks(records).groupBy("key").agg(F.count("*").alias("chunks"))
    most = records.groupBy("key").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))
    return most.join(names, "key").join(chunks, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def node_chunks(records: DataFrame) -> DataFrame:
    """(key, chunk_id), each once."""
    return records.filter("chunk_id is not null").select("key", "chunk_id").distinct()
