"""Queries that plan every user's question of the conversations for the special retrievers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.plans import planning as P
from docmesa.plans import question as Q
from docmesa.plans.queries_retrieval import _case, _re2, _route_case
from docmesa.plans.registry import query, table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_lit, xs)) + "]"


def _routes(*names: str) -> str:
    return "route IN (" + ", ".join(_lit(r) for r, (*_, used) in vocab.ROUTES.items() if set(names) & set(used.split())) + ", '')"


def _m(where: str, pattern: str) -> str:
    return f"regexp_matches({where}, '{_re2(pattern)}')"


def _ordered(x: str) -> str:
    """The distinct values of a list in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _terms(x: str, stops: list[str], most: int) -> str:
    kept = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_.:/&+-]{{2,}}'), lambda t: NOT list_contains({_list(stops)}, t))"
    return f"list_slice({_ordered(kept)}, 1, {most})"


def _named(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {_lit(name)} END" for name, test in tests) + "], lambda v: v IS NOT NULL)"


_PARTS = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?i)\b(?:and|or|with|between|versus|vs\.?|compared to)\b|[;?]', chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: length(p) > 8)"
_PLAIN = "trim(regexp_replace(lower({x}), '[^a-z0-9_.:/&+-]+', ' ', 'g'))"
_ASKED = f"(SELECT *, {_route_case()} AS route FROM (SELECT *, {_case()} AS kind, {_PLAIN.format(x='text')} AS low FROM conversations WHERE role = 'user'))"
_SQL_ON, _API_ON = f"({_routes('sql_database')} OR {_m('low', P.SQL_QUESTION)})", f"({_routes('api')} OR {_m('lower(text)', P.API_QUESTION)})"
_RETRY_ON = f"({_routes('iterative')} OR kind IN ({', '.join(map(_lit, P.RETRY_TYPES))}))"
_HOPS_ON = f"({_routes('multi_hop')} OR regexp_matches(text, '(?i)\\b(then|after that|multi[- ]?hop|related to|connected to|depends on|requires|upstream|downstream|because|therefore|conflict|across documents)\\b'))"
_PARTS_ON = f"(({_routes('query_decomposition')} OR kind IN ({', '.join(map(_lit, P.COMPLEX_TYPES))}) OR length(text) - length(replace(text, '?', '')) >= 2 OR {_m('low', P.COMPLEX)}) AND len(list_filter(list_slice({_ordered(_PARTS)}, 1, 8), lambda p: len({_terms('p', P.PART_STOPS, 18)}) > 0)) > 0)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned questions; the plans that a query does not show are pruned."""
    return P.planned(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text"))


def _joined(name: str):
    return F.array_join(name, "|").alias(name.split(".")[-1])


@query(f"SELECT conv_id, turn, {_SQL_ON} AS active, array_to_string(CASE WHEN len(i) > 0 THEN i ELSE ['chunk_lookup'] END, '|') AS intents, array_to_string({_terms('text', P.SQL_STOPS, 24)}, '|') AS terms FROM (SELECT *, {_named([(n, _m('low', p)) for n, p in P.SQL_INTENTS])} AS i FROM {_ASKED})")
def sql_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", F.col("sql.active").alias("active"), _joined("sql.intents"), _joined("sql.terms"))


@query(f"SELECT conv_id, turn, {_API_ON} AS active, {_m('lower(text)', P.API_QUESTION)} AS live, array_to_string({_terms('text', P.API_STOPS, 30)}, '|') AS terms FROM {_ASKED}")
def api_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", F.col("api.active").alias("active"), F.col("api.live").alias("live"), _joined("api.terms"))


def _retry_sql() -> str:
    said = ["CASE WHEN len(missing) > 0 THEN 'exact missing terms ' || array_to_string(missing[1:12], ' ') || ' ' || text END"]
    said += [f"CASE WHEN list_contains(asks, {_lit(name)}) THEN {_lit(prefix + ' ')} || array_to_string(w[1:12], ' ') END" for name, _, prefix in P.SIGNALS]
    said.append("CASE WHEN coverage < 0.45 THEN 'broader engineering context ' || array_to_string(w[1:16], ' ') END")
    return f"""WITH c AS (SELECT *, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
q AS (SELECT *, {_route_case()} AS route FROM (SELECT *, {_case()} AS kind, {_PLAIN.format(x='text')} AS low FROM c WHERE role = 'user')),
t AS (SELECT conv_id, turn, text, {_RETRY_ON} AS active, {_terms('text', P.RETRY_STOPS, 32)} AS w, {_named([(n, _m('low', p)) for n, p, _ in P.SIGNALS])} AS asks, {_PLAIN.format(x="coalesce(answer, '')")} AS e FROM q),
m AS (SELECT *, list_filter(w, lambda x: NOT contains(e, x)) AS missing FROM t), v AS (SELECT *, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(1 - len(missing) / len(w), 4) END AS coverage FROM m)
SELECT conv_id, turn, active, CAST(round(coverage * 1e6) AS BIGINT) AS coverage, array_to_string(list_slice(list_filter([{', '.join(said)}], lambda x: x IS NOT NULL), 1, 5), '|') AS queries FROM v"""


@query(_retry_sql())
def retry_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer that followed lacks, as a first pass's evidence, and the retry queries for that."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("answer", F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(w)).filter("role = 'user'").select("conv_id", "turn", "text", "answer")
    p = P.planned(c)
    r = P.retries(F.col("text"), F.col("iterative.terms"), F.col("iterative.asks"), F.col("answer"), P.strings([]))
    return p.select("conv_id", "turn", F.col("iterative.active").alias("active"), T.micro(r["coverage"]).alias("coverage"), F.array_join(r["queries"], "|").alias("queries"))


def _tool_sql() -> str:
    dependent = {"sql_database": _SQL_ON, "api": _API_ON, "iterative": _RETRY_ON, "query_decomposition": _PARTS_ON, "multi_hop": _HOPS_ON}
    tests = [(name, f"(kind IN ({', '.join(map(_lit, kinds.split()))}) OR {_m('low', p)} OR {_routes(*used.split())} OR {dependent.get(name, 'false')})") for name, p, kinds, used, _ in P.TOOLS]
    intent = reduce(lambda out, x: f"CASE WHEN list_contains(tools, {_lit(x[0])}) THEN {_lit(x[1])} ELSE {out} END", reversed(P.TOOL_INTENTS), "'hybrid_search_tooling'")
    more = " + ".join(f"CASE WHEN list_contains({_list(names.split())}, t) AND " + (f"kind IN ({', '.join(map(_lit, kinds.split()))})" if kinds else _m("low", p)) + f" THEN {x} ELSE 0.0 END" for names, kinds, p, x in P.PRIORITIES)
    return f"""WITH n AS (SELECT *, list_slice({_named(tests)}, 1, 10) AS found FROM {_ASKED}), u AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['semantic_vector', 'keyword_sparse'] END AS tools FROM n),
p AS (SELECT conv_id, turn, kind, low, tools, unnest(tools) AS t FROM u), s AS (SELECT conv_id, turn, sum(CAST(round(least(1.45, 1.0 + {more}) * 1e6) AS BIGINT)) AS priority FROM p GROUP BY ALL)
SELECT conv_id, turn, array_to_string(tools, '|') AS tools, {intent} AS intent, CAST(priority AS BIGINT) AS priority FROM u JOIN s USING (conv_id, turn)"""


@query(_tool_sql())
def tool_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("tool.priorities", F.lit(0).cast("bigint"), lambda a, x: a + T.micro(x))
    return _questions(spark, sf_dir).select("conv_id", "turn", _joined("tool.tools"), F.col("tool.intent").alias("intent"), total.alias("priority"))


_FOCUS = _ordered(f"list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.:/-]{{2,}}'), lambda t: NOT list_contains({_list(P.AGENT_STOPS)}, t))")
_NEEDS = " || ".join(f"CASE WHEN {_m('lower(text)', p)}" + (f" OR kind IN ({', '.join(map(_lit, kinds.split()))})" if kinds else "") + f" THEN {_list(words)} ELSE [] END" for _, p, kinds, words, _ in P.AGENT_NEEDS)


@query(f"SELECT conv_id, turn, active, array_to_string(CASE WHEN active THEN f[1:16] ELSE f END, '|') AS focus, array_to_string(CASE WHEN active THEN list_filter(r, lambda v, i: list_position(r, v) = i) ELSE [] END, '|') AS required FROM (SELECT conv_id, turn, {_routes('agentic')} AS active, {_FOCUS} AS f, {_NEEDS} AS r FROM {_ASKED})")
def agent_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", F.col("agent.active").alias("active"), _joined("agent.focus"), _joined("agent.required"))


@query()
def planned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that stand for each question, in order. An outer explode, for the filter that the optimizer infers for the other would
    be pushed through all steps and written out anew at each."""
    return _questions(spark, sf_dir).select("conv_id", "turn", "route", F.posexplode_outer("queries").alias("place", "query"))


_HOP_SPLIT = r"(?i)\b(?:then|after that|next|and then|before|after|because|therefore|so that|related to|connected to|depends on|requires)\b|[;?]"


def _pieces(pattern: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(q, '{pattern}', chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^[ .,:;-]+|[ .,:;-]+$', '', 'g')), lambda p: length(p) > 5)"


def _hops_sql() -> str:
    relation = reduce(lambda out, x: f"CASE WHEN contains(low, {_lit(x[0])}) THEN {_lit(x[1])} ELSE {out} END", reversed(Q.RELATION_SIGNS), "'semantic_context'")
    intent = reduce(lambda out, x: f"CASE WHEN {_m('low', x[1])} THEN {_lit(x[0])} ELSE {out} END", reversed(Q.HOP_INTENTS), "CASE WHEN relation != 'semantic_context' THEN 'relationship_evidence' ELSE 'semantic_evidence' END")
    weight = reduce(lambda out, x: f"CASE WHEN {_m('low', x[1])} THEN {x[2]} ELSE {out} END", reversed(Q.HOP_INTENTS), "CASE WHEN relation != 'semantic_context' THEN 1.15 ELSE 1.0 END")
    return f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user'),
p AS (SELECT id, {_pieces(_HOP_SPLIT)} AS a, {_pieces(r"(?i)\b(?:and|with|between|versus|vs\.?|compared to)\b")} AS b FROM q), l AS (SELECT id, CASE WHEN len(a) > 1 THEN a ELSE b END AS l FROM p), d AS (SELECT id, list_slice(list_filter(l, lambda v, i: list_position(l, v) = i), 1, 6) AS l FROM l),
h AS (SELECT id, unnest(range(1, len(l) + 1)) AS hop, unnest(l) AS query FROM d), r AS (SELECT *, lower(query) AS low, {relation.replace("low", "lower(query)")} AS relation FROM h)
SELECT id, CAST(hop AS INT) AS hop, query, relation, {intent} AS intent, CAST(round(round(({weight}) * CASE WHEN hop = 1 THEN 1.0 ELSE 0.92 END, 2) * 1e4) AS BIGINT) AS weight FROM r"""


@query(_hops_sql())
def question_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    h = Q.hops(q, "id")
    exact = F.round(F.col("weight") * 1e4).cast("bigint")
    return h.select("id", "hop", "query", "relation", "intent", exact.alias("weight"))
