"""Queries over documents as text, lines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmesa.functions import text as T
from docmesa.functions import vocab
from docmesa.operators import blocks as B
from docmesa.operators import chunk as C
from docmesa.operators import dedupe as D
from docmesa.plans.registry import query, table

#: The normalised text in DuckDB; typographic characters and compatibility forms do not occur in the driver's tables.
NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '\b[0-9]+\s*/\s*[0-9]+\b', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({NORMAL}, ' '), lambda w: w != '')"
SIGNED = f"SELECT doc_id, source, lang, text, {WORDS} AS words, substr(sha1({NORMAL}), 1, 20) AS exact_signature FROM documents"
LINE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '([A-Za-z])-\s+([a-z])', '\1\2', 'g'), '\s+([,.;:!?%)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g'), '\b([A-Za-z])\s*/\s*([A-Za-z])\b', '\1/\2', 'g'), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g'), '^[ \t\r\n|]+|[ \t\r\n|]+$', '', 'g')"
PRINT = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({LINE}), '\b[0-9]{{1,4}}([/-][0-9]{{1,2}}){{1,2}}\b', '<date>', 'g'), '\b[0-9]+\s*(of|/)\s*[0-9]+\b', '<page>', 'g'), '\b[0-9]+\b', '<num>', 'g'), '[^a-z0-9<>]+', ' ', 'g'))"
LINES = "SELECT doc_id, i AS line_no, string_split(text, chr(10))[i + 1] AS line FROM documents, unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) AS u(i)"
MARKED = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s != '')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, exact_signature, len(words) AS n_words, substr(sha1(array_to_string(words[1:100], ' ')), 1, 20) AS prefix_signature FROM ({SIGNED})")
def dedupe_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fingerprints(_documents(spark, sf_dir), composed=False).select("doc_id", "exact_signature", "n_words", "prefix_signature")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY source, exact_signature ORDER BY doc_id) = 1 AS kept FROM ({SIGNED})")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.fingerprints(_documents(spark, sf_dir).select("doc_id", "source", "text"), composed=False)
    return D.with_first(d.select("doc_id", "source", "exact_signature"), "exact_signature", ["source"], "doc_id").select("doc_id", "kept")


@query(f"SELECT source, count(*) AS documents, count(DISTINCT p) AS prefixes, count(*) - count(DISTINCT p) AS removed FROM (SELECT source, substr(sha1(array_to_string(words[1:100], ' ')), 1, 20) AS p FROM ({SIGNED})) GROUP BY source")
def prefix_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.fingerprints(_documents(spark, sf_dir).select("doc_id", "source", "text"), composed=False).select("doc_id", "source", "prefix_signature")
    kept = D.with_first(d, "prefix_signature", ["source"], "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("kept").alias("prefixes"), F.count_if(~F.col("kept")).alias("removed"))


_PAIRS = f"""
WITH d AS (SELECT doc_id, list_distinct(words) AS w, len(words) AS n,
    CASE WHEN len(words) < 5 THEN list_distinct(words) ELSE list_distinct(list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))) END AS s,
    list_sort(list_distinct(regexp_extract_all(lower(text), '\\b[0-9]+(\\.[0-9]+)?(\\s*[:/]\\s*[0-9]+(\\.[0-9]+)?)?\\b'))) AS k FROM ({SIGNED}) WHERE len(words) >= 12),
f AS (SELECT doc_id, unnest(w) AS x, len(w) AS n FROM d), e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM d),
g AS (SELECT doc_id, x FROM f JOIN (SELECT x, count(*) AS df FROM f GROUP BY x) USING (x) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, x) <= n - ceil(0.9 * n) + 1),
h AS (SELECT doc_id, x FROM e JOIN (SELECT x, count(*) AS df FROM e GROUP BY x) USING (x) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, x) <= n - ceil(0.72 * n) + 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b USING (x) WHERE a.doc_id < b.doc_id UNION SELECT a.doc_id, b.doc_id FROM h a JOIN h b USING (x) WHERE a.doc_id < b.doc_id),
p AS (SELECT c.a, c.b, len(list_intersect(l.w, r.w)) AS iw, len(l.w) AS lw, len(r.w) AS rw, len(list_intersect(l.s, r.s)) AS js, len(l.s) AS ls, len(r.s) AS rs FROM c JOIN d l ON l.doc_id = c.a JOIN d r ON r.doc_id = c.b WHERE l.k = r.k),
q AS (SELECT a, b, iw / (lw + rw - iw) AS jaccard, iw / least(lw, rw) AS containment, js / (ls + rs - js) AS shingle FROM p)
SELECT a, b, CASE WHEN jaccard >= 0.9 THEN 'near_duplicate_jaccard' WHEN containment >= 0.92 AND shingle >= 0.72 THEN 'near_duplicate_containment' ELSE 'near_duplicate_shingle' END AS reason,
    CAST(round(jaccard * 1e6) AS BIGINT) AS jaccard, CAST(round(shingle * 1e6) AS BIGINT) AS shingle FROM q WHERE jaccard >= 0.9 OR (containment >= 0.92 AND shingle >= 0.72) OR shingle >= 0.86"""


@query(_PAIRS)
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.fingerprints(_documents(spark, sf_dir).select("doc_id", "text"), composed=False)
    return D.near_pairs(d, "doc_id").select("a", "b", "reason", T.micro(F.col("jaccard")).alias("jaccard"), T.micro(F.col("shingle")).alias("shingle"))


@query()
def near_duplicate_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keep_first(_documents(spark, sf_dir).select("doc_id", "source", "text"), "doc_id", "source")


@query(f"SELECT doc_id, line_no, {PRINT} AS fingerprint FROM ({LINES})")
def line_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.lines_as_blocks(_documents(spark, sf_dir))
    return b.select("doc_id", F.col("block_no").alias("line_no"), T.line_fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT doc_id, fp AS fingerprint, count(*) AS times FROM (SELECT doc_id, {PRINT} AS fp FROM ({LINES})) WHERE fp != '' GROUP BY doc_id, fp HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_fingerprint(B.lines_as_blocks(_documents(spark, sf_dir))).filter("fp != ''")
    return b.groupBy("doc_id", F.col("fp").alias("fingerprint")).agg(F.count("*").alias("times")).filter("times > 1")


@query(f"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, line, fp, row_number() OVER (PARTITION BY doc_id, fp ORDER BY line_no) AS nth FROM (SELECT doc_id, line_no, line, {PRINT} AS fp FROM ({LINES}))) WHERE nth = 1 OR length(line) >= 220 OR fp = '' GROUP BY doc_id")
def first_lines_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.first_on_page(B.with_fingerprint(B.lines_as_blocks(_documents(spark, sf_dir))))
    return b.groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, line, fp, lag(fp, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (SELECT doc_id, line_no, line, {PRINT} AS fp FROM ({LINES}))) WHERE fp != '' AND fp = before AND length(line) < 160")
def adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_fingerprint(B.lines_as_blocks(_documents(spark, sf_dir)))
    return b.join(B.drop_adjacent_repeats(b).select("doc_id", "block_no"), ["doc_id", "block_no"], "left_anti").select("doc_id", F.col("block_no").alias("line_no"))


@query()
def cleaned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.remove_noise(B.lines_as_blocks(_documents(spark, sf_dir))).select("doc_id", "block_no", "text")


@query(f"SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, {MARKED} AS s FROM documents)")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("bigint").alias("longest"))


_TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.-]+'), lambda t: regexp_replace(lower(t), '^[._-]+|[._-]+$', '', 'g'))"
_SINGULAR = "CASE WHEN t LIKE '%s' AND length(t) > 4 AND t NOT LIKE '%ss' AND t NOT LIKE '%us' THEN t[1:length(t) - 1] ELSE t END"
_STOPS = ", ".join(f"'{w}'" for w in vocab.STOPWORDS)
_KEPT = f"SELECT doc_id, t FROM (SELECT doc_id, {_SINGULAR} AS t FROM (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents)) WHERE length(t) >= 2 AND t NOT IN ({_STOPS}) AND (CASE WHEN t LIKE '%s' AND length(t) > 4 THEN t[1:length(t) - 1] ELSE t END) NOT IN ({_STOPS})"


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", F.explode(F.transform(T.tokens(F.col("text")), T.keyword_token)).alias("t"))
    return d.filter(T.keyword_keep(F.col("t")))


@query(f"SELECT doc_id, t AS term, n, CAST(round(least(3.0, 0.8 + 0.35 * n) * 1e6) AS BIGINT) AS weight FROM (SELECT doc_id, t, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY least(3.0, 0.8 + 0.35 * count(*)) DESC, t) AS r FROM ({_KEPT}) GROUP BY doc_id, t) WHERE r <= 30")
def keyword_weights_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _keywords(spark, sf_dir).groupBy("doc_id", F.col("t").alias("term")).agg(F.count("*").alias("n"))
    c = c.withColumn("w", F.least(F.lit(3.0), 0.8 + 0.35 * F.col("n")))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))
    return c.withColumn("r", r).filter("r <= 30").select("doc_id", "term", "n", T.micro(F.col("w")).alias("weight"))


@query(f"SELECT doc_id, t AS term, n FROM (SELECT doc_id, t, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, t) AS r FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(lower(text), '[a-z0-9_.:/&+-]+'), lambda x: x)) AS t FROM documents) WHERE length(t) >= 2 GROUP BY doc_id, t) WHERE r <= {vocab.SPARSE_TERMS}")
def sparse_terms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_.:/&+-]+"), F.lit(0))).alias("term")).filter("length(term) >= 2")
    c = d.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))).filter(F.col("r") <= vocab.SPARSE_TERMS).drop("r")


_ASKED = ["licensed", "version", "license", "apache"]


@query(f"WITH k AS (SELECT DISTINCT doc_id, t FROM ({_KEPT})), a AS (SELECT doc_id, t FROM k WHERE t IN ({', '.join(repr(t) for t in _ASKED)})) SELECT term, related, n FROM (SELECT a.t AS term, k.t AS related, count(*) AS n, row_number() OVER (PARTITION BY a.t ORDER BY count(*) DESC, k.t) AS r FROM a JOIN k USING (doc_id) WHERE k.t NOT IN ({', '.join(repr(t) for t in _ASKED)}) GROUP BY a.t, k.t) WHERE r <= 8")
def cooccurrence_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring(_documents(spark, sf_dir), _ASKED)


def cooccurring(documents: DataFrame, asked: list[str], most: int = 8) -> DataFrame:
    """For each asked term the keywords that come most often in the same documents. Documents without an asked term are left out before their words are told apart,
    and pairs are counted in each task before they are shuffled."""
    near = documents.filter(T.contains_any(F.lower("text"), asked)).select(F.array_distinct(F.filter(F.transform(T.tokens(F.col("text")), T.keyword_token), T.keyword_keep)).alias("w"))
    terms = F.array(*[F.lit(t) for t in asked])
    pairs = near.select(F.explode(F.array_intersect("w", terms)).alias("term"), F.array_except("w", terms).alias("w")).select("term", F.explode("w").alias("related"))
    c = pairs.groupBy("term", "related").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "related"))).filter(F.col("r") <= most).drop("r")


@query(f"SELECT doc_id, line_no, heading FROM (SELECT doc_id, line_no, line, length(line) <= 140 AND NOT line LIKE '%.' AND regexp_matches(line, '^([0-9]+\\.)*[0-9]+\\s+.') AS heading FROM ({LINES})) WHERE heading")
def numbered_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.lines_as_blocks(_documents(spark, sf_dir))
    return b.select("doc_id", F.col("block_no").alias("line_no"), ((F.length("text") <= 140) & ~F.endswith("text", F.lit(".")) & F.rlike("text", F.lit(vocab.SECTION_NUMBER))).alias("heading")).filter("heading")


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with invented headings: a short line is one, its level follows from its length."""
    b = B.lines_as_blocks(_documents(spark, sf_dir)).withColumn("heading", F.length("text").between(1, 40))
    return b.withColumn("level", (F.length("text") % 3 + 1).cast("int"))


_LEVELS = f"WITH l AS (SELECT doc_id, line_no, line, length(line) BETWEEN 1 AND 40 AS h, length(line) % 3 + 1 AS lv FROM ({LINES}))"


@query(f"""{_LEVELS}, w AS (SELECT doc_id, line_no, {', '.join(f"max(CASE WHEN h AND lv = {n} THEN line_no END) OVER o AS p{n}, max_by(CASE WHEN h AND lv = {n} THEN line END, CASE WHEN h AND lv = {n} THEN line_no END) OVER o AS n{n}" for n in (1, 2, 3))} FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, line_no, array_to_string(list_filter([CASE WHEN p1 >= 0 THEN n1 END, CASE WHEN p2 > coalesce(p1, -1) THEN n2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN n3 END], lambda x: x IS NOT NULL), ' > ') AS path FROM w""")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.heading_stack(_leveled(spark, sf_dir))
    return b.select("doc_id", F.col("block_no").alias("line_no"), F.array_join("section_path", " > ").alias("path"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.with_ids(C.with_overlap(C.document_chunks(_documents(spark, sf_dir))))
    return C.diagnostics(c).select("doc_id", "chunk_index", "chunk_id", "text", "section", "boundary", "overlap", "chars", "size_class", "chunk_score", "previous_chunk_id", "next_chunk_id", "section_position")


_FIXED = r"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS begin_, CAST(0 AS BIGINT) AS stop, '' AS piece FROM t WHERE t != ''
UNION ALL SELECT doc_id, t, n + 1, a, e, substr(t, a + 1, e - a) FROM (SELECT doc_id, t, n, a, CASE WHEN a + 1200 < length(t) AND k > a + 660 THEN k + 1 ELSE least(length(t), a + 1200) END AS e FROM
(SELECT doc_id, t, n, a, a + 1200 - strpos(reverse(substr(t, a + 1, 1200)), ' .') - 1 + CASE WHEN strpos(reverse(substr(t, a + 1, 1200)), ' .') = 0 THEN -100000 ELSE 0 END AS k FROM
(SELECT doc_id, t, n, CASE WHEN n = 0 THEN 0 ELSE greatest(stop - 180, begin_ + 1) END AS a FROM w WHERE n = 0 OR stop < length(t)))))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS chunk_index, trim(piece) AS text FROM w WHERE n > 0 AND trim(piece) != ''"""


@query(_FIXED)
def fixed_size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_chunks(_documents(spark, sf_dir))


_CHUNKED = f"SELECT doc_id, line_no + 1 AS chunk_index, line AS text, lang AS section FROM ({LINES}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of their document; its language is their section."""
    d = _documents(spark, sf_dir)
    b = B.lines_as_blocks(d).join(d.select("doc_id", "lang"), "doc_id")
    one = F.lit(1).cast("bigint")
    return b.select("doc_id", (F.col("block_no") + 1).alias("chunk_index"), "text", F.col("lang").alias("section"), one.alias("page_start"), one.alias("page_end"))


_ID = f"substr(sha1(chunk_index || '|1|1|' || section || '|' || substr({NORMAL}, 1, 240)), 1, 16)"


@query(f"SELECT doc_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS previous_chunk_id, lead(chunk_id) OVER w AS next_chunk_id, row_number() OVER w AS section_position, count(*) OVER (PARTITION BY doc_id, section) AS section_chunks FROM (SELECT *, {_ID} AS chunk_id FROM ({_CHUNKED})) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.links(C.with_ids(_line_chunks(spark, sf_dir), composed=False))
    return c.select("doc_id", "chunk_index", "chunk_id", "previous_chunk_id", "next_chunk_id", "section_position", "section_chunks")


@query(f"""SELECT doc_id, chunk_index, length(text) AS chars, CASE WHEN length(text) < 180 THEN 'small' WHEN length(text) <= 1700 THEN 'healthy' ELSE 'large' END AS size_class,
CAST(round(greatest(0.0, 1.0 - CASE WHEN length(text) < 180 THEN 0.2 ELSE 0 END - CASE WHEN length(text) > 1700 THEN 0.35 ELSE 0 END - CASE WHEN regexp_matches(trim(text), '^(TABLE:|[A-Z0-9(\\[*•-])') THEN 0 ELSE 0.25 END - CASE WHEN regexp_matches(trim(text), '[.!?;:)\\]|]$') THEN 0 ELSE 0.25 END) * 1e6) AS BIGINT) AS score FROM ({_CHUNKED})""")
def chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diagnostics(_line_chunks(spark, sf_dir)).select("doc_id", "chunk_index", "chars", "size_class", T.micro(F.col("chunk_score")).alias("score"))


@query("SELECT doc_id, item_id, n FROM (SELECT d.doc_id, b.item_id, len(list_intersect(d.w, b.w)) AS n, len(b.w) AS m FROM (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) d JOIN (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark) b ON len(list_intersect(d.w, b.w)) * 2 >= len(b.w))")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of the distinct words of a benchmark item."""
    words = lambda d, i: d.select(i, F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    d, b = words(_documents(spark, sf_dir), "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id").withColumn("m", F.size("w"))
    shared = d.select("doc_id", F.explode("w").alias("x")).join(b.select("item_id", "m", F.explode("w").alias("x")), "x")
    return shared.groupBy("doc_id", "item_id", "m").agg(F.count("*").alias("n")).filter("n * 2 >= m").select("doc_id", "item_id", "n")


@query()
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merge_wrapped(B.lines_as_blocks(_documents(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN length(p) <= 88 THEN p ELSE rtrim(p[1:85]) || '...' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM documents)")
def document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.preview(F.col("text"), 88).alias("preview"))
