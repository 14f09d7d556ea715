"""The operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmesa.llm import embedding_dedup, fingerprints, html_extraction, jaccard_join, packing, pii, piece_encoding, quality, suffix_dedup, warc
from docmesa.llm.common import prepare, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(prepare(spark), sf_dir, "documents")
    return quality.score_documents(documents, quality.train(documents, read_table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read_table(prepare(spark), sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(read_table(prepare(spark), sf_dir, "pages"), html_extraction.train())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(prepare(spark), sf_dir, "pages"))


def op5_pieces(spark: SparkSession, sf_dir: str, model: str = "") -> DataFrame:
    with open(model or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return piece_encoding.digest_documents(read_table(prepare(spark), sf_dir, "documents"), f.read())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(prepare(spark), sf_dir, "documents"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(prepare(spark), sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(prepare(spark), sf_dir, "documents"), pii.train())


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(prepare(spark), sf_dir, "documents"), words=3, top=90, bottom=100)


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "") -> DataFrame:
    with open(tokenizer or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.pack_documents(read_table(prepare(spark), sf_dir, "documents"), f.read(), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_suffix_dedup, op3_main_text, op4_warc, op5_pieces, op6_fingerprints, op7_near_vectors, op8_pii, op9_jaccard, op10_packing)}
_WINDOW = 50

OP2_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, CAST(2 * c + 1 AS INT), {2 * (500 + _WINDOW - 1)}) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {_WINDOW - 1}, 500)) AS c FROM d)),
w AS (SELECT doc_id, c + j AS i, substr(g, CAST(2 * j + 1 AS INT), {2 * _WINDOW}) AS x FROM (SELECT doc_id, c, g, unnest(range(length(g) // 2 - {_WINDOW - 1})) AS j FROM c)),
f AS (SELECT x, min(doc_id) AS f FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
k AS (SELECT doc_id, i, f FROM w JOIN f USING (x)),
m AS (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -{2 * _WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) + {_WINDOW} THEN 1 ELSE 0 END AS fresh FROM k WHERE f < doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM m),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {_WINDOW} AS b FROM g GROUP BY doc_id, s),
cuts AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
kept AS (SELECT c.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS INT), CAST(2 * (a - before) AS INT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS INT)) AS x, sum(b - a) AS removed, count(*) AS spans FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr(" + _LETTERS + ", CAST(((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '')"

OP4_SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to FROM p"""

_REACH = "r AS (SELECT id, id AS x FROM n UNION SELECT r.id, b FROM r JOIN e ON r.x = e.a)"

OP7_SQL = f"""WITH RECURSIVE n AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n WHERE label IS NOT NULL AND list_dot_product(v, v) > 0),
e AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.label = q.label AND p.id != q.id WHERE list_dot_product(p.v, q.v) >= 0.93), {_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM e WHERE a = n.id) AS n_links, min(x) AS component_id, n.id = min(x) AS kept, CAST(1.0 AS DOUBLE) AS audit_recall FROM n JOIN r ON r.id = n.id GROUP BY n.id"""

OP9_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id AS id, len(s) AS k FROM s), t AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM t p JOIN t q USING (x) WHERE p.doc_id != q.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * i >= 90 * (p.k + q.k - i)), {_REACH}
SELECT n.id AS doc_id, k AS n_shingles, min(x) AS component_id FROM n JOIN r ON r.id = n.id GROUP BY n.id, k"""

ORACLE: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op7_near_vectors": OP7_SQL, "op9_jaccard": OP9_SQL}
