"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, perplexity band and verdict of every document."""
    from cuboid.llm.quality import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = quality_rules(docs, keep=["doc_id", "lang"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower", "upper")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from cuboid.llm.setjoin import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL["op3_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), t AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.v) AS component_id FROM n JOIN r ON r.u = n.doc_id GROUP BY ALL
"""


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the paragraphs and spans that repeat an earlier one, and where their first copies are."""
    from cuboid.llm.paragraphs import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_removed", "text", "removed_lines", "kept_in")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    from cuboid.llm.mixing import mix_sources, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    out = mix_sources(docs, "size")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


#: The rules of op6.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    from cuboid.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, keep=["page_id"])


ORACLE_SQL["op6_url_filter"] = r"""
WITH r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
a AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substring(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substring(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC) AS k
  FROM c JOIN r ON (c.host = split_part(r.rule, '/', 1) OR ends_with(c.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(c.path, substring(r.rule, position('/' IN r.rule))))
SELECT c.page_id, c.host, c.path, d.rule, coalesce(d.verdict, 'allow') AS verdict
FROM c LEFT JOIN d ON d.page_id = c.page_id AND d.k = 1
"""


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after writing WARC archives and reading them back."""
    from cuboid.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    from cuboid.llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels"), keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


#: The vocabulary file is a parameter; this is the place of the public one.
PIECES_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text, and whether they decode to it."""
    from cuboid.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES_MODEL, keep=["doc_id"])


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from cuboid.llm.maintext import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


@query
def op4_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of the embeddings: classes of equal fingerprints, and what aligns with every 20th one."""
    from cuboid.llm.audio import melodies, search_recordings

    return search_recordings(melodies(table(spark, sf_dir, "embeddings")), id_column="vec_id")


#: The vocabulary file is a parameter; this is the place of the public one.
COUNTED_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    from cuboid.llm.tokencounts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), COUNTED_VOCABULARY, keep=["doc_id"])


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row: rows of other labels just less alike than its positives."""
    from cuboid.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))


ORACLE_SQL["op11_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language that stand together most tightly."""
    from cuboid.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k AS length, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k
), f AS MATERIALIZED (SELECT lang, length, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE length > 1),
q AS (SELECT lang, phrase, length, a, k, array_to_string(s[1:k], ' ') AS first, array_to_string(s[k + 1:], ' ') AS rest FROM c, range(1, 5) r(k) WHERE k < length),
s AS (
  SELECT q.lang, q.phrase, q.a, q.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * q.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM q JOIN f x ON x.lang = q.lang AND x.phrase = q.first JOIN f y ON y.lang = q.lang AND y.phrase = q.rest JOIN t ON t.lang = q.lang
), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS z FROM s) WHERE z = 1),
i AS (
  SELECT c.lang, array_to_string(c.s[i:i + k - 1], ' ') AS phrase, max(c.a) AS longer FROM c, range(2, 5) r(k), range(1, 5) o(i) WHERE k < c.length AND i + k - 1 <= c.length GROUP BY ALL
), o AS (
  SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * m.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
