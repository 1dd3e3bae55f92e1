"""The registered queries of the text operators, each over the whole of its table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.llm import (
    centroids, classifier, licences, main_text, mixing, near, perplexity, pieces, spans, token_files, topk, variants, warc,
)
from logweir.llm.common import table


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer's file; it travels to the tasks with their function."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier."""
    return spans.without_repeats(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    return warc.archived(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in the mix of all sources."""
    mix = mixing.mix_words(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_files.token_table(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, on shingles of four words."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries by name."""
    return {f.__name__: f for f in (
        op1_main_text, op2_spans, op3_warc, op4_pieces, op5_mixing, op6_perplexity, op7_token_files, op8_classifier,
        op9_near, op10_topk, op11_variants, op12_centroids, op13_licences, pipeline)}


def sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {
        "op3_warc": OP3, "op5_mixing": OP5, "op9_near": OP9, "op10_topk": OP10, "op11_variants": variants.duckdb_sql(),
        "op12_centroids": centroids.duckdb_sql(), "op13_licences": licences.duckdb_sql()}


OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (
  SELECT *, sum(source_size) OVER () AS whole,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST)),
l AS (SELECT *, (3 * whole - 4 * held) * weight / (2.0 * rest_weight) > 2 * source_size AS fills FROM r),
t AS (
  SELECT source, source_size, CASE WHEN fills THEN 2.0 * source_size ELSE
           CAST((3 * whole - 4 * coalesce(sum(CASE WHEN fills THEN source_size END) OVER (), 0)) * weight AS DOUBLE)
           / CAST(2 * sum(CASE WHEN NOT fills THEN weight END) OVER () AS DOUBLE) END AS target
  FROM l),
p AS (
  SELECT d.*, t.source_size, CAST(t.target AS DOUBLE) AS target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
         CAST(floor(t.target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(
         budget // source_size * size + greatest(0, least(size, budget % source_size - earlier)) AS BIGINT) END AS taken
FROM p
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_common >= 80 * (a.n + b.n - n_common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
