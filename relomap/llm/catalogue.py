"""The subpackage's queries: thin digests of its operators over the driver's tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relomap.llm.common import held_side, train_side
from relomap.llm.exact_dedup import exact_dedup
from relomap.llm.langid import fit_language, identify_language
from relomap.llm.lattice import LatticeOptions, score_documents
from relomap.llm.line_dedup import dedup_lines
from relomap.llm.ngram_join import ngram_join
from relomap.llm.packing import PackOptions, pack_documents
from relomap.llm.pieces import encode_documents
from relomap.llm.quality import fit_quality, score_quality
from relomap.llm.sharding import shard_documents
from relomap.llm.topk import top_k


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_language(docs, train_side("doc_id", 4, 2))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_side("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_side("doc_id", 4, 2))
    found = score_quality(docs, model)
    return found.select("doc_id", held_side("doc_id", 4, 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), digests=True)


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = score_documents(docs, train_side("doc_id", 7, 2), LatticeOptions(vocabulary=tokenizer_path("piece_bpe_32k.model")))
    return scored.select("doc_id", (~F.col("learned_from")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), PackOptions(tokenizer=tokenizer_path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_top_k": op6_top_k,
    "op7_quality": op7_quality,
    "op8_pieces": op8_pieces,
    "op9_lattice": op9_lattice,
    "op10_packing": op10_packing,
}

#: ``\x20\x09-\x0D`` deleted, as DuckDB says it.
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w)),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS k FROM g GROUP BY 1),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y, nx.k AS kx, ny.k AS ky FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c::DOUBLE / (nx.n + ny.n - c) >= 0.8),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
        classes AS (SELECT x, min(y) AS class_id, count(*) AS class_size FROM reach GROUP BY 1),
        links AS (SELECT x, count(*) AS n_links, count(DISTINCT ky) FILTER (ky <> kx) AS n_set_links FROM l GROUP BY 1)
        SELECT classes.x AS doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links, coalesce(n_set_links, 0) AS n_set_links FROM classes LEFT JOIN links USING (x)""",
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORM}) AS h FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY h) AS size FROM d)
        SELECT doc_id, keep_id, size AS group_size, keep_id = doc_id AS kept, h AS text_sha256 FROM w""",
    "op6_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
