"""The engine's queries over the driver's tables, each with the DuckDB SQL that says the same.

The tables hold no diff documents, so regions are derived from them: lines of ``documents`` (or whole texts) with
``doc_id % 2`` as the side, 0 for deletions and 1 for insertions, and ``source`` as the file; and tags of ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relomap.functions.hashing import fnv1a64, move_id
from relomap.functions.text import SPACE, clamp, collapse_space, escape_canonical, files_of_paths, has_content, move_ids_label, pad_right, parse_position, path_union, preview, split_filename, trim_space
from relomap.model import FilterOptions
from relomap.operators import groups as G
from relomap.operators import matching as M
from relomap.operators import registry as R
from relomap.operators import spans as S
from relomap.operators.filters import filter_regions
from relomap.operators.nesting import sibling_numbers, tag_depth
from relomap.session import ship
from relomap.sources.lines import scan_lines
from relomap.sources.xml import scan_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Ids that a document's lines may take: more than a text of two gigabytes, the most a string holds, has lines.
LINE_IDS = 1 << 31
#: Tags of ``pages`` that are balanced on every page.
BALANCED = ["ul", "li", "a", "nav"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _side(doc_id: str = "doc_id"):
    return F.when(F.col(doc_id) % 2 == 0, "delete").otherwise("insert")


def doc_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as regions; the id of a candidate is its document's."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("candidate_id"), _side().alias("kind"), F.col("source").alias("filename"), F.col("text").alias("raw_text"), F.col("text").alias("canonical_text"))


def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as regions, numbered by document and line; canonical: white space collapsed."""
    docs = _table(spark, sf_dir, "documents")
    lines = scan_lines(docs, "doc_id", "text", keep=("source",))
    number = (F.col("id") * LINE_IDS + F.col("line_no")).cast("long")
    return lines.select(number.alias("candidate_id"), _side("id").alias("kind"), F.col("source").alias("filename"), F.col("line").alias("raw_text"), collapse_space(F.col("line")).alias("canonical_text"))


def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_regions(spark, sf_dir)
    return kept.where(has_content(F.col("raw_text")) & (F.octet_length("raw_text") >= FilterOptions().min_bytes))


_WS = SPACE
_COLLAPSE = rf"regexp_replace(regexp_replace({{0}}, '[{_WS}]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_LINES = f"""
    raw_lines AS (SELECT doc_id, source, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line,
                         generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS line_no
                  FROM documents WHERE text <> ''),
    regions AS (SELECT doc_id * {LINE_IDS} + line_no AS candidate_id, CASE WHEN doc_id % 2 = 0 THEN 'delete' ELSE 'insert' END AS kind,
                       source AS filename, line AS raw_text, {_COLLAPSE.format('line')} AS canonical_text FROM raw_lines),
    candidates AS (SELECT * FROM regions WHERE regexp_matches(raw_text, '[^{_WS}]') AND strlen(raw_text) >= 2)"""
_COUNTS = """
    counts AS (SELECT canonical_text, count(*) FILTER (kind = 'delete') AS dels, count(*) FILTER (kind = 'insert') AS ins,
                      min(candidate_id) AS first_id FROM candidates GROUP BY 1),
    kinds AS (SELECT *, CASE WHEN dels = 0 AND ins = 0 THEN 'ambiguous' WHEN ins = 0 THEN 'delete_only' WHEN dels = 0 THEN 'insert_only'
                             WHEN dels = 1 AND ins = 1 THEN 'move_1_to_1' WHEN dels = ins THEN 'moves_many' ELSE 'copy_or_repeat' END AS kind FROM counts)"""
_DOCS = """
    candidates AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 2 = 0 THEN 'delete' ELSE 'insert' END AS kind, source AS filename,
                          text AS raw_text, text AS canonical_text FROM documents)"""


@_query("group_kind_histogram", f"WITH {_LINES}, {_COUNTS} SELECT kind, count(*) AS groups FROM kinds GROUP BY 1")
def group_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kind_histogram(G.group_counts(line_candidates(spark, sf_dir)))


@_query("group_kind_histogram_docs", f"WITH {_DOCS}, {_COUNTS} SELECT kind, count(*) AS groups FROM kinds GROUP BY 1")
def group_kind_histogram_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kind_histogram(G.group_counts(doc_regions(spark, sf_dir)))


@_query("region_filter_default", f"WITH {_LINES} SELECT candidate_id, kind, filename, strlen(raw_text) AS n_bytes FROM candidates")
def region_filter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = line_regions(spark, sf_dir).withColumns({"has_diff_child": F.lit(False), "parent_id": F.lit(None).cast("long"), "pre_marked": F.lit(False)})
    return filter_regions(flags).select("candidate_id", "kind", "filename", F.octet_length("raw_text").cast("long").alias("n_bytes"))


@_query("region_filter_min_bytes", f"WITH {_LINES} SELECT filename, count(*) AS kept, sum(strlen(raw_text))::BIGINT AS n_bytes FROM regions WHERE strlen(raw_text) >= 40 GROUP BY 1")
def region_filter_min_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filter_regions(line_regions(spark, sf_dir), FilterOptions(policy="all_regions", drop_whitespace_only=False, min_bytes=40))
    return kept.groupBy("filename").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.octet_length("raw_text")).cast("long").alias("n_bytes"))


@_query("whitespace_lines", f"WITH {_LINES} SELECT filename, count(*) AS n FROM regions WHERE NOT regexp_matches(raw_text, '[^{_WS}]') GROUP BY 1")
def whitespace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_regions(spark, sf_dir).where(~has_content(F.col("raw_text"))).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "canonical_text",
    f"""SELECT doc_id, md5({_COLLAPSE.format('text')}) AS collapsed_md5, md5(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t')) AS escaped_md5,
               md5(regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g')) AS trimmed_md5 FROM documents""",
)
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", md5(collapse_space(text)).alias("collapsed_md5"), md5(escape_canonical(text)).alias("escaped_md5"), md5(trim_space(text)).alias("trimmed_md5"))


_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(1, strlen({0})), lambda i: CAST(concat('0x', substr(hex({0}), (2 * i - 1)::BIGINT, 2)) AS HUGEINT))),
          lambda h, b: ((((xor((h % 256)::INTEGER, b::INTEGER)::HUGEINT + h - h % 256)) * 435) % 18446744073709551616
                        + (((xor((h % 256)::INTEGER, b::INTEGER)::HUGEINT + h - h % 256) % 16777216) * 1099511627776)) % 18446744073709551616)"""


@_query("fnv_hash", f"SELECT n_nationkey, CAST({_FNV.format('n_name')} AS VARCHAR) AS hash FROM nation")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _table(spark, sf_dir, "nation").select("n_nationkey", fnv1a64(F.col("n_name")).cast("string").alias("hash"))


@_query("fnv_hash_lines", f"SELECT item_id, CAST({_FNV.format('text')} AS VARCHAR) AS hash FROM benchmark")
def fnv_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return _table(spark, sf_dir, "benchmark").select("item_id", fnv1a64(F.col("text")).cast("string").alias("hash"))


@_query(
    "content_groups",
    f"""WITH {_LINES}, {_COUNTS}, ids AS (SELECT canonical_text, string_agg(candidate_id::VARCHAR, ',' ORDER BY candidate_id) FILTER (kind = 'delete') AS d,
        string_agg(candidate_id::VARCHAR, ',' ORDER BY candidate_id) FILTER (kind = 'insert') AS i FROM candidates GROUP BY 1)
        SELECT row_number() OVER (ORDER BY first_id) - 1 AS group_id, md5(canonical_text) AS content_md5, coalesce(d, '') AS del_ids, coalesce(i, '') AS ins_ids, kinds.kind AS kind
        FROM kinds JOIN ids USING (canonical_text)""",
)
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = G.content_groups(line_candidates(spark, sf_dir))
    return groups.select("group_id", F.md5(F.col("canonical_text").cast("binary")).alias("content_md5"), F.array_join("del_ids", ",").alias("del_ids"), F.array_join("ins_ids", ",").alias("ins_ids"), "kind")


@_query(
    "unconfirmed_groups",
    f"""WITH {_LINES}, short AS (SELECT substr(md5(canonical_text), 1, 3) AS bucket, kind, candidate_id FROM candidates)
        SELECT bucket, count(*) FILTER (kind = 'delete') AS dels, count(*) FILTER (kind = 'insert') AS ins, min(candidate_id) AS first_id FROM short GROUP BY 1""",
)
def unconfirmed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of three hexadecimal digits, so that contents collide."""
    short = line_candidates(spark, sf_dir).withColumn("bucket", F.substring(F.md5(F.col("canonical_text").cast("binary")), 1, 3))
    return G.group_counts(short, "bucket").drop("kind")


_RANKED = """
    ranked AS (SELECT canonical_text, kind, candidate_id, row_number() OVER (PARTITION BY canonical_text, kind ORDER BY candidate_id) AS rn FROM candidates),
    pairs AS (SELECT d.candidate_id AS del_id, i.candidate_id AS ins_id FROM ranked d JOIN ranked i ON d.canonical_text = i.canonical_text AND d.rn = i.rn
              AND d.kind = 'delete' AND i.kind = 'insert')"""


@_query("greedy_match", f"WITH {_LINES}, {_RANKED} SELECT del_id, ins_id FROM pairs")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.greedy_pairs(line_candidates(spark, sf_dir))


@_query("unmatched", f"WITH {_LINES}, {_RANKED} SELECT candidate_id, kind FROM candidates WHERE candidate_id NOT IN (SELECT del_id FROM pairs UNION ALL SELECT ins_id FROM pairs)")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = line_candidates(spark, sf_dir)
    return M.unmatched(candidates, M.greedy_pairs(candidates)).select("candidate_id", "kind")


_ALL = "SELECT d.candidate_id AS del_id, i.candidate_id AS ins_id FROM candidates d JOIN candidates i ON d.canonical_text = i.canonical_text AND d.kind = 'delete' AND i.kind = 'insert'"


@_query("all_pairs", f"WITH {_LINES} {_ALL}")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.all_pairs(line_candidates(spark, sf_dir), cap=None)


@_query(
    "capped_pairs",
    f"""WITH {_LINES}, {_COUNTS}, two AS (SELECT canonical_text, sum(dels * ins) OVER (ORDER BY first_id ROWS UNBOUNDED PRECEDING) AS s FROM counts WHERE dels > 0 AND ins > 0)
        {_ALL} JOIN two ON two.canonical_text = d.canonical_text AND two.s <= 300""",
)
def capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the operator's own parameter."""
    return M.all_pairs(line_candidates(spark, sf_dir), cap=300)


@_query(
    "move_summary",
    f"""WITH {_LINES}, {_COUNTS} SELECT count(*) FILTER (dels > 0 AND ins > 0) AS move_count, 2 * count(*) FILTER (dels > 0 AND ins > 0) AS annotated_regions,
        coalesce(sum(dels + ins) FILTER (dels > 0 AND ins > 0), 0)::BIGINT AS annotated_regions_actual, count(*) AS groups_total,
        (SELECT count(*) FROM candidates) AS candidates_total, (SELECT count(*) FROM regions) AS regions_total FROM counts""",
)
def move_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = line_candidates(spark, sf_dir)
    totals = line_regions(spark, sf_dir).agg(F.count(F.lit(1)).alias("_r"))
    summary = G.move_summary(F.lit(0), candidates, G.group_counts(candidates)).drop("regions_total").crossJoin(totals)
    return summary.withColumnRenamed("_r", "regions_total")


@_query(
    "registry_summary",
    f"""WITH {_LINES}, {_COUNTS} SELECT count(*) AS content_groups, sum(dels)::BIGINT AS delete_ids, sum(ins)::BIGINT AS insert_ids, """
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("move_1_to_1", "moves_many", "delete_only", "insert_only", "copy_or_repeat", "ambiguous"))
    + " FROM kinds",
)
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.registry_summary(G.group_counts(line_candidates(spark, sf_dir)))


@_query(
    "move_entries",
    f"""WITH {_LINES}, {_COUNTS} SELECT row_number() OVER (ORDER BY first_id) - 1 AS move_no, f.from_ids, f.to_ids, f.from_files
        FROM kinds JOIN (SELECT canonical_text, string_agg(candidate_id::VARCHAR, ' | ' ORDER BY candidate_id) FILTER (kind = 'delete') AS from_ids,
        string_agg(candidate_id::VARCHAR, ' | ' ORDER BY candidate_id) FILTER (kind = 'insert') AS to_ids,
        array_to_string(list_sort(list_distinct(list(filename) FILTER (kind = 'delete'))), ',') AS from_files FROM candidates GROUP BY 1) f USING (canonical_text)
        WHERE dels > 0 AND ins > 0""",
)
def move_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = G.content_groups(line_candidates(spark, sf_dir).join(G.group_counts(line_candidates(spark, sf_dir)).where("dels > 0 AND ins > 0").select("canonical_text"), "canonical_text", "left_semi"))
    files = line_candidates(spark, sf_dir).where("kind = 'delete'").groupBy("canonical_text").agg(F.array_sort(F.collect_set("filename")).alias("f"))
    ids = lambda c: path_union(F.col(c).cast("array<string>"))
    return groups.join(files, "canonical_text").select(F.col("group_id").alias("move_no"), ids("del_ids").alias("from_ids"), ids("ins_ids").alias("to_ids"), F.array_join("f", ",").alias("from_files"))


@_query(
    "annotation_tags",
    f"""WITH {_LINES}, {_COUNTS} SELECT c.candidate_id, c.kind, k.dels AS deletes, k.ins AS inserts, CASE WHEN c.kind = 'delete' THEN k.ins ELSE k.dels END AS partners
        FROM candidates c JOIN counts k USING (canonical_text) WHERE dels > 0 AND ins > 0""",
)
def annotation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = line_candidates(spark, sf_dir)
    two = G.group_counts(candidates).where("dels > 0 AND ins > 0").select("canonical_text", F.col("dels").alias("deletes"), F.col("ins").alias("inserts"))
    return candidates.join(two, "canonical_text").select("candidate_id", "kind", "deletes", "inserts", F.when(F.col("kind") == "delete", F.col("inserts")).otherwise(F.col("deletes")).alias("partners"))


@_query("move_ids")
def move_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents' moves, in order of their first candidate."""
    ship(spark)
    docs = doc_regions(spark, sf_dir)
    two = G.group_counts(docs).where("dels > 0 AND ins > 0").select("canonical_text")
    groups = G.content_groups(docs.join(two, "canonical_text", "left_semi"))
    return groups.select("group_id", move_id(F.col("group_id")).alias("move_id"))


@_query(
    "per_file_stats",
    """WITH c AS (SELECT source AS filename, doc_id % 2 = 0 AS del, doc_id % 3 <> 0 AS active FROM documents)
       SELECT filename, count(*) AS ids, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive, count(*) FILTER (del) AS dels, count(*) FILTER (NOT del) AS ins FROM c GROUP BY 1""",
)
def per_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document stands for a removed candidate."""
    return R.file_stats(doc_regions(spark, sf_dir).withColumn("active", F.col("candidate_id") % 3 != 0))


@_query(
    "registry_counts",
    """WITH c AS (SELECT source AS filename, text, doc_id % 3 <> 0 AS active FROM documents)
       SELECT count(DISTINCT filename) FILTER (active) AS files, count(*) AS total_records, count(*) FILTER (active) AS active_candidates, count(*) FILTER (NOT active) AS inactive_candidates,
              count(DISTINCT text) FILTER (active) AS buckets FROM c""",
)
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(doc_regions(spark, sf_dir).withColumn("active", F.col("candidate_id") % 3 != 0))


@_query(
    "registry_remove",
    "SELECT doc_id AS candidate_id, source AS filename, source NOT IN ('src0', 'src3') AS active FROM documents",
)
def registry_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = doc_regions(spark, sf_dir).withColumn("active", F.lit(True))
    gone = spark.createDataFrame([("src0",), ("src3",)], "filename string")
    return R.remove_files(registry, gone).select("candidate_id", "filename", "active")


@_query(
    "registry_replace",
    """WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS candidate_id, source AS filename, length(text) AS chars FROM documents),
            top AS (SELECT max(candidate_id) + 1 AS t FROM n),
            fresh AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 + (SELECT t FROM top) AS candidate_id, source AS filename, length(text) AS chars FROM documents WHERE source = 'src5')
       SELECT candidate_id, filename, chars, filename <> 'src5' AS active FROM n UNION ALL SELECT candidate_id, filename, chars, true FROM fresh""",
)
def registry_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's candidates are replaced by the same texts, under new ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), F.length("text").cast("long").alias("chars"))
    registry = R.number_candidates(docs, "doc_id")
    return R.replace_files(registry, docs.where("filename = 'src5'"), "doc_id").select("candidate_id", "filename", "chars", "active")


@_query(
    "top_buckets",
    f"""WITH {_LINES}, {_COUNTS} SELECT md5(canonical_text) AS content_md5, dels, ins, dels + ins AS members, kind, greatest((SELECT count(*) FROM counts) - 20, 0) AS not_shown
        FROM kinds ORDER BY dels + ins DESC, canonical_text LIMIT 20""",
)
def top_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report; k is its parameter."""
    top = G.top_buckets(G.group_counts(line_candidates(spark, sf_dir)), "canonical_text", 20)
    return top.select(F.md5(F.col("canonical_text").cast("binary")).alias("content_md5"), "dels", "ins", "members", "kind", "not_shown")


_TOKENS = r"""
    raw_tokens AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '<[^>]*>|[^<]+')) AS token, generate_subscripts(regexp_extract_all(html, '<[^>]*>|[^<]+'), 1) AS token_no FROM pages),
    tokens AS (SELECT id, token_no, token, CASE WHEN NOT starts_with(token, '<') THEN 'TEXT' WHEN regexp_matches(token, '^</[A-Za-z]') THEN 'END' WHEN regexp_matches(token, '^<[A-Za-z]') THEN 'START' ELSE 'OTHER' END AS kind,
                      nullif(lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') AS name FROM raw_tokens)"""
_NESTED = """
    leveled AS (SELECT *, sum(CASE WHEN kind = 'START' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY token_no) - CASE WHEN kind = 'START' THEN 1 ELSE 0 END AS depth
                FROM tokens WHERE name IN ('ul', 'li', 'a', 'nav') AND kind IN ('START', 'END')),
    nested AS (SELECT id, token_no, name, kind, depth::BIGINT AS depth, CASE WHEN kind = 'START' THEN lead(token_no) OVER (PARTITION BY id, depth ORDER BY token_no) END AS end_no,
                      CASE WHEN kind = 'START' THEN coalesce(lead(kind) OVER (PARTITION BY id ORDER BY token_no) = 'END', true) END AS leaf FROM leveled)"""


@_query("node_scan", f"WITH {_TOKENS} SELECT id, token_no::BIGINT AS token_no, kind, name, md5(token) AS token_md5 FROM tokens")
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = scan_tokens(_table(spark, sf_dir, "pages"), "page_id", "html")
    return tokens.select("id", "token_no", "kind", "name", F.md5(F.col("token").cast("binary")).alias("token_md5"))


@_query("tag_depth", f"WITH {_TOKENS}, {_NESTED} SELECT id, token_no::BIGINT AS token_no, name, kind, depth, coalesce(end_no, -1)::BIGINT AS end_no, coalesce(leaf, false) AS leaf FROM nested")
def nesting_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = tag_depth(scan_tokens(_table(spark, sf_dir, "pages"), "page_id", "html"), BALANCED)
    return nested.withColumns({"end_no": F.coalesce("end_no", F.lit(-1).cast("long")), "leaf": F.coalesce("leaf", F.lit(False))})


@_query(
    "sibling_index",
    f"""WITH {_TOKENS}, {_NESTED}, starts AS (SELECT * FROM nested WHERE kind = 'START'),
        linked AS (SELECT s.*, p.token_no AS parent_no FROM starts s ASOF LEFT JOIN starts p ON s.id = p.id AND s.depth - 1 = p.depth AND s.token_no > p.token_no)
        SELECT id, token_no::BIGINT AS token_no, name, depth, coalesce(parent_no, -1)::BIGINT AS parent_no, row_number() OVER (PARTITION BY id, parent_no, depth, name ORDER BY token_no) AS sibling_no FROM linked""",
)
def sibling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sibling_numbers(scan_tokens(_table(spark, sf_dir, "pages"), "page_id", "html"), BALANCED).select("id", "token_no", "name", "depth", F.coalesce("parent_no", F.lit(-1).cast("long")).alias("parent_no"), "sibling_no")


@_query(
    "nesting_violations",
    f"""WITH {_TOKENS} SELECT id, name, count(*) FILTER (kind = 'START') AS starts, count(*) FILTER (kind = 'END') AS ends FROM tokens WHERE name IS NOT NULL GROUP BY 1, 2
        HAVING count(*) FILTER (kind = 'START') <> count(*) FILTER (kind = 'END')""",
)
def nesting_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = scan_tokens(_table(spark, sf_dir, "pages"), "page_id", "html").where("name IS NOT NULL")
    return tokens.groupBy("id", "name").agg(F.count_if(F.col("kind") == "START").alias("starts"), F.count_if(F.col("kind") == "END").alias("ends")).where("starts <> ends")


@_query(
    "leaf_text",
    f"""WITH {_TOKENS}, {_NESTED}, leaves AS (SELECT id, token_no, end_no FROM nested WHERE kind = 'START' AND name = 'a' AND leaf)
        SELECT l.id, l.token_no::BIGINT AS token_no, md5(coalesce(string_agg(t.token, '' ORDER BY t.token_no), '')) AS text_md5 FROM leaves l LEFT JOIN tokens t ON t.id = l.id AND t.kind = 'TEXT'
        AND t.token_no BETWEEN l.token_no AND l.end_no GROUP BY 1, 2""",
)
def leaf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of links without chosen tags in them: each token belongs to the last chosen tag before it."""
    from pyspark.sql import Window

    tokens = scan_tokens(_table(spark, sf_dir, "pages"), "page_id", "html")
    leaves = tag_depth(tokens, BALANCED).where("kind = 'START' AND name = 'a' AND leaf").select("id", "token_no")
    tag = F.col("name").isin(BALANCED) & F.col("kind").isin("START", "END")
    last = F.last(F.when(tag, F.col("token_no")), ignorenulls=True).over(Window.partitionBy("id").orderBy("token_no"))
    text = tokens.withColumn("_of", last).where("kind = 'TEXT'").groupBy("id", F.col("_of").alias("token_no")).agg(F.array_sort(F.collect_list(F.struct("token_no", "token"))).alias("_t"))
    joined = leaves.join(text, ["id", "token_no"], "left")
    return joined.select("id", "token_no", F.md5(F.coalesce(F.array_join(F.transform("_t", lambda x: x["token"]), ""), F.lit("")).cast("binary")).alias("text_md5"))


_SPANS = "spans AS (SELECT event_type AS id, user_id * 7 % 5000 AS b, user_id * 7 % 5000 + event_id % 13 AS e, CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'insert' END AS kind, event_id % 50 AS move FROM events)"


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer spans derived from events: a file for each event type."""
    begin = F.col("user_id") * 7 % 5000
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), begin.alias("begin"), (begin + F.col("event_id") % 13).alias("end"), _side("event_id").alias("kind"), F.array(F.col("event_id") % 50).alias("move_ids"))


_MERGED = f"""{_SPANS},
    of_kind AS (SELECT id || '/' || kind AS id, b, e, kind, move FROM spans),
    marked AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS brk FROM of_kind),
    islands AS (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    merged AS (SELECT id, kind, min(b) AS b, max(e) AS e, list_sort(list_distinct(list(move))) AS moves FROM islands GROUP BY id, kind, island)"""


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_spans(spark, sf_dir)
    return S.merge_spans(spans.withColumn("id", F.concat("id", F.lit("/"), "kind")))


@_query("span_merge", f"WITH {_MERGED} SELECT id, kind, b AS begin_line, e AS end_line, 'm=' || array_to_string(moves, ',') AS label FROM merged")
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_spans(spark, sf_dir).select("id", "kind", F.col("begin").alias("begin_line"), F.col("end").alias("end_line"), move_ids_label(F.col("move_ids")).alias("label"))


@_query(
    "line_in_span",
    f"""WITH {_MERGED}, lines AS (SELECT DISTINCT id, g AS line_no FROM of_kind, generate_series(0, 5100, 3) t(g))
        SELECT l.id, l.line_no, coalesce(m.b, -1) AS begin_line, coalesce(m.e, -1) AS end_line FROM lines l LEFT JOIN merged m ON m.id = l.id AND l.line_no BETWEEN m.b AND m.e""",
)
def line_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merged_spans(spark, sf_dir)
    lines = merged.select("id").distinct().withColumn("line_no", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, 5100, 3)))))
    return S.lines_in_spans(lines, merged).select("id", "line_no", *(F.coalesce(c, F.lit(-1).cast("long")).alias(f"{c}_line") for c in ("begin", "end")))


@_query(
    "sliding_line_search",
    rf"""WITH {_LINES}, flat AS (SELECT doc_id, line_no, {_COLLAPSE.format('line')} AS line FROM raw_lines),
        wanted AS (SELECT doc_id, 3 AS k, string_agg(line, ' ' ORDER BY line_no) AS text FROM flat WHERE line_no BETWEEN 2 AND 3 GROUP BY 1 HAVING count(*) = 2),
        pats AS (SELECT doc_id, {_COLLAPSE.format('text')} AS text FROM wanted WHERE {_COLLAPSE.format('text')} <> ''),
        one AS (SELECT p.doc_id, min(f.line_no) AS n FROM pats p JOIN flat f USING (doc_id) WHERE contains(f.line, p.text) GROUP BY 1),
        two AS (SELECT p.doc_id, min(f.line_no) AS n FROM pats p JOIN flat f USING (doc_id) JOIN flat g ON g.doc_id = f.doc_id AND g.line_no = f.line_no + 1
                WHERE contains(f.line || ' ' || g.line, p.text) GROUP BY 1)
        SELECT doc_id AS pattern_id, coalesce(one.n, two.n)::BIGINT AS found_at FROM pats LEFT JOIN one USING (doc_id) LEFT JOIN two USING (doc_id) WHERE one.n IS NOT NULL OR two.n IS NOT NULL""",
)
def sliding_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third line of each document, joined, searched in its lines."""
    lines = scan_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    pair = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    patterns = lines.where("line_no IN (2, 3)").groupBy("id").agg(pair.alias("p")).where("size(p) = 2").select(F.col("id").alias("pattern_id"), "id", F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("text"))
    found = S.locate(lines, patterns, window=2)
    return found.select("pattern_id", F.col("begin").alias("found_at"))


@_query(
    "preview",
    f"""SELECT doc_id, CASE WHEN strlen(t) > 60 THEN left(t, list_max(list_filter(range(0, 61), lambda k: strlen(left(t, k)) <= 60))) || '...' ELSE t END AS shown
        FROM (SELECT doc_id, {_COLLAPSE.format('text')} AS t FROM documents)""",
)
def preview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("shown"))


@_query("xpath_union", "SELECT source, string_agg('/src:unit[@filename=''' || doc_id || ''']', ' | ' ORDER BY doc_id) AS paths FROM documents GROUP BY 1")
def xpath_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/src:unit[@filename='"), F.col("doc_id").cast("string"), F.lit("']"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", path.alias("p")))), lambda x: x["p"])
    return _table(spark, sf_dir, "documents").groupBy("source").agg(path_union(listed).alias("paths"))


@_query("path_files", "SELECT source, array_to_string(list_sort(list_distinct(list((doc_id % 10)::VARCHAR || '.cpp'))), ',') AS files FROM documents GROUP BY 1")
def path_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/src:unit[@filename='"), (F.col("doc_id") % 10).cast("string"), F.lit(".cpp']/diff:delete[1]"))
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(files_of_paths(F.collect_list(path)), ",").alias("files"))


@_query(
    "filename_split",
    "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS original, CASE WHEN doc_id % 3 > 0 THEN lang || CASE WHEN doc_id % 3 = 2 THEN '|x' ELSE '' END END AS modified FROM documents",
)
def filename_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("|"), "lang")).otherwise(F.concat("source", F.lit("|"), "lang", F.lit("|x")))
    return _table(spark, sf_dir, "documents").withColumn("_s", split_filename(name)).select("doc_id", F.col("_s.original").alias("original"), F.col("_s.modified").alias("modified"))


@_query(
    "parse_pos",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN doc_id % 4 = 1 THEN doc_id || ':' || (doc_id % 7) ELSE (doc_id % 5) || ':' || n_chars END AS pos FROM documents),
            q AS (SELECT doc_id, nullif(try_cast(regexp_extract(pos, '^([0-9]+):([0-9]+)', 1) AS BIGINT), 0) AS l, nullif(try_cast(regexp_extract(pos, '^([0-9]+):([0-9]+)', 2) AS BIGINT), 0) AS c FROM p)
       SELECT doc_id, CASE WHEN l IS NOT NULL AND c IS NOT NULL THEN l ELSE -1 END AS line, CASE WHEN l IS NOT NULL AND c IS NOT NULL THEN c ELSE -1 END AS col FROM q""",
)
def parse_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    pos = F.when(F.col("doc_id") % 4 == 0, "none").when(F.col("doc_id") % 4 == 1, F.concat(text("doc_id"), F.lit(":"), (F.col("doc_id") % 7).cast("string"))).otherwise(F.concat((F.col("doc_id") % 5).cast("string"), F.lit(":"), text("n_chars")))
    return _table(spark, sf_dir, "documents").withColumn("_p", parse_position(pos)).select("doc_id", *(F.coalesce(f"_p.{c}", F.lit(-1).cast("long")).alias(c) for c in ("line", "col")))


@_query(
    "clamp_interval",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS a, l_suppkey % 100 AS b FROM lineitem),
            c AS (SELECT *, greatest(least(a, b), 20) AS x, least(greatest(a, b), 60) AS y FROM s)
       SELECT l_orderkey, l_linenumber, CASE WHEN x <= y THEN x ELSE -1 END AS begin_col, CASE WHEN x <= y THEN y ELSE -1 END AS end_col FROM c""",
)
def clamp_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = clamp(F.col("l_partkey") % 100, F.col("l_suppkey") % 100, F.lit(20).cast("long"), F.lit(60).cast("long"))
    return _table(spark, sf_dir, "lineitem").withColumn("_c", cut).select("l_orderkey", "l_linenumber", *(F.coalesce(f"_c.{c}", F.lit(-1).cast("long")).alias(f"{c}_col") for c in ("begin", "end")))


@_query("pad_names", "SELECT n_nationkey, CASE WHEN length(n_name) < 8 THEN rpad(n_name, 8, ' ') ELSE n_name END AS padded FROM nation")
def pad_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", pad_right(F.col("n_name"), 8).alias("padded"))


@_query("line_scan", f"WITH {_LINES} SELECT doc_id AS id, line_no::BIGINT AS line_no, md5(line) AS line_md5 FROM raw_lines")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(_table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff document for each row of ``documents``: its lines as regions, deletions and insertions in turn."""
    escaped = F.col("text")
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    tag = lambda i: F.when(i % 2 == 0, "diff:delete").otherwise("diff:insert")
    marked = F.transform(F.split(escaped, "\n", -1), lambda line, i: F.concat(F.lit("<"), tag(i), F.lit(">"), line, F.lit("</"), tag(i), F.lit(">")))
    head = F.concat(F.lit('<unit xmlns="urn:source" xmlns:diff="urn:diff" filename="'), "source", F.lit('">'))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.array_join(marked, "\n"), F.lit("</unit>")).alias("xml"))


_DIFFS = f"""
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    found AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN 'delete' ELSE 'insert' END AS kind, line AS raw_text, {_COLLAPSE.format('line')} AS canonical_text FROM lines),
    candidates AS (SELECT * FROM found WHERE regexp_matches(raw_text, '[^{_WS}]') AND strlen(raw_text) >= 2),
    counts AS (SELECT doc_id, canonical_text, count(*) FILTER (kind = 'delete') AS dels, count(*) FILTER (kind = 'insert') AS ins FROM candidates GROUP BY 1, 2),
    per_doc AS (SELECT doc_id, count(*) FILTER (dels > 0 AND ins > 0) AS move_count, count(*) AS groups_total, coalesce(sum(dels + ins) FILTER (dels > 0 AND ins > 0), 0) AS actual FROM counts GROUP BY 1)"""


@_query(
    "detect_moves",
    f"""WITH {_DIFFS} SELECT d.doc_id, coalesce(p.move_count, 0) AS move_count, 2 * coalesce(p.move_count, 0) AS annotated_regions, (SELECT count(*) FROM found f WHERE f.doc_id = d.doc_id) AS regions_total,
        (SELECT count(*) FROM candidates c WHERE c.doc_id = d.doc_id) AS candidates_total, coalesce(p.groups_total, 0) AS groups_total, coalesce(p.actual, 0)::BIGINT AS annotated_regions_actual
        FROM documents d LEFT JOIN per_doc p USING (doc_id)""",
)
def detect_moves_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relomap.plans.moves import detect_moves

    return detect_moves(diff_documents(spark, sf_dir)).summaries.drop("moves")


@_query("annotated_xml", f"WITH {_DIFFS} SELECT d.doc_id, coalesce(p.actual, 0)::BIGINT AS marked_tags, true AS declared FROM documents d LEFT JOIN per_doc p USING (doc_id)")
def annotated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relomap.plans.moves import detect_moves

    xml = detect_moves(diff_documents(spark, sf_dir)).xml
    marks = F.regexp_count("xml", F.lit(r'<diff:(?:delete|insert) mv:[a-z]+="[^"]*" mv:[a-z]+="[^"]*">')).cast("long")
    return xml.select("doc_id", marks.alias("marked_tags"), F.col("xml").contains('xmlns:mv="urn:relomap:moves"').alias("declared"))
