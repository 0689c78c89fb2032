"""Queries that run the diff operators over diff documents made from whole rows of ``documents``, and their DuckDB SQL.

Each row of ``documents`` becomes one document, every fourth a single file and the others an archive of two units, with
nested regions, an old mark, a named function, a blank region, one that is too short, and the row's text on both sides.
The SQL says from the row alone what the operators must find.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relomap.functions.text import SPACE, existing_move_id, kind_label, numeric_move, pad_left
from relomap.model import FilterOptions
from relomap.operators import groups as G
from relomap.operators import matching as M
from relomap.operators import registry as R
from relomap.operators import report as P
from relomap.operators import spans as S
from relomap.operators.filters import filter_regions
from relomap.operators.nesting import prefixed_counts, regions, root_modes, violations
from relomap.plans.catalogue import _COLLAPSE, _COUNTS, _MERGED, ORACLE_SQL, QUERIES, _query, _side, _table, doc_regions, line_regions, merged_spans
from relomap.plans.moves import Moves, debug_report, detect_moves
from relomap.sources.lines import read_json, scan_lines
from relomap.sources.xml import scan_nodes
from relomap.streaming import registry_stream
from relomap.tables import scratch_root, written

__all__ = ["ORACLE_SQL", "QUERIES"]

_BODY_OLD = '<diff:delete move="{id}"{m0}>{T}</diff:delete><diff:insert>head <diff:delete>{lang}</diff:delete> tail</diff:insert>'
_BODY_NEW = (
    "<function><name>f{id}</name><block><diff:insert{m3}>{T}</diff:insert></block></function><diff:delete>  {lang}  </diff:delete>"
    "<diff:insert{m5}>{source}</diff:insert><diff:insert{m6}> {source}\n</diff:insert><diff:delete{m7}>{source}</diff:delete><diff:delete> \n</diff:delete><diff:insert>x</diff:insert>"
)
_HEAD = '<unit xmlns="urn:source" xmlns:diff="urn:diff"'
#: Documents, and the same with the marks that detection writes (m0 to m7) and the declared namespace.
ARCHIVE = f'{_HEAD}{{decl}}><unit filename="{{source}}.old">{_BODY_OLD}</unit><unit filename="{{source}}.new">{_BODY_NEW}</unit></unit>'
SINGLE = f'{_HEAD} filename="{{source}}.c"{{decl}}>{_BODY_OLD}{_BODY_NEW}</unit>'


def _filled(template: str, fields: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(fields.get(p, F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def _sql_filled(template: str, fields: dict[str, str]) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    literal = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(fields.get(p, "''") if i % 2 else literal(p) for i, p in enumerate(parts) if p)


def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``xml`` for every row of ``documents``."""
    escaped = F.coalesce("text", F.lit(""))
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    fields = {"id": F.col("doc_id").cast("string"), "T": escaped, "lang": F.coalesce("lang", F.lit("none")), "source": F.coalesce("source", F.lit("none"))}
    xml = F.when(F.col("doc_id") % 4 == 3, _filled(SINGLE, fields)).otherwise(_filled(ARCHIVE, fields))
    return _table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))


def _moves(spark: SparkSession, sf_dir: str) -> Moves:
    return detect_moves(diff_documents(spark, sf_dir))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(scan_nodes(diff_documents(spark, sf_dir)))


def _md5(column: str) -> Column:
    return F.md5(F.col(column).cast("binary"))


def _form(text: str) -> str:
    """SQL of the canonical form of a region that holds only this text."""
    escaped = f"replace(replace(replace({_COLLAPSE.format(text)}, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t')"
    return f"CASE WHEN regexp_matches({text}, '[^{SPACE}]') THEN 'T(' || replace({escaped}, ' ', ')T(') || ')' ELSE '' END"


# Region by region: kind, raw text, canonical form, parent, depth, unit of an archive, steps in an archive's unit and in a file.
_REGIONS = [
    ("delete", "T", None, "NULL", 0, "old", "/diff:delete[1]", "/diff:delete[1]"),
    ("insert", "'head ' || lang || ' tail'", "'T(head)S(diff:delete)T(' || lang || ')E(diff:delete)T(tail)'", "NULL", 0, "old", "/diff:insert[1]", "/diff:insert[1]"),
    ("delete", "lang", None, "1", 1, "old", "/diff:insert[1]/diff:delete[1]", "/diff:insert[1]/diff:delete[1]"),
    ("insert", "T", None, "NULL", 0, "new", "/src:function[src:name='f{id}']/src:block[1]/diff:insert[1]", "/src:function[src:name='f{id}']/src:block[1]/diff:insert[1]"),
    ("delete", "'  ' || lang || '  '", None, "NULL", 0, "new", "/diff:delete[1]", "/diff:delete[2]"),
    ("insert", "source", None, "NULL", 0, "new", "/diff:insert[1]", "/diff:insert[2]"),
    ("insert", "' ' || source || chr(10)", None, "NULL", 0, "new", "/diff:insert[2]", "/diff:insert[3]"),
    ("delete", "source", None, "NULL", 0, "new", "/diff:delete[2]", "/diff:delete[3]"),
    ("delete", "' ' || chr(10)", None, "NULL", 0, "new", "/diff:delete[3]", "/diff:delete[4]"),
    ("insert", "'x'", None, "NULL", 0, "new", "/diff:insert[3]", "/diff:insert[4]"),
]


def _path(k: int) -> str:
    _, _, _, _, _, unit, archived, single = _REGIONS[k]
    fields = {"id": "doc_id::VARCHAR", "source": "source"}
    return f"CASE WHEN doc_id % 4 = 3 THEN {_sql_filled('/src:unit[1]' + single, fields)} ELSE {_sql_filled('/src:unit[@filename=' + chr(39) + '{source}.' + unit + chr(39) + ']' + archived, fields)} END"


_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS T, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents)"
_ALL_REGIONS = f"{_DOCS}, regions AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {k} AS region_id, '{kind}' AS kind, source || CASE WHEN doc_id % 4 = 3 THEN '.c' ELSE '.{unit}' END AS filename, {raw} AS raw_text, {form or _form(raw)} AS canonical_text, "
    f"{parent}::BIGINT AS parent_id, {depth} AS depth, {'true' if k == 1 else 'false'} AS has_diff_child, {'true' if k == 0 else 'false'} AS pre_marked, {'doc_id' if k == 0 else 'NULL::BIGINT'} AS existing_move_id, {_path(k)} AS xpath FROM d"
    for k, (kind, raw, form, parent, depth, unit, _, _) in enumerate(_REGIONS)
) + ")"
_CANDIDATES = f"""{_ALL_REGIONS}, candidates AS (SELECT *, row_number() OVER (ORDER BY doc_id, region_id) - 1 AS candidate_id FROM regions
    WHERE NOT has_diff_child AND regexp_matches(raw_text, '[^{SPACE}]') AND strlen(raw_text) >= 2)"""


def _mix(n: str) -> str:
    """SQL of the nine digits of the n-th move."""
    wrap = "18446744073709551616::UHUGEINT"
    start = f"((({n})::UHUGEINT + 11400714819323198485::UHUGEINT) % {wrap})::UBIGINT"
    step = lambda x, shift, by: f"((xor(x, x >> {shift})::UHUGEINT * {by}::UHUGEINT) % {wrap})::UBIGINT"
    first = f"list_transform([{start}], lambda x: {step('x', 30, 13787848793156543929)})"
    second = f"list_transform({first}, lambda x: {step('x', 27, 10723151780598845931)})"
    return f"list_transform({second}, lambda x: format('{{:09x}}', (xor(x, x >> 31) % 68719476736)::BIGINT))[1]"


#: The catalogue's query of the ids of whole documents' moves.
ORACLE_SQL["move_ids"] = f"""WITH candidates AS (SELECT doc_id AS candidate_id, CASE WHEN doc_id % 2 = 0 THEN 'delete' ELSE 'insert' END AS kind, text AS canonical_text FROM documents), {_COUNTS},
    two AS (SELECT row_number() OVER (ORDER BY first_id) - 1 AS group_id FROM counts WHERE dels > 0 AND ins > 0) SELECT group_id, {_mix('group_id')} AS move_id FROM two"""

_TAGS = f"""{_CANDIDATES}, sizes AS (SELECT doc_id, canonical_text, count(*) FILTER (kind = 'delete') AS deletes, count(*) FILTER (kind = 'insert') AS inserts, min(candidate_id) AS first_id,
        string_agg(xpath, ' | ' ORDER BY candidate_id) FILTER (kind = 'delete') AS del_paths, string_agg(xpath, ' | ' ORDER BY candidate_id) FILTER (kind = 'insert') AS ins_paths,
        string_agg(md5(raw_text), ' | ' ORDER BY candidate_id) FILTER (kind = 'delete') AS del_texts, string_agg(md5(raw_text), ' | ' ORDER BY candidate_id) FILTER (kind = 'insert') AS ins_texts
        FROM candidates GROUP BY 1, 2),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_id) - 1 AS n FROM sizes WHERE deletes > 0 AND inserts > 0),
    moved AS (SELECT *, {_mix('n')} AS move_id FROM numbered)"""


@_query("diff_regions", f"WITH {_ALL_REGIONS} SELECT doc_id, region_id::BIGINT AS region_id, kind, filename, md5(raw_text) AS raw_md5, md5(canonical_text) AS canonical_md5, coalesce(parent_id, -1) AS parent_id, depth, has_diff_child, pre_marked, coalesce(existing_move_id, -1) AS existing_move_id, xpath FROM regions")
def diff_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _regions(spark, sf_dir)
    minus = F.lit(-1).cast("long")
    return found.select("doc_id", "region_id", "kind", "filename", _md5("raw_text").alias("raw_md5"), _md5("canonical_text").alias("canonical_md5"), F.coalesce("parent_id", minus).alias("parent_id"), "depth", "has_diff_child", "pre_marked", F.coalesce("existing_move_id", minus).alias("existing_move_id"), "xpath")


@_query("diff_modes", "SELECT doc_id, 'unit' AS root_name, CASE WHEN doc_id % 4 = 3 THEN 'single_file' ELSE 'archive' END AS mode FROM documents")
def diff_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_modes(scan_nodes(diff_documents(spark, sf_dir)))


_POLICIES = {
    "leaf_only": (FilterOptions(), f"NOT has_diff_child AND regexp_matches(raw_text, '[^{SPACE}]') AND strlen(raw_text) >= 2"),
    "top_level_only": (FilterOptions(policy="top_level_only"), f"parent_id IS NULL AND regexp_matches(raw_text, '[^{SPACE}]') AND strlen(raw_text) >= 2"),
    "all_regions": (FilterOptions(policy="all_regions"), f"regexp_matches(raw_text, '[^{SPACE}]') AND strlen(raw_text) >= 2"),
    "blank_too": (FilterOptions(policy="all_regions", drop_whitespace_only=False), "strlen(raw_text) >= 2"),
    "unmarked": (FilterOptions(skip_pre_marked=True), f"NOT pre_marked AND NOT has_diff_child AND regexp_matches(raw_text, '[^{SPACE}]') AND strlen(raw_text) >= 2"),
    "from_one_byte": (FilterOptions(min_bytes=1), f"NOT has_diff_child AND regexp_matches(raw_text, '[^{SPACE}]') AND strlen(raw_text) >= 1"),
}


@_query("diff_policies", f"WITH {_ALL_REGIONS} " + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS policy, region_id::BIGINT AS region_id FROM regions WHERE {where}" for name, (_, where) in _POLICIES.items()))
def diff_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(spark, _regions(spark, sf_dir), "regions")
    parts = [filter_regions(found, o).select("doc_id", F.lit(name).alias("policy"), "region_id") for name, (o, _) in _POLICIES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_query(
    "diff_tags",
    f"""WITH {_TAGS} SELECT c.doc_id, c.kind, c.xpath, md5(c.raw_text) AS raw_md5, m.move_id, m.inserts::INTEGER AS inserts, m.deletes::INTEGER AS deletes,
        CASE WHEN c.kind = 'delete' THEN m.ins_paths ELSE m.del_paths END AS partners FROM candidates c JOIN moved m USING (doc_id, canonical_text)""",
)
def diff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _moves(spark, sf_dir).tags
    return tags.select("doc_id", "kind", "xpath", _md5("raw_text").alias("raw_md5"), "move_id", "inserts", "deletes", F.array_join("partner_xpaths", " | ").alias("partners"))


@_query("diff_entries", f"WITH {_TAGS} SELECT doc_id, move_id, del_paths AS from_xpaths, ins_paths AS to_xpaths, del_texts AS from_texts, ins_texts AS to_texts FROM moved")
def diff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _moves(spark, sf_dir).entries
    joined = lambda c: F.array_join(c, " | ")
    digests = lambda c: joined(F.transform(c, lambda t: F.md5(t.cast("binary"))))
    return entries.select("doc_id", "move_id", joined("from_xpaths").alias("from_xpaths"), joined("to_xpaths").alias("to_xpaths"), digests("from_raw_texts").alias("from_texts"), digests("to_raw_texts").alias("to_texts"))


@_query(
    "diff_summary_json",
    f"""WITH {_TAGS}, tops AS (SELECT doc_id, count(*) AS moves, min_by(move_id, move_id) AS id, min_by(del_paths, move_id) AS path, min_by(del_texts, move_id) AS text FROM moved GROUP BY 1)
        SELECT doc_id, 'move_count,moves,annotated_regions,regions_total,candidates_total,groups_total' AS keys, coalesce(moves, 0)::VARCHAR AS move_count, (2 * coalesce(moves, 0))::VARCHAR AS annotated_regions, '10' AS regions_total,
               (SELECT count(*) FROM candidates c WHERE c.doc_id = d.doc_id)::VARCHAR AS candidates_total, (SELECT count(*) FROM sizes s WHERE s.doc_id = d.doc_id)::VARCHAR AS groups_total, id AS first_id, path AS first_path, text AS first_text
        FROM d LEFT JOIN tops USING (doc_id)""",
)
def diff_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results file read back: its keys in order, its numbers, and its first move with the text."""
    json = _moves(spark, sf_dir).json
    one = lambda path: F.get_json_object("json", path)
    numbers = ("move_count", "annotated_regions", "regions_total", "candidates_total", "groups_total")
    return json.select("doc_id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), *(one(f"$.{n}").alias(n) for n in numbers), one("$.moves[0].move_id").alias("first_id"), one("$.moves[0].from_xpaths[0]").alias("first_path"), F.md5(one("$.moves[0].from_raw_texts[0]").cast("binary")).alias("first_text"))


def _mark(k: int, side: str, move: str, partners: list[int]) -> str:
    joined = " || ' | ' || ".join(f"({_path(p)})" for p in partners)
    attributes = {"id": move, side: joined}  # written in order of name
    return " || ".join(f"' mv:{name}=\"' || {attributes[name]} || '\"'" for name in sorted(attributes))


_HAS = f"(regexp_matches(T, '[^{SPACE}]') AND strlen(T) >= 2)"
_SECOND = f"CASE WHEN {_HAS} THEN {_mix('1')} ELSE {_mix('0')} END"
_WRITTEN = {
    "id": "doc_id::VARCHAR",
    "T": "replace(replace(replace(T, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
    "lang": "lang",
    "source": "source",
    "decl": "' xmlns:mv=\"urn:relomap:moves\"'",
    "m0": f"CASE WHEN {_HAS} THEN {_mark(0, 'to', _mix('0'), [3])} ELSE '' END",
    "m3": f"CASE WHEN {_HAS} THEN {_mark(3, 'from', _mix('0'), [0])} ELSE '' END",
    "m5": _mark(5, "from", f"({_SECOND})", [7]),
    "m6": _mark(6, "from", f"({_SECOND})", [7]),
    "m7": _mark(7, "to", f"({_SECOND})", [5, 6]),
}


@_query(
    "diff_annotated",
    f"""WITH {_DOCS} SELECT doc_id, md5('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' || chr(10) || CASE WHEN doc_id % 4 = 3 THEN {_sql_filled(SINGLE, _WRITTEN)} ELSE {_sql_filled(ARCHIVE, _WRITTEN)} END || chr(10)) AS xml_md5 FROM d""",
)
def diff_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole annotated documents."""
    return _moves(spark, sf_dir).xml.select("doc_id", _md5("xml").alias("xml_md5"))


#: Documents with one integrity error each, or none, by the remainder of the id; and the error's code.
_FAULTS = [
    ("<unit{ns}><unit filename=\"a\"><diff:delete>{T}</diff:delete></unit></unit>", None),
    ("<unit{ns} filename=\"a\"><unit filename=\"b\">{T}</unit></unit>", "nested_unit"),
    ("<other{ns} filename=\"a\">{T}</other>", "root_not_unit"),
    ("<unit{ns}><unit>{T}</unit></unit>", "missing_filename"),
    ("<unit{ns}><unit filename=\"\">{T}</unit></unit>", "missing_filename"),
    ("<unit{ns}><x>{T}</x></unit>", "stray_tag"),
    ("<unit{ns}><unit filename=\"a\"><unit filename=\"b\">{T}</unit></unit></unit>", "nested_unit"),
    ("<unit{ns} filename=\"a\"><diff:delete>{T}</diff:insert></unit>", "not_well_formed"),
    ("<unit{ns} filename=\"a\"><diff:delete>{T}", "not_well_formed"),
]


@_query("diff_violations", f"SELECT doc_id, CASE doc_id % {len(_FAULTS)} " + " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(_FAULTS) if code) + f" END AS error_code FROM documents WHERE doc_id % {len(_FAULTS)} > 0")
def diff_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    fields = {"ns": F.lit(' xmlns:diff="urn:diff"'), "T": escaped}
    xml = F.lit(None).cast("string")
    for i, (template, _) in enumerate(_FAULTS):
        xml = F.when(F.col("doc_id") % len(_FAULTS) == i, _filled(template, fields)).otherwise(xml)
    nodes = written(spark, scan_nodes(_table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))), "nodes")
    return violations(nodes).select("doc_id", "error_code")


#: Tables of tags that no parser has checked: two tags a row of ``orders``, and the errors by remainder of the key.
@_query("tag_violations", """SELECT o_orderkey AS doc_id, n AS node_idx, error_code FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 1 THEN [0, 1] WHEN 2 THEN [1] WHEN 3 THEN [0, 1] ELSE [] END) AS n,
    unnest(CASE o_orderkey % 4 WHEN 1 THEN ['end_without_start', 'end_without_start'] WHEN 2 THEN ['mismatched_kind'] WHEN 3 THEN ['unclosed_region', 'unclosed_region'] ELSE [] END) AS error_code FROM orders)""")
def tag_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    tag = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("full_name"))
    good = F.array(tag("START", "diff:delete"), tag("END", "diff:delete"))
    pairs = F.when(key == 1, F.array(tag("END", "diff:insert"), tag("END", "diff:insert"))).when(key == 2, F.array(tag("START", "diff:delete"), tag("END", "diff:insert"))).when(key == 3, F.array(tag("START", "diff:insert"), tag("START", "diff:delete"))).otherwise(good)
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("doc_id"), F.posexplode(pairs).alias("node_idx", "t"))
    nodes = rows.select("doc_id", F.col("node_idx").cast("long").alias("node_idx"), F.lit(0).cast("long").alias("unit_no"), "t.kind", "t.full_name", F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("error"))
    codes = ("end_without_start", "mismatched_kind", "unclosed_region")
    return violations(nodes).where(F.col("error_code").isin(*codes)).select("doc_id", "node_idx", "error_code")


@_query("diff_prefixed", "SELECT doc_id, unnest(['delete', 'insert']) AS name, unnest([5, 5]) AS n FROM documents")
def diff_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixed_counts(scan_nodes(diff_documents(spark, sf_dir)), "diff")


@_query(
    "diff_first_groups",
    f"""WITH {_CANDIDATES}, g AS (SELECT canonical_text, min(candidate_id) AS first_id, list(candidate_id ORDER BY candidate_id) FILTER (kind = 'delete') AS d, list(candidate_id ORDER BY candidate_id) FILTER (kind = 'insert') AS i FROM candidates GROUP BY 1),
        s AS (SELECT row_number() OVER (ORDER BY first_id) - 1 AS group_id, coalesce(d, []) AS d, coalesce(i, []) AS i FROM g)
        SELECT group_id, array_to_string(d[1:2], ',') AS del_ids, greatest(len(d) - 2, 0) AS del_more, array_to_string(i[1:2], ',') AS ins_ids, greatest(len(i) - 2, 0) AS ins_more FROM s WHERE group_id < 50""",
)
def diff_first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first groups; their number is its parameter."""
    shown = G.first_groups(_moves(spark, sf_dir).groups, 50, 2)
    return shown.select("group_id", F.array_join("del_ids", ",").alias("del_ids"), F.col("del_ids_more").cast("long").alias("del_more"), F.array_join("ins_ids", ",").alias("ins_ids"), F.col("ins_ids_more").cast("long").alias("ins_more"))


_SHOWN = "CASE WHEN strlen({0}) > 60 THEN left({0}, list_max(list_filter(range(0, 61), lambda k: strlen(left({0}, k)) <= 60))) || '...' ELSE {0} END"


@_query(
    "diff_candidate_report",
    f"""WITH {_CANDIDATES}, t AS (SELECT *, {_COLLAPSE.format('raw_text')} AS flat, {_COLLAPSE.format('canonical_text')} AS form FROM candidates)
        SELECT candidate_id, CASE WHEN kind = 'insert' THEN 'INS' ELSE 'DEL' END AS label, true AS active, filename, {_SHOWN.format('flat')} AS raw_shown, {_SHOWN.format('form')} AS canonical_shown FROM t""",
)
def diff_candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_report(_moves(spark, sf_dir).candidates).drop("first_node", "last_node", "content_hash")


@_query("diff_region_report", f"""WITH {_ALL_REGIONS} SELECT doc_id, CASE region_id WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE region_id + 1 END::BIGINT AS closing, CASE WHEN kind = 'insert' THEN 'INS' ELSE 'DEL' END AS label, filename,
    coalesce(existing_move_id::VARCHAR, '') AS old_move, md5(raw_text) AS text_md5 FROM regions""")
def diff_region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = written(spark, scan_nodes(diff_documents(spark, sf_dir)), "nodes")
    return P.region_report(regions(nodes), nodes).select("doc_id", "closing", "label", "filename", F.coalesce("old_move", F.lit("")).alias("old_move"), _md5("text").alias("text_md5"))


@_query("diff_region_records", f"WITH {_ALL_REGIONS} SELECT doc_id, region_id::VARCHAR AS region_id, kind, filename, md5(raw_text) AS raw_md5, xpath FROM regions")
def diff_region_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported records read back."""
    one = lambda c: F.get_json_object("record", f"$.{c}")
    return P.region_records(_regions(spark, sf_dir)).select("doc_id", *(one(c).alias(c) for c in ("region_id", "kind", "filename", "xpath")), F.md5(one("raw_text").cast("binary")).alias("raw_md5"))


_PAIRED = f"""{_CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_text, kind ORDER BY candidate_id) AS rn FROM candidates),
    pairs AS (SELECT x.candidate_id AS del_id, y.candidate_id AS ins_id, x.filename AS del_file, y.filename AS ins_file, strlen(x.raw_text) AS del_bytes, strlen(y.raw_text) AS ins_bytes
              FROM ranked x JOIN ranked y ON x.canonical_text = y.canonical_text AND x.rn = y.rn AND x.kind = 'delete' AND y.kind = 'insert')"""


@_query("diff_match_report", f"WITH {_PAIRED} SELECT * FROM pairs")
def diff_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = _moves(spark, sf_dir)
    found = P.match_report(moves.candidates, moves.matches)
    return found.select("del_id", "ins_id", "del_file", "ins_file", F.col("del_bytes").cast("long").alias("del_bytes"), F.col("ins_bytes").cast("long").alias("ins_bytes"))


@_query(
    "diff_debug_report",
    f"""WITH {_PAIRED}, g AS (SELECT canonical_text, count(*) FILTER (kind = 'delete') AS d, count(*) FILTER (kind = 'insert') AS i FROM candidates GROUP BY 1)
        SELECT 'files' AS part, (SELECT count(DISTINCT filename) FROM candidates) AS n UNION ALL SELECT 'active', (SELECT count(*) FROM candidates) UNION ALL SELECT 'buckets', (SELECT count(*) FROM g)
        UNION ALL SELECT 'two_sided', (SELECT count(*) FROM g WHERE d > 0 AND i > 0) UNION ALL SELECT 'largest', (SELECT max(d + i) FROM g) UNION ALL SELECT 'shown_groups', (SELECT least(count(*), 20) FROM g)
        UNION ALL SELECT 'file_rows', (SELECT count(DISTINCT filename) FROM candidates) UNION ALL SELECT 'matches', (SELECT count(*) FROM pairs) UNION ALL SELECT 'unmatched', (SELECT count(*) FROM candidates) - 2 * (SELECT count(*) FROM pairs)""",
)
def diff_debug_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number from each part of the full report."""
    parts = debug_report(_moves(spark, sf_dir))
    number = lambda frame, name, c: frame.select(F.lit(name).alias("part"), c.cast("long").alias("n"))
    rows = lambda key, name: parts[key].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    summary = F.col("move_1_to_1") + F.col("moves_many") + F.col("copy_or_repeat")
    out = number(parts["registry"], "files", F.col("files")).unionByName(number(parts["registry"], "active", F.col("active_candidates"))).unionByName(number(parts["registry"], "buckets", F.col("buckets")))
    out = out.unionByName(number(parts["summary"], "two_sided", summary)).unionByName(number(parts["buckets"].agg(F.max("members").alias("m")), "largest", F.col("m")))
    for key, name in (("groups", "shown_groups"), ("files", "file_rows"), ("matches", "matches"), ("unmatched", "unmatched")):
        out = out.unionByName(rows(key, name))
    return out


@_query(
    "diff_moves_difference",
    f"""WITH {_TAGS}, a AS (SELECT doc_id, del_paths AS f, ins_paths AS t, del_texts AS ft, ins_texts AS tt FROM moved), b AS (SELECT CASE WHEN doc_id % 5 = 0 THEN f || '!' ELSE f END AS f, t, ft, tt FROM a WHERE doc_id % 7 > 0),
        miss AS (SELECT f, t, ft, tt FROM a EXCEPT ALL SELECT * FROM b), more AS (SELECT * FROM b EXCEPT ALL SELECT f, t, ft, tt FROM a)
        SELECT 'missing' AS side, count(*) AS n FROM miss UNION ALL SELECT 'unexpected', count(*) FROM more""",
)
def diff_moves_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves against the same with some left out and some paths changed."""
    entries = written(spark, _moves(spark, sf_dir).entries, "entries")
    last = F.size("from_xpaths") - 1
    changed = F.transform("from_xpaths", lambda x, i: F.when((i == last) & (F.col("doc_id") % 5 == 0), F.concat(x, F.lit("!"))).otherwise(x))
    other = entries.where("doc_id % 7 > 0").withColumn("from_xpaths", changed)
    return P.moves_difference(entries, other).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


# Positions: ranges of lines and columns in the lines of each document.
_POS = (
    '<unit filename="{source}|{lang}" xmlns:diff="urn:diff" xmlns:pos="urn:pos"><diff:delete><a pos:start="bad" pos:end="1:1"/><b pos:start="1:{c1}" pos:end="{l2}:{c2}"/><c pos:start="9:9" pos:end="9:9"/>'
    '<diff:insert><d pos:start="1:1" pos:end="1:{c2}"/></diff:insert></diff:delete><diff:insert><e pos:start="{l2}:2" pos:end="{l2}:5"/></diff:insert></unit>'
)
_RANGES = """
    n AS (SELECT doc_id AS id, doc_id % 5 + 1 AS c1, doc_id % 7 + 1 AS c2, doc_id % 3 + 1 AS l2 FROM documents),
    ranges AS (SELECT id, 'delete' AS kind, 1 AS sl, c1 AS sc, l2 AS el, c2 AS ec FROM n UNION ALL SELECT id, 'insert', 1, 1, 1, c2 FROM n UNION ALL SELECT id, 'insert', l2, 2, l2, 5 FROM n),
    raw_lines AS (SELECT doc_id AS id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS line_no FROM documents WHERE text <> ''),
    cut AS (SELECT r.id, r.kind, l.line_no, l.line, CASE WHEN r.sl = l.line_no THEN r.sc ELSE 1 END AS a, CASE WHEN r.el = l.line_no THEN r.ec ELSE greatest(length(l.line), 1) END AS b, greatest(length(l.line), 1) AS w
            FROM ranges r JOIN raw_lines l ON l.id = r.id AND l.line_no BETWEEN r.sl AND r.el),
    clamped AS (SELECT id, kind, line_no, line, greatest(least(a, b), 1) AS s, least(greatest(a, b), w) AS e FROM cut WHERE greatest(least(a, b), 1) <= least(greatest(a, b), w))"""


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("none"))
    number = lambda c: c.cast("string")
    fields = {"source": text("source"), "lang": text("lang"), "c1": number(F.col("doc_id") % 5 + 1), "c2": number(F.col("doc_id") % 7 + 1), "l2": number(F.col("doc_id") % 3 + 1)}
    nodes = scan_nodes(_table(spark, sf_dir, "documents").select("doc_id", _filled(_POS, fields).alias("xml")))
    return S.position_ranges(nodes).withColumnRenamed("doc_id", "id")


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("position_ranges", f"WITH {_RANGES} SELECT id, kind, sl AS start_line, sc AS start_col, el AS end_line, ec AS end_col FROM ranges")
def position_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("id", "kind", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("start", "end") for c in ("line", "col")))


@_query(
    "line_segments",
    f"""WITH {_RANGES}, marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY id, line_no ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS brk FROM clamped WHERE kind = 'insert'),
        islands AS (SELECT *, sum(brk) OVER (PARTITION BY id, line_no ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
        merged AS (SELECT id, line_no, min(s) AS s, max(e) AS e FROM islands GROUP BY id, line_no, island)
        SELECT id, line_no::BIGINT AS line_no, string_agg(s || '-' || e, ',' ORDER BY s) AS segments FROM merged GROUP BY 1, 2""",
)
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = S.line_segments(_numbered_lines(spark, sf_dir), _positions(spark, sf_dir).where("kind = 'insert'"))
    shown = F.transform("segments", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return cut.select("id", "line_no", F.array_join(shown, ",").alias("segments"))


@_query(
    "highlight_columns",
    f"""WITH {_RANGES}, w AS (SELECT id, max(line_no) AS top FROM raw_lines GROUP BY 1)
        SELECT l.id, l.line_no::BIGINT AS line_no, md5(lpad(l.line_no::VARCHAR, length(top::VARCHAR)::INTEGER, ' ') || ' | ' || CASE WHEN c.s IS NULL THEN l.line
               ELSE substr(l.line, 1, c.s - 1) || chr(27) || '[48;5;52m' || substr(l.line, c.s, c.e - c.s + 1) || chr(27) || '[0m' || substr(l.line, c.e + 1) END) AS shown_md5
        FROM raw_lines l JOIN w USING (id) LEFT JOIN clamped c ON c.id = l.id AND c.line_no = l.line_no AND c.kind = 'delete'""",
)
def highlight_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.highlight_columns(_numbered_lines(spark, sf_dir), _positions(spark, sf_dir), "delete").select("id", "line_no", _md5("shown").alias("shown_md5"))


@_query(
    "highlight_lines",
    f"""WITH {_MERGED}, lines AS (SELECT DISTINCT id, g AS line_no FROM of_kind, generate_series(0, 5100, 3) t(g)), w AS (SELECT id, length(max(line_no)::VARCHAR) AS n FROM lines GROUP BY 1)
        SELECT l.id, l.line_no, lpad(l.line_no::VARCHAR, n::INTEGER, ' ') || CASE WHEN m.b IS NULL THEN ' |       | line ' || l.line_no
               ELSE ' | m=' || array_to_string(m.moves, ',') || ' | ' || chr(27) || CASE WHEN m.kind = 'delete' THEN '[48;5;52m' ELSE '[48;5;22m' END || 'line ' || l.line_no || chr(27) || '[0m' END AS shown
        FROM lines l JOIN w USING (id) LEFT JOIN merged m ON m.id = l.id AND l.line_no BETWEEN m.b AND m.e""",
)
def highlight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merged_spans(spark, sf_dir)
    lines = merged.select("id").distinct().withColumn("line_no", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, 5100, 3)))))
    return S.highlight_lines(lines.withColumn("line", F.concat(F.lit("line "), F.col("line_no").cast("string"))), merged)


@_query(
    "span_merge_kinds",
    """WITH spans AS (SELECT user_id % 40 AS id, event_id * 3 % 400 AS b, event_id * 3 % 400 + event_id % 9 AS e, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'insert' END AS kind, event_id % 50 AS move FROM events),
            turned AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, e, kind) AS r, lag(kind) OVER (PARTITION BY id ORDER BY b, e, kind) AS before FROM spans),
            runs AS (SELECT *, sum(CASE WHEN before <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY r) AS run FROM turned),
            broken AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY id, run ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS brk FROM runs),
            islands AS (SELECT *, sum(brk) OVER (PARTITION BY id, run ORDER BY r) AS island FROM broken)
       SELECT id, kind, min(b) AS begin_line, max(e) AS end_line, array_to_string(list_sort(list_distinct(list(move))), ',') AS moves FROM islands GROUP BY id, kind, run, island""",
)
def span_merge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of both kinds in one file: one of another kind in between keeps two apart."""
    begin = F.col("event_id") * 3 % 400
    kind = F.when(F.col("event_id") % 5 == 0, "delete").otherwise("insert")
    spans = _table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("id"), begin.alias("begin"), (begin + F.col("event_id") % 9).alias("end"), kind.alias("kind"), F.array(F.col("event_id") % 50).alias("move_ids"))
    return S.merge_spans(spans).select("id", "kind", F.col("begin").alias("begin_line"), F.col("end").alias("end_line"), F.array_join("move_ids", ",").alias("moves"))


@_query("move_attributes", """WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN ' +' || (doc_id * 4294967) || 'z' WHEN 2 THEN lang END AS attribute FROM documents),
    n AS (SELECT *, nullif(regexp_extract(attribute, '^[ ]*\\+?([0-9]+)', 1), '')::HUGEINT % 4294967296 AS v FROM a)
    SELECT doc_id, coalesce(v::BIGINT, -1) AS number, coalesce(CASE WHEN attribute IS NOT NULL THEN coalesce(v::BIGINT, 0) END, -1) AS existing FROM n""")
def move_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of ``move`` attributes: as tools take them, and as the scan does."""
    key, text = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    attribute = F.when(key == 0, text).when(key == 1, F.concat(F.lit(" +"), (F.col("doc_id") * 4294967).cast("string"), F.lit("z"))).when(key == 2, F.col("lang"))
    minus = F.lit(-1).cast("long")
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(numeric_move(attribute), minus).alias("number"), F.coalesce(existing_move_id(attribute), minus).alias("existing"))


@_query("labels_and_pads", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'DEL' ELSE 'INS' END AS label, repeat(' ', greatest(6 - length(doc_id::VARCHAR), 0)::INTEGER) || doc_id::VARCHAR AS padded FROM documents")
def labels_and_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", kind_label(_side()).alias("label"), pad_left(F.col("doc_id").cast("string"), F.lit(6)).alias("padded"))


@_query("registry_lookups", """WITH f AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'no such file')
    SELECT source AS filename, (SELECT count(*) FROM documents d WHERE d.source = f.source AND doc_id % 3 > 0) AS n, (SELECT coalesce(min(doc_id), -1) FROM documents d WHERE d.source = f.source AND doc_id % 3 > 0) AS first_id,
    EXISTS (SELECT 1 FROM documents d WHERE d.source = f.source AND doc_id % 3 > 0) AS present FROM f WHERE source IS NOT NULL""")
def registry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file looked up, and one that is not there."""
    registry = doc_regions(spark, sf_dir).withColumn("active", F.col("candidate_id") % 3 != 0)
    names = [r[0] for r in registry.select("filename").where("filename IS NOT NULL").distinct().collect()]  # a row per file of the table
    out = None
    for name in [*sorted(names), "no such file"]:
        held = R.file_candidates(registry, name).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("candidate_id"), F.lit(-1)).alias("first_id"))
        row = held.select(F.lit(name).alias("filename"), "n", "first_id", F.lit(R.has_file(registry, name)).alias("present"))
        out = row if out is None else out.unionByName(row)
    return out


@_query("lines_without_cr", """WITH t AS (SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) AS text FROM documents WHERE text <> ''),
    l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS line_no FROM t)
    SELECT doc_id AS id, line_no::BIGINT AS line_no, md5(regexp_replace(line, '\\r\\z', '')) AS line_md5 FROM l""")
def lines_without_cr(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return scan_lines(texts, "doc_id", "text", strip_cr=True).select("id", "line_no", _md5("line").alias("line_md5"))


@_query("json_rows", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as one JSON document that spans lines, read back."""
    path = f"{scratch_root(spark)}/relomap-tables/json-{spark.sparkContext.applicationId}"
    whole = _table(spark, sf_dir, "nation").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))
    whole.select(F.to_json("rows", {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
    return read_json(spark, path).select("n_nationkey", "n_name")


@_query("blank_lines", f"""WITH raw_lines AS (SELECT source, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), 1) AS line_no FROM documents WHERE text <> ''),
    l AS (SELECT source, CASE WHEN line_no % 3 = 0 THEN regexp_replace(line, '[^{SPACE}]', chr(9), 'g') ELSE line END AS line FROM raw_lines)
    SELECT source AS filename, count(*) FILTER (regexp_matches(line, '[^{SPACE}]')) AS filled, count(*) FILTER (NOT regexp_matches(line, '[^{SPACE}]')) AS blank FROM l GROUP BY 1""")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line with white space alone: what has content, and what the filter therefore drops."""
    from relomap.functions.text import has_content

    lines = line_regions(spark, sf_dir).withColumn("raw_text", F.when(F.col("candidate_id") % (1 << 31) % 3 == 0, F.regexp_replace("raw_text", f"[^{SPACE}]", "\t")).otherwise(F.col("raw_text")))
    return lines.groupBy("filename").agg(F.count_if(has_content(F.col("raw_text"))).alias("filled"), F.count_if(~has_content(F.col("raw_text"))).alias("blank"))


@_query(
    "sliding_line_search_whole",
    rf"""WITH raw_lines AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n\z', ''), chr(10)), 1) AS line_no FROM documents WHERE text <> ''),
        flat AS (SELECT doc_id, line_no, {_COLLAPSE.format('line')} AS line FROM raw_lines),
        pats AS (SELECT doc_id, {_COLLAPSE.format('text')} AS text FROM documents WHERE {_COLLAPSE.format('text')} <> ''),
        windows AS (SELECT a.doc_id, a.line_no, b.line_no - a.line_no AS k, string_agg(b.line, ' ') OVER (PARTITION BY a.doc_id, a.line_no ORDER BY b.line_no) AS joined FROM flat a JOIN flat b ON b.doc_id = a.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + 79),
        hits AS (SELECT p.doc_id, w.line_no AS b, min(w.k) AS k, min(w.k) > 0 AS late FROM pats p JOIN windows w USING (doc_id) WHERE contains(w.joined, p.text) GROUP BY 1, 2)
        SELECT doc_id AS pattern_id, min_by(b, (late, b))::BIGINT AS begin_line, min_by(b + k, (late, b))::BIGINT AS end_line FROM hits GROUP BY 1""",
)
def sliding_line_search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text, searched in its own lines by windows of 80."""
    docs = _table(spark, sf_dir, "documents")
    found = S.locate(scan_lines(docs, "doc_id", "text"), docs.select(F.col("doc_id").alias("pattern_id"), F.col("doc_id").alias("id"), "text"))
    return found.select("pattern_id", F.col("begin").alias("begin_line"), F.col("end").alias("end_line"))


@_query(
    "registry_stream",
    """SELECT source AS filename, CASE WHEN source = 'src5' THEN false ELSE true END AS active, count(*) AS n FROM documents GROUP BY 1, 2
       UNION ALL SELECT 'src5', true, count(*) FROM documents WHERE source = 'src5' HAVING count(*) > 0""",
)
def stream_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after two runs of the stream: all files, then one of them again."""
    import uuid

    root = f"{scratch_root(spark)}/relomap-tables/{uuid.uuid4().hex}-stream"
    candidates = doc_regions(spark, sf_dir).select("filename", "kind", _md5("canonical_text").alias("canonical_text"), F.lit("").alias("raw_text"))
    for part in (candidates, candidates.where("filename = 'src5'")):
        part.write.mode("append").parquet(f"{root}/in")
        query = registry_stream.maintain(spark.readStream.schema(candidates.schema).parquet(f"{root}/in"), f"{root}/table", f"{root}/checkpoint")
        query.awaitTermination()
    return registry_stream.current(spark, f"{root}/table").groupBy("filename", "active").agg(F.count(F.lit(1)).alias("n"))
