"""Nesting of diff regions over an ordered node table.

Nodes are partitioned by (document, unit), so an archive's units are worked on in parallel. Region texts come from one
pass over a unit's nodes in order, so their cost is that of the texts; integrity errors are found by window functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from relomap.functions.hashing import fnv1a64
from relomap.functions.text import SPACE, collapse_space, diff_kind, escape_canonical, existing_move_id, has_content
from relomap.model import CanonicalOptions
from relomap.session import ship

_UNIT = ("doc_id", "unit_no")
#: Regions as they close; numbers are those in their unit.
_CLOSED = pa.schema(
    [("doc_id", pa.int64()), ("unit_no", pa.int64()), ("number", pa.int64()), ("kind", pa.string()), ("filename", pa.string()), ("start_idx", pa.int64()), ("end_idx", pa.int64()), ("raw_text", pa.string()), ("canonical_text", pa.string())]
    + [("parent", pa.int64()), ("depth", pa.int32()), ("has_diff_child", pa.bool_()), ("move", pa.string()), ("xpath", pa.string())]
)


def _in_unit(*order: str) -> Window:
    return Window.partitionBy(*_UNIT).orderBy(*(order or ("node_idx",)))


def canonical_token(options: CanonicalOptions) -> Column:
    """What a row of the node table adds to the canonical form of a region around it; a text adds one part for each run."""
    text = F.coalesce(F.col("content"), F.lit(""))
    if options.ignore_whitespace_only_text:
        runs = F.replace(escape_canonical(collapse_space(text)), F.lit(" "), F.lit(")T("))
        words = F.when(has_content(text), F.concat(F.lit("T("), runs, F.lit(")"))).otherwise("")
    else:
        runs = F.regexp_extract_all(text, F.lit(f"[{SPACE}]+|[^{SPACE}]+"), 0)
        words = F.array_join(F.transform(runs, lambda x: F.concat(F.lit("T("), escape_canonical(x), F.lit(")"))), "")
    tag = F.when(F.col("kind") == "START", F.concat(F.lit("S("), "full_name", F.lit(")"))).when(F.col("kind") == "END", F.concat(F.lit("E("), "full_name", F.lit(")"))).otherwise("")
    if options.ignore_diff_ws:
        tag = F.when(F.col("full_name") == "diff:ws", "").otherwise(tag)
    return F.when(F.col("kind") == "TEXT", words).otherwise(tag)


def root_modes(nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``root_name``, ``mode``: single_file where the root has a file name, even an empty one; else archive."""
    first = nodes.where("kind = 'START'").groupBy("doc_id").agg(F.min_by(F.struct("full_name", "attrs"), "node_idx").alias("r"))
    return first.select("doc_id", F.col("r.full_name").alias("root_name"), F.when(F.col("r.attrs").getItem("filename").isNotNull(), "single_file").otherwise("archive").alias("mode"))


def unit_names(nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``unit_no``, ``filename``: of each unit of an archive, or of the root."""
    units = nodes.where("kind = 'START' AND full_name = 'unit' AND (node_idx > 0 OR map_contains_key(attrs, 'filename'))")
    named = units.groupBy(*_UNIT).agg(F.max_by(F.col("attrs").getItem("filename"), F.col("node_idx")).alias("filename"))
    return named


def violations(nodes: DataFrame) -> DataFrame:
    """Integrity errors: ``doc_id``, ``node_idx``, ``error_code``.

    Codes: not_well_formed, root_not_unit, missing_filename, nested_unit, stray_tag, unclosed_region, end_without_start,
    mismatched_kind. A clean document has no row.
    """
    modes = root_modes(nodes)
    typed = nodes.join(modes, "doc_id", "left")
    level = F.sum(F.when(F.col("kind") == "START", 1).when(F.col("kind") == "END", -1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("node_idx"))
    typed = typed.withColumn("_level", level - (F.col("kind") == "START").cast("int"))
    code = (
        F.when(F.col("error").isNotNull(), "not_well_formed")
        .when((F.col("node_idx") == 0) & (F.col("full_name") != "unit"), "root_not_unit")
        .when((F.col("kind") == "START") & (F.col("full_name") == "unit") & (F.col("node_idx") > 0) & (F.col("mode") == "single_file"), "nested_unit")
        .when((F.col("kind") == "START") & (F.col("full_name") == "unit") & (F.col("node_idx") > 0) & (F.col("_level") > 1), "nested_unit")
        .when((F.col("kind") == "START") & (F.col("full_name") == "unit") & (F.col("node_idx") > 0) & (F.coalesce(F.col("attrs").getItem("filename"), F.lit("")) == ""), "missing_filename")
        .when((F.col("kind") == "START") & (F.col("mode") == "archive") & (F.col("_level") == 1) & (F.col("full_name") != "unit"), "stray_tag")
    )
    found = typed.select("doc_id", "node_idx", code.alias("error_code")).where("error_code IS NOT NULL")
    # Diff tags alone, for node tables that no XML parser has checked.
    tags = nodes.where(diff_kind(F.col("full_name")).isNotNull() & F.col("kind").isin("START", "END"))
    step = F.when(F.col("kind") == "START", 1).otherwise(-1)
    depth = F.sum(step).over(_in_unit())
    tags = tags.withColumn("_depth", depth).withColumn("_d", depth + (F.col("kind") == "END").cast("int"))
    opened = F.lag("full_name").over(Window.partitionBy(*_UNIT, "_d").orderBy("node_idx"))
    closing = F.lead("kind").over(Window.partitionBy(*_UNIT, "_d").orderBy("node_idx"))
    tags = tags.withColumns({"_opened": opened, "_next": closing})
    bad = F.when((F.col("kind") == "END") & (F.col("_depth") < 0), "end_without_start").when((F.col("kind") == "END") & (F.col("_opened") != F.col("full_name")), "mismatched_kind").when((F.col("kind") == "START") & F.col("_next").isNull(), "unclosed_region")
    return found.unionByName(tags.select("doc_id", "node_idx", bad.alias("error_code")).where("error_code IS NOT NULL"))


def checked(nodes: DataFrame) -> DataFrame:
    """``nodes``, raising at run time where a document has integrity errors."""
    bad = violations(nodes).groupBy("doc_id").agg(F.min(F.struct("node_idx", "error_code")).alias("_bad"))
    code = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(": "), F.col("_bad.error_code"), F.lit(" at node "), F.col("_bad.node_idx").cast("string"))
    fine = F.when(F.col("_bad").isNull(), F.lit(True)).otherwise(F.raise_error(code).cast("boolean"))
    return nodes.join(bad, "doc_id", "left").where(fine).drop("_bad")


def _with_parents(starts: DataFrame, keys: tuple[str, ...], order: str, depth: str, name: str) -> DataFrame:
    """``starts`` with the ``order`` of the innermost start around each: the last one before it that is one level up.

    Each start stands in the window of its own level, and again, asking, in that of the level above.
    """
    asking = starts.withColumns({"_level": F.col(depth) - 1, "_asks": F.lit(True)}).where("_level >= 0")
    both = starts.withColumns({"_level": F.col(depth), "_asks": F.lit(False)}).unionByName(asking)
    above = F.last(F.when(~F.col("_asks"), F.col(order)), ignorenulls=True).over(Window.partitionBy(*keys, "_level").orderBy(order, "_asks"))
    top = both.where(~F.col("_asks") & (F.col(depth) == 0)).withColumn(name, F.lit(None).cast(starts.schema[order].dataType))
    return both.withColumn(name, above).where("_asks").unionByName(top).drop("_level", "_asks")


def _close_regions(outer: bool):
    """Rows of units in node order to regions as they close; texts are kept only while a region is open."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, filename, seen = None, None, 0
        opened: list[list] = []
        raw: list[str] = []
        form: list[str] = []
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(_CLOSED)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _CLOSED, strict=True)], schema=_CLOSED)

        for batch in batches:
            for doc_id, unit_no, idx, edge, kind, text, token, mark, named, name, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc_id, unit_no) != unit:
                    unit, filename, seen = (doc_id, unit_no), None, 0
                    opened.clear(), raw.clear(), form.clear()
                if named:
                    filename = name
                if edge > 0:
                    if opened:
                        opened[-1][-1] = True
                    begin = len(form) + (not outer)
                    opened.append([seen, idx, kind, mark, path, opened[-1][0] if opened else None, len(raw), begin, False])
                    seen += 1
                if opened:
                    raw.append(text)
                    form.append(token)
                if edge < 0 and opened:
                    number, start, kind, mark, path, parent, raw_at, form_at, child = opened.pop()
                    texts = "".join(raw[raw_at:]), "".join(form[form_at : len(form) - (not outer)])
                    out.append((doc_id, unit_no, number, kind, filename, start, idx, *texts, parent, len(opened), child, mark, path))
                    held += len(texts[0]) + len(texts[1])
                    if not opened:
                        raw.clear(), form.clear()
                    if len(out) >= 5000 or held > 1 << 22:
                        yield flush()
                        held = 0
        yield flush()

    return close


def regions(nodes: DataFrame, options: CanonicalOptions | None = None, with_hash: bool = False) -> DataFrame:
    """Diff regions, in one pass over each unit's nodes.

    Columns: ``doc_id``, ``region_id`` (order in the document, from 0), ``kind``, ``filename``, ``start_idx``,
    ``end_idx``, ``raw_text``, ``canonical_text``, ``parent_id``, ``depth``, ``has_diff_child``, ``pre_marked``,
    ``existing_move_id``, ``xpath``, and ``hash`` if asked for. Rows with an ``error`` have no regions, and a region that
    is never closed has no row, though it counts in ``region_id`` (see ``violations``).
    """
    o = options or CanonicalOptions()
    ship(nodes.sparkSession)
    diff, opens, ends = diff_kind(F.col("full_name")), F.col("kind") == "START", F.col("kind") == "END"
    edge = F.when(diff.isNotNull() & opens, 1).when(diff.isNotNull() & ends, -1).otherwise(0)
    has_name = F.map_contains_key(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.lit("filename"))
    named = opens & (F.col("full_name") == "unit") & ((F.col("node_idx") > 0) | has_name)
    attribute = lambda n: F.col("attrs").getItem(n)
    fine = nodes.where("error IS NULL")
    # Nodes are dealt as they are, a text once; its canonical form, which is longer, is made where it is used.
    dealt = fine.select(
        *_UNIT, "node_idx", "kind", "full_name", F.when(F.col("kind") == "TEXT", F.col("content")).alias("content"),
        F.when(edge > 0, attribute("move")).alias("move"), F.coalesce(named, F.lit(False)).alias("named"), F.when(named, attribute("filename")).alias("filename"), "xpath",
    ).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "node_idx")
    rows = dealt.select(*_UNIT, "node_idx", edge.cast("int").alias("edge"), diff.alias("kind"), F.coalesce("content", F.lit("")).alias("raw"), canonical_token(o).alias("form"), "move", "named", "filename", "xpath")
    closed = rows.mapInArrow(_close_regions(not o.ignore_outer_diff_wrapper), from_arrow_schema(_CLOSED))
    # Numbers in the unit become numbers in the document: a row per unit says how many regions start before it.
    sizes = fine.where(edge > 0).groupBy(*_UNIT).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*_UNIT, F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))
    out = closed.join(before, list(_UNIT)).select(
        "doc_id",
        (F.col("before") + F.col("number")).alias("region_id"),
        "kind",
        "filename",
        "start_idx",
        "end_idx",
        "raw_text",
        "canonical_text",
        (F.col("before") + F.col("parent")).alias("parent_id"),
        "depth",
        "has_diff_child",
        F.col("move").isNotNull().alias("pre_marked"),
        existing_move_id(F.col("move")).alias("existing_move_id"),
        "xpath",
    )
    return out.withColumn("hash", fnv1a64(F.col("canonical_text"))) if with_hash else out


def tag_depth(tokens: DataFrame, tags: list[str]) -> DataFrame:
    """Depth and partner of tokens of chosen tags: ``id``, ``token_no``, ``name``, ``kind``, ``depth``, ``end_no``, ``leaf``.

    ``depth`` is from 0 for outermost tags; ``end_no`` is the matching end's token of a start, ``leaf`` whether the next of
    the chosen tags is an end. Meant for tags that are balanced in each text.
    """
    chosen = tokens.where(F.col("name").isin(tags) & F.col("kind").isin("START", "END"))
    in_text = Window.partitionBy("id").orderBy("token_no")
    opens = F.col("kind") == "START"
    leveled = chosen.withColumn("depth", F.sum(F.when(opens, 1).otherwise(-1)).over(in_text) - F.when(opens, 1).otherwise(0))
    at_level = Window.partitionBy("id", "depth").orderBy("token_no")
    return leveled.select(
        "id",
        "token_no",
        "name",
        "kind",
        F.col("depth").cast("long").alias("depth"),
        F.when(opens, F.lead("token_no").over(at_level)).alias("end_no"),
        F.when(opens, F.coalesce(F.lead("kind").over(in_text) == "END", F.lit(True))).alias("leaf"),
    )


def sibling_numbers(tokens: DataFrame, tags: list[str]) -> DataFrame:
    """1-based place of each start tag among the same-named starts of one depth since their parent opened."""
    nested = tag_depth(tokens, tags).where("kind = 'START'")
    placed = _with_parents(nested, ("id",), "token_no", "depth", "parent_no")
    return placed.withColumn("sibling_no", F.row_number().over(Window.partitionBy("id", "parent_no", "depth", "name").orderBy("token_no")).cast("long")).drop("kind")


def prefixed_nodes(nodes: DataFrame, prefix: str = "diff") -> DataFrame:
    """Start tags of one namespace prefix with their paths, for inspection."""
    return nodes.where((F.col("kind") == "START") & F.col("full_name").startswith(f"{prefix}:")).select("doc_id", "node_idx", "name", "attrs", "xpath")


def prefixed_counts(nodes: DataFrame, prefix: str = "diff") -> DataFrame:
    """``doc_id``, ``name``, ``n``: how often each tag of a namespace prefix starts."""
    return prefixed_nodes(nodes, prefix).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
