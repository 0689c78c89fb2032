"""Spans of lines and columns: locating texts in files, merging spans, looking lines up in spans, highlighting."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relomap.functions.text import clamp, collapse_space, diff_kind, move_ids_label, pad_left, parse_position
from relomap.operators.nesting import _with_parents
from relomap.session import ship

#: Terminal colours behind highlighted text, a dark red and a dark green of the 256-colour table, and the reset.
BACKGROUND = {"delete": "\x1b[48;5;52m", "insert": "\x1b[48;5;22m"}
RESET = "\x1b[0m"
#: Lines that a located text may span, and characters past its length after which a window is not extended.
WINDOW_LINES, WINDOW_SLACK = 80, 2000
#: Lines of a block over which spans are spread, and patterns that one task looks for in a file.
BLOCK_LINES, PATTERNS = 64, 2000


def merge_spans(spans: DataFrame, file_col: str = "id") -> DataFrame:
    """Merge overlapping and adjacent spans of one kind that follow each other by (begin, end).

    ``spans``: file, ``begin``, ``end``, ``kind``, ``move_ids``. A span of another kind in between keeps two apart. The
    merged span has all ids, sorted and distinct.
    """
    order = Window.partitionBy(file_col).orderBy("begin", "end", "kind")
    turns = spans.withColumn("_turn", F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(0)))
    turns = turns.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(file_col, "_run").orderBy("begin", "end")
    reach = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    broken = turns.withColumn("_break", F.coalesce((F.col("begin") > reach + 1).cast("int"), F.lit(0)))
    islands = broken.withColumn("_island", F.sum("_break").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(file_col, "kind", "_run", "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("move_ids")))).alias("move_ids")).drop("_run", "_island")


def lines_in_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``lines`` (``id``, ``line_no``, ...) with the first span, by (begin, end), that holds each: ``begin``, ``end``, ``kind``,
    ``move_ids``; null where none does. Spans are spread over blocks of lines, so the lookup is an equality join."""
    block = lambda c: F.floor(F.col(c) / BLOCK_LINES)
    spread = spans.select(F.col("id").alias("_id"), F.explode(F.sequence(block("begin"), block("end"))).alias("_block"), F.struct("begin", "end", "kind", "move_ids").alias("_span"))
    held = (F.col("id") == F.col("_id")) & (F.col("_at") == F.col("_block")) & F.col("line_no").between(F.col("_span.begin"), F.col("_span.end"))
    places = lines.select("id", "line_no").distinct().withColumn("_at", block("line_no"))
    first = places.join(spread, held).groupBy("id", "line_no").agg(F.min("_span").alias("_span"))
    return lines.join(first, ["id", "line_no"], "left").select(*lines.columns, "_span.begin", "_span.end", "_span.kind", "_span.move_ids")


def _find(lines: list[str], text: str, separator: str, window: int, slack: int) -> tuple[int, int] | None:
    """Places (from 0) of the first line that holds the text, else of the ends of the first window that does."""
    for i, line in enumerate(lines):
        if text in line:
            return i, i
    whole, begins = separator.join(lines), [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + len(separator))
    at = whole.find(text)
    while at >= 0:
        first, last = bisect_right(begins, at) - 1, bisect_right(begins, at + len(text) - 1) - 1
        # A window begins with a line, and goes on while what it holds is not longer than the text by more than the slack.
        least = max(0, last - window + 1, bisect_left(begins, begins[last] - len(separator) - len(text) - slack))
        if least <= first:
            return least, last
        at = whole.find(text, at + 1)
    return None


def locate(lines: DataFrame, patterns: DataFrame, separator: str = " ", window: int = WINDOW_LINES, slack: int = WINDOW_SLACK) -> DataFrame:
    """Where texts stand in their files: ``pattern_id``, ``begin``, ``end`` (line numbers), for those that are found.

    ``lines``: ``id``, ``line_no``, ``line``; ``patterns``: ``pattern_id``, ``id``, ``text``. Both are compared with white
    space collapsed. The first line that holds the text wins; else the first window of at most ``window`` lines, joined by
    ``separator``, which is not extended beyond ``slack`` characters more than the text. With a line feed as separator, as
    the highlighter has it, no window can hold a text that no line holds, since collapsed texts have no line feeds.

    A file's lines meet its patterns in one task, in parts of at most ``PATTERNS`` patterns each.
    """
    wanted = patterns.select("pattern_id", F.col("id").alias("file"), collapse_space(F.col("text")).alias("text")).where("text <> ''")
    sizes = wanted.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / PATTERNS).cast("int").alias("parts"))
    asked = wanted.join(sizes, "file").withColumn("part", F.pmod(F.xxhash64("pattern_id"), F.col("parts")).cast("int")).select("pattern_id", "file", "part", "text")
    flat = lines.select(F.col("id").alias("file"), F.col("line_no").cast("long").alias("line_no"), collapse_space(F.col("line")).alias("line"))
    dealt = flat.join(sizes, "file").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("file", "part", "line_no", "line")

    def search(held: pa.Table, texts: pa.Table) -> pa.Table:
        held = held.sort_by("line_no")
        shown, numbers = held.column("line").to_pylist(), held.column("line_no").to_pylist()
        hits = [_find(shown, t, separator, window, slack) for t in texts.column("text").to_pylist()]
        found = [i for i, h in enumerate(hits) if h]
        ends = [pa.array([numbers[hits[i][e]] for i in found], type=pa.int64()) for e in (0, 1)]
        return pa.Table.from_arrays([texts.column("pattern_id").take(pa.array(found, type=pa.int64())), *ends], ["pattern_id", "begin", "end"])

    ship(lines.sparkSession)
    kind = patterns.schema["pattern_id"].dataType.simpleString()
    return dealt.groupBy("file", "part").cogroup(asked.groupBy("file", "part")).applyInArrow(search, f"pattern_id {kind}, begin long, end long")


def position_ranges(nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``kind``, ``start``, ``end``: for each diff region the first element in it, and in no inner region, that
    has parsable ``pos:start`` and ``pos:end``."""
    tags = diff_kind(F.col("full_name")).isNotNull()
    order = Window.partitionBy("doc_id", "unit_no").orderBy("node_idx")
    step = F.when(tags & (F.col("kind") == "START"), 1).when(tags & (F.col("kind") == "END"), -1).otherwise(0)
    starts = nodes.where("error IS NULL").withColumn("_open", F.sum(step).over(order)).where("kind = 'START'")
    start, end = (parse_position(F.col("attrs").getItem(f"pos:{e}")) for e in ("start", "end"))
    placed = starts.where(tags).withColumn("_level", F.col("_open") - 1).select("doc_id", "unit_no", "node_idx", "_level", diff_kind(F.col("full_name")).alias("k"), F.lit(None).cast("struct<line:bigint,col:bigint>").alias("start"), F.lit(None).cast("struct<line:bigint,col:bigint>").alias("end"))
    asking = starts.where(~tags & (F.col("_open") > 0)).select("doc_id", "unit_no", "node_idx", F.col("_open").alias("_level"), F.lit(None).cast("string").alias("k"), start.alias("start"), end.alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    linked = _with_parents(placed.unionByName(asking), ("doc_id", "unit_no"), "node_idx", "_level", "_region").where("k IS NULL")
    firsts = linked.groupBy("doc_id", F.col("_region").alias("node_idx")).agg(F.min(F.struct("node_idx", "start", "end")).alias("_r"))
    return firsts.join(placed.select("doc_id", "node_idx", "k"), ["doc_id", "node_idx"]).select("doc_id", F.col("k").alias("kind"), "_r.start", "_r.end")


def line_segments(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Merged column segments of ranges on each line: ``id``, ``line_no``, ``segments`` (begin, end; from 1, inclusive).

    ``ranges``: ``id``, ``start``, ``end`` as (line, col). Columns are clamped to the line; an empty line counts as one column.
    """
    spread = ranges.where("start.line <= end.line").select("id", "start", "end", F.explode(F.sequence("start.line", "end.line")).alias("line_no"))
    width = F.greatest(F.length("line"), F.lit(1)).cast("long")
    begin = F.when(F.col("start.line") == F.col("line_no"), F.col("start.col")).otherwise(F.lit(1).cast("long"))
    end = F.when(F.col("end.line") == F.col("line_no"), F.col("end.col")).otherwise(width)
    cut = spread.join(lines.select("id", "line_no", "line"), ["id", "line_no"]).select("id", "line_no", clamp(begin, end, F.lit(1).cast("long"), width).alias("s")).where("s IS NOT NULL").select("id", "line_no", "s.begin", "s.end")
    order = Window.partitionBy("id", "line_no").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = cut.withColumn("_b", F.coalesce((F.col("begin") > reach + 1).cast("int"), F.lit(0))).withColumn("_i", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "line_no", "_i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return merged.groupBy("id", "line_no").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("segments"))


def _numbered(lines: DataFrame) -> DataFrame:
    width = F.length(F.max("line_no").over(Window.partitionBy("id")).cast("string"))
    return lines.withColumn("_no", pad_left(F.col("line_no").cast("string"), width))


def highlight_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``id``, ``line_no``, ``shown``: lines with numbers, those in a span with their move ids and a background colour."""
    found = lines_in_spans(_numbered(lines), spans)
    colour = F.when(F.col("kind") == "delete", BACKGROUND["delete"]).otherwise(BACKGROUND["insert"])
    plain = F.concat("_no", F.lit(" |       | "), "line")
    marked = F.concat("_no", F.lit(" | "), move_ids_label(F.col("move_ids")), F.lit(" | "), colour, "line", F.lit(RESET))
    return found.select("id", "line_no", F.when(F.col("kind").isNull(), plain).otherwise(marked).alias("shown"))


def highlight_columns(lines: DataFrame, ranges: DataFrame, kind: str) -> DataFrame:
    """``id``, ``line_no``, ``shown``: lines with numbers, the columns of ranges of ``kind`` in its background colour."""
    cut = line_segments(lines, ranges.where(F.col("kind") == kind))
    found = _numbered(lines).join(cut, ["id", "line_no"], "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(1).cast("long").alias("at"))
    text = lambda a, b: F.substring("line", a.cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc, s):  # noqa: ANN001, ANN202
        out = F.concat(acc["out"], text(acc["at"], s["begin"]), F.lit(BACKGROUND[kind]), text(s["begin"], s["end"] + 1), F.lit(RESET))
        return F.struct(out.alias("out"), (s["end"] + 1).alias("at"))

    done = F.aggregate(F.coalesce("segments", F.array().cast("array<struct<begin:bigint,end:bigint>>")), begin, step)
    shown = F.concat("_no", F.lit(" | "), done["out"], text(done["at"], F.length("line") + 1))
    return found.select("id", "line_no", shown.alias("shown"))
