"""Scan of diff documents: XML texts to an ordered node table, in one pass.

Each document is parsed by expat in a Python worker. The text between two tags is one row, but counts as many nodes as it
has runs of white space and of other characters: indices skip accordingly, and the canonical form is split there, so that
it does not depend on how a text was broken by markers. Every diff tag carries its path; documents that are not well
formed give one row with ``error`` set.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from relomap.model import NODES
from relomap.session import ship

#: Rows, and characters of texts, from which on scanned nodes leave as one batch.
_BATCH_ROWS, _BATCH_TEXT = 10_000, 1 << 22
#: Elements whose path step names them instead of counting them.
NAMED = ("function", "decl")


class _Element:
    __slots__ = ("attrs", "counts", "full_name", "index", "name_text", "parent", "naming")

    def __init__(self, full_name: str, attrs: dict[str, str], parent: _Element | None) -> None:
        self.full_name, self.attrs, self.parent = full_name, attrs, parent
        self.counts: dict[str, int] = {}
        self.name_text: list[str] | None = None
        self.naming = False
        self.index = 1
        if parent is not None:
            self.index = parent.counts[full_name] = parent.counts.get(full_name, 0) + 1


def _quoted(text: str) -> str:
    return f'"{text}"' if "'" in text else f"'{text}'"


def path_of(element: _Element, rooted: bool) -> str:
    """The path of an element; units of an archive are addressed by file name, without the root's step unless rooted."""
    steps: list[str] = []
    at: _Element | None = element
    while at is not None:
        step = at.full_name if ":" in at.full_name else f"src:{at.full_name}"
        inner_unit = at.full_name == "unit" and at.parent is not None
        if inner_unit and "filename" in at.attrs:
            steps.append(f"{step}[@filename={_quoted(at.attrs['filename'])}]")
            if not rooted:
                break
        elif at.full_name in NAMED and at.name_text is not None:
            steps.append(f"{step}[src:name={_quoted(''.join(at.name_text))}]")
        else:
            steps.append(f"{step}[{at.index}]")
        at = at.parent
    return "/" + "/".join(reversed(steps))


def runs_in(text: str) -> int:
    """How many runs of white space and of other characters a text has; bytes are split at the same six characters."""
    data = text.encode("utf-8", "surrogatepass")
    words = len(data.split())
    return 2 * words - 1 + data[:1].isspace() + data[-1:].isspace() if words else min(len(data), 1)


def parse(doc_id: int | None, xml: str, rooted: bool = False) -> list[tuple]:
    """Rows of the node table for one document."""
    rows: list[list] = []
    tagged: list[tuple[int, _Element]] = []
    stack: list[_Element] = []
    text: list[str] = []
    unit, index = -1, 0

    def add(kind: str, full_name: str | None, content: str | None = None, attrs: dict[str, str] | None = None, nodes: int = 1) -> None:
        nonlocal index
        name = full_name.rpartition(":")[2] if full_name else None
        rows.append([doc_id, index, max(unit, 0), kind, name, full_name, content, list((attrs or {}).items()) if attrs is not None else None, None, None])
        index += nodes

    def flush() -> None:
        if text:
            whole = "".join(text)
            add("TEXT", None, whole, nodes=runs_in(whole))
            text.clear()

    def start(full_name: str, flat: list[str]) -> None:
        nonlocal unit
        flush()
        attrs = dict(zip(flat[::2], flat[1::2], strict=True))
        parent = stack[-1] if stack else None
        if full_name == "unit" and parent is not None:
            unit += 1
        element = _Element(full_name, attrs, parent)
        if full_name == "name" and parent is not None and parent.full_name in NAMED and parent.name_text is None:
            parent.name_text, element.naming = [], True
        if full_name in ("diff:insert", "diff:delete"):
            tagged.append((len(rows), element))
        stack.append(element)
        add("START", full_name, attrs=attrs)

    def end(full_name: str) -> None:
        flush()
        stack.pop()
        add("END", full_name)

    def characters(data: str) -> None:
        text.append(data)
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].naming:
                stack[depth - 1].name_text.append(data)  # type: ignore[union-attr]
                break

    def comment(data: str) -> None:
        flush()
        add("OTHER", None, f"<!--{data}-->")

    def instruction(target: str, data: str) -> None:
        flush()
        add("OTHER", None, f"<?{target} {data}?>")

    parser = expat.ParserCreate()
    parser.ordered_attributes, parser.buffer_text = True, True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.CommentHandler, parser.ProcessingInstructionHandler = comment, instruction
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, ValueError) as e:
        return [(doc_id, 0, 0, "OTHER", None, None, None, None, None, f"not well formed: {e}")]
    for at, element in tagged:
        rows[at][8] = path_of(element, rooted)
    return [tuple(r) for r in rows]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``doc_id`` (by path order within the read), ``path``, ``xml``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    return files.withColumn("doc_id", F.xxhash64("path")).select("doc_id", "path", "xml")


def scan_nodes(documents: DataFrame, rooted_archive_paths: bool = False) -> DataFrame:
    """Nodes of ``documents`` (``doc_id``, ``xml``); a null text counts as empty and is not well formed."""
    ship(documents.sparkSession)
    schema = to_arrow_schema(NODES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows: list[tuple] = []  # of many small documents, or of a part of a large one
        held = 0
        for batch in batches:
            for doc_id, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += parse(doc_id, xml or "", rooted_archive_paths)
                held += len(xml or "")
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_TEXT:
                    for i in range(0, len(rows), _BATCH_ROWS):
                        yield packed(rows[i : i + _BATCH_ROWS])
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return documents.select(F.col("doc_id").cast("long"), F.col("xml").cast("string")).mapInArrow(scan, NODES)


#: Start tags, end tags and text of loose markup, for the token path that SQL engines share.
TAG_PATTERN = r"<[^>]*>|[^<]+"


def scan_tokens(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tokens of loose markup in order: ``id``, ``token_no`` from 1, ``kind`` (START, END, TEXT, OTHER), ``name``, ``token``.

    For markup that is not well formed; there is no nesting here, see ``operators.nesting.tag_depth``.
    """
    tokens = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(TAG_PATTERN), 0)).alias("_n", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    kind = F.when(~F.col("token").startswith("<"), "TEXT").when(F.col("token").rlike(r"^</[A-Za-z]"), "END").when(F.col("token").rlike(r"^<[A-Za-z]"), "START").otherwise("OTHER")
    return tokens.select("id", (F.col("_n") + 1).cast("long").alias("token_no"), kind.alias("kind"), F.nullif(name, F.lit("")).alias("name"), "token")
