"""Functions, groups, matching, registry, spans, streaming and the command line on small tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from relomap import cli
from relomap.functions import hashing, text
from relomap.operators import groups, matching, registry, spans
from relomap.sources.lines import read_json, read_lines, scan_lines
from relomap.sources.xml import runs_in, scan_nodes
from relomap.streaming import registry_stream
from relomap.tables import with_ordinals


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.collapse_space(F.lit(" a \t\n b\x0b\x0c"))) == "a b"
    assert v(text.collapse_space(F.lit("a b"))) == "a b"
    assert v(text.escape_canonical(F.lit("a\\\n\t("))) == "a\\\\\\n\\t("
    assert v(text.has_content(F.lit(" \n"))) is False
    assert v(text.has_content(F.lit(""))) is False
    assert v(text.preview(F.lit("a  b" * 30), 10)) == "a ba ba ba..."
    assert v(text.preview(F.lit("éééé"), 5)) == "éé..." and v(text.preview(F.lit("éééé"), 8)) == "éééé" and v(text.preview(F.lit("中"), 2)) == "..."
    assert v(text.pad_right(F.lit("abc"), 2)) == "abc"
    assert v(text.pad_left(F.lit("7"), F.lit(3))) == "  7"
    assert tuple(v(text.split_filename(F.lit("a|b|c")))) == ("a", "b|c")
    assert v(text.split_filename(F.lit("ab"))) is None
    assert tuple(v(text.parse_position(F.lit("3:14")))) == (3, 14)
    for bad in ("0:1", "3:0", "x:1", "3", "", ":"):
        assert v(text.parse_position(F.lit(bad))) is None
    assert tuple(v(text.clamp(F.lit(9), F.lit(2), F.lit(4), F.lit(6)))) == (4, 6)
    assert v(text.clamp(F.lit(1), F.lit(2), F.lit(4), F.lit(6))) is None
    assert [v(text.existing_move_id(F.lit(x))) for x in ("7", " +12z", "x", "4294967297", "99999999999999999999999999999999999999999")] == [7, 12, 0, 1, 0]
    assert v(text.numeric_move(F.lit("x"))) is None
    assert v(text.files_of_paths(F.array(F.lit("/u[@filename='b']/x"), F.lit('/u[@filename="a"]'), F.lit("/u[1]")))) == ["a", "b"]
    assert v(text.move_ids_label(F.array(F.lit(1), F.lit(7)))) == "m=1,7"
    assert v(text.kind_label(F.lit("insert"))) == "INS"


def shown(t: str | None, most: int) -> str | None:
    if t is None:
        return None
    flat = re.sub("[ \t\n\r\f\x0b]+", " ", t).strip(" ")
    return flat if len(flat.encode()) <= most else flat.encode()[:most].decode("utf-8", "ignore") + "..."


def test_preview_looks_at_the_text_once(spark):
    random.seed(7)
    texts = [None, "", " ", " " * 5000 + "x" * 59 + "\n" * 5000 + "y ", "x" * 60, "x" * 61, "é" * 30, "é" * 31, "a" + "é" * 30, "\x1c\x85\xa0 \x00"]
    texts += ["".join(random.choices("aé中\U0001f600 \n\t\x0b\x85", k=random.randint(1, 200))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 5, 60):
        made = frame.select("t", text.preview(F.col("t"), most).alias("v"))
        assert [(r.t, r.v) for r in made.collect()] == [(t, shown(t, most)) for t in texts]
    # Nothing but the beginning goes through a pattern, and no lambda has one in it, which would run at each of its calls.
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == plan.count("regexp_replace(") == 1 and "regexp" not in plan[plan.index("lambdafunction(") :]


def test_runs_of_space(spark):
    random.seed(8)
    texts = ["", " ", "  a  b "] + ["".join(random.choices("ab \t\n\r\f\x0b\x1c\x85\xa0é", k=random.randint(0, 12))) for _ in range(500)]
    pieces = re.compile(r"[ \t\n\r\f\x0b]+|[^ \t\n\r\f\x0b]+")
    assert [runs_in(t) for t in texts] == [len(pieces.findall(t)) for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.collapse_space(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [re.sub("[ \t\n\r\f\x0b]+", " ", t).strip(" ") for t in texts]


def test_scanned_nodes_by_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"<unit><a>{'word ' * i}</a><b/></unit>" if i % 5 else "<unit>") for i in range(40)], "doc_id long, xml string").coalesce(1)
    want = scan_nodes(docs).collect()
    monkeypatch.setattr("relomap.sources.xml._BATCH_ROWS", 3)
    monkeypatch.setattr("relomap.sources.xml._BATCH_TEXT", 50)
    assert scan_nodes(docs).collect() == want and {r.doc_id for r in want} == set(range(40))


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def test_hashes(spark):
    from relomap.session import ship

    ship(spark)
    texts = ["", "a", "T(low)T(moon)", "é中", None, "z" * 3000] + ["q" * (i % 70) for i in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", hashing.fnv1a64(F.col("t")).alias("v")).collect()
    assert [None if r.v is None else int(r.v) for r in got] == [None if t is None else fnv(t.encode()) for t in texts]
    ids = [r.v for r in spark.range(3).select(hashing.move_id(F.col("id")).alias("v")).collect()]
    assert ids[:2] == ["97b1dcdaf", "c89025cc1"] and len(set(ids)) == 3  # fixed values
    assert value(spark, hashing.move_id(F.lit(None).cast("long"))) is None


ROWS = [(0, "f", "delete", "x", True), (1, "f", "insert", "x", True), (2, "g", "insert", "x", True), (3, "g", "delete", "y", True), (4, "g", "insert", "y", True), (5, "h", "delete", "z", True), (6, "h", "insert", "w", True), (7, "h", "insert", "w", False)]
SCHEMA = "candidate_id long, filename string, kind string, canonical_text string, active boolean"


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_groups(spark, candidates):
    got = {r.canonical_text: (r.group_id, r.del_ids, r.ins_ids, r.kind) for r in groups.content_groups(candidates).collect()}
    assert got == {"x": (0, [0], [1, 2], "copy_or_repeat"), "y": (1, [3], [4], "move_1_to_1"), "z": (2, [5], [], "delete_only"), "w": (3, [], [6], "insert_only")}
    loose = {r.canonical_text: r.ins_ids for r in groups.content_groups(candidates, confirmed=False).collect()}
    assert loose["w"] == [6, 7]
    counted = groups.group_counts(candidates)
    assert {r.kind: r.groups for r in groups.kind_histogram(counted).collect()} == {"copy_or_repeat": 1, "move_1_to_1": 1, "delete_only": 1, "insert_only": 1}
    kinds = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (2, 2), (2, 3)], "d int, i int").select(groups.classify(F.col("d"), F.col("i")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["ambiguous", "delete_only", "insert_only", "move_1_to_1", "moves_many", "copy_or_repeat"]
    top = groups.top_buckets(counted, "canonical_text", 1).first()
    assert (top.canonical_text, top.members, top.not_shown) == ("x", 3, 3)
    shown = groups.first_groups(groups.content_groups(candidates), 1, 1).first()
    assert (shown.ins_ids, shown.ins_ids_more) == ([1], 1)


def test_matching(spark, candidates):
    pairs = matching.greedy_pairs(candidates)
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (3, 4)]
    assert sorted(r.candidate_id for r in matching.unmatched(candidates, pairs).collect()) == [2, 5, 6]
    every = lambda cap: sorted(map(tuple, matching.all_pairs(candidates, cap).collect()))
    assert every(None) == [(0, 1), (0, 2), (3, 4)]
    assert every(2) == [(0, 1), (0, 2)]
    assert every(1) == [] == every(0)  # the first content would pass the cap, which ends the list
    assert every(3) == every(None)


def test_registry(spark, candidates):
    gone = registry.remove_files(candidates, spark.createDataFrame([("f",)], "filename string"))
    assert sorted(r.candidate_id for r in gone.where("active").collect()) == [2, 3, 4, 5, 6]
    fresh = spark.createDataFrame([("f", "insert", "q")], "filename string, kind string, canonical_text string")
    after = registry.replace_files(candidates, fresh, "filename")
    assert [(r.candidate_id, r.canonical_text) for r in after.where("active AND filename = 'f'").collect()] == [(8, "q")]
    c = registry.counts(after).first()
    assert (c.files, c.total_records, c.active_candidates, c.inactive_candidates) == (3, 9, 6, 3)
    assert registry.has_file(after, "f") and not registry.has_file(after, "none")
    stats = {r.filename: (r.ids, r.active, r.dels, r.ins) for r in registry.file_stats(after).collect()}
    assert stats["h"] == (3, 2, 1, 2)
    assert registry.number_candidates(candidates.drop("candidate_id", "active").limit(0), "filename").count() == 0


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.n for r in with_ordinals(rows, ("k",), "n").collect())


def test_spans(spark):
    rows = [("f", 1, 3, "delete", [2]), ("f", 4, 5, "delete", [1]), ("f", 5, 9, "insert", [3]), ("f", 6, 7, "delete", [4]), ("g", 1, 1, "delete", [5])]
    made = spark.createDataFrame(rows, "id string, begin long, end long, kind string, move_ids array<long>")
    merged = sorted((r.id, r.begin, r.end, r.kind, r.move_ids) for r in spans.merge_spans(made).collect())
    assert merged == [("f", 1, 5, "delete", [1, 2]), ("f", 5, 9, "insert", [3]), ("f", 6, 7, "delete", [4]), ("g", 1, 1, "delete", [5])]
    lines = spark.createDataFrame([("f", i, f"line {i}") for i in range(1, 11)], "id string, line_no long, line string")
    held = {r.line_no: r.move_ids for r in spans.lines_in_spans(lines, spans.merge_spans(made)).collect()}
    assert held[5] == [1, 2] and held[6] == [3] and held[10] is None
    shown = {r.line_no: r.shown for r in spans.highlight_lines(lines, spans.merge_spans(made)).collect()}
    assert shown[10] == "10 |       | line 10"
    assert shown[1] == " 1 | m=1,2 | " + spans.BACKGROUND["delete"] + "line 1" + spans.RESET


def test_locate(spark):
    lines = spark.createDataFrame([(0, 1, "int  a;"), (0, 2, "if (x) {"), (0, 3, "  int b;"), (0, 4, "}"), (0, 5, "int a;")], "id int, line_no long, line string")
    wanted = spark.createDataFrame([("one", 0, "int a;"), ("many", 0, "if (x) {\n int b;\n}"), ("none", 0, "zzz"), ("blank", 0, " ")], "pattern_id string, id int, text string")
    assert {r.pattern_id: (r.begin, r.end) for r in spans.locate(lines, wanted).collect()} == {"one": (1, 1), "many": (1, 4)}  # the first window that holds it
    assert {r.pattern_id for r in spans.locate(lines, wanted, separator="\n").collect()} == {"one"}
    assert {r.pattern_id for r in spans.locate(lines, wanted, window=2).collect()} == {"one"}


def test_columns(spark):
    from relomap.sources.xml import scan_nodes

    xml = '<unit filename="a|b"><diff:delete><x pos:start="bad" pos:end="1:1"/><y pos:start="1:2" pos:end="2:3"/><z pos:start="9:9" pos:end="9:9"/><diff:insert><w pos:start="1:1" pos:end="1:2"/></diff:insert></diff:delete></unit>'
    ranges = spans.position_ranges(scan_nodes(spark.createDataFrame([(0, xml)], "doc_id long, xml string")))
    assert sorted((r.kind, tuple(r.start), tuple(r.end)) for r in ranges.collect()) == [("delete", (1, 2), (2, 3)), ("insert", (1, 1), (1, 2))]
    lines = spark.createDataFrame([(0, 1, "abcdef"), (0, 2, "ghijkl"), (0, 3, "")], "id long, line_no long, line string")
    of_file = ranges.withColumnRenamed("doc_id", "id")
    cut = {r.line_no: [tuple(s) for s in r.segments] for r in spans.line_segments(lines, of_file).collect()}
    assert cut == {1: [(1, 6)], 2: [(1, 3)]}
    shown = {r.line_no: r.shown for r in spans.highlight_columns(lines, of_file, "delete").collect()}
    on, off = spans.BACKGROUND["delete"], spans.RESET
    assert shown == {1: f"1 | a{on}bcdef{off}", 2: f"2 | {on}ghi{off}jkl", 3: "3 | "}


def test_lines(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a\r\nb\n"), (1, ""), (2, None), (3, "\n"), (4, "x")], "i int, t string")
    assert sorted((r.id, r.line_no, r.line) for r in scan_lines(docs, "i", "t", strip_cr=True).collect()) == [(0, 1, "a"), (0, 2, "b"), (3, 1, ""), (4, 1, "x")]
    (tmp_path / "f.txt").write_text("one\ntwo\n")
    assert [r.line for r in read_lines(spark, str(tmp_path / "f.txt")).orderBy("line_no").collect()] == ["one", "two"]
    (tmp_path / "f.json").write_text('{\n"a": [1, 2]\n}')
    assert read_json(spark, str(tmp_path / "f.json")).first().a == [1, 2]


def test_scratch_folder():
    from types import SimpleNamespace as Fake

    from relomap.tables import scratch_root

    def session(master, conf=None, given=None):
        folder = Fake(isDefined=lambda: given is not None, get=lambda: given)
        settings = Fake(get=lambda *_: conf)
        return Fake(conf=settings, sparkContext=Fake(getConf=lambda: settings, master=master, _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: folder))))

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_root(session("spark://host:7077"))
    assert scratch_root(session("local[2]")).startswith("file://")
    assert scratch_root(session("spark://host:7077", conf="hdfs://a/b/")) == "hdfs://a/b"
    assert scratch_root(session("spark://host:7077", given="hdfs://a/c")) == "hdfs://a/c"


def test_stream(spark, tmp_path):
    schema = "filename string, kind string, canonical_text string, raw_text string"
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    for i, rows in enumerate(([("f", "delete", "x", "x"), ("g", "insert", "x", "x")], [("f", "insert", "y", "y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = registry_stream.maintain(spark.readStream.schema(schema).parquet(source), table, checkpoint)
        query.awaitTermination()
        now = registry_stream.current(spark, table)
        assert sorted((r.filename, r.canonical_text) for r in now.where("active").collect()) == [[("f", "x"), ("g", "x")], [("f", "y"), ("g", "x")]][i]
    assert now.count() == 3 and now.where("filename = 'f' AND active").first().candidate_id == 2


def test_arguments():
    assert cli.parse_arguments(["a.xml"]) == ("a.xml", "diff_new.xml", None, False)
    assert cli.parse_arguments(["a", "b", "--results", "r", "-v"]) == ("a", "b", "r", True)
    for bad in ([], ["a", "b", "c"], ["--help"], ["--version"], ["--no"], ["a", "--results"]):
        assert cli.main(bad) == 1


def test_command_line(spark, tmp_path):
    (tmp_path / "in.xml").write_text('<unit filename="f"><diff:delete>int a;</diff:delete><diff:insert>int a;</diff:insert></unit>')
    out, results = tmp_path / "out.xml", tmp_path / "r.json"
    assert cli.main([str(tmp_path / "in.xml"), str(out), "--results", str(results)]) == 0
    assert "mv:id" in out.read_text() and '"move_count" : 1' in results.read_text()
    assert cli.main([str(tmp_path / "none.xml"), str(out)]) == 2
    (tmp_path / "bad.xml").write_text("<unit")
    assert cli.main([str(tmp_path / "bad.xml"), str(out)]) == 2
