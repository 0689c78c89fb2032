"""Detection on generated diff documents against a plain model of it, and on single awkward ones."""

from __future__ import annotations

import json
import random
import xml.etree.ElementTree as ET
from collections import defaultdict
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from relomap.model import CanonicalOptions, FilterOptions, OutputOptions
from relomap.operators.nesting import checked, prefixed_counts, regions, violations
from relomap.operators.report import candidate_report, match_report, moves_difference, region_records, region_report
from relomap.plans.moves import debug_report, detect_moves, entries_with_files
from relomap.sources.xml import scan_nodes

SPACES = {"xmlns:diff": "urn:example:diff"}
# The ids of the first two moves of a document, and the 64-bit FNV-1a hash of "T(salt)T(water)".
FIRST_IDS = ("97b1dcdaf", "c89025cc1")
SALT_WATER = 8138555415079059090
PHRASES = ["salt water", "the  tide\nturns", "x", " \t", "low moon", "a < b & c", "salt  water ", "\\ over \\"]


@dataclass
class Region:
    """A region of the model: kind, children (texts and regions), and what the operators should say of it."""

    kind: str
    parts: list = field(default_factory=list)
    mark: int | None = None
    path: str = ""
    file: str = ""
    parent: Region | None = None

    def raw(self) -> str:
        return "".join(p if isinstance(p, str) else p.raw() for p in self.parts)

    def form(self) -> str:
        """Parts in order; a text next to another text is one text."""
        out, text = "", ""
        for p in [*self.parts, None]:
            if isinstance(p, str):
                text += p
                continue
            out += "".join(f"T({w})" for w in text.replace("\\", "\\\\").split())
            text = ""
            if p is not None:
                out += f"S(diff:{p.kind}){p.form()}E(diff:{p.kind})"
        return out

    def element(self) -> ET.Element:
        out = ET.Element(f"diff:{self.kind}", {} if self.mark is None else {"move": str(self.mark)})
        last = None
        for p in self.parts:
            if isinstance(p, str):
                if last is None:
                    out.text = (out.text or "") + p
                else:
                    last.tail = (last.tail or "") + p
            else:
                last = p.element()
                out.append(last)
        return out


def made(rng: random.Random, doc_id: int) -> tuple[str, list[Region]]:
    """A random document and its regions in document order."""
    found: list[Region] = []

    def region(parent: Region | None, depth: int) -> Region:
        r = Region(rng.choice(["delete", "insert"]), mark=rng.choice([None, None, None, 7]), parent=parent)
        found.append(r)
        for _ in range(rng.choice([1, 1, 1, 3])):
            r.parts.append(region(r, depth + 1) if depth < 2 and rng.random() < 0.25 else rng.choice(PHRASES))
        return r

    single = doc_id % 3 == 0
    root = ET.Element("unit", dict(SPACES, filename=f"file{doc_id}.txt") if single else SPACES)
    for u in range(1 if single else rng.randint(0, 3)):
        unit = root if single else ET.SubElement(root, "unit", {"filename": f"part{u}.txt"})
        base = "/src:unit[1]" if single else f"/src:unit[@filename='part{u}.txt']"
        for _ in range(rng.randint(0, 4)):
            first = len(found)
            top = region(None, 0)
            unit.append(top.element())
            for r in found[first:]:
                r.file = unit.get("filename")
        counts: dict = defaultdict(int)
        for r in found:
            if r.file == unit.get("filename") and not r.path:
                key = (r.parent.path if r.parent else base, r.kind)
                counts[key] += 1
                r.path = f"{key[0]}/diff:{r.kind}[{counts[key]}]"
    return ET.tostring(root, encoding="unicode"), found


def model(found: list[Region], options: FilterOptions) -> tuple[list[Region], list[tuple[list[Region], list[Region]]], int]:
    """Candidates, moves (deletions and insertions, in order of their first candidate) and the number of groups."""
    outer = {id(r.parent) for r in found if r.parent}
    kept = [r for r in found if not (options.skip_pre_marked and r.mark is not None)]
    kept = [r for r in kept if {"leaf_only": id(r) not in outer, "top_level_only": r.parent is None, "all_regions": True}[options.policy]]
    kept = [r for r in kept if (r.raw().strip() or not options.drop_whitespace_only) and len(r.raw().encode()) >= options.min_bytes]
    groups: dict[str, list[Region]] = {}
    for r in kept:
        groups.setdefault(r.form(), []).append(r)
    sides = [([r for r in g if r.kind == "delete"], [r for r in g if r.kind == "insert"]) for g in groups.values()]
    return kept, [s for s in sides if s[0] and s[1]], len(groups)


DOCUMENTS = [made(random.Random(i), i) for i in range(60)]
EVERY = [FilterOptions(), FilterOptions(policy="top_level_only"), FilterOptions(policy="all_regions", drop_whitespace_only=False, min_bytes=1), FilterOptions(skip_pre_marked=True)]


def frame(spark, documents):
    return spark.createDataFrame(list(documents), "doc_id long, xml string")


@pytest.fixture(scope="module")
def found(spark):
    return detect_moves(frame(spark, [(i, x) for i, (x, _) in enumerate(DOCUMENTS)]))


def test_the_generated_documents_have_every_case():
    of = [r for _, rs in DOCUMENTS for r in rs]
    sizes = {(len(d), len(i)) for _, rs in DOCUMENTS for d, i in model(rs, FilterOptions())[1]}
    assert {(1, 1)} < sizes and any(d != i for d, i in sizes) and any(not rs for _, rs in DOCUMENTS)
    assert any(r.parent and r.parent.parent for r in of) and any(r.mark for r in of) and any(not r.raw().strip() for r in of)


def test_regions(found):
    got = defaultdict(dict)
    for r in found.regions.collect():
        got[r.doc_id][r.region_id] = r
    for i, (_, want) in enumerate(DOCUMENTS):
        assert sorted(got[i]) == list(range(len(want)))
        number = {id(r): k for k, r in enumerate(want)}
        outer = {id(r.parent) for r in want if r.parent}
        for k, r in enumerate(want):
            g = got[i][k]
            assert (g.kind, g.filename, g.raw_text, g.canonical_text, g.xpath) == (r.kind, r.file, r.raw(), r.form(), r.path)
            assert (g.parent_id, g.has_diff_child, g.existing_move_id) == (number.get(id(r.parent)), id(r) in outer, r.mark)
            assert g.pre_marked == (r.mark is not None) and g.start_idx < g.end_idx


@pytest.mark.parametrize("options", EVERY)
def test_moves(spark, found, options):
    out = found if options == FilterOptions() else detect_moves(found.documents, options)
    summaries = {r.doc_id: r for r in out.summaries.collect()}
    for i, (_, rs) in enumerate(DOCUMENTS):
        kept, moves, groups = model(rs, options)
        s = summaries[i]
        assert (s.regions_total, s.candidates_total, s.groups_total, s.move_count, s.annotated_regions) == (len(rs), len(kept), groups, len(moves), 2 * len(moves))
        assert s.annotated_regions_actual == sum(len(d) + len(n) for d, n in moves)
        listed = {tuple(map(tuple, (m.from_xpaths, m.to_xpaths, m.from_raw_texts, m.to_raw_texts))) for m in s.moves}
        assert listed == {tuple(tuple(f(r) for r in side) for f in (lambda r: r.path, lambda r: r.raw()) for side in (d, n)) for d, n in moves}


def test_written_documents(spark, found):
    xml = {r.doc_id: r.xml for r in found.xml.collect()}
    ids = {r.doc_id: [] for r in found.summaries.collect()}
    for i, (_, rs) in enumerate(DOCUMENTS):
        assert 'xmlns:mv="urn:relomap:moves"' in xml[i]
        marks = {}
        for n, (d, ins) in enumerate(model(rs, FilterOptions())[1]):
            for r in d + ins:
                where = "to" if r.kind == "delete" else "from"
                marks[id(r)] = (n, where, " | ".join(x.path for x in (ins if r.kind == "delete" else d)))
        tags = [e for e in ET.fromstring(xml[i]).iter() if e.tag.startswith("{urn:example:diff}")]
        assert len(tags) == len(rs)
        for e, r in zip(tags, rs, strict=True):
            own = {k.rpartition("}")[2]: v for k, v in e.attrib.items() if k.startswith("{")}
            if id(r) not in marks:
                assert not own
                continue
            n, where, paths = marks[id(r)]
            assert own[where] == paths and set(own) == {"id", where} and e.get("move") == (None if r.mark is None else str(r.mark))
            if n < 2:
                assert own["id"] == FIRST_IDS[n]
        plain = lambda e: (e.tag, {k: v for k, v in e.attrib.items() if "moves}" not in k}, e.text, e.tail, [plain(c) for c in e])
        assert plain(ET.fromstring(xml[i])) == plain(ET.fromstring(DOCUMENTS[i][0])) and ids[i] == []
    again = detect_moves(frame(spark, [(i, x) for i, x in xml.items()]))
    assert {r.doc_id: r.xml for r in again.xml.collect()} == xml  # ids replaced by the same ids


def test_results_file(found):
    got = {r.doc_id: json.loads(r.json) for r in found.json.collect()}
    for i, (_, rs) in enumerate(DOCUMENTS):
        assert list(got[i]) == ["move_count", "moves", "annotated_regions", "regions_total", "candidates_total", "groups_total"]
        moves = model(rs, FilterOptions())[1]
        assert sorted(m["from_raw_texts"] for m in got[i]["moves"]) == sorted([r.raw() for r in d] for d, _ in moves)


def doc(body: str, **attributes: str) -> str:
    shown = "".join(f' {k}="{v}"' for k, v in {**SPACES, **attributes}.items())
    return f"<unit{shown}>{body}</unit>"


def test_canonical_forms(spark):
    body = "<diff:delete>salt<diff:ws> </diff:ws>water</diff:delete><diff:insert>a \\ b</diff:insert><diff:delete><b>salt</b></diff:delete>"
    nodes = scan_nodes(frame(spark, [(0, doc(body, filename="f"))]))
    form = lambda **o: [r.canonical_text for r in regions(nodes, CanonicalOptions(**o)).orderBy("region_id").collect()]
    assert form() == ["T(salt)T(water)", "T(a)T(\\\\)T(b)", "S(b)T(salt)E(b)"]
    assert form(ignore_diff_ws=False)[0] == "T(salt)S(diff:ws)E(diff:ws)T(water)"
    assert form(ignore_whitespace_only_text=False)[:2] == ["T(salt)T( )T(water)", "T(a)T( )T(\\\\)T( )T(b)"]
    assert form(ignore_outer_diff_wrapper=False)[1] == "S(diff:insert)T(a)T(\\\\)T(b)E(diff:insert)"
    first = regions(nodes, with_hash=True).orderBy("region_id").first()
    assert int(first.hash) == SALT_WATER and (first.start_idx, first.end_idx) == (1, 7)  # three runs of text and a tag's two ends


def test_regions_cost_their_texts(spark):
    """Thousands of regions in one unit, each with its own text."""
    body = "".join(f"<diff:{('insert', 'delete')[i % 2]}>number {i // 2}</diff:{('insert', 'delete')[i % 2]}>" for i in range(20_000))
    out = detect_moves(frame(spark, [(0, doc(body, filename="f"))]))
    assert out.summaries.first().move_count == 10_000
    deep = "<diff:insert>" * 150 + "salt water" + "</diff:insert>" * 150
    got = regions(scan_nodes(frame(spark, [(0, doc(deep, filename="f"))]))).orderBy("region_id").collect()
    assert [r.depth for r in got] == list(range(150)) and {r.raw_text for r in got} == {"salt water"}
    assert [r.parent_id for r in got] == [None, *range(149)]


def test_escapes_survive(spark):
    body = '<diff:delete>a &lt; b &amp;&amp; c</diff:delete><x k="&quot;&lt;"/><!-- note --><diff:insert>a &lt; b &amp;&amp; c</diff:insert>'
    out = detect_moves(frame(spark, [(5, doc(body, filename="f"))]))
    text = out.xml.first().xml
    assert ET.fromstring(text)[0].text == "a < b && c" and ET.fromstring(text)[1].attrib == {"k": '"<'} and "<!-- note -->" in text
    assert out.summaries.first().move_count == 1


def test_named_steps_and_rooted_paths(spark):
    body = "<unit filename='p'><decl><kind>k</kind> <name>sea</name><body><diff:delete>low moon</diff:delete></body></decl><function><name>air</name><diff:insert>low moon</diff:insert></function></unit>"
    for rooted, base in ((False, "/src:unit[@filename='p']"), (True, "/src:unit[1]/src:unit[@filename='p']")):
        entry = detect_moves(frame(spark, [(0, doc(body))]), output=OutputOptions(rooted_archive_paths=rooted)).entries.first()
        assert entry.from_xpaths == [f"{base}/src:decl[src:name='sea']/src:body[1]/diff:delete[1]"]
        assert entry.to_xpaths == [f"{base}/src:function[src:name='air']/diff:insert[1]"]


def test_files_of_entries(found):
    rows = {(r.doc_id, tuple(r.from_xpaths)): r for r in entries_with_files(found).collect()}
    for i, (_, rs) in enumerate(DOCUMENTS):
        for d, n in model(rs, FilterOptions())[1] if i % 3 else []:
            r = rows[i, tuple(x.path for x in d)]
            assert (r.from_files, r.to_files) == (sorted({x.file for x in d}), sorted({x.file for x in n}))


def test_violations(spark):
    bad = {
        0: ('<unit filename="a"><unit filename="b"/></unit>', "nested_unit"),
        1: ('<other filename="a"/>', "root_not_unit"),
        2: ("<unit><unit/></unit>", "missing_filename"),
        3: ("<unit><x/></unit>", "stray_tag"),
        4: ("<unit", "not_well_formed"),
        5: ('<unit><unit filename="a"/></unit>', None),
    }
    nodes = scan_nodes(frame(spark, [(i, x) for i, (x, _) in bad.items()]))
    assert {(r.doc_id, r.error_code) for r in violations(nodes).collect()} == {(i, c) for i, (_, c) in bad.items() if c}
    with pytest.raises(Exception, match="nested_unit"):
        checked(nodes.where("doc_id = 0")).collect()
    assert checked(nodes.where("doc_id = 5")).count() > 0
    with pytest.raises(ValueError, match="policy"):
        FilterOptions(policy="some")
    assert detect_moves(frame(spark, [(4, "<unit"), (6, None)])).summaries.where("regions_total = 0").count() == 2


def test_violations_of_tags(spark):
    rows = [(0, 0, "START", "diff:delete"), (0, 1, "END", "diff:insert"), (1, 0, "END", "diff:delete"), (2, 0, "START", "diff:insert")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_idx long, kind string, full_name string").selectExpr("*", "0L AS unit_no", "CAST(NULL AS map<string,string>) AS attrs", "CAST(NULL AS string) AS error")
    got = {(r.doc_id, r.error_code) for r in violations(nodes).collect()}
    assert {(0, "mismatched_kind"), (1, "end_without_start"), (2, "unclosed_region")} <= got


def test_reports(found):
    report = debug_report(found)
    assert report["registry"].first().inactive_candidates == 0 and report["matches"].count() > 0
    for i, (_, rs) in enumerate(DOCUMENTS[:10]):
        mine = region_report(found.regions.where(F.col("doc_id") == i), found.nodes.where(F.col("doc_id") == i)).orderBy("closing").collect()
        order = []
        close = lambda r: [close(c) for c in r.parts if not isinstance(c, str)] + [order.append(r)]  # noqa: E731, B023
        for r in rs:
            if r.parent is None:
                close(r)
        assert [(m.label, m.text, m.old_move) for m in mine] == [("DEL" if r.kind == "delete" else "INS", r.raw(), None if r.mark is None else str(r.mark)) for r in order]
    records = [json.loads(r.record) for r in region_records(found.regions).collect()]
    assert len(records) == sum(len(rs) for _, rs in DOCUMENTS) and {"kind", "raw_text", "xpath", "region_id"} <= set(records[0])
    shown = candidate_report(found.candidates).collect()
    assert {r.label for r in shown} == {"DEL", "INS"} and int(next(r.content_hash for r in shown if r.canonical_shown == "T(salt)T(water)")) == SALT_WATER
    pairs = match_report(found.candidates, found.matches)
    assert pairs.count() == found.matches.count() and pairs.where("del_text <> ins_text").count() == 0
    assert moves_difference(found.entries, found.entries, with_ids=True).count() == 0
    some = found.entries.where("doc_id < 20")
    changed = some.withColumn("move_id", F.lit("0"))
    assert moves_difference(some, changed).count() == 0 and moves_difference(some, changed, with_ids=True).count() == 2 * some.count()
    assert {r.side for r in moves_difference(some, found.entries.where("doc_id >= 20")).collect()} == {"missing", "unexpected"}
    assert sum(r.n for r in prefixed_counts(found.nodes).collect()) == len(records)


def test_canonical_forms_are_not_dealt(found):
    plan = regions(found.nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("RepartitionByExpression") :]


def test_empty(spark):
    out = detect_moves(frame(spark, []))
    assert out.summaries.count() == out.xml.count() == out.entries.count() == 0


def test_across_documents(spark):
    docs = frame(spark, [(0, doc("<diff:delete>low moon</diff:delete>", filename="f")), (1, doc("<diff:insert>low moon</diff:insert>", filename="f"))])
    assert detect_moves(docs).tags.count() == 0
    assert {r.move_id for r in detect_moves(docs, across_documents=True).tags.collect()} == {FIRST_IDS[0]}
