"""Components, line dedup and the n-gram join against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relomap.llm.components import Forest, components
from relomap.llm.editjoin import Signer, within
from relomap.llm.line_dedup import _INDEX, _WHO, LineOptions, _code_points, _meet, dedup_lines, remove_repeated_lines
from relomap.llm.ngram_join import JoinOptions, Shingler, keep_first, ngram_join, overlaps, sketches
from tests.llm.util import AWKWARD, SCHEMA, clashing, empty, rows, table


def distance(a: str, b: str) -> int:
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def changed(text: str, edits: int) -> str:
    s = list(text)
    for _ in range(edits):
        i = random.randrange(len(s))
        random.choice([lambda: s.__setitem__(i, "z"), lambda: s.__delitem__(i), lambda: s.insert(i, "y")])()
    return "".join(s)


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    forest, numbers = Forest(2000), set()
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
            numbers |= {a, b}
    for few in (500_000, 0):  # in one task, and by rounds
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {n: forest.root(n) for n in numbers}
        assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_edit_distance_and_signatures(edits):
    random.seed(edits)
    base = ["".join(random.choices("abc", k=random.randint(edits + 3, 70))) for _ in range(6)]
    lines = [changed(random.choice(base), random.randint(0, 4)) for _ in range(40)] + ["".join(random.choices("ab", k=random.randint(edits + 1, 9))) for _ in range(20)]
    lines = [x for x in lines if len(x) > edits]
    points, offsets = _code_points(lines)
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    near = within(points, offsets, *(np.array(c) for c in zip(*pairs, strict=True)), edits)
    assert near.tolist() == [distance(lines[i], lines[j]) <= edits for i, j in pairs]
    index, probe = defaultdict(set), defaultdict(set)
    for line, is_index, key in zip(*Signer(edits).sign(points, offsets), strict=True):
        (index if is_index else probe)[key].add(line)
    met = {(a, b) for k, own in index.items() for a in own for b in own | probe.get(k, set())}
    assert all((i, j) in met or (j, i) in met for (i, j), ok in zip(pairs, near, strict=True) if ok)


def test_meeting_rows():
    random.seed(5)
    for _ in range(200):
        made = sorted({(random.randint(0, 6), random.randint(0, 2) + random.choice([0, _INDEX])) for _ in range(random.randint(0, 20))})
        made = sorted(made + random.sample(made, len(made) // 3))
        batches, i = [], 0
        while i < len(made):
            part = made[i : i + random.randint(1, 4)]
            i += len(part)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*part, strict=True)], ["key", "who"]))
        got = sorted({tuple(r.values()) for b in _meet(iter(batches)) for r in b.to_pylist()})
        keys = {r[0] for r in made if r[1] < 0 and len({s[1] & _WHO for s in made if s[0] == r[0]}) > 1}
        assert got == sorted({r for r in made if r[0] in keys})


def line_brute(docs: list[tuple], o: LineOptions) -> dict:
    order = lambda d, n: (d is None, d or 0, n)
    occurrences = defaultdict(list)
    for d in docs:
        for n, line in enumerate((d[1] or "").split("\n")):
            occurrences[line.strip(" \t\x0b\x0c\r")].append((d[0], n))
    lines = [x for x in occurrences if x]
    split = [x.split() for x in lines]
    forest = Forest(len(lines))
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            near = min(len(a), len(b)) >= o.min_chars and abs(len(a) - len(b)) <= o.edits and distance(a, b) <= o.edits
            words = min(min(len(split[i]), len(split[j])) // o.words_per_edit, o.most_word_edits) if o.words_per_edit else 0
            if near or (words and abs(len(split[i]) - len(split[j])) <= words and distance(split[i], split[j]) <= words):
                forest.join(i, j)
    classes = defaultdict(list)
    for i, line in enumerate(lines):
        classes[forest.root(i)] += occurrences[line]
    out = Counter()
    for members in classes.values():
        first = min(members, key=lambda m: order(*m))
        for m in members:
            out[*m, *first, len(members), m == first] += 1
    for m in occurrences.get("", []):
        out[*m, *m, 1, True] += 1
    return out


def line_docs() -> list[tuple]:
    random.seed(9)
    base = ["".join(random.choices("abcdef ", k=random.randint(25, 60))).strip().ljust(25, "q") for _ in range(12)]
    docs = [(i, "\n".join(changed(random.choice(base), random.choice([0, 0, 1, 2, 5])) for _ in range(4)), "en", "s", 1) for i in range(25)]
    return docs + [(90, "\n".join(["short", "short", "", "  " + base[0] + "\t", base[0]]), "en", "s", 1), (None, base[1], "en", "s", 1)]


def got_lines(frame) -> Counter:
    return Counter((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.class_size, r.kept) for r in frame.collect())


@pytest.mark.parametrize("options", [LineOptions(), LineOptions(block=3), LineOptions(edits=1, min_chars=10), LineOptions(edits=0, words_per_edit=0), LineOptions(words_per_edit=4)])
def test_line_dedup(spark, options):
    docs = line_docs()
    assert got_lines(dedup_lines(table(spark, docs), options=options)) == line_brute(docs, options)


def test_line_dedup_awkward(spark):
    small = [d for d in AWKWARD if d[0] != 7]
    docs = clashing(spark, ["h1", "line", "kept", "first", "node", "key", "_drops"]).where("doc_id IS NULL OR doc_id <> 7")
    assert got_lines(dedup_lines(docs)) == line_brute(small, LineOptions())
    assert dedup_lines(empty(spark)).count() == 0
    assert dedup_lines(table(spark)).where("doc_id = 7").first().n_chars == len(AWKWARD[8][1]) - 1


def test_a_hot_line_is_joined_apart(spark):
    docs = [(i, "one line that most of the texts have\n\n" + f"own {i}", "en", "s", 1) for i in range(1500)]
    got = dedup_lines(table(spark, docs)).collect()
    assert sum(r.kept for r in got if r.line_no == 0) == 1 and {r.class_size for r in got if r.line_no == 0} == {1500}
    assert all(r.kept and r.class_size == 1 for r in got if r.line_no)


def test_remove_repeated_lines(spark):
    docs = [(2, "a first line of some length\nkeep me, I am the only such one", "en", "s", 1), (1, "a first line of some length\nx", "en", "s", 1), (3, "a first line, of some length", "en", "s", 1), (4, None, "en", "s", 1), (5, "y\n\ny", "en", "s", 1)]
    docs += [docs[0]]
    got = remove_repeated_lines(table(spark, docs))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert rows(got.select("doc_id", "text")) == sorted([(2, "keep me, I am the only such one"), (2, "keep me, I am the only such one"), (1, docs[1][1]), (3, ""), (4, None), (5, "y\n")], key=str)
    own = ["_t1", "_k1", "_d", "_drops", "t1", "drops", "row", "id", "h1", "first", "_heavy", "_spread"]
    clash = remove_repeated_lines(table(spark, docs).withColumns({c: F.lit(c) for c in own}))
    assert clash.columns == [*got.columns, *own] and rows(clash.select("doc_id", "text", *own)) == [(*r, *own) for r in rows(got.select("doc_id", "text"))]


def grams(text: str | None) -> frozenset:
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def join_brute(docs: list[tuple], threshold: float = 0.8) -> Counter:
    sets = [grams(d[1]) for d in docs]
    forest, links, others = Forest(len(docs)), Counter(), defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                forest.join(i, j)
                links[i] += 1
                links[j] += 1
                if a != b:
                    others[i].add(b)
                    others[j].add(a)
    out = Counter()
    for i, d in enumerate(docs):
        members = [j for j in range(len(docs)) if forest.root(j) == forest.root(i)]
        ids = [docs[j][0] for j in members if docs[j][0] is not None]
        out[d[0], min(ids) if ids and sets[i] else d[0], len(members), links[i], len(others[i])] += 1
    return out


def join_docs() -> list[tuple]:
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    docs, n = [], 0
    boiler = [word() for _ in range(30)]
    for _ in range(30):
        base = [word() for _ in range(random.randint(20, 120))]
        for _ in range(random.choice([1, 1, 2, 6])):
            own = base[:]
            for _ in range(random.choice([0, 0, 1, 1, 3])):
                own[random.randrange(len(own))] = word()
            docs.append((n, " ".join(own + boiler * (n % 3 == 0)), "en", "s", 1))
            n += 1
    big = [word() for _ in range(90)]
    for _ in range(60):  # one large group of near copies
        own = big[:]
        own[random.randrange(len(own))] = word()
        docs.append((n, " ".join(own), "en", "s", 1))
        n += 1
    return docs


def got_join(frame) -> Counter:
    return Counter((r.doc_id, r.class_id, r.class_size, r.n_links, r.n_set_links) for r in frame.collect())


@pytest.mark.parametrize("options", [JoinOptions(), JoinOptions(local=8, brute=4, block=7), JoinOptions(local=8, levels=1, block=16)])
def test_ngram_join(spark, options):
    docs = join_docs()
    assert got_join(ngram_join(table(spark, docs), options=options)) == join_brute(docs)


def test_ngram_join_awkward(spark):
    docs = clashing(spark, ["s1", "node", "class_id", "n", "copies", "path", "root"])
    assert got_join(ngram_join(docs)) == join_brute(AWKWARD)
    assert ngram_join(empty(spark)).count() == 0
    kept = rows(keep_first(docs).select("doc_id"))
    assert kept == sorted([(1,), (3,), (4,), (5,), (7,), (8,), (9,), (10,), (11,)], key=str)
    assert keep_first(docs).columns == docs.columns
    own = ["_stay", "_t1", "_k1", "t1", "k1", "row", "id", "class"]
    clash = keep_first(clashing(spark, own))
    assert rows(clash.select("doc_id")) == kept and rows(clash.select(*own).distinct()) == [("clash",) * len(own)]


def test_shingles_and_sketches():
    texts = ["a b c d e f", "a b c d e f", "a b", "", " \n", "b a", "a  b\tc\nd e f", "x " * 50]
    flat = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, flat)])
    sets = Shingler(5).sets(np.frombuffer(b"".join(flat), dtype=np.uint8), offsets)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 2, 1]
    assert (sets[0] == sets[1]).all() and (sets[0] == sets[6]).all() and sets[2] != sets[5]
    made = sketches(sets, 64, 1)
    assert (made[0] == made[1]).all() and not made[3].any()
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    pair = sketches([a, b], 1024, 1)
    assert (pair[0] == pair[1]).mean() == pytest.approx(800 / 1000, abs=0.05)
    assert overlaps([a, b], [b, a[:0], a[:7]]).tolist() == [[800, 0, 7], [len(b), 0, 7]]


def test_recall_near_the_threshold_with_deep_paths(spark):
    """Two thousand pairs at 0.8 to 0.85 whose texts all share a passage; nodes are split until few sets are left."""
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    passage, docs, pairs = [word() for _ in range(60)], [], []
    while len(pairs) < 2000:
        base = [word() for _ in range(random.randint(80, 140))]
        other = base[:]
        for at in random.sample(range(len(base)), random.randint(1, 4)):
            other[at] = word()
        texts = [" ".join(passage + x) for x in (base, other)]
        a, b = map(grams, texts)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append(len(docs))
            docs += [(len(docs) + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in ngram_join(table(spark, docs), options=JoinOptions(brute=2, local=600)).collect()}
    met = sum(got[p] == got[p + 1] for p in pairs) / len(pairs)
    print("recall", met)
    assert met >= 0.995
    assert all(got[p] == p for p in pairs)


def test_runs_reach_the_target():
    assert 10 <= JoinOptions().runs <= 20
    assert JoinOptions(deep=1.5).runs > JoinOptions().runs > JoinOptions(depth=2).runs
    assert JoinOptions(recall=0.9999).runs > JoinOptions().runs


def test_keep_first_keeps_different_documents_of_one_id(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "un deux trois quatre cinq six sept", "eins zwei drei vier acht neun zehn")
    docs = [(None, one), (None, two), (None, two), (4, two), (None, three), (5, one + " eta theta"), (5, three + " elf"), (5, three + " elf"), (None, None), (6, "")]
    got = keep_first(table(spark, [(d, t, "en", "s", 1) for d, t in docs])).select("doc_id", "text")
    assert rows(got) == sorted([(None, one), (4, two), (None, three), (5, one + " eta theta"), (5, three + " elf"), (None, None), (6, "")], key=str)


def test_short_lines_by_equality(spark, tmp_path):
    from relomap.llm.catalogue import op5_line_dedup

    docs = [(1, "我们今天去公园\nshort\n\nonce", "en", "s", 1), (2, "shorts\n\n short\t\n我们今天去公园", "en", "s", 1), (None, "short", "en", "s", 1)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, 0, 1, 0, 2, True), (1, 1, 1, 1, 3, True), (1, 2, 1, 2, 1, True), (1, 3, 1, 3, 1, True)]
    want += [(2, 0, 2, 0, 1, True), (2, 1, 2, 1, 1, True), (2, 2, 1, 1, 3, False), (2, 3, 1, 0, 2, False), (None, 0, 1, 1, 3, False)]
    assert got_lines(op5_line_dedup(spark, str(tmp_path))) == Counter(want)
    left = remove_repeated_lines(table(spark, docs)).select("doc_id", "text")
    assert rows(left) == sorted([(1, docs[0][1]), (2, "shorts\n"), (None, "")], key=str)


def word_changes(words: list[str], edits: int) -> list[str]:
    words = words[:]
    for _ in range(edits):
        at = random.randrange(len(words))
        words[at : at + 1] = random.choice([[], ["replacement"], [words[at], "insertion"]])
    return words


def test_word_edits_grow_with_the_line(spark):
    from relomap.llm.editjoin import WordSigner, within_words, word_hashes

    random.seed(4)
    base = [["".join(random.choices("abcdefgh", k=6)) for _ in range(n)] for n in (9, 19, 20, 21, 30, 31, 41, 59, 60, 61, 80)]
    made = [word_changes(b, k) for b in base for k in (0, 1, 2, 3, 5, 7)]
    lines = sorted({" ".join(w) for w in made} | {"".join(chr(0x4E00 + hash_ % 900) for hash_ in range(40)), "".join(chr(0x4E00 + hash_ % 900) for hash_ in range(38)) + "x"})
    points, offsets = _code_points(lines)
    words, at = word_hashes(points, offsets)
    split = [words[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in split] == [len(x.split()) if x[0] < "一" else len(x) for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    want = [0 < min(len(split[i]) // 10, len(split[j]) // 10) and distance(split[i], split[j]) <= min(len(split[i]) // 10, len(split[j]) // 10, 5) for i, j in pairs]
    assert within_words(points, offsets, *(np.array(c) for c in zip(*pairs, strict=True)), 10, 5).tolist() == want
    index, probe = defaultdict(set), defaultdict(set)
    for line, is_index, key in zip(*WordSigner(10, 5).sign(points, offsets), strict=True):
        (index if is_index else probe)[key].add(line)
    met = {frozenset((x, y)) for k, some in index.items() for x in some for y in some | probe[k]}
    assert all(frozenset(p) in met for p, near in zip(pairs, want, strict=True) if near)

    forest = Forest(len(lines))
    for (i, j), near in zip(pairs, want, strict=True):
        if near or distance(lines[i], lines[j]) <= 2:
            forest.join(i, j)
    docs = [(i, x, "en", "s", 1) for i, x in enumerate(lines)]
    for block in (1024, 3):
        got = dedup_lines(table(spark, docs), options=LineOptions(words_per_edit=10, most_word_edits=5, block=block)).collect()
        assert {r.doc_id: r.class_doc_id for r in got} == {i: forest.root(i) for i in range(len(lines))}


def test_op5_links_long_near_copies(spark, tmp_path):
    from relomap.llm.catalogue import op5_line_dedup

    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(105)]
    near = ["changed" if i in (20, 70) else w for i, w in enumerate(words)]
    far = ["changed" if i % 10 == 0 else w for i, w in enumerate(words)]
    table(spark, [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far))]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.kept for r in op5_line_dedup(spark, str(tmp_path)).collect()} == {0: True, 1: False, 2: True}


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_packed_signatures_meet(held, monkeypatch):
    """Signatures take 11 bytes and a row for each bucket and role; what meets is the same, also where buckets come in parts."""
    from relomap.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = np.random.default_rng(3)
    pool = rng.integers(-(1 << 63), (1 << 63) - 1, 900)
    made, packed = [], []
    for _ in range(5):  # five tasks
        key, who, index = rng.choice(pool, 600), rng.integers(0, 1 << 48, 40)[rng.integers(0, 40, 600)], rng.random(600) < 0.4
        packed.append(line_dedup._packed(key, who, index, 3))
        made += [(k >> 61 << 40 | k & line_dedup._KEY, w | (_INDEX if i else 0)) for k, w, i in zip(key.view(np.uint64).tolist(), who.tolist(), index.tolist(), strict=True)]
    sent = pa.Table.from_batches(packed).sort_by([("bucket", "ascending"), ("probe", "ascending")])
    assert sent.num_rows == 5 * 16 and sum(len(r.as_py()) for r in sent.column("rows")) == 11 * len(made)
    got = {tuple(r.values()) for b in line_dedup._meet_packed(iter(sent.to_batches(max_chunksize=7))) for r in b.to_pylist()}
    lines, indexed = defaultdict(set), {k for k, w in made if w < 0}
    for k, w in made:
        lines[k].add(w & _WHO)
    assert got == {(k, w) for k, w in made if k in indexed and len(lines[k]) > 1}


def test_only_lines_that_met_are_dealt(spark):
    from relomap.llm.line_dedup import _known

    rows = spark.range(40_000).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1)).alias("line_hash"), "id")
    wanted = rows.where("id % 10 = 3").select("line_hash")
    got = [r.id for r in _known(rows, wanted, wanted.count()).collect()]
    assert len(got) == len(set(got)) and {i for i in range(40_000) if i % 10 == 3} <= set(got) and len(got) < 8000


def test_points_of_a_column():
    from relomap.llm.line_dedup import _points_of

    made = pa.array(["abc", "", "hé中", "\U0001d11ez", "  x"])
    for column in (made, made.slice(1, 3), pa.array(["plain", "ascii"]), made.slice(0, 0)):
        assert [x.tolist() for x in _points_of(column)] == [x.tolist() for x in _code_points(column.to_pylist())]
