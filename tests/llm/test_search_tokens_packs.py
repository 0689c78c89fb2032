"""Top-k search, piece encoding, packing, the pipeline, and queries against SQL."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from relomap.llm import catalogue
from relomap.llm.packing import Encoder, PackOptions, SegmentTree, best_fit_decreasing, pack_documents
from relomap.llm.pieces import ChunkCodec, decode_documents, encode_documents
from relomap.llm.topk import SearchOptions, top_k
from tests.compare import connect, same
from tests.llm.util import AWKWARD, clashing, empty, rows, table

PIECES, BYTES = catalogue.tokenizer_path("piece_bpe_32k.model"), catalogue.tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_against_sql(spark, small, name):
    same(catalogue.QUERIES[name](spark, small).toPandas(), connect(small).sql(catalogue.ORACLE_SQL[name]).df())


def search_brute(vectors, is_query, k, scale=256):
    fine = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict.fromkeys((i, tuple(v)) for i, v in fine if is_query(i)):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in fine if c != q)
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 8) / 4]) for i in range(400)]
    vectors += [(None, [1.0] * 8), (401, None), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, []), (406, [1.0, 2.0]), (0, vectors[0][1]), (50, [0.5] * 8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = search_brute(vectors, lambda i: i % 50 == 0, 5)
    for o in (SearchOptions(), SearchOptions(candidate_block=130, query_block=2)):
        assert rows(top_k(frame.withColumn("values", F.lit(1)).withColumn("qb", F.lit(2)), F.col("vec_id") % 50 == 0, options=o)) == want
    few = frame.where("vec_id < 3")
    assert rows(top_k(few, F.col("vec_id") == 1)) == search_brute([v for v in vectors if v[0] is not None and v[0] < 3], lambda i: i == 1, 5)
    assert top_k(frame.where("false"), F.col("vec_id") == 1).count() == 0


PARTS = ["a", " ", "\n", "▁", "  ", "the", "é", "\t", "<s>", "</s>", "<unk>", "中", "ﬁ", "Ａ", " ", "\x00", "😀", "<0x0A>", "\r\n", "Hello"]


def test_pieces_match_the_library():
    codec, sp = ChunkCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec.safe
    random.seed(1)
    for _ in range(3000):
        text = "".join(random.choices(PARTS, k=random.randint(0, 12)))
        ids = sp.encode(text)
        assert codec.encode(text).tolist() == ids and codec.decode(text) == sp.decode(ids)
        assert codec.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_pieces_documents(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = catalogue.op8_pieces(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in got:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    encoded = encode_documents(clashing(spark, ["ids", "decoded"]), PIECES)
    want = sorted([(d[0], sp.encode(d[1] or ""), sp.decode(sp.encode(d[1] or ""))) for d in AWKWARD], key=str)
    assert sorted([(r.doc_id, list(r.ids), r.decoded) for r in encoded.collect()], key=str) == want
    assert sorted([(r.doc_id, r.text) for r in decode_documents(encoded, PIECES).collect()], key=str) == sorted([(i, t) for i, _, t in want], key=str)
    assert encode_documents(empty(spark), PIECES, digests=True).count() == 0


def test_encoder_matches_the_library():
    encoder, library = Encoder(BYTES), Tokenizer.from_file(BYTES)
    assert encoder.fast is not None
    random.seed(2)
    parts = [*PARTS, "it's", "12", "<|endoftext|>", "'ll", "!?", "\x85", "€", "²", "ª", "\x1c"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert encoder(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, " " * 2_000_000 + "word", "a" + "\t \n" * 700_000 + "b c"])
def test_long_white_space_is_encoded(text):
    assert Encoder(BYTES)(text).tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


def plain_packing(items: list[int], window: int) -> list[int]:
    left: list[int] = []
    for s in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= s
        else:
            left.append(window - s)
    return sorted(left)


def test_best_fit_decreasing():
    random.seed(7)
    for _ in range(200):
        window = random.choice([5, 16, 37])
        items = [random.randint(1, window) for _ in range(random.randint(0, 70))]
        placed, windows = best_fit_decreasing(np.bincount(items, minlength=window + 1), window)
        assert sorted(window - f for _, n, f in windows for _ in range(n)) == plain_packing(items, window)
        held = defaultdict(list)
        for s, _, n, first, per, offset in placed:
            for i in range(n):
                held[first + i // per].append((offset + i % per * s, s))
        for spots in held.values():
            assert [o for o, _ in sorted(spots)] == [0, *np.cumsum([s for _, s in sorted(spots)])[:-1]]
        assert sorted(s for spots in held.values() for _, s in spots) == sorted(items)


def test_segment_tree():
    tree, marked = SegmentTree(20), set()
    random.seed(0)
    for _ in range(300):
        i = random.randint(0, 20)
        marked ^= {i}
        tree.set(i, i in marked)
        q = random.randint(0, 20)
        assert tree.tightest(q) == min((m for m in marked if m >= q), default=-1)


def check_packs(got, docs, window):
    library = Tokenizer.from_file(BYTES)
    ids = defaultdict(list)
    for d in docs:
        ids[d[0]].append([*library.encode(d[1] or "", add_special_tokens=False).ids, 1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for doc_id, texts in ids.items():
        want = sorted((at, len(t[at : at + window]), zlib.crc32(np.array(t[at : at + window], dtype="<u4").tobytes()), len(t)) for t in texts for at in range(0, len(t), window))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id]) == want
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == members[0].sequence_tokens <= window
        assert members[0].padded_tokens == (at if at & (at - 1) == 0 else window)
    assert sorted(sequences) == list(range(len(sequences)))
    lengths = [r.length for r in got]
    assert sorted(window - v[0].sequence_tokens for v in sequences.values()) == plain_packing(lengths, window)


def test_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    check_packs(pack_documents(docs, PackOptions(tokenizer=BYTES)).collect(), plain, 2048)
    check_packs(pack_documents(clashing(spark, ["rank", "part", "length", "before", "n"]), PackOptions(tokenizer=BYTES, window=64)).collect(), AWKWARD, 64)
    assert pack_documents(empty(spark), PackOptions(tokenizer=BYTES)).count() == 0


def test_pipeline(spark, small):
    """Each stage on its predecessor's rows: what goes, and that what stays is as it was. Short lines count as well."""
    from tests.llm.test_joins import join_brute, line_brute

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    junk = spark.createDataFrame([(10**6, "12 345 || 99", "en", "s", 12)], docs.schema)
    before = docs.unionByName(junk).cache()
    kept = corpus_pipeline.STAGES[0][1](spark, before, small)
    assert kept.columns == columns and rows(kept) == rows(docs)
    good = corpus_pipeline.STAGES[1][1](spark, kept, small).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    stay = {r.doc_id for r in good.collect()}
    assert good.columns == columns and sum(q == 1 and d not in stay for d, q in labels.items()) <= 0.05 * len(labels)
    assert sum(q == 0 and d in stay for d, q in labels.items()) <= 0.2 * max(1, sum(q == 0 for q in labels.values()))
    some = good.where(F.length("text") < 1500).cache()
    lined = corpus_pipeline.STAGES[2][1](spark, some, small).cache()
    plain = [tuple(r) for r in some.collect()]
    decided = line_brute(plain, corpus_pipeline.remove_repeated_lines.__globals__["LineOptions"]())
    keep = {(d, n) for d, n, *_, kept in decided if kept}
    want = {}
    for d in plain:
        lines = d[1].split("\n")
        left = [x for n, x in enumerate(lines) if (d[0], n) in keep]
        text = d[1] if len(left) == len(lines) else "\n".join(left)
        if text.strip(" \t\n\x0b\x0c\r"):
            want[d[0]] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in lined.collect()} == want and lined.columns == columns
    once = corpus_pipeline.STAGES[3][1](spark, lined, small).cache()
    classes = join_brute([tuple(r) for r in lined.collect()])
    assert {r.doc_id for r in once.collect()} == {d for d, c, *_ in classes if d == c} and once.columns == columns
    check_packs(corpus_pipeline.STAGES[4][1](spark, once, small).collect(), [tuple(r) for r in once.collect()], 2048)


def test_pipeline_stages_with_awkward_rows(spark, small):
    """Nulls, repeats, an empty table, and columns with the names that operators use."""
    own = ["lang_pred", "lang_score", "quality_score", "quality_predicted", "_t1", "_d", "_drops", "_stay", "_k1", "row", "id", "h1", "class", "text_"]
    docs = clashing(spark, own)
    kept = corpus_pipeline.language_id(spark, docs, small)
    assert kept.columns == docs.columns and rows(kept.select(*own).distinct()) == [("clash",) * len(own)]
    assert sorted({r.doc_id for r in kept.collect()} - {None}) == [1, 2, 6, 7, 8, 9, 10, 11]
    for stage in (corpus_pipeline.quality, corpus_pipeline.line_dedup, corpus_pipeline.ngram_dedup):
        left = stage(spark, docs, small)
        assert left.columns == docs.columns and rows(left.select(*own).distinct()) in ([], [("clash",) * len(own)])
        assert stage(spark, docs.where("false"), small).count() == 0
    lined = {(r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, small).collect()}
    assert (1, AWKWARD[0][1]) in lined and (6, AWKWARD[5][1]) not in lined and not {3, 4, 5} & {d for d, _ in lined}
    assert corpus_pipeline.packing(spark, docs, small).where("doc_id = 3").first().length == 1


def test_pipeline_runs(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "line_dedup", "ngram_dedup", "packing"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
