"""Exact dedup and sharding."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from relomap.llm.catalogue import op3_sharding
from relomap.llm.common import flat_bytes
from relomap.llm.exact_dedup import CHUNK, Polynomial, exact_dedup
from relomap.llm.sharding import ShardOptions, pack, place, shard_documents
from tests.llm.util import AWKWARD, clashing, empty, rows, table


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3 * CHUNK), min_size=1, max_size=5))
def test_fingerprints_compose(parts):
    p = Polynomial()
    flat, offsets = flat_bytes(pa.array([*parts, b"".join(parts)], type=pa.large_binary()))
    many = [tuple(map(int, r)) for r in p.many(flat, offsets)]
    assert many == [p.of(x) for x in [*parts, b"".join(parts)]]
    whole = many[0]
    for part, own in zip(parts[1:], many[1:], strict=False):
        whole = p.combine(whole, own, len(part))
    assert whole == many[-1]


def norm(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(docs: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for d in docs:
        groups[norm(d[1])].append(d)
    out = []
    for text, members in groups.items():
        head = min(members, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))
        for d in members:
            kept = d[0] == head[0] and len(d[1] or "") == len(head[1] or "")
            out.append((d[0], head[0], len(members), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark):
    want = brute(AWKWARD)
    assert rows(exact_dedup(table(spark))) == want
    assert rows(exact_dedup(clashing(spark, ["norm", "fp", "sha", "keep_id", "n", "head"]))) == want
    assert rows(exact_dedup(empty(spark))) == []


def test_collisions_are_parted(spark):
    random.seed(4)
    docs = [(i, "".join(random.choices("ab \n", k=random.randint(0, 6))), "en", "s", 1) for i in range(300)]
    weak = Polynomial(primes=(3, 5), bases=(2, 2))
    assert rows(exact_dedup(table(spark, docs), polynomial=weak)) == brute(docs)


def test_ids_of_other_types(spark):
    from pyspark.sql import functions as F

    want = [(None if d is None else f"n{d}", None if k is None else f"n{k}", *rest) for d, k, *rest in brute(AWKWARD)]
    named = table(spark).withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    got = rows(exact_dedup(named))
    assert [r[2:] for r in got] == [r[2:] for r in sorted(want, key=str)] and {r[0] for r in got} == {r[0] for r in want}
    assert rows(exact_dedup(table(spark).withColumn("doc_id", F.col("doc_id").cast("int")))) == brute(AWKWARD)


def test_hot_group_without_ids(spark):
    docs = [(None, "same text", "en", "s", 1)] * 5000 + [(i, f"text {i}", "en", "s", 1) for i in range(1000)]
    got = exact_dedup(table(spark, docs)).groupBy("group_size").count().collect()
    assert {r.group_size: r["count"] for r in got} == {5000: 5000, 1: 1000}


def test_hot_group(spark):
    docs = [(i, "same text" if i % 3 else f"text {i}", "en", "s", 1) for i in range(7000)]  # more copies than one salt takes
    assert rows(exact_dedup(table(spark, docs))) == brute(docs)


def shuffled_bytes(spark) -> int:
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_single_rows_are_not_dealt(spark):
    random.seed(6)
    docs = [(i, random.randbytes(1500).hex(), "en", "s", 1) for i in range(2000)]
    docs += [(10_000 + i, " " + docs[7 * i][1], "en", "s", 1) for i in range(60)]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the groups were many
    try:
        given, before = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").cache(), shuffled_bytes(spark)
        assert rows(exact_dedup(given)) == brute(docs)
        assert shuffled_bytes(spark) - before < sum(len(d[1]) for d in docs) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_bitmap_lets_single_rows_pass(spark, monkeypatch):
    monkeypatch.setattr("relomap.llm.exact_dedup.WORDS", 1)  # many single rows are compared with themselves
    docs = [(i, f"text {i if i % 3 else i % 60}", "en", "s", 1) for i in range(400)]
    assert rows(exact_dedup(table(spark, docs))) == brute(docs)


def check_shards(got, docs, shards, tolerance):
    by = defaultdict(list)
    assert sorted(r.size for r in got) == sorted(len((d[1] or "").encode()) + 8 for d in docs)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((d[1] or "").encode()) for d in docs)
    for r in got:
        assert 0 <= r.shard < shards
        by[r.shard].append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    fill = [sum(r.size for r in by[k]) for k in range(shards)]
    assert max(fill) - min(fill) <= tolerance, fill


def test_sharding_awkward(spark):
    for docs in (table(spark), clashing(spark, ["group", "unit", "shard", "size", "slot", "heavy", "pieces"])):
        check_shards(shard_documents(docs, options=ShardOptions(shards=3)).collect(), AWKWARD, 3, 10**6)
    assert shard_documents(empty(spark)).count() == 0


def test_sharding_balance(spark):
    random.seed(5)
    docs = [(i, "x" * random.randint(0, 400), "en", "s", 1) for i in range(4000)]
    docs += [(10_000 + i, "hot " * 20, "en", "s", 1) for i in range(2000)]  # a third of all rows
    small = ShardOptions(shards=8, heavy=200, light=400)
    got = shard_documents(table(spark, docs), options=small).collect()
    check_shards(got, docs, 8, 16)
    tokens, count = np.zeros(8), np.zeros(8)
    for r in got:
        tokens[r.shard] += r.n_tokens
        count[r.shard] += 1
    assert count.max() / count.mean() < 1.2
    shard_of = defaultdict(set)
    sizes = defaultdict(int)
    for r in got:
        shard_of[r.text_crc32].add(r.shard)
        sizes[r.text_crc32] += r.size
    share = sum(sizes.values()) / 8
    assert all(len(s) == 1 for k, s in shard_of.items() if sizes[k] <= share / 8)


def test_a_group_is_cut_only_above_a_share(spark):
    docs = [(i, "y" * 300 + str(i), "en", "s", 1) for i in range(400)]
    docs += [(1000 + i, "hot " * 20, "en", "s", 1) for i in range(90)] + [(None, "null ids " * 20, "en", "s", 1) for i in range(180)]
    got = shard_documents(table(spark, docs), options=ShardOptions(shards=4, heavy=50, light=200, numbered=13)).collect()
    check_shards(got, docs, 4, 700)
    shard_of = defaultdict(set)
    for r in got:
        shard_of[r.text_crc32].add(r.shard)
    assert len(shard_of[zlib.crc32(b"hot " * 20)]) == 1  # above half of a share, in rows
    assert len(shard_of[zlib.crc32(b"null ids " * 20)]) > 1  # three shares of the tokens


def plain_pack(items: list[list[int]], shards: int) -> list[int]:
    """Vector bin packing item by item, with exact fractions."""
    from fractions import Fraction

    total = [sum(x[j] for x in items) for j in range(len(items[0]))]
    loads = [[Fraction(x, t) if t else Fraction(0) for x, t in zip(item, total, strict=True)] for item in items]
    left = [[Fraction(1, shards) if t else Fraction(0) for t in total] for _ in range(shards)]
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(loads[i]), i)):
        room = lambda k: [a - b for a, b in zip(left[k], loads[i], strict=True)]  # noqa: E731, B023
        fits = [k for k in range(shards) if min(room(k)) >= 0]
        if fits:
            best = max(fits, key=lambda k: (sum(a * b for a, b in zip(left[k], loads[i], strict=True)), -k))
        else:
            best = max(range(shards), key=lambda k: (min(room(k)), -k))
        out[i], left[best] = best, room(best)
    return out


def test_packing_is_by_dot_product():
    rng = np.random.default_rng(4)
    for _ in range(40):
        items = rng.integers(1, 1000, (int(rng.integers(1, 60)), 3))
        shards = int(rng.integers(1, 7))
        assert pack(items, shards).tolist() == plain_pack(items.tolist(), shards)


def test_no_exchange_evens_the_bytes_further():
    """Between the fullest and the emptiest shard no item, and no pair of items, closes more of the gap in bytes."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        items, shards = rng.integers(1, 200, (120, 3)), 5
        shard = place(items, shards)
        fill = np.bincount(shard, weights=items[:, 0], minlength=shards)
        hi, lo = int(fill.argmax()), int(fill.argmin())
        gap = fill[hi] - fill[lo]
        taken = items[shard == hi, 0][:, None] - np.append(items[shard == lo, 0], 0)[None, :]
        assert gap <= 1 or not ((taken > 0) & (taken < gap)).any()


def test_place_is_close():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 1000, (3000, 3))
    shard = place(items, 24)
    fill = np.bincount(shard, weights=items[:, 0], minlength=24)
    assert fill.max() - fill.min() <= 2
    for j in (1, 2):
        other = np.bincount(shard, weights=items[:, j], minlength=24)
        assert other.max() / other.mean() < 1.1


def test_query(spark, small):
    got = op3_sharding(spark, small).collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(got, docs, 24, max(len(d[1].encode()) for d in docs) * 2)
