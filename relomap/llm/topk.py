"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Candidates are cut into blocks, queries too, and each pair of blocks is one group:
the queries' terms are taken one at a time, and the term's postings, weighted by the queries' values, are scattered into
dense score arrays. Each group keeps its k best by partition selection; the groups' lists are merged per query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relomap.llm.common import tune


@dataclass(frozen=True)
class SearchOptions:
    k: int = 5
    #: Components become floor(scale * x).
    scale: int = 256
    #: Rows of a block of candidates, and of queries.
    candidate_block: int = 2048
    query_block: int = 1024
    #: Blocks of candidates there are at least, down to 128 rows each, so that small tables spread over tasks.
    least_blocks: int = 24


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ``ids`` ascend."""
    if len(scores) <= k:
        chosen = np.arange(len(scores))
    else:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))]


def accumulate(queries: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Scores of sparse queries (terms, values) against ``n`` candidates given as postings sorted by term."""
    scores = np.zeros((len(queries), n), dtype=np.int64)
    q_terms = np.concatenate([t for t, _ in queries]) if queries else np.zeros(0, dtype=np.int64)
    q_rows = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
    q_values = np.concatenate([v for _, v in queries]) if queries else np.zeros(0, dtype=np.int64)
    order = np.argsort(q_terms, kind="stable")
    q_terms, q_rows, q_values = q_terms[order], q_rows[order], q_values[order]
    for term in np.unique(q_terms):
        a, b = np.searchsorted(terms, [term, term + 1])
        if a == b:
            continue
        c, d = np.searchsorted(q_terms, [term, term + 1])
        mine, theirs = q_rows[c:d], rows[a:b]
        if len(theirs) == n and len(mine) == len(queries):  # every row has the term: both lists are the ranges
            scores += q_values[c:d, None] * weights[None, a:b]
        else:
            scores[np.ix_(mine, theirs)] += q_values[c:d, None] * weights[None, a:b]
    return scores


def _sparse(table: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    ids = table.column("vec_id").to_numpy()
    lists = table.column("values").combine_chunks()
    values, offsets = np.asarray(lists.values), lists.offsets.to_numpy()
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        row = values[a:b]
        at = np.flatnonzero(row)
        out.append((at, row[at]))
    return ids, out


def _search(k: int):
    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: dict[str, list] = {n: [] for n in ("query_id", "query_key", "vec_id", "score")}
        if queries.num_rows and candidates.num_rows:
            ids, rows = _sparse(candidates.sort_by("vec_id"))
            terms = np.concatenate([t for t, _ in rows])
            order = np.argsort(terms, kind="stable")
            postings = (terms[order], np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])[order], np.concatenate([v for _, v in rows])[order])
            query_ids, query_rows = _sparse(queries)
            keys = queries.column("query_key").to_numpy()
            step = max(1, (4 << 20) // len(ids))  # queries whose dense score arrays are held at once
            for at in range(0, len(query_ids), step):
                scores = accumulate(query_rows[at : at + step], *postings, len(ids))
                for i, row in enumerate(scores, at):
                    others = np.flatnonzero(ids != query_ids[i])
                    top = others[best(row[others], ids[others], k)]
                    for name, part in (("query_id", np.full(len(top), query_ids[i])), ("query_key", np.full(len(top), keys[i])), ("vec_id", ids[top]), ("score", row[top])):
                        found[name].append(part)
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64), type=pa.int64()) for n, v in found.items()})

    return search


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", options: SearchOptions | None = None) -> DataFrame:
    """The k candidates of highest integer inner product for each query row: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components x become floor(scale * x). Every row with another id than the query's is a candidate. Ties go to the
    smaller id.

    Defined cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows with a null
    id; a component that a shorter vector lacks counts as 0; rows repeated with equal id and vector count once as
    queries, and each as a candidate; fewer candidates than k give as many rows; empty tables give an empty result;
    other columns are ignored.
    """
    o = options or SearchOptions()
    tune(vectors.sparkSession)
    vec = F.col(vector_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    base = vectors.where(vec.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * o.scale).cast("long")).alias("values"), is_query.alias("is_query")
    )
    rows, asked = base.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    size = max(128, min(o.candidate_block, -(-rows // o.least_blocks)))
    blocks, query_blocks = max(1, -(-rows // size)), max(1, -(-asked // o.query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "values"), F.lit(n)).cast("int")
    queries = base.where("is_query").select("vec_id", "values", F.xxhash64("vec_id", "values").alias("query_key")).dropDuplicates(["vec_id", "values"])
    queries = queries.withColumn("qb", deal(query_blocks)).withColumn("cb", every(blocks))
    candidates = base.select("vec_id", "values", deal(blocks).alias("cb"), every(query_blocks).alias("qb"))
    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(_search(o.k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
