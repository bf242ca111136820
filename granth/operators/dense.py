"""Exact inner-product search: query blocks against all rows, a running top-k per task, then per query."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from granth.functions import text as T
from granth.operators.lexical import top
from granth.runtime import materialise, small_side

DIM = 64
#: Queries of up to DIM places that travel together to all rows, fewer of longer ones: 8 MB. More queries take more passes.
BLOCK = 16384
#: Queries that are scored together against a batch of rows, which takes 0.5 MB a query.
ROWS = 128
#: Pairs of them that are scored one by one; from more on, whole rows are.
PAIRS = 200_000


@lru_cache(maxsize=200_000)
def slot(token: str, dim: int = DIM) -> int:
    return hashlib.md5(token.encode("utf-8", "surrogatepass")).digest()[-1] % dim


@F.pandas_udf(ArrayType(DoubleType()))
def hash_vector(tokens: pd.Series) -> pd.Series:
    """Deterministic embedding: tokens counted in 64 hashed slots, unit length; zero without tokens."""

    def one(ts) -> np.ndarray:
        v = np.bincount([slot(t) for t in ts], minlength=DIM).astype(float) if ts is not None and len(ts) else np.zeros(DIM)
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    return tokens.map(one)


def embed(items: DataFrame, column: str = "text") -> DataFrame:
    """items with a vector, by the default hash embedder; other embedders supply any array<double> column."""
    return items.withColumn("vector", hash_vector(T.tokens(F.coalesce(column, F.lit("")))))


def search(items: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best of (id, vector) for each (query_id, vector), ties by id, no score threshold.

    Null vectors take no part; a row whose dimension is not that of the queries is an error. A scope is applied before scoring. Every
    task keeps k rows a query, so what is shuffled does not grow with the rows. A query of zeros has k rows too, by id.
    """
    rows = items.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL")
    if allowed is not None:
        ids = materialise(allowed.select("id").where("id IS NOT NULL").dropDuplicates(), "scope")
        rows = rows.join(small_side(ids, 16), "id", "left_semi")
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)  # every task returns k rows a query
    asked = queries.select("query_id", "vector").where("query_id IS NOT NULL AND vector IS NOT NULL")
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n // max(1, BLOCK * DIM // max(DIM, dim or 0))))
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        parts.append(rows.mapInPandas(_scorer(block, k), "query_id long, id long, score double"))
    return top(reduce(DataFrame.unionByName, parts), k) if k > 0 else top(parts[0].limit(0), 1)


def best_columns(s: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) columns of the k largest of each row, lower columns first among equals; s is rounded to six places."""
    m = s.shape[1]
    if m <= k:
        return np.broadcast_to(np.arange(m), s.shape)
    if np.abs(s).max() * 1e6 * m < 2**61:  # score and column in one integer
        key = np.rint(s * 1e6).astype(np.int64) * m + np.arange(m - 1, -1, -1)
        return np.argpartition(key, m - k, axis=1)[:, m - k:]
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def _scorer(block: pd.DataFrame, k: int):
    ids = block["query_id"].to_numpy(np.int64)
    q = np.array([np.asarray(v, np.float64) for v in block["vector"]]) if len(block) else np.zeros((0, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, who = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for pdf in batches:
            if not len(ids) or not len(pdf):
                continue
            wrong = pdf["vector"].map(len).to_numpy() != q.shape[1]
            if wrong.any():
                raise ValueError(f"vector of id {pdf['id'][wrong].iloc[0]} has another dimension than the queries ({q.shape[1]})")
            pdf = pdf.sort_values("id")
            x, own = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]]), pdf["id"].to_numpy(np.int64)
            width = min(k, score.shape[1] + len(own))
            full = score.shape[1] == k > 0
            new_s, new_w = np.empty((len(ids), width)), np.empty((len(ids), width), np.int64)
            for lo in range(0, len(ids), ROWS):
                at = slice(lo, min(lo + ROWS, len(ids)))
                some = _screened(q[at], x, score[at, -1], k) if full else None
                whole = np.ones(at.stop - lo, bool) if some is None else some[2]
                new_s[at], new_w[at] = (score[at], who[at]) if full else (0, 0)
                if whole.any():
                    rows = lo + np.flatnonzero(whole)
                    s = np.round(q[rows] @ x.T, 6) + 0.0
                    c = best_columns(s, k)
                    s, w = np.concatenate([score[rows], np.take_along_axis(s, c, 1)], axis=1), np.concatenate([who[rows], own[c]], axis=1)
                    order = np.lexsort((w, -s), axis=1)[:, :k]
                    new_s[rows], new_w[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
                if some is not None and len(some[0]):
                    rows, back = np.unique(lo + some[0], return_inverse=True)
                    s = np.concatenate([score[rows].ravel(), np.round(np.einsum("ij,ij->i", q[lo + some[0]], x[some[1]]), 6) + 0.0])
                    w, row = np.concatenate([who[rows].ravel(), own[some[1]]]), np.concatenate([np.repeat(np.arange(len(rows)), k), back])
                    order = np.lexsort((w, -s, row))
                    order = order[np.searchsorted(row[order], np.arange(len(rows)))[:, None] + np.arange(k)]
                    new_s[rows], new_w[rows] = s[order], w[order]
            score, who = new_s, new_w
        if score.size:
            yield pd.DataFrame({"query_id": np.repeat(ids, score.shape[1]), "id": who.ravel(), "score": score.ravel()})

    return run


def _screened(q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, column) of the pairs whose score may reach the floor of their row, by products in single precision less all they can be
    wrong by, and the rows that have too many of them to be scored one by one. None if single precision is of no use."""
    size = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
    if not (np.isfinite(size).all() and np.isfinite(floor).all() and size.max() < 1e30):
        return None
    least = (floor - size * (q.shape[1] + 8) * 2.0**-23 - 2e-6).astype(np.float32)
    may = q.astype(np.float32) @ x.astype(np.float32).T >= least[:, None]
    count = may.sum(axis=1)
    whole = count > 4 * k
    if count[~whole].sum() > PAIRS:
        whole[:] = True
    may[whole] = False
    row, column = np.nonzero(may)
    return row, column, whole
