"""Reciprocal rank fusion, hydration of hits, and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.functions import text as T
from granth.runtime import materialise, small_side

RRF_K = 60


def rrf(dense: DataFrame, lexical: DataFrame, n: int, k: int = RRF_K) -> DataFrame:
    """(query_id, id, dense_score, dense_rank, bm25_rank, rrf_score, pos): the first n of both lists fused.

    Ties go to the better dense rank (missing last), then to the better lexical rank: the order of first appearance.
    """
    one = lambda df, d, s, r: df.select("query_id", "id", s.alias("dense_score"), d.alias("dense_rank"), r.alias("bm25_rank"), (1.0 / (k + F.col("rank"))).alias("part"))
    none_l, none_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    both = one(dense, F.col("rank"), F.col("score"), none_l).unionByName(one(lexical, none_l, none_d, F.col("rank")))
    fused = both.groupBy("query_id", "id").agg(F.max("dense_score").alias("dense_score"), F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"), F.round(F.sum("part"), 9).alias("rrf_score"))
    w = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "id")
    return fused.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= n)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their chunk and document; a hit whose chunk is gone is dropped. Text joins late, for fused ids only: other chunks are
    left out where they are read, not shuffled."""
    hits = materialise(hits, "fused")
    ids = materialise(hits.select("id").dropDuplicates(), "ids")
    c = chunks.select("id", "doc_id", "page", "language", "text").join(small_side(ids, 16), "id", "left_semi")
    d = documents.select("doc_id", "filename")
    return hits.join(c, "id").join(d, "doc_id").select("query_id", F.col("id").alias("chunk_id"), "doc_id", "filename", "page", "language", "text", "dense_score", "dense_rank", "bm25_rank", "rrf_score", "pos")


def overlap_score(query: str, text: str):
    """Default reranker: share of the query's distinct terms that the passage has."""
    q = F.array_distinct(T.tokens(F.coalesce(query, F.lit(""))))
    return F.round(F.coalesce(F.size(F.array_intersect(q, T.tokens(F.coalesce(text, F.lit(""))))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)), 6)


def rerank(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits by rerank_score, ties by fused position, first k."""
    s = hits.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", overlap_score("query", "text")).drop("query")
    w = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pos")
    return s.withColumn("final", F.row_number().over(w).cast("long")).where(F.col("final") <= k)
