"""Retrieval metrics, question sets, hard negatives, tokenizer statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

METRICS = ("r1", "r5", "r10", "mrr10", "ndcg10")


def metrics(rankings: DataFrame, targets: DataFrame) -> DataFrame:
    """(system, query_id, lang, rank, r1, r5, r10, mrr10, ndcg10) of (system, query_id, id, rank) against (query_id, lang, target).

    Every query has one target; a query that a system doesn't rank counts with zeros.
    """
    systems = rankings.select("system").dropDuplicates()
    hit = rankings.join(targets.select("query_id", F.col("target").alias("id")), ["query_id", "id"]).select("system", "query_id", "rank")
    m = targets.join(F.broadcast(systems)).join(hit, ["system", "query_id"], "left")  # a handful of systems
    r, zero = F.col("rank"), F.lit(0.0)
    at = lambda k: F.when(r <= k, 1.0).otherwise(0.0)
    return m.select("system", "query_id", "lang", "rank", at(1).alias("r1"), at(5).alias("r5"), at(10).alias("r10"), F.when(r <= 10, 1.0 / r).otherwise(zero).alias("mrr10"), F.when(r <= 10, 1.0 / F.log2(r + 1)).otherwise(zero).alias("ndcg10"))


def summary(m: DataFrame, by_lang: bool) -> DataFrame:
    keys = ["system", "lang"] if by_lang else ["system"]
    return m.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in METRICS])


def markdown(summary_df: DataFrame) -> DataFrame:
    """(line_no, line) of a table; floats with three places. The summary has one row a system."""
    cell = F.concat_ws(" | ", "system", *[F.format_string("%.3f", c) for c in METRICS])
    rows = summary_df.select((F.row_number().over(W.orderBy("system")) + 2).cast("long").alias("line_no"), F.concat(F.lit("| "), cell, F.lit(" |")).alias("line"))
    head = summary_df.sparkSession.createDataFrame([(1, "| " + " | ".join(("system", *METRICS)) + " |"), (2, "|" + " --- |" * (len(METRICS) + 1))], "line_no long, line string")
    return head.unionByName(rows)


def shuffle_key(seed: int, *cols: str):
    """Deterministic order in place of a seeded shuffle."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def take_fraction(ids: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The first int(n x fraction) of distinct ids in hash order, exactly: only counts of 4,096 hash buckets reach the driver."""
    d = ids.select("id").where("id IS NOT NULL").dropDuplicates().withColumn("h", shuffle_key(seed, "id"))
    d = d.withColumn("b", F.substring("h", 1, 3))
    counts = sorted((r.b, r["count"]) for r in d.groupBy("b").count().collect())
    want, cut, left = int(sum(n for _, n in counts) * fraction), "", 0
    for b, n in counts:
        if want < n:
            cut, left = b, want
            break
        want -= n
    else:
        return d.select("id")
    edge = d.where(F.col("b") == cut).withColumn("k", F.row_number().over(W.orderBy("h", "id"))).where(F.col("k") <= left)  # one bucket of 4,096
    return d.where(F.col("b") < cut).select("id").unionByName(edge.select("id"))


def parse_questions(raw):
    """array<struct<lang,question>> of the valid entries in the outermost braces of a model's answer; empty if there are none."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    q = F.from_json(body, "struct<questions:array<struct<lang:string,question:string>>>")["questions"]
    ok = F.filter(q, lambda x: x["lang"].isin("en", "hi", "hinglish") & (F.length(x["question"]) > 8))
    return F.coalesce(F.transform(ok, lambda x: F.struct(x["lang"].alias("lang"), F.trim(x["question"]).alias("question"))), F.array().cast("array<struct<lang:string,question:string>>"))


def hard_negatives(ranked: DataFrame, positives: DataFrame, rank_min: int = 3, rank_max: int = 30, margin: float = 0.02, seed: int = 13) -> DataFrame:
    """(query_id, positive, negative, pos_score, neg_score, neg_rank) from (query_id, id, score, rank), ranked to rank_max + 11.

    Ranks are counted without the positive; candidates lie in the band and below pos_score - margin; without any, the ten after
    the band serve, and if there are none either, the last ten. The choice among candidates is the smallest hash.
    """
    r = ranked.join(positives, "query_id").where("id <> positive")
    r = r.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long"))
    band = (F.col("k") >= rank_min) & (F.col("k") <= rank_max) & (F.col("score") < F.col("pos_score") - margin)
    after = (F.col("k") > rank_max) & (F.col("k") <= rank_max + 10)
    r = r.withColumn("last", F.max("k").over(W.partitionBy("query_id")))
    c = r.where(band | after | (F.col("k") > F.col("last") - 10)).withColumn("tier", F.when(band, 0).when(after, 1).otherwise(2)).withColumn("h", shuffle_key(seed, "query_id", "id"))
    best = c.groupBy("query_id", "positive", "pos_score").agg(F.min(F.struct("tier", "h", "id", "score", "k")).alias("b"))
    return best.select("query_id", "positive", F.col("b.id").alias("negative"), "pos_score", F.col("b.score").alias("neg_score"), F.col("b.k").alias("neg_rank"))
