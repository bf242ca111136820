"""Problem 8: one mixture in which each source has its target share, by hierarchical budgets.

The target shares hang in a tree domain > language > source (the domain is the source's name up to its first '-', the
language the stored label of the document). A budget goes down the tree in proportion to the weights; a child that
cannot use its part, as its texts times max_repeats are too few, leaves the rest to its siblings before any of it goes
further up. Each leaf then takes whole seeded epochs of its texts and a token prefix of the next epoch's order. What the leaves
of a source lack or exceed together, as no text is split, is made up by some of the texts next to their cuts (EDGE on either
side of each), so that a source misses its budget by about half a short text, not by half a text a leaf.

Leaf sums (sources x languages) are all that reaches the driver. The prefix is a two-level running sum over hash buckets,
so no window holds a leaf. Null or unlisted sources take no part; null labels form the language 'und'. Texts of 0 tokens
are never used. A repeated mix_targets row counts once; a source without documents passes its share on.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.runtime import materialise

ROWS_PER_BUCKET = 20_000
#: Texts on either side of a leaf's cut that may be added or left out.
EDGE = 8


class Node:
    def __init__(self, weight: float = 0.0, room: float = 0.0):
        self.weight, self.room, self.budget = weight, room, 0.0
        self.children: dict[str, Node] = {}

    def total(self) -> None:
        if self.children:
            for c in self.children.values():
                c.total()
            self.weight = sum(c.weight for c in self.children.values())
            self.room = sum(c.room for c in self.children.values())

    def allocate(self, budget: float) -> None:
        """Split at most room among the children by weight; what a full child leaves is split again among its siblings."""
        self.budget = min(budget, self.room)
        open_, left = dict(self.children), self.budget
        given: dict[str, float] = defaultdict(float)
        while open_ and left > 1e-9:
            w = sum(c.weight for c in open_.values())
            full = {k: c for k, c in open_.items() if (left * c.weight / w if w else left / len(open_)) >= c.room - 1e-9}
            if not full:
                for k, c in open_.items():
                    given[k] = left * c.weight / w if w else left / len(open_)
                break
            for k, c in full.items():
                given[k] = c.room
                left -= c.room
                del open_[k]
        for k, c in self.children.items():
            c.allocate(given[k])


def budgets(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total: float) -> dict[tuple[str, str], float]:
    """Budget of each leaf (source, language) from (source, language, tokens) and {source: (share, max_repeats)}."""
    have: dict[str, int] = defaultdict(int)
    for s, _, n in leaves:
        have[s] += n
    root = Node()
    for s, (share, _) in targets.items():
        if not have[s]:
            leaves = [*leaves, (s, "und", 0)]
    for s, lang, n in leaves:
        share, repeats = targets[s]
        d = root.children.setdefault(s.split("-")[0], Node())
        part = share * n / have[s] if have[s] else share
        d.children.setdefault(lang, Node()).children[s] = Node(part, n * repeats)
    root.total()
    root.allocate(total)
    return {(s, lang): leaf.budget for d in root.children.values() for lang, node in d.children.items() for s, leaf in node.children.items()}


def reachable(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]]) -> float:
    """Largest total at which every source that has texts and may be used gets its target share within its repeats."""
    have: dict[str, int] = defaultdict(int)
    for s, _, n in leaves:
        have[s] += n
    return min((n * targets[s][1] / targets[s][0] for s, n in have.items() if targets[s][1] > 0), default=0.0)


def size(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total_tokens: int | str | None) -> float:
    """Tokens of the mixture that total_tokens asks for (see mix)."""
    pool = sum(n for s, _, n in leaves if targets[s][1] > 0)
    if total_tokens == "pool":
        return pool
    if total_tokens == "whole":
        return max(pool, reachable(leaves, targets))
    return reachable(leaves, targets) if total_tokens is None else total_tokens


def mix(documents: DataFrame, targets: DataFrame, language, total_tokens: int | str | None = None, seed: int = 11) -> DataFrame:
    """(source, language, doc_id, n_tokens, copies, tokens_used) of every text used.

    documents: doc_id, source, n_tokens and what language (a column) needs. total_tokens: size of the mixture; by default the
    largest at which every source with texts reaches its target share; "pool" is the size of all listed texts that may be used,
    each once, at which small sources may fall short; "whole" is the larger of the two, so that no source gets fewer tokens than
    in either.
    """
    spark = documents.sparkSession
    want = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    docs = documents.select("doc_id", "source", F.coalesce(language, F.lit("und")).alias("language"), "n_tokens").where(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0))
    docs = materialise(docs, "mix")
    leaves = docs.groupBy("source", "language").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    known = [(r.source, r.language, r.n) for r in leaves]
    budget = budgets(known, want, size(known, want, total_tokens))
    plan = []
    for r in leaves:
        b = budget[r.source, r.language]
        epochs = min(int(b // r.n), want[r.source][1])
        part = b - epochs * r.n if epochs < want[r.source][1] else 0.0
        plan.append((r.source, r.language, epochs, float(part), max(1, -(-r.rows // ROWS_PER_BUCKET))))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, language string, epochs int, part double, buckets long"))  # a row a leaf
    keyed = docs.join(plan_df, ["source", "language"]).withColumn("h", F.xxhash64("doc_id", "epochs", F.lit(seed)))
    # buckets split the hash range in order, so that bucket order is epoch order
    keyed = keyed.withColumn("bucket", F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("long"))
    sums = keyed.groupBy("source", "language", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = sums.withColumn("before", F.sum("in_bucket").over(W.partitionBy("source", "language").orderBy("bucket")) - F.col("in_bucket"))
    run = F.sum("n_tokens").over(W.partitionBy("source", "language", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = keyed.join(before.select("source", "language", "bucket", "before"), ["source", "language", "bucket"]).withColumn("start", F.col("before") + run - F.col("n_tokens"))
    # a text belongs to the prefix if its middle lies within it: the leaf's error is at most half a text
    inside = F.col("start") + F.col("n_tokens") / 2 <= F.col("part")
    placed = materialise(placed.withColumn("inside", inside).withColumn("copies", F.col("epochs") + inside.cast("int")).select("source", "language", "doc_id", "n_tokens", "start", "inside", "epochs", "copies"), "placed")
    change = spark.createDataFrame(_adjust(placed, budget, want), "source string, language string, doc_id long, start long, delta int")
    same = [placed[k].eqNullSafe(change[k]) for k in ("source", "language", "doc_id", "start")]
    final = placed.join(F.broadcast(change), same[0] & same[1] & same[2] & same[3], "left").select(placed["source"], placed["language"], placed["doc_id"], "n_tokens", (F.col("copies") + F.coalesce("delta", F.lit(0))).cast("int").alias("copies"))  # at most 2 x EDGE rows a leaf
    return final.where("copies > 0").select("source", "language", "doc_id", "n_tokens", "copies", (F.col("n_tokens") * F.col("copies")).alias("tokens_used"))


def _adjust(placed: DataFrame, budget: dict[tuple[str, str], float], want: dict[str, tuple[float, int]]) -> list[tuple]:
    """(source, language, doc_id, start, +1 or -1): texts next to the cuts whose change brings each source closest to its budget."""
    took = {r.source: r.n for r in placed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    near = W.partitionBy("source", "language", "inside")
    k = F.row_number().over(near.orderBy(F.when(F.col("inside"), -F.col("start")).otherwise(F.col("start")), "doc_id"))
    lack: dict[str, float] = defaultdict(float)
    for (s, _), b in budget.items():
        lack[s] += b
    options: dict[str, list[tuple]] = defaultdict(list)
    for r in placed.withColumn("k", k).where(F.col("k") <= EDGE).collect():
        sign = -1 if r.inside else 1
        if 0 <= r.copies + sign <= want[r.source][1]:
            options[r.source].append((sign * r.n_tokens, r.language, -1 if r.doc_id is None else r.doc_id, r.doc_id, r.start, sign))
    out = []
    for s in sorted(options):
        left, free = lack[s] - took.get(s, 0), sorted(options[s], key=lambda o: o[:3])
        while free:
            o = min(free, key=lambda o: abs(left - o[0]))
            if abs(left - o[0]) >= abs(left):
                break
            free.remove(o)
            left -= o[0]
            out.append((s, o[1], o[3], o[4], o[5]))
    return out


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target share, reached share, texts, tokens and the most copies of one text."""
    per = mixture.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens_used").alias("tokens"), F.max("copies").alias("most_copies"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    whole = mixture.agg(F.sum("tokens_used").alias("whole"))
    out = t.join(per, "source", "left").crossJoin(F.broadcast(whole))  # one row
    z = F.lit(0).cast("long")
    return out.select("source", "target_share", "max_repeats", F.coalesce("texts", z).alias("texts"), F.coalesce("tokens", z).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"))
