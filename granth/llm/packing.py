"""Problem 7: filling containers of fixed capacity by first-fit decreasing.

Documents are dealt into random groups of bounded size (by hash of the id), and each group is packed on its own, for each
capacity, with a tournament tree over the free room of its bins: finding the first bin that fits takes log(bins) steps.
A group holds about group_tokens tokens and at most group_rows rows, so no task grows with the input; only the last
bins of a group may stay partly empty, which costs less than one container a group.

A document larger than the capacity is cut into full containers; its remainder is packed like any other item. Size 0
(null or empty text) takes no room and goes to the group's first container. Repeated documents are packed each time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granth.runtime import materialise

SCHEMA = "pack_id int, capacity_tokens int, group_no long, container_no int, doc_id long, piece_no int, start_token long, end_token long, size long, free long"
GROUP_TOKENS = 1_000_000
GROUP_ROWS = 20_000


class RoomTree:
    """Max tree over the free room of bins; first(size) is the lowest bin that still holds size, or -1."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        room, at = self.room, 1
        if room[1] < size:
            return -1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        leaf = at - self.leaves
        self.used = max(self.used, leaf + 1)
        at //= 2
        while at:
            a, b = room[2 * at], room[2 * at + 1]
            room[at] = a if a > b else b
            at //= 2
        return leaf

    def free(self, leaf: int) -> int:
        return self.room[self.leaves + leaf]


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item (all sizes <= capacity) and free room of each bin."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tree, bins = RoomTree(len(sizes), capacity), [0] * len(sizes)
    for i in order:
        bins[i] = tree.place(sizes[i])
    return bins, [tree.free(k) for k in range(tree.used)]


def pack(documents: DataFrame, capacities: DataFrame, group_tokens: int = GROUP_TOKENS, group_rows: int = GROUP_ROWS, seed: int = 5) -> DataFrame:
    """Container of every document (doc_id, n_tokens) for every capacity (pack_id, capacity_tokens)."""
    sized = materialise(documents.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")), "sizes")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    groups = max(1, -(-total // group_tokens), -(-n // group_rows))
    caps = [(r.pack_id, r.capacity_tokens) for r in capacities.select("pack_id", "capacity_tokens").where("capacity_tokens > 0").dropDuplicates().collect()]
    packs = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity_tokens")) for p, c in caps]) if caps else F.expr("array_remove(array(named_struct('pack_id', 1, 'capacity_tokens', 1)), named_struct('pack_id', 1, 'capacity_tokens', 1))")
    items = sized.withColumn("group_no", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups))).withColumn("p", F.explode(packs)).select("p.*", "group_no", "doc_id", "n_tokens")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pid, cap, group = int(pdf["pack_id"].iloc[0]), int(pdf["capacity_tokens"].iloc[0]), int(pdf["group_no"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        rows, rest, full = [], [], 0
        for doc, size in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
            whole = size // cap if size > cap else 0
            for k in range(whole):
                rows.append((full, doc, k, k * cap, (k + 1) * cap, cap, 0))
                full += 1
            if size - whole * cap or not whole:
                rest.append((doc, whole, whole * cap, size))
        bins, free = first_fit_decreasing([e - s for _, _, s, e in rest], cap)
        rows += [(full + b, doc, k, s, e, e - s, free[b]) for b, (doc, k, s, e) in zip(bins, rest)]
        out = pd.DataFrame(rows, columns=["container_no", "doc_id", "piece_no", "start_token", "end_token", "size", "free"])
        return out.astype({"doc_id": "Int64"}).assign(pack_id=pid, capacity_tokens=cap, group_no=group)[[c.split()[0] for c in SCHEMA.split(", ")]]

    return items.groupBy("pack_id", "capacity_tokens", "group_no").applyInPandas(run, SCHEMA)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: items, containers, tokens and the share of the containers' room that is used."""
    bins = packed.groupBy("pack_id", "capacity_tokens", "group_no", "container_no").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return bins.groupBy("pack_id", "capacity_tokens").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.col("capacity_tokens")), 6).alias("fill"), F.max("used").alias("fullest"))
