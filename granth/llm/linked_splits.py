"""Problem 4: train / validation / test splits that keep linked records together.

Documents are linked by questions naming two of them and by equal files. Their components are kept in a persisted table
(doc, component, n, split, status) under a path of its own, in buckets by hash of the document. A batch maps the ends of its links to
the components they are in, finds components among those only (smallest labels with pointer jumping over a link table that is
contracted each round), and rewrites only the buckets of documents whose row changes. Existing components keep their split, new
ones fill the deficits, and components that merge across different splits are quarantined. What a batch shuffles grows with the
batch; the table is only scanned.

Nulls: a null doc_id / chunk_id names nothing; a question that names no document is left out. A blank sha256 is no
file identity. Repeated rows count once. Empty inputs give empty tables with the same columns.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.runtime import BLANK, materialise, read_text, scratch, small_side, write_text

RATIOS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Components that hold more than this share of all questions are placed one by one (there are at most 1/share of them).
LARGE_SHARE = 0.002
#: The others are spread over hash buckets of about so many components, which fill the deficits in order.
BUCKET_ROWS = 20_000
#: Documents in one bucket of the persisted table, as far as its first batch tells.
TABLE_ROWS = 500_000


def question_docs(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qa_id, doc): the documents each question names, by doc_id and by the document of its chunk, once each."""
    q = qa.select("qa_id", "doc_id", "chunk_id").where("qa_id IS NOT NULL").dropDuplicates()
    own = q.select("qa_id", F.col("doc_id").alias("doc"))
    via = q.where("chunk_id IS NOT NULL").join(chunks.select(F.col("id").alias("chunk_id"), F.col("doc_id").alias("doc")), "chunk_id").select("qa_id", "doc")
    return own.unionByName(via).where("doc IS NOT NULL").dropDuplicates()


def file_links(documents: DataFrame) -> DataFrame:
    """(a, b): each document to the smallest one with the same sha256, but for case and outer blanks."""
    key = F.lower(F.regexp_replace("sha256", f"^[{BLANK}]+|[{BLANK}]+$", ""))
    d = documents.select("doc_id", key.alias("sha")).where("doc_id IS NOT NULL AND sha <> ''")
    low = d.groupBy("sha").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return d.join(low, "sha").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")


def question_links(named: DataFrame) -> DataFrame:
    """(a, b): a question's documents, each to the smallest, as distinct links: a hot document gives no hot group."""
    low = named.groupBy("qa_id").agg(F.min("doc").alias("b"), F.max("doc").alias("m")).where("b < m").select("qa_id", "b")
    return named.join(low, "qa_id").where("doc <> b").select(F.col("doc").alias("a"), "b").dropDuplicates()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(doc, root): smallest member of the component of every linked vertex.

    Each round: every vertex points to its smallest neighbour, pointers jump to their ends, links are contracted to
    roots and made distinct. Vertices at least halve per round, so that 60 rounds are enough for any table; should links be
    left all the same, this raises. Tables are written to the shared folder per round.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").dropDuplicates(), "edges")
    known: DataFrame | None = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("m")).select("doc", F.least("doc", "m").alias("root")), "point")
        while True:
            up = point.select(F.col("doc").alias("root"), F.col("root").alias("up"))
            jumped = materialise(point.join(up, "root", "left").select("doc", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved")), "jump")
            point = jumped.select("doc", "root")
            if jumped.where("moved").isEmpty():
                break
        a, b = point.select(F.col("doc").alias("a"), F.col("root").alias("ra")), point.select(F.col("doc").alias("b"), F.col("root").alias("rb"))
        edges = materialise(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).dropDuplicates(), "edges")
        if known is None:
            known = point
        else:
            known = known.join(point.select(F.col("doc").alias("root"), F.col("root").alias("r2")), "root", "left").select("doc", F.coalesce("r2", "root").alias("root"))
            known = materialise(known, "known")
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"links are left after {max_rounds} rounds")
    if known is None:
        return links.select(F.col("a").alias("doc"), F.col("b").alias("root")).limit(0)
    return known


def question_groups(qa: DataFrame, chunks: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """(qa_id, group_doc_id): smallest document of the component of every question that names a document, from the table at path."""
    first, state = _first_batch(qa, chunks, documents, path)
    return first.join(state.select("doc", "component"), "doc").select("qa_id", F.col("component").alias("group_doc_id"))


def _first_batch(qa: DataFrame, chunks: DataFrame, documents: DataFrame, path: str | None) -> tuple[DataFrame, DataFrame]:
    """(qa_id, doc) of every question that names a document, and the component table after it took them all in."""
    kept = ComponentTable(qa.sparkSession, path or scratch(qa.sparkSession, "components"))
    named = materialise(question_docs(qa, chunks), "named")
    first = named.groupBy("qa_id").agg(F.min("doc").alias("doc"))
    kept.update(first, question_links(named).unionByName(file_links(documents)))
    return first, kept.read()


def assign_splits(sizes: DataFrame, taken: dict[str, int], ratios=RATIOS, seed: int = 17) -> DataFrame:
    """(component, split) for new components of (component, n), filling what each split lacks.

    taken: questions that each split holds already. Components above LARGE_SHARE of the total go one by one, largest
    first, to the split that lacks most; their number is bounded by 1 / LARGE_SHARE. All others are ordered by hash and laid
    end to end over the remaining deficits: bucket sums come to the driver (one for BUCKET_ROWS components), never components.
    """
    own, rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, buckets = own + sum(taken.values()), max(1, -(-rows // BUCKET_ROWS))
    lack = {s: r * total - taken.get(s, 0) for s, r in ratios}
    cut = LARGE_SHARE * total
    placed = []
    for r in sizes.where(F.col("n") > cut).orderBy(F.desc("n"), "component").collect():
        s = max(lack, key=lambda k: lack[k])
        lack[s] -= r.n
        placed.append((r.component, s))
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)["component"]
    large = spark.createDataFrame(placed, f"component {kind}, split string")
    rest = sizes.where(F.col("n") <= cut).withColumn("h", F.xxhash64("component", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = {r.bucket: r.n for r in rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for b in range(buckets):
        starts.append((b, at))
        at += sums.get(b, 0)
    room = {s: max(0.0, v) for s, v in lack.items()}
    scale = at / (sum(room.values()) or 1)
    edge, ends = 0.0, []
    for s, _ in ratios:
        edge += room[s] * scale
        ends.append((s, edge))
    place = F.col("start") + F.sum("n").over(W.partitionBy("bucket").orderBy("h", "component")) - F.col("n") / 2
    pick = F.lit(ends[-1][0])
    for s, e in reversed(ends[:-1]):
        pick = F.when(F.col("place") < e, s).otherwise(pick)
    small = rest.join(F.broadcast(spark.createDataFrame(starts, "bucket long, start long")), "bucket").withColumn("place", place).select("component", pick.alias("split"))
    return large.unionByName(small)


STATE = "doc long, component long, n long, split string, status string"


class ComponentTable:
    """Persisted (doc, component, n, split, status) of every document seen; n counts the questions that name it first.

    path holds a folder per version with a folder per bucket, and a manifest that names the current folder of each bucket. A batch
    writes the buckets it changes and then replaces the manifest, so readers see all of a batch or nothing.

    status: new, kept (the component existed and keeps its split), or quarantined (it joins components of different splits, or
    holds a quarantined one; its split is null and stays so until someone decides).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/manifest.json")
        return json.loads(text) if text else {"version": 0, "buckets": 0, "at": {}}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        at = self.manifest()["at"]
        folders = [f"{self.path}/{folder}" for k, folder in sorted(at.items()) if buckets is None or int(k) in buckets]
        return self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)

    def update(self, named: DataFrame, links: DataFrame, ratios=RATIOS) -> None:
        """Take in a batch: named (qa_id, doc) of questions not seen before, links (a, b) between documents."""
        state = self.read()
        links = materialise(links.select("a", "b").where("a <> b").dropDuplicates(), "links")
        n_new = materialise(named.groupBy("doc").agg(F.count("*").alias("n_new")), "n_new")
        ends = materialise(n_new.select("doc").unionByName(links.select(F.col("a").alias("doc"))).unionByName(links.select(F.col("b").alias("doc"))).dropDuplicates(), "ends")
        # where the batch's documents are now; the table is scanned, not shuffled, as long as the batch is small
        inside = materialise(state.select("doc", "component").join(small_side(ends, 16), "doc", "left_semi"), "inside")
        root = materialise(ends.join(inside, "doc", "left").select("doc", F.coalesce("component", "doc").alias("root"), F.col("component").isNull().alias("fresh")), "root")
        a, b = root.select(F.col("doc").alias("a"), F.col("root").alias("ra")), root.select(F.col("doc").alias("b"), F.col("root").alias("rb"))
        met = components(links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        moves = root.groupBy("root").agg(F.min("fresh").alias("fresh")).join(met.select(F.col("doc").alias("root"), F.col("root").alias("to")), "root", "left")
        moves = materialise(moves.select(F.col("root").alias("was"), F.coalesce("to", "root").alias("to"), "fresh"), "moves")
        # all rows of the components that the batch touches
        old = state.join(small_side(moves.where("NOT fresh").select(F.col("was").alias("component"), "to"), 24), "component")
        old = materialise(old.select("doc", "component", "n", "split", "status", "to"), "old")
        per_old = old.groupBy("to").agg(F.sum("n").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"), F.max(F.col("status") == "quarantined").alias("bad"))
        per_new = n_new.join(root, "doc").join(moves.select(F.col("was").alias("root"), "to"), "root").groupBy("to").agg(F.sum("n_new").alias("n_new"))
        per = moves.select("to").dropDuplicates().join(per_old, "to", "left").join(per_new, "to", "left")
        status = F.when(F.coalesce("bad", F.lit(False)) | (F.col("lo") != F.col("hi")), "quarantined").when(F.col("lo").isNotNull(), "kept").otherwise("new")
        per = materialise(per.select(F.col("to").alias("component"), (F.coalesce("n", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("size"), "lo", status.alias("now")), "per")
        # what each split holds: the table without the touched components, and those that keep theirs
        held = state.where("split IS NOT NULL").groupBy("split").agg(F.sum("n").alias("n")).unionByName(old.where("split IS NOT NULL").groupBy("split").agg((-F.sum("n")).alias("n")))
        held = held.unionByName(per.where("now = 'kept'").groupBy(F.col("lo").alias("split")).agg(F.sum("size").alias("n")))
        taken = {r.split: r.n for r in held.groupBy("split").agg(F.sum("n").alias("n")).collect()}
        fresh = assign_splits(per.where("now = 'new'").select("component", F.col("size").alias("n")), taken, ratios)
        final = per.join(fresh.withColumnRenamed("split", "given"), "component", "left")
        final = materialise(final.select("component", F.when(F.col("now") == "kept", F.col("lo")).when(F.col("now") == "new", F.col("given")).alias("split"), F.col("now").alias("status")), "final")
        was = old.select("doc", F.col("to").alias("component"), F.col("component").alias("c0"), "n", F.col("split").alias("s0"), F.col("status").alias("t0"))
        came = root.where("fresh").join(moves.select(F.col("was").alias("root"), F.col("to").alias("component")), "root").select("doc", "component", F.lit(None).cast("long").alias("c0"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("s0"), F.lit(None).cast("string").alias("t0"))
        rows = was.unionByName(came).join(n_new, "doc", "left").join(final, "component")
        same = F.col("c0").eqNullSafe(F.col("component")) & F.col("s0").eqNullSafe(F.col("split")) & F.col("t0").eqNullSafe(F.col("status")) & F.col("n_new").isNull()
        self._write(rows.where(~same).select("doc", "component", (F.col("n") + F.coalesce("n_new", F.lit(0))).alias("n"), "split", "status"))

    def _write(self, changed: DataFrame) -> None:
        m = self.manifest()
        changed = materialise(changed, "changed")
        buckets = m["buckets"] or max(8, -(-changed.count() // TABLE_ROWS))
        bucket = F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int").alias("bucket")
        touched = sorted(r.bucket for r in changed.select(bucket).distinct().collect())  # at most one row a bucket
        if not touched and m["buckets"]:
            return
        keep = self.read(touched).join(small_side(changed.select("doc"), 16), "doc", "left_anti")
        folder = f"v{m['version'] + 1}"
        keep.select("*", bucket).unionByName(changed.select("*", bucket).repartition("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        m = {"version": m["version"] + 1, "buckets": buckets, "at": m["at"] | {str(k): f"{folder}/bucket={k}" for k in touched}}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(m))


def split_questions(spark: SparkSession, qa: DataFrame, chunks: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """(qa_id, component, split, status) of every distinct question; questions that name no document are their own group."""
    first, state = _first_batch(qa, chunks, documents, path)
    alone = qa.select("qa_id").where("qa_id IS NOT NULL").dropDuplicates().join(first, "qa_id", "left_anti")
    own = assign_splits(alone.select(F.col("qa_id").alias("component"), F.lit(1).cast("long").alias("n")), {})
    return first.join(state.select("doc", "component", "split", "status"), "doc").select("qa_id", "component", "split", "status").unionByName(own.select(F.col("component").alias("qa_id"), F.lit(None).cast("long").alias("component"), "split", F.lit("new").alias("status")))
