"""Problem 3: near-duplicate texts by Golay-code fuzzy hashing.

Every text gets a fingerprint of one-bit minhashes over its runs of three words, in segments of 23 bits. A segment is
decoded with the perfect (23,12) Golay code together with its 23 one-bit neighbours; the 1 or 6 codeword indices found are its
keys, so that two segments with at most two different bits always share one (and most with three or four do). By the pigeonhole
principle, texts whose fingerprints differ in few bits have such a segment. Each segment's keys are joined with one anchor
minhash and hashed to 64 bits, which keeps buckets small in collections of any size: two texts meet if, in any of SEGMENTS
segments, the anchors agree and the codes touch.
Pairs that meet are screened by the distance of their fingerprints inside the join, made distinct, and verified exactly.

Equal texts collapse to one representative before anything is paired, so a hot group of copies costs one row. Nulls and texts
below min_words have no pairs. Repeated ids count once. No bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granth.runtime import BLANK, materialise, small_side

WIDTH = 3
THRESHOLD = 0.60
MIN_WORDS = 30
SEGMENTS = 12
#: Screens: fingerprint bits that may differ, of the 128 that travel with the keys and of all 256. At a similarity of 0.60,
#: 25.6 and 51.2 differ on average, with deviations of 4.5 and 6.4.
MAX_BITS = 40
MAX_BITS_ALL = 72
SEED = 29
#: Copies of one text whose pairs are listed by one task.
GROUP_SHARE = 1000

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GENERATOR = 0b101011100011


class Golay:
    """Decoder of the perfect (23,12) code by syndrome table: every word is within three bits of one codeword."""

    def __init__(self) -> None:
        self.bit = np.array([self._syndrome(1 << i) for i in range(23)], np.int32)
        self.error = np.zeros(2048, np.int32)
        for weight in range(4):
            for at in combinations(range(23), weight):
                e = sum(1 << i for i in at)
                self.error[self._syndrome(e)] = e
        low, high = np.arange(1 << 12), np.arange(1 << 11)
        self.low, self.high = self._table(low, 0), self._table(high, 12)

    @staticmethod
    def _syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    def _table(self, v: np.ndarray, shift: int) -> np.ndarray:
        s = np.zeros(len(v), np.int32)
        for i in range(int(len(v)).bit_length() - 1):
            s ^= np.where(v >> i & 1, self.bit[i + shift], 0).astype(np.int32)
        return s

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each 23-bit word."""
        s = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[s]) >> 11

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 24) sorted indices of each word and its one-bit neighbours; repeats are set to -1, leaving 1 or 6."""
        near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23, dtype=np.int32))[None, :]], axis=1)
        k = np.sort(self.index(near), axis=1)
        k[:, 1:][k[:, 1:] == k[:, :-1]] = -1
        return k


class Sketcher:
    """Keys and fingerprints of texts."""

    def __init__(self, width: int = WIDTH, segments: int = SEGMENTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = segments * 23 + segments
        self.mul = rng.integers(1, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        self.mix = rng.integers(1, 2**63, width, dtype=np.uint64) | np.uint64(1)
        self.width, self.segments, self.golay = width, segments, Golay()
        self.words: dict[str, int] = {}

    def _word(self, w: str) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) > 500_000:
                self.words.clear()
            h = self.words[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def runs(self, words: list[str]) -> np.ndarray:
        h = np.fromiter((self._word(w) for w in words), np.uint64, len(words))
        n = len(words) - self.width + 1
        s = np.zeros(n, np.uint64)
        for k in range(self.width):
            s += h[k:k + n] * self.mix[k]
        s ^= s >> np.uint64(31)
        return (s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)

    def sketch(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(four words of fingerprint, keys of each text) for texts of at least width words."""
        sets = [self.runs(w) for w in texts]
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        mins = np.empty((len(self.mul), len(sets)), np.uint32)
        buf = np.empty_like(flat)
        for i in range(len(self.mul)):
            np.multiply(flat, self.mul[i], out=buf)
            buf += self.add[i]
            buf ^= buf >> np.uint32(15)
            mins[i] = np.minimum.reduceat(buf, starts)
        nb = self.segments * 23
        bits = (mins[:nb] * np.uint32(0x85EBCA6B) >> np.uint32(17)) & np.uint32(1)
        prints = [np.zeros(len(sets), np.uint64) for _ in range(4)]
        for i in range(256):
            prints[i // 64] |= bits[i % nb].astype(np.uint64) << np.uint64(i % 64)
        out = []
        for s in range(self.segments):
            word = np.zeros(len(sets), np.int32)
            for i in range(23):
                word |= bits[s * 23 + i].astype(np.int32) << i
            codes = self.golay.keys(word)
            anchor = mins[nb + s].astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(s)
            k = (anchor + codes.astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            k = (k ^ k >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((k ^ k >> np.uint64(32)).astype(np.int64), codes >= 0))
        keys = [np.concatenate([k[t][ok[t]] for k, ok in out]) for t in range(len(sets))]
        return [f.astype(np.int64) for f in prints], keys


def sketches(items: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, segments: int = SEGMENTS) -> DataFrame:
    """(id, digest, f1 to f4, keys) of every (id, text) with enough words. One pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Sketcher(width, segments)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                ids, words, digests = [], [], []
                for i, t in pdf.iloc[lo:lo + 512].itertuples(index=False):
                    w = t.lower().split()
                    if len(w) >= max(min_words, width):
                        ids.append(i)
                        words.append(w)
                        digests.append(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                if ids:
                    f, keys = maker.sketch(words)
                    yield pd.DataFrame({"id": ids, "digest": digests, "f1": f[0], "f2": f[1], "f3": f[2], "f4": f[3], "keys": keys})

    return items.select("id", "text").where((F.length("text") >= 2 * min_words - 1) & F.col("id").isNotNull()).mapInPandas(run, "id long, digest string, f1 long, f2 long, f3 long, f4 long, keys array<long>")


def run_sets(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, s): the distinct runs of width words of each text, as 64-bit hashes, made inside the JVM."""
    words = F.filter(F.split(F.lower("text"), f"[{BLANK}]+"), lambda w: w != "")
    run = lambda i: F.xxhash64(*[F.get("w", i.cast("int") + k) for k in range(width)])
    return items.select("id", words.alias("w")).select("id", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - width), run)).alias("s"))


def similar(items: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, width: int = WIDTH, segments: int = SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) between representatives, a < b, and members (id, rep) of every text with enough words."""
    sk = materialise(sketches(items, min_words, width, segments), "sketch")
    first = sk.groupBy("digest").agg(F.min("id").alias("rep"))
    members = materialise(sk.select("id", "digest").dropDuplicates().join(first, "digest").select("id", "rep"), "members")
    copies = members.where("id <> rep").select("id")
    one = materialise(sk.join(small_side(copies, 16), "id", "left_anti"), "reps")
    keyed = one.select("id", "f1", "f2", F.explode("keys").alias("key"))  # a bare scan on both sides of the join lets Spark reuse its exchange
    x, y = keyed.alias("x"), keyed.alias("y")
    bits = lambda *pairs: sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in pairs[1:]), F.bit_count(F.col(pairs[0][0]).bitwiseXOR(F.col(pairs[0][1]))))
    near = bits(("x.f1", "y.f1"), ("x.f2", "y.f2")) <= MAX_BITS
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).dropDuplicates()
    full = one.select("id", "f1", "f2", "f3", "f4")
    for side in "ab":
        met = met.join(full.select(F.col("id").alias(side), *[F.col(f"f{k}").alias(f"{side}{k}") for k in range(1, 5)]), side)
    met = met.where(bits(*[(f"a{k}", f"b{k}") for k in range(1, 5)]) <= MAX_BITS_ALL).select("a", "b")
    met = materialise(met, "met")
    ids = materialise(met.select(F.explode(F.array("a", "b")).alias("id")).dropDuplicates(), "ids")
    sets = run_sets(items.select("id", "text").join(small_side(ids, 16), "id", "left_semi"), width)
    sets = materialise(sets, "sets")
    both = met.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    pairs = both.select("a", "b", common.alias("n"), (F.size("sa") + F.size("sb")).alias("m")).select("a", "b", (F.col("n") / (F.col("m") - F.col("n"))).alias("similarity")).where(F.col("similarity") >= threshold).dropDuplicates(["a", "b"])
    return pairs, members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b) of all texts: pairs of representatives carried to their copies, and pairs of copies."""
    m = members.select("id", "rep")
    across = pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b").select("ia", "ib")
    # a large group is dealt to several tasks: its texts by hash on one side, all of them in every share on the other
    twins = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep", F.ceil(F.col("n") / F.lit(GROUP_SHARE)).cast("int").alias("shares"))
    some = m.join(twins, "rep")
    left = some.select("rep", F.col("id").alias("ia"), F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"))
    right = some.select("rep", F.col("id").alias("ib"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    within = left.join(right, ["rep", "share"]).where("ia < ib").select("ia", "ib")
    return across.unionByName(within).select(F.least("ia", "ib").alias("chunk_a"), F.greatest("ia", "ib").alias("chunk_b"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(chunk_id, class_id, rep, links): one row per text; links counts similar representatives, class_id is the smallest id reachable."""
    from granth.llm.linked_splits import components

    pairs = materialise(pairs, "pairs")
    comp = components(pairs.select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(comp.select(F.col("doc").alias("rep"), "root"), "rep", "left").join(links, "rep", "left")
    return out.select(F.col("id").alias("chunk_id"), F.coalesce("root", "rep").alias("class_id"), "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
