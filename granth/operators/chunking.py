"""Token-budget chunks with overlap: the one operator that has to walk its pieces in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.functions import text as T
from granth.runtime import materialise

SCHEMA = "doc_id long, page int, chunk_index int, token_count int, text string"


def windows(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each chunk over piece sizes. The budget is soft: a piece joins the carried overlap unchecked, so a chunk may
    reach limit + overlap."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    out, start = [], 0
    for i in range(len(sizes)):
        if i > start and total[i + 1] - total[start] > limit:
            out.append((start, i))
            while total[i] - total[start] > overlap:
                start += 1
    if sizes:
        out.append((start, len(sizes)))
    return out


def pieces(sentences: list[str], limit: int, count: Callable[[str], int] | None = None) -> list[tuple[str, int]]:
    """Sentences with their token counts; a sentence over the limit is packed word by word (a longer word stays alone)."""
    out = []
    for s in sentences:
        words = s.split()
        n = len(words) if count is None else count(s)
        if n <= limit:
            out.append((s, n))
        elif count is None:
            out += [(" ".join(words[k:k + limit]), len(words[k:k + limit])) for k in range(0, len(words), limit)]
        else:
            bag, room = [], limit
            for w in words:
                size = count(w)
                if bag and size > room:
                    out.append((" ".join(bag), count(" ".join(bag))))
                    bag, room = [], limit
                bag.append(w)
                room -= size
            out.append((" ".join(bag), count(" ".join(bag))))
    return out


def chunk(pages: DataFrame, limit: int = 300, overlap: int = 50, count: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of (doc_id, page, text), never across pages; chunk_index runs over the document.

    Sentences are found inside the JVM; only the fold runs in Python, a page at a time and where the page is. Numbers come from the
    chunk counts of the pages before, so no task holds a document. count: token counter, by default blank-cut words. Null texts
    have no chunks; a page that is listed twice gives its chunks twice, under the same numbers.
    """
    if overlap >= limit:
        raise ValueError("overlap must be smaller than the chunk size")
    cut = pages.select("doc_id", "page", T.sentences(T.normalize("text")).alias("s")).where(F.size("s") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, s in pdf.itertuples(index=False):
                parts = pieces(list(s), limit, count)
                for k, (a, b) in enumerate(windows([n for _, n in parts], limit, overlap)):
                    rows.append((doc, page, k, sum(n for _, n in parts[a:b]), " ".join(t for t, _ in parts[a:b])))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "chunk_index", "token_count", "text"]).astype({"doc_id": "Int64", "page": "Int32"})

    local = materialise(cut.mapInPandas(run, SCHEMA), "chunked")
    per = local.groupBy("doc_id", "page").agg((F.max("chunk_index") + 1).alias("n"))
    first = per.select("doc_id", "page", (F.sum("n").over(W.partitionBy("doc_id").orderBy(F.asc_nulls_first("page"))) - F.col("n")).alias("first"))  # a number a page
    x, y = local.alias("x"), first.alias("y")
    both = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.col("x.page").eqNullSafe(F.col("y.page")))
    return both.select("x.doc_id", "x.page", (F.col("chunk_index") + F.col("first")).cast("int").alias("chunk_index"), "token_count", "text")


def dominant_language(chunks: DataFrame) -> DataFrame:
    """(doc_id, language) from the token-weighted labels of its chunks: hi from 0.8 Hindi or mixed, mixed from 0.2, else en."""
    hi = F.sum(F.when(F.col("language").isin("hi", "mixed"), F.col("token_count")).otherwise(0))
    share = hi / F.nullif(F.sum("token_count"), F.lit(0))
    return chunks.groupBy("doc_id").agg(F.when(share >= 0.8, "hi").when(share >= 0.2, "mixed").otherwise("en").alias("language"))


