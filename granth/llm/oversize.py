"""Problem 2: cutting oversized texts into overlapping pieces at lexical-cohesion valleys.

Candidate gaps are natural boundaries (page, paragraph, line and sentence ends). At each gap the word counts of the
blocks on both sides are compared; the depth of the similarity valley, plus a bonus for stronger boundaries, ranks the
gaps. Every piece takes the deepest valley in its size window, or the deepest before it if the window holds no gap; without
any boundary it is cut at the word limit.

Sizes are words (maximal runs of non-blank characters), whatever token_count says. A null or empty text has no words and
is never oversized. The page of a piece is the chunk's page plus the form feeds before its first word; null stays null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granth.runtime import BLANK

SCHEMA = "chunk_id long, doc_id long, piece_no int, n_pieces int, start_word int, end_word int, overlap_words int, page int, cut string, text string"
BLOCK = 30  # words on each side of a gap
#: Earliest cut, as a share of the room that a piece has for new words.
MIN_FILL = 0.5
#: Added to the depth of a gap for its kind (fixed values).
BONUS = {"page": 0.5, "paragraph": 0.4, "line": 0.1, "sentence": 0.1}

_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?।॥۔؟。！？|…][\"'”’)\]」』]*$")
_NORM = re.compile(r"[\W\d_]+")


def n_words(column: str = "text"):
    """Words of a text, counted inside the JVM; null for null."""
    return F.regexp_count(column, F.lit(f"[^{BLANK}]+"))


def _gaps(text: str, spans: list[tuple[int, int]]) -> dict[int, str]:
    """Word index that a new piece could start at, and the kind of boundary before it."""
    out = {}
    for i in range(1, len(spans)):
        a, b = spans[i - 1][1], spans[i][0]
        between = text[a:b]
        if "\f" in between:
            out[i] = "page"
        elif between.count("\n") > 1:
            out[i] = "paragraph"
        else:
            ended = _END.search(text, spans[i - 1][0], a) is not None
            if ended:
                out[i] = "sentence"
            elif "\n" in between:
                out[i] = "line"
    return out


def _similarity(words: list[str], at: int, block: int) -> float:
    left, right = Counter(words[max(0, at - block):at]), Counter(words[at:at + block])
    dot = sum(n * right[w] for w, n in left.items() if w in right)
    return dot / (sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values())) or 1.0)


def _depths(words: list[str], gaps: list[int], block: int) -> list[float]:
    """Valley depth of each gap: how far similarity climbs to the nearest peak on either side."""
    s = [_similarity(words, g, block) for g in gaps]
    left, right = list(s), list(s)  # similarity at the peak that is reached by climbing from each gap
    for k in range(1, len(s)):
        if s[k - 1] >= s[k]:
            left[k] = left[k - 1]
    for k in range(len(s) - 2, -1, -1):
        if s[k + 1] >= s[k]:
            right[k] = right[k + 1]
    return [a - v + b - v for a, b, v in zip(left, right, s)]


def cut_points(text: str, limit: int, overlap: int, block: int = BLOCK) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) in words, of each piece; start includes the overlap with the piece before."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, n, "end")] if n else []
    kinds = _gaps(text, spans)
    words = [_NORM.sub("", text[a:b]).lower() for a, b in spans]
    gaps = sorted(kinds)
    depth = {g: d + BONUS[kinds[g]] for g, d in zip(gaps, _depths(words, gaps, block))}
    overlap = max(0, min(overlap, limit - 1))
    out, start, first = [], 0, 0
    pos = 0
    while n - start > limit:
        room = start + limit
        least = first + max(1, int((room - first) * MIN_FILL))
        while pos < len(gaps) and gaps[pos] < least:
            pos += 1
        k, best = pos, None
        while k < len(gaps) and gaps[k] <= room:
            if best is None or depth[gaps[k]] >= depth[best]:
                best = gaps[k]
            k += 1
        if best is None:  # a short piece rather than a cut inside a sentence; the next one must start later than this one
            k = pos - 1
            while k >= 0 and gaps[k] > max(first, start + overlap):
                if best is None or depth[gaps[k]] > depth[best]:
                    best = gaps[k]
                k -= 1
        end, kind = (best, kinds[best]) if best is not None else (room, "limit")
        out.append((start, end, kind))
        first, start = end, max(start + 1, end - overlap)
    out.append((start, n, "end"))
    return out


def split_oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of every chunk whose text has more than limit words, in order. No shuffle; one pass over the text."""
    big = chunks.select("id", "doc_id", "page", "text").where((F.length("text") > 2 * limit) & (n_words() > limit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, did, page, text in pdf.itertuples(index=False):
                spans = [m.span() for m in _WORD.finditer(text)]
                cuts = cut_points(text, limit, overlap)
                last = feeds = seen = 0
                for k, (a, b, kind) in enumerate(cuts):
                    at = spans[a][0]
                    feeds, seen = feeds + text.count("\f", seen, at), at
                    here = None if pd.isna(page) else int(page) + feeds
                    rows.append((cid, did, k, len(cuts), a, b, max(0, last - a), here, kind, text[at:spans[b - 1][1]]))
                    last = b
            out = pd.DataFrame(rows, columns=["chunk_id", "doc_id", "piece_no", "n_pieces", "start_word", "end_word", "overlap_words", "page", "cut", "text"])
            out = out.astype({"chunk_id": "Int64", "doc_id": "Int64", "page": "Int32"})
            yield out

    return big.mapInPandas(run, SCHEMA)
