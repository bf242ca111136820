"""Problem 9: sentence units of every document, in spaced and spaceless scripts.

A text is first cut into paragraphs: blank lines, headings, list items and lead-in lines are found, and wrapped lines are
told from one-statement-per-line texts by whether the next line's first word would still have fitted (wrapping is greedy).
Within a paragraph every terminator is a node of a lattice: it has a score from its mark, the word before and the word after; a unit
between two nodes has one from what it holds, and none may end inside a quotation or bracket. The best path gives the units.
In spaceless scripts the gaps without a mark are nodes too: words come from a dictionary lattice, and final particles and
opening words classify the gap (see spaceless).

A null or blank text gives no unit. Units never overlap, cover all non-blank characters, and are in text order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granth.llm.spaceless import COHESION, LETTERS, MIN_COUNT, MOST_WORDS, VARIETY, Spaceless
from granth.runtime import materialise

SCHEMA = "doc_id long, unit_no int, start_pos int, end_pos int"

# -- fixed values: abbreviations and word lists ------------------------------------------------------------------------
#: Never end a sentence: titles, and words that announce a number or a name.
BEFORE_NAME = {
    "dr", "mr", "mrs", "ms", "smt", "shri", "sri", "prof", "rs", "no", "nos", "sec", "annex", "para", "approx", "dept", "fig", "vol", "vs", "st", "e.g", "i.e", "cf", "ca",
    "डॉ", "डा", "प्रो", "कु", "रु", "क्र", "श्री", "सं", "नं", "पं", "ডা", "ড", "মো", "নং", "திரு", "எண்",
}
#: May end one: before a capital or another script they do.
SOFT = {"etc", "a.m", "p.m", "p.a", "inc", "ltd", "co", "jr", "sr", "ph.d"}
#: Spoken Latin initials in Devanagari; initials only after a title or another initial.
INITIALS_HI = {"ए", "बी", "सी", "डी", "ई", "एफ", "जी", "एच", "आई", "जे", "के", "एल", "एम", "एन", "ओ", "पी", "क्यू", "आर", "एस", "टी", "यू", "वी", "डब्ल्यू", "एक्स", "वाई", "जेड"}
TITLES_HI = {"डॉ", "डा", "प्रो", "कु", "श्री", "श्रीमती", "सुश्री", "पं"}
#: Japanese and Chinese: what may follow a closed quotation inside a sentence.
AFTER_QUOTE = set("とはがをにでのもへやかな，,、；;：:的地得说道称")

_LINE = re.compile(r"[^\n\r\f\v\x85  ]+")
_BREAK = re.compile(r"[\n\r\f\v\x85  ]")
_ITEM = re.compile(r"(?:\(?\d{1,3}[.)]|[०-९]{1,3}[.)]|[-*•‣◦▪–—])\s+\S")
_MARKS = ".!?।॥۔؟。！？…|｡"
_CLOSERS = "\"'”’)\\]」』»）】"
_TERM = re.compile(rf"[{_MARKS}]+[{_CLOSERS}]*")
_ENDED = re.compile(rf"[.!?।॥۔؟。！？…|｡][{_CLOSERS}]*$")
_FIRST = re.compile(r"\S*?\w[^\W\d_]-(?=\w+[^\W\d_])|[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]|\S[^\s\u3040-\u30ff\u3400-\u9fff]*")  # wrapping may break a compound at its hyphen
_WORD_BEFORE = re.compile(r"[^\s\"“‘(\[「『«]*$")
_GLUED = re.compile(r"^.*(?:[^\W\d_]{3,}|\d|[)%])[.!?]+(?=[^\W\d_])")
#: Longest line that counts as wrapped; longer lines without an end mark are statements of their own.
WRAP_LIMIT = 90
_QUOTES = re.compile(r"\"[^\"]*\"|“[^”]*”|「[^」]*」|『[^』]*』|«[^»]*»|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")
_LATIN_LOW = re.compile(r"[a-zà-öø-ÿ]")
_THAI = re.compile(r"[฀-๿]")
_NOT_BLANK = re.compile(r"\S")
_SPACELESS = re.compile(f"[{LETTERS}]")
#: The same for the JVM, which writes code points in its own way.
SPACELESS_JAVA = "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in LETTERS)
GENERAL = Spaceless()


# -- gaps of spaced scripts --------------------------------------------------------------------------------------------
def gap_score(text: str, lo: int, start: int, end: int, hi: int) -> float:
    """Score of ending a unit at end, after the terminator text[start:end] (closers included); positive means a break."""
    mark = text[start]
    after = _NOT_BLANK.search(text, end, hi)
    if after is None:
        return 9.0
    nxt = after.group()
    spaced = after.start() > end
    closed = text[end - 1] in "\"'”’)]」』»）】"
    if mark in "。！？｡":
        return -9.0 if closed and not spaced and nxt in AFTER_QUOTE or nxt in "，、；," else 5.0
    if mark in "।॥۔":
        return -5.0 if closed and nxt in ",;" else 5.0
    if mark == "|":
        return 5.0 if start > lo and not text[start - 1].isspace() and (spaced or not nxt.isascii()) or not nxt.isascii() else -5.0
    if nxt in ",;:，、":
        return -9.0
    if mark in "!?؟":
        return -3.0 if _LATIN_LOW.match(nxt) or not spaced and nxt.isascii() and not nxt.isupper() else 5.0
    # full stops and ellipses
    if not spaced:
        if end - start == 1 and start > lo and nxt not in _MARKS:
            p = text[start - 1]
            if nxt.isupper() and end + 1 < hi and (text[end + 1].islower() or text[end + 1].isspace() and p.islower()) and (p.islower() or p.isdigit() or p in "%)"):
                w = _WORD_BEFORE.search(text, max(lo, start - 24), start).group().lower()
                return -5.0 if w in BEFORE_NAME or len(w) < 2 else 3.0
            if not nxt.isascii() and nxt.isalpha() and not _THAI.match(nxt) and not _THAI.match(p) and not p.isdigit():
                w = _WORD_BEFORE.search(text, max(lo, start - 24), start).group()
                return -5.0 if w in BEFORE_NAME or w.split(".")[-1] in INITIALS_HI or w in TITLES_HI else 3.0
        return 3.0 if closed and nxt.isupper() else -9.0
    if end - start > 1 and text[start:start + 2] == "..":
        return -4.0 if _LATIN_LOW.match(nxt) else 2.0
    if _LATIN_LOW.match(nxt):
        return -5.0
    word = _GLUED.sub("", _WORD_BEFORE.search(text, max(lo, start - 40), start).group())
    low = word.lower()
    if low in BEFORE_NAME:
        return -9.0
    if low in SOFT:
        return 3.0
    if len(word) == 1 and word.isupper() and word.isascii():
        return -6.0
    if word in INITIALS_HI:
        before = text[max(lo, start - len(word) - 24): start - len(word)].split()
        prev = before[-1].rstrip(".") if before else ""
        if prev in TITLES_HI or prev in INITIALS_HI and before[-1].endswith("."):
            return -6.0
    if low.isdigit() and (start - len(word) <= lo) and len(word) <= 3:
        return -6.0  # the number of a list item
    return 4.0


#: A unit without a letter or digit is worth less by this; only units up to so many characters can be one.
EMPTY, SHORT = 8.0, 8


def _units(text: str, lo: int, hi: int, model: Spaceless = GENERAL) -> Iterator[tuple[int, int]]:
    """Units of one paragraph text[lo:hi], which starts and ends with non-blank characters: the best path through its gaps."""
    gaps = [(m.end(), gap_score(text, lo, m.start(), m.end(), hi)) for m in _TERM.finditer(text, lo, hi)]
    if _SPACELESS.search(text, lo, hi):
        gaps += model.gaps(text, lo, hi)
        gaps.sort()
    # a gap that scores nothing by itself is on no best path, as what a unit holds can only count against it
    gaps = [g for g in gaps if lo < g[0] < hi and g[1] > 0]
    if gaps:
        # no unit may end strictly inside a quotation or bracket that closes within the paragraph
        closed = [m.span() for m in _QUOTES.finditer(text, lo, hi)]
        k, nodes = 0, []
        for at, score in gaps:
            while k < len(closed) and closed[k][1] <= at - 1:
                k += 1
            if not (k < len(closed) and closed[k][0] < at < closed[k][1]):
                nodes.append((at, score))
        for at in best_path(text, lo, nodes, hi):
            yield lo, at
            lo = _NOT_BLANK.search(text, at, hi).start()
    yield lo, hi


def best_path(text: str, lo: int, nodes: list[tuple[int, float]], hi: int) -> list[int]:
    """Positions of the nodes (position, score) on the path from lo to hi that is worth most.

    A path is worth its nodes' scores less EMPTY for each unit without a letter or digit. Only units of at most SHORT characters are
    looked at, so each node needs the best of all nodes further back and the few that are near.
    """
    ends = [lo, *[at for at, _ in nodes], hi]
    worth, back = [0.0], [0]
    far, far_best = 0, -1  # nodes up to far are further back than SHORT; far_best is the best of them
    for j in range(1, len(ends)):
        while far < j and ends[j] - ends[far] > SHORT:
            if far_best < 0 or worth[far] >= worth[far_best]:
                far_best = far
            far += 1
        score, frm = (worth[far_best], far_best) if far_best >= 0 else (-1e18, 0)
        for i in range(far, j):
            w = worth[i] - (0.0 if any(c.isalnum() for c in text[ends[i]:ends[j]]) else EMPTY)
            if w >= score:
                score, frm = w, i
        worth.append(score + (nodes[j - 1][1] if j <= len(nodes) else 0.0))
        back.append(frm)
    out, j = [], back[-1]
    while j:
        out.append(ends[j])
        j = back[j]
    return out[::-1]


def _lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end, block) of every non-blank line, blanks trimmed."""
    out, block, last = [], 0, 0
    for m in _LINE.finditer(text):
        s = m.group()
        t = s.strip()
        if not t:
            continue
        a = m.start() + len(s) - len(s.lstrip())
        if out and len(_BREAK.findall(text[last:a].replace("\r\n", "\n"))) > 1:
            block += 1
        out.append((a, a + len(t), block))
        last = a + len(t)
    return out


#: A wrapped paragraph mostly ends in a short line; statements are about as long as each other.
STATEMENT = 45


def _even(size: list[int], item: list[bool], head: list[bool]) -> bool:
    return all(z >= STATEMENT for z, it, h in zip(size, item, head) if not it and not h)


def _inner_gap(text: str, a: int, b: int, model: Spaceless) -> bool:
    return next(_units(text, a, b, model), (a, b)) != (a, b)


def sentence_units(text: str, model: Spaceless = GENERAL) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text, in code points; model: what is known of spaceless scripts."""
    lines = _lines(text)
    n = len(lines)
    if not n:
        return []
    size = [b - a for a, b, _ in lines]
    ended = [_ENDED.search(text, max(a, b - 8), b) is not None for a, b, _ in lines]
    item = [_ITEM.match(text, a, b) is not None for a, b, _ in lines]
    head = [text[a] == "#" for a, _, _ in lines]
    lead = [text[b - 1] in ":：" for _, b, _ in lines]
    fits = [False] * n
    open_ = fitting = small = 0
    for i in range(n - 1):
        if lines[i][2] != lines[i + 1][2]:
            continue
        wide = size[i]
        for j in (i + 1, i + 2):
            if j < n and lines[j][2] == lines[i][2] and not item[j]:
                wide = max(wide, size[j])
        first = _FIRST.match(text, lines[i + 1][0], lines[i + 1][1]).group()
        fits[i] = size[i] + 1 + len(first) <= wide or size[i] > WRAP_LIMIT
        if not (ended[i] or item[i + 1] or head[i] or lead[i] or item[i]):
            open_ += 1
            fitting += fits[i]
            small += _LATIN_LOW.match(first) is not None
    # lines are statements if many leave room for the next word, or if none holds the start of a second sentence and
    # they are about even
    by_line = fitting >= 2 and fitting >= 0.25 * open_ or open_ > 0 and not small and (fitting or _even(size, item, head)) and not any(_inner_gap(text, a, b, model) for (a, b, _), it in zip(lines, item) if not it)
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        j = i
        while j + 1 < n and lines[j + 1][2] == lines[j][2]:
            if item[j + 1] or head[j + 1] or head[j] or lead[j] or by_line:
                break
            if ended[j]:
                if item[i]:
                    break
                # an abbreviation at the line's end does not close the paragraph; other marks may, the gaps decide
                if fits[j]:
                    m = None
                    for m in _TERM.finditer(text, max(lines[j][0], lines[j][1] - 8), lines[j][1]):
                        pass
                    if m is None or gap_score(text, lines[j][0], m.start(), lines[j][1], lines[j + 1][1]) > 0:
                        break
            elif fits[j]:
                nxt = text[lines[j + 1][0]]
                if not _LATIN_LOW.match(nxt):
                    break
            j += 1
        lo, hi = lines[i][0], lines[j][1]
        if item[i] or head[i]:
            out.append((lo, hi))
        else:
            out.extend(_units(text, lo, hi, model))
        i = j + 1
    return out


#: Distinct entries that a task counts before it hands them on.
COUNTED = 100_000


def _counted(add) -> Callable:
    """mapInArrow function that counts what add(text, counter) counts of each text; counters are emptied at COUNTED entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                add(text, seen)
                if len(seen) > COUNTED:
                    yield frame(seen)
                    seen.clear()
        yield frame(seen)

    def frame(seen: Counter) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in seen], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], ["key", "before", "after", "n"])

    return run


def _add_grams(text: str, seen: Counter) -> None:
    seen.update(Spaceless.grams(text))


def fit_spaceless(documents: DataFrame, samples: DataFrame | None = None) -> Spaceless:
    """Model from single sentences (samples: text, of a fixed number) and all distinct texts with spaceless scripts.

    The same counts as Spaceless.fit(): grams, and the words inside marked sentences, are counted by the executors; the driver gets
    the dictionary and the counts of words and pairs of words.
    """
    spark = documents.sparkSession
    texts = materialise(documents.where(F.col("text").rlike(f"[{SPACELESS_JAVA}]")).select("text").dropDuplicates(), "spaceless")
    known = [] if samples is None else sorted({r.text for r in samples.where("text IS NOT NULL").select("text").collect()})
    both = texts.unionByName(spark.createDataFrame([(s,) for s in Spaceless.single(known)], "text string"))
    schema, free = "key string, before string, after string, n long", lambda c: F.size(c) + F.when(F.arrays_overlap(c, F.array(F.lit("\x02"), F.lit("\x03"))), 2).otherwise(0)
    grams = both.mapInArrow(_counted(_add_grams), schema).groupBy("key").agg(F.sum("n").alias("n"), F.collect_set("before").alias("b"), F.collect_set("after").alias("a"))
    size = F.length("key")
    grams = materialise(grams.where((F.col("n") >= MIN_COUNT) | (size == 1)).select("key", "n", F.least(free("b"), free("a")).alias("free")), "grams")
    total = grams.where(size == 1).agg(F.sum("n")).first()[0] or 1
    cut = grams.where((size > 1) & (F.col("free") >= VARIETY)).select("key", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("key", "n", F.expr("substring(key, 1, k)").alias("x"), F.expr("substring(key, k + 1)").alias("y"))
    part = lambda name: grams.select(F.col("key").alias(name), F.col("n").alias(f"n{name}"))
    firm = cut.join(part("x"), "x").join(part("y"), "y").groupBy("key", "n").agg(F.min(F.log(F.col("n") * float(total) / (F.col("nx") * F.col("ny")))).alias("cohesion"))
    words = firm.where(F.col("cohesion") >= COHESION).orderBy(F.desc(F.col("n") * size), "key").limit(MOST_WORDS).select("key", "n").collect()
    model = Spaceless()
    model.cost.update((r.key, log(total / r.n)) for r in words)
    model.longest = max(map(len, model.cost))

    def add_inner(text: str, seen: Counter) -> None:
        model.inner.clear()
        model.count_marked(text)
        for key, n in model.inner.items():
            seen[key, "", ""] += n

    inner = texts.mapInArrow(_counted(add_inner), schema).groupBy("key").agg(F.sum("n").alias("n")).collect()
    model.inner = Counter({r.key: r.n for r in inner})
    return model.train(known)


def sentences(documents: DataFrame, model: Spaceless = GENERAL) -> DataFrame:
    """Units of (doc_id, text). One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, nos, starts, ends = [], [], [], []
            for doc, text in pdf.itertuples(index=False):
                for k, (a, b) in enumerate(sentence_units(text, model)):
                    ids.append(doc)
                    nos.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "unit_no": pd.array(nos, dtype="Int32"), "start_pos": pd.array(starts, dtype="Int32"), "end_pos": pd.array(ends, dtype="Int32")})

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, SCHEMA)
