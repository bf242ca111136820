"""Problem 1: noise in text from scanned pages: words cut at line ends, misread characters, running headers, page numbers.

Lines are judged in pairs with their neighbours: a boosted classifier of furniture, trained on lines that repeat within their
document against lines of flowing text (a bounded sample of whole documents), finds headers, and a second one tells words that
were cut at a line end from compounds broken at their own hyphen. It is trained on words of the front matters that were cut on
purpose and on their compounds, and looks at how often both readings and both halves stand there. Page numbers must follow
the document's own numbering. Every other word that the front matters do not know, also with the outer signs that may be its
own misread letters, looks up correction candidates in an inverted index of character q-grams; a boosted ranker, trained on
words that were corrupted on purpose, accepts or rejects the best one.

The lexicon counts words over all documents and is only ever joined, whatever its size; every distinct unknown word of all chunks
is looked up once. Nulls and empty texts have no noise. A chunk's own repeated words count once. Pages that are null borrow the
page of the chunk's neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.llm.boosting import Boosted
from granth.runtime import BLANK, materialise, small_side

# -- fixed values: what a scanner confuses ------------------------------------------------------------------------------
#: Right character to the look-alikes it is read as.
LOOK_ALIKES = {
    "a": ("o", "@"), "b": ("h", "6"), "c": ("e", "("), "d": ("cl",), "e": ("c",), "f": ("t",), "g": ("9", "q"), "h": ("b", "li"), "i": ("!", "1", "l", "j"), "l": ("1", "!", "i", "|"),
    "m": ("rn", "nn"), "n": ("ri", "u"), "o": ("0",), "q": ("9",), "s": ("5", "$"), "t": ("+", "f"), "u": ("ii", "v"), "v": ("u",), "w": ("vv",), "y": ("v",), "z": ("2",), "rn": ("m",), "cl": ("d",),
    "क": ("फ",), "ख": ("रव",), "घ": ("ध",), "थ": ("य",), "ध": ("घ",), "ब": ("व",), "भ": ("म",), "ष": ("प",), "ड": ("ङ",), "व": ("ब",), "ढ": ("द",), "झ": ("भ",), "फ": ("क",), "म": ("भ",), "य": ("थ",), "प": ("ष",),
}
#: Pairs that also differ between real words too often to count on their own.
WEAK_PAIRS = {("a", "o"), ("n", "u"), ("u", "v"), ("v", "u"), ("y", "v"), ("f", "t"), ("t", "f"), ("i", "l"), ("l", "i"), ("i", "j"), ("n", "ri"), ("c", "e"), ("h", "li"), ("b", "h"), ("m", "nn"), ("व", "ब"), ("ब", "व"), ("ढ", "द"), ("फ", "क"), ("म", "भ"), ("य", "थ"), ("प", "ष"), ("rn", "m"), ("cl", "d"), ("झ", "भ"), ("ध", "घ"), ("g", "q")}
HYPHENS = "\\-‐\xad¬"  # as the body of a character class
PUNCTUATION = ".,;:?()\"'…।॥|“”‘’[]{}<>~!*•·#%&=+_^`"
#: Look-alikes that also stand around words, and how many of them on each side may belong to the word.
EDGE_SIGNS = "".join(sorted({a for alts in LOOK_ALIKES.values() for a in alts} & set(PUNCTUATION)))
EDGE_DEPTH = 2
DIGITS = {chr(0x966 + k): str(k) for k in range(10)} | {chr(0x9E6 + k): str(k) for k in range(10)} | {chr(0x660 + k): str(k) for k in range(10)} | {chr(0x6F0 + k): str(k) for k in range(10)} | {chr(0xBE6 + k): str(k) for k in range(10)}

Q = 3
#: Bounds of the training samples (documents, lines, words).
TRAIN_DOCS = 400
TRAIN_CHUNKS = 3000
TRAIN_WORDS = 1500
#: So many of the lexicon's most frequent words go with the scan, which need not pass them on; the join drops all known words anyway.
COMMON_WORDS = 8192
#: Candidates must share this part of the q-grams of the longer word, whose number may differ by this much.
MIN_GRAMS = 0.2
BAND = 3
FURNITURE, MAYBE, MISREAD, CUT_WORD = 0.5, 0.12, 0.5, 0.5
WRAPPED = 110

_SPLIT = re.compile(r"[\s\-‐–—/]+")
_ENDED = re.compile(r"[.!?।॥۔؟…:;,|][\"'”’)\]]*$|[\"”)]$")
_ITEM = re.compile(r"(?:\(?[0-9]{1,3}[.)]|[-*•‣▪])\s|[0-9]{1,3} \|")
_NUM = r"(?:[0-9०-९০-৯٠-٩۰-۹௦-௯]{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_PAGE = re.compile(rf"^(?:[-–—~]\s?({_NUM})\s?[-–—~]|\[({_NUM})\]|\(({_NUM})\)|(?:p|pp|pg|page|पृष्ठ|पान|पृ|पन्ना|صفحہ|পৃষ্ঠা|பக்கம்)\.?\s?({_NUM})(?:\s?(?:/|of|में से|का)\s?{_NUM})?|({_NUM}))$", re.IGNORECASE)
_CUT = re.compile(rf"([^\s{HYPHENS}/]+)[{HYPHENS}] *$")
_LETTER = re.compile(r"[^\W\d_]")


def tokens(text: str) -> list[str]:
    """Words in lower case, without outer punctuation, of at least two characters and one letter."""
    return [w for w in (x.strip(PUNCTUATION) for x in _SPLIT.split(text.lower())) if len(w) > 1 and _LETTER.search(w)]


def edge_forms(raw: str) -> list[tuple[str, str]]:
    """(word, form) for each form of a written word that keeps outer signs which may be its own misread letters, fewest first."""
    word = raw.strip(PUNCTUATION)
    if len(word) == len(raw) or not _LETTER.search(word):
        return []
    start = len(raw) - len(raw.lstrip(PUNCTUATION))
    end = start + len(word)
    a, b = start, end
    while a and start - a < EDGE_DEPTH and raw[a - 1] in EDGE_SIGNS:
        a -= 1
    while b < len(raw) and b - end < EDGE_DEPTH and raw[b] in EDGE_SIGNS:
        b += 1
    if len(word) == 1 and a < start and ")" in raw[end:]:  # an item's letter in brackets
        a = start
    cut = sorted((end - start + i + j, i, j) for i in range(start - a + 1) for j in range(b - end + 1) if i + j)
    return [(word, raw[start - i:end + j]) for _, i, j in cut]


def edge_words(text: str, common: frozenset[str] = frozenset()) -> set[str]:
    """Forms of the words with the outer signs that may be misread letters; those whose word is known are left out here or later."""
    if not any(c in text for c in EDGE_SIGNS):
        return set()
    return {f for x in _SPLIT.split(text.lower()) for w, f in edge_forms(x) if w not in common}


def roman(s: str) -> int | None:
    value, last = 0, 0
    for c in reversed(s.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        value += -v if v < last else v
        last = max(last, v)
    return value


def page_number(segment: str) -> tuple[int, str] | None:
    """(number, style) of a segment that prints nothing but a page number."""
    m = _PAGE.match(segment)
    if not m:
        return None
    raw = next(g for g in m.groups() if g)
    bare = m.group(5) is not None
    plain = "".join(DIGITS.get(c, c) for c in raw)
    if plain.isdigit():
        return int(plain), "bare" if bare else "styled"
    if not (raw.islower() or raw.isupper()):
        return None
    return roman(raw), "roman" if bare else "styled"


def skeleton(line: str) -> str:
    """A line with everything that a scanner confuses folded together, to recognise a header despite misreads."""
    s = line.lower()
    for right, wrongs in (("m", ("rn", "nn")), ("w", ("vv",)), ("d", ("cl",)), ("u", ("ii",)), ("o", ("0",)), ("l", ("1", "!", "|", "i")), ("s", ("5",)), ("g", ("9",)), ("e", ("c",)), ("h", ("b",)), ("फ", ("क",)), ("य", ("थ",)), ("म", ("भ",)), ("प", ("ष",)), ("ङ", ("ड",))):
        for w in wrongs:
            s = s.replace(w, right)
    s = re.sub(r"([ऀ-ःऺ-ॏ])\1+", r"\1", s)
    s = s.replace("ि", "")  # the short i moves around its consonant
    return re.sub(r"\s+", " ", s).strip()


class Segment:
    __slots__ = ("text", "line", "piece", "start", "page")

    def __init__(self, text: str, line: int, piece: int, start: int):
        self.text, self.line, self.piece, self.start = text, line, piece, start
        self.page = page_number(text)


def segments(text: str) -> list[Segment]:
    """Non-blank lines, and the parts of a line that stand apart by three or more blanks."""
    out = []
    for no, m in enumerate(re.finditer(r"[^\n\f\r]+", text)):
        parts = [p for p in re.finditer(r"\S+(?:[ \t\xa0]{1,2}\S+)*", m.group())]
        for k, p in enumerate(parts):
            out.append(Segment(p.group(), no, k if len(parts) > 1 else -1, m.start() + p.start()))
    return out


def line_features(segs: list[Segment], prior: dict[str, float], which: list[int]) -> np.ndarray:
    """Features of some segments, none a page number, from the line, the line before and the line after."""
    wide = max((len(s.text) for s in segs if s.page is None), default=0)
    rows = np.zeros((len(which), 20))
    n = len(segs)
    for k, i in enumerate(which):
        s = segs[i]
        p = next((segs[j] for j in range(i - 1, max(-1, i - 3), -1) if segs[j].page is None and segs[j].line != s.line), None)
        q = next((segs[j] for j in range(i + 1, min(n, i + 3)) if segs[j].page is None and segs[j].line != s.line), None)
        t = s.text
        words = t.split()
        first = words[0] if words else ""
        caps = sum(w[0].isupper() for w in words if w[0].isascii()) / len(words)
        scores = [prior.get(w, 0.0) for w in tokens(skeleton(t))]
        rows[k] = (
            _ENDED.search(t) is None,
            p is None, p is not None and _ENDED.search(p.text) is None,
            q is None, q is not None and len(t) + 1 + len(q.text.split()[0]) <= wide,
            q is not None and q.text[0].islower(), t[0].islower(),
            len(t) / max(wide, 1), caps, t.isupper(),
            p is not None and len(p.text) + 1 + len(first) <= wide,
            sum(c.isdigit() for c in t) / len(t),
            s.piece >= 0, _ITEM.match(t) is not None,
            len(words), wide <= WRAPPED,
            float(np.mean(scores)) if scores else 0.0, max(scores, default=0.0),
            sum(w.isupper() and len(w) > 1 and w.isalpha() for w in words) / len(words), t[0] in "\"“'(",
        )
    return rows


class Furniture:
    """Classifier of running headers: a boosted model over line pairs and the words that repeated lines use."""

    def __init__(self) -> None:
        self.prior: dict[str, float] = {}
        self.model = Boosted(trees=50, depth=3)

    def fit(self, docs: dict[int, list[str]]) -> Furniture:
        """docs: texts of the chunks of whole documents. A line is an example of furniture if its folded form stands in two or
        more different chunks of its document, is not ended and is short; lines of flowing text are the others."""
        seen: list[tuple[list[Segment], list[bool]]] = []
        furniture, flowing = Counter(), Counter()
        for texts in docs.values():
            texts = list(dict.fromkeys(texts))
            parsed = [segments(t) for t in texts]
            count: Counter = Counter()
            for segs in parsed:
                count.update({skeleton(s.text) for s in segs if s.page is None})
            for segs in parsed:
                flags = [s.page is None and count[skeleton(s.text)] > 1 and _ENDED.search(s.text) is None and len(s.text) < 90 and not _ITEM.match(s.text) for s in segs]
                seen.append((segs, flags))
                for s, f in zip(segs, flags):
                    (furniture if f else flowing).update(set(tokens(skeleton(s.text))))
        a, b = sum(furniture.values()) + 1, sum(flowing.values()) + 1
        self.prior = {w: float(np.clip(np.log((furniture[w] + 0.1) / a) - np.log((flowing[w] + 0.1) / b), -4, 4)) for w in furniture | flowing if furniture[w] + flowing[w] > 1}
        xs, ys = [], []
        for segs, flags in seen:
            if not segs:
                continue
            which = [i for i, s in enumerate(segs) if s.page is None]
            for i, row in zip(which, line_features(segs, self.prior, which)):
                f = flags[i]
                # a lone open line of furniture's words may be a header that was stored once: it teaches nothing
                if not f and row[0] and row[16] > 0.5 and row[14] > 2:
                    continue
                xs.append(row)
                ys.append(f)
        if xs:
            self.model.fit(np.array(xs), np.array(ys))
        return self

    def scores(self, many: list[list[Segment]]) -> list[np.ndarray]:
        """Probability of being furniture, for the segments of many texts at once; page numbers and single lines get 0."""
        out = [np.zeros(len(segs)) for segs in many]
        if not self.model.nodes:
            return out
        open_ = [[i for i, s in enumerate(segs) if s.page is None and _ENDED.search(s.text) is None] if len(segs) > 1 else [] for segs in many]
        x = [line_features(segs, self.prior, at) for segs, at in zip(many, open_) if at]
        if x:
            p = self.model.predict(np.concatenate(x))
            k = 0
            for o, at in zip(out, open_):
                o[at] = p[k:k + len(at)]
                k += len(at)
        return out


# -- words --------------------------------------------------------------------------------------------------------------
def _devanagari_swap(word: str) -> set[str]:
    """Forms of a word with one short i put before or behind its neighbour cluster."""
    out = set()
    for m in re.finditer("ि", word):
        k = m.start()
        j = k - 1
        if j >= 0:
            out.add(word[:j] + word[k] + word[j] + word[k + 1:])
        if k + 1 < len(word):
            out.add(word[:k] + word[k + 1] + word[k] + word[k + 2:])
    return out


def align(wrong: str, right: str) -> tuple[int, int, int, int, int, int]:
    """(look-alikes, weak look-alikes, doubled signs, swaps, substitutions, gaps) of the cheapest alignment."""
    n, m = len(wrong), len(right)
    inf = (1e9, None, None)
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, None, None)

    def push(i: int, j: int, cost: float, frm: tuple[int, int], op: str) -> None:
        if cost < best[i][j][0]:
            best[i][j] = (cost, frm, op)

    for i in range(n + 1):
        for j in range(max(0, i - 4), min(m, i + 4) + 1):
            c = best[i][j][0]
            if c > 6:
                continue
            if i < n and j < m:
                a, b = wrong[i], right[j]
                if a == b:
                    push(i + 1, j + 1, c, (i, j), "=")
                else:
                    push(i + 1, j + 1, c + 1.0, (i, j), "s")
            for r in (1, 2):
                if j + r <= m and (alts := LOOK_ALIKES.get(right[j:j + r])):
                    for alt in alts:
                        if wrong.startswith(alt, i):
                            weak = (right[j:j + r], alt) in WEAK_PAIRS
                            push(i + len(alt), j + r, c + (0.35 if weak else 0.3), (i, j), "w" if weak else "l")
            if i < n and i and wrong[i] == wrong[i - 1] and not wrong[i].isdigit():
                push(i + 1, j, c + (0.3 if not wrong[i].isalpha() else 0.9), (i, j), "d" if not wrong[i].isalpha() else "g")
            if i + 1 < n and j + 1 < m and wrong[i] == right[j + 1] and wrong[i + 1] == right[j]:
                push(i + 2, j + 2, c + 0.4, (i, j), "x")
            if i + 2 < n and j + 2 < m and wrong[i] == "ि" == right[j + 2] and wrong[i + 1:i + 3] == right[j:j + 2]:
                push(i + 3, j + 3, c + 0.5, (i, j), "x")
            if i < n:
                push(i + 1, j, c + 1.0, (i, j), "g")
            if j < m:
                push(i, j + 1, c + 1.0, (i, j), "g")
    ops = Counter()
    i, j = n, m
    if best[n][m][1] is None and (n or m):
        return (0, 0, 0, 0, 9, 9)
    while (i, j) != (0, 0):
        _, frm, op = best[i][j]
        ops[op] += 1
        i, j = frm
    return ops["l"], ops["w"], ops["d"], ops["x"], ops["s"], ops["g"]


def grams(word: str, q: int = Q) -> set[str]:
    s = "^" * (q - 1) + word + "$" * (q - 1)
    return {s[i:i + q] for i in range(len(s) - q + 1)}


def pair_features(wrong: str, right: str, seen: int, clean: int) -> list[float]:
    """wrong occurs in seen chunks and in no clean text; right occurs in clean front matters."""
    ops = align(wrong, right)
    a, b = grams(wrong), grams(right)
    odd = sum(c.isdigit() or not (c.isalpha() or c >= "̀") for c in wrong)
    return [*ops, ops[0] + ops[1] + ops[2] + ops[3], len(wrong), len(right) - len(wrong), log1p(seen), log1p(clean), log1p(clean) - log1p(seen), len(a & b) / max(len(a), len(b)), odd, wrong.isascii()]


def corrupt(word: str, rng: np.random.Generator) -> str | None:
    """A word as a scanner may have read it: one to three confusions, or None if nothing can be confused."""
    out = word
    for _ in range(int(rng.choice([1, 1, 1, 2, 2, 3]))):
        places = []
        for i in range(len(out)):
            for r in (1, 2):
                for alt in LOOK_ALIKES.get(out[i:i + r], ()) if i + r <= len(out) else ():
                    places += [(i, r, alt)] * (1 if (out[i:i + r], alt) in WEAK_PAIRS else 3)
            if "ऀ" <= out[i] <= "ः" or "ा" <= out[i] <= "ौ":
                places += [(i, 1, out[i] * 2)] * 2
        forms = sorted(_devanagari_swap(out))
        if forms and rng.random() < 0.3:
            out = forms[int(rng.integers(len(forms)))]
        elif places:
            i, r, alt = places[int(rng.integers(len(places)))]
            out = out[:i] + alt + out[i + r:]
    return out if out != word else None


def train_ranker(lexicon: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """Ranker from words corrupted on purpose, against words with letters lost, added or changed, and against real neighbours.

    lexicon: (word, clean count), bounded by TRAIN_WORDS.
    """
    rng = np.random.default_rng(seed)
    words = dict(lexicon)
    index: dict[str, list[str]] = defaultdict(list)
    for w in words:
        for g in grams(w):
            index[g].append(w)

    def near(t: str) -> list[str]:
        hits = Counter(w for g in grams(t) for w in index.get(g, ()))
        return [w for w, _ in hits.most_common(4) if w != t]

    xs, ys = [], []

    def add(t: str, w: str, y: int) -> None:
        xs.append(pair_features(t, w, int(min(40, 1 + rng.geometric(0.3))), words[w]))
        ys.append(y)

    for w, n in lexicon:
        t = corrupt(w, rng)
        if t and t not in words and len(t) > 1:
            add(t, w, 1)
            for other in near(t):
                if other != w and sum(align(t, other)[4:]):
                    add(t, other, 0)
        k = int(rng.integers(len(w)))
        for bad in (w[:k] + w[k + 1:], w[:k] + chr(97 + int(rng.integers(26))) + w[k + 1:] if w.isascii() else w[:k] + chr(0x915 + int(rng.integers(36))) + w[k + 1:], w[:k] + (chr(97 + int(rng.integers(26))) if w.isascii() else chr(0x915 + int(rng.integers(36)))) + w[k:]):
            if len(bad) > 1 and bad not in words and sum(align(bad, w)[4:]):
                add(bad, w, 0)
        for other in near(w)[:2]:
            if sum(align(w, other)[4:]):
                add(w, other, 0)
    model = Boosted(trees=60, depth=3)
    return model.fit(np.array(xs), np.array(ys)) if xs else model


def cut_features(left: str, right: str, one: int, two: int, a: int, b: int, misread: bool) -> list[float]:
    """A line that ends in left and a hyphen, and the next one that starts with right; one, two, a, b: clean counts of the word
    as one, of the compound, and of both halves; misread: the word as one is a misread of a known word."""
    l1, l2, la, lb = log1p(one), log1p(two), log1p(a), log1p(b)
    return [l1, l2, l1 - l2, la, lb, min(la, lb), min(la, lb) - l1, misread, len(left), len(right), min(len(left), len(right)), left.isascii()]


def train_joins(words: list[tuple[str, int]], compounds: list[tuple[str, int]], count: dict[str, int], seed: int = 9) -> Boosted:
    """Line-pair classifier of cut words (1) against compounds broken at their hyphen (0), from bounded samples of (word, clean count).

    count: clean counts of everything that cut_examples() asks for. Some examples forget the count of the whole, as a rare or
    misread word has none: a cut word is then known as a misread at best, a compound by its halves alone.
    """
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for kind, left, right in cut_examples(words, compounds):
        whole, hyphened = left + right, f"{left}-{right}"
        one, two, a, b = (count.get(w, 0) for w in (whole, hyphened, left, right))
        if kind == "forgotten":
            xs.append(cut_features(left, right, 0, two, a, b, bool(rng.random() < 0.5)))
        elif kind == "rare":
            xs.append(cut_features(left, right, 0, 0, a, b, False))
        else:
            xs.append(cut_features(left, right, one, two, a, b, False))
        ys.append(kind in ("cut", "forgotten"))
    model = Boosted(trees=40, depth=3)
    return model.fit(np.array(xs, float), np.array(ys, float)) if xs else model


def cut_examples(words: list[tuple[str, int]], compounds: list[tuple[str, int]]) -> list[tuple[str, str, str]]:
    """(kind, left, right): every word cut at a place of its own, and compounds cut at their hyphens; a part of both as if unseen."""
    out = []
    for w, _ in words:
        if len(w) >= 4:
            k = 2 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % (len(w) - 3)
            out.append(("forgotten" if k % 5 == 0 else "cut", w[:k], w[k:]))
    for w, _ in compounds:
        parts = w.split("-")
        for k in range(1, len(parts)):
            left, right = "-".join(parts[:k]), "-".join(parts[k:])
            if left and right:
                out += [("compound", left, right), ("rare", left, right)]
    return out


# -- distributed ----------------------------------------------------------------------------------------------------------
def _bare(word: Column | str) -> Column:
    strip = "[" + re.sub(r"([\[\]\\^&\-])", r"\\\1", PUNCTUATION) + "]+"
    return F.regexp_replace(F.regexp_replace(word, f"^{strip}", ""), f"{strip}$", "")


def lexicon(documents: DataFrame) -> DataFrame:
    """(word, clean): in how many front matters each word, or compound with its hyphen, stands; each written form counts.

    Texts are cut at blanks inside the JVM; only distinct written forms are stripped of punctuation and cut at hyphens.
    """
    raw = documents.select(F.explode(F.array_distinct(F.split(F.lower("text"), f"[{BLANK}]+"))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    bare = _bare(F.translate("raw", "‐", "-"))
    raw = raw.where(F.col("raw").rlike(r"\p{L}")).select(bare.alias("raw"), "n")
    parts = raw.select(F.explode(F.array_distinct(F.array_append(F.split("raw", r"[\-–—/]+"), F.col("raw")))).alias("word"), "n")
    inner = parts.select(_bare("word").alias("word"), "n")
    return inner.where((F.length("word") > 1) & F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.sum("n").alias("clean")).where("clean > 1")


SCAN = "chunk_id long, doc_id long, chunk_index int, page int, words array<string>, cuts array<struct<left:string,right:string,written:string>>, lines array<struct<at:int,skeleton:string,score:double>>, numbers array<struct<at:int,value:int,style:string>>"


def parse(segs: list[Segment], score: np.ndarray, common: frozenset[str] = frozenset()) -> tuple[list[str], list[tuple[str, str, str]], list[tuple[int, str, float]], list[tuple[int, int, str]]]:
    """(words but for common ones, line pairs that may cut a word, possible header lines, possible page numbers) of one text.

    A cut is (left, right, written): what stands before the hyphen, what starts the next line, and both as written but for the
    signs at the cut. Its halves are no words of the text; the line pair's classifier decides what they are.
    """
    if len(segs) < 2:
        return sorted({w for s in segs for w in (*tokens(s.text), *edge_words(s.text, common))} - common), [], [], []
    lines, numbers, body, cuts = [], [], [], []
    for s, p in zip(segs, score):
        if s.page is not None:
            numbers.append((s.start, s.page[0], s.page[1]))
        elif p >= MAYBE:
            lines.append((s.start, skeleton(s.text), float(p)))
        if s.page is None and p < FURNITURE:
            body.append(s)
    words: set[str] = set()
    carry = ""
    for i, s in enumerate(body):
        t = s.text
        m = _CUT.search(t)
        nxt = body[i + 1].text if i + 1 < len(body) else ""
        right = re.match(rf"[^\s{HYPHENS}/]+", nxt) if m and nxt else None
        if carry and t.startswith(carry):
            t = t[len(carry):]
        carry = ""
        if m and right and (m.group(1)[-1].isalpha() or m.group(1)[-1] >= "ऀ" and not m.group(1)[-1].isdigit()):
            left, r = m.group(1).lower().strip(PUNCTUATION), right.group().lower().strip(PUNCTUATION)
            if left and r and (r[0].isalpha() or r[0] >= "ऀ"):
                cuts.append((left, r, m.group(1).lower().rstrip(PUNCTUATION) + right.group().lower().lstrip(PUNCTUATION)))
                t = t[: max(0, m.start() - (len(s.text) - len(t)))]
                carry = right.group()
        words.update(tokens(t), edge_words(t, common))
    return [w for w in words - common if len(w) > 1], cuts, lines, numbers


def scan(chunks: DataFrame, furniture: Furniture, common: frozenset[str] = frozenset()) -> DataFrame:
    """One row per chunk with what its text may hold. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                many = [segments(t) for t in part["text"]]
                for (cid, did, index, page, _), segs, score in zip(part.itertuples(index=False), many, furniture.scores(many)):
                    w, c, ln, nu = parse(segs, score, common)
                    if w or c or ln or nu:
                        whole = lambda v: None if pd.isna(v) else int(v)
                        rows.append((cid, did, whole(index), whole(page), w, [{"left": a, "right": b, "written": x} for a, b, x in c], [{"at": a, "skeleton": k, "score": p} for a, k, p in ln], [{"at": a, "value": v, "style": k} for a, v, k in nu]))
            out = pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_index", "page", "words", "cuts", "lines", "numbers"])
            out = out.astype({"chunk_id": "Int64", "doc_id": "Int64", "chunk_index": "Int32", "page": "Int32"})
            yield out

    return chunks.select("id", "doc_id", "chunk_index", "page", "text").where("text <> ''").mapInPandas(run, SCAN)


def training_docs(chunks: DataFrame) -> dict[int, list[str]]:
    """Texts of whole documents that have more than two and at most 40 chunks with lines: the first by hash, at most TRAIN_DOCS
    documents with at most TRAIN_CHUNKS chunks."""
    c = chunks.select("doc_id", "text").where("text LIKE '%\n%' AND doc_id IS NOT NULL")
    few = c.groupBy("doc_id").agg(F.count("*").alias("n")).where("n BETWEEN 3 AND 40").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()
    room, ids = TRAIN_CHUNKS, []
    for r in few:
        if r.n <= room:
            room -= r.n
            ids.append(r.doc_id)
    out: dict[int, list[str]] = defaultdict(list)
    for r in c.where(F.col("doc_id").isin(ids)).collect() if ids else []:
        out[r.doc_id].append(r.text)
    return {k: sorted(out[k]) for k in sorted(out)}


def gram_index(words: DataFrame, word: str, size: str, replicate: int = 0) -> DataFrame:
    """words with one row for each q-gram of the prefix of their word: (gram, band) to meet on, and size, the number of q-grams.

    Two words that share MIN_GRAMS of the q-grams of the longer one also share one of the prefix of either, if all prefixes
    follow the same order: of n q-grams the last MIN_GRAMS * n may be left out. The order puts q-grams with outer padding last, for
    these are the common ones. band is the number of q-grams; with replicate, a row for every band so far away.
    """
    prefix = F.pandas_udf(lambda s: s.map(gram_prefix), "array<string>")
    number = F.pandas_udf(lambda s: s.map(lambda w: len(grams(w))).astype("int32"), "int")
    near = F.explode(F.sequence(F.col(size) - replicate, F.col(size) + replicate)) if replicate else F.col(size)
    return words.withColumn(size, number(word)).select(*words.columns, size, near.alias("band"), prefix(word).alias("_g")).select(*words.columns, size, "band", F.explode("_g").alias("gram"))


def gram_prefix(word: str) -> list[str]:
    g = sorted(grams(word), key=lambda x: (x.startswith("^") + x.endswith("$"), zlib.crc32(x.encode("utf-8", "surrogatepass"))))
    return g[: len(g) - ceil(MIN_GRAMS * len(g)) + 1]


def corrections(unknown: DataFrame, lex: DataFrame, ranker: Boosted) -> DataFrame:
    """(word, replacement, score) of unknown (word, seen) that the ranker takes for misreads.

    Candidates come from the inverted index of q-grams of the lexicon; pairs need MIN_GRAMS of shared q-grams.
    """
    a = gram_index(unknown.select("word", "seen"), "word", "n", BAND)
    b = gram_index(lex.where(~F.col("word").contains("-")).select(F.col("word").alias("right"), "clean"), "right", "m")
    met = a.join(b, ["gram", "band"]).select("word", "right", "seen", "clean", "n", "m").dropDuplicates(["word", "right"])
    cut = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) + Q - 1), lambda i: F.substring(F.concat(F.lit("^" * (Q - 1)), w, F.lit("$" * (Q - 1))), i, F.lit(Q))))
    met = met.where(F.size(F.array_intersect(cut(F.col("word")), cut(F.col("right")))) >= MIN_GRAMS * F.greatest("n", "m"))

    @F.pandas_udf("double")
    def rank(word: pd.Series, right: pd.Series, seen: pd.Series, clean: pd.Series) -> pd.Series:
        x = [pair_features(*v) for v in zip(word, right, seen, clean)]
        return pd.Series(ranker.predict(np.array(x)) if x else np.zeros(0))

    scored = met.withColumn("score", rank("word", "right", "seen", "clean")).where(F.col("score") >= MISREAD)
    return scored.groupBy("word").agg(F.max(F.struct("score", "clean", "right")).alias("best")).select("word", F.col("best.right").alias("replacement"), F.col("best.score").alias("score"))


class Noise:
    """Everything that problem 1's queries share: the scan of all chunks and the decisions about it."""

    def __init__(self, chunks: DataFrame, documents: DataFrame):
        self.chunks = chunks
        self.lex = materialise(lexicon(documents), "lexicon")
        sample = [(r.word, r.clean) for r in self._sample(~F.col("word").contains("-"))]
        self.ranker = train_ranker(sample)
        self.joins = self._join_classifier(sample)
        self.furniture = Furniture().fit(training_docs(chunks))
        common = frozenset(r.word for r in self.lex.orderBy(F.desc("clean"), "word").limit(COMMON_WORDS).collect())
        self.scan = materialise(scan(chunks, self.furniture, common), "scan")
        cuts = self.scan.where(F.size("cuts") > 0).select("chunk_id", F.explode("cuts").alias("c")).select("chunk_id", "c.*").dropDuplicates()
        self.pairs = materialise(self._known_pairs(cuts), "pairs")
        whole = self.pairs.where((F.col("one") > 0) | (F.col("two") == 0))  # the others are compounds: their halves are words
        joined = cuts.join(whole.select("left", "right", "one"), ["left", "right"])
        edged = F.pandas_udf(lambda one, raw: pd.Series([[] if k else [f for _, f in edge_forms(w)] for k, w in zip(one, raw)]), "array<string>")
        more = joined.select("chunk_id", F.concat("left", "right").alias("word")).unionByName(joined.select("chunk_id", F.explode(edged("one", "written")).alias("word")))
        halves = cuts.join(whole.select("left", "right"), ["left", "right"], "left_anti").select("chunk_id", F.explode(F.array("left", "right")).alias("word"))
        words = self.scan.select("chunk_id", F.explode("words").alias("word")).unionByName(more.unionByName(halves).where(F.length("word") > 1).dropDuplicates())
        unknown = words.groupBy("word").agg(F.count("*").alias("seen")).withColumn("bare", _bare("word"))
        unknown = materialise(unknown.join(self.lex.select(F.col("word").alias("bare")), "bare", "left_anti").select("word", "seen"), "unknown")
        self.fixes = materialise(corrections(unknown, self.lex, self.ranker), "fixes")
        self.misreads = words.join(small_side(self.fixes, 128), "word").select("chunk_id", "word", "replacement").dropDuplicates(["chunk_id", "word"])

    def _sample(self, which: Column) -> list:
        """The first TRAIN_WORDS entries of the lexicon by hash."""
        return self.lex.where(which).orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS).collect()

    def _join_classifier(self, sample: list[tuple[str, int]]) -> Boosted:
        compounds = [(r.word, r.clean) for r in self._sample(F.col("word").rlike(r"^[^-]+(-[^-]+)+$"))]
        asked = sorted({w for _, a, b in cut_examples(sample, compounds) for w in (a, b, a + b, f"{a}-{b}")})  # a few for each of TRAIN_WORDS examples
        if not asked:
            return Boosted()
        known = self.lex.join(F.broadcast(self.lex.sparkSession.createDataFrame([(w,) for w in asked], "word string")), "word").collect()
        return train_joins(sample, compounds, {r.word: r.clean for r in known})

    def _known_pairs(self, cuts: DataFrame) -> DataFrame:
        """(left, right, one, two, a, b): distinct line pairs with the clean counts of the word, the compound and the halves."""
        d = cuts.select("left", "right").dropDuplicates()
        for name, key in (("one", F.concat("left", "right")), ("two", F.concat_ws("-", "left", "right")), ("a", F.col("left")), ("b", F.col("right"))):
            d = d.withColumn("_k", key).join(self.lex.select(F.col("word").alias("_k"), F.col("clean").alias(name)), "_k", "left").drop("_k").fillna({name: 0})
        return d

    def cuts(self) -> DataFrame:
        """(chunk_id, left, right): words cut at a line end, by the line-pair classifier."""
        misread = self.fixes.select(F.col("word").alias("_w"), F.lit(True).alias("misread"))
        d = self.pairs.join(misread, F.concat("left", "right") == F.col("_w"), "left").drop("_w").fillna({"misread": False})
        model = self.joins

        @F.pandas_udf("double")
        def cut(left: pd.Series, right: pd.Series, one: pd.Series, two: pd.Series, a: pd.Series, b: pd.Series, bad: pd.Series) -> pd.Series:
            x = np.array([cut_features(*v) for v in zip(left, right, one, two, a, b, bad)], float)
            return pd.Series(model.predict(x) if len(x) and model.nodes else np.ones(len(x)))

        is_cut = d.where(cut("left", "right", "one", "two", "a", "b", "misread") >= CUT_WORD).select("left", "right")
        c = self.scan.where(F.size("cuts") > 0).select("chunk_id", F.explode("cuts").alias("c")).select("chunk_id", "c.left", "c.right")
        return c.join(is_cut, ["left", "right"])

    def headers(self) -> DataFrame:
        """(chunk_id, at): header lines. A line the classifier is unsure of needs another chunk of its document with the same one."""
        h = self.scan.where(F.size("lines") > 0).select("chunk_id", "doc_id", F.explode("lines").alias("l")).select("chunk_id", "doc_id", "l.at", "l.skeleton", "l.score")
        low = h.where(F.col("score") < FURNITURE)  # only these are joined: the many sure lines of a large document stay where they are
        asked = low.select("doc_id", "skeleton").dropDuplicates()
        rep = h.join(asked, ["doc_id", "skeleton"], "left_semi").groupBy("doc_id", "skeleton").agg(F.count_distinct("chunk_id").alias("chunks")).where("chunks > 1")
        return h.where(F.col("score") >= FURNITURE).select("chunk_id", "at").unionByName(low.join(rep, ["doc_id", "skeleton"]).select("chunk_id", "at"))

    def page_numbers(self) -> DataFrame:
        """(chunk_id, at): printed numbers that follow the document's own numbering.

        Printed number minus page is the same throughout a document: the offset with the most support (styled numbers count
        three times) holds; a document whose only support is one bare number has no numbering unless it equals the page.
        """
        n = self.scan.where(F.size("numbers") > 0).select("chunk_id", "doc_id", "chunk_index", "page", F.explode("numbers").alias("p")).select("chunk_id", "doc_id", "chunk_index", "page", "p.at", "p.value", "p.style")
        # a null page is guessed from the nearest of three chunks on either side, looked up by (doc_id, chunk_index)
        hole = n.where("page IS NULL AND chunk_index IS NOT NULL").select("chunk_id", "doc_id", "chunk_index").dropDuplicates()
        steps = F.explode(F.array(*[F.lit(k) for k in (-3, -2, -1, 1, 2, 3)]))
        asked = hole.select("chunk_id", "doc_id", "chunk_index", steps.alias("step")).withColumn("chunk_index", F.col("chunk_index") + F.col("step"))
        near = self.chunks.where("page IS NOT NULL").select("doc_id", "chunk_index", F.col("page").alias("own"))
        order = F.struct((F.col("step") > 0).alias("after"), F.abs("step").alias("far"), F.col("own").alias("own"))
        filled = asked.join(near, ["doc_id", "chunk_index"]).groupBy("chunk_id").agg(F.min(order).alias("b")).select("chunk_id", F.col("b.own").alias("guess"))
        n = n.join(filled, "chunk_id", "left")
        sure = n.where("page IS NOT NULL").withColumn("offset", F.col("value") - F.col("page"))
        weight = F.sum(F.when(F.col("style") == "styled", 3).when(F.col("style") == "roman", 2).otherwise(1))
        votes = sure.groupBy("doc_id", "offset").agg(weight.alias("votes"))
        best = votes.groupBy("doc_id").agg(F.max(F.struct("votes", (-F.abs(F.col("offset"))).alias("close"), "offset")).alias("b")).select("doc_id", F.col("b.offset").alias("offset"), F.col("b.votes").alias("votes"))
        judged = n.join(small_side(materialise(best, "offsets"), 64), "doc_id", "left")  # one row a document: the optimiser may split n's hot document
        page = F.coalesce("page", "guess")
        same = F.when(F.col("page").isNotNull(), F.col("value") - F.col("page") == F.col("offset")).otherwise(F.coalesce(F.abs(F.col("value") - page - F.coalesce("offset", F.lit(0))) <= 2, F.col("style") != "bare"))
        trusted = (F.col("style") != "bare") | (F.coalesce("votes", F.lit(0)) >= 2) | (F.abs(F.coalesce("offset", F.lit(99))) <= 20)
        return judged.where(same & trusted).select("chunk_id", "at")

    def found(self) -> DataFrame:
        """(chunk_id, kind), once each."""
        part = lambda df, kind: df.select("chunk_id", F.lit(kind).alias("kind"))
        return part(self.cuts(), "hyphen").unionByName(part(self.misreads, "misread")).unionByName(part(self.headers(), "header")).unionByName(part(self.page_numbers(), "pageno")).dropDuplicates()


def rebuild(text: str, furniture_at: set[int], joins: set[tuple[str, str]], fixes: dict[str, str]) -> str:
    """Continuous paragraphs: furniture left out, cut words joined, lines of a paragraph laid end to end, misreads replaced.

    A line that left room for the next one's first word ends its paragraph, as headings and statements of a line each do, unless the
    next line goes on in small letters.
    """
    out: list[str] = []
    body = [s for s in segments(text) if s.start not in furniture_at]
    width = [len(s.text) for s in body]
    last = 0
    for i, s in enumerate(body):
        gap = text[last:s.start]
        last = s.start + len(s.text)
        t = s.text
        room = i > 0 and body[i - 1].line != s.line and width[i - 1] + 1 + len(t.split()[0]) <= max(width[max(0, i - 3):i + 2])
        if out and gap.count("\n") > 1 and not gap.strip():
            out.append("\n\n" + t)
        elif out:
            m, r = _CUT.search(out[-1]), re.match(rf"[^\s{HYPHENS}/]+", t)
            if m and r:
                key = m.group(1).lower().strip(PUNCTUATION), r.group().lower().strip(PUNCTUATION)
                out[-1] = out[-1][: m.end(1)] + t if key in joins else out[-1].rstrip() + t
            elif _ITEM.match(t) or room and not t[0].islower():
                out.append("\n" + t)
            else:
                out[-1] += " " + t
        else:
            out.append(t)
    whole = "".join(out)

    def swap(m: re.Match) -> str:
        w = m.group().strip(PUNCTUATION)
        w = next((x for x in (w, *(form for _, form in edge_forms(m.group()))) if x.lower() in fixes), None)
        if w is None:
            return m.group()
        f = fixes[w.lower()]
        f = f.upper() if w.isupper() and len(w) > 1 else f[:1].upper() + f[1:] if w[:1].isupper() else f
        return m.group().replace(w, f, 1)

    return re.sub(r"[^\s\-‐–—/]+", swap, whole) if fixes else whole


def repair(noise: Noise) -> DataFrame:
    """(chunk_id, text) of every chunk with noise, as readable paragraphs. Lists per chunk are bounded by the chunk's own text."""
    f = noise.headers().unionByName(noise.page_numbers()).groupBy("chunk_id").agg(F.collect_set("at").alias("at"))
    j = noise.cuts().groupBy("chunk_id").agg(F.collect_set(F.struct("left", "right")).alias("joins"))
    m = noise.misreads.groupBy("chunk_id").agg(F.collect_set(F.struct("word", "replacement")).alias("fixes"))
    per = f.join(j, "chunk_id", "full_outer").join(m, "chunk_id", "full_outer")
    both = per.join(noise.chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").select("chunk_id", "text", "at", "joins", "fixes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: v is None or isinstance(v, float)
        for pdf in batches:
            rows = []
            for cid, text, at, joins, fixes in pdf.itertuples(index=False):
                rows.append((cid, rebuild(text, set() if none(at) else set(map(int, at)), set() if none(joins) else {(x["left"], x["right"]) for x in joins}, {} if none(fixes) else {x["word"]: x["replacement"] for x in fixes})))
            yield pd.DataFrame(rows, columns=["chunk_id", "text"])

    return both.mapInPandas(run, "chunk_id long, text string")
