"""Word lattices of scripts that write no spaces between words, and classes of the gaps between their sentences (problem 9).

A dictionary of words is found in texts by cohesion (a word's parts stand together more often than chance) and by the variety of
what stands beside it. The cheapest path through the lattice of dictionary words segments a run of text. A gap is then
classified by how often its last word closes and its first word opens a sentence in texts whose boundaries are known, by general
lists of final particles and opening words, and by what stands around it. The classifier is trained on joins of known sentences
against the gaps inside them. fit() takes texts as a list; sentences.fit_spaceless counts the same over all texts of a table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np

from granth.llm.boosting import Boosted

#: Thai, Lao, Burmese, Khmer, kana, Han (fixed values: Unicode blocks).
LETTERS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
# -- fixed values: general words of the languages -------------------------------------------------------------------------
#: Particles and endings that close a sentence.
FINAL = ("ครับ", "ค่ะ", "คะ", "นะ", "จ้ะ", "จ้า", "แล้ว", "ไหม", "หรือไม่", "หรือยัง", "ด้วย", "เลย", "です", "ます", "ました", "ません", "でした", "である", "だった", "ください", "でしょう", "ましょう", "吗", "吧", "呢", "了", "啊")
#: Words that open a sentence.
OPENING = ("แต่", "ดังนั้น", "เมื่อ", "หาก", "ถ้า", "กรุณา", "โปรด", "นอกจากนี้", "อย่างไรก็ตาม", "เพราะฉะนั้น", "วันนี้", "พรุ่งนี้", "ผู้ที่", "しかし", "また", "そして", "なお", "ただし", "だから", "今日", "明日", "この", "その", "但是", "因此", "所以", "此外", "请", "我", "他", "她", "今天", "明天")
#: What goes on inside a sentence at its start: joiners, case particles, endings that follow a closing one.
GOING_ON = ("และ", "หรือ", "ของ", "ใน", "ซึ่ง", "ว่า", "ให้", "กับ", "จาก", "โดย", "เพื่อ", "ภายใน", "จะ", "ที่", "は", "が", "を", "に", "の", "へ", "と", "も", "で", "や", "から", "まで", "ので", "けど", "か", "し", "よ", "ね", "的", "地", "得", "和", "与", "或", "在", "到", "过")
LONGEST = 10
MIN_COUNT = 4
MOST_WORDS = 20_000
COHESION, VARIETY = 1.2, 3
UNKNOWN = 9.0

_RUN = re.compile(f"[{LETTERS}]+")
_BLANK_GAP = re.compile(f"(?<=[{LETTERS}0-9A-Za-z.%])[  \u3000]+(?=[{LETTERS}])")
_MARKED = re.compile(r"[。！？!?｡\n]+")
_HAS = re.compile(f"[{LETTERS}]")


class Spaceless:
    """Dictionary, closing and opening counts, and gap classifier. An unfitted one knows the general lists only."""

    def __init__(self) -> None:
        self.cost: dict[str, float] = {w: 3.0 for w in {*FINAL, *OPENING, *GOING_ON}}
        self.longest = max(map(len, self.cost))
        self.closing: Counter = Counter()
        self.opening: Counter = Counter()
        self.inner: Counter = Counter()
        self.model = Boosted(trees=40, depth=3, least=4)
        self.judged: dict[tuple, float] = {}

    # -- words --
    @staticmethod
    def grams(text: str) -> Iterator[tuple[str, str, str]]:
        """(gram, character before, character after) of all stretches of runs up to LONGEST; single characters without neighbours."""
        for m in _RUN.finditer(text):
            run = f"\x02{m.group()}\x03"
            n = len(run)
            for i in range(1, n - 1):
                yield run[i], "", ""
            for k in range(2, LONGEST + 1):
                for i in range(1, n - k):
                    yield run[i:i + k], run[i - 1], run[i + k]

    def learn_words(self, texts: list[str]) -> None:
        """Dictionary from the runs of texts. Bounds: LONGEST characters a word, MOST_WORDS words."""
        grams: Counter = Counter()
        beside: dict[str, set[str]] = {}
        for t in texts:
            for m in _RUN.finditer(t):
                run = f"\x02{m.group()}\x03"
                n = len(run)
                for k in range(1, LONGEST + 1):
                    for i in range(1, n - k):
                        grams[run[i:i + k]] += 1
        total = sum(c for g, c in grams.items() if len(g) == 1) or 1
        firm = {g for g, c in grams.items() if len(g) > 1 and c >= MIN_COUNT and min(log(c * total / (grams[g[:k]] * grams[g[k:]])) for k in range(1, len(g))) >= COHESION}
        for t in texts:
            for m in _RUN.finditer(t):
                run = f"\x02{m.group()}\x03"
                n = len(run)
                for k in range(2, LONGEST + 1):
                    for i in range(1, n - k):
                        g = run[i:i + k]
                        if g in firm:
                            beside.setdefault("<" + g, set()).add(run[i - 1])
                            beside.setdefault(">" + g, set()).add(run[i + k])
        free = lambda g: min(len(s) + 2 * bool(s & {"\x02", "\x03"}) for s in (beside["<" + g], beside[">" + g]))
        words = sorted((g for g in firm if free(g) >= VARIETY), key=lambda g: (-grams[g] * len(g), g))[:MOST_WORDS]
        for w in words:
            self.cost[w] = log(total / grams[w])
        self.longest = max(map(len, self.cost))

    def words(self, text: str) -> list[str]:
        """Cheapest path through the word lattice: a dictionary word costs its surprise, an unknown character UNKNOWN; runs of
        unknown characters come out as one word."""
        n = len(text)
        best, back = [0.0] + [1e18] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] + UNKNOWN < best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + UNKNOWN, i
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = self.cost.get(text[i:j])
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out, j = [], n
        while j:
            out.append(text[back[j]:j])
            j = back[j]
        out.reverse()
        joined: list[str] = []
        for w in out:
            if joined and w not in self.cost and joined[-1] not in self.cost and w.isdigit() == joined[-1].isdigit():
                joined[-1] += w
            else:
                joined.append(w)
        return joined

    @staticmethod
    def keys(words: list[str], opening: bool) -> list[str]:
        """What is counted at the start or end of words: the outermost word and, marked by a blank, it and its neighbour. Numbers are alike."""
        plain = ["0" if w.isdigit() else w for w in (words[:2] if opening else words[-2:])]
        one = plain[:1] if opening else plain[-1:]
        return [*one, " ".join(plain)] if len(plain) > 1 else one

    def count_inner(self, words: list[str]) -> None:
        for k in range(1, len(words)):
            self.inner.update("<" + x for x in self.keys(words[k:], True))
            self.inner.update(">" + x for x in self.keys(words[:k], False))

    # -- gaps --
    def features(self, left: str, right: str, blank: bool, mine: int = 0, forget: bool = False) -> list[float]:
        """A gap between left and right (without the blank). mine: how often this very gap is in the counts; forget: as if all of
        its words were new."""
        odds = []
        for side, opening, seen in ((left[-2 * LONGEST:], False, self.closing), (right[:2 * LONGEST], True, self.opening)):
            got = []
            for x in self.keys(self.words(side), opening):
                out, inside = max(0, seen[x] - mine), self.inner["<>"[not opening] + x]
                got.append(log((out + 0.5) / (inside + 0.5)) if out + inside else 0.0)
            odds += (got + [0.0, 0.0])[:2] if not forget else [0.0, 0.0]
        return [
            *odds, max(odds[:2]) + max(odds[2:]), left.endswith(FINAL), right.startswith(OPENING), right.startswith(GOING_ON), blank,
            min(len(left), 40), min(len(right), 40), left[-1:].isdigit(), right[:1].isdigit(), left[-1:].isascii(),
        ]

    @staticmethod
    def single(sentences: list[str]) -> list[str]:
        return [s.strip() for s in sentences if s and _HAS.search(s)]

    def count_marked(self, text: str) -> None:
        """Inner words of all sentences that end in a mark; where a space may end one too, they are left out."""
        for p in _MARKED.split(text):
            s = p.strip()
            if s and _HAS.search(s) and not _BLANK_GAP.search(s):
                self.count_inner(self.words(s))

    def fit(self, sentences: list[str], texts: list[str]) -> Spaceless:
        """sentences: units with known ends, in any language (spaced ones are left out); texts: documents that hold spaceless scripts."""
        self.learn_words([*self.single(sentences), *texts])
        for t in texts:
            self.count_marked(t)
        return self.train(sentences)

    def train(self, sentences: list[str]) -> Spaceless:
        """Closing and opening counts and the gap classifier, when words and what stands inside marked sentences are known."""
        single = self.single(sentences)
        bare = [re.sub(r"[。！？!?｡.\s]+$", "", s) for s in single]
        bare = [s for s in bare if len(s) > 3]
        for s in bare:
            w = self.words(s)
            self.closing.update(self.keys(w, False))
            self.opening.update(self.keys(w, True))
            self.count_inner(w)
        rng = np.random.default_rng(4)
        xs, ys = [], []
        kinds: dict[str, list[str]] = {}
        for s in bare:
            kinds.setdefault(_script(s), []).append(s)
        # blanks mostly stand between sentences, and inside them around numbers
        for group in kinds.values():
            for s in group:
                w = self.words(s)
                for _ in range(max(8, len(w) // 2)):
                    other = group[int(rng.integers(len(group)))]
                    xs.append(self.features(s, other, bool(rng.random() < 0.8), 1, bool(rng.random() < 0.3)))
                    ys.append(1)
                at = 0
                for k in range(len(w) - 1):
                    at += len(w[k])
                    blank = rng.random() < (0.5 if w[k + 1][:1].isdigit() or w[k][-1:].isdigit() else 0.1)
                    xs.append(self.features(s[:at], s[at:] + group[int(rng.integers(len(group)))], bool(blank), 0, bool(rng.random() < 0.3)))
                    ys.append(0)
        if xs:
            self.model.fit(np.array(xs, float), np.array(ys, float))
        return self

    def ends(self, left: str, right: str, blank: bool) -> float:
        """Probability that a sentence ends between left and right."""
        f = self.features(left, right, blank)
        if self.model.nodes:
            key = tuple(f)
            if key not in self.judged:
                if len(self.judged) > 100_000:
                    self.judged.clear()
                self.judged[key] = float(self.model.predict(np.array([f], float))[0])
            return self.judged[key]
        return 0.7 if (f[5] or f[6]) and not f[7] else 0.3

    def gaps(self, text: str, lo: int, hi: int) -> list[tuple[int, float]]:
        """(position, score) of the unmarked gaps of text[lo:hi], which score above 0 if they end a sentence.

        Blanks between words are gaps, in kana and Han, where titles have blanks too, only after a closing particle; so are word
        boundaries within a stretch that has neither mark nor blank, if a closing particle stands before and none of GOING_ON behind.
        """
        out = []
        prev = lo
        spans = list(_BLANK_GAP.finditer(text, lo, hi))
        for m in spans:
            if "\u3040" <= text[m.end()] and not text[prev:m.start()].endswith(FINAL):
                continue
            p = self.ends(text[prev:m.start()], text[m.end():min(hi, m.end() + 64)], True)
            out.append((m.start(), 6 * (p - 0.5)))
            if p > 0.5:
                prev = m.end()
        if not spans and not _MARKED.search(text, lo, hi - 1) and _HAS.search(text, lo, hi):
            w, at = self.words(text[lo:hi]), lo
            prev = lo
            for k in range(len(w) - 1):
                at += len(w[k])
                if text[prev:at].endswith(FINAL) and not text.startswith(GOING_ON, at):
                    p = self.ends(text[prev:at], text[at:min(hi, at + 64)], False)
                    out.append((at, 6 * (p - 0.5)))
                    if p > 0.5:
                        prev = at
        return out


def _script(s: str) -> str:
    if re.search("[\u3040-\u30ff]", s):
        return "kana"
    c = _HAS.search(s).group()
    return "han" if "\u3400" <= c else str(ord(c) >> 7)
