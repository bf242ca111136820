"""Problem 5: language of every record and of every segment of it.

A bidirectional gated recurrent network reads the letters of a text as bytes (low bytes, with the high byte wherever it
changes within a word, and one blank between words), is trained in numpy by backpropagation through time, and labels every
position. A record is read in pieces: stretches of one script within a sentence; wrapped lines go on. The position
posteriors of a piece are pooled, and those of all its pieces of one script make the record's probabilities there.

Every piece takes the language that its record has in its script, unless the network is sure of another over a whole
sentence (CLEAR, STATEMENT): scraps do not make a text mixed. A few words in a script of their own (names, codes, loan words)
belong to the sentence around them. A record is 'mixed' if two languages each hold at least a fifth of its letters.

Training uses the trusted sentences plus a bounded sample of stored labels (WEAK_ROWS rows a label and table, at most
WEAK_SENTENCES of their sentences a label, both by hash order), without those that it contradicts. A part of the training strings
are joins of two sentences, so that labels belong to positions. Everything else covers all rows.

Texts that were decoded wrongly are turned back before they are read. Null texts and texts without letters have language
null, confidence 0 and no segments.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granth.functions.labels import label
from granth.llm.encoding import restore_text

LANGS = ("hi", "en", "hinglish", "mr", "bn", "ur", "ta", "ja", "zh", "th")
MIXED_SHARE = 0.2
#: Bound of the labelled sample: so many rows a stored label and table, and so many of their sentences a label: the second
#: figure for languages that share their script with another one, which have more to learn.
WEAK_ROWS = 100
WEAK_SENTENCES = (120, 700)
KIN = {"hi", "mr", "en", "hinglish", "ja", "zh"}
HIDDEN = 20
WINDOW = 160
#: Epochs over the trusted sentences, the weak ones, and the weak ones that are left.
EPOCHS = (14, 2, 4)
#: Share of the training strings that are joined to one of another language, for position labels.
JOINED = 0.15
#: A weak text is dropped as a whole only if it has so many pieces; a weak sentence stays if its label has this share of its letters.
SEVERAL = 3
DOUBT = 0.3
#: Another language within one script: least probability of the piece's pooled positions, and least letters.
CLEAR = 0.9
STATEMENT = 30
#: Words that a run in another script needs to count as that script's language, and letters if it has fewer words.
RUN_WORDS, RUN_LETTERS = 4, 16
#: Byte strings of pieces whose result a worker keeps.
CACHE = 400_000
BLANK_BYTE = 0x20

_ENDS = "!?।॥۔؟。！？|\f"
_SOFT_ENDS = re.compile(r"(?<=[^\W\d_]{4})\.(?=[\"'”’)\]]*\s)|\n[^\S\n]*\n|(?<=[.:])\n")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point below 65,536: 0 other, 1 letter or mark, 2 sentence end; and its script block (0 for Latin)."""
    kind, script = np.zeros(65536, np.int8), np.zeros(65536, np.int16)
    for o in range(65536):
        cat = unicodedata.category(chr(o))[0]
        if cat in "LM":
            kind[o] = 1
    for c in _ENDS:
        kind[ord(c)] = 2
    for lo, hi, n in ((0x370, 0x52F, 1), (0x590, 0x5FF, 2), (0x600, 0x8FF, 3), (0x900, 0x97F, 4), (0x980, 0x9FF, 5), (0xA00, 0xDFF, 6), (0xE00, 0xEFF, 7), (0xF00, 0x1FFF, 8), (0x2E80, 0xD7FF, 9)):
        script[lo:hi + 1] = n
    script[0xB80:0xC00] = 10
    return kind, script


def encode(texts: list[str]) -> dict[str, np.ndarray]:
    """Bytes, words and pieces of texts, as flat arrays.

    data: bytes; word_at: byte where each word starts; word_letters, word_seg: its letters and piece; seg_rec, seg_script,
    seg_words, seg_letters, seg_lo, seg_hi: record, script, size and character range of each piece.
    """
    kind_of, script_of = _classes()
    joined = "\n".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    low = np.minimum(cp, 65535).astype(np.int64)
    kind = kind_of[low]
    letter = kind == 1
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(w0):
        z = np.zeros(0, np.int64)
        return {k: z for k in ("data", "word_at", "word_letters", "word_seg", "seg_rec", "seg_script", "seg_words", "seg_letters", "seg_lo", "seg_hi")}
    rec = np.searchsorted(starts, w0, "right") - 1
    script = script_of[low[w0]].astype(np.int64)
    end = kind == 2
    end[[m.start() for m in _SOFT_ENDS.finditer(joined)]] = True
    ends = np.cumsum(end)
    fresh = np.ones(len(w0), bool)
    fresh[1:] = (rec[1:] != rec[:-1]) | (script[1:] != script[:-1]) | (ends[w0[1:]] != ends[w1[:-1] - 1])
    seg = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(w0) - 1]])
    at_char = np.flatnonzero(letter)
    c = cp[at_char]
    word_no = np.repeat(np.arange(len(w0)), w1 - w0)
    high = (c >> 8).astype(np.int64)
    turn = np.concatenate([[True], (high[1:] != high[:-1]) | (word_no[1:] != word_no[:-1])]) & ((high > 0) | (np.concatenate([[0], high[:-1]]) > 0) & (np.concatenate([[-1], word_no[:-1]]) == word_no))
    size = 1 + turn
    pos = np.cumsum(size) - 1 + word_no
    word_first = np.concatenate([[0], np.cumsum(w1 - w0)[:-1]])
    word_at = pos[word_first] - turn[word_first]
    data = np.full(pos[-1] + 2, BLANK_BYTE, np.uint8)
    data[pos] = np.where((c >= 65) & (c <= 90), c + 32, c) & 0xFF
    data[pos[turn] - 1] = high[turn]
    letters = w1 - w0
    return {"data": data, "word_at": word_at, "word_letters": letters, "word_seg": seg, "seg_rec": rec[first], "seg_script": script[first], "seg_words": last - first + 1, "seg_letters": np.add.reduceat(letters, first), "seg_lo": w0[first] - starts[rec[first]], "seg_hi": w1[last] - starts[rec[first]]}


def _squash(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place, d is scratch: the network's bounded activation, several times cheaper than tanh; its slope is (1 - |y|)^2."""
    np.abs(x, out=d)
    d += 1
    x /= d
    return x


class BiGRU:
    """Two gated recurrent layers over bytes, in opposite directions, and a softmax over languages at every position.

    Both directions run as one stacked computation: index 0 reads forwards, index 1 backwards.
    """

    def __init__(self, hidden: int = HIDDEN, classes: int = len(LANGS), seed: int = 3):
        rng = np.random.default_rng(seed)
        h = hidden
        self.p: dict[str, np.ndarray] = {}
        for part in "zrc":  # update gate, reset gate, candidate
            self.p["x" + part] = (rng.standard_normal((2, 256, h)) * 0.5).astype(np.float32)
            self.p["u" + part] = np.stack([np.linalg.qr(rng.standard_normal((h, h)))[0] for _ in range(2)]).astype(np.float32)
        self.p["xz"] += 1.5
        self.p["w"] = (rng.standard_normal((2 * h, classes)) * 0.1).astype(np.float32)
        self.p["b"] = np.zeros(classes, np.float32)
        self.cache: dict[bytes, np.ndarray] = {}

    def _forward(self, data: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (T, 2, B, h) of sequences (B, T), each direction at its text position; kept collects what backpropagation needs.

        Every array of a step is contiguous, so numpy runs long inner loops.
        """
        (n, t), h = data.shape, self.p["uz"].shape[1]
        cols = np.ascontiguousarray(data.T).astype(np.intp)
        tables = [(self.p["x" + k], self.p["u" + k]) for k in "zrc"]
        out = np.empty((t, 2, n, h), self.p["w"].dtype)
        state = np.zeros((2, n, h), out.dtype)
        z, r, c, a, d = (np.empty_like(state) for _ in range(5))
        for i in range(t):
            for (x, u), g in zip(tables, (z, r, c)):
                np.take(x[0], cols[i], axis=0, out=g[0], mode="clip")
                np.take(x[1], cols[t - 1 - i], axis=0, out=g[1], mode="clip")
                np.matmul(state, u, out=a)
                if g is not c:
                    g += a
                    _squash(g, d)
                    g += 1
                    g *= 0.5
            if kept is not None:
                kept.append((z.copy(), r.copy(), a.copy(), state))
            a *= r
            c += a
            _squash(c, d)
            if kept is not None:
                kept[-1] += (c.copy(),)
            state = state - c
            state *= z
            state += c
            out[i, 0], out[t - 1 - i, 1] = state[0], state[1]
        return out

    def _posterior(self, out: np.ndarray) -> np.ndarray:
        """(T, classes, B) probabilities of every position."""
        h = out.shape[3]
        logits = np.matmul(self.p["w"][:h].T, out[:, 0].transpose(0, 2, 1))
        logits += np.matmul(self.p["w"][h:].T, out[:, 1].transpose(0, 2, 1))
        logits += self.p["b"][:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def step(self, data: np.ndarray, want: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch: want and mask are (B, T)."""
        (n, t), h = data.shape, self.p["uz"].shape[1]
        kept: list = []
        out = self._forward(data, kept)
        prob = np.ascontiguousarray(self._posterior(out).transpose(0, 2, 1))
        wt, mt = want.T, mask.T.astype(prob.dtype)
        total = mt.sum() or 1.0
        picked = np.take_along_axis(prob, wt[:, :, None], 2)[:, :, 0]
        loss = float(-(np.log(picked + 1e-9) * mt).sum() / total)
        prob[np.arange(t)[:, None], np.arange(n)[None, :], wt] -= 1
        prob *= (mt / total)[:, :, None]
        flat = prob.reshape(-1, prob.shape[2])
        both = np.concatenate([out[:, 0], out[:, 1]], axis=2).reshape(-1, 2 * h)
        grads = {"w": both.T @ flat, "b": flat.sum(0)} | {"u" + k: np.zeros_like(self.p["uz"]) for k in "zrc"}
        dout = [np.ascontiguousarray(prob @ self.p["w"][lo:lo + h].T) for lo in (0, h)]
        back = {k: np.ascontiguousarray(self.p["u" + k].transpose(0, 2, 1)) for k in "zrc"}
        dh = np.zeros((2, n, h), prob.dtype)
        dx = {k: np.empty((t, 2, n, h), prob.dtype) for k in "zrc"}  # by time step of each direction
        for i in reversed(range(t)):
            z, r, an, prev, c = kept[i]
            dh[0] += dout[0][i]
            dh[1] += dout[1][t - 1 - i]
            dc = dh * (1 - z)
            dc *= (1 - np.abs(c)) ** 2
            dz = dh * (prev - c)
            dz *= 0.5 * (1 - np.abs(z * 2 - 1)) ** 2
            dr = dc * an
            dr *= 0.5 * (1 - np.abs(r * 2 - 1)) ** 2
            dx["z"][i], dx["r"][i], dx["c"][i] = dz, dr, dc
            dh *= z
            turned = prev.transpose(0, 2, 1)
            for k, v in (("z", dz), ("r", dr), ("c", dc * r)):
                grads["u" + k] += np.matmul(turned, v)
                dh += np.matmul(v, back[k])
        for k in "zrc":
            grads["x" + k] = np.zeros_like(self.p["xz"])
        for way, at in enumerate((data.T.reshape(-1), data.T[::-1].reshape(-1))):
            order = np.argsort(at, kind="stable")
            seen, first = np.unique(at[order], return_index=True)
            for k in "zrc":
                grads["x" + k][way, seen] = np.add.reduceat(dx[k][:, way].reshape(-1, h)[order], first, axis=0)
        return loss, grads

    def fit(self, strings: list[tuple[bytes, np.ndarray]], epochs: int, batch: int = 96, rate: float = 0.02, seed: int = 1) -> float:
        """Adam with clipped gradients over batches of (bytes, class of each byte) of like length; returns the last epoch's loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.cache.clear()
        k, mean = 0, 0.0
        steps = epochs * -(-len(strings) // batch)
        for _ in range(epochs):
            losses, order = [], rng.permutation(len(strings))
            lots = []
            for lo in range(0, len(order), 8 * batch):  # like lengths within a stretch of the shuffled order
                some = sorted(order[lo:lo + 8 * batch], key=lambda i: len(strings[i][0]))
                lots += [some[x:x + batch] for x in range(0, len(some), batch)]
            for j in rng.permutation(len(lots)):
                lot = [strings[i] for i in lots[j]]
                data, inside = _pad([b for b, _ in lot])
                want = np.zeros(data.shape, np.int64)
                for row, (_, y) in zip(want, lot):
                    row[:len(y)] = y
                loss, g = self.step(data, want, inside)
                losses.append(loss)
                k += 1
                lr = rate * (1 - 0.9 * k / steps)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for name, x in g.items():
                    x *= min(1.0, 1.0 / (norm + 1e-9))
                    m[name] += 0.1 * (x - m[name])
                    v2[name] += 0.01 * (x * x - v2[name])
                    self.p[name] -= lr * (m[name] / (1 - 0.9**k)) / (np.sqrt(v2[name] / (1 - 0.99**k)) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    def pooled(self, keys: list[bytes], batch: int = 1024) -> np.ndarray:
        """Mean posterior of the positions of each byte string; strings seen before are not read again."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.cache]
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = list(dict.fromkeys(keys))
        parts = sorted(((k[lo:lo + WINDOW], k) for k in fresh for lo in range(0, len(k), WINDOW)), key=lambda x: len(x[0]))
        sums: dict[bytes, np.ndarray] = {}
        for lo in range(0, len(parts), batch):
            lot = parts[lo:lo + batch]
            data, inside = _pad([b for b, _ in lot])
            prob = self._posterior(self._forward(data))
            prob *= inside.T[:, None, :]
            for (_, k), v in zip(lot, prob.sum(0).T):
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            self.cache[k] = v / len(k)
        return np.stack([self.cache[k] for k in keys]) if keys else np.zeros((0, len(self.p["b"])), np.float32)

    def pieces(self, e: dict[str, np.ndarray]) -> np.ndarray:
        """(pieces, classes) probabilities of encoded texts, each piece read on its own."""
        return self.pooled(piece_bytes(e))


def piece_bytes(e: dict[str, np.ndarray]) -> list[bytes]:
    if not len(e["word_seg"]):
        return []
    first = np.flatnonzero(np.diff(np.concatenate([[-1], e["word_seg"]])))
    at = e["word_at"][first]
    raw, ends = e["data"].tobytes(), np.concatenate([at[1:], [len(e["data"])]])
    return [raw[a:b] for a, b in zip(at.tolist(), ends.tolist())]


def _pad(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(B, T) bytes padded with blanks, and which positions are inside."""
    n = np.array([len(b) for b in strings])
    t = int(n.max())
    data = np.frombuffer(b"".join(b.ljust(t, b" ") for b in strings), np.uint8).reshape(len(strings), t)
    return data, np.arange(t)[None, :] < n[:, None]


_CUT = re.compile(r"(?<=[!?।۔。！？])\s+|(?<=[^\W\d_]{3}[.])\s+|\n\s*\n")


def strings(samples: list[tuple[str, str]], seed: int = 5) -> list[tuple[bytes, np.ndarray]]:
    """Training strings with the class of every byte: the pieces of the sentences, but for scraps in another script than most
    of their sentence; a JOINED part of them is followed by another one."""
    rng = np.random.default_rng(seed)
    one = []
    for text, lang in samples:
        keys = piece_bytes(encode([text]))
        most = max(map(len, keys), default=0)
        one += [(k[lo:lo + WINDOW], LANGS.index(lang)) for k in keys if len(k) >= max(6, most // 3) for lo in range(0, len(k), WINDOW)]
    out = []
    for k, y in one:
        if rng.random() < JOINED:
            k2, y2 = one[int(rng.integers(len(one)))]
            out.append(((k + k2)[:WINDOW], np.array([y] * len(k) + [y2] * len(k2))[:WINDOW]))
        else:
            out.append((k, np.full(len(k), y)))
    return out


_MODELS: dict[str, BiGRU] = {}


def _order(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _pooled(net: BiGRU, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language in the letters of each text, its pieces)."""
    mass, pieces = np.zeros((len(texts), len(LANGS))), np.zeros(len(texts), np.int64)
    for lo in range(0, len(texts), 256):
        e = encode(texts[lo:lo + 256])
        np.add.at(mass, e["seg_rec"] + lo, net.pieces(e) * e["seg_letters"][:, None])
        np.add.at(pieces, e["seg_rec"] + lo, 1)
    return mass / np.maximum(mass.sum(1, keepdims=True), 1e-9), pieces


def train(trusted: list[tuple[str, str]], weak: list[tuple[str, str]], seed: int = 3) -> BiGRU:
    """Network from trusted (sentence, language) and weak (text, stored language).

    Trained on the trusted sentences, the network drops weak texts of several pieces that it takes for another language as a
    whole (a single sentence is too little to contradict a label); it goes on with the sentences of the others, drops those it
    then contradicts, and goes on with the rest. The trusted sentences take part throughout.
    """
    key = hashlib.blake2b(repr((sorted(trusted), sorted(weak), HIDDEN, EPOCHS)).encode("utf-8", "surrogatepass")).hexdigest()
    if key in _MODELS:
        return _MODELS[key]
    net = BiGRU(seed=seed)
    sure = strings(trusted)
    if sure:
        net.fit(sure, EPOCHS[0] if weak else 2 * EPOCHS[0], batch=32, rate=0.015)
    if weak:
        share, pieces = _pooled(net, [t for t, _ in weak])
        by: dict[str, dict[str, None]] = {}
        for (text, lang), m, n in zip(weak, share, pieces):
            if n < SEVERAL or m.argmax() == LANGS.index(lang):
                by.setdefault(lang, {}).update((s, None) for s in _CUT.split(text) if len(s) > 15)
        some = [(s, lang) for lang in sorted(by) for s in sorted(by[lang], key=_order)[: WEAK_SENTENCES[lang in KIN]]]
        net.fit(strings(some) + 4 * sure, EPOCHS[1])
        share, _ = _pooled(net, [s for s, _ in some])
        good = [x for x, m in zip(some, share) if m[LANGS.index(x[1])] >= DOUBT]
        net.fit(strings(good) + 2 * sure, EPOCHS[2])
    net.cache.clear()
    _MODELS[key] = net
    return net


def training_rows(trusted: DataFrame, labelled: DataFrame) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Trusted (sentence, language), and a bounded sample of the stored labels of (tbl, stored, text): the whole texts of the first
    WEAK_ROWS rows of each label and table, by hash."""
    good = trusted.select("text", label("lang").alias("lang")).where("text IS NOT NULL").dropDuplicates().where(F.col("lang").isin(*LANGS))
    sure = sorted((r.text, r.lang) for r in good.collect())  # the table of trusted sentences has a fixed size
    rows = labelled.select("tbl", label("stored").alias("lang"), "text").where(F.col("lang").isin(*LANGS) & (F.length("text") > 15)).withColumn("h", F.xxhash64("text"))
    top = rows.withColumn("k", F.row_number().over(W.partitionBy("tbl", "lang").orderBy("h", "text"))).where(F.col("k") <= WEAK_ROWS).select("text", "lang")
    return sure, sorted({(restore_text(r.text), r.lang) for r in top.collect()})


def settle(p: np.ndarray, e: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language of each piece, its confidence, letters by record and language) from the pieces' posteriors.

    Runs too short to count in their own script take the language of the piece before, or else after, them in their record.
    """
    k = p.shape[1]
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((n, k))
    rec, script, size = e["seg_rec"], e["seg_script"], e["seg_letters"].astype(float)
    group = rec * 64 + script
    _, at = np.unique(group, return_inverse=True)
    pool = np.zeros((at.max() + 1, k))
    np.add.at(pool, at, p * size[:, None])
    pool /= pool.sum(1, keepdims=True)
    main = pool.argmax(1)[at]
    own = p.argmax(1)
    rows = np.arange(len(p))
    sure = (own != main) & (p[rows, own] >= CLEAR) & (size >= STATEMENT)
    lang = np.where(sure, own, main)
    conf = np.where(sure, p[rows, own], pool[at, main])
    # runs of a script that are too short to be a statement, next to a longer one in another script
    long_ = (e["seg_words"] >= RUN_WORDS) | (size >= RUN_LETTERS)
    host = np.where(long_, rows, -1)
    before = np.maximum.accumulate(host)
    ok = (before >= 0) & (rec[np.maximum(before, 0)] == rec)
    after = len(p) - 1 - np.maximum.accumulate(np.where(long_[::-1], rows, -1))[::-1]
    after = np.where(after >= len(p), 0, after)
    ok2 = long_[after] & (rec[after] == rec)
    to = np.where(long_, rows, np.where(ok, before, np.where(ok2, after, rows)))
    lang, conf = lang[to], conf[to]
    mass = np.zeros((n, k))
    np.add.at(mass, (rec, lang), size)
    return lang, conf, mass


OUT = "tbl string, rec_id long, stored string, lang string, confidence double, segments array<struct<start_pos:int,end_pos:int,lang:string,confidence:double>>"


def judge(texts: list[str], net: BiGRU, with_segments: bool = False) -> tuple[list[str | None], np.ndarray, list[list[dict]]]:
    """Language, confidence and segments of each text."""
    n = len(texts)
    texts = [restore_text(t) if t else "" for t in texts]
    e = encode(texts)
    lang, conf, mass = settle(net.pieces(e), e, n)
    total = np.maximum(mass.sum(1), 1)
    weighed = np.zeros((n, len(LANGS)))
    np.add.at(weighed, (e["seg_rec"], lang), e["seg_letters"] * conf)
    top = np.sort(mass, axis=1)
    mixed = top[:, -2] >= MIXED_SHARE * total
    main = mass.argmax(1)
    sure = np.round(np.where(mixed, weighed.sum(1), weighed[np.arange(n), main]) / total, 6)
    segs: list[list] = [[] for _ in range(n)]
    if with_segments:
        for r, a, b, g, c in zip(e["seg_rec"].tolist(), e["seg_lo"].tolist(), e["seg_hi"].tolist(), lang.tolist(), conf.tolist()):
            s = segs[r]
            if s and s[-1]["lang"] == LANGS[g]:
                s[-1]["end_pos"], s[-1]["confidence"] = b, min(s[-1]["confidence"], round(c, 6))
            else:
                s.append({"start_pos": a, "end_pos": b, "lang": LANGS[g], "confidence": round(c, 6)})
    return [None if not top[i, -1] else "mixed" if mixed[i] else LANGS[main[i]] for i in range(n)], sure, segs


def identify(records: DataFrame, model: BiGRU, with_segments: bool = False) -> DataFrame:
    """(tbl, rec_id, stored, lang, confidence, segments) of (tbl, rec_id, stored, text). One pass, no shuffle.

    segments are merged where neighbours share a language; positions are those of the text after wrong decoding is undone.
    """
    weights = {k: (v.astype(np.float32).tobytes(), v.shape) for k, v in model.p.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = BiGRU()
        net.p = {k: np.frombuffer(v, np.float32).reshape(shape) for k, (v, shape) in weights.items()}
        for whole in batches:
            for pdf in _parts(whole):
                out = pdf[["tbl", "rec_id", "stored"]].copy()
                out["lang"], out["confidence"], out["segments"] = judge(pdf["text"].tolist(), net, with_segments)
                yield out

    return records.select("tbl", "rec_id", "stored", "text").mapInPandas(run, OUT)


def _parts(pdf: pd.DataFrame, chars: int = 400_000) -> Iterator[pd.DataFrame]:
    """Slices of a batch of at most about chars characters (a longer text is a slice of its own)."""
    size = pdf["text"].str.len().fillna(0).to_numpy()
    cut = (np.cumsum(size) // chars).astype(int)
    for _, part in pdf.groupby(cut, sort=True):
        yield part.reset_index(drop=True)


def wrong_labels(identified: DataFrame) -> DataFrame:
    """(tbl, rec_id, lang) of records whose stored label is missing or names another language."""
    stored = label("stored")
    return identified.where(F.col("lang").isNotNull() & (stored.isNull() | (stored != F.col("lang")))).select("tbl", "rec_id", "lang").dropDuplicates(["tbl", "rec_id"])
