"""Problem 6: text that was decoded with the wrong encoding.

A garbled record is found through a table of garbled forms: every distinct clean run of non-ASCII characters in the corpus
(a word, a sign or a mark; ASCII is the same in all these encodings) is encoded and wrongly decoded along every chain,
and the runs of all records are hash-joined with these forms. Matches give the verified original of each run. Only runs made of
characters that wrong decoding can produce take part in the join, so clean text in any script costs one scan.

Two losses leave no word to join: a UTF-16 reading merges ASCII bytes across word ends, so such runs are turned back as a
whole and accepted if every byte is printable ASCII or valid UTF-8; a replacement character shows wrong decoding by itself
and is not restorable unless a form that lost the same bytes is known.

Null and empty fields are never garbled. Forms that several clean words share are settled by the word's frequency, then by order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granth.runtime import materialise

RUN = r"[^\x00-\x7F]+"
#: Encodings that text in UTF-8 is often read with, and how undefined bytes are treated (fixed values).
READ_AS = (("cp1252", "control"), ("cp1252", "replace"), ("latin-1", "strict"), ("mac_roman", "strict"), ("cp437", "strict"), ("cp850", "strict"), ("cp1250", "control"), ("cp1251", "control"), ("cp1254", "control"), ("iso8859-15", "strict"))
#: Misreadings that may follow one another; they need not be the same.
DEPTH = 2
#: Characters of forms that a task holds at once, besides those of one run.
FORM_CHARS = 1_000_000
REPLACEMENT = "�"


def _reader(encoding: str, errors: str) -> list[str]:
    """Character of each byte under an encoding; undefined bytes become control characters or the replacement character."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b) if errors == "control" else REPLACEMENT)
    return out


@lru_cache(maxsize=1)
def readers() -> list[list[str]]:
    return [_reader(e, m) for e, m in READ_AS]


@lru_cache(maxsize=1)
def _tables() -> list[dict[int, str]]:
    return [dict(enumerate(r)) for r in readers()]


def garble(word: str) -> list[tuple[str, int]]:
    """(form, depth) of a word under every chain of up to DEPTH misreadings, alike or different; the shortest chain counts."""
    out: dict[str, int] = {}
    level = [word]
    for depth in range(1, DEPTH + 1):
        further: dict[str, None] = {}
        for w in level:
            raw = w.encode("utf-8", "surrogatepass").decode("latin-1")
            for t in _tables():
                f = raw.translate(t)
                if f == w or f in out:
                    continue
                out[f] = depth
                if REPLACEMENT not in f:
                    further[f] = None
        level = list(further)
    return list(out.items())


#: Blocks that hold everything non-ASCII that a reader can produce (a coarse filter; the join decides).
PRODUCED = r"\x{80}-\x{24F}\x{2C6}-\x{2DD}\x{370}-\x{45F}\x{490}\x{491}\x{2010}-\x{203A}\x{2044}\x{207F}\x{20A0}-\x{20BF}\x{2116}-\x{22FF}\x{2310}-\x{2321}\x{2500}-\x{25FF}\x{F8FF}\x{FB01}\x{FB02}\x{FFFD}"


#: Characters that a UTF-16 reading of two ASCII bytes gives: both bytes of the code unit are in 0x0A-0x7E.
UTF16_RUN = r"(?:[\x{2000}-\x{7EFF}&&[^\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3000}-\x{30FF}]][^\x00-\x7F]{3,})"


def turn_utf16(run: str) -> str | None:
    """Text whose bytes were read as UTF-16, or None if the run isn't one. A lost last byte is dropped."""
    for order in ("utf-16-le", "utf-16-be"):
        raw = run.encode(order, "surrogatepass").rstrip(b"\x00")
        if all(0x20 <= b < 0x7F or b in (9, 10, 12, 13) for b in raw):
            return raw.decode("ascii")
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if s.isprintable() and " " in s:
            return s
    return None


def _runs(records: DataFrame) -> Column:
    return F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1))


def garbled_forms(records: DataFrame) -> DataFrame:
    """(form, original, depth, n) for every distinct clean run of the records; n is the original's frequency.

    Runs of four or more characters that are all producible are garbled themselves and make no forms.
    """
    clean = records.select(F.explode(_runs(records)).alias("run")).where(~F.col("run").rlike(f"^[{PRODUCED}]{{4,}}$")).groupBy("run").agg(F.count("*").alias("n"))

    return clean.mapInPandas(forms, "form string, original string, depth int, n long")


def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """garbled_forms() of (run, n), in frames of about FORM_CHARS characters: the forms of a run of hundreds of characters are
    hundreds of times as long as it, and a batch of Arrow has thousands of runs."""
    rows: list[tuple[str, str, int, int]] = []
    held = 0
    for pdf in batches:
        for w, n in pdf.itertuples(index=False):
            for f, d in garble(w):
                rows.append((f, w, d, n))
                held += len(f)
            if held > FORM_CHARS:
                yield pd.DataFrame(rows, columns=["form", "original", "depth", "n"])
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=["form", "original", "depth", "n"])


def suspect_runs(records: DataFrame) -> DataFrame:
    """(tbl, rec_id, run) distinct: runs that wrong decoding can produce, in whole."""
    rows = records.where(F.col("text").rlike(f"[{PRODUCED}]{{2}}|{REPLACEMENT}") | F.col("text").rlike(UTF16_RUN))
    return rows.select("tbl", "rec_id", F.explode(F.array_distinct(_runs(rows))).alias("run")).where(F.col("run").rlike(f"^[{PRODUCED}]{{2,}}$") | F.col("run").contains(REPLACEMENT) | F.col("run").rlike(UTF16_RUN))


def resolve(records: DataFrame) -> DataFrame:
    """(tbl, rec_id, run, original, how): every wrongly decoded run of each record; original is null where it is lost.

    records: (tbl, rec_id, text). Runs are resolved once per distinct run. A clean run that happens to have a producible
    look (an accent, a quotation mark) has no preimage in the corpus and drops out. Originals that are themselves
    forms (double decoding) are followed to the clean word through the depth of the chain.
    """
    runs = materialise(suspect_runs(records), "runs")
    distinct = materialise(runs.select("run").dropDuplicates(), "distinct")
    match = distinct.join(garbled_forms(records), distinct.run == F.col("form")).groupBy("run").agg(F.min(F.struct("depth", (-F.col("n")).alias("n"), "original")).alias("best"))
    known = distinct.join(match, "run", "left").select("run", F.col("best.original").alias("original"))

    @F.pandas_udf("struct<original string, how string>")
    def settle(run: pd.Series, original: pd.Series) -> pd.DataFrame:
        out = []
        for r, o in zip(run, original):
            if isinstance(o, str):
                first = o
                for _ in range(DEPTH):  # an original that is garbled itself goes back along the same chain
                    back = ungarble(first)
                    if back is None:
                        break
                    first = back
                out.append((first, "form"))
            else:
                s = turn_utf16(r) if len(r) >= 4 else None
                if s is not None:
                    out.append((s, "utf16"))
                elif REPLACEMENT in r:
                    out.append((None, "lost"))
                else:
                    out.append((None, None))
        return pd.DataFrame(out, columns=["original", "how"])

    done = known.withColumn("s", settle("run", "original")).select("run", "s.original", "s.how").where("how IS NOT NULL")
    return runs.join(done, "run").select("tbl", "rec_id", "run", "original", "how")


@lru_cache(maxsize=1)
def _backs() -> list[dict[str, int]]:
    return [{c: b for b, c in enumerate(r) if c != REPLACEMENT} for r in readers()]


@lru_cache(maxsize=200_000)
def ungarble(word: str) -> str | None:
    """Clean reading of a form under one chain step, or None: only if re-encoding gives valid UTF-8 for letters or marks."""
    for back in _backs():
        raw = bytearray()
        for c in word:
            b = back.get(c)
            if b is None:
                break
            raw.append(b)
        else:
            try:
                s = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(s) < len(word) and not any(c < " " or c == "\x7f" for c in s):  # C1 controls stand in forms of forms
                return s
    return None


def found(records: DataFrame) -> DataFrame:
    return resolve(records).select("tbl", "rec_id").dropDuplicates()


def repair(records: DataFrame) -> DataFrame:
    """(tbl, rec_id, text, restored, lost) of every affected record, with known originals put in place of their runs."""
    per = resolve(records).groupBy("tbl", "rec_id").agg(F.collect_list(F.struct("run", "original")).alias("runs"))  # bounded by the record's own length
    both = per.join(records, ["tbl", "rec_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        pat = re.compile(RUN)
        for pdf in batches:
            out = []
            for tbl, rec, text, runs in pdf[["tbl", "rec_id", "text", "runs"]].itertuples(index=False):
                known = {r["run"]: r["original"] for r in runs}
                lost = sum(1 for m in pat.findall(text) if m in known and known[m] is None)
                good = sum(1 for m in pat.findall(text) if known.get(m) is not None)
                out.append((tbl, rec, pat.sub(lambda m: known.get(m.group()) or m.group(), text), good, lost))
            yield pd.DataFrame(out, columns=["tbl", "rec_id", "text", "restored", "lost"])

    return both.mapInPandas(run, "tbl string, rec_id long, text string, restored int, lost int")


def records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The two fields that may be garbled, as (tbl, rec_id, text); only texts with non-ASCII characters."""
    a = chunks.select(F.lit("chunks").alias("tbl"), F.col("id").alias("rec_id"), "text")
    b = documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), F.col("warnings").alias("text"))
    return a.unionByName(b).where(F.col("text").rlike(RUN))


def restore_text(text: str) -> str:
    """Text with every producible run turned back along its chain as far as it goes, without a corpus: for readers that
    only need the language meant. Lost bytes are left out. Other operators use the verified originals of resolve()."""
    import re

    if text.isascii() or not _MAYBE().search(text):
        return text

    def turn(m: re.Match) -> str:
        run = m.group()
        if len(run) >= 4:
            s = turn_utf16(run)
            # letters from U+0920 to U+097E also have two ASCII bytes each
            if s is not None and (not s.isascii() or _UTF16().search(run)):
                return s
        for _ in range(DEPTH):
            back = ungarble(run)
            if back is None:
                back = _ungarble_lossy(run) if REPLACEMENT in run else None
            if back is None:
                break
            run = back
        return run

    return re.sub(RUN, turn, text)


def _ungarble_lossy(word: str) -> str | None:
    for back in _backs():
        if all(c == REPLACEMENT or c in back for c in word):
            s = bytes(back[c] for c in word if c != REPLACEMENT).decode("utf-8", "ignore")
            if s and len(s) < len(word):
                return s
    return None


def _python(pattern: str) -> str:
    """Code points of a Java pattern as Python's re writes them."""
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", pattern)


@lru_cache(maxsize=1)
def _UTF16():
    """UTF16_RUN for Python, which has no intersection of classes."""
    import re

    first, but, rest = re.fullmatch(r"\(\?:\[(.+)&&\[\^(.+)\]\](\[.+)\)", UTF16_RUN).groups()
    return re.compile(_python(f"(?![{but}])[{first}]{rest}"))


@lru_cache(maxsize=1)
def _MAYBE():
    import re

    span = _python(PRODUCED)
    return re.compile(f"[{span}]{{2}}|{REPLACEMENT}|[\u2e80-\u9fff][^\\x00-\\x7F]{{3}}")
