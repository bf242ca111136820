"""Text functions of the knowledge base, as column expressions; only Unicode normalisation leaves the JVM.

Nulls give null (detect_language: 'en', as for a text without letters).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- fixed values: character classes and word lists ------------------------------------------------------------------------
DEVA = r"\x{900}-\x{963}\x{966}-\x{97F}"
TOKEN = rf"[a-z0-9\x{{C0}}-\x{{24F}}]+|[{DEVA}]+"
DIGITS = r"^[0-9\x{966}-\x{96F}]+$"
#: Blanks other than the line feed.
HBLANK = r" \t\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SIGNS = r"\x{900}-\x{903}\x{93A}-\x{94F}\x{955}-\x{957}\x{962}\x{963}"
HINGLISH = [
    "hai", "hain", "kya", "kaise", "kaisa", "kyun", "kyon", "nahi", "nahin", "mein", "mujhe", "hum", "aap", "tum", "ka", "ki", "ke", "ko", "se",
    "aur", "bhi", "kab", "kahan", "kitna", "kitne", "kaun", "wala", "wali", "liye", "yeh", "ye", "woh", "vo", "tha", "thi", "hota", "hoti", "karna",
    "karne", "kare", "batao", "bataiye", "chahiye", "sakta", "sakte", "milega", "milta", "yojana", "sarkar", "paisa", "kaam",
]
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "of", "to", "in", "on", "for", "and", "or", "with", "by", "at", "from", "as", "that",
    "this", "it", "its", "what", "which", "who", "how", "do", "does", "did", "can", "i", "me", "my", "you", "your", "we", "our", "है", "हैं", "था",
    "थी", "थे", "का", "की", "के", "को", "में", "से", "पर", "और", "या", "भी", "यह", "वह", "ये", "वे", "एक", "तो", "ही", "कि", "क्या", "कैसे", "लिए",
    "हो", "होता", "होती", "कर", "करें", "किया", "गया", "गई", "इस", "उस", "जो", "ने", "ka", "ki", "ke", "ko", "se", "hai", "hain", "aur", "mein",
]
#: Frequent Hindi words as a legacy font spells them in Latin letters, and signs it uses inside words.
LEGACY_WORDS = [
    "dk", "ds", "dh", "esa", "gS", "gSa", "vkSj", "fd", "dks", "ls", "ij", "gsrq", "}kjk", "fy,", "rFkk", ",oa", "uke", "fd;k", "tk,xkA", "gksxkA",
    "dj", "Hkh",
]
#: Signs at the edges of a word that don't count as part of it (a legacy word that has one of them at an edge can't be met).
EDGES = ".,:()\"'"
_LEGACY = [w for w in LEGACY_WORDS if w.strip(EDGES) == w]
#: One such word between blanks, with signs around it; the first two conditions only save time.
LEGACY_WORD = (
    rf"(?=[{EDGES}{''.join(sorted({w[0] for w in _LEGACY}))}])(?<![!-~])(?<![^{HBLANK}\n])[{EDGES}]*+"
    rf"(?:{'|'.join(re.sub(r'([^A-Za-z0-9])', r'\\\1', w) for w in _LEGACY)})[{EDGES}]*+(?![^{HBLANK}\n])"
)
LEGACY_INNER = r"[A-Za-z][;|}{\]\[~`][A-Za-z]|%&|[\x{BC}\x{BD}]"

SEP = "\x1e"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize(c: str | Column) -> Column:
    """Canonical composition, no zero-width signs, LF line ends, words rejoined over hyphen breaks, single blanks, trimmed lines."""
    x = nfc(_col(c))
    x = F.regexp_replace(x, r"[\x{200B}\x{2060}\x{FEFF}]", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    x = F.regexp_replace(x, r"[ \t\x{A0}]+", " ")
    x = F.regexp_replace(x, rf"[{HBLANK}]*\n[{HBLANK}]*", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, rf"^[{HBLANK}\n]+|[{HBLANK}\n]+$", "")


def detect_language(c: str | Column) -> Column:
    """hi, mixed, hinglish or en, by the share of Devanagari letters and then of romanised Hindi function words."""
    t = F.coalesce(_col(c), F.lit(""))
    deva, latin = F.regexp_count(t, F.lit(f"[{DEVA}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    words = F.regexp_extract_all(F.lower(t), F.lit("([a-z]+)"), F.lit(1))
    marks = F.size(F.filter(words, lambda w: w.isin(HINGLISH)))
    share = deva / F.nullif(deva + latin, F.lit(0))
    return F.when(share >= 0.6, "hi").when(share >= 0.15, "mixed").when((F.size(words) > 0) & (marks / F.nullif(F.size(words), F.lit(0)) >= 0.2), "hinglish").otherwise("en")


def tokens(c: str | Column) -> Column:
    """Lexical tokens: numbers of any length, other words of two characters and more that aren't stop words."""
    x = F.regexp_replace(nfc(F.lower(_col(c))), r"[\x{200C}\x{200D}]", "")
    found = F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda w: w.rlike(DIGITS) | ((F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def sentences(c: str | Column) -> Column:
    """Sentence parts of a normalised text. Whether a line opens a part depends on that line alone (short, bullet or number),
    so one look-ahead replaces the fold over lines."""
    x = F.regexp_replace(_col(c), rf"(?<=[.!?।॥])[{HBLANK}\n]+|\n{{2,}}", SEP)
    x = F.regexp_replace(x, rf"\n(?=[^\n{SEP}]{{1,39}}(?:[\n{SEP}]|$)|[-•*]|\p{{Nd}}{{2}}|\p{{Nd}}\.)", SEP)
    parts = F.split(F.regexp_replace(x, r"\n", " "), SEP)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def repair_devanagari(c: str | Column) -> Column:
    """A vowel sign or mark that a text layer repeats within a syllable stands once."""
    x = F.regexp_replace(_col(c), r"([\x{93E}-\x{94C}\x{962}\x{963}])([\x{900}-\x{903}\x{93C}\x{94D}]*)\1+", "$1$2")
    return F.regexp_replace(x, r"([\x{900}-\x{903}\x{93C}])\1+", "$1")


def looks_garbled(c: str | Column) -> Column:
    """At least ten Devanagari words, and signs at word starts for more than one in twenty."""
    t = F.coalesce(_col(c), F.lit(""))
    words = F.regexp_count(t, F.lit(rf"[\x{{900}}-\x{{97F}}][^{HBLANK}\n]*"))  # each from its first Devanagari sign
    orphans = F.regexp_count(t, F.lit(rf"(?=[\x{{900}}-\x{{963}}])(?<![^{HBLANK}\n])[{SIGNS}]"))
    return F.when(orphans == 0, F.lit(False)).otherwise((words >= 10) & (orphans / F.nullif(words, F.lit(0)) > 0.05))


def looks_legacy_font(c: str | Column) -> Column:
    """Twenty words or more in the first 8,000 characters, and legacy-font words and signs for more than six in a hundred."""
    t = F.substring(F.coalesce(_col(c), F.lit("")), 1, 8000)
    signs = F.regexp_count(t, F.lit(LEGACY_WORD)) + F.regexp_count(t, F.lit(LEGACY_INNER))
    words = n_words(t)
    return F.when(signs == 0, F.lit(False)).otherwise((words >= 20) & (signs / F.nullif(words, F.lit(0)) > 0.06))


def n_words(c: str | Column) -> Column:
    return F.regexp_count(_col(c), F.lit(rf"[^{HBLANK}\n]+"))
