"""Language labels in their many spellings, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a language label (lower case; a country after - or _ is dropped first) to the label.
SPELLINGS = {
    "hi": "hi", "hin": "hi", "hindi": "hi",
    "en": "en", "eng": "en", "english": "en",
    "hinglish": "hinglish", "hi-latn": "hinglish",
    "mixed": "mixed",
    "mr": "mr", "mar": "mr", "marathi": "mr",
    "bn": "bn", "ben": "bn", "bengali": "bn", "bangla": "bn",
    "ur": "ur", "urd": "ur", "urdu": "ur",
    "ta": "ta", "tam": "ta", "tamil": "ta",
    "ja": "ja", "jpn": "ja", "japanese": "ja",
    "zh": "zh", "zho": "zh", "chi": "zh", "chinese": "zh",
    "th": "th", "tha": "th", "thai": "th",
}


def label(column: str | Column) -> Column:
    """Canonical label; null for null, blank and 'und'; any other spelling is returned in lower case."""
    c = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    c = F.when(c == "hi-latn", c).otherwise(F.regexp_replace(c, "[-_][a-z]{2}$", ""))
    known = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.when(c.isin("", "und"), None).otherwise(F.coalesce(F.try_element_at(known, c), c))
