"""Sizes of texts in tokens of a public tokenizer (problems 7 and 8). The vocabulary file is a parameter and is only read."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary splits text before merging: letters, numbers, other signs, blanks (the well-known public pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest stretch handed to the tokenizer at once; texts are cut before a blank so that no token changes.
STRETCH = 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str) -> int:
    enc, n = encoder(path), 0
    while len(text) > STRETCH:
        at = text.rfind(" ", STRETCH // 2, STRETCH)
        at = at if at > 0 and text[at - 1] != " " else STRETCH
        n += len(enc.encode_ordinary(text[:at]))
        text = text[at:]
    return n + len(enc.encode_ordinary(text))


def with_tokens(documents: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """documents plus n_tokens (long). A null text has 0 tokens, as an empty one."""

    @F.pandas_udf("long")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda t: count(t, path) if t else 0).astype("int64")

    return documents.withColumn("n_tokens", tokens(text))
