"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; the file is read once in each worker.
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters that are encoded at a time; longer texts are cut before a blank.
_STRETCH = 100_000


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text of any length; strings of special tokens are ordinary text."""
    enc, n, lo = encoding(path), 0, 0
    while len(text) - lo > _STRETCH:
        hi = text.rfind(" ", lo + 1, lo + _STRETCH)
        hi = hi if hi > lo else lo + _STRETCH
        n += len(enc.encode_ordinary(text[lo:hi]))
        lo = hi
    return n + len(enc.encode_ordinary(text[lo:] if lo else text))


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text; 0 for null and empty ones."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) if t else 0 for t in texts], dtype="int64")

    return counted(text)
