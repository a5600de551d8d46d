"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary cuts a text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the parts in which a text is encoded that the encoder refuses as a whole.
PART = 20_000


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(encoding, text: str) -> int:
    text = text.encode("utf-8", "replace").decode("utf-8")
    try:
        return len(encoding.encode_ordinary(text))
    except Exception:  # noqa: BLE001  # the encoder's own limits, on runs of a million equal characters
        return sum(len(encoding.encode_ordinary(text[i : i + PART])) for i in range(0, len(text), PART))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for an empty text, NULL for NULL."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in batches:
            yield pd.Series([None if t is None else _count(encoding, t) for t in texts], dtype="Int64")

    return count(text)
