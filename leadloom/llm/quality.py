"""Statistics of a text's quality, and fixed rules that tell prose from lists, tables and junk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the common-word table at most; they go to the tasks with the function.
MOST_COMMON_WORDS = 20_000
# The published thresholds of web-text filters for word lengths, symbols, bullets, ellipses and
# alphabetic words, and those for punctuated and short lines, with the length of a short line.
MEAN_WORD_LENGTH = (3.0, 10.0)
MOST_SYMBOLS = 0.1
MOST_BULLETS = 0.9
MOST_ELLIPSES = 0.3
LEAST_ALPHABETIC = 0.8
LEAST_PUNCTUATED = 0.12
MOST_SHORT_LINES = 0.67
SHORT_LINE = 30
#: Least share of common words. The published rule asks for two stop words in a text of 50 words or more; here texts
#: are short and the table of common words has some sixty a language, so it is a share.
LEAST_COMMON_SHARE = 0.18
STATISTICS = {
    "n_chars": "int", "n_words": "int", "mean_word_length": "double", "symbol_ratio": "double", "n_lines": "int", "punctuated_lines": "double", "bullet_lines": "double",
    "ellipsis_lines": "double", "short_lines": "double", "alphabetic_words": "double", "common_words": "double",
}

_BETWEEN_WORDS, _BETWEEN_LINES, _BLANK = r"[^\p{L}\p{M}\p{N}]+", "[\\r\\n\u2028\u2029]+", r"^\s*$"
_NO_SYMBOL = r"[\p{L}\p{M}\p{N}\s.,;:!?'’‘\"“”«»()\-–—¿¡]"
_PUNCTUATED, _ELLIPSIS, _BULLET = r"[.!?…][\"”’»)\]]*\s*$", r"(?:…|\.\.\.)\s*$", r"^\s*(?:[-*•·‣◦▪]|\d{1,3}[.)])\s"


def common_words(words: DataFrame) -> dict[str, list[str]]:
    """The words of each language from a table (lang, word) of bounded size."""
    rows = words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["word"])
    return {k: sorted(v) for k, v in sorted(out.items())}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


class _Pieces:
    """The pieces of a batch of texts in one flat array, and counts of them by text."""

    def __init__(self, texts: pa.Array, between: str, empty: str):
        lists = pc.split_pattern_regex(texts, between)
        flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        filled = pc.invert(pc.match_substring_regex(flat, empty))
        self.flat, self.owner, self.texts = flat.filter(filled), owner.filter(filled).to_numpy(zero_copy_only=False), len(texts)
        self.n = np.bincount(self.owner, minlength=self.texts)

    def count(self, test: pa.Array) -> np.ndarray:
        return np.bincount(self.owner[test.to_numpy(zero_copy_only=False)], minlength=self.texts)

    def total(self, amounts: pa.Array) -> np.ndarray:
        return np.bincount(self.owner, amounts.to_numpy(zero_copy_only=False), minlength=self.texts)


def _batch_statistics(texts: pa.Array, common: dict[str, list[str]]) -> pa.Array:
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    words, lines = _Pieces(pc.utf8_lower(t), _BETWEEN_WORDS, "^$"), _Pieces(t, _BETWEEN_LINES, _BLANK)
    count = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False)
    visible = count(pc.replace_substring_regex(t, r"\s", ""))
    symbols = count(pc.replace_substring_regex(t, _NO_SYMBOL, ""))
    hits = [words.count(pc.is_in(words.flat, pa.array(ws, pa.large_string()))) for ws in common.values()]
    best = np.max(hits, axis=0) if hits else np.zeros(len(t))
    of_lines = lambda pattern: _share(lines.count(pc.match_substring_regex(lines.flat, pattern)), lines.n)
    values = [
        count(t), words.n, _share(words.total(pc.utf8_length(words.flat)), words.n), _share(symbols, visible), lines.n, of_lines(_PUNCTUATED), of_lines(_BULLET), of_lines(_ELLIPSIS),
        _share(lines.count(pc.less_equal(pc.utf8_length(lines.flat), SHORT_LINE)), lines.n), _share(words.count(pc.match_substring_regex(words.flat, r"\p{L}")), words.n), _share(best, words.n),
    ]
    kinds = {"int": pa.int32(), "double": pa.float64()}
    return pa.StructArray.from_arrays([pa.array(v, kinds[k]) for v, k in zip(values, STATISTICS.values())], names=list(STATISTICS))


def text_statistics(df: DataFrame, text_col: str, common: dict[str, list[str]]) -> DataFrame:
    """`df` with a struct column `stats` of the whole text, counted for a batch of texts at once.

    Words are runs of letters and digits. The share of common words is that of the language in which it is
    highest, so a missing or wrong language label doesn't matter. NULL texts count as empty; in an empty
    text all counts and shares are 0. A column `stats` that is there already is replaced.
    """

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {k}" for n, k in STATISTICS.items()) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        return _batch_statistics(texts, common)

    return df.withColumn("stats", measure(F.col(text_col).cast("string")))


#: Rules that fail a text alone, and those of its layout, which prose without marks or in short lines breaks too: they fail it together.
DECISIVE = ("few common words", "word length", "symbols", "bullets", "ellipses", "few alphabetic words")
LAYOUT = ("unpunctuated lines", "short lines")


def failures(stats: Column) -> Column:
    """Names of the rules that a text fails, in order; an empty text fails `empty` alone, one without words `few common words`."""
    s = stats
    tests = {
        "few common words": s["common_words"] < LEAST_COMMON_SHARE,
        "word length": ~s["mean_word_length"].between(*MEAN_WORD_LENGTH),
        "symbols": s["symbol_ratio"] > MOST_SYMBOLS,
        "bullets": s["bullet_lines"] > MOST_BULLETS,
        "ellipses": s["ellipsis_lines"] > MOST_ELLIPSES,
        "few alphabetic words": s["alphabetic_words"] < LEAST_ALPHABETIC,
        "unpunctuated lines": s["punctuated_lines"] <= LEAST_PUNCTUATED,
        "short lines": s["short_lines"] >= MOST_SHORT_LINES,
    }
    failed = F.array_compact(F.array(*[F.when(tests[name], F.lit(name)) for name in (*DECISIVE, *LAYOUT)]))
    return F.when(s["n_words"] == 0, F.when(s["n_chars"] == 0, F.array(F.lit("empty"))).otherwise(F.array(F.lit("few common words")))).otherwise(failed)


def is_prose(reasons: Column) -> Column:
    """Whether a text, also an empty one, fails no decisive rule and not all of its layout's; the recorded reasons tell which."""
    return ~(F.arrays_overlap(reasons, F.array(*[F.lit(n) for n in DECISIVE])) | (F.size(F.array_intersect(reasons, F.array(*[F.lit(n) for n in LAYOUT]))) == len(LAYOUT)))
