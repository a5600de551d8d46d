"""One consistent form for texts that look alike, by a compiled longest-match transducer."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that look like a Latin one (fixed values).
LATIN_LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԍ": "g", "ԛ": "q", "ԝ": "w", "ѵ": "v", "Ѵ": "V", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ϱ": "p", "η": "n",
    # Armenian
    "Օ": "O", "Ս": "U", "Լ": "L", "Տ": "S", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "յ": "j", "ք": "p",
    # Latin letters of phonetic and other alphabets
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ɴ": "n", "ʀ": "r", "ʟ": "l", "ǃ": "!", "ſ": "s", "Ɩ": "I",
}
#: Dots and marks that other characters imitate belong to ordinary punctuation and are left alone.
_JOINERS = "͏ᅟᅠㅤ"
#: Latin letters of other alphabets among them; no text is truly written in these.
_PHONETIC = {c: x for c, x in LATIN_LOOKALIKES.items() if "ſ" >= c > "ÿ" or "ɏ" < c < "ʰ"}
_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("Latin", "Cyrillic", "Greek", "Armenian")}
_WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}]+")
_CLUSTER = regex.compile(r"\X")


def _script(c: str) -> str:
    return next((name for name, p in _SCRIPTS.items() if p.match(c)), "")


class Transducer:
    """Longest-match rewriting of whole grapheme clusters in one pass.

    Rules are held in a trie over code points. At each cluster boundary the longest rule that ends on a
    boundary applies, else the cluster stands. A rule with two results, or one whose result another rule
    would change, is refused when it is added or compiled.
    """

    def __init__(self, rules: dict[str, str]):
        self.rules = dict(rules)
        for key, value in self.rules.items():
            if not key:
                raise ValueError("empty rule")
            if any(k in value for k in value if k in self.rules) or (value in self.rules and self.rules[value] != value):
                raise ValueError(f"the result of {key!r} would be rewritten: {value!r}")
        self.root: dict = {}
        for key, value in self.rules.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            if node.setdefault("", value) != value:
                raise ValueError(f"two results for {key!r}")
        #: The characters that rules end with: a text without any of them stays.
        self.last = frozenset(key[-1] for key in self.rules)

    def __call__(self, text: str) -> str:
        if self.last.isdisjoint(text):
            return text
        ends = {m.end() for m in _CLUSTER.finditer(text)}
        out, i, n = [], 0, len(text)
        while i < n:
            node, j, best = self.root, i, None
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node and (j in ends or j == i + 1):
                    best = (j, node[""])
            if best:
                i = best[0]
                out.append(best[1])
            else:
                out.append(text[i])
                i += 1
        return "".join(out)


def _is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


#: Code points that can have another form: all but ideographs, syllables, surrogates and private use.
_RANGES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x10000), (0x10780, 0x107C0), (0x11000, 0x12000), (0x1BC00, 0x1BD00), (0x1D000, 0x1D800), (0x1EE00, 0x1EF00), (0x1F100, 0x1F300), (0x1FBF0, 0x1FC00), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


@cache
def form_rules() -> dict[str, str]:
    """Rules for widths, compatibility forms, decomposed accents, spaces and invisible characters, from Unicode's own data."""
    rules: dict[str, str] = {}
    for point in (p for a, b in _RANGES for p in range(a, b)):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind == "Zs":
            rules[c] = " "
        elif kind == "Cf" or c in _JOINERS or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            rules[c] = ""
        elif kind == "Mn" and c in "̷̸̶̵":
            continue
        else:
            parts = unicodedata.decomposition(c)
            if parts.startswith("<"):
                wide = parts.startswith(("<wide>", "<narrow>"))
                if wide or not _is_punctuation(c):
                    rules[c] = unicodedata.normalize("NFKC", c)
            elif parts:
                whole = unicodedata.normalize("NFD", c)
                composed = unicodedata.normalize("NFC", c)
                if composed != c:
                    rules[c] = composed
                if len(whole) > 1 and unicodedata.normalize("NFC", whole) == c:
                    rules[whole] = c
                    if len(whole) == 3 and len(unicodedata.normalize("NFC", whole[:2])) == 1:
                        rules[unicodedata.normalize("NFC", whole[:2]) + whole[2]] = c
    for c in ("\u2028", "\u2029"):
        rules[c] = " "
    for key, value in list(rules.items()):  # results in the end form
        for _ in range(4):
            changed = "".join(_PHONETIC.get(y, y) for x in value for y in rules.get(x, x))
            changed = unicodedata.normalize("NFC", changed)
            if changed == value:
                break
            value = changed
        rules[key] = value
        if value == key:
            del rules[key]
    return rules


@cache
def form_transducer() -> Transducer:
    return Transducer(form_rules())


def _borrowed(text: str) -> str:
    """The text with letters borrowed from other scripts replaced by those of the word's own script."""
    if LATIN_LOOKALIKES.keys().isdisjoint(text):
        return text
    own = Counter(_script(c) for c in text if c not in LATIN_LOOKALIKES)
    own.pop("", None)
    whole = own.most_common(1)[0][0] if own else ""

    def word(m: regex.Match) -> str:
        w = m.group()
        sure = Counter(s for c in w if c not in LATIN_LOOKALIKES and (s := _script(c)) and not (s == "Latin" and c in _REVERSE["Cyrillic"] | _REVERSE["Greek"]))
        seen = {s for c in w if (s := _script(c))}
        target = sure.most_common(1)[0][0] if sure else whole if whole else "Latin" if "Latin" in seen else ""
        if target == "Latin":
            return "".join(LATIN_LOOKALIKES.get(c, c) for c in w)
        if target in ("Cyrillic", "Greek") and len(seen) > 1:
            return "".join(_REVERSE[target].get(c, c) for c in w)
        return w

    return _WORD.sub(word, text)


_REVERSE: dict[str, dict[str, str]] = {name: {} for name in ("Cyrillic", "Greek")}
for _c, _latin in LATIN_LOOKALIKES.items():
    if (_s := _script(_c)) in _REVERSE:
        _REVERSE[_s].setdefault(_latin, _c)


def consistent(text: str) -> str:
    """The one form of a text: letters of its own script, standard widths, composed accents, plain spaces."""
    return text if text.isascii() else _consistent(text)  # no rule begins with an ASCII character alone


@lru_cache(20_000)
def _consistent(text: str) -> str:
    # what the rules leave side by side is composed: jamo, and marks after a letter that has changed its width or script
    mapped = unicodedata.normalize("NFC", form_transducer()(text))
    return unicodedata.normalize("NFC", _borrowed(mapped))


def consistent_form(c: Column) -> Column:
    """The consistent form of a column; NULL for NULL. Texts of ASCII only are theirs already and stay in the JVM."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else consistent(t) for t in texts], dtype=object)

    text = c.cast("string")
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(convert(other), text)


def inconsistent_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, value, form) of the values that differ from their consistent form. NULL values don't."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    d = df.select(key, pairs).select(key, "p.field_name", "p.value").where(F.col("value").isNotNull())
    return d.withColumn("form", consistent_form(F.col("value"))).where("form <> value")
