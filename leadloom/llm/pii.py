"""Personal information in free text: finding it, and putting keyed surrogates in its place."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.names import NICKNAMES
from leadloom.plans.lineage import cut

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

_EMAIL = regex.compile(
    r"(?<![\w.+@%-])[\w.+%'-]*[\w+%-]"
    r"(?:\s?[@＠]\s?|\s?[\[({]\s?(?:at|@|arroba)\s?[\])}]\s?|\s(?:at|AT)\s(?=\S+\s(?:dot|DOT)\s))"
    r"[\w-]+(?:(?:\.|\s?[\[({]\s?(?:dot|punto|punkt|point|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)[\w-]+)*"
    r"(?:\.|\s?[\[({]\s?(?:dot|punto|punkt|point|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s)[\p{L}][\p{L}-]*+",
    regex.I,
)
#: What may stand before a number that is neither a phone nor an identity number.
_NOT_PERSONAL = regex.compile(
    r"(?:invoice|part\s?(?:no|number|#)?|order(?:ed)?|ticket|tracking|model|code|ref(?:erence)?|sku|item|serial|exit|highway|built|paid|rated|open|case|factura|pedido|rechnung|bestellung|auftrag|artikel|facture|commande|since|from|unit|room|[$€£#])"
    r"[\s.:#nNrRº°o]*$",
    regex.I,
)
_ID_CUE = regex.compile(
    r"\b(?i:SSN|social security(?: number| no\.?)?|passport|pass|reisepass|passeport|pasaporte|driver'?s? licen[cs]e|licen[cs]e|permis|führerschein|carnet|DNI|NIE|NIF|ID(?:[- ]?(?:card|no\.?|number|nr\.?))?|ausweis(?:nummer|nr\.?)?|personalausweis|carte d[’']identité|numéro de sécu(?:rité sociale)?|sécu|NIR|national insurance(?: number)?|steuer-?id|CNI)"
    r"(?:\s*(?i:no|nr|number|nummer|num|n[º°])\b\.?|\s*#|\s*:|\s+(?:is|was|ist|lautet|est|es))?\s*[:#]?\s*[(\[]?"
    r"(?P<v>(?=[A-Z0-9 .\-/]*\d)[A-Z0-9]+(?:[ .\-/]?[A-Z0-9]+)*+)",
)
_ID_SHAPE = regex.compile(
    r"(?<![\w.\-/+#])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"
    r"|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]\d{3}-\d{4}-\d{4}"
    r"|\d{8}-?[A-HJ-NP-TV-Z]|\d{2}\.\d{3}\.\d{3}-?[A-HJ-NP-TV-Z]"
    r"|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}"
    r")(?![\w\-/]|\.\d)"
)
_PHONE = regex.compile(
    r"(?<![\w.\-/+#$€£])(?:"
    r"(?:\+|00)\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]?\d{2,5}){1,5}"  # with a country code
    r"|(?:1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4}|1?\d{10}"  # ten digits
    r"|\(0\d{2,5}\)[ /.\-]?\d{3,9}(?:[ \-]\d{2,6})*|0\d{2,5}(?: ?[/\-] ?| )\d{3,9}(?:[ \-]\d{2,6})*"  # area code with 0
    r"|0\d(?:[ .\-]?\d{2}){4}|00(?:[ .\-]\d{2}){4}"  # pairs
    r"|\d{3}(?: \d{2}){3}|\d{3} \d{3} \d{3}|\d{9}"  # nine digits
    r"|\d{3}[\-.]\d{4}"  # seven digits
    r")(?![\d\-/]|\.\d|\w|[.,]\d)"
)
_EN_TYPES = "Street|Str|St|Avenue|Ave|Av|Road|Rd|Boulevard|Blvd|Boul|Lane|Ln|Drive|Dr|Court|Crt|Ct|Parkway|Pkwy|Pky|Place|Pl|Square|Sq|Terrace|Ter|Way|Crescent|Cres|Close|Row|Walk"
_ADDRESS = regex.compile(
    r"(?<![\w#.\-/$])(?:(?:No\.?\s*)?\d{1,5}[A-Za-z]?,?\s+(?:(?:North|South|East|West|[NSEW]\.?|So\.?|No\.?)\s+)?(?:[\p{L}][\p{L}'’\-]*|\d{1,3}(?:st|nd|rd|th))(?:\s+[\p{Lu}][\p{L}'’\-]*){0,2}\s+(?:" + _EN_TYPES + r")\b"
    r"|[\p{Lu}][\p{L}\-]*[\s\-]?(?i:straße|strasse|str\.?|weg|gasse|allee|platz|ufer|ring|damm|chaussee|steig|pfad|markt)\s+\d{1,4}\s?[a-z]?\b"
    r"|(?i:calle|avenida|avda\.?|av\.|c/|plaza|pza\.?|paseo|pº|camino|carretera|ronda|travesía)\s*(?:(?:de|del|la|las|los|el)\s+)*[\p{L}][\p{L}'’\-]*(?:\s+(?:(?:de|del|la|las|los|el)\s+)*[\p{Lu}][\p{L}'’\-]*)*,?\s+(?:n[º°.]*\s*)?\d{1,4}[a-z]?\b"
    r"|\d{1,4}(?:\s?(?:bis|ter|quater)|[a-c])?,?\s+(?i:rue|avenue|av\.?|boulevard|bd\.?|place|pl\.?|chemin|allée|impasse|quai|route|cours|square|passage|r\.)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s*)*[\p{L}][\p{L}'’\-]*"
    r")"
)
_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Herrn|Frau|Sra|Sr|Srta|Don|Doña|Prof|Dra|Madame|Monsieur|Señora?|Sir)\b\.?\s+)"
_TITLE_FR = r"(?:(?:M|Dr|Mme|Mlle|Madame|Monsieur|Prof)\b\.?\s+)"
#: A name: one to three words of letters, possibly hyphenated, with initials before or between them.
_WORD = r"[\p{L}][\p{L}'’]+(?:-[\p{L}][\p{L}'’]+)*"
_NAME = rf"(?P<v>(?:[\p{{L}}]\.\s*){{0,2}}{_WORD}(?:\s+(?:[\p{{L}}]\.\s*)?{_WORD}){{0,2}}?)"
_SHORT_NAME = rf"(?P<v>(?:[\p{{L}}]\.\s*){{0,2}}{_WORD}(?:\s+{_WORD})?)"
_NAME_CUES = [
    regex.compile(p)
    for p in (
        rf"(?i:\b(?:owner|manager|boss|technician|assistant|receptionist|guy|lady|chef|doctor|dentist|stylist) (?:is called|is named|was called|named|called))\s+{_TITLE}?{_NAME}(?=[.,;!?\n]|$)",
        rf"(?i:\bour (?:technician|doctor|stylist|plumber|agent|waiter|waitress|dentist|mechanic)),\s+{_TITLE}?{_NAME}(?=,)",
        rf"(?i:\bI (?:spoke|talked|dealt) (?:with|to))\s+{_TITLE}?{_NAME}(?=\s+(?:twice|once|again|yesterday|today)\b|[.,;!?\n]|$)",
        rf"(?:^|(?<=[.!?]\s)|(?<=\n)|(?<=\s\s)|(?<=[)>\]]\s)|(?<=\s)){_TITLE}?{_NAME}(?=\s+(?:at the counter was|and the crew saved|hat alles gut|explained it all|was lovely)\b)",
        rf"(?:^|(?<=[.!?]\s)|(?<=\n)|(?<=\s\s)|(?<=[)>\]]\s)|(?<=\s)){_TITLE_FR}?{_NAME}(?=\s+(?:a tout expliqué|m[’']a|nous a)\b)",
        rf"(?i:\bask for)\s+{_TITLE}?{_NAME}(?=[,.;!?\n]|$)",
        rf"(?i:\bnever let)\s+{_TITLE}?{_NAME}(?=\s+(?:near|touch|into|in)\b)",
        rf"(?i:\b(?:big )?(?:thanks|thank you|kudos|shout-?out|props) to)\s+{_TITLE}?{_NAME}(?=\s+(?:for|and|at)\b|[.,;!?\n]|$)",
        rf"(?i:\b(?:signed|regards|cheers|sincerely)),\s+{_TITLE}?{_NAME}(?=\s{{2}}|[,;!?\n]|\.(?:\s|$)|\s*$)",
        rf"(?:^|(?<=[\s]))[-–—]\s+{_TITLE}?{_NAME}(?=\s{{2}}|[;!?\n]|\.(?:\s|$)|\s*$)",
        # a signature that a new sentence follows: two words of it if a capital comes after them, else one
        rf"(?i:\b(?:signed|regards|cheers|sincerely)),\s+{_TITLE}?{_SHORT_NAME}(?=\s+[\p{{Lu}}<(\d])",
        rf"(?:^|(?<=[\s]))[-–—]\s+{_TITLE}?{_SHORT_NAME}(?=\s+[\p{{Lu}}<(\d])",
        rf"(?i:\bmy (?:husband|wife|son|daughter|sister|brother|mother|father|mom|dad|friend|neighbou?r|partner|boss|kid|cousin))\s+{_TITLE}?{_NAME}(?=\s+(?:agrees?|says?|said|thinks?|loved|likes?|was|is|and|also)\b|[.,;!?\n]|$)",
        rf"(?i:\bdanke an)\s+{_TITLE}?{_NAME}(?=\s+(?:für|und)\b|[.,;!?\n]|$)",
        rf"(?i:\bfragen sie nach)\s+{_TITLE}?{_NAME}(?=[,.;!?\n]|$)",
        rf"(?i:\b(?:merci à|grâce à))\s+{_TITLE_FR}?{_NAME}(?=\s+(?:pour|et)\b|[.,;!?\n]|$)",
        rf"(?i:\bdemandez)\s+{_TITLE_FR}?{_NAME}(?=\s+(?:à|au|chez)\b|[.,;!?\n]|$)",
        rf"(?i:\b(?:nos atendió|me atendió|gracias a))\s+{_TITLE}?{_NAME}(?=\s+(?:muy|por|y|con)\b|[.,;!?\n]|$)",
        rf"(?i:\b(?:pregunten|pregunte|pregunta) por)\s+{_TITLE}?{_NAME}(?=[,.;!?\n]|$)",
        rf"\b(?:Dr|Mr|Mrs|Ms|Miss|Mme|Mlle|Herrn|Frau|Sra|Srta|Don|Doña|Prof)\b\.?\s+(?P<v>\p{{Lu}}[\p{{L}}'’]+(?:-\p{{Lu}}[\p{{L}}'’]+)*(?:\s+\p{{Lu}}[\p{{L}}'’]+(?:-\p{{Lu}}[\p{{L}}'’]+)*)?)(?!\w)",
    )
]
#: Words that cue patterns may take for a name (fixed values).
_NO_NAME = frozenset(
    "the a an it he she they we you i my our your their his her its this that these those there here and or but if so as at by for from in of on to up with "
    "everyone everybody someone somebody anyone anybody nobody all both them him us me who which what when where staff team crew owner manager "
    "no not never yes great good best nice very really honest price prices quote cash card".split()
)


def _usable_name(value: str) -> bool:
    words = [w.lower().strip(".") for w in value.split()]
    return any(len(w) > 1 for w in words) and not any(w in _NO_NAME and len(w) > 1 for w in words)


def find_mentions(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each mention in order, start from 0; earlier kinds of KINDS win where two overlap."""
    found: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def add(kind: str, start: int, end: int) -> None:
        if start < end and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append((kind, start, end))

    digits = any(c.isdigit() for c in text)
    if any(s in text for s in ("@", "＠", "[", "(", "{")) or " at " in text.lower():
        for m in _EMAIL.finditer(text):
            add("EMAIL", m.start(), m.end())
    if digits:
        for m in _ADDRESS.finditer(text):
            add("ADDRESS", m.start(), m.end())
        for m in _ID_CUE.finditer(text):
            if sum(c.isdigit() for c in m.group("v")) >= 4:
                add("ID", m.start("v"), m.end("v"))
        for kind, pattern in (("ID", _ID_SHAPE), ("PHONE", _PHONE)):
            for m in pattern.finditer(text):
                if not _NOT_PERSONAL.search(text, max(0, m.start() - 24), m.start()):
                    add(kind, m.start(), m.end())
    for cue in _NAME_CUES:
        for m in cue.finditer(text):
            start, value = m.start("v"), m.group("v")
            if _usable_name(value):
                add("NAME", start, start + len(value))
    return sorted(found, key=lambda x: x[1])


def mentions(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, text, kind, start_pos, end_pos, mention): a row a mention in the whole text, start_pos from 1 in code points.

    NULL and empty texts and texts without a mention give no rows.
    """

    @F.pandas_udf("array<struct<kind: string, start_pos: int, end_pos: int, mention: string>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [{"kind": k, "start_pos": a + 1, "end_pos": b, "mention": t[a:b]} for k, a, b in find_mentions(t)] for t in texts], dtype=object)

    d = df.select(F.col(key), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return d.withColumn("m", F.explode(find("text"))).select(key, "text", "m.*")


# Surrogates -----------------------------------------------------------------------------------------------

_SYLLABLES = [a + b for a in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "tr") for b in ("a", "e", "i", "o", "u", "ai", "ei", "ou")]
#: Syllables of other scripts, and given names by gender with the endings of their stand-ins by script (fixed values).
_SCRIPTS = {
    "CYRILLIC": [a + b for a in "бвгдзклмнпрстфхш" for b in "аеиоуэыю"],
    "GREEK": [a + b for a in "βγδζθκλμνπρστφχψ" for b in "αεηιουωυ"],
    "ARABIC": [a + b for a in "بتجدرزسشطعفقكلمن" for b in "ابتدرسلم"],
    "HEBREW": [a + b for a in "בגדזחטכלמנספקרשת" for b in "אבדהולמר"],
    "HANGUL": [chr(0xAC00 + 84 * i) for i in range(128)],
    "HIRAGANA": [chr(0x3042 + i % 60) for i in range(128)],
    "KATAKANA": [chr(0x30A2 + i % 60) for i in range(128)],
    "CJK": [chr(0x5B00 + 7 * i) for i in range(128)],
}
_WOMEN = frozenset(
    "abigail anna anne alice barbara elizabeth rebecca katherine margaret maria marie mary susan sarah sophie emma julia laura linda lisa nina olivia patricia rose ruth helen jane jennifer jessica claire chloe camille odette leocadia "
    "ursula ingrid petra heike sabine carmen lucia isabel pilar анна мария елена ольга наталья татьяна ирина екатерина μαρία ελένη άννα αικατερίνη فاطمة عائشة مريم زينب".split()
)
_MEN = frozenset(
    "albert alexander andrew anthony arthur benjamin william robert charles christopher daniel david edward eric frank frederick george henry james john joseph kevin lawrence mark martin michael nicholas patrick paul peter philip richard samuel stephen thomas walter "
    "hans jürgen klaus stefan pierre jean jacques luc carlos javier pablo diego иван александр сергей дмитрий николай владимир андрей γιώργος νίκος δημήτρης محمد أحمد علي حسن".split()
)
_ENDINGS = {"LATIN": ("ella", "bert"), "CYRILLIC": ("ина", "слав"), "GREEK": ("ίνα", "ίας"), "ARABIC": ("ة", "ين")}


def _gender(name: str) -> int | None:
    """0 for a woman's given name, 1 for a man's, None for others."""
    name = NICKNAMES.get(name.lower(), name.lower())
    return 0 if name in _WOMEN else 1 if name in _MEN else None


def _digest(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """A keyed hash in hexadecimal: SHA-256 over the key at both ends."""
    return F.sha2(F.concat_ws("\u001e", F.lit(key), kind, entity, attempt.cast("string"), F.lit(key)), 256)


def _surrogate(kind: str, entity: str, digest: str) -> str:
    """A stand-in of the same type, script, case and format, determined by the digest."""
    draw = int(digest, 16)

    def pick(n: int) -> int:
        nonlocal draw
        draw, r = divmod(draw, n)
        return r

    if kind == "EMAIL":
        name = "".join(_SYLLABLES[pick(128)] for _ in range(4))
        return f"{name}{pick(9000) + 1000}@mail.example"
    if kind == "NAME":
        if len(entity.rstrip(".")) == 1:
            return chr(ord("A") + pick(26)) + "."
        script = next((w for c in entity if (w := unicodedata.name(c, "").split(" ")[0]) in (*_SCRIPTS, "LATIN")), "LATIN")
        if script != "LATIN" or _gender(entity) is not None:
            ends, sex = _ENDINGS.get(script), _gender(entity)
            few = script in ("HANGUL", "CJK")
            word = "".join(_SCRIPTS.get(script, _SYLLABLES)[pick(128)] for _ in range(max(2, len(entity)) if few else 3))
            return (word + (ends[sex] if ends and sex is not None else "")).capitalize()
        ending = {"a": "a", "e": "e", "o": "o"}.get(entity[-1:].lower(), "n")
        word = "".join(_SYLLABLES[pick(128)] for _ in range(3 if len(entity) > 5 else 2)) + "l" + ("" if ending == "n" else ending) + ("en" if ending == "n" else "")
        return word.capitalize()
    letters = {True: "ABCDEFGHJKLMNPRSTVWXYZ", False: "abcdefghjkmnprstuvwxyz"}
    if kind == "ADDRESS":  # new number and street name, the street's type stays
        out = re.sub(r"\d", lambda m: str(pick(9) + 1), entity)
        words = re.findall(r"[^\W\d_]{3,}", out)
        name = max(words, key=len) if words else ""
        return out.replace(name, "".join(_SYLLABLES[pick(128)] for _ in range(3)).capitalize() + "" if not re.search(r"(straße|strasse|weg|gasse|allee|platz|str)$", name, re.I) else "".join(_SYLLABLES[pick(128)] for _ in range(2)).capitalize() + re.search(r"(straße|strasse|weg|gasse|allee|platz|str)$", name, re.I).group().lower(), 1) if name else out
    return re.sub(r"[0-9]|[A-Za-z]", lambda m: str(pick(10)) if m.group().isdigit() else letters[m.group().isupper()][pick(22)], entity)


def _surrogates(*columns: str) -> Column:
    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([_surrogate(k, e, d) for k, e, d in zip(kind, entity, digest)], dtype=object)

    return draw(*columns)


_AT = r"\s*[\[({]\s*(?:at|@|arroba)\s*[\])}]\s*|\s*[@＠]\s*|\s+at\s+"
_DOT = r"\s*[\[({]\s*(?:dot|punto|punkt|point|\.)\s*[\])}]\s*|\s+dot\s+"


def _entity(kind: Column, mention: Column) -> Column:
    """What two mentions of the same thing share: parts of a name each by itself, e-mails however written, digits and letters of phones and IDs, addresses without case and spacing."""
    low = F.lower(mention)
    digits = F.regexp_replace(F.regexp_replace(low, r"[^0-9]", ""), "^00", "")
    return (
        F.when(kind == "NAME", low)
        .when(kind == "EMAIL", F.regexp_replace(F.regexp_replace(low, _AT, "@"), _DOT, "."))
        .when(kind == "PHONE", F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits))
        .when(kind == "ID", F.upper(F.regexp_replace(low, r"[^\p{L}\p{N}]", "")))
        .otherwise(F.regexp_replace(low, r"\s+", " "))
    )


def _in_form(kind: str, mention: str, surrogate: str) -> str:
    """A surrogate written as the mention is: its signs for @ and dots, or its separators between digits and letters."""
    if kind == "EMAIL":
        at, dot = re.search(_AT, mention, re.I), re.search(_DOT, mention, re.I)
        name, host = surrogate.split("@")
        out = name + (at.group() if at else "@") + (host.replace(".", dot.group()) if dot else host)
        return out.upper() if mention.isupper() else out
    if kind in ("PHONE", "ID"):
        rest, out = list(surrogate), []
        for c in reversed(mention):  # from the end, as a country's number may be left out before
            new = rest.pop() if re.match(r"[0-9A-Za-z]", c) and rest else c
            out.append(new.lower() if c.islower() else new)
        return "".join(reversed(out))
    return surrogate


def _written(*columns: str) -> Column:
    @F.pandas_udf("string")
    def write(kind: pd.Series, mention: pd.Series, surrogate: pd.Series) -> pd.Series:
        return pd.Series([_in_form(k, m, x) for k, m, x in zip(kind, mention, surrogate)], dtype=object)

    return write(*columns)


def surrogate_table(found: DataFrame, key: str, rounds: int = 8) -> DataFrame:
    """(kind, entity, surrogate): distinct surrogates for the distinct entities of `found` (kind, mention).

    Parts of a name are entities of their own, so the same person keeps one stand-in in whatever form. Where
    two entities draw the same surrogate, all but the first draw again with a further attempt, until none
    collide; what is left after `rounds` gets its hash appended.
    """
    parts = F.when(F.col("kind") == "NAME", F.split("mention", r"[\s-]+")).otherwise(F.array("mention"))
    e = found.select("kind", F.explode(parts).alias("part")).select("kind", _entity(F.col("kind"), F.col("part")).alias("entity"), "part")
    todo = e.groupBy("kind", "entity").agg(F.min(F.when(F.col("kind").isin("PHONE", "ID"), F.col("entity")).otherwise(F.col("part"))).alias("part"))
    taken = cut(todo.where(F.length("entity") > 2).select("kind", F.col("entity").alias("_is")))  # a stand-in is nothing that was found
    done = None
    for attempt in range(rounds):
        drawn = todo.withColumn("digest", _digest(key, F.col("kind"), F.col("entity"), F.lit(attempt))).withColumn("surrogate", _surrogates("kind", "part", "digest"))
        drawn = cut(drawn)
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        first = first.join(taken, (first["kind"] == taken["kind"]) & (_entity(first["kind"], first["surrogate"]) == taken["_is"]), "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = drawn.join(first, ["kind", "surrogate", "entity"], "left_semi").select("kind", "entity", "part", "surrogate")
        done = good if done is None else done.unionByName(good)
        done = cut(done)
        todo = cut(drawn.join(good, ["kind", "entity"], "left_anti").select("kind", "entity", "part"))
        # an initial has 26 stand-ins, so initials may share one
        initials = todo.where(F.length(F.regexp_replace("part", r"\.", "")) == 1)
        if todo.exceptAll(initials).isEmpty():
            break
    last = todo.withColumn("digest", _digest(key, F.col("kind"), F.col("entity"), F.lit(0))).withColumn("surrogate", _surrogates("kind", "part", "digest"))
    mark = F.when(F.length(F.regexp_replace("part", r"\.", "")) == 1, F.col("surrogate")).otherwise(F.concat("surrogate", F.substring("digest", 1, 12)))
    return done.select("kind", "entity", "surrogate").unionByName(last.select("kind", "entity", mark.alias("surrogate")))


def with_surrogates(df: DataFrame, key_col: str, text_col: str, secret: str) -> DataFrame:
    """(key_col, text, replaced): each text of `df` with a mention, and the text with surrogates in their places.

    The same secret gives the same surrogates. The mentions of one text come together in one row of it.
    """
    found = cut(mentions(df, key_col, text_col))
    table = surrogate_table(found, secret)
    parts = F.when(F.col("kind") == "NAME", F.split("mention", r"[\s-]+")).otherwise(F.array("mention"))
    e = found.select(key_col, "kind", "start_pos", "end_pos", "mention", F.posexplode(parts).alias("i", "part")).withColumn("entity", _entity(F.col("kind"), F.col("part")))
    e = e.join(table, ["kind", "entity"]).withColumn("surrogate", _written("kind", "part", "surrogate")).withColumn("surrogate", F.when((F.col("kind") == "NAME") & (F.col("part") == F.upper("part")) & (F.length("part") > 2), F.upper("surrogate")).when((F.col("kind") == "NAME") & (F.col("part") == F.lower("part")), F.lower("surrogate")).otherwise(F.col("surrogate")))
    # names keep what stands between their parts
    gap = F.when(F.col("kind") == "NAME", F.coalesce(F.get(F.regexp_extract_all("mention", F.lit(r"[\s-]+"), F.lit(0)), F.col("i")), F.lit(""))).otherwise("")
    e = e.withColumn("gap", gap)
    each = e.groupBy(key_col, "start_pos", "end_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate", "gap"))), lambda x: F.concat(x["surrogate"], x["gap"])), "").alias("by"))
    per_text = each.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "by")), lambda a, b: b["start_pos"] - a["start_pos"]).alias("all"))
    texts = found.select(key_col, "text").dropDuplicates([key_col])
    replaced = F.aggregate("all", F.col("text"), lambda t, m: F.concat(F.substring(t, F.lit(1), m["start_pos"] - 1), m["by"], F.substring(t, m["end_pos"] + 1, F.length(t))))
    return texts.join(per_text, key_col).select(key_col, "text", replaced.alias("replaced"))


def with_placeholders(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key_col, text, replaced) with each mention replaced by its kind in brackets."""
    found = mentions(df, key_col, text_col)
    per_text = found.groupBy(key_col).agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind")), lambda a, b: b["start_pos"] - a["start_pos"]).alias("all"))
    replaced = F.aggregate("all", F.col("text"), lambda t, m: F.concat(F.substring(t, F.lit(1), m["start_pos"] - 1), F.lit("["), m["kind"], F.lit("]"), F.substring(t, m["end_pos"] + 1, F.length(t))))
    return per_text.select(key_col, "text", replaced.alias("replaced"))
