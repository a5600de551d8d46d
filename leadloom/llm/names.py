"""Business names: their parts, and links between their variants by metric-space partitioning."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.components import component_labels
from leadloom.llm.lookalike import consistent
from leadloom.operators.skew import salted_join
from leadloom.plans.lineage import cut

# What the words of business names mean, without accents and in lower case. ------------------

#: Words of each trade in English, German and French, with usual abbreviations, and its categories.
TRADES = {
    "plumbing": "plumbing plumber plumbers plbg plumb sanitar klempner plomberie plombier plomb",
    "dental": "dental dentist dntl dentiste dentaire zahnarztpraxis zahnarzt zahnarztin dent cabinet clinic",
    "roofing": "roofing roofer rfg roof dachdecker dachdeckerei couverture couvreur",
    "bakery": "bakery baker bkry backerei boulangerie patisserie boulanger",
    "electrical": "electrical electrician elec elektro elektriker electricite electricien electric",
    "landscaping": "landscaping landscaper lndscpg landscape gartenbau gartnerei paysages paysagiste lndscp",
    "cleaning": "cleaning clng cleaners gebaudereinigung reinigung nettoyage menage societe cleaner",
    "auto": "auto autorepair garage kfz werkstatt autowerkstatt garagiste repair rpr",
    "law": "law lawyer attorney rechtsanwalte rechtsanwalt kanzlei avocat avocats attorneys firm",
    "heating": "heating htg heizungsbau heizungsbauer chauffage chauffagiste contractor",
    "veterinary": "veterinary veterinarian vet tierarztpraxis tierarzt tierarztin veterinaire clinique",
    "coffeehouse": "coffee coffeehouse cafe kaffeehaus cof",
    "photography": "photography photographer photo fotostudio fotograf photographie photographe photogr",
    "tutoring": "tutoring tutrg tutor nachhilfe nachhilfeschule soutien scolaire",
    "hairstudio": "hair hairstudio salon friseursalon friseur coiffure studio stu",
    "flooring": "flooring flrg floor parkett bodenleger parquets parquet revetement",
    "tire": "tire tyre tires tyres reifendienst reifenhandler reifen pneus pneu tr",
    "painting": "painting painter pntg malerbetrieb malermeister maler peinture peintre",
    "pestcontrol": "pest pestcontrol control ctrl schadlingsbekampfung kammerjager desinsectisation deratisation pst",
    "accounting": "accounting accountant acctg steuerberatung steuerberater comptabilite comptable",
    "moving": "moving mover movers mvg umzuge umzugsfirma umzug demenagement demenageur",
    "florist": "florist flst blumenhaus blumenladen blumen fleurs fleuriste flowers",
    "fitness": "fitness fit gym fitnessstudio sportstudio salle sport",
    "optical": "optical optician opt optik optiker optique opticien",
}
#: Words of categories and names that alone say no trade.
_SIDE = "house hse center centre shop store service company contractor clinic cabinet clinique firm expert batiment sol studio stu repair rpr control ctrl salle societe de en haus".split()
#: Words that tell a name's legal or general form.
GENERIC = frozenset(
    "llc l l c inc ltd limited corp co company gmbh g m b h ek e k ohg kg ag ug sarl s a r l sas sa eurl services service svcs svc group grp center centre ctr associates assoc associate brothers bros "
    "international intl gesellschaft ges meisterbetrieb mstr gebruder gebr sohne soehne sons son fils filles fille tochter compagnie cie etablissements ets the and und et n by of de du la le van van von y und amp".split()
)
#: Short forms of given names and the given name they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony", "art": "arthur", "barb": "barbara", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "becky": "rebecca", "becca": "rebecca", "bill": "william", "billy": "william", "will": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "bert": "robert", "charlie": "charles", "chuck": "charles", "chris": "christopher", "cathy": "katherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "don": "donald", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "fred": "frederick", "freddy": "frederick", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john", "jake": "jacob", "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "jess": "jessica", "joe": "joseph", "josie": "josephine", "jo": "josephine", "jon": "jonathan", "ken": "kenneth", "larry": "lawrence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "ron": "ronald", "sam": "samuel", "steve": "steven", "sue": "susannah", "susie": "susannah", "suzy": "susannah", "susan": "susannah", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "walt": "walter",
}
GIVEN = frozenset(NICKNAMES.values())
#: First letters that a given name may be shortened to, its own and those of its short forms.
INITIALS = {g: "".join(sorted({g[0], *(n[0] for n, x in NICKNAMES.items() if x == g)})) for g in GIVEN}
#: Towns from which on a registrable domain is taken to be shared: by a web host's customers or a chain's outlets.
SHARED_TOWNS = 3
#: Rows up to which a table, counted first, is sent to all tasks.
SENT_ROWS = 50_000

_TRADE_OF = {w: t for t, words in TRADES.items() for w in words.split() if w not in _SIDE}
_SIDE_OF = {w: [t for t, words in TRADES.items() if w in words.split()] for w in _SIDE}
_LONG_TRADE_WORDS = frozenset(w for w in _TRADE_OF if len(w) >= 6)
_LONGEST = max(map(len, _LONG_TRADE_WORDS))


def fold(text: str) -> str:
    """Lower case without accents, in the consistent form of lookalike."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", consistent(text)).lower().replace("ß", "ss")
    return "".join(c for c in t if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, or most + 1 where it is greater than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if most == 1:  # what is left after the common beginning and end tells
        i, n = 0, min(len(a), len(b))
        while i < n and a[i] == b[i]:
            i += 1
        j = 0
        while j < n - i and a[-1 - j] == b[-1 - j]:
            j += 1
        x, y = a[i : len(a) - j], b[i : len(b) - j]
        return 1 if max(len(x), len(y)) <= 1 or (len(x) == len(y) == 2 and x == y[::-1]) else 2
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1] if row[-1] <= most else most + 1


def _deletions(word: str, most: int) -> set[str]:
    """The word with up to `most` letters left out."""
    out = {word}
    for _ in range(most):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


@lru_cache(200_000)
def letters_of(word: str) -> int:
    """A bit for each kind of letter that a word has; an edit changes two at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 31)
    return bits


class Lexicon:
    """Words of several kinds that are found again with a slip or two: those that begin alike and are near by their length and letters are compared."""

    def __init__(self, kinds: list[tuple[dict[str, str], int, int]]):
        """`kinds`: what the words of a kind mean, the length from which slips are allowed, and from which two."""
        self.kinds = kinds
        #: (letters, kind, word, slips) by the first letter and each length that a word with its slips may have.
        self.near: dict[tuple[str, int], list[tuple[int, int, str, int]]] = {}
        for k, (words, least, long) in enumerate(kinds):
            for w in words:
                if len(w) >= least:
                    most = 2 if len(w) >= long else 1
                    for n in range(len(w) - most, len(w) + most + 1):
                        self.near.setdefault((w[0], n), []).append((letters_of(w), k, w, most))
        self.shortest = min(k[1] for k in kinds) - 1

    def find(self, word: str) -> tuple[str, ...]:
        """What the word means in each kind, itself or as the nearest word that begins alike; "" for nothing."""
        best = [(0, word, words[word]) if word in words else (9, "", "") for words, _, _ in self.kinds]
        if len(word) >= self.shortest:
            letters = letters_of(word)
            for first in {*word[:2]}:
                for other, k, w, most in self.near.get((first, len(word)), ()):
                    if best[k][0] and (letters ^ other).bit_count() <= 2 * most and (d := distance(word, w, most)) <= most:
                        best[k] = min(best[k], (d, w, self.kinds[k][0][w]))
        return tuple(b[2] for b in best)


@cache
def _lexicon() -> Lexicon:
    general = {w: w for w in GENERIC if len(w) > 1} | {w: w for w in _SIDE_OF}
    return Lexicon([(_TRADE_OF, 6, 10), (general, 7, 99), (NICKNAMES | {g: g for g in GIVEN}, 6, 99)])


@lru_cache(300_000)
def _meaning(word: str) -> tuple[str, ...]:
    """The trade, the general word and the given name that a word is, allowing for a slip in a long one."""
    return _lexicon().find(word)


def _trade_word(word: str) -> str:
    return _meaning(word)[0]


def _general(word: str) -> bool:
    return word in GENERIC or bool(_meaning(word)[1])


def _given(word: str) -> str:
    return _meaning(word)[2]


@lru_cache(50_000)
def trade_of_category(category: str) -> str:
    words = re.findall(r"[^\W_]+", fold(category))
    return next((t for w in words if (t := _trade_word(w))), next((_SIDE_OF[w][0] for w in words if len(_SIDE_OF.get(w, ())) == 1), ""))


@lru_cache(200_000)
def _glued(word: str) -> tuple[str, ...]:
    """Parts of a word in which a trade is written on to a name."""
    if _trade_word(word) or _general(word):
        return (word,)
    for k in range(min(_LONGEST, len(word) - 4), 5, -1):
        if word[-k:] in _LONG_TRADE_WORDS:
            return (word[:-k], word[-k:])
        if word[:k] in _LONG_TRADE_WORDS:
            return (word[:k], word[k:])
    return (word,)


_GIVEN_BY_LENGTH = sorted((g for g in {*NICKNAMES, *GIVEN} if len(g) >= 5), key=len, reverse=True)
_ENDINGS = sorted((w for w in GENERIC if len(w) >= 5), key=len, reverse=True)


def _unglued(word: str, place: list[str]) -> list[str]:
    """Words of a name that is written as one, such as a name key: the, general endings and the town go off it."""
    word = word.removeprefix("the") if len(word) > 12 else word
    first = next((g for g in _GIVEN_BY_LENGTH if word.startswith(g) and len(word) > len(g) + 6), "")
    word, out = word[len(first) :], [first] if first else []
    again = True
    while again:
        again = False
        for w in [*place, *_ENDINGS]:
            if len(word) > len(w) + 5 and word.endswith(w):
                word, again = word[: -len(w)], True
                out.append(w)
                break
    for w in ("autorepair", *sorted(TRADES, key=len, reverse=True)):  # the trade, also a short one, is what is left at the end
        if len(word) > len(w) + 3 and word.endswith(w):
            return [word[: -len(w)], w, *out]
    return [word, *out]


_LATIN, _LETTER = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[^\W\d_]")
_CAMEL, _DOTTED, _APOSTROPHE = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])"), re.compile(r"\b((?:[^\W\d_]\.){2,})"), re.compile(r"(?<=\w)['’](?=\w)")
_POSSESSIVE = re.compile(r"(?<=\w)['’]s\b", re.I)
_WORDS = re.compile(r"[^\W_]+")
_INITIAL = re.compile(r"(?<![^\W_])([^\W\d_])\.")


@lru_cache(200_000)
def _of_trade(word: str, trade: str) -> bool:
    """Whether a word is a slip of one of the words of a trade that is known already."""
    return len(word) >= 4 and any(len(w) >= 4 and abs(len(w) - len(word)) <= 1 and distance(word, w, 1) <= 1 for w in [*TRADES[trade].split(), *(["house"] if trade == "coffeehouse" else [])])


@lru_cache(20_000)
def _place_words(town: str) -> tuple[str, ...]:
    return tuple(_WORDS.findall(fold(town))) if town else ()


def _is_place(word: str, place: tuple[str, ...]) -> bool:
    n = len(word)
    for p in place:  # a loop, as this is asked of every word
        if len(p) >= 4 and -1 <= len(p) - n <= 1 and (p[0] == word[0] or p[-1] == word[-1]) and distance(word, p, 1) <= 1:
            return True
    return False


def parse_name(name: str | None, category: str | None, town: str) -> dict:
    """Parts of a business name: core words sorted, given name or initial, trade, and whether it is in Latin letters."""
    text = consistent(name or "")
    latin = text.isascii() or bool(_LATIN.search(text)) or not _LETTER.search(text)
    text = _CAMEL.sub(" ", text)
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") + " ", text) if "." in text else text
    text = _APOSTROPHE.sub("", _POSSESSIVE.sub("", text)) if "'" in text or "’" in text else text
    marked = _INITIAL.search(text) if "." in text else None
    words = _WORDS.findall(fold(text))
    place = _place_words(town)
    if len(words) == 1 and len(words[0]) > 7:
        words = _unglued(words[0], list(place))
    trades, core, given, initials = [], [], "", fold(marked.group(1)) if marked else ""
    words = [w for word in words if not (place and _is_place(word, place)) for w in _glued(word)]
    for w in words:
        if (t := _trade_word(w)) and len(words) > 1:
            trades.append(t)
        elif len(w) == 1 and w.isalpha():
            initials = initials or (w if w not in "ns" else "")
        elif not given and len(words) > 2 and (g := _given(w)):
            given = g
        elif not _general(w):
            core.append(w)
        elif w in _SIDE_OF and len(_SIDE_OF[w]) == 1:
            trades.append("?" + _SIDE_OF[w][0])
    sure = [t for t in trades if t[0] != "?"]
    trade = trade_of_category(category) if category else ""
    trade = trade or (sure[0] if sure else trades[0][1:] if trades else "")
    if trade and len(core) > 1:
        core = [w for w in core if not _of_trade(w, trade)] or core
    if not core and given:
        core, given = [given], ""
    return {"core": sorted(core), "given": given or initials, "trade": trade, "latin": latin}


_SCHEME, _PORT = re.compile(r"^(?:[a-z]+:/*)+"), re.compile(r":\d*$")
_BY_LENGTH = sorted(TRADES, key=len, reverse=True)


@lru_cache(50_000)
def bare_host(url: str) -> str:
    """A URL's or raw domain's host without scheme, www, port and dot, in lower case."""
    host = _SCHEME.sub("", unicodedata.normalize("NFKC", url).strip().lower()).split("/")[0].split("?")[0].split("@")[-1]
    return _PORT.sub("", host).strip(".").removeprefix("www.")


def base_of(url: str | None) -> str:
    """The registrable part of a URL's host, its last two labels; "" for none."""
    labels = bare_host(url).split(".") if url else []
    return ".".join(labels[-2:]) if len(labels) > 1 else ""


def _with_base(df: DataFrame, website: str) -> DataFrame:
    @F.pandas_udf("string")
    def base(sites: pd.Series) -> pd.Series:
        return sites.map(base_of, na_action=None)

    return df.withColumn("_base", base(F.col(website)))


def shared_domains(df: DataFrame, website: str, town: str) -> DataFrame:
    """(_base, shared) of the registrable domains that the rows of `df` have in SHARED_TOWNS towns or more."""
    places = _with_base(df.select(website, town), website).where(F.col("_base") != "").select("_base", F.lower(F.trim(F.col(town))).alias("_town")).where("_town <> ''").distinct()
    return cut(places.groupBy("_base").count().where(F.col("count") >= SHARED_TOWNS).select("_base", F.lit(True).alias("shared")))


def with_shared(df: DataFrame, website: str, shared: DataFrame) -> DataFrame:
    """`df` with `shared`: whether its website's domain is one of shared_domains(), which are counted before they are sent to all tasks."""
    d = _with_base(df, website).join(F.broadcast(shared) if shared.count() <= SENT_ROWS else shared, "_base", "left").drop("_base")
    return d.withColumn("shared", F.coalesce("shared", F.lit(False)))


def host_name(website: str | None, town: str, shared: bool = False) -> tuple[str, str]:
    """(name, trade) spelled by a site's own host, both "" where its domain is shared and the host no customer's subdomain.

    The town or its beginning at the host's end goes.
    """
    if not website:
        return "", ""
    labels = bare_host(website).split(".")
    at = -3 if shared else -2
    label = labels[at] if len(labels) >= -at else ""
    if not label:
        return "", ""
    place = "".join(_place_words(town))
    label = fold(label)
    head, dash, tail = label.rpartition("-")
    if dash and place and distance(tail, place, 1) <= 1:
        label = head
    elif place and label.endswith(place[:5]) and len(label) > 8:
        label = label[: -len(place[:5])]
    label = label.replace("-", "").replace("_", "")
    if label.endswith("autorepair") and len(label) > 12:
        return label[:-10], "auto"
    for t in _BY_LENGTH:
        if label.endswith(t) and len(label) > len(t) + 2:
            return label[: -len(t)], t
    return label, ""


# Links -----------------------------------------------------------------------------------------------------

#: Radius of the joins in the true metric, Levenshtein's.
RADIUS = 3
#: Letters of a point below which only equal strings are partners: within the radius any two of them would be.
SHORTEST = 3
#: Points of a cell, about; more make more pivots in a block, up to the most.
CELL_POINTS, MOST_PIVOTS = 256, 512

_PARTS = "core array<string>, given string, trade string, latin boolean, host string"


def parsed(df: DataFrame, name: str, category: str, town: str, website: str) -> DataFrame:
    """`df` with a struct column `parts`: core words, given name or initial, trade, latin, and the name its host spells.

    Hosts on domains that are met in several towns spell no name but that of a subdomain.
    """

    @F.pandas_udf(f"struct<{_PARTS.replace(' array', ': array').replace(' string', ': string').replace(' boolean', ': boolean')}>")
    def parse(names: pd.Series, categories: pd.Series, towns: pd.Series, sites: pd.Series, shared: pd.Series) -> pd.DataFrame:
        out = []
        for n, c, t, s, x in zip(names, categories, towns, sites, shared):
            p = parse_name(n, c, t or "")
            p["host"], trade = host_name(s, t or "", x)
            p["trade"] = p["trade"] or trade
            out.append(p)
        return pd.DataFrame(out, columns=["core", "given", "trade", "latin", "host"])

    return with_shared(df, website, shared_domains(df, website, town)).withColumn("parts", parse(name, category, town, website, "shared")).drop("shared")


def metric_pairs(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (l, r) of the structs of two points in one block whose strings are at most `radius` edits apart.

    `points` has block, s and p, a struct that tells it apart and is ordered. Blocks of many strings get
    pivots, drawn from their strings by hash. A point's home is its nearest pivot; it is also put with every
    pivot that is at most twice the radius further off than home: by the triangle inequality no partner
    within the radius has its home elsewhere. Within a cell, points whose distances to the pivot differ by
    more than the radius are no partners either; the others are measured. Each pair comes out once.
    """
    strings = points.select("block", "s").distinct()
    n = strings.groupBy("block").agg(F.count("*").alias("n"))
    pivots = F.least(F.ceil(F.col("n") / CELL_POINTS), F.lit(MOST_PIVOTS))
    drawn = strings.join(n.where(F.col("n") > CELL_POINTS), "block").where(F.pmod(F.xxhash64("s"), F.col("n")) < pivots)
    by_block = cut(drawn.groupBy("block").agg(F.sort_array(F.collect_set("s")).alias("pivots")))
    # a block without pivots has one, the empty string, whose distance is the length
    d = points.join(by_block, "block", "left").withColumn("pivots", F.coalesce("pivots", F.array(F.lit(""))))
    d = d.withColumn("far", F.transform("pivots", lambda v: F.levenshtein(F.col("s"), v))).withColumn("home", F.array_min("far"))
    d = d.withColumn("cells", F.filter(F.transform("far", lambda x, i: F.struct(i.alias("cell"), x.alias("far"))), lambda c: c["far"] <= F.col("home") + 2 * radius))
    d = d.withColumn("home_cell", F.array_position("far", F.col("home")).cast("int") - 1)
    copies = d.select("block", F.col("s"), F.col("p"), "home_cell", F.explode("cells").alias("c")).select("block", F.col("c.cell").alias("cell"), F.col("c.far").alias("far"), "s", "p", "home_cell")
    at_home = copies.where(F.col("cell") == F.col("home_cell"))
    left = at_home.select("block", "cell", F.col("far").alias("far_l"), F.col("s").alias("s_l"), F.col("p").alias("l"), F.col("home_cell").alias("home_l"))
    right = copies.select("block", "cell", F.col("far").alias("far_r"), F.col("s").alias("s_r"), F.col("p").alias("r"), F.col("home_cell").alias("home_r"))
    j = salted_join(left.withColumn("_by", F.hash("l")), right, ["block", "cell"], "_by", 4_000).drop("_by")
    # two points at home in one cell meet twice there, others once from either home
    once = F.when(F.col("home_l") == F.col("home_r"), F.col("l") < F.col("r")).otherwise(F.col("home_l") < F.col("home_r"))
    j = j.where(once & (F.abs(F.col("far_l") - F.col("far_r")) <= radius))
    # generated, so that no filter above measures the pair again
    edits = F.explode(F.array(F.levenshtein("s_l", "s_r", radius))).alias("edits")
    return j.select("block", "s_l", "s_r", "l", "r", edits).where("edits >= 0")


def equal_pairs(points: DataFrame) -> DataFrame:
    """Pairs like those of metric_pairs(), of points in one block with equal strings; of two words of names none, as no link comes of them."""
    left = points.where(F.col("p.kind") != "T").select("block", "s", F.col("p").alias("l"), F.hash("p").alias("_by"))
    j = salted_join(left, points.select("block", "s", F.col("p").alias("r")), ["block", "s"], "_by", 4_000)
    once = (F.col("r.kind") == "T") | (F.col("l") < F.col("r"))
    return j.where(once).select("block", F.col("s").alias("s_l"), F.col("s").alias("s_r"), "l", "r", F.lit(0).alias("edits"))


def linked_records(records: DataFrame) -> DataFrame:
    """(record_id, entity) for records (record_id, town, parts, phone) with a name: records of one business share entity.

    Records alike in town and parts are one node. A node's points are its name, core words joined; each word
    of a name of several; the name its site's host spells; and for names in other than Latin letters its
    phone. Points meet in blocks of town and trade; a node of unknown trade is put into each trade of its
    town. Two points link their nodes where the edits are few for their length, the given names or initials
    don't differ, and one word of a name has met a host. Records without town, or without any point, are in no link.
    """
    p = F.col("parts")
    d = records.where((F.col("town") != "") & ((F.size(p["core"]) > 0) | (p["host"] != ""))).select("record_id", "town", F.array_join(p["core"], " ").alias("core"), p["given"].alias("given"), p["trade"].alias("trade"), p["latin"].alias("latin"), p["host"].alias("host"), F.coalesce("phone", F.lit("")).alias("phone"))
    d = cut(d.dropDuplicates(["record_id"]))
    # a phone is a point only where a name in other letters has it
    foreign_phones = d.where("not latin and phone <> ''").select("town", "phone").distinct().withColumn("called", F.lit(True))
    d = d.join(foreign_phones, ["town", "phone"], "left").withColumn("phone", F.when(F.col("called"), F.col("phone")).otherwise("")).drop("called")
    keys = ["town", "core", "given", "trade", "latin", "host", "phone"]
    nodes = cut(d.groupBy(*keys).agg(F.min("record_id").alias("node")))
    words = F.split("core", " ")
    unglued = F.regexp_replace("core", r"(?<=[a-z]{5})(?:and|und)(?= |$)", "")  # a conjunction written on to the name before it
    pts = F.array_compact(
        F.concat(
            F.array(
                F.when((F.col("core") != "") & F.col("latin"), F.struct(F.lit("F").alias("kind"), F.array_join(words, "").alias("s"))),
                F.when((F.col("core") != "") & ~F.col("latin"), F.struct(F.lit("X").alias("kind"), F.array_join(words, "").alias("s"))),
                F.when((unglued != F.col("core")) & F.col("latin"), F.struct(F.lit("F").alias("kind"), F.replace(unglued, F.lit(" ")).alias("s"))),
                F.when(F.col("host") != "", F.struct(F.lit("H").alias("kind"), F.col("host").alias("s"))),
                F.when(F.col("phone") != "", F.struct(F.lit("P").alias("kind"), F.concat(F.lit("tel"), F.regexp_replace("phone", r"\D", "")).alias("s"))),
            ),
            F.when(F.col("latin") & (F.size(words) > 1), F.transform(words, lambda w: F.struct(F.lit("T").alias("kind"), w.alias("s")))).otherwise(F.array().cast("array<struct<kind:string,s:string>>")),
        )
    )
    points = nodes.select("town", "trade", "given", "node", "host", F.explode(pts).alias("x")).where(F.length("x.s") > 0)
    known = points.select("town", "trade").where("trade <> ''").distinct()
    everywhere = points.where("trade = ''").drop("trade").join(known, "town")
    points = points.unionByName(everywhere)
    points = cut(points.select(F.concat_ws("|", "town", "trade").alias("block"), F.col("x.s").alias("s"), F.struct("node", F.col("x.kind").alias("kind"), "given", "host").alias("p")))
    short = F.length("s") < SHORTEST
    pairs = metric_pairs(points.where(~short)).unionByName(equal_pairs(points.where(short)))
    a, b = F.col("l.kind"), F.col("r.kind")
    kinds = F.concat(F.least(a, b), F.greatest(a, b))
    shorter = F.least(F.length("s_l"), F.length("s_r"))
    other_host = (F.col("l.host") != "") & (F.col("r.host") != "") & (F.col("l.host") != F.col("r.host"))
    swapped = F.sort_array(F.split("s_l", "")) == F.sort_array(F.split("s_r", ""))
    near = (F.col("edits") <= F.when(shorter < 5, 0).when(shorter < 8, 1).when(shorter < 14, 2).otherwise(3)) | ((F.col("edits") == 2) & (shorter >= 5) & swapped)
    exact = F.col("edits") == 0
    g, h = F.col("l.given"), F.col("r.given")
    letters = F.create_map(*[F.lit(x) for pair in sorted(INITIALS.items()) for x in pair])
    initial = lambda x: F.coalesce(F.try_element_at(letters, x), F.substring(x, 1, 1))
    given = (g == "") | (h == "") | F.when(F.length(g) == 1, initial(h).contains(g)).when(F.length(h) == 1, initial(g).contains(h)).otherwise(g == h)
    link = F.when(kinds == "FF", near & given & ~other_host).when(kinds == "XX", exact).when(kinds == "HH", exact).when(kinds == "PP", exact).when(kinds == "FH", near & ~other_host).when(kinds == "HT", exact & ~other_host).otherwise(F.lit(False))
    edges = pairs.where((F.col("edits") <= 2) | (shorter >= 14)).where(link & (F.col("l.node") != F.col("r.node"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    labels = component_labels(edges, "a", "b")
    named = d.join(nodes, keys).select("record_id", "node")
    return named.join(labels.withColumnRenamed("id", "node"), "node", "left").select("record_id", F.coalesce("label", "node").alias("entity"))


def entity_pairs(linked: DataFrame, key: str = "record_id") -> DataFrame:
    """(id_a, id_b) of every two records of one entity, id_a the smaller. Large entities are split over tasks."""
    sizes = linked.groupBy("entity").count().where("count > 1").select("entity")
    e = linked.join(sizes, "entity", "left_semi")
    left, right = e.select("entity", F.col(key).alias("id_a")), e.select("entity", F.col(key).alias("id_b"))
    return salted_join(left, right, ["entity"], "id_a", 2_000).where("id_a < id_b").select("id_a", "id_b")
