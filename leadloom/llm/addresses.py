"""Postal addresses of the same place: parts, mined rewrites, and rematching until no new rewrite appears."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.names import distance, fold
from leadloom.operators.skew import salted_join
from leadloom.plans.lineage import cut

# Fixed values ------------------------------------------------------------------------------------------------

#: Words that tell a street's type in English, German, French and Spanish, folded.
STREET_TYPES = frozenset(
    "street st str avenue ave av road rd boulevard blvd boul lane ln drive dr court ct crt parkway pkwy pky place pl square sq terrace ter way crescent close highway hwy "
    "strasse weg gasse allee platz ufer ring damm chaussee rue r bd chemin ch impasse imp quai route rte cours passage calle c avenida avda plaza paseo camino carretera".split()
)
DIRECTIONS = {"n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "nord": "n", "sud": "s", "ost": "e", "ouest": "w"}
_ARTICLES = frozenset("de du des la le les l d of the del los las el".split())
_UNIT = r"(?:suite|ste|unit|apartment|apt|appt|appartement|room|rm|floor|fl|haus|wohnung|whg|og|eg|etage|stock|bat|batiment|escalier|piso|local|puerta)"
_UNITS = re.compile(rf"\b\d{{1,3}}(?:st|nd|rd|th)\s+(?:floor|fl)\b\.?|\b\d{{1,2}}\.?\s*(?:og|etage|stock|eme etage|o piso)\b\.?(?:\s*\d\w?\b)?|(?:\b{_UNIT}\b\.?|#)\s*(?:no\.?\s*)?#?\s*(?:\d+[a-z]?|[a-z]\d*)\b")
_COUNTRIES = re.compile(r"\b(?:united states(?: of america)?|u\.?\s?s\.?\s?a\.?|united kingdom|great britain|england|scotland|wales|deutschland|germany|france|canada|can|espana|spain|u\.s\.|us|uk|gb|ca|de|fr|es)$|^(?:united states(?: of america)?|u\.?\s?s\.?\s?a\.?|united kingdom|great britain|england|deutschland|germany|france|canada|can|us|uk|gb|ca|de|fr|es)\b")
#: Names of states and provinces by their abbreviations.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
    "ab": "alberta", "bc": "british columbia", "mb": "manitoba", "nb": "new brunswick", "nl": "newfoundland", "ns": "nova scotia", "on": "ontario", "pe": "prince edward island", "qc": "quebec", "sk": "saskatchewan",
}
_STATE_NAMES = "|".join(sorted(STATES.values(), key=len, reverse=True))
_POSTAL = re.compile(r"\b(?:[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2}|[a-z]\d[a-z]\s?\d[a-z]\d|(?:d|f|e)-\d{5}|\d{5}-\d{4})\b|(?<![\w-])[\dol]{5}(?![\w-])")
_GERMAN = frozenset("strasse str weg gasse allee platz ufer ring damm chaussee".split())
_COMPOUND = re.compile(r"^(\w{3,}?)-?(strasse|str|weg|gasse|allee|platz|ufer|ring|damm|chaussee)$")
#: Number words of numbered streets and their figures.
ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), "1st 2nd 3rd 4th 5th 6th 7th 8th 9th 10th 11th 12th".split()))
_NUMBER = re.compile(r"^\d{1,5}[a-z]?$")


def postal_key(postal: str | None) -> str:
    """A postal code in one form: five digits or letters and digits, the letters O, I and L read as digits."""
    if not postal:
        return ""
    p = re.sub(r"^[a-z]{1,2}-", "", fold(postal).strip())
    p = re.sub(r"(?<=\d{5})-\d{4}$", "", re.sub(r"\s", "", p).translate(str.maketrans("oil", "011")))
    return re.sub(r"[^a-z0-9]", "", p)


def postal_in(full: str | None) -> str:
    """The last postal code written in a full address."""
    found = list(_POSTAL.finditer(fold(full))) if full else []
    return postal_key(found[-1].group()) if found else ""


def street_part(address: str | None, full: str | None, town: str, state: str | None, postal: str | None) -> dict | None:
    """number, street words, type and direction of an address; None where there is no street with a number.

    The short address is taken where it is given, else the full one. Units, postal codes, states, countries
    and the town go first, then what is left around the number is the street.
    """
    for raw in (address, full):
        if not raw:
            continue
        found = _street(raw, town, state, raw is full)
        if found:
            return found
    return None


def _street(raw: str, town: str, state: str | None, whole: bool) -> dict | None:
    text = re.sub(r"\bn[or°º]\.?\s*(?=\d)", " ", fold(raw))
    text = re.sub(r"\bbis\b|\bquater\b|\bter\b(?=\s)", lambda m: m.group() if m.group() == "ter" else "bis", text)
    text = re.sub(r"(\d)\s+bis\b", r"\1b", text)
    segments = [x.strip() for x in re.split(r"[,\n|·;]|\s-\s", _UNITS.sub(",", text)) if x.strip()]
    place = re.findall(r"[^\W_]+", fold(town)) if town else []
    best = None
    for segment in segments:
        s = segment
        if whole or len(segments) > 1:
            s = _COUNTRIES.sub(" ", _COUNTRIES.sub(" ", s.strip()).strip())
            s = re.sub(rf"\b(?:{_STATE_NAMES})\b(?=\s*(?:$|[\dol]{{5}}|[a-z]\d))", " ", s)
            left = _POSTAL.sub(" ", s)
            if re.search(r"\d", left) or not re.search(r"\d", s) or len(segments) == 1:
                s = left
            elif not re.fullmatch(r"\s*\d{1,4}\s*", s):
                s = left
        words = re.findall(r"\d{1,3}(?:st|nd|rd|th)\b|[^\W_]+", s.replace("'", " ").replace("’", " "))
        if len(segments) > 2 and (" ".join(words) in STATES or " ".join(words) in STATES.values()):
            continue  # a state in a part of its own
        if place and (whole or len(segments) > 1):
            words = _without_town(words, place)
        if state and words and len(words) > 2 and fold(state) in words and whole:
            i = len(words) - 1 - words[::-1].index(fold(state))
            if fold(state) not in DIRECTIONS or i == len(words) - 1:
                words = words[:i] + words[i + 1 :]
        if not words:
            continue
        cand = (any(_NUMBER.match(w) for w in words), any(re.search(r"[a-z]{2}|\d(?:st|nd|rd|th)", w) for w in words), words)
        if cand[0] and cand[1]:
            best = words
            break
        if cand[0] and best is None:
            best = ("number", words)
        elif cand[1] and isinstance(best, tuple) and best[0] == "number":
            best = [*best[1], *words]  # "27, Magnolia Dr"
            break
        elif cand[1] and best is None:
            best = ("street", words)
        elif cand[0] and isinstance(best, tuple) and best[0] == "street":
            best = [*best[1], *words]
            break
    if not isinstance(best, list):
        return None
    return _parts(best)


def _without_town(words: list[str], place: list[str]) -> list[str]:
    n = len(place)
    for i in range(len(words) - n + 1):
        if all(w == p or (len(p) >= 5 and distance(w, p, 2) <= 2) for w, p in zip(words[i : i + n], place)):
            return words[:i] + words[i + n :]
    return words


@cache
def _slipped_article(word: str) -> bool:
    """Whether a short word, which stands between a street's type and its name, is an article but for a slip."""
    return len(word) <= 4 and any(len(a) > 1 and distance(word, a, 1) <= 1 for a in _ARTICLES)


def _parts(words: list[str]) -> dict | None:
    numbers = [i for i, w in enumerate(words) if _NUMBER.match(w)]
    if not numbers:
        return None
    at = numbers[0]
    number = words[at]
    rest = words[:at] + words[at + 1 :]
    rest = [w for i, w in enumerate(rest) if not (_NUMBER.match(w) or (len(w) == 1 and w not in DIRECTIONS and w not in STREET_TYPES))]
    split = []
    for w in rest:
        w = ORDINALS.get(w, w)
        m = _COMPOUND.match(w)
        split += [m.group(1), m.group(2)] if m and m.group(1) not in STREET_TYPES else [w]
    # a hyphenated compound comes as two words already
    core, types, way = [], [], ""
    for i, w in enumerate(split):
        if w in DIRECTIONS and len(split) > 1 and not way:
            way = DIRECTIONS[w]
        elif w in STREET_TYPES and len(split) > 1:
            types.append(w)
        elif w not in _ARTICLES and not (types and i + 1 < len(split) and _slipped_article(w)):
            core.append(w)
    if not core:  # a street called like a type
        core, types = types, []
    if not core:
        return None
    if types and types[-1] in _GERMAN:  # ae, oe and ue are umlauts written out
        core = [re.sub(r"(?<=[aou])e", "", w) if len(w) > 4 else w for w in core]
    return {"number": number, "core": sorted(core), "kind": types[-1] if types else "", "way": way}


def address_parts(df: DataFrame, address: str, full: str, town: str, state: str, postal: str) -> DataFrame:
    """`df` with a struct `place`: number, core words, type, direction and postal key; NULL without street and number."""

    @F.pandas_udf("struct<number: string, core: array<string>, kind: string, way: string, postal: string>")
    def parse(a: pd.Series, f: pd.Series, t: pd.Series, s: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = []
        for x in zip(a, f, t, s, p):
            got = street_part(*x)
            out.append({"number": None, "core": None, "kind": None, "way": None, "postal": None} if got is None else got | {"postal": postal_key(x[4]) or postal_in(x[1])})
        return pd.DataFrame(out, columns=["number", "core", "kind", "way", "postal"])

    return df.withColumn("place", parse(address, full, town, state, postal))


# Mining ------------------------------------------------------------------------------------------------------

#: Critical value of the likelihood ratio at 1 in 1000; the share of its contexts that a word shares with what it is rewritten to; the least contexts for unlike words.
SIGNIFICANT, LEAST_SHARE, LEAST_CONTEXTS = 10.83, 0.5, 4
#: Rounds after which mining that still finds rewrites is taken for an error: each one moves words to more frequent ones, so it ends.
MOST_ROUNDS = 60
#: Rewrites up to which their table, counted first, is sent to all tasks.
SENT_REWRITES = 200_000


def _leave_one_out(forms: DataFrame) -> DataFrame:
    """(slot, context, token, n): the words of `forms` with all that they agree in elsewhere, n records.

    A core word's context is town and number with the other core words and the postal code, or the type where
    there is no postal code in one of the two; a type's is town, number, postal code and core.
    """
    same = F.concat_ws("|", "town", "number", "postal")
    by_kind = F.concat_ws("|", "town", "number", F.lit("kind"), "kind", "way")
    core = F.transform("core", lambda t, i: F.struct(F.lit("core").alias("slot"), F.concat_ws("|", same, F.array_join(F.filter(F.col("core"), lambda x, j: j != i), " ")).alias("context"), t.alias("token")))
    typed = F.transform("core", lambda t, i: F.struct(F.lit("typed").alias("slot"), F.concat_ws("|", by_kind, F.array_join(F.filter(F.col("core"), lambda x, j: j != i), " ")).alias("context"), t.alias("token")))
    none = F.array().cast("array<struct<slot:string,context:string,token:string>>")
    kind = F.when((F.col("kind") != "") & (F.col("postal") != ""), F.array(F.struct(F.lit("kind").alias("slot"), F.concat_ws("|", same, F.array_join("core", " ")).alias("context"), F.col("kind").alias("token")))).otherwise(none)
    all_slots = F.concat(F.when(F.col("postal") != "", core).otherwise(none), F.when(F.col("kind") != "", typed).otherwise(none), kind)
    return forms.select("n", F.explode(all_slots).alias("x")).select("x.*", "n").groupBy("slot", "context", "token").agg(F.sum("n").alias("n"))


def _log_term(k: Column, expected: Column) -> Column:
    return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))


def mine_rewrites(forms: DataFrame) -> DataFrame:
    """(slot, token, by): significant rewrites among `forms` (town, number, postal, core, kind, n).

    Counted are contexts that two records or more attest. In each its most frequent word is the hub; every
    other word there makes a pair with it. A pair's contexts are held against those of either word by the
    likelihood ratio of independence, and against those of the rarer word, which is to be rewritten: the
    name of another street is attested in many contexts without the hub, a misspelling or an abbreviation
    in few, so a core word must share half of them. Words alike need no more; unlike ones need several
    contexts and significance. Of types, abbreviations and slips are rewritten, others as unlike words.
    """
    slots = _leave_one_out(forms)
    attested = slots.groupBy("slot", "context").agg(F.sum("n").alias("records"), F.collect_list(F.struct("token", "n")).alias("words")).where("records > 1").select("slot", "context", F.size("words").alias("many"), F.explode("words").alias("w"))
    attested = cut(attested.select("slot", "context", "many", "w.token", "w.n"))
    totals = attested.groupBy("slot", "token").agg(F.count("*").alias("contexts"), F.sum("n").alias("times"))
    total = {r["slot"]: r["n"] for r in attested.groupBy("slot").agg(F.count_distinct("context").alias("n")).collect()}  # three slots
    met = attested.where("many > 1").join(totals, ["slot", "token"])
    groups = met.groupBy("slot", "context").agg(F.max(F.struct("times", "token", "contexts")).alias("hub"), F.collect_list(F.struct("token", "contexts", "times")).alias("words"))
    pairs = groups.select("slot", "hub", F.explode("words").alias("w")).where(F.col("w.token") != F.col("hub.token"))
    p = pairs.groupBy("slot", F.col("w.token").alias("token"), F.col("hub.token").alias("by")).agg(F.count("*").alias("both"), F.first("w.contexts").alias("n_a"), F.first("hub.contexts").alias("n_b"), F.first("hub.times").alias("times_b"))
    n = F.coalesce(*[F.when(F.col("slot") == s, F.lit(float(k))) for s, k in sorted(total.items())], F.lit(1.0))
    k11, a, b = (F.col(c).cast("double") for c in ("both", "n_a", "n_b"))
    k12, k21, k22 = a - k11, b - k11, F.greatest(n - a - b + k11, F.lit(0.0))
    ratio = 2 * (_log_term(k11, a * b / n) + _log_term(k12, a * (n - b) / n) + _log_term(k21, (n - a) * b / n) + _log_term(k22, (n - a) * (n - b) / n))
    edits = F.levenshtein("token", "by")
    length = F.least(F.length("token"), F.length("by"))
    swapped = (length >= 3) & (F.sort_array(F.split("token", "")) == F.sort_array(F.split("by", "")))
    misspelt = ((edits <= 1) & (length >= 3)) | ((edits == 2) & (swapped | (length >= 7))) | ((edits == 3) & (length >= 10))
    # an abbreviation begins alike and keeps the order of the letters
    a_short = F.when(F.length("token") <= F.length("by"), F.col("token")).otherwise(F.col("by"))
    a_long = F.when(F.length("token") <= F.length("by"), F.col("by")).otherwise(F.col("token"))
    abbreviated = (F.substring(a_short, 1, 1) == F.substring(a_long, 1, 1)) & F.rlike(a_long, F.concat(F.lit("^"), F.array_join(F.transform(F.split(a_short, ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), ".*")))
    digits = F.col("token").rlike("[0-9]") | F.col("by").rlike("[0-9]")
    both_digits = F.col("token").rlike("[0-9]") & F.col("by").rlike("[0-9]")
    mostly = k11 / a >= LEAST_SHARE
    unlike = mostly & (k11 >= LEAST_CONTEXTS) & (ratio > SIGNIFICANT)
    core_ok = F.when(both_digits, F.lit(False)).when(digits, unlike).otherwise((misspelt & mostly) | unlike)
    kind_ok = abbreviated | misspelt | unlike
    typed_ok = misspelt & ~digits & mostly  # without a postal code only words that are alike
    kept = p.where(F.when(F.col("slot") == "kind", kind_ok).when(F.col("slot") == "typed", typed_ok).otherwise(core_ok))
    kept = kept.withColumn("slot", F.when(F.col("slot") == "typed", "core").otherwise(F.col("slot")))
    return kept.groupBy("slot", "token").agg(F.max_by("by", F.struct("both", "times_b", "by")).alias("by"))


def _resolved(rewrites: DataFrame) -> DataFrame:
    """`rewrites` with words that are rewritten themselves replaced by what they become, one step and then two."""
    for _ in range(2):
        further = rewrites.select("slot", F.col("token").alias("by"), F.col("by").alias("_by"))
        rewrites = rewrites.join(further, ["slot", "by"], "left").select("slot", "token", F.coalesce("_by", "by").alias("by"))
    return rewrites.where("token <> by")


def _rewrite(forms: DataFrame, rewrites: DataFrame, few: bool) -> DataFrame:
    """`forms` (with id) with their words rewritten; the table of rewrites is sent to all tasks where it is found to be short."""
    sent = F.broadcast if few else (lambda t: t)
    r = rewrites.select("slot", "token", "by")
    kinds = r.where("slot = 'kind'").select(F.col("token").alias("kind"), F.col("by").alias("new_kind"))
    cores = r.where("slot = 'core'").select("token", "by")
    words = forms.select("id", F.explode("core").alias("token")).join(sent(cores), "token", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.coalesce("by", "token"))).alias("new_core"))
    d = forms.join(words, "id").join(sent(kinds), "kind", "left")
    return d.select("id", "town", "number", "postal", F.col("new_core").alias("core"), F.coalesce("new_kind", "kind").alias("kind"), "way", "n")


def normalised_forms(forms: DataFrame) -> DataFrame:
    """`forms` (id, town, number, postal, core, kind, way, n) rewritten until mining finds nothing new."""
    d = forms
    for _ in range(MOST_ROUNDS):
        found = cut(mine_rewrites(d))
        many = found.count()
        if not many:
            return d
        d = cut(_rewrite(d, _resolved(found), many <= SENT_REWRITES))
    raise RuntimeError(f"rewrites not settled after {MOST_ROUNDS} rounds")


def same_place_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b) of records (record_id, town, place) with the same street, number and town, id_a the smaller.

    Records that agree in all parts are one form; forms are rewritten by normalised_forms(). Two forms are the
    same place if town, number and core words agree, and type and direction agree or one is missing, in which
    case their postal codes mustn't differ. Records without town or place are in no pair.
    """
    parts = ["town", "number", "postal", "core", "kind", "way"]
    d = records.where(F.col("place.number").isNotNull() & (F.col("town") != "")).select("record_id", "town", "place.*")
    forms = d.groupBy(*parts).agg(F.count("*").alias("n"), F.min("record_id").alias("id"))
    forms = cut(forms)
    members = d.join(forms.select(*parts, "id"), parts).select("record_id", "id")
    done = normalised_forms(forms).select("id", "town", "number", F.array_join("core", " ").alias("street"), "kind", "way", "postal")
    m = cut(members.join(done, "id").drop("id"))
    keys = ["town", "number", "street"]
    left = m.select(*keys, *[F.col(c).alias(f"{c}_l") for c in ("kind", "way", "postal")], F.col("record_id").alias("id_a"))
    right = m.select(*keys, *[F.col(c).alias(f"{c}_r") for c in ("kind", "way", "postal")], F.col("record_id").alias("id_b"))
    alike = lambda c: (F.col(f"{c}_l") == F.col(f"{c}_r"))
    lacks = lambda c: (F.col(f"{c}_l") == "") | (F.col(f"{c}_r") == "")
    ok = (alike("kind") & alike("way")) | ((alike("kind") | lacks("kind")) & (alike("way") | lacks("way")) & (alike("postal") | lacks("postal")))
    return salted_join(left, right, keys, "id_a", 2_000).where((F.col("id_a") < F.col("id_b")) & ok).select("id_a", "id_b")
