"""Several values packed in one field: inferring the delimiters of a source, and splitting by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.plans.lineage import cut
from leadloom.sources.tables import is_missing

#: Candidate delimiters. Hard ones never stand within a word; soft ones may.
HARD = {"comma": r"\s*,\s*", "semicolon": r"\s*;\s*", "pipe": r"\s*\|\s*", "dot": r"\s*[·•]\s*", "newline": r"\s*[\r\n]\s*", "tab": r"\s*\t\s*"}
SOFT = {"spaced slash": r"\s+/\s+", "spaced hyphen": r"\s+[-–—]\s+", "slash": r"/", "space": r"\s+"}
CANDIDATES = HARD | SOFT
#: Score from which a candidate is taken: pieces known from cells without it weigh 0.7, cells of several pieces 0.3.
#: Soft ones need their pieces known; hard ones that mostly do split cells are taken also where all values are new.
LEAST_SCORE = 0.6
LEAST_HARD_SCORE = 0.25
_MARK = "\u001f"


def _unwrap_cell(cell: Column) -> Column:
    c = F.regexp_replace(cell, r"^\s+|\s+$", "")
    return F.when(c.rlike(r"(?s)^\[.*\]$"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def _outside(cell: Column, change) -> Column:
    """`change` done to what stands outside double quotes; with an odd number of quotes none of them quotes."""
    parts = F.split(cell, '"', -1)
    return F.when(F.size(parts) % 2 == 0, change(cell)).otherwise(F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, change(x)).otherwise(x)), '"'))


def _unwrap_piece(piece: Column) -> Column:
    p = F.regexp_replace(piece, r"^\s+|\s+$", "")
    inner = F.substring(p, F.lit(2), F.length(p) - 2)
    p = F.when((F.length(p) >= 2) & p.startswith('"') & p.endswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(p.rlike(r"(?s)^(?:'[^']*'|“[^”]*”|«[^»]*»|\[[^\]]*\])$"), inner).otherwise(p)
    return F.regexp_replace(p, r"^\s+|\s+$", "")


def split_cell(cell: Column, patterns: list[str]) -> Column:
    """The values of a cell in order, unwrapped, without empty ones."""
    c = _unwrap_cell(cell)
    marked = _outside(c, lambda x: F.regexp_replace(x, "|".join(patterns), _MARK)) if patterns else c
    return F.filter(F.transform(F.split(marked, _MARK, -1), _unwrap_piece), lambda x: x != "")


def _kind(piece: Column) -> Column:
    """A piece's type where it is a regular one, else the piece in lower case."""
    p = F.lower(piece)
    return F.when(p.rlike(r"^\S+@\S+\.\w{2,}$"), "<email>").when(p.rlike(r"^https?://\S+$"), "<url>").otherwise(p)


def cells(df: DataFrame, key: str, fields: list[str], carried: list[str] | None = None) -> DataFrame:
    """(key, source, cell) of the non-missing cells of `fields`, and the columns to be carried along; each field is a source of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("source"), F.col(f).alias("cell")) for f in fields])).alias("p")
    more = carried or []
    return df.select(F.col(key), *more, pairs).select(key, *more, "p.source", "p.cell").where(~is_missing(F.col("cell")))


def _pieces_split_by(texts: Column, pattern: str) -> Column:
    """All pieces of those texts that the pattern splits."""
    return F.flatten(F.transform(F.filter(texts, lambda x: x.rlike(pattern)), lambda x: F.split(x, pattern)))


def delimiter_scores(cell_rows: DataFrame) -> DataFrame:
    """(source, candidate, cells, score) for each source of `cell_rows` (source, cell) and each candidate it shows.

    A hard candidate is scored on the cells that hold it outside quotes, a soft one on the unquoted pieces
    between hard delimiters that it would split further. Type regularity: the share of the pieces whose type
    or text is also a piece of cells without the candidate. Piece-count consistency: the share of those
    cells that come out in two pieces at least.
    """
    hard = list(HARD.values())
    c = _unwrap_cell(F.col("cell"))
    marked = _outside(c, lambda x: F.regexp_replace(x, "|".join(hard), _MARK))
    d = cell_rows.select("source", c.alias("cell"), F.filter(F.transform(F.split(marked, _MARK, -1), lambda x: F.trim(x)), lambda x: x != "").alias("raw"))
    d = d.withColumn("outside", F.when((F.size(F.split("cell", '"', -1)) % 2) == 1, F.regexp_replace("cell", '"[^"]*+"', "")).otherwise(F.col("cell")))
    d = d.withColumn("open", F.filter("raw", lambda x: ~x.contains('"')))
    used = []
    for name, pattern in CANDIDATES.items():
        if name in HARD:
            holds, pieces = F.col("outside").rlike(pattern), F.transform("raw", _unwrap_piece)
        else:  # the spaced ones come first: a blank beside them is theirs
            base = F.col("open") if name.startswith("spaced") else F.flatten(F.transform("open", lambda x: F.split(x, SOFT["spaced slash"] + "|" + SOFT["spaced hyphen"])))
            pieces = _pieces_split_by(base, pattern)
            holds = F.size(pieces) > 0
        used.append(F.when(holds, F.struct(F.lit(name).alias("candidate"), F.transform(pieces, _kind).alias("pieces"))))
    d = d.select("source", F.transform("raw", lambda x: _kind(_unwrap_piece(x))).alias("pieces"), F.array_compact(F.array(*used)).alias("used"))
    # all that is counted comes from one pass: pieces between hard delimiters by what their cells lack, pieces of
    # each candidate, and the candidate's cells; counts are small before anything is shuffled
    d = d.withColumn("lacks", F.array_except(F.array(*[F.lit(n) for n in CANDIDATES]), F.transform("used", lambda x: x["candidate"])))
    one = lambda kind, candidates, pieces: F.struct(F.lit(kind).alias("kind"), candidates.alias("candidates"), pieces.alias("pieces"))
    known = F.array(one("known", F.col("lacks"), F.col("pieces")))
    split = F.transform("used", lambda u: one("split", F.array(u["candidate"]), u["pieces"]))
    each = F.transform("used", lambda u: one("cells", F.array(u["candidate"]), F.array(F.when(F.size(u["pieces"]) >= 2, "several").otherwise("one"))))
    rows = d.select("source", F.explode(F.concat(known, split, each)).alias("x")).select("source", "x.kind", "x.candidates", F.explode("x.pieces").alias("piece"))
    counts = cut(rows.groupBy("source", "kind", "candidates", "piece").count())
    counts = counts.withColumn("candidate", F.explode("candidates")).groupBy("source", "kind", "candidate", "piece").agg(F.sum("count").alias("count"))
    cells_ = counts.where("kind = 'cells'").groupBy("source", "candidate").agg(F.sum("count").alias("cells"), (F.coalesce(F.sum(F.when(F.col("piece") == "several", F.col("count"))), F.lit(0)) / F.sum("count")).alias("consistency"))
    pieces = counts.where("kind = 'split'").select("source", "candidate", "piece", F.col("count").alias("n"))
    lacking = counts.where("kind = 'known'").select("source", "candidate", "piece", F.lit(1).alias("known"))
    seen = pieces.join(lacking, ["source", "candidate", "piece"], "left").groupBy("source", "candidate").agg((F.sum(F.col("n") * F.coalesce("known", F.lit(0))) / F.sum("n")).alias("regularity"))
    return cells_.join(seen, ["source", "candidate"], "left").select("source", "candidate", "cells", (0.7 * F.coalesce("regularity", F.lit(0.0)) + 0.3 * F.col("consistency")).alias("score"))


def inferred_delimiters(cell_rows: DataFrame) -> dict[str, list[str]]:
    """The candidates taken for each source. Its rows to the driver are sources times candidates at most."""
    out: dict[str, list[str]] = {}
    least = F.when(F.col("candidate").isin(*HARD), LEAST_HARD_SCORE).otherwise(LEAST_SCORE)
    for r in delimiter_scores(cell_rows).where(F.col("score") >= least).collect():
        out.setdefault(r["source"], []).append(r["candidate"])
    return {s: [n for n in CANDIDATES if n in names] for s, names in out.items()}


def unpack(df: DataFrame, key: str, fields: list[str], carried: list[str] | None = None) -> DataFrame:
    """(key, field_name, pos, item): a row for every value of every non-missing cell of `fields`, pos from 1; columns to be `carried` along follow.

    Wrapping quotes and brackets go, a doubled quote inside quotes is one, empty pieces take no position,
    and delimiters inside quotes belong to the value. NULL and missing cells and empty tables give no rows.
    """
    rows = cells(df, key, fields, carried)
    taken = inferred_delimiters(rows.select("source", "cell"))
    by_source = F.lit(None).cast("array<string>")
    for f in fields:
        by_source = F.when(F.col("source") == f, split_cell(F.col("cell"), [CANDIDATES[n] for n in taken.get(f, [])])).otherwise(by_source)
    out = rows.select(key, F.col("source").alias("field_name"), F.posexplode(by_source).alias("pos", "item"), *(carried or []))
    return out.withColumn("pos", F.col("pos") + 1)
