"""A small language of conditions, parsed once and compiled to columns.

Filters are four groups of conditions: include_all, include_any, exclude_all, exclude_any. A condition is a
mapping {field, op, value, negate}, {field: value} with an optional op and negate, or a text "field op value".
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("=", "!=", ">", "<", ">=", "<=", "in", "notin", "contains")
GROUPS = ("include_all", "include_any", "exclude_all", "exclude_any")
#: Other names of fields (fixed values).
ALIASES = {"reviews": "review_count", "require_email": "email_found", "has_website": "website", "gtm": "tag_manager", "rating_num": "rating"}
#: Fields that only the website's pages give (fixed values).
LATE_FIELDS = frozenset(
    "email_found emails email_count website_status website_failure_reason facebook instagram linkedin youtube twitter_x tiktok pinterest github snapchat tech_stack cms analytics tag_manager meta_pixel ga4 gtm "
    "advertising booking_system chat_widget ssl signal_pricing signal_financing signal_licensed_insured signal_established signal_portfolio signal_mobile_service signal_membership lead_score sentiment_score review_keywords "
    "decision_maker_name decision_maker_title mx_status smtp_status".split()
)
_TRUE, _FALSE = ("yes", "true", "y", "1"), ("no", "false", "n", "0", "")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any
    negate: bool = False


def parse(cond: Any) -> Condition:
    """A condition from any of its forms; ValueError for others and for unknown operators."""
    if isinstance(cond, str):
        words = cond.split(maxsplit=2)
        if len(words) == 3:
            return _checked(Condition(words[0], words[1], words[2]))
    elif isinstance(cond, dict) and "field" in cond:
        return _checked(Condition(str(cond["field"]), str(cond.get("op", "=")), cond.get("value"), bool(cond.get("negate", False))))
    elif isinstance(cond, dict):
        named = [k for k in cond if k not in ("op", "negate")]
        if len(named) == 1:
            return _checked(Condition(named[0], str(cond.get("op", "=")), cond[named[0]], bool(cond.get("negate", False))))
    raise ValueError(f"not a condition: {cond!r}")


def _checked(c: Condition) -> Condition:
    if c.op not in OPS:
        raise ValueError(f"unknown operator {c.op!r}")
    return c


def coerce(value: Any) -> Any:
    """A value as bool, int, float or trimmed text, whichever fits first."""
    if value is None or isinstance(value, (bool, int, float)):
        return value
    text = str(value).strip()
    if text.lower() in _TRUE:
        return True
    if text.lower() in _FALSE:
        return False
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


class Field:
    """What a field's text is as a bool, number or text; columns of other types are cast to text first."""

    def __init__(self, name: str, columns: list[str]):
        at = name if name == "email_found" and "email_found" in columns else ALIASES.get(name, name)
        if name == "email_found" and "email_found" not in columns and "emails" in columns:
            raw = F.when(F.coalesce(F.lower(F.trim("emails")).isin("", "n/a"), F.lit(True)), "no").otherwise("yes")
        elif name in ("website", "meta_pixel", "ga4", "gtm") and at in columns:
            missing = F.coalesce(F.lower(F.trim(F.col(at).cast("string"))).isin("", "n/a", "no"), F.lit(True))
            raw = F.when(missing, "no").otherwise("yes")
        else:
            raw = F.col(at).cast("string") if at in columns else F.lit(None).cast("string")
        self.text = F.trim(raw)
        low = F.lower(self.text)
        self.is_true, self.is_false = low.isin(*_TRUE), low.isin(*_FALSE)
        self.is_bool = self.is_true | self.is_false
        self.plain_number = F.when(self.text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), self.text.try_cast("double"))
        self.number = F.when(self.is_true, 1.0).when(self.is_false, 0.0).otherwise(self.plain_number)

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.text.isNull()
        if isinstance(value, (bool, int, float)):
            return F.coalesce(self.number == float(value), F.lit(False))
        return F.coalesce(~self.is_bool & self.plain_number.isNull() & (self.text == str(value)), F.lit(False))

    def spelled(self) -> Column:
        """As it reads once coerced."""
        whole = F.when(self.text.rlike(r"^[+-]?\d+$"), self.text.try_cast("decimal(38,0)").cast("string"))
        return F.when(self.text.isNull(), "None").when(self.is_true, "True").when(self.is_false, "False").otherwise(F.coalesce(whole, self.text))


def compile_condition(cond: Any, columns: list[str]) -> Column:
    """A condition as a column that is never NULL.

    Order comparisons are numeric and false where a side is no number; equality is on coerced values; the
    items of in and notin are taken as written. A missing field equals nothing and differs from everything.
    """
    c = parse(cond)
    field = Field(c.field, columns)
    if c.op in (">", "<", ">=", "<="):
        expected = coerce(c.value)
        if isinstance(expected, str) or expected is None:
            test = F.lit(False)
        else:
            x, y = field.number, F.lit(float(expected))
            test = F.coalesce({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[c.op], F.lit(False))
    elif c.op in ("=", "!="):
        test = field.equals(coerce(c.value))
        test = ~test if c.op == "!=" else test
    elif c.op in ("in", "notin"):
        items = c.value if isinstance(c.value, (list, tuple, set)) else [coerce(c.value)]
        test = reduce(lambda a, b: a | b, [field.equals(x) for x in items], F.lit(False))
        test = ~test if c.op == "notin" else test
    else:
        expected = coerce(c.value)
        test = field.spelled().contains(str(expected))
    return ~test if c.negate else test


def _all(conds: list, columns: list[str]) -> Column | None:
    return reduce(lambda a, b: a & b, [compile_condition(c, columns) for c in conds]) if conds else None


def _any(conds: list, columns: list[str]) -> Column | None:
    return reduce(lambda a, b: a | b, [compile_condition(c, columns) for c in conds]) if conds else None


def rejection(filters: dict[str, list], columns: list[str]) -> Column:
    """The group that rejects a row, in the order of GROUPS; NULL for a row that is kept. Empty groups reject nothing."""
    out = F.lit(None).cast("string")
    tests = {"include_all": _all, "include_any": _any, "exclude_all": _all, "exclude_any": _any}
    for name in reversed(GROUPS):
        test = tests[name](list(filters.get(name) or []), columns)
        if test is not None:
            out = F.when(~test if name.startswith("include") else test, F.lit(name)).otherwise(out)
    return out


def apply(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    return df.where(rejection(filters, df.columns).isNull())


def split(filters: dict[str, list], late: frozenset[str] = LATE_FIELDS) -> tuple[dict[str, list], dict[str, list]]:
    """The conditions that can be tested before a website's pages are known, and the others, by group."""
    early: dict[str, list] = {}
    later: dict[str, list] = {}
    for name in GROUPS:
        for cond in filters.get(name) or []:
            (later if parse(cond).field in late else early).setdefault(name, []).append(cond)
    return early, later
