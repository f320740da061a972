"""Moments with precision, and what is valid when."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, functions as F

from ..plans.ast import QueryError

_FORM = re.compile(r"(-?\d{1,9})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:\.\d+)?)?)?)?)?)?(Z|[+-]\d{2}:\d{2})?$")
PRECISIONS = ("year", "month", "day", "hour", "minute", "second")


def days(y: int, m: int, d: int) -> int:
    """Days since 1970 of a proleptic Gregorian date, for any year (0 is 1 BCE)."""
    cycles, rest = divmod(y, 400)
    return date(rest or 400, m, d).toordinal() + (cycles - (0 if rest else 1)) * 146_097 - date(1970, 1, 1).toordinal()


def parse(text: str) -> tuple[int, str]:
    """(epoch seconds, precision) of an ISO form from a year alone to a second; a sign in front means BCE, "-0500" being year -500."""
    m = _FORM.match(text.strip())
    if not m:
        raise QueryError(f"not a time: {text!r}")
    parts = [int(x) for x in m.groups()[:6] if x is not None]
    y, mo, d, h, mi, s = (*parts, *(0, 1, 1, 0, 0, 0)[len(parts) :])
    try:
        at = days(y, mo, d) * 86_400 + h * 3600 + mi * 60 + s
    except ValueError as e:
        raise QueryError(f"not a time: {text!r}: {e}") from None
    if (z := m[7]) and z != "Z":
        at -= (1 if z[0] == "+" else -1) * (int(z[1:3]) * 3600 + int(z[4:6]) * 60)
    return at, PRECISIONS[len(parts) - 1]


def interval(at: int, precision: str) -> tuple[int, int]:
    """[start, end) in seconds that a time of that precision covers."""
    fixed = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
    if precision in fixed:
        return at, at + fixed[precision]
    y, m = civil(at)
    if precision == "year":
        return at, days(y + 1, 1, 1) * 86_400
    return at, (days(y + 1, 1, 1) if m == 12 else days(y, m + 1, 1)) * 86_400


def civil(at: int) -> tuple[int, int]:
    cycles, rest = divmod(at // 86_400 + date(1970, 1, 1).toordinal() - 1, 146_097)
    d = date.fromordinal(rest + 1)
    return d.year + cycles * 400, d.month


def _sorted(c: Column) -> Column:
    return F.array_sort(F.array_compact(c))


def visible_at(starts: Column, ends: Column, asserted: Column, t: Column | int) -> Column:
    """Whether a statement with these annotations (arrays of seconds, maybe null) may hold at t.

    Sorted starts and ends are paired in order and hold from the one to the other, both included; a start too many holds from there on, an
    end too many until then. A statement with assertions alone is open, so it may hold at any time; one without annotations always holds.
    """
    t = F.lit(t) if isinstance(t, int) else t
    s, e, a = (_sorted(F.coalesce(x, F.array().cast("array<bigint>"))) for x in (starts, ends, asserted))
    n = F.least(F.size(s), F.size(e))
    closed = F.exists(F.zip_with(s, e, lambda x, y: (x <= t) & (t <= y)), lambda b: F.coalesce(b, F.lit(False)))
    later = (F.size(s) > n) & (F.get(s, n) <= t)
    until = (F.size(e) > n) & (F.get(e, F.size(e) - 1) >= t)
    alone = (F.size(s) == 0) & (F.size(e) == 0)
    return F.coalesce(closed, F.lit(False)) | F.coalesce(later, F.lit(False)) | F.coalesce(until, F.lit(False)) | F.array_contains(a, t.cast("bigint")) | alone


def overlaps(starts: Column, ends: Column, asserted: Column, low: int, high: int) -> Column:
    """Whether a statement may hold at some time from low to high. One with assertions alone does only if one of these lies there."""
    lo, hi = F.lit(low), F.lit(high)
    s, e, a = (_sorted(F.coalesce(x, F.array().cast("array<bigint>"))) for x in (starts, ends, asserted))
    n = F.least(F.size(s), F.size(e))
    closed = F.exists(F.zip_with(s, e, lambda x, y: (x <= hi) & (y >= lo)), lambda b: F.coalesce(b, F.lit(False)))
    later = (F.size(s) > n) & (F.get(s, n) <= hi)
    until = (F.size(e) > n) & (F.get(e, F.size(e) - 1) >= lo)
    told = F.exists(a, lambda x: (x >= lo) & (x <= hi))
    none = (F.size(s) == 0) & (F.size(e) == 0) & (F.size(a) == 0)
    return closed | F.coalesce(later, F.lit(False)) | F.coalesce(until, F.lit(False)) | told | none
