"""Date recognition: a table of patterns, each a regular expression with a Spark format that must parse as well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {
    "en": "January February March April May June July August September October November December",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

#: name, regular expression, format that the (rewritten) text must parse under; None where the expression decides alone.
PATTERNS: list[tuple[str, str, str | None]] = [
    ("dd.mm.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ("yyyy-mm-dd", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("yy-mm-dd", r"^\d{2}-\d{2}-\d{2}$", "yy-MM-dd"),
    ("iso", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    ("iso zone", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})$", None),
    ("datetime", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    ("dd.mm.yyyy hh:mm", r"^\d{1,2}\.\d{1,2}\.\d{4} \d{2}:\d{2}$", "d.M.yyyy HH:mm"),
    ("dd.mm.yyyy hh:mm:ss", r"^\d{1,2}\.\d{1,2}\.\d{4} \d{2}:\d{2}:\d{2}$", "d.M.yyyy HH:mm:ss"),
    ("dd/mm/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("mm/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("yyyy/mm/dd", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("rfc 2822", rf"^(?:[A-Z][a-z]{{2}}, )?\d{{1,2}} (?:{_SHORT}) \d{{4}} \d{{2}}:\d{{2}}(?::\d{{2}})? (?:[+-]\d{{4}}|GMT|UTC|[A-Z]{{2,4}})$", None),
    ("d month yyyy", rf"^(?i)\d{{1,2}}\s+(?:{'|'.join(' '.join(_MONTHS.values()).split())}|{_SHORT})\.?,?\s+\d{{4}}(?:\s*г\.?)?$", None),
    ("month d, yyyy", rf"^(?i)(?:{'|'.join(_MONTHS['en'].split())}|{_SHORT})\.?\s+\d{{1,2}},?\s+\d{{4}}$", None),
]


def _fits(s: Column, regex: str, fmt: str | None) -> Column:
    ok = s.rlike(regex)
    if fmt is None:
        return ok
    return ok & F.try_to_timestamp(F.when(ok, s), F.lit(fmt)).isNotNull()


def is_date(s: Column) -> Column:
    # one cheap test before all patterns: a date has a digit and is short
    some = (F.char_length(s) <= 40) & s.rlike(r"\d")
    return F.coalesce(some & reduce(lambda a, b: a | b, [_fits(s, r, f) for _, r, f in PATTERNS]), F.lit(False))


def date_pattern(s: Column) -> Column:
    """Name of the first pattern that fits, or null."""
    out = F
    for name, regex, fmt in PATTERNS:
        out = out.when(_fits(s, regex, fmt), F.lit(name))
    return out
