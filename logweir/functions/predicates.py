"""Filter conditions over log records as plain columns.

Names are compared after bringing the *arguments* to the stored case, so the conditions reach the
parquet scan. ``canonical=False`` also accepts records whose stored names have another case.
"""

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions import fixed

_SPELLINGS = {
    name: {full, short}
    for full, short in zip(fixed.SEVERITY_NAMES, fixed.SEVERITY_SHORT_NAMES)
    for name in (full, short)
}


def clean(items: Iterable[str]) -> list[str]:
    """Trimmed, lower-cased, non-blank items in order, each once."""
    return list(dict.fromkeys(i.strip().lower() for i in items if i.strip()))


def _contains_any(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, [F.contains(F.lower(text), F.lit(p)) for p in patterns])


def includes_any(text: Column, patterns: Iterable[str]) -> Column | None:
    """Some pattern occurs in the text, ignoring case; None when there is nothing to require."""
    patterns = [p.lower() for p in patterns]
    return _contains_any(text, patterns) if patterns else None


def excludes_all(text: Column, patterns: Iterable[str]) -> Column | None:
    """No pattern occurs in the text, ignoring case; None when there is nothing to reject."""
    patterns = [p.lower() for p in patterns]
    return ~_contains_any(text, patterns) if patterns else None


def line_includes_any(patterns: Iterable[str], line: str = "line") -> Column | None:
    return includes_any(F.col(line), patterns)


def line_excludes_all(patterns: Iterable[str], line: str = "line") -> Column | None:
    return excludes_all(F.col(line), patterns)


def _name_in(column: Column, names: list[str], canonical: bool) -> Column:
    stored = column if canonical else F.lower(column)
    return column.isNotNull() & stored.isin(*names)


def severity_in(
    names: Iterable[str], column: str | Column = "severity", canonical: bool = True
) -> Column | None:
    """Severity is one of the names, in either spelling (ERR or ERROR); null never is."""
    names = clean(names)
    if not names:
        return None
    wanted = sorted({s for n in names for s in _SPELLINGS.get(n.upper(), {n.upper()})})
    wanted = wanted if canonical else [w.lower() for w in wanted]
    return _name_in(F.col(column) if isinstance(column, str) else column, wanted, canonical)


def severity_hidden(names: Iterable[str], column: str = "severity") -> Column | None:
    """Keep every level but the hidden ones; None when nothing is hidden."""
    hidden = {s for n in clean(names) for s in _SPELLINGS.get(n.upper(), {n.upper()})}
    kept = [n for n in fixed.SEVERITY_NAMES if n not in hidden]
    if len(kept) == len(fixed.SEVERITY_NAMES):
        return None
    return severity_in(kept, column) if kept else F.lit(False)


def facility_in(
    names: Iterable[str], column: str | Column = "facility", canonical: bool = True
) -> Column | None:
    """Facility name is one of the names; null never is."""
    names = clean(names)
    if not names:
        return None
    return _name_in(F.col(column) if isinstance(column, str) else column, names, canonical)


def facility_matches(codes: Iterable[int], column: str = "facility_code") -> Column:
    """Facility code is in the list; an empty list accepts everything, null included."""
    codes = list(codes)
    if not codes:
        return F.lit(True)
    return F.col(column).isNotNull() & F.col(column).isin(*codes)


def keep_malformed(flag: bool, proto: str = "proto") -> Column:
    """False drops the messages no format matched."""
    return F.lit(True) if flag else F.col(proto) != "UNKNOWN"


def since(position: int, column: str = "pos") -> Column | None:
    """Rows starting at or after a position; a negative position means no bound."""
    return F.col(column) >= position if position >= 0 else None


def message_filter(
    include: Iterable[str] = (), exclude: Iterable[str] = (), column: str = "message"
) -> Column:
    """Substring filter on the message text alone; an absent message counts as empty text."""
    text = F.coalesce(F.col(column), F.lit(""))
    return all_of(excludes_all(text, exclude), includes_any(text, include))


def line_field(line: Column, name: str) -> Column:
    """Lower-cased string value of a JSON member taken from the raw text; null if not a string.

    Only the first ``"name":`` of the line counts, so a nested look-alike later on is not used.
    """
    lowered = F.lower(line)
    key = f'"{name}":'
    start = F.locate(key, lowered)
    rest = F.substring(lowered, start + len(key), F.lit(2**31 - 1))
    pattern = r'\A[ \t]*"([^"]*)"'
    return F.when((start > 0) & rest.rlike(pattern), F.regexp_extract(rest, pattern, 1))


def is_json_object(line: Column) -> Column:
    """The line parses as one JSON object."""
    parsed = F.try_parse_json(line)
    return F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))


def drop_bad_lines(line: str = "line", json_only: bool = False) -> Column:
    """Not a blank line and, on request, one JSON object."""
    present = F.length(line) > 0
    return present & is_json_object(F.col(line)) if json_only else present


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the given conditions; None stands for no condition."""
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else F.lit(True)


@dataclass(frozen=True)
class LogFilter:
    """Severity and facility allow-lists plus substrings of the raw line to require or reject."""

    severities: tuple[str, ...] = field(default=())
    facilities: tuple[str, ...] = field(default=())
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())

    @classmethod
    def of(
        cls, sev: str = "", fac: str = "", inc: Iterable[str] = (), exc: Iterable[str] = ()
    ) -> "LogFilter":
        """From request values: comma-separated names, repeatable patterns, blanks dropped."""
        return cls(
            tuple(clean(sev.split(","))), tuple(clean(fac.split(","))),
            tuple(clean(inc)), tuple(clean(exc)),
        )

    def condition(self, canonical: bool = True) -> Column:
        """All parts together; the cheap columns come before the text scans."""
        return all_of(
            severity_in(self.severities, canonical=canonical),
            facility_in(self.facilities, canonical=canonical),
            line_excludes_all(self.exclude),
            line_includes_any(self.include),
        )

    def line_condition(self, line: str = "line") -> Column:
        """The same over raw JSON text alone, for lines without parsed columns."""
        text = F.col(line)
        return all_of(
            line_excludes_all(self.exclude, line),
            line_includes_any(self.include, line),
            severity_in(self.severities, line_field(text, "severity"), canonical=False),
            facility_in(self.facilities, line_field(text, "facility"), canonical=False),
        )


NO_FILTER = LogFilter()
