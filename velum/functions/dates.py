"""Reading a found date and writing another date the same way."""

from __future__ import annotations

from pyspark.sql import functions as F

from velum.functions import patterns as P
from velum.functions.checks import ascii_digits
from velum.functions.sqlx import let, quoted

DATE = "struct<kind:string,year:int,month:int,day:int,date:date>"

_MONTHS = ", ".join(f"{quoted(word)}, {number}" for word, number in P.MONTH_NUMBER.items())
_NUMERIC = quoted(r"(?U)^(\d+)[.\-/](\d+)[.\-/](\d+)")
_MONTH_WORD = quoted("(?iU)(" + P.MONTH_WORDS + ")")


def month_lookup(word: str) -> str:
    """Month number of a Polish or English month word, null for any other word."""
    return f"element_at(map({_MONTHS}), lower({word}))"


def _names(forms) -> str:
    return "array(" + ", ".join(map(quoted, forms)) + ")"


def _number(digits: str, pattern: str, group: int) -> str:
    return f"try_cast(regexp_extract({digits}, {pattern}, {group}) AS INT)"


_DAY_BEFORE_WORD = quoted(r"(?U)^(\d{1,2})\s")
_YEAR_AFTER_WORD = quoted(r"(?U)\s(\d{4})")


def date_parts(kind: str, text: str) -> str:
    """``struct<year, month, day>`` as written; a part that is not written is null."""
    return let(ascii_digits(text), lambda t: parts_of(kind, t), "struct<year:int,month:int,day:int>")


def parts_of(kind: str, t: str) -> str:
    """:func:`date_parts` of a text whose digits are 0–9."""

    def parts(year: str, month: str, day: str) -> str:
        return f"named_struct('year', {year}, 'month', {month}, 'day', {day})"

    num = lambda i: _number(t, _NUMERIC, i)
    word = month_lookup(f"regexp_extract({t}, {_MONTH_WORD}, 1)")
    day, year = _number(t, _DAY_BEFORE_WORD, 1), _number(t, _YEAR_AFTER_WORD, 1)
    full_year = f"({num(3)} + IF({num(3)} < 100, 2000, 0))"
    return f"""CASE
        WHEN {kind} = 'ymd' THEN {parts(num(1), num(2), num(3))}
        WHEN {kind} = 'dmy' THEN {parts(full_year, num(2), num(1))}
        WHEN {kind} IN ('d-month-y', 'month-y') THEN {parts(year, word, day)} END"""


def plausible(kind: str, text: str) -> str:
    """A month no greater than 12 (an unreadable ``00`` stays) and, where one is written, a day of 1 to 31."""

    def check(t: str) -> str:
        month = f"{_number(t, _NUMERIC, 2)} <= 12"
        day = {"ymd": _number(t, _NUMERIC, 3), "dmy": _number(t, _NUMERIC, 1)}.get(kind)
        if day is None:
            return f"{_number(t, _DAY_BEFORE_WORD, 1)} BETWEEN 1 AND 31"
        return f"{month} AND {day} BETWEEN 1 AND 31"

    return "true" if kind == "month-y" else let(ascii_digits(text), check, "boolean")


def date_value(year: str, month: str, day: str) -> str:
    """The calendar date, null when a part is missing or the day does not exist."""
    return (
        f"CASE WHEN {year} > 0 AND {month} > 0 AND {day} > 0 "
        f"THEN try_cast(format_string('%04d-%02d-%02d', {year}, {month}, {day}) AS DATE) END"
    )


def read_date(kind: str, text: str) -> str:
    """``struct<kind, year, month, day, date>`` for a date detector's text, null for other detectors."""
    return let(date_parts(kind, text), lambda p: date_of(kind, p), DATE)


def date_of(kind: str, p: str) -> str:
    """:func:`read_date` for parts that are at hand, null where they are null."""
    return (
        f"IF({p} IS NULL, NULL, named_struct('kind', {kind}, 'year', {p}.year, 'month', {p}.month, "
        f"'day', {p}.day, 'date', {date_value(f'{p}.year', f'{p}.month', f'{p}.day')}))"
    )


def with_date(rows, kind: str, text: str, name: str):
    """Rows with the date that ``text`` writes as a column: :func:`read_date` in steps, which compile to plain code."""
    return (
        rows.withColumn("_ascii", F.expr(ascii_digits(text)))
        .withColumn("_parts", F.expr(parts_of(kind, "_ascii")))
        .withColumn(name, F.expr(date_of(kind, "_parts")))
        .drop("_ascii", "_parts")
    )


def date_key(date: str) -> str:
    """Equal for all spellings of a date: ``d:`` and the day, else ``m:`` and the month, else ``y:`` and the year."""
    return f"""CASE
        WHEN {date}.date IS NOT NULL THEN concat('d:', {date}.date)
        WHEN {date}.month > 0 AND {date}.year > 0 THEN format_string('m:%d-%d', {date}.year, {date}.month)
        WHEN {date}.year > 0 THEN format_string('y:%d', {date}.year) END"""


def restyled(kind: str, old: str, new: str) -> str:
    """The new date in the spelling of the old text: separator, padding, year length, month case, suffix."""
    padded = lambda part: f"lpad({part}({new}), 2, '0')"
    plain = lambda part: f"CAST({part}({new}) AS STRING)"
    sep = f"regexp_extract({old}, '[.\\\\-/]', 0)"
    zero_month = f"{old} RLIKE '(?U)[.\\\\-/]0\\\\d?[.\\\\-/]'"
    zero_day = f"startswith({old}, '0')"
    short_year = f"{old} RLIKE '(?U)[.\\\\-/]\\\\d{{2}}\\\\z'"
    nominative, genitive = _names(P.MONTHS_NOMINATIVE), _names(P.MONTHS_GENITIVE)
    word = f"lower(regexp_extract({old}, {_MONTH_WORD}, 1))"
    case_of = lambda is_nominative: (
        f"IF({is_nominative}, {nominative}, {genitive})[month({new}) - 1]"
    )
    starts = " OR ".join(f"startswith(lower({old}), {quoted(m)})" for m in P.MONTHS_NOMINATIVE)
    suffix = (
        f"CASE WHEN {old} RLIKE '(?U)r\\\\.\\\\s*\\\\z' THEN ' r.' WHEN {old} RLIKE '(?U)r\\\\s*\\\\z' THEN ' r' ELSE '' END"
    )
    return f"""CASE {kind}
        WHEN 'ymd' THEN concat_ws({sep}, {plain('year')}, {padded('month')}, {padded('day')})
        WHEN 'dmy' THEN concat_ws({sep},
            IF({zero_day} OR {zero_month}, {padded('day')}, {plain('day')}),
            IF({zero_month}, {padded('month')}, {plain('month')}),
            IF({short_year}, lpad(year({new}) % 100, 2, '0'), {plain('year')}))
        WHEN 'd-month-y' THEN concat(day({new}), ' ', {case_of(f'array_contains({nominative}, {word})')}, ' ',
            year({new}), {suffix})
        WHEN 'month-y' THEN concat({case_of(starts)}, ' ', year({new})) END"""
