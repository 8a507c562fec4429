"""Digits and check digits."""

from __future__ import annotations

import sys
import unicodedata

from velum.functions.patterns import NIP_WEIGHTS, PESEL_WEIGHTS, SPACES
from velum.functions.sqlx import let, quoted

_DECIMALS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_FROM = "".join(_DECIMALS)
_TO = "".join(str(unicodedata.decimal(c)) for c in _DECIMALS)


def ascii_digits(text: str) -> str:
    """Decimal digits of any script as 0–9; plain ASCII text, the usual case, is passed through."""
    return f"IF(octet_length({text}) = length({text}), {text}, translate({text}, {quoted(_FROM)}, {quoted(_TO)}))"


def zero_digits(text: str) -> str:
    """The shape of a text: every decimal digit of any script as 0, every space as a plain one."""
    few, many = [c for c in SPACES if c < "\x80" and c != " "], [c for c in SPACES if c != " "]
    plain = f"translate({text}, {quoted('123456789' + ''.join(few))}, {quoted('0' * 9 + ' ' * len(few))})"
    full = f"translate({text}, {quoted('123456789' + _FROM + ''.join(many))}, {quoted('0' * (9 + len(_FROM)) + ' ' * len(many))})"
    return f"IF(octet_length({text}) = length({text}), {plain}, {full})"


def plain_digits(text: str) -> str:
    """The digits of a text, as 0–9."""
    return ascii_digits(digits_only(text))


def digits_only(text: str) -> str:
    return f"regexp_replace({text}, '(?U)\\\\D', '')"


def _weighted(digits: str, weights) -> str:
    return " + ".join(
        f"(ascii(substring({digits}, {i}, 1)) - 48)" + (f" * {w}" if w > 1 else "") for i, w in enumerate(weights, 1)
    )


def _digit(digits: str, i: int) -> str:
    return f"(ascii(substring({digits}, {i}, 1)) - 48)"


def pesel_check(n: str) -> str:
    """On ASCII digits: 11 of them, the last one completing the weighted sum of the others to a multiple of ten."""
    return f"IF({n} RLIKE '^[0-9]{{11}}\\\\z', ({_weighted(n, PESEL_WEIGHTS)} + {_digit(n, 11)}) % 10 = 0, false)"


def nip_check(n: str) -> str:
    """On ASCII digits: 10 of them, the last one being the weighted sum of the others modulo eleven."""
    return f"IF({n} RLIKE '^[0-9]{{10}}\\\\z', ({_weighted(n, NIP_WEIGHTS)}) % 11 = {_digit(n, 10)}, false)"


def pesel_valid(number: str) -> str:
    return let(ascii_digits(number), pesel_check, "boolean")


def nip_valid(number: str) -> str:
    return let(ascii_digits(number), nip_check, "boolean")
