"""Small builders for Spark SQL expression text.

Findings are computed inside the row that holds the text, with higher-order functions, so no shuffle is
needed. Expressions that run inside a lambda are composed as SQL text: every function in
``velum.functions`` takes SQL expressions and returns one, for ``F.expr`` or for further composition.
"""

from __future__ import annotations

import re
from itertools import count

_names = count()


def quoted(value: str) -> str:
    """A SQL string literal for ``value``; control characters are escaped."""
    out = []
    for ch in value:
        if ch in "'\\":
            out.append("\\" + ch)
        elif ord(ch) < 32 or 0x7F <= ord(ch) <= 0xA0 or 0x2000 <= ord(ch) <= 0x206F or 0xE000 <= ord(ch) <= 0xF8FF:
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def contains_any(text: str, words) -> str:
    """True when any of the words occurs in the text. A word that holds another one adds nothing and is left out."""
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in needed) + ")"


def let(value: str, body, returns: str | None = None) -> str:
    """Bind ``value`` once: ``body`` receives the bound name and returns an expression over it.

    Naming the type of the result gives the faster form: an array access works out the type of the whole bound
    expression again for every row.
    """
    name = f"v{next(_names)}"
    if returns:
        return f"aggregate(array({value}), CAST(NULL AS {returns}), (z{name}, {name}) -> {body(name)})"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def trimmed(text: str, chars: str) -> str:
    return f"trim(BOTH {quoted(chars)} FROM {text})"


def rtrimmed(text: str, chars: str) -> str:
    return f"trim(TRAILING {quoted(chars)} FROM {text})"


def ltrimmed(text: str, chars: str) -> str:
    return f"trim(LEADING {quoted(chars)} FROM {text})"


def any_of(words) -> str:
    """A pattern for any of the words that branches where they do: at most places of a text one look decides."""

    def branch(rest: list[str]) -> str:
        heads = sorted({w[0] for w in rest if w})
        parts = [re.escape(h) + branch([w[1:] for w in rest if w[:1] == h]) for h in heads]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return body if all(rest) else f"(?:{body})?"

    return branch(list(words))


def holds_any(text: str, words) -> str:
    """:func:`contains_any` in one pass. A word that holds another one adds nothing and is left out."""
    words = list(dict.fromkeys(words))
    return f"{text} RLIKE {quoted(any_of([w for w in words if not any(o != w and o in w for o in words)]))}"


def is_one_of(text: str, words) -> str:
    """Whether the text is one of a few plain words; inside a lambda ``IN`` looks at all of them."""
    return f"contains({quoted(' ' + ' '.join(words) + ' ')}, concat(' ', {text}, ' '))"
