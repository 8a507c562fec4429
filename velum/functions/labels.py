"""The text that explains a value, and what can be told of it without cutting it out.

A line's label for a value is the text since the last break (two spaces or ``;``), or all text to the left where that
is too short. Labels of many values of one line are prefixes of the same pieces of it, so which words a label holds is
told from an index of the line: for each piece the place where the first word of each category ends. A label holds a
word of the category if and only if that place is not beyond its value's start. The index is made once per line.
"""

from __future__ import annotations

from velum.functions import patterns as P
from velum.functions.patterns import LABEL_EDGE, LABEL_MAX_CHARS, LABEL_MAX_WORDS, NAME_SHAPED, SPACES
from velum.functions.spans import MARK_STAND_IN, counts_below, pieces, positions
from velum.functions.sqlx import contains_any, let, ltrimmed, quoted, rtrimmed, trimmed

MIN_LEFT_LABEL = 3
_FEW_WORDS = quoted(rf"(?U)^\S+(\s+\S+){{0,{LABEL_MAX_WORDS - 1}}}\z")
_AFTER_LAST_BREAK = quoted(r"(?sU)^(?:.*(?:\s{2,}|;))?(.*)\z")
_BREAK = r"(?U)\s{2,}|;"

#: Words in a label that decide a type, by category.
CATEGORIES = {
    "amount": P.AMOUNT_LABELS,
    "pesel": ("pesel",),
    "tax": P.TAX_LABELS,
    "nip": ("nip",),
    "regon": ("regon",),
    "phone": P.PHONE_LABELS,
    "number": P.NUMBER_LABELS,
    "symbol": P.SYMBOL_LABELS,
    "name": P.NAME_LABELS,
    "given": ("imię", "imie"),
    "surname": ("nazwisko",),
    "postal": P.POSTAL_CONTEXT,
}
#: A place no value is beyond.
NEVER = 2**31 - 1


def single_spaced(text: str) -> str:
    return f"regexp_replace({text}, {quoted('(?U)' + chr(92) + 's{2,}')}, ' ')"


def clean_label(text: str) -> str:
    """Text without surrounding spaces, dashes, colons and bullets, runs of spaces made single."""
    return single_spaced(trimmed(text, LABEL_EDGE))


def nearest_piece(left: str) -> str:
    """The last non-blank piece of the text to the left, pieces being parted by two spaces or ';'."""
    return trimmed(
        f"regexp_extract({rtrimmed(left, SPACES + ';')}, {_AFTER_LAST_BREAK}, 1)", LABEL_EDGE
    )


def _whole(left: str) -> str:
    cleaned = clean_label(left)
    return f"IF(length({cleaned}) >= {MIN_LEFT_LABEL}, {cleaned}, NULL)"


def left_label(near: str, left: str) -> str:
    """:func:`label_left` for a nearest piece that is already at hand as ``near``."""
    return f"IF(length({near}) >= {MIN_LEFT_LABEL}, {near}, {_whole(left)})"


def chosen_label(near: str, left: str, row_left: str, above: str) -> str:
    """:func:`label_for` for a nearest piece that is already at hand as ``near``."""
    return f"coalesce({left_label(near, left)}, {row_left}, {above}, {near})"


def label_left(left: str) -> str:
    """Label from the same line, or null when nothing of three characters stands to the left."""
    return let(nearest_piece(left), lambda near: left_label(near, left), "string")


def label_for(left: str, row_left: str, above: str) -> str:
    """Same line, else the part to the left, else the rows above, else whatever little stands to the left."""
    return let(nearest_piece(left), lambda near: chosen_label(near, left, row_left, above), "string")


def offered_above(text: str) -> str:
    """What a line offers as a label to the lines below it: null unless it is short or ends with '='."""
    return let(
        trimmed(text, LABEL_EDGE),
        lambda t: f"IF({t} RLIKE {_FEW_WORDS} OR {t} LIKE '%=', "
        f"right({rtrimmed(single_spaced(t), ':=')}, {LABEL_MAX_CHARS}), NULL)",
        "string",
    )


def offered_beside(text: str) -> str:
    """What a part offers as a label to parts on its right: null for person-shaped text and text with digits."""
    return let(
        clean_label(text),
        lambda t: f"CASE WHEN {t} = '' OR {t} RLIKE {quoted(NAME_SHAPED)} "
        f"OR {t} RLIKE {quoted('[' + chr(92) + 'p{Nd}²³¹⁰⁴-⁹₀-₉]')} THEN NULL "
        f"WHEN {t} RLIKE {_FEW_WORDS} AND length({t}) >= 2 THEN {t} ELSE right({t}, {LABEL_MAX_CHARS}) END",
        "string",
    )


# ---- the index of a line -------------------------------------------------------------------------------

# Why a label was chosen: the nearest piece, all text to the left, the surroundings, or the little there is.
NEAR, WHOLE, AROUND, LITTLE = 1, 2, 3, 4


def _folded(text: str) -> str:
    """Lower case of the same length. A dotted capital I, the one letter that grows, is in no word looked for."""
    return f"lower(translate({text}, 'İ', {quoted(MARK_STAND_IN)}))"


def _first_end(low: str, words) -> str:
    """Where the first of the words ends in ``low``, null if there is none. Words with a space may stand apart."""
    words = list(dict.fromkeys(words))
    ends = []
    for w in [w for w in words if not any(o != w and o in w for o in words)]:
        if " " in w:
            first, last = w.split(" ")
            apart = quoted(f"(?sU)^.*?{first}(?: |\\s{{2,}}){last}")
            ends.append(f"IF(contains({low}, {quoted(first)}), nullif(length(regexp_extract({low}, {apart}, 0)), 0), NULL)")
        else:
            ends.append(f"IF(contains({low}, {quoted(w)}), locate({quoted(w)}, {low}) + {len(w) - 1}, NULL)")
    return ends[0] if len(ends) == 1 else f"least({', '.join(ends)})"


def _ends(low: str, base: str, categories: dict[str, str]) -> str:
    """Fields of an index entry; ``categories`` maps each to the condition under which it is needed."""
    return ", ".join(
        f"'{c}', IF({needed}, coalesce({base} + {_first_end(low, CATEGORIES[c])}, {NEVER}), {NEVER})"
        for c, needed in categories.items()
    )


def _street_end(p: str, low: str) -> str:
    """Where a label that begins with ``low`` has shown that it begins with a street prefix."""
    whole = " ".join(f"WHEN startswith({low}, {quoted(s)}) THEN {p} + {len(s)}" for s in P.STREET_PREFIXES if s[-1] != " ")
    short = [s[:-1] for s in P.STREET_PREFIXES if s[-1] == " "]
    open_ = f"({' OR '.join(f'startswith({low}, {quoted(s)})' for s in short)}) AND {low} RLIKE {quoted(f'(?U)^(?:{chr(124).join(short)})(?: |{chr(92)}s{{2,}})')}"
    rest = f"substring({low}, 4)"
    after = f"{p} + 3 + length({rest}) - length({ltrimmed(rest, LABEL_EDGE)}) + 1"
    # Such a prefix ends with a space, which is only kept where more of the label follows.
    return f"CASE {whole} WHEN {open_} AND {ltrimmed(rest, LABEL_EDGE)} <> '' THEN {after} ELSE {NEVER} END"


def _entry(x: str, categories: dict[str, str]) -> str:
    """Index entry of a piece ``x`` with base ``b``, text ``c`` and, in ``w``, whether spaces in it may be collapsed.

    ``u`` is the place of its first character that is no space, ``p`` where its label begins, ``r`` the place a value must
    be beyond for the label to have three characters.
    """
    step = f"(?sU)^(?>\\s{{2,}}|.)(?>\\s{{2,}}|.).*?[^{''.join(chr(92) + c if c in '-' else c for c in LABEL_EDGE)}]"

    def placed(y: str) -> str:
        third = f"substring({y}.label, 3)"
        plain = f"IF({ltrimmed(third, LABEL_EDGE)} = '', {NEVER}, {y}.p + 2 + length({third}) - length({ltrimmed(third, LABEL_EDGE)}))"
        collapsed = f"coalesce({y}.p + nullif(length(regexp_extract({y}.label, {quoted(step)}, 0)), 0) - 1, {NEVER})"
        return (
            f"named_struct('u', IF({y}.body = '', NULL, {x}.b + length({x}.c) - length({y}.body)), 'p', {y}.p, "
            f"'r', IF({x}.w, {collapsed}, {plain}), 'street', {_street_end(f'{y}.p', f'substring({y}.low, {y}.p - {x}.b + 1)')}, "
            f"{_ends(f'{y}.low', f'{x}.b', categories)})"
        )

    fields = (
        f"named_struct('body', {ltrimmed(f'{x}.c', SPACES)}, 'label', {ltrimmed(f'{x}.c', LABEL_EDGE)}, "
        f"'p', {x}.b + length({x}.c) - length({ltrimmed(f'{x}.c', LABEL_EDGE)}), 'low', {_folded(f'{x}.c')})"
    )
    return let(fields, placed, entry_type(categories))


def entry_type(categories) -> str:
    return f"struct<u:int,p:int,r:int,street:int,{','.join(f'{c}:int' for c in categories)}>"


def index_of(text: str, categories: dict[str, str]) -> str:
    """Index of a line: an entry for each piece that is not blank, in order, and last one for the whole line.

    ``categories`` maps the categories asked for to the condition under which they are needed.
    """
    row = lambda b, c, w: f"named_struct('b', {b}, 'c', {c}, 'w', {w})"
    rows_type = "array<struct<b:int,c:string,w:boolean>>"

    def broken(cut: str) -> str:
        after = f"transform({positions(cut, 'break')}, (x, i) -> {row('x.e', f'{cut}[2 * i + 2]', 'false')})"
        return f"concat(array({row('0', f'{cut}[0]', 'false')}), {after}, array({row('0', text, 'true')}))"

    whole = f"array({row('0', text, 'false')})"
    rows = f"IF({text} RLIKE {quoted(_BREAK)}, {let(pieces(text, _BREAK), broken, rows_type)}, {whole})"
    # A line without breaks is one piece: its only entry stands for both.
    return (
        f"{let(f'transform({rows}, x -> {_entry("x", categories)})', lambda ix: f"filter({ix}, (e, i) -> e.u IS NOT NULL OR i = size({ix}) - 1)", f'array<{entry_type(categories)}>')}"
    )


def met_type(categories) -> str:
    return f"struct<s:struct<s:int,e:int,k:string,v:string>,e:{entry_type(categories)},why:int>"


def attached(spans: str, index: str, around: str, categories) -> str:
    """Sorted spans with the entry of the piece to their left and why their label is chosen: ``struct<s, e, why>``.

    ``around`` is the label the surroundings offer.
    """
    line = f"element_at({index}, -1)"

    def met(s: str, e: str) -> str:
        return let(
            e,
            lambda v: f"named_struct('s', {s}, 'e', {v}, 'why', CASE WHEN {v}.r < {s}.s THEN {NEAR} "
            f"WHEN {line}.r < {s}.s THEN {WHOLE} WHEN {around} IS NOT NULL THEN {AROUND} ELSE {LITTLE} END)",
            met_type(categories),
        )

    one = f"transform({spans}, s -> {met('s', f'IF({line}.u < s.s, {line}, NULL)')})"
    many = let(
        counts_below(f"transform(slice({index}, 1, size({index}) - 1), e -> e.u)", f"transform({spans}, s -> s.s)"),
        lambda n: f"transform({spans}, (s, j) -> {met('s', f'IF({n}[j] = 0, NULL, get({index}, {n}[j] - 1))')})",
        f"array<{met_type(categories)}>",
    )
    return f"IF(size({index}) = 1, {one}, {many})"


def around_entry(met: str, around: str, categories) -> str:
    """Entry of the surroundings' label, null where no span takes it."""
    beside = f"named_struct('b', 0, 'c', {around}, 'w', false)"
    return f"IF(exists({met}, m -> m.why = {AROUND}), transform(array({beside}), x -> {_entry('x', categories)})[0], NULL)"


def judged(met: str, index: str, around: str) -> str:
    """An attached span with the entry ``x`` and the place ``at`` that tell its label's words, and the label's begin ``p``."""
    return (
        f"named_struct('s', {met}.s, 'why', {met}.why, 'p', IF({met}.why = {WHOLE}, 0, {met}.e.p), "
        f"'x', CASE {met}.why WHEN {WHOLE} THEN element_at({index}, -1) WHEN {AROUND} THEN {around} ELSE {met}.e END, "
        f"'at', IF({met}.why = {AROUND}, {NEVER - 1}, {met}.s.s))"
    )


def judged_type(categories) -> str:
    return f"struct<s:struct<s:int,e:int,k:string,v:string>,why:int,p:int,x:{entry_type(categories)},at:int>"


def holds(m: str, category: str) -> str:
    """Whether the label of a span from :func:`judged` holds a word of the category."""
    return f"coalesce({m}.x.{category} <= {m}.at, false)"


def cut_label(text: str, start: str, why: str, p: str, around: str) -> str:
    """The label itself, for a value that starts at ``start``."""
    near = rtrimmed(f"substring({text}, {p} + 1, {start} - {p})", LABEL_EDGE)
    return (
        f"CASE {why} WHEN {NEAR} THEN {near} WHEN {WHOLE} THEN {clean_label(f'substring({text}, 1, {start})')} "
        f"WHEN {AROUND} THEN {around} ELSE coalesce({near}, '') END"
    )


def label_holds(label: str, category: str) -> str:
    """:func:`holds` for a label that is at hand in lower case."""
    return contains_any(label, CATEGORIES[category])
