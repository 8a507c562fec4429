"""Positions of pattern matches, and the choice between overlapping ones.

A span is ``struct<s: int, e: int, k: string, v: string>``: first and one-past-last code point, 0-based, detector and
matched text. Spans sort by their place.
"""

from __future__ import annotations

from velum.functions.sqlx import let, quoted

SPAN = "array<struct<s:int,e:int,k:string,v:string>>"
NONE = f"CAST(array() AS {SPAN})"

# Matches are bracketed with this private-use character and the text is cut at it, so one regex pass gives
# values and positions. Text that already holds the character is searched with another one in its place.
MARK, MARK_STAND_IN = "\ue000", "\ue001"

# Appending to an array copies it, so long lists are walked in blocks of this many.
BLOCK = 256

# Two lists whose sizes multiply to no more than this are compared each with each, longer ones by a sweep.
FEW_PAIRS = 64


def searchable(text: str) -> str:
    return f"IF(contains({text}, {quoted(MARK)}), translate({text}, {quoted(MARK)}, {quoted(MARK_STAND_IN)}), {text})"


def pieces(text: str, pattern: str) -> str:
    """Text cut into gap, match, gap, match, …, gap."""
    return f"split(regexp_replace({text}, {quoted(pattern)}, {quoted(MARK + '$0' + MARK)}), {quoted(MARK)})"


def joined(*arrays: str) -> str:
    """The arrays one after another. In a lambda ``flatten`` costs a fraction of what ``concat`` does."""
    return f"flatten(array({', '.join(arrays)}))"


def span(kind: str, start: str, end: str, value: str) -> str:
    return f"named_struct('s', {start}, 'e', {end}, 'k', {kind}, 'v', {value})"


def positions(cut: str, kind: str) -> str:
    """Spans of the matches in an array made by :func:`pieces`."""
    return positions_of(cut, quoted(kind))


def positions_of(cut: str, kind: str) -> str:
    """:func:`positions` for a kind given as an expression: every second piece, with running lengths.

    Most lines have no match or one, which need no walk over the pieces.
    """
    single = f"array({span(kind, f'length({cut}[0])', f'length({cut}[0]) + length({cut}[1])', f'{cut}[1]')})"
    seen = joined("a.out", f"array({span(kind, 'a.pos', 'a.pos + length(p)', 'p')})")
    walked = in_blocks(
        cut, "named_struct('pos', 0, 'hit', false)", "struct<pos:int,hit:boolean>", SPAN,
        lambda state: f"named_struct('pos', {state}.pos, 'hit', false, 'out', {NONE})",
        f"(a, p) -> named_struct('pos', a.pos + length(p), 'hit', NOT a.hit, 'out', IF(a.hit, {seen}, a.out))",
        lambda done: f"named_struct('pos', {done}.pos, 'hit', false)",
    )
    return f"CASE size({cut}) WHEN 1 THEN {NONE} WHEN 3 THEN {single} ELSE {walked} END"


def in_blocks(items: str, start: str, state: str, out: str, begin, step: str, end) -> str:
    """A walk over an array that collects an array: in blocks, so that appending copies no more than a block.

    ``begin`` makes a block's accumulator with an empty ``out`` from the state, ``step`` is the lambda for one element,
    ``end`` takes the state from the accumulator. A block has an even number of elements.
    """
    block = f"aggregate(slice({items}, b + 1, {BLOCK}), {begin('acc.state')}, {step})"
    grown = let(
        block,
        lambda w: f"named_struct('state', {end(w)}, 'outs', {joined('acc.outs', f'array({w}.out)')})",
        f"struct<state:{state},outs:array<{out}>>",
    )
    first = f"named_struct('state', {start}, 'outs', CAST(array() AS array<{out}>))"
    return f"flatten(aggregate(sequence(0, size({items}) - 1, {BLOCK}), {first}, (acc, b) -> {grown}).outs)"


def matches(text: str, pattern: str, kind: str) -> str:
    """All non-overlapping matches of the pattern, left to right."""
    return let(pieces(text, pattern), lambda cut: positions(cut, kind), SPAN)


def value_at(text: str, span: str) -> str:
    return f"substring({text}, {span}.s + 1, {span}.e - {span}.s)"


def counts_below(places: str, queries: str) -> str:
    """For each element of ``queries`` how many of ``places`` are less than it: both are sorted together once."""
    events = (
        f"sort_array(concat(transform({queries}, (q, j) -> named_struct('p', q, 'of', j)), "
        f"transform({places}, p -> named_struct('p', p, 'of', {2**31 - 1}))))"
    )
    # A query comes before the places equal to it. Of the elements before it, those that are queries are left out.
    asked = (
        f"filter(transform({events}, (x, i) -> named_struct('of', x.of, 'at', i)), x -> x.of < {2**31 - 1})"
    )
    counted = f"transform({asked}, (x, i) -> named_struct('of', x.of, 'n', x.at - i))"
    return f"transform(sort_array({counted}), x -> x.n)"


def is_free(taken: str, start: str, end: str) -> str:
    return f"NOT exists({taken}, t -> t.s < {end} AND {start} < t.e)"


def free_spans(taken: str, spans: str) -> str:
    """The spans that overlap none of ``taken``; both are sorted and neither overlaps within itself.

    Of what is taken and begins before a span ends, the last one ends last: only that one has to be looked at.
    """
    swept = let(
        counts_below(f"transform({taken}, t -> t.s)", f"transform({spans}, c -> c.e)"),
        lambda n: f"filter({spans}, (c, j) -> {n}[j] = 0 OR {taken}[{n}[j] - 1].e <= c.s)",
        SPAN,
    )
    few = f"filter({spans}, c -> {is_free(taken, 'c.s', 'c.e')})"
    return f"IF(CAST(size({taken}) AS BIGINT) * size({spans}) <= {FEW_PAIRS}, {few}, {swept})"


def claim_in_order(groups: str) -> str:
    """Greedy claim: groups in priority order; a span is kept iff it overlaps none kept before it.

    Spans inside one group come from one pattern, sorted and without overlaps, so each group is weighed as a whole
    against the sorted spans taken before.
    """
    more = f"sort_array({joined('taken', free_spans('taken', 'spans'))})"
    return (
        f"aggregate({groups}, {NONE}, (taken, spans) -> "
        f"CASE WHEN size(spans) = 0 THEN taken WHEN size(taken) = 0 THEN spans ELSE {more} END)"
    )
