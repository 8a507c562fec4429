"""All findings of one line of text, as one expression.

Inputs are the line's text and the two label candidates that come from its surroundings: ``row_left``, the part
to the left on the same row, and ``above``, the nearest short row above. Everything else is inside the line.

The work of a line grows with its length: a detector's pattern runs only where the line's shape allows a match, spans
claim their text by sweeping over sorted places, and labels are judged by an index of the line (``velum.functions.labels``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions import patterns as P
from velum.functions.checks import digits_only, nip_valid, pesel_valid, plain_digits, zero_digits
from velum.functions.classify import (
    capped_score,
    finding_type,
    starts_with_street,
    strong_name,
)
from velum.functions.dates import DATE, plausible, read_date
from velum.functions.labels import (
    AROUND,
    WHOLE,
    around_entry,
    attached,
    clean_label,
    cut_label,
    holds,
    index_of,
    judged,
    label_for,
    label_holds,
)
from velum.functions.spans import (
    FEW_PAIRS,
    NONE,
    SPAN,
    claim_in_order,
    counts_below,
    in_blocks,
    is_free,
    joined,
    pieces,
    positions,
    positions_of,
    searchable,
)
from velum.functions.sqlx import any_of, holds_any, is_one_of, let, quoted

# Priority order of the detectors: an earlier one claims its text first.
DATE_PATTERNS = {
    "ymd": P.DATE_YMD,
    "dmy": P.DATE_DMY,
    "d-month-y": P.DATE_DAY_MONTH,
    "month-y": P.DATE_MONTH_YEAR,
}
PATTERNS = {
    "groszy": P.GROSZY,
    **DATE_PATTERNS,
    "account": P.ACCOUNT,
    "pesel": P.PESEL,
    "nip": P.NIP,
    "postal": P.POSTAL,
    "money": P.MONEY,
    "symbol": P.SYMBOL,
    "percent": P.PERCENT,
    "phone": P.PHONE,
    "number": P.NUMBER,
}
WORDS = "array<struct<s:int,e:int,x:int,w:string,v:string,colon:boolean>>"
FINDING = f"struct<start:int,end:int,kind:string,type:string,value:string,score:double,date:{DATE},label:string,why:int,p:int,before:boolean>"
MIN_NUMBER_DIGITS = 3
MIN_NAME_CHARS = 3

# The shape of a line is the line with every digit as 0 and every space as a plain one. A detector's pattern runs only
# where the shape, or the shape without separators, holds what each of its matches has.
_DENSE = quoted(" -.,")
_NUMERIC_DATE = ("0.0", "0-0", "0/0")


def _shows(text: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _may_hold(kind: str, text: str, shape: str, dense: str) -> str:
    if kind == "d-month-y":
        return f"{_shows(shape, '0 ')} AND {text} RLIKE {quoted(r'(?U)\d\s+\p{L}{3}')}"
    if kind == "month-y":
        return f"{_shows(shape, ' 0000')} AND {text} RLIKE {quoted(r'(?U)\p{L}{3}\s+\d{4}')}"
    if kind == "symbol":
        return f"{_shows(shape, '-', '/')} AND {text} RLIKE '[A-Z0-9][-/][A-Z0-9]'"
    return {
        "groszy": _shows(shape, "/000"),
        "ymd": _shows(shape, *_NUMERIC_DATE),
        "dmy": _shows(shape, *_NUMERIC_DATE),
        "account": _shows(dense, "0" * 26),
        "pesel": _shows(shape, "0" * 11),
        "nip": _shows(shape, "0" * 10),
        "postal": _shows(shape, "0-000"),
        "money": _shows(shape, ",00", ".00"),
        "percent": _shows(shape, "%"),
        "phone": _shows(dense, "0" * 9),
        "number": _shows(dense, "0" * MIN_NUMBER_DIGITS),
    }[kind]


# What a line holds if a detector may match in it: a test on the line's row, before any other work on it.
_DIGIT_OR_GAP = r"\d[ \u00a0.,]?"
GATES = {
    "groszy": "/100",
    "ymd": r"\d[./-]\d",
    "dmy": r"\d[./-]\d",
    "d-month-y": r"\d\s+\p{L}{3}",
    "month-y": r"\p{L}{3}\s+\d{4}",
    "account": r"\d{2}(?:[ \u00a0-]?\d{4}){6}",
    "pesel": r"\d{11}",
    "nip": r"\d{10}",
    "postal": r"\d{2}-\d{3}",
    "money": r"\d[.,]\d{2}",
    "symbol": "[A-Z0-9][-/][A-Z0-9]",
    "percent": r"\d\s?%",
    "phone": r"(?:\d[ -]?){8}\d",
    "number": rf"{_DIGIT_OR_GAP}{_DIGIT_OR_GAP}\d",
}


def may_match(text: str, kinds) -> str:
    """Whether one of the detectors may match in the text."""
    return f"{text} RLIKE {quoted('(?U)' + '|'.join(dict.fromkeys(GATES[kind] for kind in kinds)))}"


SHAPE = "struct<shape:string,dense:string>"


def shape_of(text: str) -> str:
    """The text's shape and its dense shape, from which separators of digits are left out."""
    both = lambda shape: f"named_struct('shape', {shape}, 'dense', translate({shape}, {_DENSE}, ''))"
    return let(zero_digits(text), both, SHAPE)


def candidates(text: str, kind: str) -> str:
    """Raw matches of one detector in a line."""
    return let(shape_of(text), lambda shape: f"flatten({groups_of(text, [kind], shape)})", SPAN)


def groups_of(text: str, kinds, shape: str, row_left: str | None = None, above: str = "") -> str:
    """The matches of several detectors, an array of spans for each one that has any, in the order given.

    With the labels' candidates given, only matches that pass their detector's own test are kept. The texts cut by all
    detectors are walked by one expression: the plan is sent to every task and must stay small.
    """
    cut = lambda kind: f"IF({_may_hold(kind, text, f'{shape}.shape', f'{shape}.dense')}, {pieces(text, PATTERNS[kind])}, NULL)"
    cuts = ", ".join(f"named_struct('k', {quoted(kind)}, 'cut', {cut(kind)})" for kind in kinds)
    found = positions_of("x.cut", "x.k")
    if row_left is not None:
        found = let(found, lambda f: _kept(f, text, kinds, row_left, above), SPAN)
    return f"transform(filter(array({cuts}), x -> size(x.cut) > 1), x -> {found})"


def _kept(found: str, text: str, kinds, row_left: str, above: str) -> str:
    """Matches of the detector ``x.k`` that pass its own test, before overlaps are looked at."""
    tests = [f"WHEN '{kind}' THEN {plausible(kind, 'c.v')}" for kind in kinds if kind in DATE_PATTERNS]
    if "number" in kinds:
        tests.append(
            f"WHEN 'number' THEN length(c.v) >= {MIN_NUMBER_DIGITS} AND length({digits_only('c.v')}) >= {MIN_NUMBER_DIGITS}"
        )
    kept = f"filter({found}, c -> CASE x.k {' '.join(tests)} ELSE true END)" if tests else found
    checked = [kind for kind in ("pesel", "nip") if kind in kinds]
    if not checked:
        return kept
    return f"IF({is_one_of('x.k', checked)}, {_kept_by_label(text, row_left, above, found)}, {kept})"


def _kept_by_label(text: str, row_left: str, above: str, found: str) -> str:
    """Matches kept for their check digit or because the label says what they are."""
    around = f"coalesce({row_left}, {above})"
    valid = lambda v: f"IF(x.k = 'pesel', {pesel_valid(v)}, {nip_valid(v)})"
    kinds = ["pesel", "nip"]
    ends = lambda entry: f"IF(x.k = 'pesel', {entry}.pesel, {entry}.nip)"

    def kept(index: str) -> str:
        says = (
            f"CASE m.why WHEN {WHOLE} THEN {ends(f'element_at({index}, -1)')} <= m.s.s "
            f"WHEN {AROUND} THEN contains(lower({around}), x.k) ELSE coalesce({ends('m.e')} <= m.s.s, false) END"
        )
        return f"transform(filter({attached(found, index, around, kinds)}, m -> {says} OR {valid('m.s.v')}), m -> m.s)"

    labelled = let(index_of(text, {k: "true" for k in kinds}), kept, SPAN)
    return f"IF(forall({found}, c -> {valid('c.v')}), {found}, {labelled})"


def kept_candidates(text: str, kinds: list[str], row_left: str, above: str, shape: str | None = None) -> str:
    """Matches of some detectors that pass their own tests, before overlaps are looked at, sorted."""
    if shape is None:
        return let(shape_of(text), lambda s: kept_candidates(text, kinds, row_left, above, s), SPAN)
    return f"sort_array(flatten({groups_of(text, kinds, shape, row_left, above)}))"


def date_spans(text: str) -> str:
    """Dates of a line in all four spellings, overlaps settled in favour of the earlier spelling."""
    return let(shape_of(text), lambda shape: claim_in_order(groups_of(text, DATE_PATTERNS, shape, "NULL", "NULL")), SPAN)


def value_spans(text: str, row_left: str, above: str, shape: str) -> str:
    """Accepted spans of every detector but names, reservations included, in order of their place."""
    return claim_in_order(groups_of(text, PATTERNS, shape, row_left, above))


_NAME_GATE = f"[{P.CAPITALS}][{P.SMALLS}]+(?:-[{P.CAPITALS}]|(?U:\\s)+[{P.CAPITALS}][{P.SMALLS}])"


def name_words(text: str) -> str:
    """Capitalised words with the end of their extension by up to two more such words.

    ``struct<s, e, x, w, v>``: start, end, extended end, the word, the extended word. Words that can never start a name
    are left out.
    """
    stop = quoted(f"^(?:{any_of(P.STOP_WORDS)})\\z")

    def words(cut: str) -> str:
        spaces = lambda i: f"coalesce(get({cut}, 2 * ({i}) + 2) RLIKE {quoted('(?U)^' + chr(92) + 's+' + chr(92) + 'z')}, false)"

        def extended(spans: str) -> str:
            more = (
                f"CASE WHEN w.e - w.s <= 2 OR get({spans}, i + 1) IS NULL OR NOT {spaces('i')} THEN 0 "
                f"WHEN get({spans}, i + 2) IS NULL OR NOT {spaces('i + 1')} THEN 1 ELSE 2 END"
            )
            made = let(
                more,
                lambda n: f"named_struct('s', w.s, 'e', w.e, 'x', {spans}[i + {n}].e, 'w', w.v, 'v', "
                f"IF({n} = 0, w.v, array_join(slice({cut}, 2 * i + 2, 2 * {n} + 1), '')), "
                f"'colon', startswith({cut}[2 * i + 2], ':'))",
                WORDS[6:-1],
            )
            return f"filter(transform({spans}, (w, i) -> {made}), w -> NOT w.colon AND NOT lower(w.w) RLIKE {stop})"

        return let(positions(cut, "name"), extended, WORDS)

    return let(pieces(text, P.WORD), words, WORDS)


def name_spans(text: str, row_left: str, above: str, taken: str) -> str:
    """Accepted name spans, given the spans other detectors took, sorted.

    An unexplained single word is no finding and claims nothing, so where no name label is in sight only
    runs of words and double-barrelled words are looked at.
    """
    surroundings = f"lower(concat_ws(' ', {text}, {row_left}, {above}))"
    label_in_sight = let(surroundings, lambda near: holds_any(near, P.NAME_LABELS), "boolean")
    settle = lambda free: f"named_struct('s', w.s, 'e', IF({free}, w.x, w.e), 'k', 'name', 'v', IF({free}, w.v, w.w))"

    def free_below(n: str, end: str) -> str:
        return f"({n} = 0 OR {taken}[{n} - 1].e <= w.s)"

    def settled(words: str) -> str:
        few = (
            f"transform(filter({words}, w -> {is_free(taken, 'w.s', 'w.e')}), w -> {settle(is_free(taken, 'w.s', 'w.x'))})"
        )
        starts = f"transform({taken}, t -> t.s)"
        swept = let(
            f"named_struct('e', {counts_below(starts, f'transform({words}, w -> w.e)')}, "
            f"'x', {counts_below(starts, f'transform({words}, w -> w.x)')})",
            lambda n: f"flatten(transform({words}, (w, j) -> IF({free_below(f'{n}.e[j]', 'w.e')}, "
            f"array({settle(free_below(f'{n}.x[j]', 'w.x'))}), {NONE})))",
            SPAN,
        )
        return f"IF(CAST(size({taken}) AS BIGINT) * size({words}) <= {FEW_PAIRS}, {few}, {swept})"

    def claimed(possible: str) -> str:
        return in_blocks(
            possible, "0", "int", SPAN, lambda last: f"named_struct('last', {last}, 'out', {NONE})",
            f"(n, w) -> IF(w.s < n.last, n, named_struct('last', w.e, 'out', {joined('n.out', 'array(w)')}))",
            lambda done: f"{done}.last",
        )

    def pick(in_sight: str) -> str:
        words = f"filter({name_words(text)}, w -> w.x > w.e OR contains(w.w, '-') OR {in_sight})"
        spans = f"filter({let(words, settled, SPAN)}, w -> w.e - w.s >= {MIN_NAME_CHARS})"
        chosen = let(spans, lambda s: f"IF(size({s}) <= 1, {s}, {claimed(s)})", SPAN)
        return f"IF({in_sight} OR {text} RLIKE {quoted(_NAME_GATE)}, {chosen}, {NONE})"

    return f"IF({text} RLIKE '[{P.CAPITALS}][{P.SMALLS}]', {let(label_in_sight, pick, SPAN)}, {NONE})"


def accepted_spans(text: str, row_left: str, above: str, taken: str) -> str:
    """Every accepted span of a line, sorted; no two overlap. Reservations (amounts in words) are dropped."""
    return f"filter(sort_array({joined(taken, name_spans(text, row_left, above, taken))}), f -> f.k <> 'groszy')"


_NUMBERS = ("money", "symbol", "percent", "phone", "number")
_NEEDED = {
    "amount": _NUMBERS, "pesel": _NUMBERS, "tax": _NUMBERS, "nip": _NUMBERS, "regon": _NUMBERS, "phone": _NUMBERS,
    "number": _NUMBERS, "symbol": ("symbol",), "name": ("name",), "given": ("name",), "surname": ("name",),
    "postal": ("postal",),
}


def _needed(spans: str) -> dict[str, str]:
    """For each category of label words whether a line's spans ask for it."""
    has = lambda kinds: f"exists({spans}, s -> {is_one_of('s.k', kinds)})"
    return {category: has(kinds) for category, kinds in _NEEDED.items()}


def typed(met: str, index: str, around: str) -> str:
    """Findings of attached spans, without labels: a line's labels together can be far longer than the line."""

    def one(m: str) -> str:
        digits = f"IF({is_one_of(f'{m}.s.k', _NUMBERS)}, {plain_digits(f'{m}.s.v')}, NULL)"
        left = lambda category: f"element_at({index}, -1).{category} <= {m}.s.s"
        street = f"coalesce({m}.x.street <= {m}.at, false)"
        return let(
            digits,
            lambda d: let(
                finding_type(f"{m}.s.k", f"{m}.s.v", d, lambda c: holds(m, c), left, street), lambda t: _finding(f"{m}.s", t, "CAST(NULL AS STRING)", f"{m}.why", f"{m}.p"), FINDING
            ),
            FINDING,
        )

    return f"transform({met}, m -> {let(judged('m', index, around), one, FINDING)})"


def _finding(s: str, t: str, label: str, why: str, p: str) -> str:
    date = f"IF({is_one_of(f'{s}.k', DATE_PATTERNS)}, {read_date(f'{s}.k', f'{s}.v')}, NULL)"
    return (
        f"named_struct('start', {s}.s, 'end', {s}.e, 'kind', {s}.k, 'type', {t}.type, 'value', {s}.v, 'score', {t}.score, "
        f"'date', {date}, 'label', {label}, 'why', {why}, 'p', {p}, 'before', {t}.before)"
    )


#: Spans times characters of a line up to which each span's label is cut out and read instead of using the index.
SHORT = 1 << 15


def typed_short(spans: str, text: str, row_left: str, above: str) -> str:
    """:func:`typed` with labels, for lines of which all labels together are short. The same rules on the labels."""

    def labelled(left: str) -> str:
        label = label_for(left, row_left, above)
        whole = f"named_struct('left', {left}, 'label', {label})"
        return let(whole, lambda c: let(f"lower({c}.label)", lambda low: judged_by(c, low), FINDING), FINDING)

    def judged_by(c: str, low: str) -> str:
        digits = f"IF({is_one_of('s.k', _NUMBERS)}, {plain_digits('s.v')}, NULL)"
        left = lambda category: label_holds(f"lower({c}.left)", category)
        rules = lambda d: finding_type("s.k", "s.v", d, lambda k: label_holds(low, k), left, starts_with_street(low))
        before = f"coalesce(nullif({clean_label(f'right(lower({c}.left), 40)')}, ''), {c}.label)"

        made = lambda t: _finding("s", t, f"IF({t}.before, {before}, {c}.label)", "CAST(NULL AS INT)", "CAST(NULL AS INT)")
        return let(digits, lambda d: let(rules(d), made, FINDING), FINDING)

    return f"transform({spans}, s -> {let(f'substring({text}, 1, s.s)', labelled, FINDING)})"


def all_spans(text: str, row_left: str, above: str, shape: str) -> dict[str, str]:
    """Steps from a searchable line to its accepted spans."""
    return {
        "_taken": value_spans(text, row_left, above, shape),
        "_spans": accepted_spans(text, row_left, above, "{_taken}"),
    }


def steps(line, spans=all_spans) -> dict[str, str]:
    """The detector as named steps, each an expression over the line and the steps before it; ``_found`` is the last.

    ``line`` gives the name of one of the line's fields ``text``, ``row_left`` and ``above``. Steps of other steps are
    written ``{_name}``, for they are columns where a line is a row and elements of arrays where a page is. ``spans``
    makes the steps up to ``_spans``. Nothing is nested deeper than a step, which keeps the analysis of plans short.
    """
    text, row_left, above = "{_text}", line("row_left"), line("above")
    around = f"coalesce({row_left}, {above})"
    needed = _needed("{_spans}")
    long = f"CAST(size({{_spans}}) AS BIGINT) * length({text}) > {SHORT}"
    return {
        "_text": searchable(line("text")),
        "_shape": shape_of(text),
        **spans(text, row_left, above, "{_shape}"),
        "_index": f"IF({long}, {index_of(text, needed)}, NULL)",
        "_met": f"IF({{_index}} IS NULL, NULL, {attached('{_spans}', '{_index}', around, needed)})",
        "_around": f"IF({{_met}} IS NULL, NULL, {around_entry('{_met}', around, needed)})",
        "_found": f"CASE WHEN size({{_spans}}) = 0 THEN CAST(array() AS array<{FINDING}>) WHEN {{_met}} IS NULL "
        f"THEN {typed_short('{_spans}', line('text'), row_left, above)} ELSE {typed('{_met}', '{_index}', '{_around}')} END",
    }


# Without names that nothing explains. Rows are made from this expression and not from the column of the last step: of a
# column the optimizer infers that it is not empty, and would unfold all steps into that condition at the scan.
EXPLAINED = f"filter({{}}, f -> f.type <> 'nazwa' OR {strong_name('f.value')})"


def _filled(sql: str, known, name) -> str:
    """The expression with the steps it uses named."""
    for step in known:
        sql = sql.replace("{" + step + "}", name(step))
    return sql


def with_steps(lines: DataFrame, spans=all_spans, last: str = "_found") -> DataFrame:
    """Lines with ``text, row_left, above`` and the steps up to ``last`` as columns."""
    known: list[str] = []
    for name, sql in steps(lambda field: field, spans).items():
        lines = lines.withColumn(name, F.expr(_filled(sql, known, lambda step: step)))
        known.append(name)
        if name == last:
            break
    return lines


def page_findings(pages: DataFrame, lines: str) -> DataFrame:
    """Pages with ``found``: all their findings as one array, each with its ``line_no``, in reading order.

    ``lines`` is the expression of a page's lines, ``array<struct<line_no, text, above>>``. Each step is an array with an
    element per line, so everything stays inside the page's row.
    """
    known: list[str] = []
    field = lambda name: "CAST(NULL AS STRING)" if name == "row_left" else f"l.{name}"
    rows = pages.withColumn("_lines", F.expr(lines))
    for name, sql in steps(field).items():
        rows = rows.withColumn(name, F.expr(f"transform(_lines, (l, i) -> {_filled(sql, known, lambda step: f'{step}[i]')})"))
        known.append(name)
    found = (
        f"flatten(transform(_lines, (l, i) -> transform({EXPLAINED.format('_found[i]')}, "
        "f -> named_struct('line_no', l.line_no, 'f', f))))"
    )
    # Through a one-element array: a condition on what is made of the findings stays above it and is not unfolded.
    return rows.select(*pages.columns, F.explode(F.array(F.expr(found))).alias("found"))


def describe(lines: DataFrame, keep: list[str], spans=all_spans) -> DataFrame:
    """Lines with ``text, row_left, above, source`` to one row per finding of their spans, with label, score and date.

    A line's findings are typed together; labels are cut out after they have become rows, so one is in memory at a time,
    and only where they are asked for.
    """
    rows = with_steps(lines.select(*keep, "source", "text", "row_left", "above"), spans).select(
        *keep, "source", "text", "row_left", "above", F.explode(F.expr(EXPLAINED.format("_found"))).alias("f")
    )
    label = cut_label("text", "f.start", "f.why", "f.p", "coalesce(row_left, above)")
    window = "right(lower(substring(text, greatest(f.start - 104, 0) + 1, least(f.start, 104))), 40)"
    label = f"CASE WHEN f.label IS NOT NULL THEN f.label WHEN f.before THEN coalesce(nullif({clean_label(window)}, ''), {label}) ELSE {label} END"
    return rows.select(
        *keep, "source", F.col("f.kind").alias("kind"), F.col("f.start").alias("start"), F.col("f.end").alias("end"),
        F.col("f.type").alias("type"), F.col("f.value").alias("value"), F.expr(label).alias("label"),
        F.expr(capped_score("f.score", "source")).alias("score"), F.col("f.date").alias("date"),
    )
