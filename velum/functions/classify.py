"""Types and scores of findings."""

from __future__ import annotations

from velum.functions import patterns as P
from velum.functions.checks import nip_check, pesel_check
from velum.functions.labels import clean_label, label_holds
from velum.functions.sqlx import is_one_of, let, quoted


def typed(kind: str, score) -> str:
    return f"named_struct('type', {quoted(kind)}, 'score', {score}D)"


def classify_number(low: str, token: str, digits: str) -> str:
    """:func:`number_rules` for a lower-cased label that is at hand."""
    return number_rules(lambda category: label_holds(low, category), token, digits)


def number_rules(has, token: str, digits: str) -> str:
    """Type and score of a number from its label and its own shape; the first rule that holds wins.

    ``has`` tells whether the label holds a word of a category.
    """
    n = f"length({digits})"
    return f"""CASE
        WHEN {token} LIKE '%\\\\%' THEN {typed('procent', 0.8)}
        WHEN contains({token}, '+') THEN {typed('telefon', 0.85)}
        WHEN ({token} RLIKE '(?U)[.,]\\\\d{{2}}' OR contains({token}, 'zł')) AND {has('amount')}
            THEN {typed('kwota', 0.9)}
        WHEN {n} = 11 AND {has('pesel')} THEN {typed('PESEL', 0.98)}
        WHEN {n} = 11 THEN IF({pesel_check(digits)}, {typed('PESEL', 0.85)}, {typed('numer', 0.35)})
        WHEN {n} = 10 AND {has('tax')} THEN {typed('NIP', 0.97)}
        WHEN {n} = 10 THEN IF({nip_check(digits)}, {typed('NIP', 0.85)}, {typed('numer', 0.35)})
        WHEN {n} = 9 AND {has('regon')} THEN {typed('REGON', 0.95)}
        WHEN {n} = 26 THEN {typed('nr konta', 0.95)}
        WHEN {n} = 13 AND {has('nip')} THEN {typed('NIP', 0.95)}
        WHEN {n} BETWEEN 9 AND 13 AND {has('phone')} THEN {typed('telefon', 0.9)}
        WHEN {has('number')} THEN {typed('numer', 0.7)}
        WHEN {token} RLIKE {quoted(P.WHOLE_AMOUNT)} THEN {typed('kwota?', 0.4)}
        WHEN {n} BETWEEN 9 AND 13 AND {token} RLIKE {quoted(P.WHOLE_PHONE)} THEN {typed('telefon?', 0.45)}
        ELSE {typed('numer', 0.4)} END"""


def starts_with_street(low: str) -> str:
    return "(" + " OR ".join(f"startswith({low}, {quoted(p)})" for p in P.STREET_PREFIXES) + ")"


def street_override(low: str, found: str) -> str:
    """A plain number behind a street prefix is a house number."""
    return f"IF({found}.type = 'numer' AND {starts_with_street(low)}, {typed('ulica nr', 0.25)}, {found})"


def name_rules(name: str, has, left) -> str:
    """``struct<type, score, before>`` of a capitalised word or run of words; ``before`` if the text before is its label."""
    row = lambda kind, score, before="false": f"named_struct('type', {kind}, 'score', {score}D, 'before', {before})"
    whole = f"{has('given')} OR NOT {has('surname')}"
    return f"""CASE
        WHEN {has('name')} THEN {row(f"IF({whole}, 'imię i nazwisko', 'nazwisko')", 0.9)}
        WHEN {left('name')} THEN {row("'imię i nazwisko'", 0.8, 'true')}
        WHEN {name} RLIKE '(?U)\\\\s' THEN {row("'imię i nazwisko'", 0.55)}
        ELSE {row("'nazwa'", 0.3)} END"""


def classify_name(left: str, left_low: str, name: str, label: str, low: str) -> str:
    """Type, label and score of a capitalised word or run of words whose label is at hand, also in lower case."""
    rules = name_rules(name, lambda c: label_holds(low, c), lambda c: label_holds(left_low, c))
    before = f"coalesce(nullif({clean_label(f'right({left_low}, 40)')}, ''), {label})"
    return let(
        rules,
        lambda t: f"named_struct('type', {t}.type, 'label', IF({t}.before, {before}, {label}), 'score', {t}.score)",
        "struct<type:string,label:string,score:double>",
    )


def strong_name(name: str) -> str:
    """At least two capitals: what an unexplained ``nazwa`` needs to be kept."""
    return f"length(regexp_replace({name}, '[^{P.CAPITALS}]', '')) >= 2"


def postal_score(has, left) -> str:
    """A postal code is certain only near words of an address."""
    return f"IF({has('postal')} OR {left('postal')}, 0.95D, 0.5D)"


def date_score(kind: str) -> str:
    return f"IF({kind} IN ('ymd', 'dmy'), 0.95D, 0.85D)"


def capped_score(score: str, source: str) -> str:
    """Findings in recognised (scanned) text are never trusted above the cap."""
    return f"IF({source} = 'ocr', least({score}, {P.OCR_SCORE_CAP}D), {score})"


def finding_type(kind: str, value: str, digits: str, has, left, street: str) -> str:
    """``struct<type, score, before>`` of an accepted span of any detector.

    ``has`` and ``left`` tell whether the label, and all text to the left, hold a word of a category; ``street`` whether
    the label begins with a street prefix. ``digits`` are the digits of a number.
    """
    fixed = lambda name, score: f"named_struct('type', {name}, 'score', {score}, 'before', false)"
    symbol = f"IF({has('symbol')}, {typed('numer', 0.75)}, {typed('symbol', 0.4)})"
    number = f"IF({kind} = 'symbol', {symbol}, {number_rules(has, value, digits)})"
    numbered = let(
        number,
        lambda n: f"CASE WHEN {kind} = 'money' THEN {fixed("'kwota'", f'greatest({n}.score, 0.7D)')} "
        f"WHEN {n}.type = 'numer' AND {street} THEN {fixed("'ulica nr'", '0.25D')} ELSE {fixed(f'{n}.type', f'{n}.score')} END",
        "struct<type:string,score:double,before:boolean>",
    )
    return f"""CASE
        WHEN {kind} = 'name' THEN {name_rules(value, has, left)}
        WHEN {is_one_of(kind, ('ymd', 'dmy', 'd-month-y', 'month-y'))} THEN {fixed("'data'", date_score(kind))}
        WHEN {kind} = 'account' THEN {fixed("'nr konta'", '0.95D')}
        WHEN {kind} = 'pesel' THEN {fixed("'PESEL'", '0.95D')}
        WHEN {kind} = 'nip' THEN {fixed("'NIP'", '0.95D')}
        WHEN {kind} = 'postal' THEN {fixed("'kod pocztowy'", postal_score(has, left))}
        ELSE {numbered} END"""


def type_group(kind: str) -> str:
    return f"""CASE
        WHEN {kind} = 'data' THEN 'data'
        WHEN {kind} IN ('imię i nazwisko', 'nazwisko', 'nazwa') THEN 'osoby'
        WHEN startswith({kind}, 'kwota') THEN 'kwota'
        WHEN {kind} IN ('PESEL', 'NIP', 'REGON', 'nr konta', 'kod pocztowy', 'telefon', 'telefon?') THEN 'id'
        ELSE 'numer' END"""


def confidence_band(score: str) -> str:
    percent = f"round({score} * 100)"
    return f"CASE WHEN {percent} >= {P.BAND_HIGH} THEN '★★★' WHEN {percent} >= {P.BAND_MEDIUM} THEN '★★' ELSE '★' END"
