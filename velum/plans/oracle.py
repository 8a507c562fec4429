"""The same results as plain SQL for DuckDB, to check every query against.

DuckDB's regular expressions have no look-around and no back-references. Boundaries are therefore written into the
text first: runs of digits, words or symbol characters are bracketed with private-use characters that tell what
stands before and after, and patterns are matched on the marked text.
"""

from __future__ import annotations

from velum.functions import patterns as P
from velum.plans import fixtures as fx
from velum.plans.catalog import FORM_MAPPING, REQUIRED, SALT

ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[str, list[str]]] = {}

S = "\ue000"
# Run of digits: starts A, after '.' P, after ',' K (for dates: P after any separator); ends B, before '.' or ',' Q,
# before separator and digit F. Word or symbol run: U … V. X stands for a '.' right before a word.
A, Pm, K, B, Q, F, U, V = (chr(c) for c in range(0xE010, 0xE018))
X = "\ue020"
STRIP = f"[{A}-{V}]"

WS = r"[\t-\r \x{85}\p{Z}]"
KEY = "doc_id, page, line_no, part_idx"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, list(needs))


def oracle(key: str, sql: str, *needs: str) -> None:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTES[name][1]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order)
    ORACLES[key] = f"WITH {head}\n{sql}" if head else sql


def has_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


# ---- expressions -------------------------------------------------------------------------------------

_SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in P.SPACES) + ")"
_EDGE = f"concat({_SPACES}, {lit(P.LABEL_EDGE[len(P.SPACES):])})"


def single(text: str) -> str:
    return f"regexp_replace({text}, '{WS}{{2,}}', ' ', 'g')"


def clean(text: str) -> str:
    return single(f"trim({text}, {_EDGE})")


def n_words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{WS}+'), lambda q: q <> ''))"


def offered_above(text: str) -> str:
    t = clean(text)
    return (
        f"CASE WHEN {t} <> '' AND ({n_words(t)} <= 5 OR {t} LIKE '%=') THEN right(rtrim({t}, ':='), 60) END"
    )


def offered_beside(text: str) -> str:
    t = clean(text)
    named = f"regexp_matches({t}, '{P.NAME_SHAPED}')"
    return (
        f"CASE WHEN {t} = '' OR {named} OR regexp_matches({t}, '[0-9]') THEN NULL "
        f"WHEN {n_words(t)} <= 5 AND len({t}) >= 2 THEN {t} ELSE right({t}, 60) END"
    )


def piece(left: str) -> str:
    pieces = f"string_split_regex({left}, '{WS}{{2,}}|;')"
    return f"coalesce(trim(list_filter({pieces}, lambda q: trim(q, {_SPACES}) <> '')[-1], {_EDGE}), '')"


def valid(digits: str, weights, modulus: int) -> str:
    total = " + ".join(f"{w} * CAST(substr({digits}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1))
    last = f"CAST(substr({digits}, {len(weights) + 1}, 1) AS INT)"
    check = f"(10 - ({total}) % 10) % 10" if modulus == 10 else f"({total}) % 11"
    return f"(len({digits}) = {len(weights) + 1} AND {check} = {last})"


def number_rules(lab: str, token: str, d: str) -> str:
    n = f"len({d})"
    row = lambda kind, score: f"{{'type': '{kind}', 'score': CAST({score} AS DOUBLE)}}"
    return f"""CASE
        WHEN suffix({token}, '%') THEN {row('procent', 0.8)}
        WHEN contains({token}, '+') THEN {row('telefon', 0.85)}
        WHEN {has_any(lab, P.AMOUNT_LABELS)} AND (regexp_matches({token}, '[.,][0-9][0-9]') OR contains({token}, 'zł'))
            THEN {row('kwota', 0.9)}
        WHEN {n} = 11 THEN CASE WHEN contains({lab}, 'pesel') THEN {row('PESEL', 0.98)}
            WHEN {valid(d, P.PESEL_WEIGHTS, 10)} THEN {row('PESEL', 0.85)} ELSE {row('numer', 0.35)} END
        WHEN {n} = 10 THEN CASE WHEN {has_any(lab, ['nip', 'podatk'])} THEN {row('NIP', 0.97)}
            WHEN {valid(d, P.NIP_WEIGHTS, 11)} THEN {row('NIP', 0.85)} ELSE {row('numer', 0.35)} END
        WHEN {n} = 9 AND contains({lab}, 'regon') THEN {row('REGON', 0.95)}
        WHEN {n} = 26 THEN {row('nr konta', 0.95)}
        WHEN contains({lab}, 'nip') AND {n} = 13 THEN {row('NIP', 0.95)}
        WHEN {has_any(lab, P.PHONE_LABELS)} AND {n} >= 9 AND {n} <= 13 THEN {row('telefon', 0.9)}
        WHEN {has_any(lab, P.NUMBER_LABELS)} THEN {row('numer', 0.7)}
        WHEN regexp_matches({token}, '^[0-9]+([ \\x{{a0}}][0-9][0-9][0-9])*[.,][0-9][0-9]$') THEN {row('kwota?', 0.4)}
        WHEN regexp_matches({token}, '^\\+?[0-9][0-9 \\x{{a0}}-]{{7,}}$') AND {n} >= 9 AND {n} <= 13
            THEN {row('telefon?', 0.45)}
        ELSE {row('numer', 0.4)} END"""


TYPE_GROUP = """CASE WHEN type = 'data' THEN 'data' WHEN type IN ('imię i nazwisko', 'nazwisko', 'nazwa') THEN 'osoby'
    WHEN type IN ('kwota', 'kwota?') THEN 'kwota'
    WHEN type IN ('PESEL', 'NIP', 'REGON', 'nr konta', 'kod pocztowy', 'telefon', 'telefon?') THEN 'id' ELSE 'numer' END"""
BAND = "CASE WHEN score >= 0.845 THEN '★★★' WHEN score >= 0.595 THEN '★★' ELSE '★' END"

# ---- inputs ------------------------------------------------------------------------------------------

_R = fx.FIRST_DOC
cte(
    "given_pages",
    f"""SELECT doc_id, CAST(0 AS INT) AS page, text FROM documents
    UNION ALL SELECT {_R['pages']} + page_id, 0, html FROM pages
    UNION ALL SELECT {_R['conversations']} + conv_id, CAST(turn AS INT), text FROM conversations
    UNION ALL SELECT {_R['benchmark']} + item_id, 0, text FROM benchmark""",
)
cte("f_pages", fx.forms_sql(fx.DUCKDB_JOIN))
cte("b_pages", fx.bare_sql(fx.DUCKDB_JOIN))
cte(
    "c_pages",
    "SELECT * FROM given_pages UNION ALL SELECT * FROM f_pages UNION ALL SELECT * FROM b_pages",
    "given_pages", "f_pages", "b_pages",
)


def lines_of(prefix: str) -> None:
    cte(
        f"{prefix}_raw",
        f"""SELECT doc_id, page, unnest(string_split(text, chr(10))) AS text,
            generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {prefix}_pages""",
        f"{prefix}_pages",
    )
    cte(
        f"{prefix}_lines",
        f"""SELECT doc_id, page, line_no, pos, CAST(0 AS INT) AS part_idx, text, CAST(NULL AS VARCHAR) AS row_left,
            coalesce(lag(offer, 1) OVER w, lag(offer, 2) OVER w, lag(offer, 3) OVER w) AS above, 'text' AS source
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS INT) AS line_no,
              {offered_above('text')} AS offer FROM {prefix}_raw WHERE trim(text, {_SPACES}) <> '')
        WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)""",
        f"{prefix}_raw",
    )


# ---- detectors ---------------------------------------------------------------------------------------

_ALT = "(?i:" + P.MONTH_WORDS + ")"
_YMD = "|".join(
    f"{A}[0-9]{{4}}{F}{s}{Pm}[0-9]{{1,2}}{F}{s}{Pm}(?:[0-9]{{3}}[{B}{F}]|[0-9]{{2}}[{B}{F}]|[0-9]{B})"
    for s in (r"\.", "-", "/")
)
_DMY = "|".join(
    f"{A}[0-9]{{1,2}}{F}{s}{Pm}[0-9]{{1,2}}{F}{s}{Pm}(?:[0-9]{{5}}[{B}{F}]|[0-9]{{4}}{B}|[0-9]{{3}}[{B}{F}]|[0-9]{{2}}{B})"
    for s in (r"\.", "-", "/")
)
_SP = r"[ \x{a0}]"
_NUM_END = f"(?:{B}|{Q}[.,][{Pm}{K}][0-9]{{1,3}}{B})"
_CURRENCY = r"(?:zł|zl|PLN|EUR|USD|CHF|GBP|€|\$)"
# kind: (priority, column of marked text, pattern, characters of the match that are not part of the value)
DETECTORS = {
    "groszy": (0, "m_num", f"[{A}{Pm}{K}][0-9]{{1,2}}{B}/{A}100[{B}{Q}]", "0"),
    "ymd": (
        1, "m_date", _YMD,
        f"CASE WHEN regexp_matches(p, '[0-9]{{3}}[{B}{F}]$') OR regexp_matches(p, '[0-9]{{2}}{F}$') THEN 1 ELSE 0 END",
    ),
    "dmy": (
        2, "m_date", _DMY,
        f"CASE WHEN regexp_matches(p, '{Pm}([0-9]{{5}}|[0-9]{{3}})[{B}{F}]$') THEN 1 ELSE 0 END",
    ),
    "d-month-y": (
        3, "m_word",
        f"{U}[0-9]{{1,2}}{V}{WS}+{U}{_ALT}{V}\\.?(?:{WS}+{U}[0-9]{{4}}{V})?(?:{WS}+{U}[rR]{V}\\.?)?", "0",
    ),
    "month-y": (4, "m_word", f"{U}{_ALT}{V}{WS}+{U}[0-9]{{4}}{V}", "0"),
    "account": (5, "m_num", f"[{A}{Pm}{K}][0-9]{{2}}(?:(?:{B}[ \\x{{a0}}-]{A})?[0-9]{{4}}){{6}}[{B}{Q}]", "0"),
    "pesel": (6, "m_num", f"[{A}{Pm}{K}][0-9]{{11}}[{B}{Q}]", "0"),
    "nip": (7, "m_num", f"[{A}{Pm}{K}][0-9]{{10}}[{B}{Q}]", "0"),
    "postal": (8, "m_num", f"[{A}{Pm}{K}][0-9]{{2}}{B}-{A}[0-9]{{3}}[{B}{Q}]", "0"),
    "money": (
        9, "m_num",
        f"[{A}{K}](?:[0-9]{{1,3}}(?:{B}{_SP}{A}[0-9]{{3}})*|[0-9]+){Q}[.,][{Pm}{K}][0-9]{{2}}{B}{WS}?{_CURRENCY}", "0",
    ),
    "symbol": (
        10, "m_sym", f"{U}[A-Z][A-Z0-9]{{0,8}}(?:(?:/|{V}-{U})[A-Z0-9]{{1,8}}){{1,5}}{V}", "0",
    ),
    "percent": (11, "m_num", f"{A}[0-9]{{1,3}}(?:{Q}[.,][{Pm}{K}][0-9]{{1,2}})?{B}{WS}?%", "0"),
    "phone": (12, "text", r"(?:\+[0-9]{2}[ \-]?)?(?:[0-9][ \-]?){8,11}[0-9]", "0"),
    "number": (
        13, "m_num",
        f"{A}(?:[0-9]{{1,3}}(?:{B}{_SP}{A}[0-9]{{3}})*{B}{_SP}{A}[0-9]{{3}}{_NUM_END}|[0-9]+{_NUM_END})", "0",
    ),
    "name": (14, "text", P.WORD, "0"),
}


def hits(prefix: str, kind: str) -> str:
    rank, column, pattern, cut = DETECTORS[kind]
    return f"""SELECT {KEY}, {rank} AS rank, '{kind}' AS kind, e0 - n AS s, e0 - {cut} AS e FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY {KEY} ORDER BY i) AS INT) AS e0 FROM (
            SELECT *, CAST(len(regexp_replace(p, '{STRIP}', '', 'g')) AS INT) AS n FROM (
                SELECT {KEY}, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (
                    SELECT {KEY}, string_split(regexp_replace({column}, {lit(f'({pattern})')}, '{S}\\1{S}', 'g'), '{S}') AS ps
                    FROM {prefix}_marks) WHERE len(ps) > 1)))
        WHERE i % 2 = 0"""


def engine(prefix: str) -> None:
    """Findings of ``{prefix}_lines``: candidates, arbitration, names, items."""
    base = f"regexp_replace(text, '([0-9]+)', '{A}\\1{B}', 'g')"
    num = f"replace(replace({base}, '.{A}', '.{Pm}'), ',{A}', ',{K}')"
    date = f"regexp_replace({base}, '([./-]){A}', '\\1{Pm}', 'g')"
    cte(
        f"{prefix}_marks",
        f"""SELECT *, regexp_replace({num}, '{B}([.,])', '{Q}\\1', 'g') AS m_num,
            regexp_replace({date}, '{B}([./-])([{A}{Pm}])', '{F}\\1\\2', 'g') AS m_date,
            replace(regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)', '{U}\\1{V}', 'g'), '.{U}', '{X}{U}') AS m_word,
            regexp_replace(text, '([A-Za-z0-9/]+)', '{U}\\1{V}', 'g') AS m_sym
        FROM {prefix}_lines""",
        f"{prefix}_lines",
    )
    numeric = [k for k in DETECTORS if k != "name"]
    cte(f"{prefix}_hits", " UNION ALL ".join(hits(prefix, k) for k in numeric), f"{prefix}_marks")
    label = f"CASE WHEN len(near) >= 3 THEN near WHEN len(whole) >= 3 THEN whole ELSE coalesce(row_left, above, near) END"
    cte(
        f"{prefix}_labelled",
        f"""SELECT *, {label} AS label, lower({label}) AS low,
                CASE WHEN len(near) >= 3 THEN near WHEN len(whole) >= 3 THEN whole END AS left_label
            FROM (SELECT *, {piece('lft')} AS near, {clean('lft')} AS whole FROM (
                SELECT h.*, l.source, l.row_left, l.above, substr(l.text, s + 1, e - s) AS value, substr(l.text, 1, s) AS lft,
                    substr(l.text, s, 1) AS before, substr(l.text, e + 1, 1) AS after
                FROM {prefix}_hits h JOIN {prefix}_lines l USING ({KEY})))""",
        f"{prefix}_hits", f"{prefix}_lines",
    )
    first, second = "string_split_regex(value, '[./-]')[1]", "string_split_regex(value, '[./-]')[2]"
    third = "string_split_regex(value, '[./-]')[3]"
    months = "MAP {" + ", ".join(f"'{w}': {m}" for w, m in P.MONTH_NUMBER.items()) + "}"
    word_month = f"{months}[lower(regexp_extract(value, '{_ALT}'))]"
    cte(
        f"{prefix}_dated",
        f"""SELECT *,
            CASE kind WHEN 'ymd' THEN CAST({first} AS INT)
                WHEN 'dmy' THEN CASE WHEN CAST({third} AS INT) < 100 THEN 2000 ELSE 0 END + CAST({third} AS INT)
                WHEN 'd-month-y' THEN TRY_CAST(regexp_extract(value, '{WS}([0-9]{{4}})', 1) AS INT)
                WHEN 'month-y' THEN CAST(regexp_extract(value, '([0-9]{{4}})$', 1) AS INT) END AS y,
            CASE WHEN kind IN ('ymd', 'dmy') THEN CAST({second} AS INT)
                WHEN kind IN ('d-month-y', 'month-y') THEN {word_month} END AS m,
            CASE kind WHEN 'ymd' THEN CAST({third} AS INT) WHEN 'dmy' THEN CAST({first} AS INT)
                WHEN 'd-month-y' THEN CAST(regexp_extract(value, '^([0-9]+)', 1) AS INT) END AS d,
            regexp_replace(value, '[^0-9]', '', 'g') AS digits
        FROM {prefix}_labelled""",
        f"{prefix}_labelled",
    )
    word = r"[\p{L}\p{N}_]"
    postal = f"CASE WHEN {has_any("lower(concat(label, ' ', lft))", P.POSTAL_CONTEXT)} THEN 0.95 ELSE 0.5 END"
    street = " OR ".join(f"starts_with(low, '{p}')" for p in P.STREET_PREFIXES)
    symbol_type = f"CASE WHEN {has_any('low', P.SYMBOL_LABELS)} THEN 'numer' ELSE 'symbol' END"
    symbol_score = f"CASE WHEN {has_any('low', P.SYMBOL_LABELS)} THEN 0.75 ELSE 0.4 END"
    cte(
        f"{prefix}_cands",
        f"""SELECT * REPLACE (CASE WHEN type = 'numer' AND ({street}) THEN 'ulica nr' ELSE type END AS type,
                CASE WHEN type = 'numer' AND ({street}) THEN CAST(0.25 AS DOUBLE) ELSE score END AS score),
            CASE WHEN y > 0 AND m > 0 AND d > 0 THEN TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS date_value
        FROM (SELECT *,
            CASE WHEN rank BETWEEN 1 AND 4 THEN 'data' WHEN kind = 'account' THEN 'nr konta' WHEN kind = 'pesel' THEN 'PESEL'
                WHEN kind = 'nip' THEN 'NIP' WHEN kind = 'postal' THEN 'kod pocztowy' WHEN kind = 'money' THEN 'kwota'
                WHEN kind = 'symbol' THEN {symbol_type} WHEN kind = 'groszy' THEN '' ELSE c.type END AS type,
            CAST(CASE WHEN kind IN ('ymd', 'dmy') THEN 0.95 WHEN rank IN (3, 4) THEN 0.85
                WHEN kind IN ('account', 'pesel', 'nip') THEN 0.95 WHEN kind = 'postal' THEN {postal}
                WHEN kind = 'money' THEN greatest(c.score, 0.7) WHEN kind = 'symbol' THEN {symbol_score}
                ELSE c.score END AS DOUBLE) AS score
            FROM (SELECT *, {number_rules('low', 'value', 'digits')} AS c FROM {prefix}_dated)
            WHERE CASE kind
                WHEN 'groszy' THEN NOT regexp_matches(before, '{word}') AND NOT regexp_matches(after, '{word}')
                WHEN 'ymd' THEN m <= 12 AND d BETWEEN 1 AND 31 WHEN 'dmy' THEN m <= 12 AND d BETWEEN 1 AND 31
                WHEN 'd-month-y' THEN d BETWEEN 1 AND 31
                WHEN 'pesel' THEN contains(low, 'pesel') OR {valid('digits', P.PESEL_WEIGHTS, 10)}
                WHEN 'nip' THEN contains(low, 'nip') OR {valid('digits', P.NIP_WEIGHTS, 11)}
                WHEN 'percent' THEN NOT regexp_matches(after, '[0-9]')
                WHEN 'number' THEN len(digits) > 2 ELSE true END)""",
        f"{prefix}_dated",
    )
    no_span = "CAST([] AS STRUCT(rank INT, s INT, e INT)[])"
    fold = (
        f"list_reduce(list({{'rank': CAST(rank AS INT), 's': CAST(s AS INT), 'e': CAST(e AS INT)}} ORDER BY rank, s), "
        f"lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.s < x.e AND x.s < t.e)) > 0 THEN acc "
        f"ELSE list_append(acc, x) END, {no_span})"
    )
    cte(f"{prefix}_taken", f"SELECT {KEY}, {fold} AS taken FROM {prefix}_cands GROUP BY {KEY}", f"{prefix}_cands")
    cte(
        f"{prefix}_dates",
        f"""SELECT c.* FROM {prefix}_cands c JOIN (
            SELECT {KEY}, unnest({fold}) AS t FROM {prefix}_cands WHERE rank BETWEEN 1 AND 4 GROUP BY {KEY}) a
            ON c.doc_id = a.doc_id AND c.page = a.page AND c.line_no = a.line_no AND c.part_idx = a.part_idx
            AND c.rank = a.t.rank AND c.s = a.t.s""",
        f"{prefix}_cands",
    )
    cte(
        f"{prefix}_accepted",
        f"""SELECT c.* FROM {prefix}_cands c JOIN (SELECT {KEY}, unnest(taken) AS t FROM {prefix}_taken) a
            ON c.doc_id = a.doc_id AND c.page = a.page AND c.line_no = a.line_no AND c.part_idx = a.part_idx
            AND c.rank = a.t.rank AND c.s = a.t.s""",
        f"{prefix}_cands", f"{prefix}_taken",
    )
    # names
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(P.STOP_WORDS))
    gap = "substr(text, e + 1, next_s - e)"
    joined = f"regexp_matches({gap}, '^{WS}+$')"
    cte(f"{prefix}_word_hits", hits(prefix, "name"), f"{prefix}_marks")
    cte(
        f"{prefix}_capitals",
        f"""SELECT * FROM (
            SELECT *, CASE WHEN e - s <= 2 OR NOT coalesce(glued, false) THEN e
                WHEN coalesce(lead(glued) OVER w, false) THEN lead(e, 2) OVER w ELSE lead(e) OVER w END AS x
            FROM (SELECT *, {joined} AS glued FROM (
                SELECT h.*, l.text, l.row_left, l.above, l.source, lead(h.s) OVER (PARTITION BY {KEY} ORDER BY h.s) AS next_s
                FROM {prefix}_word_hits h JOIN {prefix}_lines l USING ({KEY})))
            WINDOW w AS (PARTITION BY {KEY} ORDER BY s))
        WHERE lower(substr(text, s + 1, e - s)) NOT IN ({stop}) AND substr(text, e + 1, 1) <> ':'""",
        f"{prefix}_word_hits", f"{prefix}_lines",
    )
    free = lambda end: f"len(list_filter(coalesce(taken, {no_span}), lambda t: t.s < {end} AND s < t.e)) = 0"
    name_fold = (
        "list_reduce(list({'s': CAST(s AS INT), 'e': CAST(fin AS INT)} ORDER BY s), "
        "lambda acc, w: CASE WHEN len(acc) > 0 AND w.s < acc[-1].e THEN acc ELSE list_append(acc, w) END, "
        "CAST([] AS STRUCT(s INT, e INT)[]))"
    )
    cte(
        f"{prefix}_name_spans",
        f"""SELECT {KEY}, u.s AS s, u.e AS e FROM (SELECT {KEY}, unnest({name_fold}) AS u FROM (
            SELECT *, CASE WHEN {free('x')} THEN x ELSE e END AS fin
            FROM {prefix}_capitals LEFT JOIN {prefix}_taken USING ({KEY}) WHERE {free('e')})
            WHERE fin - s >= 3 GROUP BY {KEY})""",
        f"{prefix}_capitals", f"{prefix}_taken",
    )
    cte(f"{prefix}_names", named(f"{prefix}_name_spans", f"{prefix}_lines"), f"{prefix}_name_spans", f"{prefix}_lines")
    strong = f"(type <> 'nazwa' OR len(regexp_replace(value, '[^{P.CAPITALS}]', '', 'g')) >= 2)"
    cte(
        f"{prefix}_items",
        f"""SELECT {KEY}, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", type, value, label,
                CASE WHEN source = 'ocr' AND score > 0.6 THEN CAST(0.6 AS DOUBLE) ELSE score END AS score, source,
                sha256(concat_ws('|', {KEY}, s, e)) AS item_id, date_value, y, m, d, kind
            FROM (SELECT {KEY}, s, e, type, value, label, score, source, date_value, y, m, d, kind
                    FROM {prefix}_accepted WHERE kind <> 'groszy'
                UNION ALL SELECT {KEY}, s, e, type, value, label, score, source, NULL, NULL, NULL, NULL, 'name'
                    FROM {prefix}_names WHERE {strong})""",
        f"{prefix}_accepted", f"{prefix}_names",
    )


def named(spans: str, lines: str) -> str:
    """Type, label and score of name spans."""
    label = "CASE WHEN len(near) >= 3 THEN near WHEN len(whole) >= 3 THEN whole ELSE coalesce(row_left, above, near) END"
    before = clean("right(lower(lft), 40)")
    in_label, in_left = has_any("lower(lab)", P.NAME_LABELS), has_any("lower(lft)", P.NAME_LABELS)
    return f"""SELECT {KEY}, s, e, value, source,
        CASE WHEN {in_label} THEN CASE WHEN contains(lower(lab), 'nazwisko') AND NOT contains(lower(lab), 'imię')
                AND NOT contains(lower(lab), 'imie') THEN 'nazwisko' ELSE 'imię i nazwisko' END
            WHEN {in_left} OR regexp_matches(value, '{WS}') THEN 'imię i nazwisko' ELSE 'nazwa' END AS type,
        CASE WHEN {in_label} THEN lab WHEN {in_left} THEN coalesce(nullif({before}, ''), lab) ELSE lab END AS label,
        CAST(CASE WHEN {in_label} THEN 0.9 WHEN {in_left} THEN 0.8 WHEN regexp_matches(value, '{WS}') THEN 0.55
            ELSE 0.3 END AS DOUBLE) AS score
    FROM (SELECT *, {label} AS lab FROM (SELECT *, {piece('lft')} AS near, {clean('lft')} AS whole FROM (
        SELECT h.{KEY.replace(', ', ', h.')}, h.s, h.e, l.row_left, l.above, l.source, substr(l.text, h.s + 1, h.e - h.s) AS value,
            substr(l.text, 1, h.s) AS lft
        FROM {spans} h JOIN {lines} l USING ({KEY}))))"""


for _prefix in ("c", "f", "b", "r"):
    lines_of(_prefix)
for _prefix in ("c", "f", "o", "r"):
    engine(_prefix)

# ---- recognised words --------------------------------------------------------------------------------

cte(
    "o_words",
    f"""SELECT doc_id, page, i, w, word, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0,
            CAST(x0 + 6 * len(word) AS DOUBLE) AS x1, CAST(y0 + 10 AS DOUBLE) AS y1 FROM (
        SELECT *, (CASE WHEN i >= 6 THEN 320 ELSE 40 END) + 6 * off AS x0,
            14 * (i % 6 + 1) + (CASE WHEN i >= 6 THEN (k + i) % 3 ELSE 0 END) AS y0
        FROM (SELECT *, doc_id - {_R['forms']} AS k,
                CAST(sum(len(word) + 1) OVER (PARTITION BY doc_id, page, i ORDER BY w) AS INT) - len(word) - 1 AS off
            FROM (SELECT doc_id, page, line_no AS i, unnest(string_split(text, ' ')) AS word,
                unnest(range(0, len(string_split(text, ' ')))) AS w FROM f_lines))
        WHERE 30 + (k * 7 + w) % 70 >= 35)""",
    "f_lines",
)
cte(
    "o_line_words",
    """SELECT *, CAST(sum(len(word) + 1) OVER (PARTITION BY doc_id, page, i ORDER BY w) AS INT) AS ws_end FROM o_words""",
    "o_words",
)
cte(
    "o_text",
    """SELECT doc_id, page, i, string_agg(word, ' ' ORDER BY w) || ' ' AS text, min(x0) AS x0, min(y0) AS y0,
        max(x1) AS x1, max(y1) AS y1 FROM o_words GROUP BY doc_id, page, i""",
    "o_words",
)
cte(
    "o_rows",
    """SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page, row_no ORDER BY x0, i) - 1 AS INT) AS part_idx FROM (
        SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY leader) - 1 AS INT) AS row_no FROM (
            SELECT t.*, CASE WHEN l.i IS NOT NULL THEN l.i ELSE t.i END AS leader
            FROM o_text t LEFT JOIN o_text l ON l.doc_id = t.doc_id AND l.page = t.page AND l.i = t.i - 6))""",
    "o_text",
)
cte(
    "o_lines",
    f"""SELECT r.doc_id, r.page, r.row_no AS line_no, r.part_idx, r.text, r.x0, r.x1, r.i,
            CASE WHEN q.x1 <= r.x0 + 1 THEN {offered_beside('q.text')} END AS row_left, a.above, 'ocr' AS source
        FROM o_rows r
        LEFT JOIN o_rows q ON q.doc_id = r.doc_id AND q.page = r.page AND q.row_no = r.row_no AND q.part_idx = r.part_idx - 1
        LEFT JOIN (SELECT doc_id, page, row_no, part_idx, arg_min(offer, near) AS above FROM (
            SELECT t.doc_id, t.page, t.row_no, t.part_idx, (t.row_no - u.row_no) * 1000 + u.part_idx AS near, u.offer
            FROM o_rows t JOIN (SELECT *, {offered_above('text')} AS offer FROM o_rows) u
            ON u.doc_id = t.doc_id AND u.page = t.page AND u.row_no BETWEEN t.row_no - 3 AND t.row_no - 1
            WHERE u.offer IS NOT NULL AND least(u.x1, t.x1) - greatest(u.x0, t.x0) >= -5)
            GROUP BY doc_id, page, row_no, part_idx) a
        ON a.doc_id = r.doc_id AND a.page = r.page AND a.row_no = r.row_no AND a.part_idx = r.part_idx""",
    "o_rows",
)
cte(
    "o_pieces",
    """SELECT t.*, CAST(row_number() OVER (PARTITION BY item_id ORDER BY w) - 1 AS INT) AS piece_no,
            px0 + (px1 - px0) * f / n AS x0, py0 AS y0, px0 + (px1 - px0) * f / n + (px1 - px0) * (g - f) / n AS x1, py1 AS y1
        FROM (SELECT it.*, v.w, v.x0 AS px0, v.x1 AS px1, v.y0 AS py0, v.y1 AS py1, len(v.word) + 1 AS n,
                greatest(it.start - (v.ws_end - len(v.word) - 1), 0) AS f,
                least(it."end" - (v.ws_end - len(v.word) - 1), len(v.word) + 1) AS g
            FROM o_items it JOIN o_lines l USING (doc_id, page, line_no, part_idx)
            JOIN o_line_words v ON v.doc_id = l.doc_id AND v.page = l.page AND v.i = l.i) t
        WHERE g > f""",
    "o_items", "o_lines", "o_line_words",
)
cte(
    "o_boxed",
    f"""SELECT {KEY}, start, "end", type, value, label, score, source, item_id, min(x0) AS x0, min(y0) AS y0,
            max(x1) AS x1, max(y1) AS y1
        FROM o_pieces GROUP BY {KEY}, start, "end", type, value, label, score, source, item_id""",
    "o_pieces",
)

# ---- one statement per query -------------------------------------------------------------------------

LINE = "doc_id, page, line_no"
PLAIN = 'start, "end", value, type, label, score'

oracle(
    "scan_documents",
    f"SELECT doc_id, page, len(text) AS n_chars FROM given_pages WHERE trim(text, {_SPACES}) <> ''",
    "given_pages",
)
oracle(
    "empty_documents",
    f"SELECT doc_id, page FROM given_pages WHERE (doc_id + page) % 2 <> 0 OR coalesce(trim(text, {_SPACES}), '') = ''",
    "given_pages",
)
oracle("explode_lines", f"SELECT {LINE}, text FROM c_lines", "c_lines")
_MAPPING = FORM_MAPPING.replace("FROM (SELECT c_custkey AS c FROM customer)", "FROM (SELECT c_custkey AS c FROM customer) q")
cte("mapping", _MAPPING)
_USABLE = "trim(coalesce(nowa, '')) <> ''"
cte(
    "first_entries",
    f"""SELECT side, k, min(ord) AS ord, arg_min(trim(nowa), ord) AS nowa FROM (
        SELECT 'l' AS side, lower(trim(opis)) AS k, ord, nowa FROM mapping WHERE {_USABLE}
        UNION ALL SELECT 'v', trim(stara), ord, nowa FROM mapping WHERE {_USABLE}) WHERE k <> '' GROUP BY side, k""",
    "mapping",
)
oracle("scan_mapping", "SELECT typ, opis, stara, nowa FROM mapping WHERE nowa IS NOT NULL", "mapping")
oracle(
    "filter_word_boxes",
    "SELECT doc_id, page, 0 AS block, 0 AS par, i + 1 AS line, word AS text, x0, y0, x1, y1 FROM o_words",
    "o_words",
)
oracle(
    "words_to_lines",
    "SELECT doc_id, page, 0 AS block, 0 AS par, i + 1 AS line, text, x0, y0, x1, y1 FROM o_text",
    "o_text",
)
oracle(
    "horizontal_only",
    "SELECT doc_id, page, 0 AS block, 0 AS par, i + 1 AS line, text FROM o_text WHERE (i + 1) % 5 <> 0",
    "o_text",
)
oracle(
    "lines_to_rows",
    """SELECT doc_id, page, row_no, string_agg(text, '' ORDER BY part_idx) AS text, count(*) AS n_parts,
        min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM o_rows GROUP BY doc_id, page, row_no""",
    "o_rows",
)
oracle(
    "span_geometry",
    f'SELECT {KEY}, start, "end", piece_no, x0, y0, x1, y1 FROM o_pieces',
    "o_pieces",
)
oracle("item_bounds", f'SELECT {KEY}, start, "end", type, x0, y0, x1, y1 FROM o_boxed', "o_boxed")
cte(
    "o_tall",
    """SELECT a.doc_id, a.page, r.row_no, a.x0, a.y0, a.x1, a.y1 + CASE WHEN (a.x0 + r.row_no) % 7 = 0 THEN 9 ELSE 0 END AS y1,
        row_number() OVER () AS n
    FROM o_words a JOIN o_rows r ON r.doc_id = a.doc_id AND r.page = a.page AND r.i = a.i""",
    "o_words", "o_rows",
)
oracle(
    "gap_to_next",
    """SELECT doc_id, page, row_no, x0, y0, x1, y1,
        greatest(CAST(0 AS DOUBLE), least(CAST(593 AS DOUBLE), coalesce(nxt - 2, CAST(593 AS DOUBLE))) - x1) AS gap
    FROM (SELECT a.*, min(b.x0) AS nxt FROM o_tall a LEFT JOIN o_tall b
        ON b.doc_id = a.doc_id AND b.page = a.page AND b.x0 > a.x1 - 1 AND b.y1 >= a.y0 + 1 AND b.y0 <= a.y1 - 1
        GROUP BY ALL)""",
    "o_tall",
)
cte(
    "shifted",
    """SELECT doc_id, page, item_id, x0, y0 - 6 * (len(value) % 3) AS y0, x1, y1 + 6 * (len(value) % 3) AS y1
    FROM o_boxed""",
    "o_boxed",
)
oracle(
    "overlap_pairs",
    """SELECT doc_id, page, item_a, item_b, common_area FROM (
        SELECT a.doc_id, a.page, a.item_id AS item_a, b.item_id AS item_b,
            (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common_area,
            least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS smaller
        FROM shifted a JOIN shifted b ON a.doc_id = b.doc_id AND a.page = b.page AND a.item_id < b.item_id
            AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
    WHERE common_area > CAST(0.35 AS DOUBLE) * smaller""",
    "shifted",
)

for _key, _kind in {
    "detect_date_ymd": "ymd",
    "detect_date_dmy": "dmy",
    "detect_date_dmonthy": "d-month-y",
    "detect_date_monthy": "month-y",
}.items():
    oracle(
        _key,
        f'SELECT {LINE}, s AS start, e AS "end", value, coalesce(y, 0) AS year, CAST(m AS INT) AS month, coalesce(d, 0) AS day '
        f"FROM c_cands WHERE kind = '{_kind}'",
        "c_cands",
    )
for _kind in ["account", "pesel", "nip", "postal", "money", "symbol", "percent", "phone", "number"]:
    oracle(
        f"detect_{_kind}",
        f'SELECT {LINE}, s AS start, e AS "end", value, type, label, score FROM c_cands WHERE kind = \'{_kind}\'',
        "c_cands",
    )
_SPAN = f'SELECT {LINE}, s AS start, e AS "end", value, kind'
oracle("reserve_groszy", f"{_SPAN} FROM c_cands WHERE kind = 'groszy'", "c_cands")
oracle("detect_dates", f"{_SPAN} FROM c_dates", "c_dates")
oracle("arbitrate", f"{_SPAN} FROM c_accepted", "c_accepted")
oracle(
    "month_lookup",
    "SELECT word, CAST(month AS INT) AS month, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^\\p{L}]+')) AS word "
    "FROM c_lines) JOIN (VALUES " + ", ".join(f"('{w}', {m})" for w, m in P.MONTH_NUMBER.items())
    + ") AS v(form, month) ON lower(word) = form GROUP BY word, month",
    "c_lines",
)
_PEOPLE = "type IN ('imię i nazwisko', 'nazwisko', 'nazwa')"
oracle("detect_names", f"SELECT {LINE}, {PLAIN} FROM c_items WHERE {_PEOPLE}", "c_items")

for _key, _weights, _mod in (("pesel_valid", P.PESEL_WEIGHTS, 10), ("nip_valid", P.NIP_WEIGHTS, 11)):
    oracle(
        _key,
        f"""SELECT {LINE}, number, CASE WHEN len(number) = {len(_weights) + 1} THEN {valid('number', _weights, _mod)}
            ELSE false END AS valid FROM (SELECT {LINE}, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM c_lines)""",
        "c_lines",
    )
oracle("digits_only", f"SELECT {LINE}, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM c_lines", "c_lines")
oracle(
    "classify_number",
    f"""SELECT {LINE}, s AS start, e AS "end", value, label, r.type AS type, r.score AS score FROM (
        SELECT *, {number_rules('low', 'value', 'digits')} AS r FROM c_cands WHERE kind IN ('percent', 'phone', 'number'))""",
    "c_cands",
)
oracle(
    "street_override",
    f"""SELECT {LINE}, s AS start, e AS "end", value, label, type, score FROM c_cands
    WHERE kind = 'number' AND type = 'ulica nr'""",
    "c_cands",
)
cte("c_word_spans", f"SELECT {KEY}, s, x AS e FROM c_capitals", "c_capitals")
cte("c_word_names", named("c_word_spans", "c_lines"), "c_word_spans", "c_lines")
_WORDS = f'SELECT {LINE}, s AS start, e AS "end", value, type, label, score FROM c_word_names'
oracle("classify_name", _WORDS, "c_word_names")
oracle(
    "drop_weak_name",
    f"{_WORDS} WHERE type <> 'nazwa' OR len(regexp_replace(value, '[^{P.CAPITALS}]', '', 'g')) >= 2",
    "c_word_names",
)
oracle("clean_label", f"SELECT {LINE}, {clean('text')} AS cleaned FROM c_lines", "c_lines")
oracle(
    "ocr_score_cap",
    f"""SELECT {LINE}, start, "end", type, least(score, CAST(0.6 AS DOUBLE)) AS score, 'ocr' AS source FROM c_items""",
    "c_items",
)
oracle(
    "date_score",
    f"""SELECT {LINE}, s AS start, kind, CAST(CASE WHEN kind IN ('ymd', 'dmy') THEN 0.95 ELSE 0.85 END AS DOUBLE) AS score
    FROM c_dates""",
    "c_dates",
)
oracle("date_value", f"SELECT {LINE}, s AS start, value, CAST(date_value AS VARCHAR) AS date_value FROM c_dates", "c_dates")
_DATE_KEY = """CASE WHEN date_value IS NOT NULL THEN 'd:' || CAST(date_value AS VARCHAR)
    WHEN y > 0 AND m > 0 THEN 'm:' || y || '-' || m WHEN y > 0 THEN 'y:' || y END"""
oracle("date_key", f"SELECT {LINE}, s AS start, value, {_DATE_KEY} AS date_key FROM c_dates", "c_dates")


def restyle(kind: str, value: str, new: str) -> str:
    two = lambda x: f"printf('%02d', {x})"
    y, m, d = f"year({new})", f"month({new})", f"day({new})"
    nom = "[" + ", ".join(f"'{w}'" for w in P.MONTHS_NOMINATIVE) + "]"
    gen = "[" + ", ".join(f"'{w}'" for w in P.MONTHS_GENITIVE) + "]"
    parts = f"string_split_regex({value}, '[./-]')"
    sep = f"substr({value}, len({parts}[1]) + 1, 1)"
    month_pad, day_pad = f"starts_with({parts}[2], '0')", f"starts_with({parts}[1], '0')"
    starts = " OR ".join(f"starts_with(lower({value}), '{w}')" for w in P.MONTHS_NOMINATIVE)
    suffix = (
        f"CASE WHEN regexp_matches({value}, 'r\\.{WS}*$') THEN ' r.' WHEN regexp_matches({value}, 'r{WS}*$') THEN ' r' ELSE '' END"
    )
    word = f"lower(regexp_extract({value}, '{_ALT}'))"
    return f"""CASE {kind}
        WHEN 'ymd' THEN {y} || {sep} || {two(m)} || {sep} || {two(d)}
        WHEN 'dmy' THEN CASE WHEN {day_pad} OR {month_pad} THEN {two(d)} ELSE {d}::VARCHAR END || {sep}
            || CASE WHEN {month_pad} THEN {two(m)} ELSE {m}::VARCHAR END || {sep}
            || CASE WHEN len({parts}[3]) = 2 THEN {two(f'{y} % 100')} ELSE {y}::VARCHAR END
        WHEN 'd-month-y' THEN {d} || ' ' || CASE WHEN list_contains({nom}, {word}) THEN {nom}[{m}] ELSE {gen}[{m}] END
            || ' ' || {y} || {suffix}
        ELSE CASE WHEN {starts} THEN {nom}[{m}] ELSE {gen}[{m}] END || ' ' || {y} END"""


oracle(
    "date_restyle",
    f"""SELECT {LINE}, start, value, {restyle('kind', 'value', 'new_date')} AS restyled FROM (
        SELECT *, s AS start, DATE '2027-11-05' + CAST(doc_id % 400 AS INT) AS new_date FROM c_dates)""",
    "c_dates",
)
oracle("type_group", f"SELECT item_id, type, {TYPE_GROUP} AS type_group FROM c_items", "c_items")
oracle("confidence_band", f"SELECT item_id, score, {BAND} AS band FROM c_items", "c_items")
oracle(
    "item_projection",
    f"""SELECT item_id AS id, doc_id, page, type, value, label, round_even(score, 2) AS score, source, {TYPE_GROUP} AS type_group,
        {BAND} AS band, CAST(round_even(x0, 2) AS DOUBLE) AS x0, CAST(round_even(y0, 2) AS DOUBLE) AS y0,
        CAST(round_even(x1, 2) AS DOUBLE) AS x1, CAST(round_even(y1, 2) AS DOUBLE) AS y1 FROM o_boxed""",
    "o_boxed",
)
oracle(
    "report_position",
    f"SELECT {KEY}, start, printf('%.1f;%.1f;%.1f;%.1f', x0, y0, x1, y1) AS pozycja FROM o_boxed",
    "o_boxed",
)
oracle("label_left", f"SELECT {LINE}, s AS start, left_label AS label FROM c_cands WHERE kind = 'number'", "c_cands")
oracle("label_for", f"SELECT {LINE}, s AS start, label FROM c_cands WHERE kind = 'number'", "c_cands")
oracle(
    "label_row_left",
    "SELECT doc_id, page, line_no AS row_no, part_idx, row_left AS label FROM o_lines",
    "o_lines",
)
oracle("label_above", f"SELECT {LINE}, above AS label FROM c_lines", "c_lines")
_ITEM = f'{KEY}, start, "end", type, value, label, score, source, item_id, CAST(date_value AS VARCHAR) AS date_value'
oracle("analyze", f"SELECT {_ITEM} FROM c_items", "c_items")
oracle("sort_items", f"SELECT {KEY}, {PLAIN} FROM c_items ORDER BY {KEY}, start", "c_items")
oracle(
    "union_pages",
    f"""SELECT {KEY}, start, "end", type, value, source, CAST(NULL AS DOUBLE) AS x0 FROM f_items
    UNION ALL SELECT {KEY}, start, "end", type, value, source, x0 FROM o_boxed""",
    "f_items", "o_boxed",
)
oracle(
    "dedup_ocr_items",
    f"""SELECT {KEY}, start, "end", type, value FROM o_boxed o WHERE NOT EXISTS (SELECT 1 FROM o_boxed t
        WHERE (t.start + t.line_no) % 2 = 0 AND t.doc_id = o.doc_id AND t.page = o.page
        AND round_even(t.x0 + 0.25, 0) = round_even(o.x0, 0) AND round_even(t.y0, 0) = round_even(o.y0, 0))""",
    "o_boxed",
)
oracle("distinct_types", "SELECT DISTINCT doc_id, type FROM c_items", "c_items")
oracle(
    "requires_types",
    "SELECT doc_id, count(DISTINCT type) FILTER (WHERE type IN ("
    + ", ".join(f"'{t}'" for t in REQUIRED) + f")) = {len(REQUIRED)} AS has_all FROM c_items GROUP BY doc_id",
    "c_items",
)
oracle("filter_by_group", f"SELECT {LINE}, {PLAIN} FROM c_items WHERE {TYPE_GROUP} IN ('osoby', 'kwota')", "c_items")
oracle(
    "filter_by_text",
    f"SELECT {LINE}, {PLAIN} FROM c_items WHERE contains(lower(value || ' ' || type || ' ' || label), 'kwiatowa')",
    "c_items",
)
oracle("filter_by_page", f"SELECT {LINE}, {PLAIN} FROM c_items WHERE page = 0", "c_items")

_NEW = "CASE type WHEN 'procent' THEN '' WHEN 'telefon' THEN value ELSE '[' || upper(type) || ']' END"
for _prefix in ("c", "f"):
    cte(f"{_prefix}_jobs", f"SELECT *, {_NEW} AS new_value FROM {_prefix}_items", f"{_prefix}_items")
_CHANGED = "new_value NOT IN ('', value)"
_REPORT = f"""SELECT item_id AS id, page + 1 AS strona, type AS typ, label AS opis_etykieta, value AS wartosc_oryginalna,
    new_value AS wartosc_nowa, CASE WHEN new_value = value THEN '' WHEN new_value = '' THEN 'pominieto (pusta wartość)'
    ELSE 'ok' END AS status, '' AS pozycja FROM c_jobs"""
for _key in ("join_reports", "write_report_csv", "write_report_json"):
    oracle(_key, _REPORT, "c_jobs")
oracle(
    "write_mapping",
    "SELECT type AS typ, label AS opis, value AS stara, new_value AS nowa FROM c_jobs WHERE new_value <> ''",
    "c_jobs",
)
oracle(
    "select_changes",
    f"""SELECT * FROM (SELECT {LINE}, start, type, value,
        CASE type WHEN 'NIP' THEN '' WHEN 'PESEL' THEN 'x' || value ELSE new_value END AS new_value FROM c_jobs)
    WHERE new_value NOT IN ('', value)""",
    "c_jobs",
)
for _prefix in ("c", "f"):
    cte(
        f"{_prefix}_matched",
        f"""SELECT * FROM (SELECT i.*,
            CASE WHEN l.ord IS NULL OR v.ord < l.ord THEN v.nowa ELSE l.nowa END AS new_value FROM {_prefix}_items i
            LEFT JOIN (SELECT * FROM first_entries WHERE side = 'l') l ON l.k = lower(trim(i.label))
            LEFT JOIN (SELECT * FROM first_entries WHERE side = 'v') v ON v.k = trim(i.value)) WHERE new_value IS NOT NULL""",
        f"{_prefix}_items", "first_entries",
    )
oracle("match_mapping", f"SELECT {LINE}, start, type, value, label, new_value FROM c_matched", "c_matched")
oracle(
    "date_variants",
    f"""SELECT doc_id, date_key, count(*) AS n_items, array_to_string(list_sort(list(DISTINCT value)), ' | ') AS spellings
    FROM (SELECT *, {_DATE_KEY} AS date_key FROM c_items WHERE type = 'data') GROUP BY doc_id, date_key""",
    "c_items",
)
oracle(
    "count_items",
    f"""SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_items, count(*) AS n_pages,
        count(*) FILTER (WHERE trim(coalesce(text, ''), {_SPACES}) = '') AS n_empty_pages
    FROM c_pages LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM c_items GROUP BY doc_id, page) USING (doc_id, page)
    GROUP BY doc_id""",
    "c_pages", "c_items",
)
oracle(
    "type_profile",
    f"SELECT type_group, type, CAST(count(*) AS BIGINT) AS n_items FROM (SELECT *, {TYPE_GROUP} AS type_group FROM c_items) "
    "GROUP BY ROLLUP (type_group, type)",
    "c_items",
)
oracle(
    "replacements_by_page",
    f"SELECT doc_id, page, count(*) AS n_jobs FROM c_jobs WHERE {_CHANGED} GROUP BY doc_id, page ORDER BY doc_id, page",
    "c_jobs",
)
oracle("count_changed", f"SELECT count(*) AS n_changed FROM c_jobs WHERE {_CHANGED}", "c_jobs")
oracle("count_ok", "SELECT count(*) AS n_ok FROM c_jobs WHERE new_value <> ''", "c_jobs")
oracle(
    "batch_summary",
    f"""SELECT doc_id, CASE WHEN bool_or(text IS NULL) THEN 'błąd: brak tekstu' ELSE 'ok' END AS status,
        CASE WHEN bool_or(text IS NULL) THEN 0 ELSE coalesce(any_value(n), 0) END AS n_replaced FROM c_pages
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM c_jobs WHERE new_value <> '' GROUP BY doc_id) USING (doc_id) GROUP BY doc_id
    UNION ALL SELECT {fx.DOC_RANGE * len(fx.SOURCES)} + n_nationkey,
        'błąd: ' || ['brak tekstu', 'niepoprawny UTF-8', 'strona za długa'][n_nationkey % 3 + 1], 0 FROM nation""",
    "c_pages", "c_jobs",
)
oracle(
    "replacement_report",
    """SELECT doc_id, item_id, type, value AS old, new_value AS new, page,
        CASE WHEN new_value = '' THEN 'pominieto (pusta wartość)' ELSE 'ok' END AS status FROM c_jobs""",
    "c_jobs",
)


def rewritten(prefix: str, jobs: str) -> str:
    """Pages of ``{prefix}`` with the jobs of a query ``(doc_id, page, line_no, start, end, new_value)`` written in."""
    return f"""SELECT doc_id, page, string_agg(new_text, chr(10) ORDER BY pos) AS text FROM (
        SELECT r.doc_id, r.page, r.pos, coalesce(j.new_text, r.text) AS new_text FROM {prefix}_raw r LEFT JOIN (
            SELECT doc_id, page, pos, string_agg(substr(text, prev + 1, start - prev) || new_value, '' ORDER BY start)
                || substr(any_value(text), max("end") + 1) AS new_text
            FROM (SELECT q.*, l.text, l.pos, coalesce(lag(q."end") OVER (PARTITION BY q.doc_id, q.page, q.line_no ORDER BY q.start), 0)
                AS prev FROM ({jobs}) q JOIN {prefix}_lines l USING (doc_id, page, line_no))
            GROUP BY doc_id, page, pos) j
        ON j.doc_id = r.doc_id AND j.page = r.page AND j.pos = r.pos) GROUP BY doc_id, page"""


_JOB = f'{LINE}, start, "end"'
oracle(
    "apply_replacements",
    rewritten("c", f"SELECT {_JOB}, new_value FROM c_jobs WHERE new_value <> ''"),
    "c_raw", "c_lines", "c_jobs",
)
_TOKEN = f"'<' || sha256('{SALT}' || '|' || type || '|' || value) || '>'"
oracle(
    "mask_items",
    rewritten("c", f"SELECT {_JOB}, {_TOKEN} AS new_value FROM c_items"),
    "c_raw", "c_lines", "c_items",
)
_DRAWN = f"CAST('0x' || substr(sha256('{SALT}' || '|' || doc_id), 1, 8) AS BIGINT)"
_MOVED = f"CASE WHEN date_value IS NULL THEN '[DATA]' ELSE {restyle('kind', 'value', 'new_date')} END"
oracle(
    "shift_dates",
    rewritten(
        "c",
        f"SELECT {_JOB}, {_MOVED} AS new_value FROM (SELECT *, date_value + CAST({_DRAWN} % 365 + 1 AS INT) AS new_date "
        "FROM c_items WHERE type = 'data')",
    ),
    "c_raw", "c_lines", "c_items",
)
oracle(
    "batch_apply",
    rewritten("c", f"SELECT {_JOB}, new_value FROM c_matched"),
    "c_raw", "c_lines", "c_matched",
)
oracle(
    "batch_apply_report",
    "SELECT doc_id, item_id, type, value AS old, new_value AS new, page, 'ok' AS status FROM c_matched",
    "c_matched",
)
oracle(
    "batch_apply_summary",
    """SELECT doc_id, CASE WHEN bool_or(text IS NULL) THEN 'błąd: brak tekstu' ELSE 'ok' END AS status,
        CASE WHEN bool_or(text IS NULL) THEN 0 ELSE coalesce(any_value(n), 0) END AS n_replaced FROM c_pages
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM c_matched GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""",
    "c_pages", "c_matched",
)
# A label or value takes its new value from the first item that has it.
oracle(
    "mapping_round_trip",
    """SELECT doc_id, CASE WHEN bad THEN 'błąd: brak tekstu' ELSE 'ok' END AS status, CASE WHEN bad THEN 0 ELSE coalesce(n, 0) END
        AS n_replaced FROM (SELECT doc_id, bool_or(text IS NULL) AS bad FROM c_pages GROUP BY doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM c_items
        WHERE lower(trim(label)) IN (SELECT lower(trim(label)) FROM c_jobs WHERE new_value <> '' AND trim(label) <> '')
        OR trim(value) IN (SELECT trim(value) FROM c_jobs WHERE new_value <> '') GROUP BY doc_id) USING (doc_id)""",
    "c_pages", "c_items", "c_jobs",
)
cte("r_pages", rewritten("c", f"SELECT {_JOB}, new_value FROM c_matched"), "c_raw", "c_lines", "c_matched")
oracle(
    "verify_replacement",
    """SELECT doc_id, coalesce(n_values, 0) AS n_values, coalesce(n_left, 0) AS n_left, coalesce(n_missing, 0) AS n_missing,
        coalesce(n_found, 0) AS n_found FROM (SELECT DISTINCT doc_id FROM r_pages)
    LEFT JOIN (SELECT doc_id, count(*) AS n_values, count(*) FILTER (there) AS n_left, count(*) FILTER (NOT arrived) AS n_missing
        FROM (SELECT doc_id, value, new_value, bool_or(contains(text, value)) AS there, bool_or(contains(text, new_value)) AS arrived
            FROM (SELECT DISTINCT doc_id, value, new_value FROM c_matched) JOIN r_pages USING (doc_id) GROUP BY ALL)
        GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_found FROM r_items
        SEMI JOIN (SELECT DISTINCT doc_id, value FROM c_matched) USING (doc_id, value) GROUP BY doc_id) USING (doc_id)""",
    "r_pages", "r_items", "c_matched",
)
oracle(
    "stream_analyze",
    f"SELECT {_ITEM} FROM c_items WHERE doc_id < {_R['forms']} OR doc_id >= {_R['benchmark']}",
    "c_items",
)
