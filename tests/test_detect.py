"""Golden cases and properties of the detector on plain text."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from velum.functions import checks, dates, findings, spans
from velum.operators.deid import mask_items
from velum.operators.lines import analyze, explode_lines

CONTRACT = """\
zawarta w dniu 20 stycznia 2024 r. w Warszawie
Zleceniodawca: Marek Wiśniewski
NIP: 5556667777, REGON: 123456789
Zleceniobiorca: Katarzyna Zielińska
zamieszkałą: ul. Lipowa 8/2, 31-002 Kraków
PESEL: 92050567890, dowód osobisty: ABC 123456

Cena zlecenia: 4 200,00 zł brutto (słownie: cztery tysiące dwieście złotych 00/100).
Pozostałe 3 200,00 zł — płatność do 2024-02-10.
Kontakt telefoniczny: 602 345 678, e-mail: mw-service@example.pl"""


def found(items):
    return {(r.type, r.value): r for r in items.collect()}


def test_contract(pages):
    items = found(analyze(pages(CONTRACT)))
    assert set(items) == {
        ("data", "20 stycznia 2024 r."),
        ("imię i nazwisko", "Marek Wiśniewski"),
        ("NIP", "5556667777"),
        ("REGON", "123456789"),
        ("imię i nazwisko", "Katarzyna Zielińska"),
        ("kod pocztowy", "31-002"),
        ("PESEL", "92050567890"),
        ("numer", "123456"),
        ("kwota", "4 200,00 zł"),
        ("kwota", "3 200,00 zł"),
        ("data", "2024-02-10"),
        ("telefon", "602 345 678"),
    }
    assert items["REGON", "123456789"].label == "NIP: 5556667777, REGON"
    assert items["PESEL", "92050567890"].label == "PESEL"
    assert items["kwota", "4 200,00 zł"].score == 0.9
    assert items["data", "2024-02-10"].date.date == dt.date(2024, 2, 10)


@pytest.mark.parametrize(
    "text, hit, kind, new, restyled",
    [
        ("płatność do 15.03.2026 zgodnie z umową", "15.03.2026", "dmy", "2027-11-05", "05.11.2027"),
        ("z dnia 3 kwietnia 2026 r.", "3 kwietnia 2026 r.", "d-month-y", "2027-01-28", "28 stycznia 2027 r."),
        ("okres 2026-02-10", "2026-02-10", "ymd", "2025-12-31", "2025-12-31"),
        ("za miesiąc luty 2024", "luty 2024", "month-y", "2024-05-01", "maj 2024"),
        ("data: 5.1.26", "5.1.26", "dmy", "2027-12-09", "9.12.27"),
        ("dnia 15.11.2024", "15.11.2024", "dmy", "2027-03-05", "5.3.2027"),
        ("od 2 May 2024", "2 May 2024", "d-month-y", "2025-08-01", "1 sierpnia 2025"),
        ("w maja 2024", "maja 2024", "month-y", "2025-08-01", "sierpień 2025"),
    ],
)
def test_dates(pages, text, hit, kind, new, restyled):
    spans = pages(text).select(F.explode(F.expr(findings.date_spans("text"))).alias("s"), "text")
    row = spans.select("s.k", F.expr("substring(text, s.s + 1, s.e - s.s)").alias("value")).collect()
    assert [(r.k, r.value) for r in row] == [(kind, hit)]
    again = pages(text).select(F.expr(dates.restyled(f"'{kind}'", f"'{hit}'", f"DATE'{new}'")).alias("x"))
    assert again.first().x == restyled


def test_date_edges(pages):
    """A day is 1–31, month 00 stays, the 30th of February is a date without a calendar day, digits may be foreign."""
    items = analyze(pages("a 32.01.2024 b 30.02.2024 c 15.00.2024 d 15.13.2024 e ١٥.01.2024"))
    rows = {r.value: r.date for r in items.filter("type = 'data'").collect()}
    assert set(rows) == {"30.02.2024", "15.00.2024", "١٥.01.2024"}
    assert rows["30.02.2024"].date is None and rows["15.00.2024"].month == 0
    assert rows["١٥.01.2024"].date == dt.date(2024, 1, 15)


@pytest.mark.parametrize(
    "number, check, valid",
    [
        ("44051401359", checks.pesel_valid, True),
        ("44051401358", checks.pesel_valid, False),
        ("4405140135", checks.pesel_valid, False),
        ("5260001246", checks.nip_valid, True),
        ("5260001247", checks.nip_valid, False),
        ("526000124x", checks.nip_valid, False),
    ],
)
def test_check_digits(spark, number, check, valid):
    assert spark.range(1).select(F.expr(check(f"'{number}'")).alias("v")).first().v is valid


def test_checksum_or_label_keeps_a_number(pages):
    items = found(analyze(pages("x 44051401359", "x 44051401358", "PESEL 44051401358")))
    assert ("PESEL", "44051401359") in items and ("PESEL", "44051401358") in items
    assert ("numer", "44051401358") in items


def test_amount_in_words_reserves_its_text(pages):
    """``75/100`` is no finding, nor are its digits, also when the line holds a date."""
    items = found(analyze(pages("słownie: sto 75/100, dnia 12.05.2024, 175/100")))
    assert set(items) == {("data", "12.05.2024"), ("numer", "175"), ("numer", "100")}


def test_names(pages):
    """A name takes up to two more words; stop words and words before a colon do not start one."""
    items = found(
        analyze(
            pages(
                "był Jan Maria Rokita Kraków Nowy",
                "Faktura dla Ewy, Adres: Anna Nowak",
                "tu Anna-Maria i Ola",
                "pacjent Ola",
                "3 Maja Ulica",
            )
        ).filter("type IN ('imię i nazwisko', 'nazwisko', 'nazwa')")
    )
    assert set(items) == {
        ("imię i nazwisko", "Jan Maria Rokita"),
        ("imię i nazwisko", "Kraków Nowy"),
        ("imię i nazwisko", "Anna Nowak"),
        ("nazwa", "Anna-Maria"),
        ("imię i nazwisko", "Ola"),
    }


def test_label_above_and_street(pages):
    items = found(analyze(pages("ul. Kwiatowa 105\n\n00-001 Warszawa", "a b c d e f\nrazem =\n120,50")))
    assert items["kod pocztowy", "00-001"].label == "ul. Kwiatowa 105"
    assert (items["ulica nr", "105"].score, items["kod pocztowy", "00-001"].score) == (0.25, 0.95)
    assert items["kwota?", "120,50"].label == "razem "


def test_spans_and_values_agree(pages):
    """Accepted spans of a line never overlap, and a value is the text at its span, also after an emoji."""
    source = pages(CONTRACT, "😀 NIP 5260001246 tel. +48 601 234 567; 😀 1 250,00 PLN 12% AB-12/X 5 maja 2024 r.")
    rows = analyze(source).join(explode_lines(source), ["doc_id", "page", "line_no"]).collect()
    assert rows
    by_line = {}
    for r in rows:
        assert r.text[r.start : r.end] == r.value
        by_line.setdefault((r.doc_id, r.line_no), []).append((r.start, r.end))
    for spans in by_line.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_mark_character_in_text(pages):
    text = "PESEL: 44051401359"
    row = analyze(pages(text)).filter("type = 'PESEL'").first()
    assert text[row.start : row.end] == row.value == "44051401359"


def test_long_line(pages):
    """A line with thousands of matches: every one is found, at its place."""
    n = 3000
    text = " ".join(f"nr {100000 + i}" for i in range(n))
    rows = analyze(pages(text)).select("start", "end", "value").collect()
    assert len(rows) == n
    assert all(text[r.start : r.end] == r.value for r in rows)


SCRAPS = [
    "do zapłaty", "do  zapłaty", "Imię", "imię:", "Nazwisko", "Jan", "Maria", "Nowak-Kowalska", "ul. Lipowa", "ul ", "al. ", ";",
    "; ", "  ", "\t", " - ", "–", ":", "44051401359", "44051401358", "5260001247", "PESEL", "NIP", "REGON: 123456789",
    "12.05.2024", "5 maja 2024 r.", "1 250,00 zł", "12,5 %", "75/100", "00-001", "FV/2024/12", "nr", "tel. +48 601 234 567",
    "1234", "12", "a", "ab", "konto", "kod", "klient", "=", "İ", "ΑΣ", "😀", "faktura", "zł", "\x1c", "lekarz",
]


def test_the_index_reads_labels_as_cutting_them_out_does(pages, monkeypatch):
    """Long lines judge labels by an index and claim text by a sweep; every line gives the same findings either way."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(SCRAPS) + rng.choice([" ", "", "  ", "; ", ": "]) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    texts.append("".join(rng.choice(SCRAPS) + " " for _ in range(1500)))
    columns = ["doc_id", "start", "end", "type", "value", "label", "score"]
    rows = lambda: sorted(map(tuple, analyze(pages(*texts)).select(*columns).collect()))
    short = rows()
    monkeypatch.setattr(findings, "SHORT", -1)
    monkeypatch.setattr(findings, "FEW_PAIRS", -1)
    monkeypatch.setattr(spans, "FEW_PAIRS", -1)
    assert rows() == short and len(short) > 2_000


def test_masking_grows_with_the_line(pages):
    """Sixteen thousand findings of one line cost about four times as much as four thousand."""

    def seconds(n: int) -> float:
        source = pages(" ".join(f"nr {100000 + i}" for i in range(n)))
        start = time.time()
        assert len(mask_items(source).first().changes) == n
        return time.time() - start

    seconds(100)
    few = min(seconds(4_000) for _ in range(2))
    assert seconds(16_000) < 8 * few + 2


def test_blank_and_null_pages(pages):
    assert analyze(pages("", "  \n\t\n", None)).count() == 0


def test_gates_let_every_match_through(spark):
    """A line that a detector finds something in passes the test on its row, also with digits of other scripts."""
    from velum.functions import findings as fn

    lines = [
        "98/100", "2024-01-15 a 15.01.24", "٣ maja 2024", "3 maja  2024 r.", "luty 2024", "61109010140000071219812874",
        "61 1090 1014 0000 0712 1981 2874", "85010112345 5260001246", "00-001", "1 250,00zł 12.50€", "FV/2024/01", "AB-C",
        "12,5 %", "7%", "+48 601-234-567", "601 234 567", "1 234", "1,23", "12.3", "١٢٣", "1 234 567,8", "brak", "a 1 b 2",
    ]
    rows = spark.createDataFrame([(t,) for t in lines], "text string")
    for kind in fn.PATTERNS:
        found = F.expr(f"size({fn.candidates('text', kind)}) > 0")
        if kind == "number":
            found = F.expr(f"size({fn.kept_candidates('text', ['number'], 'NULL', 'NULL')}) > 0")
        got = rows.select("text", found.alias("found"), F.expr(fn.may_match("text", [kind])).alias("passed")).collect()
        assert any(r.found for r in got), kind
        assert [r.text for r in got if r.found and not r.passed] == [], kind


def test_single_detectors_test_lines_before_labels(spark):
    """Lines without a match are dropped where pages become lines, before labels and spans are made."""
    from velum.plans.catalog import CATALOG

    for name in ("detect_date_monthy", "detect_pesel", "date_value", "reserve_groszy", "label_for"):
        plan = CATALOG[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" in plan and "'above'" not in plan and ", above," not in plan.partition("named_struct(line_no")[2][:200], name
