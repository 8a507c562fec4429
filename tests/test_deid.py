"""Mappings, rewriting, masking, leak check, batch and stream."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velum.operators import deid, match, profile
from velum.operators.lines import analyze
from velum.sources import sinks, tables
from velum.streaming.stream import stream_analyze, stream_documents

# Fixed golden values: a document and its seven changes.
INVOICE = """\
Nr: FV/2024/01/15

Data wystawienia: 15.01.2024
Data sprzedaży: 15 stycznia 2024 r.
Sprzedawca:
Jan Kowalski
PESEL: 85010112345
   
Do zapłaty: 7 921,20 zł
Numer konta: 61 1090 1014 0000 0712 1981 2874
"""
CHANGES = {
    "Jan Kowalski": "Piotr Zadrożny-Lewandowski",
    "15.01.2024": "10.03.2026",
    "15 stycznia 2024 r.": "10 marca 2026 r.",
    "85010112345": "92050567890",
    "7 921,20 zł": "15 999,99 zł",
    "61 1090 1014 0000 0712 1981 2874": "75 2490 0005 0000 4600 7430 1234",
    "FV/2024/01/15": "FV/2026/03/99-A",
}
MAPPING = "ord long, typ string, opis string, stara string, nowa string"


def test_seven_changes_on_an_invoice(spark, pages, tmp_path):
    source = pages(INVOICE, "nic tu nie ma", None)
    mapping = spark.createDataFrame([(i, "", "", o, n) for i, (o, n) in enumerate(CHANGES.items())], MAPPING)
    rewritten, replacements, summary = deid.batch_apply(source, mapping, str(tmp_path / "jobs"))
    expected = INVOICE
    for old, new in CHANGES.items():
        expected = expected.replace(old, new)
    assert {r.doc_id: r.text for r in rewritten.collect()} == {0: expected, 1: "nic tu nie ma", 2: None}
    assert {r.status for r in replacements.collect()} == {"ok"}
    assert sorted((r.doc_id, r.status, r.n_replaced) for r in summary.collect()) == [
        (0, "ok", 7), (1, "ok", 0), (2, "błąd: brak tekstu", 0),
    ]
    check = deid.verify_replacement(rewritten, match.match_mapping(analyze(source), mapping)).collect()
    assert sorted(tuple(r) for r in check) == [(0, 7, 0, 0, 0), (1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def test_leaks_are_found_anywhere_in_the_document(spark):
    """A value left on another page counts as left, one that the detector finds again as found, a lost one as missing."""
    schema = "doc_id long, page int, text string"
    before = spark.createDataFrame([(1, 0, "NIP 5260001246"), (1, 1, "NIP 5260001246"), (2, 0, "x")], schema)
    mapping = spark.createDataFrame([(0, "", "", "5260001246", "[NIP]")], MAPPING)
    jobs = match.match_mapping(analyze(before), mapping).filter("page = 0")
    got = deid.verify_replacement(deid.apply_replacements(before, jobs), jobs).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 0, 1), (2, 0, 0, 0, 0)]
    lost = before.withColumn("text", F.lit("nothing"))
    assert tuple(deid.verify_replacement(lost, jobs).orderBy("doc_id").first()) == (1, 1, 0, 1, 0)


@pytest.mark.parametrize("direct", [10_000, 20, 0])
def test_values_are_found_by_anchors_as_directly(spark, direct):
    """A document that owns most pages and values, values shorter than an anchor, values inside others, null texts."""
    rows = [(1, i, f"A{i} NIP 526{i:04d}|ż{i % 7} " * 3) for i in range(60)] + [(2, 0, "abc"), (2, 1, None), (3, 0, ""), (None, 0, "abc")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string").withColumn("row", F.monotonically_increasing_id())
    wanted = [(1, f"526{i:04d}|") for i in range(0, 90, 2)] + [(1, v) for v in ("ż6", "ż7", "A", "zz", "NIP 5260003|ż", "NIP 526000x")]
    wanted += [(2, "abc"), (2, "abcd"), (2, "c"), (3, "abc"), (4, "abc")]
    values = spark.createDataFrame(wanted, "doc_id long, value string")
    expected = {(d, v) for d, v in wanted if any(d == e and v in (t or "") for e, _, t in rows)}
    got = [tuple(r) for r in deid.contained(pages.select("row", "doc_id", "text"), values, direct).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_failing_pages_do_not_hold_up_the_others(spark, tmp_path):
    """No text, bytes that are no UTF-8 and a page that is too long, in one run with a good document."""
    texts = "doc_id % 4 WHEN 0 THEN 'NIP 5260001246' WHEN 1 THEN CAST(unhex('61C328') AS STRING) WHEN 2 THEN repeat('NIP ', 9) END"
    pages = spark.range(4).selectExpr("id AS doc_id", "0 AS page").selectExpr("*", f"CASE {texts} AS text")
    checked = deid.checked_pages(pages, 20)
    mapping = spark.createDataFrame([(0, "", "", "5260001246", "[NIP]")], MAPPING)
    jobs = match.match_mapping(analyze(checked.drop("error")), mapping)
    got = deid.batch_summary(checked, match.replacement_report(jobs)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [
        (0, "ok", 1), (1, "błąd: niepoprawny UTF-8", 0), (2, "błąd: strona za długa", 0), (3, "błąd: brak tekstu", 0),
    ]
    rewritten, _, summary = deid.batch_apply(pages, mapping, str(tmp_path / "jobs"))
    assert {r.doc_id: r.text for r in rewritten.collect()} == {0: "NIP [NIP]", 1: None, 2: "NIP " * 9, 3: None}
    assert {r.doc_id: r.status[:4] for r in summary.collect()} == {0: "ok", 1: "błąd", 2: "ok", 3: "błąd"}


def test_a_redelivered_document_is_analysed_once(spark, pages, tmp_path):
    """The same file twice, before and after a restart; a page with another text is new."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first, changed = pages("NIP 5260001246", "PESEL: 85010112345", None), pages("NIP 5260001246 w dniu 15.01.2024")
    for delivery in ([first, first], [first, changed]):
        for part in delivery:
            part.coalesce(1).write.mode("append").parquet(source)
        stream = stream_documents(spark, source, "doc_id long, page int, text string", page="page", arrival=True)
        stream_analyze(stream, out, checkpoint, "7 days").awaitTermination()
    expected = analyze(first.unionByName(changed)).select("item_id", "type", "value").collect()
    assert sorted(spark.read.parquet(out).select("item_id", "type", "value").collect()) == sorted(expected)


def test_a_written_mapping_replaces_what_it_was_made_from(spark, pages, tmp_path):
    """Of two new values for one label the first in reading order wins, after writing and reading back."""
    source = pages("PESEL: 44051401359\nNIP 5260001246", "PESEL: 85010112345", "bez danych")
    items = analyze(source).withColumn("new_value", F.concat(F.lit("<"), "doc_id", F.lit(":"), "type", F.lit(">")))
    sinks.write_mapping(items.repartition(5), str(tmp_path / "mapping"))
    mapping = tables.scan_mapping_lines(spark, str(tmp_path / "mapping"))
    rewritten, audit, _ = deid.batch_apply(source, mapping, str(tmp_path / "jobs"))
    assert {r.doc_id: r.text for r in rewritten.collect()} == {
        0: "PESEL: <0:PESEL>\nNIP <0:NIP>", 1: "PESEL: <0:PESEL>", 2: "bez danych",
    }
    assert audit.count() == 3


def test_a_mapping_without_order_is_refused(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"stara": "a", "nowa": "b"}')
    with pytest.raises(Exception, match="no ord"):
        tables.scan_mapping_lines(spark, str(tmp_path / "m.json")).collect()


def test_a_frequent_label_is_split(spark):
    """Shuffled by force, the label of nearly all items is dealt to several tasks; unlabelled items are spread."""
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(40_000).selectExpr(
            "concat('i', id) AS item_id", "CASE id % 50 WHEN 0 THEN '' WHEN 1 THEN concat('l', id) ELSE 'PESEL' END AS label",
            "concat('v', id) AS value", "repeat(sha2(cast(id AS string), 256), 2) AS more",
        )
        mapping = spark.createDataFrame([(0, "", "pesel", "", "new"), (1, "", "", "v0", "zero")], MAPPING)
        matched = match.match_mapping(items.repartition(4), mapping)
        assert len(matched.collect()) == 38_401
        assert "skew=true" in matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_first_entry_wins(spark, pages):
    items = analyze(pages("PESEL: 44051401359", "NIP 5260001246", "PESEL 85010112345"))
    mapping = spark.createDataFrame(
        [
            (0, "", "pesel", "", ""),
            (1, "", "pesel", "", None),
            (2, "", "x", "44051401359", "by value"),
            (3, "", " PeSeL ", "", "by label"),
            (4, "", "", " 5260001246 ", " trimmed "),
            (5, "", "nip", "", "late"),
        ],
        MAPPING,
    )
    got = {r.value: r.new_value for r in match.match_mapping(items, mapping).collect()}
    assert got == {"44051401359": "by value", "85010112345": "by label", "5260001246": "trimmed"}


def test_no_jobs_changes_nothing(pages):
    source = pages(INVOICE, "\n\n a \n", "")
    jobs = analyze(source).withColumn("new_value", F.lit(""))
    before = {r.doc_id: r.text for r in source.collect()}
    assert {r.doc_id: r.text for r in deid.apply_replacements(source, jobs).collect()} == before


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["", " ", "ab cd", "łżć😀x", "1 2 3 4"]), max_size=6), min_size=1, max_size=5), st.randoms())
def test_rewriting_against_slices(spark, docs, random):
    """Edits at random places of random lines, against slicing in Python."""
    rows, jobs, expected = [], [], {}
    for d, lines in enumerate(docs):
        rows.append((d, 0, "\n".join(lines)))
        new_lines, line_no = [], 0
        for line in lines:
            if line.strip():
                cut = sorted(random.sample(range(len(line) + 1), 4))
                edits = [(cut[0], cut[1], "<A>"), (cut[2], cut[3], "<B>")]
                jobs += [(d, 0, line_no, s, e, n) for s, e, n in edits]
                for s, e, n in reversed(edits):
                    line = line[:s] + n + line[e:]
                line_no += 1
            new_lines.append(line)
        expected[d] = "\n".join(new_lines)
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    edits = spark.createDataFrame(jobs, "doc_id long, page int, line_no int, start int, end int, new_value string")
    assert {r.doc_id: r.text for r in deid.apply_replacements(pages, edits).collect()} == expected


@pytest.mark.parametrize("style", ["type", "stars", "token"])
def test_masking_leaves_no_value(pages, style):
    source = pages(INVOICE)
    masked = deid.mask_items(source, style, "s")
    text, old = masked.first().text, [r.value for r in analyze(source).collect()]
    assert old and not any(v in text for v in old)
    assert len(text.split("\n")) == len(INVOICE.split("\n"))
    audit = deid.audit_rows(masked)
    assert {r.item_id for r in audit.collect()} == {r.item_id for r in analyze(source).collect()}
    again = {r.value for r in analyze(masked.select("doc_id", "page", "text")).collect()}
    assert not again & set(old)


def test_shifted_dates_keep_style_and_distance(pages):
    source = pages("Od 1.02.2024 do 2024-02-11; 3 marca 2024 r., luty 2024, PESEL 44051401359")
    shifted = deid.shift_dates(source, "s", 30)
    rows = [r.date.date for r in analyze(shifted.select("doc_id", "page", "text")).filter("type = 'data'").orderBy("start").collect()]
    assert len(rows) == 3
    assert (rows[1] - rows[0]).days == 10 and (rows[2] - rows[1]).days == 21
    text = shifted.first().text
    assert "[DATA]" in text and "44051401359" in text and text.count(" r.") == 1


def test_reports(spark, pages, tmp_path):
    items = analyze(pages('Klient: Jan "Nowak" Kowalski; 12%\nNIP 5260001246')).withColumn(
        "new_value", F.when(F.col("type") == "NIP", "x;\"y\"").otherwise("")
    )
    report = match.join_reports(items, match.replacement_report(items))
    sinks.write_report_csv(report, str(tmp_path / "csv"))
    back = spark.read.options(sep=";", header=True, escape='"').csv(str(tmp_path / "csv"))
    assert {(r.typ, r.wartosc_nowa, r.status) for r in back.collect()} >= {("NIP", 'x;"y"', "ok")}
    sinks.write_report_json(report, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == items.count()
    sinks.write_mapping(items, str(tmp_path / "mapping"))
    assert [r.stara for r in spark.read.json(str(tmp_path / "mapping")).collect()] == ["5260001246"]


def test_mapping_file(spark, tmp_path):
    """Array order is kept, a byte order mark is tolerated, numbers become text, unusable entries are left out."""
    entries = [{"stara": 1, "nowa": 2.5}, "x", {"stara": "a"}, None, {"typ": "t", "opis": "o", "stara": "b", "nowa": "c"}]
    path = tmp_path / "m.json"
    path.write_text(json.dumps(entries), encoding="utf-8-sig")
    got = [tuple(r) for r in tables.scan_mapping(spark, str(path)).orderBy("ord").collect()]
    assert got == [(0, "", "", "1", "2.5"), (4, "t", "o", "b", "c")]


def test_mapping_files_are_read_by_name(spark, pages, tmp_path):
    """The first file by name wins, also where a later one is larger and is read first."""
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps([{"stara": "44051401359", "nowa": "first"}]), encoding="utf-8")
    more = [{"stara": "44051401359", "nowa": "second"}] + [{"stara": f"x{i}", "nowa": "y" * 50} for i in range(500)]
    (folder / "2.json").write_text(json.dumps(more), encoding="utf-8")
    mapping = tables.scan_mapping(spark, str(folder))
    assert [r.nowa for r in mapping.orderBy("ord").limit(2).collect()] == ["first", "second"]
    assert mapping.select("ord").distinct().count() == 502
    found = match.match_mapping(analyze(pages("PESEL: 44051401359")), mapping)
    assert found.first().new_value == "first"


def test_file_set(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    got = {(r.path.split("/")[-1], r.length) for r in tables.scan_file_set(spark, str(tmp_path)).collect()}
    assert got == {("a.pdf", 5), ("b.PDF", 5)}


def test_stream_equals_batch(spark, pages, tmp_path):
    """Two arrivals with a restart between them give what one batch gives; a third start adds nothing."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first, second = pages(INVOICE, "Klient: Ewa Nowak"), pages("a", "b", "NIP 5260001246").filter("doc_id = 2")
    for batch in (first, second, None):
        if batch is not None:
            batch.select("doc_id", "text").coalesce(1).write.mode("append").parquet(source)
        stream = stream_documents(spark, source, "doc_id long, text string")
        stream_analyze(stream, out, checkpoint).awaitTermination()
    expected = analyze(first.unionByName(second))
    assert sorted(spark.read.parquet(out).collect()) == sorted(expected.collect())


def test_profiles(pages):
    items = analyze(pages(INVOICE, "15.01.2024 i 2024-01-15"))
    variants = {(r.doc_id, r.date_key): r.n_items for r in profile.date_variants(items).collect()}
    assert variants == {(0, "d:2024-01-15"): 2, (1, "d:2024-01-15"): 2}
    has = {r.doc_id: r.has_all for r in profile.requires_types(items, ["data", "PESEL"]).collect()}
    assert has == {0: True, 1: False}
    assert profile.filter_by_group(items, []).count() == items.count() == profile.filter_by_text(items, " ").count()
    assert {r.type for r in profile.filter_by_group(items, ["osoby"]).collect()} == {"imię i nazwisko"}
    total = profile.type_profile(items).filter("type_group IS NULL").first().n_items
    assert total == items.count()
