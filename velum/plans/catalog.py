"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import checks, classify, dates, labels
from velum.functions import findings as fn
from velum.functions.spans import searchable, value_at
from velum.functions.sqlx import let
from velum.operators import deid, layout, match, profile
from velum.operators.lines import analyze, analyze_lines, context_lines, explode_lines
from velum.plans import fixtures as fx
from velum.sources import sinks, tables
from velum.streaming.stream import stream_analyze, stream_documents

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

LINE = ["doc_id", "page", "line_no"]
SALT = "sól"
MAX_CHARS = 5_000_000
REQUIRED = ["data", "PESEL", "NIP", "nr konta"]


def query(name: str):
    def register(make: Query) -> Query:
        CATALOG[name] = make
        return make

    return register


# ---- inputs ------------------------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.corpus(spark, sf_dir)


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_lines(corpus(spark, sf_dir))


def corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(corpus(spark, sf_dir))


def form_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(forms(spark, sf_dir))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.forms(spark, sf_dir)


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.filter_word_boxes(fx.form_boxes(spark, sf_dir), fx.BOX_DPI)


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_to_lines(word_boxes(spark, sf_dir))


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_to_rows(box_lines(spark, sf_dir), [F.col("line_key")])


def box_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.analyze_rows(layout.context_rows(box_rows(spark, sf_dir)))


def form_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping derived from ``customer``: by label, by value, both at once, and without a usable new value."""
    customers = fx.table(spark, sf_dir, "customer")
    return spark.sql(FORM_MAPPING.replace("FROM customer", "FROM {customer}"), customer=customers)


FORM_MAPPING = f"""
SELECT CAST(c AS BIGINT) * 4 AS ord, 'NIP' AS typ, 'konto klienta' AS opis,
       concat({fx._NIP9}, {fx._text(f'{fx._NIP_SUM} % 10')}) AS stara, concat('NIP-', {fx._text('c')}) AS nowa
FROM (SELECT c_custkey AS c FROM customer)
UNION ALL
SELECT CAST(c AS BIGINT) * 4 + 1, 'PESEL', CASE WHEN c % 2 = 0 THEN ' PeSeL ' ELSE 'inne' END, '',
       concat('P-', {fx._text('c')})
FROM (SELECT c_custkey AS c FROM customer)
UNION ALL
SELECT CAST(c AS BIGINT) * 4 + 2, 'kwota', 'do zapłaty', '', CASE WHEN c % 2 = 0 THEN '' ELSE NULL END
FROM (SELECT c_custkey AS c FROM customer)
UNION ALL
SELECT CAST(c AS BIGINT) * 4 + 3, 'procent', CASE WHEN c = 0 THEN 'Wygenerowano' ELSE 'brak' END, ' 23% ', ' 8% '
FROM (SELECT c_custkey AS c FROM customer)
"""


def mask_jobs(items: DataFrame) -> DataFrame:
    """Items with a new value by rule: masked, except percentages (emptied) and phone numbers (kept)."""
    return items.withColumn(
        "new_value",
        F.expr("CASE type WHEN 'procent' THEN '' WHEN 'telefon' THEN value ELSE concat('[', upper(type), ']') END"),
    )


def flat(items: DataFrame) -> DataFrame:
    """Items with the date as text, null where there is none, in place of the nested one."""
    return items.withColumn("date_value", F.col("date.date").cast("string")).drop("date")


# ---- sources and sinks -------------------------------------------------------------------------------


@query("scan_documents")
def _(spark, sf_dir):
    return tables.with_text(fx.given_pages(spark, sf_dir)).select("doc_id", "page", F.length("text").cast("bigint").alias("n_chars"))


@query("empty_documents")
def _(spark, sf_dir):
    """Every second page of all text tables made blank."""
    halves = F.when((F.col("doc_id") + F.col("page")) % 2 == 0, F.col("text")).otherwise(" \n\t ")
    return tables.empty_documents(fx.given_pages(spark, sf_dir).withColumn("text", halves))


@query("explode_lines")
def _(spark, sf_dir):
    return explode_lines(corpus(spark, sf_dir))


@query("scan_mapping")
def _(spark, sf_dir):
    """JSON arrays, one file for each thousand customers."""
    path = sinks.shared_path(spark, "mapping")
    entry = F.to_json(F.struct("typ", "opis", "stara", "nowa"), {"ignoreNullFields": "false"})
    arrays = (
        form_mapping(spark, sf_dir)
        .groupBy(F.expr("ord div 4000").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry")))).alias("entries"))
        .select("part", F.expr("concat('[', array_join(entries.entry, ',\n'), ']')").alias("value"))
    )
    arrays.write.partitionBy("part").text(path)
    return tables.scan_mapping(spark, f"{path}/*").drop("ord")


@query("filter_word_boxes")
def _(spark, sf_dir):
    return word_boxes(spark, sf_dir)


def _report(spark, sf_dir):
    jobs = sinks.written(mask_jobs(corpus_items(spark, sf_dir)), "report-jobs")
    return match.join_reports(jobs, match.replacement_report(jobs.filter("new_value <> value")))


@query("write_report_csv")
def _(spark, sf_dir):
    path, report = sinks.shared_path(spark, "report-csv"), _report(spark, sf_dir)
    sinks.write_report_csv(report, path)
    return (
        spark.read.schema(report.schema)
        .options(sep=";", header=True, escape='"', emptyValue="", nullValue="\u0000")
        .csv(path)
        .withColumn("status", F.coalesce("status", F.lit("")))
    )


@query("write_report_json")
def _(spark, sf_dir):
    path, report = sinks.shared_path(spark, "report-json"), _report(spark, sf_dir)
    sinks.write_report_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query("write_mapping")
def _(spark, sf_dir):
    """Written and read back as the mapping it is."""
    path = sinks.shared_path(spark, "mapping-out")
    sinks.write_mapping(mask_jobs(corpus_items(spark, sf_dir)), path)
    return tables.scan_mapping_lines(spark, path).drop("ord")


# ---- layout ------------------------------------------------------------------------------------------


@query("words_to_lines")
def _(spark, sf_dir):
    return box_lines(spark, sf_dir).select("doc_id", "page", "line_key.*", "text", *layout.BOX)


@query("lines_to_rows")
def _(spark, sf_dir):
    return layout.row_texts(box_rows(spark, sf_dir))


@query("horizontal_only")
def _(spark, sf_dir):
    lines = box_lines(spark, sf_dir).withColumn("dir_horizontal", F.col("line_key.line") % 5 != 0)
    return layout.horizontal_only(lines).select("doc_id", "page", "line_key.*", "text")


@query("span_geometry")
def _(spark, sf_dir):
    lines = layout.context_rows(box_rows(spark, sf_dir)).withColumn("line_no", F.col("row_no"))
    pieces = layout.span_geometry(analyze_lines(lines, keep=["spans"]))
    return pieces.select(
        *LINE, "part_idx", "start", "end", F.posexplode("pieces").alias("piece_no", "p")
    ).select(*LINE, "part_idx", "start", "end", "piece_no", "p.*")


@query("item_bounds")
def _(spark, sf_dir):
    return box_items(spark, sf_dir).select(*LINE, "part_idx", "start", "end", "type", *layout.BOX)


@query("gap_to_next")
def _(spark, sf_dir):
    """Every seventh word is made tall, so that it stands beside words of the row below."""
    words = box_rows(spark, sf_dir).select(*layout.ROW, F.explode("spans").alias("s")).select(*layout.ROW, "s.*")
    tall = F.when((F.col("x0") + F.col("row_no")) % 7 == 0, F.col("y1") + 9).otherwise(F.col("y1"))
    return layout.gap_to_next(words.drop("start", "end").withColumn("y1", tall), fx.PAGE_WIDTH)


@query("overlap_pairs")
def _(spark, sf_dir):
    kind_size = F.length("value") % 3
    shifted = sinks.written(box_items(spark, sf_dir), "boxed-items").select(
        "doc_id",
        "page",
        F.col("item_id"),
        F.col("x0"),
        (F.col("y0") - 6 * kind_size).alias("y0"),
        F.col("x1"),
        (F.col("y1") + 6 * kind_size).alias("y1"),
    )
    return layout.overlap_pairs(shifted)


# ---- detectors ---------------------------------------------------------------------------------------


def detected(lines: DataFrame, kinds: list[str]) -> DataFrame:
    """Matches of single detectors that pass their own tests, described but not yet weighed against each other."""

    def spans(text: str, row_left: str, above: str, shape: str) -> dict[str, str]:
        return {"_spans": fn.kept_candidates(text, kinds, row_left, above, shape)}

    return fn.describe(lines.filter(fn.may_match("text", kinds)), LINE, spans)


def _date_detector(name: str, kind: str):
    @query(name)
    def _(spark, sf_dir):
        return corpus_dates(spark, sf_dir, [kind]).selectExpr(*LINE, *_DATE)


def _detector(name: str, kinds: list[str], columns: list[str]):
    @query(name)
    def _(spark, sf_dir):
        return detected(corpus_lines(spark, sf_dir), kinds).selectExpr(*LINE, *columns)


_PLAIN = ["start", "end", "value", "type", "label", "score"]
_DATE = ["start", "end", "value", "coalesce(date.year, 0) AS year", "date.month AS month", "coalesce(date.day, 0) AS day"]
for _name, _kind in {
    "detect_date_ymd": "ymd",
    "detect_date_dmy": "dmy",
    "detect_date_dmonthy": "d-month-y",
    "detect_date_monthy": "month-y",
}.items():
    _date_detector(_name, _kind)
for _kind in ["account", "pesel", "nip", "postal", "money", "symbol", "percent", "phone", "number"]:
    _detector(f"detect_{_kind}", [_kind], _PLAIN)


def _span_rows(lines: DataFrame, spans: str) -> DataFrame:
    text = searchable("text")
    found = f"transform({let(text, lambda t: spans.replace('{t}', t))}, s -> named_struct('k', s.k, 's', s.s, 'e', s.e, 'value', {value_at('text', 's')}))"
    return lines.select(*LINE, F.explode(F.expr(found)).alias("f")).select(
        *LINE,
        F.col("f.s").alias("start"),
        F.col("f.e").alias("end"),
        "f.value",
        F.col("f.k").alias("kind"),
    )


@query("reserve_groszy")
def _(spark, sf_dir):
    return _span_rows(lines_for(spark, sf_dir, ["groszy"]), fn.candidates("{t}", "groszy"))


def lines_for(spark, sf_dir, kinds):
    """Lines of the corpus in which some detectors may match."""
    return explode_lines(corpus(spark, sf_dir)).filter(fn.may_match("text", kinds))


def corpus_dates(spark, sf_dir, kinds=None):
    """All dates of the corpus with their parts, spellings settled against each other, or only those of some spellings."""
    spans = fn.kept_candidates("{t}", kinds, "NULL", "NULL") if kinds else fn.date_spans("{t}")
    rows = _span_rows(lines_for(spark, sf_dir, kinds or list(fn.DATE_PATTERNS)), spans)
    return dates.with_date(rows, "kind", "value", "date")


@query("detect_dates")
def _(spark, sf_dir):
    return corpus_dates(spark, sf_dir).drop("date")


@query("month_lookup")
def _(spark, sf_dir):
    words = F.explode(F.split("text", r"(?U)[^\p{L}]+")).alias("word")
    number = F.expr(dates.month_lookup("word"))
    lines = explode_lines(corpus(spark, sf_dir)).select("doc_id", words).withColumn("month", number)
    return lines.filter("month IS NOT NULL").groupBy("word", "month").agg(F.count("*").alias("n"))


@query("detect_names")
def _(spark, sf_dir):
    return corpus_items(spark, sf_dir).filter("type IN ('imię i nazwisko', 'nazwisko', 'nazwa')").select(*LINE, *_PLAIN)


# ---- scalar functions --------------------------------------------------------------------------------


def _digit_runs(spark, sf_dir) -> DataFrame:
    """Every run of digits in the corpus, with the number of its line."""
    runs = F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("number")
    return explode_lines(corpus(spark, sf_dir)).select(*LINE, runs)


@query("pesel_valid")
def _(spark, sf_dir):
    return _digit_runs(spark, sf_dir).withColumn("valid", F.expr(checks.pesel_valid("number")))


@query("nip_valid")
def _(spark, sf_dir):
    return _digit_runs(spark, sf_dir).withColumn("valid", F.expr(checks.nip_valid("number")))


@query("digits_only")
def _(spark, sf_dir):
    return explode_lines(corpus(spark, sf_dir)).select(*LINE, F.expr(checks.digits_only("text")).alias("digits"))


@query("classify_number")
def _(spark, sf_dir):
    rows = detected(corpus_lines(spark, sf_dir), ["percent", "phone", "number"])
    found = F.expr(classify.classify_number("low", "value", "digits"))
    rows = rows.withColumn("low", F.lower("label")).withColumn("digits", F.expr(checks.plain_digits("value")))
    return rows.withColumn("c", found).select(*LINE, "start", "end", "value", "label", "c.*")


@query("street_override")
def _(spark, sf_dir):
    rows = detected(corpus_lines(spark, sf_dir), ["number"]).filter("type = 'ulica nr'")
    return rows.select(*LINE, "start", "end", "value", "label", "type", "score")


def corpus_words(spark, sf_dir):
    """Every capitalised word that could start a name, extended as far as it goes, with its type and label."""
    text = let(searchable("text"), fn.name_words)
    label = labels.label_for("lft", "row_left", "above")
    return (
        corpus_lines(spark, sf_dir)
        .select(*LINE, "text", "row_left", "above", F.explode(F.expr(text)).alias("w"))
        .selectExpr(
            *LINE, "w.s AS start", "w.x AS end", "substring(text, w.s + 1, w.x - w.s) AS value",
            "substring(text, 1, w.s) AS lft", "row_left", "above",
        )
        .withColumn("label_here", F.expr(label))
        .withColumn("low", F.lower("label_here"))
        .withColumn("left_low", F.lower("lft"))
        .withColumn("c", F.expr(classify.classify_name("lft", "left_low", "value", "label_here", "low")))
        .select(*LINE, "start", "end", "value", "c.*")
    )


@query("classify_name")
def _(spark, sf_dir):
    return corpus_words(spark, sf_dir)


@query("drop_weak_name")
def _(spark, sf_dir):
    return corpus_words(spark, sf_dir).filter(F.expr(f"type <> 'nazwa' OR {classify.strong_name('value')}"))


@query("clean_label")
def _(spark, sf_dir):
    return explode_lines(corpus(spark, sf_dir)).select(*LINE, F.expr(labels.clean_label("text")).alias("cleaned"))


@query("ocr_score_cap")
def _(spark, sf_dir):
    lines = corpus_lines(spark, sf_dir).withColumn("source", F.lit("ocr"))
    return analyze_lines(lines).select(*LINE, "start", "end", "type", "score", "source")


@query("date_score")
def _(spark, sf_dir):
    rows = corpus_dates(spark, sf_dir).withColumn("score", F.expr(classify.date_score("kind")))
    return rows.select(*LINE, "start", "kind", "score")


@query("date_value")
def _(spark, sf_dir):
    day = F.col("date.date").cast("string").alias("date_value")
    return corpus_dates(spark, sf_dir).select(*LINE, "start", "value", day)


@query("date_key")
def _(spark, sf_dir):
    key = F.expr(dates.date_key("date")).alias("date_key")
    return corpus_dates(spark, sf_dir).select(*LINE, "start", "value", key)


@query("date_restyle")
def _(spark, sf_dir):
    new = F.expr("date_add(DATE'2027-11-05', CAST(doc_id % 400 AS INT))")
    rows = corpus_dates(spark, sf_dir).withColumn("new_date", new)
    return rows.select(*LINE, "start", "value", F.expr(dates.restyled("kind", "value", "new_date")).alias("restyled"))


@query("type_group")
def _(spark, sf_dir):
    return corpus_items(spark, sf_dir).select("item_id", "type", F.expr(classify.type_group("type")).alias("type_group"))


@query("confidence_band")
def _(spark, sf_dir):
    return corpus_items(spark, sf_dir).select("item_id", "score", F.expr(classify.confidence_band("score")).alias("band"))


@query("item_projection")
def _(spark, sf_dir):
    return profile.item_projection(box_items(spark, sf_dir))


@query("report_position")
def _(spark, sf_dir):
    position = F.expr(match.report_position("x0", "y0", "x1", "y1")).alias("pozycja")
    return box_items(spark, sf_dir).select(*LINE, "part_idx", "start", position)


# ---- labels ------------------------------------------------------------------------------------------


def corpus_numbers(spark, sf_dir):
    text = let(searchable("text"), lambda t: fn.kept_candidates(t, ["number"], "row_left", "above"))
    lines = corpus_lines(spark, sf_dir).filter(fn.may_match("text", ["number"]))
    rows = lines.select(*LINE, "text", "row_left", "above", F.explode(F.expr(text)).alias("s"))
    return rows.selectExpr(*LINE, "s.s AS start", "substring(text, 1, s.s) AS lft", "row_left", "above")


@query("label_left")
def _(spark, sf_dir):
    return corpus_numbers(spark, sf_dir).select(*LINE, "start", F.expr(labels.label_left("lft")).alias("label"))


@query("label_row_left")
def _(spark, sf_dir):
    rows = layout.context_rows(box_rows(spark, sf_dir))
    return rows.select("doc_id", "page", "row_no", "part_idx", F.col("row_left").alias("label"))


@query("label_above")
def _(spark, sf_dir):
    return corpus_lines(spark, sf_dir).select(*LINE, F.col("above").alias("label"))


@query("label_for")
def _(spark, sf_dir):
    label = F.expr(labels.label_for("lft", "row_left", "above")).alias("label")
    return corpus_numbers(spark, sf_dir).select(*LINE, "start", label)


# ---- arbitration and the whole detector --------------------------------------------------------------


@query("arbitrate")
def _(spark, sf_dir):
    rows = fn.with_steps(corpus_lines(spark, sf_dir), last="_taken").select(
        *LINE, F.explode(F.expr("filter(_taken, s -> s.e > s.s)")).alias("s")
    )
    return rows.selectExpr(*LINE, "s.s AS start", "s.e AS end", "s.v AS value", "s.k AS kind")


@query("analyze")
def _(spark, sf_dir):
    return flat(corpus_items(spark, sf_dir))


@query("sort_items")
def _(spark, sf_dir):
    return profile.sort_items(corpus_items(spark, sf_dir)).select(*LINE, "part_idx", *_PLAIN)


@query("union_pages")
def _(spark, sf_dir):
    both = layout.union_pages(form_items(spark, sf_dir), box_items(spark, sf_dir))
    return both.select(*LINE, "part_idx", "start", "end", "type", "value", "source", "x0")


def _shifted_text_items(items: DataFrame) -> DataFrame:
    """Text findings placed where every second recognised one stands."""
    return items.filter("(start + line_no) % 2 = 0").withColumn("x0", F.col("x0") + 0.25)


@query("dedup_ocr_items")
def _(spark, sf_dir):
    items = sinks.written(box_items(spark, sf_dir), "boxed-items")
    kept = layout.dedup_ocr_items(items, _shifted_text_items(items))
    return kept.select(*LINE, "part_idx", "start", "end", "type", "value")


@query("distinct_types")
def _(spark, sf_dir):
    return profile.distinct_types(corpus_items(spark, sf_dir))


@query("requires_types")
def _(spark, sf_dir):
    return profile.requires_types(corpus_items(spark, sf_dir), REQUIRED)


# ---- filters -----------------------------------------------------------------------------------------


@query("filter_by_group")
def _(spark, sf_dir):
    return profile.filter_by_group(corpus_items(spark, sf_dir), ["osoby", "kwota"]).select(*LINE, *_PLAIN)


@query("filter_by_text")
def _(spark, sf_dir):
    return profile.filter_by_text(corpus_items(spark, sf_dir), " KWIATOWA ").select(*LINE, *_PLAIN)


@query("filter_by_page")
def _(spark, sf_dir):
    return profile.filter_by_page(corpus_items(spark, sf_dir), 0).select(*LINE, *_PLAIN)


@query("select_changes")
def _(spark, sf_dir):
    jobs = sinks.written(mask_jobs(corpus_items(spark, sf_dir)), "stored-changes")
    values = jobs.filter("type IN ('NIP', 'PESEL')").select(
        "item_id", F.expr("IF(type = 'NIP', '', concat('x', value))").alias("new_value")
    )
    return match.select_changes(jobs, values).select(*LINE, "start", "type", "value", "new_value")


# ---- joins -------------------------------------------------------------------------------------------


def mapped_jobs(spark, sf_dir):
    return match.match_mapping(corpus_items(spark, sf_dir), form_mapping(spark, sf_dir))


@query("match_mapping")
def _(spark, sf_dir):
    return mapped_jobs(spark, sf_dir).select(*LINE, "start", "type", "value", "label", "new_value")


@query("join_reports")
def _(spark, sf_dir):
    return _report(spark, sf_dir)


@query("date_variants")
def _(spark, sf_dir):
    return profile.date_variants(corpus_items(spark, sf_dir))


# ---- aggregations ------------------------------------------------------------------------------------


@query("count_items")
def _(spark, sf_dir):
    return deid.count_items(corpus(spark, sf_dir))


@query("type_profile")
def _(spark, sf_dir):
    return profile.type_profile(corpus_items(spark, sf_dir))


@query("replacements_by_page")
def _(spark, sf_dir):
    return profile.replacements_by_page(mask_jobs(corpus_items(spark, sf_dir)).filter("new_value NOT IN ('', value)"))


@query("count_changed")
def _(spark, sf_dir):
    return profile.count_changed(mask_jobs(corpus_items(spark, sf_dir)).filter("new_value NOT IN ('', value)"))


@query("count_ok")
def _(spark, sf_dir):
    return profile.count_ok(match.replacement_report(mask_jobs(corpus_items(spark, sf_dir))))


def failing_pages(spark, sf_dir):
    """Pages that cannot be processed, one per nation, of three kinds, with numbers after all others."""
    nations = fx.table(spark, sf_dir, "nation")
    kinds = "element_at(array(NULL, CAST(unhex('61C328') AS STRING), repeat('x', {0} + 1)), n_nationkey % 3 + 1)".format(MAX_CHARS)
    first = fx.DOC_RANGE * len(fx.SOURCES)
    return nations.select((F.col("n_nationkey") + F.lit(first)).alias("doc_id"), F.lit(0).alias("page"), F.expr(kinds).alias("text"))


@query("batch_summary")
def _(spark, sf_dir):
    """The whole corpus, and pages that fail beside it."""
    pages = deid.checked_pages(corpus(spark, sf_dir).unionByName(failing_pages(spark, sf_dir)), MAX_CHARS)
    return deid.batch_summary(pages, match.replacement_report(mask_jobs(analyze(pages.drop("error")))))


# ---- de-identification -------------------------------------------------------------------------------


@query("apply_replacements")
def _(spark, sf_dir):
    pages = corpus(spark, sf_dir)
    return deid.apply_replacements(pages, mask_jobs(analyze(pages)))


@query("replacement_report")
def _(spark, sf_dir):
    return match.replacement_report(mask_jobs(corpus_items(spark, sf_dir)))


@query("mask_items")
def _(spark, sf_dir):
    return deid.mask_items(corpus(spark, sf_dir), "token", SALT).drop("changes")


@query("shift_dates")
def _(spark, sf_dir):
    return deid.shift_dates(corpus(spark, sf_dir), SALT).drop("changes")


def _batch(spark, sf_dir):
    jobs_path = sinks.shared_path(spark, "batch-jobs")
    return deid.batch_apply(corpus(spark, sf_dir), form_mapping(spark, sf_dir), jobs_path)


@query("batch_apply")
def _(spark, sf_dir):
    return _batch(spark, sf_dir)[0]


@query("batch_apply_report")
def _(spark, sf_dir):
    return _batch(spark, sf_dir)[1]


@query("batch_apply_summary")
def _(spark, sf_dir):
    return _batch(spark, sf_dir)[2]


@query("mapping_round_trip")
def _(spark, sf_dir):
    """A mapping exported from changed items, read back and applied to the documents it came from."""
    path, jobs_path = sinks.shared_path(spark, "mapping-out"), sinks.shared_path(spark, "batch-jobs")
    pages = corpus(spark, sf_dir)
    sinks.write_mapping(mask_jobs(analyze(pages)), path)
    return deid.batch_apply(pages, tables.scan_mapping_lines(spark, path), jobs_path)[2]


@query("verify_replacement")
def _(spark, sf_dir):
    jobs = sinks.written(mapped_jobs(spark, sf_dir), "matched-jobs")
    return deid.verify_replacement(deid.apply_replacements(corpus(spark, sf_dir), jobs), jobs)


# ---- stream ------------------------------------------------------------------------------------------


@query("stream_analyze")
def _(spark, sf_dir):
    """The text tables as streams of arriving pages."""
    out, checkpoint = sinks.shared_path(spark, "stream-items"), sinks.shared_path(spark, "stream-checkpoint")
    arriving = []
    for name, columns in fx.TEXT_TABLES.items():
        source = f"{sf_dir}/{name}*.parquet"
        schema = spark.read.parquet(source).schema
        arriving.append(fx.numbered(stream_documents(spark, source, schema, *columns), name))
    stream_analyze(reduce(DataFrame.unionByName, arriving), out, checkpoint).awaitTermination()
    return flat(spark.read.parquet(out))
