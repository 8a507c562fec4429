"""Form-like inputs derived from the given tables.

The given documents hold few identifiers, so labelled forms are derived from ``orders``: one form of twelve lines
per order, one page of unlabelled values per order, and the form's words as positioned boxes. The expressions are
plain SQL that Spark and DuckDB both run, so the same text can be checked on both sides. ``k`` is the order key,
``c`` the customer key, ``d`` the order date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import patterns as P
from velum.sources.sinks import written
from velum.sources.tables import scan_documents

FIRST_NAMES = "Anna Jan Katarzyna Piotr Zofia Łukasz Ewa Żaneta"
SURNAMES = "Nowak Kowalski Zielińska Wiśniewski Ćwik Lewandowska-Zych Śliwa Wójcik"

# Documents of the several tables are told apart by the range of their numbers.
DOC_RANGE = 1_000_000_000_000
SOURCES = ["documents", "pages", "conversations", "forms", "bare", "benchmark"]
FIRST_DOC = {name: i * DOC_RANGE for i, name in enumerate(SOURCES)}

BOX_DPI = 144
PAGE_WIDTH = 595.0


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _pad(x: str, n: int) -> str:
    return f"lpad({_text(x)}, {n}, '0')"


def _pick(words: list[str] | str, i: str) -> str:
    words = words if isinstance(words, str) else " ".join(words)
    return f"split_part('{words}', ' ', CAST({i} AS INT))"


def _whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def _check_sum(digits: str, weights) -> str:
    return "(" + " + ".join(f"CAST(substr({digits}, {i}, 1) AS INT) * {w}" for i, w in enumerate(weights, 1)) + ")"


_YEAR, _MONTH, _DAY = "year(d)", "month(d)", "day(d)"
_NIP9 = _text("100000000 + (c * 7654321) % 900000000")
_PESEL10 = _text("1000000000 + (c * 123456789) % 9000000000")
_NIP_SUM = f"({_check_sum(_NIP9, P.NIP_WEIGHTS)} % 11)"
_PESEL_CHECK = f"((10 - {_check_sum(_PESEL10, P.PESEL_WEIGHTS)} % 10) % 10)"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_AMOUNT = (
    f"concat({_text(_whole(f'{_CENTS} / 100000'))}, ' ', {_pad(f'{_whole(f'{_CENTS} / 100')} % 1000', 3)}, ',', "
    f"{_pad(f'{_CENTS} % 100', 2)})"
)
_DMY = f"concat({_pad(_DAY, 2)}, '.', {_pad(_MONTH, 2)}, '.', {_text(_YEAR)})"

FORM_LINES = [
    f"concat('Nr: FV/', {_text(_YEAR)}, '/', {_pad(_MONTH, 2)}, '/', {_text('k')})",
    f"concat('Data wystawienia: ', {_DMY})",
    f"concat('Data sprzedaży: ', {_text(_DAY)}, ' ', {_pick(P.MONTHS_GENITIVE, _MONTH)}, ' ', {_text(_YEAR)}, ' r.')",
    f"concat('Wygenerowano: ', {_text(_YEAR)}, '-', {_pad(_MONTH, 2)}, '-', {_pad(_DAY, 2)})",
    f"concat('Klient: ', {_pick(FIRST_NAMES, 'c % 8 + 1')}, ' ', {_pick(SURNAMES, f'{_whole('c / 8')} % 8 + 1')})",
    f"concat('ul. Kwiatowa ', {_text('100 + k % 900')})",
    f"concat({_pad('k % 100', 2)}, '-', {_pad('(k * 13) % 1000', 3)}, ' Warszawa')",
    f"concat('NIP: ', {_NIP9}, {_text(f'{_NIP_SUM} % 10')})",
    f"concat('PESEL: ', {_PESEL10}, {_text(_PESEL_CHECK)})",
    f"concat('Telefon: +48 ', {_text('600 + k % 300')}, ' ', {_pad('(k * 7) % 1000', 3)}, ' ', {_pad('c % 1000', 3)})",
    f"concat('Numer konta: ', {_pad('k % 97', 2)}, ' 1090 1014 0000 0712 ', {_pad('k % 10000', 4)}, ' ', "
    f"{_pad('(k * 7) % 10000', 4)})",
    f"concat('Do zapłaty: ', {_AMOUNT}, ' zł, w tym VAT 23%')",
]
BARE_LINES = [
    f"concat('x ', {_PESEL10}, {_text(f'({_PESEL_CHECK} + k % 2) % 10')})",
    f"concat('x ', {_NIP9}, {_text(f'({_NIP_SUM} + k % 2) % 10')})",
    f"concat('okres ', {_pick(P.MONTHS_NOMINATIVE, _MONTH)}, ' ', {_text(_YEAR)})",
    f"concat('słownie: sto złotych ', {_pad('k % 100', 2)}, '/100')",
    f"concat('run ', {_text('1000000000000000 + k * 7919')}, ' end')",
    "'   '",
    f"concat('Dostawa ', {_text(_DAY)}, '.', {_text(_MONTH)}, '.', {_pad(f'{_YEAR} % 100', 2)}, ' oraz ', {_pad(_DAY, 2)}, "
    f"'/', {_pad(_MONTH, 2)}, '/', {_text(_YEAR)}, '; Anna Nowak-Kowalska  Jan Maria Rokita Kraków')",
    f"concat('Kod A', {_text('k % 10')}, '-B', {_text('k % 7')}, '/X rabat ', {_text('k % 50')}, ',5 % Imię: Ewa')",
    f"concat('Faktura nr ', {_text('k')}, '/', {_text(_YEAR)}, ', tel. 22 ', {_pad('k % 1000', 3)}, ' ', "
    f"{_pad('c % 100', 2)} , ' 17, kwota 1 250,00 PLN')",
    f"concat('Stan na 31.02.2024 lub 15.13.2024, ', {_text(_DAY)}, ' ', upper({_pick(P.MONTHS_GENITIVE, _MONTH)}), "
    f"' bez roku, Maja ', {_text(_YEAR)}, ', 3 Maja')",
]


def _page_sql(lines: list[str], kind: str, join: str) -> str:
    return (
        f"SELECT {FIRST_DOC[kind]} + k AS doc_id, CAST(k % 2 AS INT) AS page, {join.format(', '.join(lines))} AS text "
        "FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_totalprice FROM orders)"
    )


SPARK_JOIN = "array_join(array({}), '\\n')"
DUCKDB_JOIN = "array_to_string([{}], chr(10))"


def forms_sql(join: str) -> str:
    return _page_sql(FORM_LINES, "forms", join)


def bare_sql(join: str) -> str:
    return _page_sql(BARE_LINES, "bare", join)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files per core that the orders are dealt into.
DEALT = 4


def dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``orders`` that pages are derived from, written as several files for each core.

    A row of a few bytes becomes a page of twelve lines, and a file of one row group is read by one task however many
    orders it holds: without this, all forms would be made and analysed by one core.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return written(orders.repartition(DEALT * spark.sparkContext.defaultParallelism), "orders")


def _derived(orders: DataFrame, sql: str) -> DataFrame:
    return orders.sparkSession.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(dealt_orders(spark, sf_dir), forms_sql(SPARK_JOIN))


def bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(dealt_orders(spark, sf_dir), bare_sql(SPARK_JOIN))


#: Table, number, text and page columns of the text tables.
TEXT_TABLES = {
    "documents": ("doc_id", "text", None),
    "pages": ("page_id", "html", None),
    "conversations": ("conv_id", "text", "turn"),
    "benchmark": ("item_id", "text", None),
}


def numbered(pages: DataFrame, kind: str) -> DataFrame:
    return pages.withColumn("doc_id", F.col("doc_id") + FIRST_DOC[kind])


def given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text column of the given tables as pages."""
    read = [
        numbered(scan_documents(spark, f"{sf_dir}/{name}.parquet", *columns), name)
        for name, columns in TEXT_TABLES.items()
    ]
    return reduce(DataFrame.unionByName, read)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given pages, forms and unlabelled values together."""
    orders = dealt_orders(spark, sf_dir)
    derived = [_derived(orders, make(SPARK_JOIN)) for make in (forms_sql, bare_sql)]
    return reduce(DataFrame.unionByName, derived, given_pages(spark, sf_dir))


def form_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every form as recognised boxes in pixels, in two columns of six lines.

    Lines 1–6 stand at x = 40, lines 7–12 at x = 320 beside them, up to two points lower. A character is six points
    wide. Some words have a confidence below the limit.
    """
    lines = forms(spark, sf_dir).select(
        "doc_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "text")
    )
    words = lines.select(
        "doc_id",
        "page",
        "i",
        F.posexplode(F.split("text", " ")).alias("w", "word"),
        F.expr("split(text, ' ')").alias("ws"),
    )
    k = F.col("doc_id") - FIRST_DOC["forms"]
    offset = F.expr("length(array_join(slice(ws, 1, w), ' ')) + IF(w > 0, 1, 0)")
    scale = BOX_DPI / P.POINTS_PER_INCH
    right = F.col("i") >= 6
    return words.select(
        "doc_id",
        "page",
        F.lit(0).alias("block"),
        F.lit(0).alias("par"),
        (F.col("i") + 1).alias("line"),
        (30 + (k * 7 + F.col("w")) % 70).cast("int").alias("conf"),
        F.col("word").alias("text"),
        ((F.when(right, 320).otherwise(40) + 6 * offset) * scale).cast("double").alias("left"),
        ((14 * (F.col("i") % 6 + 1) + F.when(right, (k + F.col("i")) % 3).otherwise(0)) * scale)
        .cast("double")
        .alias("top"),
        (F.length("word") * 6 * scale).cast("double").alias("width"),
        F.lit(10 * scale).cast("double").alias("height"),
    )
