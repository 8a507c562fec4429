"""Reading documents, file listings, mappings and word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from velum.functions import patterns as P
from velum.functions.sqlx import quoted

MAPPING_ENTRY = "struct<typ:string,opis:string,stara:string,nowa:string>"
MAPPING_SCHEMA = "ord bigint, typ string, opis string, stara string, nowa string"


def scan_documents(
    spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", page: str | None = None
) -> DataFrame:
    """A parquet table as pages ``(doc_id, page, text)``; only the named columns are read.

    Pages without text come along: :func:`with_text` and :func:`empty_documents` tell them apart.
    """
    number = F.col(page).cast("int") if page else F.lit(0)
    return spark.read.parquet(path).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), number.alias("page"), F.col(text).alias("text")
    )


def _has_text():
    return F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))


def with_text(pages: DataFrame) -> DataFrame:
    return pages.filter(_has_text())


def empty_documents(pages: DataFrame) -> DataFrame:
    """Pages whose text is blank: the ones to send to text recognition."""
    return pages.filter(~_has_text()).select("doc_id", "page")


def scan_file_set(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """Inventory of a folder: path, length and modification time. File contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def scan_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping files, each a JSON array of objects, as ``(ord, typ, opis, stara, nowa)``.

    ``ord`` follows the files by name and each array by place, whatever order Spark reads the files in. Entries that are
    no objects, or lack ``stara`` or ``nowa``, are left out. A byte order mark is tolerated. A file is one document and is
    read by one task: this is the form people keep by hand. A large mapping is a folder of such files, or JSON Lines, see
    :func:`scan_mapping_lines`.
    """
    body = F.regexp_replace("value", "^\\uFEFF", "")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), body.alias("body"))
    # One row per file: numbering them by name is a small job of one task.
    numbered = files.select("file").withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)
    return (
        files.join(numbered, "file")
        .select("file_no", F.posexplode(F.from_json("body", "array<string>")).alias("place", "entry"))
        .select(
            (F.col("file_no").cast("bigint") * 2**31 + F.col("place")).alias("ord"), F.from_json("entry", MAPPING_ENTRY).alias("e")
        )
        .filter("e.stara IS NOT NULL AND e.nowa IS NOT NULL")
        .select("ord", *_mapping_columns("e."))
    )


def scan_mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """A mapping written by :func:`velum.sources.sinks.write_mapping`, in JSON Lines: splittable, any size.

    An entry without ``ord`` is an error: without an order no entry is the first, and nothing would be replaced.
    """
    order = F.coalesce("ord", F.raise_error(F.lit("a mapping entry has no ord")).cast("bigint")).alias("ord")
    return (
        spark.read.schema(MAPPING_SCHEMA)
        .json(path)
        .filter("stara IS NOT NULL AND nowa IS NOT NULL")
        .select(order, *_mapping_columns(""))
    )


def _mapping_columns(prefix: str):
    return [
        F.coalesce(F.col(f"{prefix}typ"), F.lit("")).alias("typ"),
        F.coalesce(F.col(f"{prefix}opis"), F.lit("")).alias("opis"),
        F.col(f"{prefix}stara").alias("stara"),
        F.col(f"{prefix}nowa").alias("nowa"),
    ]


def filter_word_boxes(boxes: DataFrame, dpi: float = P.DEFAULT_DPI) -> DataFrame:
    """Recognised words with text and enough confidence, their pixel boxes turned into points."""
    scale = F.lit(P.POINTS_PER_INCH / dpi)
    return (
        boxes.withColumn("text", F.expr(f"trim(BOTH {quoted(P.SPACES)} FROM text)"))
        .filter((F.col("text") != "") & (F.col("conf") >= P.MIN_WORD_CONFIDENCE))
        .select(
            "doc_id",
            "page",
            "block",
            "par",
            "line",
            "text",
            (F.col("left") * scale).alias("x0"),
            (F.col("top") * scale).alias("y0"),
            (F.col("left") * scale + F.col("width") * scale).alias("x1"),
            (F.col("top") * scale + F.col("height") * scale).alias("y1"),
        )
    )

