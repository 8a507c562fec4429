"""Pages of text to lines, and lines to findings, without a shuffle.

A page is one row, so a line's neighbours are at hand as array elements: no window is needed to look at the
rows above, and nothing has to be grouped back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions import findings as fn
from velum.functions.labels import offered_above
from velum.functions.patterns import ROWS_ABOVE
from velum.functions.sqlx import let

LINES = "array<struct<line_no:int,text:string,above:string>>"
NO_LABEL = "CAST(NULL AS STRING)"
ITEM_COLUMNS = [
    "doc_id", "page", "line_no", "part_idx", "start", "end", "type", "value", "label", "score", "source", "date",
    "item_id",
]


def line_texts(text: str) -> str:
    """The non-blank lines of a page, in order."""
    return f"filter(split({text}, '\\n'), l -> l RLIKE '(?U)\\\\S')"


def lines_in_context(text: str) -> str:
    """``array<struct<line_no, text, above>>`` of a page: each non-blank line with its label from above."""

    def contextual(lines: str) -> str:
        def above(offers: str) -> str:
            nearest = ", ".join(f"get({offers}, i - {k})" for k in range(1, ROWS_ABOVE + 1))
            return (
                f"transform({lines}, (l, i) -> named_struct('line_no', i, 'text', l, "
                f"'above', coalesce({nearest})))"
            )

        return let(f"transform({lines}, l -> {offered_above('l')})", above, LINES)

    return let(line_texts(text), contextual, LINES)


def lines_with_rows_above(text: str) -> str:
    """The non-blank lines of a page, each with the texts of the lines above it as ``b1``, ``b2``, …"""
    above = ", ".join(f"'b{k}', get(ls, i - {k})" for k in range(1, ROWS_ABOVE + 1))
    rows = lambda ls: f"transform({ls}, (l, i) -> named_struct('line_no', i, 'text', l, {above.replace('ls', ls)}))"
    return let(line_texts(text), rows, f"array<struct<line_no:int,text:string,{','.join(f'b{k}:string' for k in range(1, ROWS_ABOVE + 1))}>>")


def explode_lines(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, text)`` to ``(doc_id, page, line_no, text)``; blank lines are dropped, numbers are dense."""
    return pages.select("doc_id", "page", F.posexplode(F.expr(line_texts("text"))).alias("line_no", "text"))


def context_lines(pages: DataFrame) -> DataFrame:
    """Lines of plain-text pages ready for :func:`analyze_lines`.

    A line leaves its page with the lines above it, and the label they offer is made on its row: only for lines that a
    filter lets through, and only if it is asked for.
    """
    above = F.expr(f"coalesce({', '.join(offered_above(f'l.b{k}') for k in range(1, ROWS_ABOVE + 1))})")
    return pages.select("doc_id", "page", F.explode(F.expr(lines_with_rows_above("text"))).alias("l")).select(
        "doc_id",
        "page",
        "l.line_no",
        F.lit(0).alias("part_idx"),
        "l.text",
        F.lit(None).cast("string").alias("row_left"),
        above.alias("above"),
        F.lit("text").alias("source"),
    )


def item_id() -> Column:
    return F.sha2(F.concat_ws("|", "doc_id", "page", "line_no", "part_idx", "start", "end"), 256)


def analyze_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Findings of lines that carry ``text, row_left, above, source``; further columns in ``keep`` ride along.

    Narrow: one pass over the lines, whatever their number per document. Spans are settled inside the line, then
    they are typed together, and every finding becomes a row and gets its label there.
    """
    keys = ["doc_id", "page", "line_no", "part_idx", *(keep or [])]
    return (
        fn.describe(lines, keys).withColumn("item_id", item_id()).select(*ITEM_COLUMNS, *(keep or []))
    )


def analyze(pages: DataFrame) -> DataFrame:
    """The whole detector on plain text: ``(doc_id, page, text)`` to items."""
    return analyze_lines(context_lines(pages))
