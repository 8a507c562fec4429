"""Quality rules: per-text rules, and lines that too many documents of a host share.

Lines are normalised (words in lower case, joined by one space) and hashed. For each host (``source``) and line the
distinct documents are counted, where exact copies count as one document: a copied text is a matter for deduplication
and no sign of boilerplate. A line found in more than ``max_docs`` documents of its host and in more than ``max_share``
of them is removed from all documents but the first that holds it. A document of whose words less than ``min_left`` is
left is depleted and rejected.

Everything is built-in expressions. The text is read once; what follows works on hashes and counts. A frequent line is
pre-aggregated before each shuffle, and the join that brings the frequent lines back reads them from a written table, so
adaptive execution can split a host or line that holds a large share of the rows.

Defined cases: a null or empty text has no words (``base_failed``) and both are one text; a text is read whole, however
long; a null source is a host of its own; rows that
repeat a doc_id are judged each by its own text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import SPACE_RUN, match, text_key
from velum.sources.sinks import written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Repeated windows of a text up to which each window is looked up among them.
FEW = 48
MAX_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.001, 0.3


def _repeat_words(windows: Column, twice: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    ``windows`` has the hash of each window in order, ``twice`` the hashes found more than once. With few of those each
    window is looked up among them; with many, hashes are sorted together with their places, so that equal ones are
    neighbours. Both ways give the same places.
    """

    def neighbours(s: Column) -> Column:
        near = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(near, lambda x: x["i"]))

    looked_up = F.filter(
        F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i))
    )
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_out = F.aggregate(F.array(ordered), F.lit(None).cast("array<int>"), lambda _, s: neighbours(s))
    covered = F.aggregate(
        F.when(F.size(twice) <= FEW, looked_up).otherwise(sorted_out),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame) -> DataFrame:
    """Per document its counts and, for every line with a word, the hash of the normalised line and its words."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        "doc_id",
        "source",
        text_key(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    words = split.select(
        "doc_id",
        "source",
        "text_key",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.array_remove(F.split(x, SPACE_RUN, -1), "")).alias("line_words"),
    )
    flat = words.withColumn("words", F.flatten("line_words"))
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = flat.select(
        "doc_id",
        "source",
        "text_key",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        windows.alias("windows"),
        F.transform(
            "line_words",
            lambda ws: F.struct(
                F.xxhash64(F.transform(ws, lambda w: F.lower(w))).alias("line_key"), F.size(ws).alias("line_words")
            ),
        ).alias("lines"),
    )
    # Projections of their own: what one of them computes is used several times in the next.
    ordered = hashed.withColumn("ordered", F.sort_array("windows"))
    twice = ordered.withColumn(
        "twice",
        F.array_distinct(F.filter("ordered", lambda h, i: F.coalesce(F.get("ordered", i - 1) == h, F.lit(False)))),
    )
    return twice.select(
        *[c for c in hashed.columns if c not in ("windows", "lines")],
        _repeat_words(F.col("windows"), F.col("twice")).alias("n_repeat_words"),
        "lines",
    )


def frequent_lines(lines: DataFrame, hosts: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Lines above the limits: ``(source, line_key, n_docs, holder)``, the holder being the text that keeps the line.

    ``lines`` has one row per line, ``hosts`` the distinct texts per source. Counted in two steps, both with partial sums:
    first each text that holds the line, then the texts.
    """
    texts = lines.groupBy("source", "line_key", "text_key").agg(F.min("doc_id").alias("first_doc"))
    counts = texts.groupBy("source", "line_key").agg(
        F.count("*").alias("n_docs"), F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "text_key")).alias("first")
    )
    over = counts.filter(F.col("n_docs") > max_docs)
    return match(over, hosts, ["source"]).filter(F.col("n_docs") > F.col("host_docs") * max_share).select(
        "source", "line_key", "n_docs", F.col("first.text_key").alias("holder")
    )


def _verdicts(docs: DataFrame, max_docs: int, max_share: float, min_left: float, places: bool) -> DataFrame:
    """Counts and verdicts with ``source`` and ``text_key``; if asked for, ``gone``: the places of removed lines.

    Places count the lines that have a word, from 0; they are null where no line is removed.
    """
    keys = ["doc_id", "source", "text_key"]
    base = written(measured(docs.select("doc_id", "source", "text")), "quality-base")
    lines = base.select(*keys, F.posexplode("lines").alias("place", "line")).select(*keys, "place", "line.*")
    # In the same unit as the documents of a line: exact copies are one document.
    hosts = base.groupBy("source", "text_key").agg(F.lit(1)).groupBy("source").agg(F.count("*").alias("host_docs"))
    frequent = written(frequent_lines(lines, hosts, max_docs, max_share), "quality-frequent")
    found = match(lines, frequent, ["source", "line_key"], "inner").filter("holder <> text_key")
    # Rows that repeat a doc_id and its text would be summed up together; the rows are therefore counted as well.
    gone = [F.sort_array(F.collect_set("place")).alias("gone")] if places else []
    removed = found.groupBy(*keys).agg(F.sum("line_words").alias("sum_words"), *gone)
    rows = match(base.drop("lines"), removed, keys)
    times = base.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")
    rows = match(rows, times, keys)
    n_gone = F.coalesce(F.expr("sum_words div coalesce(times, 1)"), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("n_words") - n_gone >= min_left * F.col("n_words"))).alias("kept"),
        n_gone.alias("n_removed_words"),
        "text_key",
        "source",
        *(["gone"] if places else []),
    )


def quality_rules(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """Counts and verdict per document: ``n_removed_words`` stand in removed lines, ``kept`` is the verdict."""
    return _verdicts(docs, max_docs, max_share, min_left, False).drop("source")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("text_key")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places ``gone``: what lies between two of them is taken as a whole."""
    lines = F.split(text, "\n", -1)
    worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))
    cuts = F.transform(gone, lambda i: F.get(worded, i))
    starts = F.concat(F.array(F.lit(-1)), cuts)
    ends = F.concat(cuts, F.array(F.size(lines)))
    between = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(between), "\n")


def kept_documents(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """The documents that pass, with their columns and their texts without the removed lines."""
    good = _verdicts(docs, max_docs, max_share, min_left, True).filter("kept")
    good = good.dropDuplicates(["doc_id", "source", "text_key"]).select(
        *[F.col(c).alias(f"_velum_{c}") for c in ("doc_id", "source", "text_key", "gone")]
    )
    on = (
        F.col("doc_id").eqNullSafe(F.col("_velum_doc_id"))
        & F.col("source").eqNullSafe(F.col("_velum_source"))
        & (text_key(F.coalesce("text", F.lit(""))) == F.col("_velum_text_key"))
    )
    gone = F.col("_velum_gone")
    text = F.when(gone.isNull(), F.col("text")).otherwise(_without(F.col("text"), gone))
    return docs.join(good, on).withColumn("text", text).select(*docs.columns)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
l AS (
  SELECT rid, array_to_string(list_filter(regexp_split_to_array(lower(x), '[\x20\x09-\x0D]+'), lambda y: y <> ''), ' ') AS k,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT rid, unnest(ls) AS x FROM w)
),
texts AS (SELECT d.source, l.k, d.text, min(d.doc_id) AS doc_id FROM l JOIN d USING (rid) GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
counts AS (SELECT source, k, count(*) AS n, arg_min(text, doc_id) AS holder FROM texts GROUP BY source, k),
freq AS (
  SELECT c.source, c.k, c.holder FROM counts c JOIN hosts h ON h.source IS NOT DISTINCT FROM c.source
  WHERE c.n > {MAX_DOCS} AND c.n > {MAX_SHARE} * h.n
),
gone AS (
  SELECT l.rid, sum(l.n) AS n FROM l JOIN d USING (rid)
  JOIN freq f ON f.source IS NOT DISTINCT FROM d.source AND f.k = l.k AND f.holder <> d.text GROUP BY l.rid
),
m AS (
  SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(w.ls) - len(list_distinct(w.ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept,
  n_removed_words
FROM m
"""
