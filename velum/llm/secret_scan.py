"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

The base rules are three patterns: an assignment to a telling name, an access key and a long hexadecimal run. What they
find labels the samples for two first-order Markov models of characters: the values the base rules found are secrets, all
other long runs of the texts are ordinary identifiers, but for the runs to be judged; each distinct sample counts once, so
copies of a document do not weigh more. What is judged are the runs that the base rules left, of ``MIN_RUN`` characters and
more, with a letter and a digit: such a run is a further secret if its log-likelihood ratio under the two models reaches
``MIN_RATIO`` in total and ``MIN_MEAN`` per character.

Everything is built-in expressions. The texts are read once: spans, runs and samples are written per document; the models
are counts of neighbouring characters, at most two squares of the alphabet, however large the corpus is. A text is cut at
its matches and positions are running lengths of the pieces, so the work grows with the text, whatever its number of matches.

Defined cases: null and empty texts have no spans; positions are code points of the whole text, however long; rows that
repeat a doc_id are scanned each; without samples of a label its model knows no character better than another; spans of
the base rules may overlap each other, and further ones stand in what those left; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions.spans import pieces, positions, searchable
from velum.functions.sqlx import let, quoted
from velum.sources.sinks import written

NAMES = ("password", "passwd", "secret", "token", "api_?key")
_AFTER_NAME = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = f"(?i)({'|'.join(NAMES)}){_AFTER_NAME}"
MIN_VALUE = 6
#: Runs are maximal, so a bound on the length in the pattern finds what a test of each run would.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "A-Za-z0-9+/_=-"
MIN_SAMPLE, MIN_RUN = 12, 16
SAMPLE = f"(?<![{RUN}])[{RUN}]{{{MIN_SAMPLE},}}"
CANDIDATE = f"(?<![{RUN}])(?=[{RUN}]*[0-9])(?=[{RUN}]*[A-Za-z])[{RUN}]{{{MIN_RUN},}}"
#: Thousandths of a nat, in total and per character.
MIN_RATIO, MIN_MEAN = 10_000, 500
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Added to the count of every character, and how many observations the frequency of a character alone is worth.
SMOOTHING, BACKOFF = 0.5, 16.0

SPAN = "array<struct<s:int,e:int,k:string,v:string>>"
NONE = f"CAST(array() AS {SPAN})"
KINDS = ("assign", "access", "hex", "markov")


def _good(kind: str, value: str) -> str:
    return f"length(regexp_extract({value}, {quoted(ASSIGN)}, 2)) >= {MIN_VALUE}" if kind == "assign" else "true"


def found(text: str, pattern: str, kind: str) -> str:
    """Spans of the matches with their values."""

    def valued(cut: str) -> str:
        spans = (
            f"transform({positions(cut, kind)}, (p, i) -> named_struct('s', p.s, 'e', p.e, 'k', p.k, 'v', {cut}[2 * i + 1]))"
        )
        return f"filter({spans}, x -> {_good(kind, 'x.v')})"

    return f"IF({text} RLIKE {quoted(pattern)}, {let(pieces(text, pattern), valued, SPAN)}, {NONE})"


def blanked(text: str, pattern: str, kind: str) -> str:
    """The text with a space for every character of a match."""

    def joined(cut: str) -> str:
        return (
            f"array_join(transform({cut}, (p, i) -> IF(i % 2 = 1 AND {_good(kind, 'p')}, repeat(' ', length(p)), p)), '')"
        )

    return f"IF({text} RLIKE {quoted(pattern)}, {let(pieces(text, pattern), joined, 'string')}, {text})"


def scanned(docs: DataFrame) -> DataFrame:
    """Per document the spans of the base rules, the runs they left that may be secrets, and the ordinary samples."""
    text = searchable("coalesce(text, '')")
    rules = (("hex", HEX), ("access", ACCESS), ("assign", ASSIGN))
    rows = docs.select("doc_id", F.expr(text).alias("text"))
    rows = rows.select("doc_id", F.col("text").alias("rest"), *[F.expr(found("text", p, k)).alias(k) for k, p in rules])
    for kind, pattern in rules:
        rows = rows.withColumn("rest", F.expr(f"IF(size({kind}) = 0, rest, {blanked('rest', pattern, kind)})"))
    ordinary = f"length(v) < {MIN_RUN} OR NOT v RLIKE '[0-9]' OR NOT v RLIKE '[A-Za-z]'"
    return rows.select(
        "doc_id",
        *[k for k, _ in rules],
        F.expr(found("rest", CANDIDATE, "markov")).alias("runs"),
        F.expr(f"array_distinct(filter(regexp_extract_all(rest, {quoted(SAMPLE)}, 0), v -> {ordinary}))").alias("ordinary"),
    )


def labelled_samples(scan: DataFrame) -> DataFrame:
    """``(value, is_secret)``: distinct values of the base rules, and distinct runs that are none of them."""
    secret = f"""concat(
        transform(assign, x -> regexp_extract(x.v, {quoted(ASSIGN)}, 2)), transform(access, x -> x.v), transform(hex, x -> x.v))"""
    each = scan.select(
        F.explode(
            F.expr(
                f"concat(transform({secret}, v -> struct(v AS value, true AS is_secret)), "
                "transform(ordinary, v -> struct(v AS value, false AS is_secret)))"
            )
        ).alias("x")
    )
    return each.select("x.*").groupBy("value").agg(F.bool_or("is_secret").alias("is_secret"))


def _codes(value: str) -> str:
    """Places of a value's characters in the alphabet, from 1; 0 stands before the first."""
    return f"concat(array(0), transform(split({value}, ''), c -> instr({quoted(ALPHABET)}, c)))"


def ratios(samples: DataFrame) -> list[int]:
    """Log-likelihood ratio of each character after each other one, in thousandths; row by the character before.

    A sample's character that is not in the alphabet is left out together with what follows it.
    """
    pairs = samples.select(
        "is_secret", F.explode(F.expr(f"{let(_codes('value'), lambda c: f'zip_with({c}, slice({c}, 2, size({c})), (a, b) -> struct(a, b))')}")).alias("p")
    ).select("is_secret", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    counted = pairs.filter("b > 0").groupBy("is_secret", "a", "b").count()
    size = len(ALPHABET)
    n = {label: [[0] * size for _ in range(size + 1)] for label in (True, False)}
    for row in counted.collect():  # bounded: two squares of the alphabet
        n[row["is_secret"]][row["a"]][row["b"] - 1] = row["count"]

    def model(counts: list[list[int]]) -> list[float]:
        single = [sum(c) for c in zip(*counts)]
        single = [(x + SMOOTHING) / (sum(single) + SMOOTHING * size) for x in single]
        return [(x + BACKOFF * p) / (sum(row) + BACKOFF) for row in counts for x, p in zip(row, single)]

    return [round(1000 * (math.log(s) - math.log(o))) for s, o in zip(model(n[True]), model(n[False]))]


def ratio(value: str, table: list[int]) -> str:
    """Sum of the ratios of a value's characters."""
    each = f"element_at(array({', '.join(map(str, table))}), a * {len(ALPHABET)} + b)"
    return let(
        _codes(value),
        lambda c: f"aggregate(zip_with(slice({c}, 1, size({c}) - 1), slice({c}, 2, size({c})), (a, b) -> {each}), 0, (t, x) -> t + x)",
        "int",
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document its secrets: ``(doc_id, found)``, each ``struct<s, e, k, v>`` with its place, kind and value."""
    scan = written(scanned(docs), "secret-scan")
    table = ratios(labelled_samples(scan))
    random = f"filter(runs, x -> {let(ratio('x.v', table), lambda t: f'{t} >= {MIN_RATIO} AND {t} >= {MIN_MEAN} * length(x.v)', 'boolean')})"
    return scan.select("doc_id", F.expr(f"concat(assign, access, hex, IF(size(runs) = 0, runs, {random}))").alias("found"))


def joined_spans(spans: str) -> str:
    """``kind:start:end`` of the spans, by start and then by kind as listed."""
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    keyed = f"transform({spans}, x -> struct(x.s AS s, CASE x.k {order} END AS o, concat_ws(':', x.k, x.s, x.e) AS t))"
    return f"array_join(transform(sort_array({keyed}), x -> x.t), ',')"


def secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and places of the secrets of each document."""
    base = "filter(found, x -> x.k <> 'markov')"
    counts = [F.expr(f"CAST(size(filter(found, x -> x.k = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return secret_spans(docs).select(
        "doc_id",
        *counts[:3],
        F.sha2(F.expr(joined_spans(base)), 256).alias("base_sha256"),
        F.expr(joined_spans("found")).alias("spans"),
        counts[3],
    )


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _either_case(name: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


_ASSIGN_SQL = (f"({'|'.join(map(_either_case, NAMES))}){_AFTER_NAME}").replace("'", "''")


def _sql_cut(of: str, text: str, pattern: str) -> str:
    return f"string_split_regex({text}, '{pattern}') AS {of}_gaps, regexp_extract_all({text}, '{pattern}') AS {of}_hits"


def _sql_blank(of: str) -> str:
    ok = f"length(regexp_extract({of}_hits[i], '{_ASSIGN_SQL}', 2)) >= {MIN_VALUE}" if of == "assign" else "true"
    hit = f"CASE WHEN i > len({of}_hits) THEN '' WHEN {ok} THEN repeat(' ', length({of}_hits[i])) ELSE {of}_hits[i] END"
    return f"array_to_string(list_transform(range(1, len({of}_gaps) + 1), lambda i: {of}_gaps[i] || {hit}), '')"


def _sql_spans(of: str, order: int) -> str:
    start = (
        f"(list_sum(list_transform({of}_gaps[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform({of}_hits[1:i - 1], lambda x: length(x))), 0))::BIGINT"
    )
    return (
        f"SELECT rid, '{of}' AS k, {order} AS o, {start} AS s, {of}_hits[i] AS v "
        f"FROM (SELECT *, unnest(range(1, len({of}_hits) + 1)) AS i FROM cut)"
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
c0 AS (SELECT *, {_sql_cut('assign', 'text', _ASSIGN_SQL)}, {_sql_cut('access', 'text', ACCESS)}, {_sql_cut('hex', 'text', HEX)} FROM d),
b1 AS (SELECT *, {_sql_blank('hex')} AS r1 FROM c0),
b2 AS (SELECT * EXCLUDE (access_gaps, access_hits), access_gaps AS ag, access_hits AS ah, {_sql_cut('access', 'r1', ACCESS)} FROM b1),
b3 AS (SELECT *, {_sql_blank('access')} AS r2 FROM b2),
b4 AS (SELECT * EXCLUDE (assign_gaps, assign_hits), assign_gaps AS sg, assign_hits AS sh, {_sql_cut('assign', 'r2', _ASSIGN_SQL)} FROM b3),
b5 AS (SELECT rid, doc_id, ag AS access_gaps, ah AS access_hits, sg AS assign_gaps, sh AS assign_hits, hex_gaps, hex_hits, {_sql_blank('assign')} AS rest FROM b4),
cut AS (SELECT *, {_sql_cut('markov', 'rest', f'[{RUN}]{{{MIN_RUN},}}')}, list_distinct(regexp_extract_all(rest, '[{RUN}]{{{MIN_SAMPLE},}}')) AS ordinary FROM b5),
spans AS ({_sql_spans('assign', 0)} UNION ALL {_sql_spans('access', 1)} UNION ALL {_sql_spans('hex', 2)} UNION ALL {_sql_spans('markov', 3)}),
good AS (
  SELECT *, s + length(v) AS e, CASE k WHEN 'assign' THEN regexp_extract(v, '{_ASSIGN_SQL}', 2) ELSE v END AS value FROM spans
  WHERE (k <> 'assign' OR length(regexp_extract(v, '{_ASSIGN_SQL}', 2)) >= {MIN_VALUE})
    AND (k <> 'markov' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))
),
samples AS (
  SELECT value, bool_or(is_secret) AS is_secret FROM (
    SELECT value, true AS is_secret FROM good WHERE k <> 'markov'
    UNION ALL SELECT v, false FROM (SELECT unnest(ordinary) AS v FROM cut)
    WHERE length(v) < {MIN_RUN} OR NOT regexp_matches(v, '[0-9]') OR NOT regexp_matches(v, '[A-Za-z]')
  ) GROUP BY value
),
codes AS (
  SELECT *, CASE WHEN i = 1 THEN 0 ELSE instr('{ALPHABET}', value[i - 1]) END AS a, instr('{ALPHABET}', value[i]) AS b
  FROM (SELECT value, is_secret, unnest(range(1, length(value) + 1)) AS i FROM samples)
),
pairs AS (SELECT a, b, count_if(is_secret) AS n1, count_if(NOT is_secret) AS n0 FROM codes WHERE b > 0 GROUP BY a, b),
sums AS (SELECT a, sum(n1) AS n1, sum(n0) AS n0 FROM pairs GROUP BY a),
singles AS (SELECT b, sum(n1) AS n1, sum(n0) AS n0 FROM pairs GROUP BY b),
whole AS (SELECT coalesce(sum(n1), 0) AS n1, coalesce(sum(n0), 0) AS n0 FROM pairs),
square AS (
  SELECT a, b, round(1000 * ({' - '.join(f"""ln((coalesce(p.{n}, 0)::DOUBLE + {BACKOFF}::DOUBLE
    * ((coalesce(t.{n}, 0)::DOUBLE + {SMOOTHING}::DOUBLE) / ((SELECT {n} FROM whole)::DOUBLE + {SMOOTHING * len(ALPHABET)}::DOUBLE)))
    / (coalesce(s.{n}, 0)::DOUBLE + {BACKOFF}::DOUBLE))""" for n in ('n1', 'n0'))}))::BIGINT AS ratio
  FROM (SELECT code // {len(ALPHABET)} AS a, code % {len(ALPHABET)} + 1 AS b
    FROM (SELECT unnest(range(0, {(len(ALPHABET) + 1) * len(ALPHABET)})) AS code)) x
  LEFT JOIN pairs p USING (a, b) LEFT JOIN sums s USING (a) LEFT JOIN singles t USING (b)
),
runs AS (SELECT DISTINCT v FROM good WHERE k = 'markov'),
scored AS (
  SELECT v, sum(ratio) AS ratio FROM (
    SELECT v, CASE WHEN i = 1 THEN 0 ELSE instr('{ALPHABET}', v[i - 1]) END AS a, instr('{ALPHABET}', v[i]) AS b
    FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM runs)
  ) JOIN square USING (a, b) GROUP BY v
),
kept AS (
  SELECT g.* FROM good g LEFT JOIN scored x ON x.v = g.v AND g.k = 'markov'
  WHERE g.k <> 'markov' OR (x.ratio >= {MIN_RATIO} AND x.ratio >= {MIN_MEAN} * length(g.v))
),
listed AS (
  SELECT rid, count_if(k = 'assign') AS n_assign, count_if(k = 'access') AS n_access, count_if(k = 'hex') AS n_hex,
    count_if(k = 'markov') AS n_markov,
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (k <> 'markov') AS base,
    string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM kept GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_markov, 0)::BIGINT AS n_markov
FROM d LEFT JOIN listed USING (rid)
"""
