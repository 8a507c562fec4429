"""Quality rules, line dedup, substring dedup and SimHash against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from velum.llm import components, line_dedup, quality_rules, simhash, substring_dedup
from velum.llm.common import rank_within

from . import brute


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_rules(docs, hairy, empty):
    got = rows_of(
        quality_rules.quality_rules(docs, 3, 0.01, 0.8),
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )
    kept = brute.quality_kept([(r[0], r[1], r[3]) for r in hairy], 3, 0.01, 0.8)
    assert got == Counter((r[0], *brute.base_rules(r[1]), k) for r, k in zip(hairy, kept))
    assert len(set(kept)) == 2
    assert quality_rules.quality_rules(empty).count() == 0


def test_copies_of_another_text_do_not_hide_a_frequent_line(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, f"Home Menu\n{b}", "a") for i, b in enumerate(body)]
    rows += [(1_000 + i, "another text " + body[0], "a") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = rows_of(quality_rules.quality_rules(docs, 20, 0.1), "n_removed_words")
    assert got == Counter({(2,): 39, (0,): 3_001})


def test_many_repeated_windows_count_as_few_do(docs, monkeypatch):
    few = rows_of(quality_rules.measured(docs), "doc_id", "n_repeat_words")
    monkeypatch.setattr(quality_rules, "FEW", 0)
    assert rows_of(quality_rules.measured(docs), "doc_id", "n_repeat_words") == few


def test_kept_documents_keep_columns_and_texts(docs, hairy):
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") <= Counter((r[0], r[1]) for r in hairy)


def test_kept_documents_lose_the_frequent_lines(spark):
    """In all texts of the host but the first; other hosts, rarer lines and lines without words stay."""
    body = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(60)]
    rows = [(i, f"Home  Menu\n \n{body[i]}\n\n{'HOME menu ' if i % 2 else 'Imprint'}\n", "a") for i in range(50)]
    rows += [(i, f"Home Menu\n{body[i]}", "b") for i in range(50, 60)]
    rows += [(3, rows[3][1], "a"), (None, rows[4][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)

    def left(i, text, source):
        if source == "b" or i == 0:
            return text
        # The first text keeps both lines; an imprint stands in 25 texts of this host.
        gone = ("home menu", "imprint")
        return "\n".join(x for x in text.split("\n") if " ".join(x.lower().split()) not in gone)

    got = rows_of(quality_rules.kept_documents(docs), "doc_id", "text", "source")
    assert got == Counter((i, left(i, t, s), s) for i, t, s in rows)


def test_line_dedup(docs, hairy, empty):
    done = line_dedup.deduplicated(docs)
    expected = [(r[0], kept if n else r[1]) for r, (_, n, kept) in zip(hairy, brute.line_dedup([x[:2] for x in hairy]))]
    assert done.columns == docs.columns
    assert rows_of(done, "doc_id", "text") == Counter(expected)
    assert sum(n for _, n, _ in brute.line_dedup([x[:2] for x in hairy])) > 10
    assert line_dedup.deduplicated(empty).count() == 0


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
@pytest.mark.parametrize("ranges", [1, 2, 5])
def test_lines_streamed_in_any_cut(batch, ranges):
    """However a sorted table is cut into ranges and batches, the same lines go."""
    rng = random.Random(batch * 10 + ranges)
    rows = [(h, 0, d, h, p) for h in range(30) for d in range(rng.randrange(1, 12)) for p in range(rng.randrange(1, 4))]
    rows.sort(key=lambda r: (r[0], -r[2], r[4]))
    keys = sorted({(r[0], -r[2]) for r in rows})
    cuts = sorted(rng.sample(keys, ranges - 1))
    names, types = ["h1", "h2", "doc_id", "text_key", "pos"], [pa.int64()] * 4 + [pa.int32()]
    marks = []
    for i in range(ranges):
        lo, hi = ([None, *cuts][i], [*cuts, None][i])
        own = [r for r in rows if (lo is None or (r[0], -r[2]) >= lo) and (hi is None or (r[0], -r[2]) < hi)]
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[a : a + batch]), types)], names)
            for a in range(0, len(own), batch)
        ]
        for b in line_dedup.stream_groups(5)(iter(batches)):
            marks += b.to_pylist()
    total, top = Counter(), {}
    for m in marks:
        if m["kind"] == line_dedup.BORDER:
            total[m["h1"]] += m["n_docs"]
            top[m["h1"]] = max(top.get(m["h1"], -1), m["doc_id"])
    gone = [
        (m["text_key"], m["doc_id"], m["pos"])
        for m in marks
        if m["kind"] == line_dedup.DROP
        or m["kind"] == line_dedup.OPEN and total[m["h1"]] >= 5 and m["doc_id"] != top[m["h1"]]
    ]
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(30)}
    expected = [(h, d, p) for h, _, d, _, p in rows if len(docs[h]) >= 5 and d != max(docs[h])]
    assert Counter(gone) == Counter(expected)


@pytest.mark.parametrize("many", [1000, 0, 8])
def test_substring_dedup(docs, hairy, empty, many):
    done = substring_dedup.dedup_substrings(docs, bits=16, many=many)
    expected = brute.substring_dedup([r[1] for r in hairy])
    assert rows_of(done, "doc_id", "n_removed_words", "kept_text") == Counter(
        (r[0], gone, kept) for r, (_, gone, kept) in zip(hairy, expected)
    )
    assert sum(gone for _, gone, _ in expected) > 1000
    assert substring_dedup.dedup_substrings(empty, bits=16).count() == 0


def test_substring_dedup_with_a_full_sketch(docs, hairy):
    """A sketch far too small lets everything through; the result is the same."""
    done = substring_dedup.dedup_substrings(docs.select("doc_id", "text"), window=12, run=6, bits=16)
    expected = brute.substring_dedup([r[1] for r in hairy], 12)
    assert rows_of(done, "doc_id", "n_removed_words") == Counter((r[0], e[1]) for r, e in zip(hairy, expected))


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
@pytest.mark.parametrize("ranges", [1, 2, 6])
def test_windows_streamed_in_any_cut(batch, ranges):
    rng = random.Random(batch * 10 + ranges)
    rows = [(h, 0, False, d, h, 0) for h in range(40) for d in range(rng.choice([1, 1, 2, 3, 30]))]
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), ranges - 1)), len(rows)]
    names = ["h1", "h2", "no_id", "doc_id", "text_key", "pos"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
    marks = []
    for a, b in zip(cuts, cuts[1:]):
        own = rows[a:b]
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own[i : i + batch]), types)], names)
            for i in range(0, len(own), batch)
        ]
        for x in substring_dedup.stream_windows(iter(batches)):
            marks += x.to_pylist()
    border = Counter()
    for m in marks:
        if m["kind"] == substring_dedup.BORDER:
            border[m["h1"]] += m["n"]
    got = {
        (m["text_key"], m["doc_id"])
        for m in marks
        if m["kind"] == substring_dedup.REPEATED or m["kind"] == substring_dedup.ALONE and border[m["h1"]] > 1
    }
    n = Counter(r[0] for r in rows)
    assert got == {(r[0], r[3]) for r in rows if n[r[0]] > 1}


def test_fingerprints(hairy):
    for row in hairy[:-10]:
        assert simhash.fingerprint(row[1]) == brute.fingerprint(row[1])


@pytest.mark.parametrize("limit", [50_000, 4])
def test_near_duplicates(spark, docs, hairy, limit):
    prints = [brute.fingerprint(r[1]) for r in hairy]
    groups = brute.components(prints)
    least = {g: min((r[0] for r, x in zip(hairy, groups) if x == g and r[0] is not None), default=None) for g in groups}
    got = rows_of(simhash.near_duplicates(docs, limit), "doc_id", "component_id")
    assert got == Counter((r[0], least[g]) for r, g in zip(hairy, groups))
    kept = simhash.one_of_each(docs, limit)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter({d for d in least.values() if d is not None})


@pytest.mark.parametrize("limit", [50_000, 10])
def test_trie_join_links_what_brute_force_links(spark, limit):
    """Clusters around a few centres, so that subtries are large and must be cut."""
    rng = random.Random(3)
    found = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    prints = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    groups = brute.components(prints)
    mine = [roots.get(x, x) for x in signed]
    assert len({*zip(groups, mine)}) == len(set(groups)) == len(set(mine))


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1080)]
    got = components.components(spark.createDataFrame(path + star, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 61)} | {(i, 1000) for i in range(1001, 1080)}


def test_ranks_are_whole_and_repeatable(spark):
    rows = spark.range(2000).selectExpr("id % 3 AS k", "IF(id % 3 = 0, NULL, 'x') AS s", "id")
    got = rank_within(rows, ["k", "s"], ["id"], salts=7).collect()
    for k in range(3):
        assert sorted(r["rank0"] for r in got if r["k"] == k) == list(range(sum(r["k"] == k for r in got)))
    again = rank_within(rows.repartition(9), ["k", "s"], ["id"], salts=7).collect()
    assert {(r["id"], r["rank0"]) for r in got} == {(r["id"], r["rank0"]) for r in again}
