"""Mixing, archives, scoring, search, language identification, packing and the pipeline."""

import io
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from velum.llm import language_id, lm_scoring, mixing, packing, quality_rules, topk, warc
from velum.sources.sinks import shared_path, written

from . import brute

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- mixing ------------------------------------------------------------------------------------------


def water_filled(sizes, weights, total):
    """Targets by sharing and resharing, step by step; ``sizes`` by source in order."""
    target, open_, left = {}, dict(zip(sizes, weights)), total
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > 2 * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixing(docs, hairy, empty):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for _, text, _, source, *_ in hairy:
        size[source] += len(brute.words(text))
    sources = sorted(size, key=lambda s: (s is None, s))
    target = water_filled({s: size[s] for s in sources}, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(size.values()))
    source_of = {(r[0], len(brute.words(r[1]))): r[3] for r in hairy}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(brute.words(r[1]))) for r in hairy)
    for s in sources:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rows: Counter((r["doc_id"], r["text_key"], r["copies"]) for r in rows)
    assert key(again) == key(got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_tilted_rates_meet_their_constraints(spark):
    """Rates are exponential in the size up to the cap, and their words sum up to the target."""
    rng = random.Random(5)
    sizes = {s: [rng.randrange(1, 900) for _ in range(300)] for s in "abc"}
    histogram = spark.createDataFrame(
        [(s, z, n) for s, zs in sizes.items() for z, n in Counter(zs).items()], "source string, size long, n long"
    )
    share = {"a": 0.3, "b": 1.7, "c": 2.0}
    targets = spark.createDataFrame(
        [(s, sum(z), len(z), sum(z) * share[s]) for s, z in sizes.items()],
        "source string, source_size long, docs long, target double",
    )
    tilts = {r["source"]: r for r in mixing.solve_tilts(histogram, targets).collect()}
    for s, z in sizes.items():
        rates = [min(2, math.exp(tilts[s]["tilt"] * x / tilts[s]["mean"])) for x in z]
        assert sum(r * x for r, x in zip(rates, z)) == pytest.approx(sum(z) * share[s], rel=1e-5)


def test_mixed_documents(docs, hairy):
    done = mixing.mixed(docs)
    assert done.columns == docs.columns
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], len(brute.words(r["text"]))) for r in done.collect()) == +copies


# ---- archives ----------------------------------------------------------------------------------------


def test_archives(spark):
    rng = random.Random(2)
    html = ["<p>one</p>", None, "", "żółć " * 3, "".join(chr(rng.randrange(32, 60000) | 1) for _ in range(50_000)).encode("utf-8", "ignore").decode()]
    rows = [(i, f"http://x/ż\r\nA: {i}" if i % 3 else None, html[i % 5], "clash") for i in range(60)]
    rows += [(3, "again", html[3], ""), (None, "no id", html[0], ""), (None, "alone", "only here", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(4)
    files = warc.write_warc(pages, shared_path(spark, "warc"), file_bytes=40_000)
    assert files.count() > 4
    least = defaultdict(list)
    for i, _, h, _ in rows:
        least[h or ""].append(i)
    expected = Counter()
    for i, _, h, _ in rows:
        body = (h or "").encode()
        first = min((x for x in least[h or ""] if x is not None), default=None)
        expected[i, len(body), warc.digest_of(body), "response" if i == first else "revisit", None if i == first else first] += 1
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for split in (100, 3_000, 1 << 23):  # ranges far smaller than a record, and whole files
        got = warc.read_warc(files, split)
        assert rows_of(got, *columns) == expected
    payloads = {r["payload_digest"]: bytes(r["payload"]) for r in got.filter("record_type = 'response'").collect()}
    assert payloads == {warc.digest_of((h or "").encode()): (h or "").encode() for h in [*html, "only here"]}
    large = warc.read_warc(warc.write_warc(pages, shared_path(spark, "warc"), min_bytes=10**6))
    assert large.filter("record_type = 'revisit'").count() == 0
    none = warc.write_warc(pages.limit(0), shared_path(spark, "warc"))
    assert warc.read_warc(none).count() == 0


@pytest.mark.parametrize("chunk", [5, 64, 1 << 18])
def test_reader_passes_over_false_members(chunk):
    """Magic bytes in stored data, foreign members and torn members are no records."""
    rng = random.Random(chunk)
    good = [warc.record(i, None, rng.randbytes(200) + warc.MAGIC * 3, None) for i in range(6)]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    parts = [warc._member(good[0]), stored.compress(good[1]) + stored.flush(), warc._member(b"no record at all")]
    parts += [warc._member(good[2]), warc._member(good[3])[:-30], warc.MAGIC, warc._member(good[4]), b"junk", warc._member(good[5])]
    data = b"".join(parts)
    for step in (7, 150, len(data)):
        found = [
            (at, r["page_id"])
            for a in range(0, len(data), step)
            for at, r in warc.records_in(io.BytesIO(data), len(data), a, min(a + step, len(data)), chunk)
        ]
        assert [p for _, p in found] == [0, 1, 2, 4, 5]


def test_reader_tells_a_payload_that_is_not_its_digest():
    data = warc._member(warc.record(1, None, b"payload", None).replace(b"payload\r\n", b"paylord\r\n"))
    data += warc._member(warc.record(2, None, b"payload", None))
    found = [r for _, r in warc.records_in(io.BytesIO(data), len(data), 0, len(data))]
    assert [(r["page_id"], r["damaged"], r["payload"]) for r in found] == [(1, True, b"paylord"), (2, False, b"payload")]


def test_records_with_long_urls_are_read_by_many_tasks(spark):
    urls = ["http://x/" + c * n for c, n in (("a", 1_000), ("b", 70_000), ("ż", 12_000), ("c", 600_000))]
    rows = [(i, urls[i % 4], f"page {i} " * 3) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.read_warc(warc.write_warc(pages, shared_path(spark, "warc")), 500)
    assert got.count() == 40
    assert got.select(F.spark_partition_id()).distinct().count() > 1


# ---- scoring -----------------------------------------------------------------------------------------


def plain_scores(rows, targets):
    """Scores of :mod:`velum.llm.lm_scoring` when all words and pairs are known."""
    split = [(d, (t or "").lower().encode().split()) for d, t in rows]
    models = []
    for chosen in (lambda d: d in targets, lambda d: True):
        single, pair, begun = Counter(), Counter(), Counter()
        for d, ws in split:
            if chosen(d):
                single.update(ws)
                pair.update(zip([None, *ws], ws))
                begun.update([None, *ws][: len(ws)])
        models.append((chosen, single, pair, begun))
    types = len(models[1][1]) + 1
    out = []
    for d, ws in split:
        ce = []
        for chosen, single, pair, begun in models:
            own = [Counter(), Counter(), Counter()]
            if chosen(d):
                own = [Counter(ws), Counter(zip([None, *ws], ws)), Counter([None, *ws][: len(ws)])]
            total = sum(single.values()) - sum(own[0].values()) + types
            loss = 0.0
            for v, w in zip([None, *ws], ws):
                p = pair[v, w] - own[1][v, w] + 8 * (single[w] - own[0][w] + 1) / total
                loss -= math.log(p / (begun[v] - own[2][v] + 8))
            ce.append(round(loss / len(ws), 9) if ws else None)
        out.append((d, len(ws), *ce))
    return out


def test_lm_scores(spark, docs, hairy, empty):
    ids = [r[0] for r in hairy if r[0] is not None and r[0] % 3 == 0]
    labels = spark.createDataFrame([(i, 1) for i in [*ids, ids[0], 10**9]] + [(None, 1)], "doc_id long, quality int")
    got = Counter(
        (r["doc_id"], r["n_tokens"], *[None if x is None else round(x, 9) for x in (r["ce_target"], r["ce_background"])])
        for r in lm_scoring.cross_entropy_difference(docs, labels).collect()
    )
    assert got == Counter(plain_scores([(r[0], r[1]) for r in hairy], set(ids)))
    assert lm_scoring.cross_entropy_difference(empty, labels).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, labels.limit(0)).count() == len(hairy)


@pytest.mark.parametrize("block, ranges", [(1, 1), (37, 10_000), (1 << 40, 50)])
def test_lm_scores_use_every_count(spark, docs, hairy, monkeypatch, block, ranges):
    """However the texts are cut into blocks and the hashes into ranges, all counts are used."""
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    monkeypatch.setattr(lm_scoring, "RANGE", ranges)
    ids = [r[0] for r in hairy if r[0] is not None and r[0] % 3 == 0]
    labels = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = Counter(
        (r["doc_id"], r["n_tokens"], *[None if x is None else round(x, 9) for x in (r["ce_target"], r["ce_background"])])
        for r in lm_scoring.cross_entropy_difference(docs, labels).collect()
    )
    assert got == Counter(plain_scores([(r[0], r[1]) for r in hairy], set(ids)))


@pytest.mark.parametrize("values", [[], [0], [-1, 1 << 62, -(1 << 63), 5, 5]])
def test_lm_columns_are_packed_without_loss(values):
    assert lm_scoring.unpacked(lm_scoring.packed(np.array(values, "i8"))).tolist() == values


def test_lm_blocks_are_not_shuffled(spark, docs):
    """The texts stay where they were written, the counts go to them."""
    plan = lm_scoring.cross_entropy_difference(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    texts = [x for x in plan.split("FlatMapCoGroupsInArrow")[1].splitlines() if "Exchange" in x or "numbers#" in x and "Scan" in x]
    assert sum("numbers#" in x for x in texts) == 1 and "Exchange" not in texts[0] and "Bucketed: true" in texts[0]


def test_lm_scores_of_texts_without_words(spark):
    rows = [(1, None), (1, ""), (None, " \n"), (2, None)]
    got = lm_scoring.cross_entropy_difference(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")
    ).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, 0, None, None, None) for d, _ in rows)


def test_lm_scores_tell_the_target_apart(spark):
    rng = random.Random(1)
    kinds = [[f"{k}{i}" for i in range(80)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(200)]
    labels = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert max(got[i] for i in range(0, 200, 2)) < min(got[i] for i in range(1, 200, 2))


# ---- search ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block, group", [(4096, 1024), (37, 3)])
def test_top_k(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in rng.normal(0, 0.1, (300, 16)).astype("f4")]
    vectors[20:60] = [vectors[20]] * 40  # ties
    vectors[70] = [0.0] * 16
    vectors[80], vectors[81], vectors[82] = None, [float("nan")] * 16, [None] * 16
    vectors[83], vectors[84] = [float("inf")] * 16, [0.5] * 4
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(50, vectors[1], 1), (7, vectors[7], 1), (None, vectors[3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    usable = [
        (i, [math.floor(256 * x) for x in v])
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    expected = Counter()
    for q in {i for i, _ in usable if i % 50 == 0}:
        query = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in usable if i != q)
        for rank, (s, i) in enumerate(scored[:5], 1):
            expected[q, rank, i, -s] += 1
    assert rows_of(topk.top_k(df), "query_id", "rank", "vec_id", "score") == expected
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (100, 3)")).count() == 1


# ---- language ----------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_uses_nothing_but_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(docs)
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert rows_of(language_id.identify(other, language_id.learn(other)), "doc_id", "lang_pred", "score") == rows_of(
        language_id.identify(docs, model), "doc_id", "lang_pred", "score"
    )


def test_language_of_odd_rows(spark, docs, hairy, empty):
    got = language_id.op8_language_id
    rows = language_id.identify(docs, language_id.learn(docs)).collect()
    assert len(rows) == len(hairy) and callable(got)
    unknown = Counter(r["doc_id"] for r in rows if r["lang_pred"] == "und")
    assert unknown == Counter(r[0] for r in hairy if not any(map(str.isalpha, r[1] or "")))
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language_id.learn(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


def test_language_of_repeated_rows(spark):
    """One row repeated very often is one sample, and no language is forgotten for it."""
    polish, english = "zażółć gęślą jaźń", ["the quick brown fox", "a lazy dog there", "what is this thing"]
    rows = [(9, polish, "pl")] * 5_000 + [(i, t, "en") for i, t in enumerate([*english, "more of the same", "and so on"])]
    for given in (rows[:5_000], rows):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(3)
        assert language_id.training_sample(docs).count() <= 6
        got = {(r["text"], r["lang_pred"]) for r in language_id.identify(docs, language_id.learn(docs)).join(docs.distinct(), "doc_id").collect()}
        assert (polish, "pl") in got and all(p == "pl" for t, p in got if t == polish)


# ---- packing -----------------------------------------------------------------------------------------


def check_packed(rows, size):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


def test_packing(docs, hairy, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    expected = Counter()
    for r in hairy:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[r[0], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    n = check_packed(rows, 1024)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 1024) + 2
    assert packing.pack(empty).count() == 0


def test_encoder_gives_the_ids_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    rng = random.Random(6)
    texts = ["", " ", "a <|endoftext|> b", "x" * 3000, " " * 3000, "\r\n\t", "it's we'LL 123 ½ ²", "日本語 العربية 🙂‍"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), 32, 10])) for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["even", "short", "one length", "half and more", "few"])
def test_plans_place_every_piece(kind):
    rng = np.random.default_rng(1)
    counts = np.zeros(257, "i8")
    if kind == "even":
        counts[1:] = rng.integers(0, 500, 256)
    elif kind == "short":
        counts[1:20] = 1000
    elif kind == "one length":
        counts[100] = 12345
    elif kind == "half and more":
        counts[129:] = 10
    else:
        counts[[3, 250, 256]] = 1, 2, 1
    done = packing.plan(counts, 256)
    placed = np.zeros(257, "i8")
    for content, n in done:
        assert sum(a * b for a, b in content) <= 256
        for length, times in content:
            placed[length] += times * n
    assert (placed == counts).all()
    used = sum(n for _, n in done)
    least = max(math.ceil((counts * np.arange(257)).sum() / 256), counts[129:].sum())  # longer than half: one in each
    if kind in ("even", "short", "few"):
        assert used <= 1.01 * least + 2


# ---- pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, docs, hairy):
    """Every stage does to what its predecessor kept what brute force does to it."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = written(stage(spark, now, SF), "test-stage")
        after = now.collect()
        assert now.columns == docs.columns
        texts = Counter((r["doc_id"], r["text"]) for r in after)
        if name == "quality rules":
            kept = brute.quality_kept(
                [(r["doc_id"], r["text"], r["source"]) for r in before],
                quality_rules.MAX_DOCS, quality_rules.MAX_SHARE, quality_rules.MIN_LEFT,
            )
            assert texts == Counter((r["doc_id"], r["text"]) for r, k in zip(before, kept) if k)
        elif name == "line dedup":
            done = brute.line_dedup([(r["doc_id"], r["text"]) for r in before])
            assert texts == Counter((r["doc_id"], t if n else r["text"]) for r, (_, n, t) in zip(before, done))
        elif name == "near duplicates":
            groups = brute.components([brute.fingerprint(r["text"]) for r in before])
            left = Counter(groups[i] for i, r in enumerate(before) for a in [(r["doc_id"], r["text"])] if a in texts and a[0] is not None)
            assert set(left) == {g for r, g in zip(before, groups) if r["doc_id"] is not None}
            assert len([r for r in after if r["doc_id"] is not None]) == len(left)
        else:
            assert set(texts) <= {(r["doc_id"], r["text"]) for r in before} and max(texts.values()) <= 2
    rows = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    check_packed(rows, 1024)
    pieces = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert pieces == Counter(r["doc_id"] for r in now.collect())


def test_pipeline_runs_over_the_given_documents(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and check_packed(rows, 1024) > 0
    assert json.dumps(rows[0].asDict())


def test_pipeline_of_nothing(spark, empty):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_queries_equal_their_sql(spark):
    import check
    from velum.llm.queries import ORACLES, QUERIES

    database = check.database(SF)
    for name, sql in ORACLES.items():
        assert check.compare(QUERIES[name](spark, SF).toArrow(), check.answer(database, sql)) == "ok", name
