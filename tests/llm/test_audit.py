"""Source audit, spelling variants and secret scan against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from velum.llm import secret_scan, source_audit, spelling

from . import brute


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("tile, block, held, piece", [(32, 1 << 14, 1_000_000, 1 << 20), (2, 7, 50, 100)])
def test_source_audit(spark, docs, hairy, empty, monkeypatch, tile, block, held, piece):
    for name, value in (("TILE", tile), ("BLOCK", block), ("HELD", held), ("PIECE", piece)):
        monkeypatch.setattr(source_audit, name, value)
    got = rows_of(source_audit.source_audit(docs, 3, 5), *AUDIT)
    assert got == Counter(brute.source_audit([(r[1], r[2], r[3]) for r in hairy], 3, 5))
    assert source_audit.source_audit(empty).count() == 0


def test_source_audit_without_terms_and_with_many_sources(spark):
    rows = [(f"Ab \x01Ü—x {'hot ' * (i % 3)}tail{i}", "a" if i % 2 else None, f"s{i % 9}" if i % 5 else "hot") for i in range(200)]
    rows += [("rare", "z", "one"), (None, "z", "two"), ("", "y", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert rows_of(source_audit.source_audit(docs), *AUDIT) == Counter(brute.source_audit(rows, 30, 50))


def test_runs_and_shares():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.randrange(1, 30)
        column = [rng.choice([0, 0, 0, 1, 1, 2, 7]) for _ in range(width)]
        slots = np.flatnonzero(column)
        ends, values = source_audit.runs(slots, np.array(column)[slots], width)
        assert np.repeat(values, np.diff(ends, prepend=0)).tolist() == column and ends[-1] == width
        assert (values[1:] != values[:-1]).all()
    for total in (5, 10**15 + 7):
        n = np.array([0, 1, total // 3, total - 5])
        assert source_audit.shares(n, total).tolist() == [1 + 10**9 * (int(x) + 5) // total for x in n]


SECRET = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def secret_texts():
    rng = random.Random(5)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: pick(["tion", "ing", "er", "th", "an", "re"], rng.randrange(1, 6))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [
        f"{prose(20)} Token = \"{pick(hexa, 40)}\" {prose(9)}",
        f"ü\U0001f600 API_KEY:'{pick(mixed, 20)}' AKIA{pick('ABCDEFGH0123', 16)} AKIA{pick('AB1', 15)} AKIAAKIA",
        "token:token:abcdefgh password=abc secret==abcde passwd : \"a.b_c-d\" toKen=token=12345",
        f"{pick(hexa, 23)} {pick(hexa, 24)}g x{pick('0123456789', 30)}AKIA{pick('0123456789', 30)}",
        f"session {pick(mixed, 30)} and {word()}{word()}{word()}tiontioning_{rng.randrange(10)}",
        "4432507379035540 tiontioningererthan1 " + "thererererererer " * 30,
        f"{pick(hexa, 30)}pi_key=abcdefgh  token=abcdef",
        prose(3000) + " " + " ".join(f"secret={pick(mixed, 12)}" for _ in range(700)),
    ]
    return texts + [f"{prose(60)} token={pick(mixed, 24)}" for _ in range(40)]


def test_secret_scan(spark, docs, hairy, empty):
    texts = secret_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, None), (3, ""), (None, texts[0]), (2, texts[2])]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(secret_scan.secret_scan(given), *SECRET)
    assert got == Counter(brute.secret_scan(rows))
    assert any(r[6] for r in got)  # the models find more than the patterns
    mixed = next(r for r in got if r[0] == 4)
    assert mixed[1:4] == (0, 0, 0) and mixed[6] == 1  # the random string, not the identifier
    assert next(r for r in got if r[0] == 5)[5] == ""
    assert rows_of(secret_scan.secret_scan(docs), *SECRET) == Counter(brute.secret_scan([r[:2] for r in hairy]))
    assert secret_scan.secret_scan(empty).count() == 0


def test_secret_scan_is_native(spark):
    plan = secret_scan.scanned(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


def spelled(rng: random.Random, words: int) -> str:
    out = []
    for _ in range(words):
        w = rng.choice(["analysis", "aaaaaa", "château", "letters", "better", "bitter", "ab" * 9, "longest" * 7])
        if rng.random() < 0.5:
            at, letter = rng.randrange(len(w)), rng.choice("abtà")
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :]])
        out.append(w.title() if rng.random() < 0.1 else w)
    return " ".join(out)


@pytest.mark.parametrize("limit, chunk, step, held", [(1 << 21, 1 << 21, 1 << 20, 1_000_000), (40, 100, 9, 20)])
def test_spelling_variants(spark, docs, hairy, empty, monkeypatch, limit, chunk, step, held):
    for name, value in (("LIMIT", limit), ("CHUNK", chunk), ("STEP", step), ("HELD", held)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(9)
    rows = [(i % 50, spelled(rng, 60)) for i in range(90)] + [(None, spelled(rng, 40)), (3, None), (4, "")]
    rows += [(i, "chainaaa " * 5 + "chainaab " * 2 + "chainabb " * (i % 3 == 0)) for i in range(20)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(brute.spelling(rows))
    assert rows_of(spelling.spelling_variants(given), *SPELLING) == want
    assert any(w[1] and w[2] != w[1] for w in want)  # some forms lead further
    assert rows_of(spelling.spelling_variants(docs), *SPELLING) == Counter(brute.spelling([r[:2] for r in hairy]))
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abcdefgh", 7)])
def test_composition_accepts_each_near_pair_once(letters, longest):
    rng = random.Random(longest)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(5, longest + 1))).encode() for _ in range(400)})
    keyed = sorted(
        (spelling.state_key(w, m, a, b), w)
        for w in words
        for m in (len(w), len(w) - 1)
        if m >= 5
        for a, b in spelling.halves(0, m)
    )
    n = {w: rng.randrange(3, 9) for w in words}
    found = spelling.near_words([k for k, _ in keyed], [w for _, w in keyed], np.array([n[w] for _, w in keyed]), 50)
    got = Counter()
    for row in found.to_pylist():
        got[row["w"]] += row["n_near"]

    def near(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    assert +got == +Counter({x: sum(near(x, y) for y in words) for x in words})
