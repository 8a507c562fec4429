"""The contracts of the operators, written out plainly for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_rules(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(ws),
        sum(map(len, ws)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(repeated),
        len(ws) < 50 or 100 * len(repeated) > 50 * len(ws),
    )


def quality_kept(rows, max_docs, max_share, min_left):
    """Verdicts for (doc_id, text, source)."""

    def lines(text):
        return [tuple(w.lower() for w in words(x)) for x in (text or "").split("\n") if words(x)]

    found, hosts = defaultdict(dict), Counter(s for s, _ in {(s, t or "") for _, t, s in rows})
    for d, t, s in rows:
        for line in lines(t):
            key = (d is None, d or 0)
            found[s, line][t] = min(key, found[s, line].get(t, key))
    holder = {
        k: min(texts, key=lambda t: texts[t])
        for k, texts in found.items()
        if len(texts) > max_docs and len(texts) > max_share * hosts[k[0]]
    }
    out = []
    for _, t, s in rows:
        n = len(words(t))
        gone = sum(len(x) for x in lines(t) if holder.get((s, x), t) != t)
        out.append(not base_rules(t)[5] and n - gone >= min_left * n)
    return out


def line_dedup(rows, min_chars=40, min_docs=5):
    """(n_lines, n_dropped, kept text) for (doc_id, text)."""

    def key(line):
        return lower(line.strip(SPACES))

    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x
            for x in lines
            if d is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d
        ]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(texts, window=35):
    """(n_words, n_removed, kept text) for each text."""
    all_words = [words(t) for t in texts]
    n = Counter(tuple(ws[i : i + window]) for ws in all_words for i in range(len(ws) - window + 1))
    out = []
    for ws in all_words:
        gone = set()
        for i in range(len(ws) - window + 1):
            if n[tuple(ws[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def fingerprint(text):
    ws = words(lower(text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=2):
    """For each fingerprint the list of places linked with it, directly or through others."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def source_audit(rows, min_docs, top):
    """Rows of the audit for (text, lang, source)."""
    counts, groups, in_docs = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(found, 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return out


ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secret_scan(rows):
    """Rows of the scan for (doc_id, text)."""

    def spans(text, kind, pattern, least, group=0):
        hits = [m for m in re.finditer(pattern, text) if len(m[group]) >= least]
        return [(m.start(), m.end(), kind, m[group]) for m in hits]

    rules = {"assign": (ASSIGN, 6, 2), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]+", 24, 0)}
    base, runs, samples = [], [], {}
    for _, text in rows:
        rest = text or ""
        base.append([s for k, (p, n, g) in rules.items() for s in spans(text or "", k, p, n, g)])
        for k in ("hex", "access", "assign"):
            for s, e, _, _ in spans(rest, k, *rules[k]):
                rest = rest[:s] + " " * (e - s) + rest[e:]
        every = spans(rest, "markov", "[A-Za-z0-9+/_=-]+", 12)
        runs.append([r for r in every if len(r[3]) >= 16 and re.search("[0-9]", r[3]) and re.search("[A-Za-z]", r[3])])
        for r in every:
            if r not in runs[-1]:
                samples.setdefault(r[3], False)
    for found in base:
        samples |= {r[3]: True for r in found}
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    n = {True: Counter(), False: Counter()}
    for value, secret in samples.items():
        for a, b in zip(" " + value, value):
            n[secret][a, b] += 1

    single = {k: Counter() for k in n}
    for k in n:
        for (_, b), x in n[k].items():
            single[k][b] += x

    def ratio(value):
        total = 0
        for a, b in zip(" " + value, value):
            p = []
            for k in (True, False):
                alone = (single[k][b] + 0.5) / (sum(single[k].values()) + 0.5 * len(letters))
                p.append((n[k][a, b] + 16 * alone) / (sum(n[k][a, c] for c in letters) + 16))
            total += round(1000 * (math.log(p[0]) - math.log(p[1])))
        return total

    out = []
    for (doc_id, _), mine, more in zip(rows, base, runs):
        more = [r for r in more if ratio(r[3]) >= max(10_000, 500 * len(r[3]))]
        order = ["assign", "access", "hex", "markov"]
        text = [",".join(f"{k}:{s}:{e}" for s, e, k, _ in sorted(x, key=lambda r: (r[0], order.index(r[2])))) for x in (mine, mine + more)]
        counts = [sum(r[2] == k for r in mine) for k in order[:3]]
        out.append((doc_id, *counts, sha256(text[0]), text[1], len(more)))
    return out


def spelling(rows, min_count=3):
    """Rows of the spelling variants for (doc_id, text)."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}
    without = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            without[w[:i] + w[i + 1 :]].add(w)

    def replaced(x, y):
        return len(x) == len(y) and sum(a != b for a, b in zip(x, y)) == 1

    near = {}
    for w in n:
        shorter = {w[:i] + w[i + 1 :] for i in range(len(w))}
        near[w] = {x for x in shorter if x in n} | without[w] | {x for s in shorter for x in without[s] if replaced(x, w)}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]
