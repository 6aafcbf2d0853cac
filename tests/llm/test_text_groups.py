"""Line dedup, periodic runs and spelling variants against brute force, and on nulls, long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyrisk.llm import line_dedup, periodic_runs, queries, spelling
from test_operators import EDGE, traps

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- line dedup

def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: lower(line.strip(BLANKS))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    keep = {k: max(ids, key=rank) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(3)
    common = [f"  Common line {k} with Ünïcode and enough letters to count as one\t" for k in range(6)]
    rows = list(EDGE)
    for i in range(100, 160):
        lines = [rng.choice(common) for _ in range(rng.randrange(4))] + [f"own line {rng.random()} of the document, long enough to be a key"]
        lines += ["short", "", "é" * 39, "É" * 40, "é" * 40, common[0].upper() if i % 2 else common[0]]
        rng.shuffle(lines)
        rows.append((i if i % 7 else 107, "\n".join(lines) + "\r" * (i % 2)))
    rows += [(None, common[1] + "\n" + common[1]), (None, common[2])] + [(500 + i, "x" * 41 + f"\n{i}") for i in range(4)]
    rows += [(900, "y" * 40 + "\n" + "y" * 40)] * 5 + [(901 + i, "z" * 39 + "ß" * (i > 2)) for i in range(9)]
    return rows


@pytest.mark.parametrize("rule", [line_dedup.Rule(), line_dedup.Rule(least_bits=1 << 16, most_bits=1 << 16, block=16, busy=3)])
def test_line_dedup(spark, rule):
    rows = line_rows()
    got = line_dedup.deduplicated(traps(spark, rows).repartition(5), "lines", "dropped", rule).collect()
    assert all(r["_words"] == "w" and r["n_words"] == 7 for r in got)
    assert sorted(((r["doc_id"], r["lines"], r["dropped"], r["text"] or "") for r in got), key=repr) == brute_lines(rows)
    assert sum(r["text"] is None for r in got) == sum(t is None for _, t in rows)


def test_line_filter_counts_rows_not_lines(spark):
    docs = spark.createDataFrame([("a" * 50 + "\n" + "a" * 50,), ("b" * 50,), ("b" * 50,)], "text string").repartition(3)
    filled, bits = line_dedup.seen_twice(docs, line_dedup.Rule())
    assert bits == 1 << 20 and 1 <= sum(x.bit_count() for x in filled) <= 2  # the bits of b only


def test_line_dedup_of_nothing(spark):
    empty = traps(spark, [])
    assert line_dedup.deduplicated(empty, "lines", "dropped").collect() == []


# --- periodic runs

def brute_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items() if e - s >= least), key=lambda r: (r[0], r[2]))


def periodic_text(rng, n):
    kind, pick = rng.randrange(6), lambda letters, size: [rng.choice(letters) for _ in range(size)]
    if kind == 0:
        return pick("ab", n)
    if kind == 1:
        root = pick("abc", rng.randint(1, max(1, n // 2)))
        return (root * (n // len(root) + 1))[:n]
    if kind == 2:  # a long period made of a short one
        root = pick("ab", rng.randint(1, 4)) * rng.randint(2, 60) + pick("abc", rng.randrange(4))
        return (root * (n // len(root) + 1))[:n]
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:  # neighbouring runs of one small period
        root, out = pick("ab", rng.randint(1, 3)), []
        while len(out) < n:
            out += root * rng.randint(1, 90) + root[:rng.randrange(len(root) + 1)]
        return out[:n]
    return pick([f"w{i}" for i in range(500)], n)


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(25):
        texts = [[w.encode() for w in periodic_text(rng, rng.choice((0, 3, 12, 40, 150, 700)))] for _ in range(8)]
        for words, found in zip(texts, periodic_runs.runs_of(texts)):
            assert [tuple(map(int, r)) for r in found] == brute_runs(words)


def test_runs_of_highly_periodic_halves():
    """The case that no selected window covers: a first period that is periodic itself."""
    for times, extra in ((40, 2), (100, 1), (333, 2)):
        half = [b"a", b"b", b"c"] * times + [b"a", b"b", b"c"][:extra]
        assert [tuple(map(int, r)) for r in periodic_runs.runs_of([half * 2])[0]] == brute_runs(half * 2)


def test_runs_query_rules(spark, tmp_path):
    rows = EDGE + [(i, " ".join(["tick", "tock"] * 9 + [f"n{i}"])) for i in range(100, 140)] + [(200, "ho " * 11), (201, "ho " * 12)]
    traps(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = words_of(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            a, left = h // 10 % len(words), len(words) - h // 10 % len(words)
            p = 1 + left // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words) if len(words) < 5000 else None
        if runs is None:  # random words
            runs = [tuple(map(int, r)) for r in periodic_runs.runs_of([[w.encode() for w in words]])[0]]
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 35


def test_runs_keep_columns(spark):
    got = periodic_runs.with_runs(traps(spark, EDGE), "_found", "_kept")
    assert got.columns[-2:] == ["_found", "_kept"] and got.count() == len(EDGE)
    assert periodic_runs.with_runs(traps(spark, []), "_found", "_kept").collect() == []
    assert {r["token"] for r in got.collect()} == {"c"}


# --- spelling variants

def brute_variants(counts, min_chars=7, min_count=2, factor=10):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and one_apart(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= factor * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_rows():
    rng = random.Random(8)
    stems = ["anagramm", "bookkeeper", "aaaaaaaa", "Ünsinnig", "wörtlich", "mississippi", "L" * 80, "xy" * 32 + "z", "ÀÿÀÿÀÿÀÿ"]
    texts = []
    for _ in range(500):
        words = []
        for _ in range(30):
            w = rng.choice(stems)
            for _ in range(rng.choice((0,) * 12 + (1, 1, 2))):
                i, c = rng.randrange(len(w)), rng.choice("abàL")
                w = rng.choice((w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]))
            words.append(w)
        texts.append(rng.choice((" ", "1", "\n", "日")).join(words))
    return list(EDGE) + [(None if i % 50 == 0 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rule", [spelling.Rule(), spelling.Rule(literal=9, block=50)])
def test_spelling_variants(spark, rule):
    rows = spelling_rows()
    counts = Counter(w for _, t in rows for w in re.findall("[A-Za-zÀ-ÿ]+", lower(t or "")))
    got = spelling.groups(traps(spark, rows).repartition(3), rule).select("word", "n", "n_near", "form", "form_n", "root")
    want = brute_variants(counts)
    assert sorted(tuple(r) for r in got.collect()) == want
    forms = {w[0]: w[3] for w in want if w[3]}
    assert len(forms) > 100 and any(len(w) > 64 for w in forms) and any(forms.get(f) for f in forms.values())


def test_spelling_query_plants_deletions(spark, tmp_path):
    rows = spelling_rows()
    traps(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == brute_variants(counts)


def test_spelling_chains_and_nothing(spark):
    chain = [("aaaaaaaa" + "b" * i, 10 ** (6 - i)) for i in range(6)]  # each the form of the next
    words = spark.createDataFrame(chain, "word string, n long")
    got = {r["word"]: r for r in spelling.with_roots(spelling.variants(words)).collect()}
    assert {r["root"] for r in got.values()} == {"aaaaaaaa"} and got["aaaaaaaabbbbb"]["form"] == "aaaaaaaabbbb"
    assert spelling.groups(traps(spark, [])).collect() == []
    assert spelling.groups(traps(spark, [(1, None), (2, "")])).select(F.count("word")).first()[0] == 0


def test_rotations_of_long_words_agree():
    word, size = "ab" * 50, 100
    keys, skipped, first = spelling.rotations(word, 64)
    shorter = spelling.rotations(word[:40] + word[41:], 64)[0]
    assert keys[size + 1 + 40] == shorter[40] and skipped[size + 1 + 40] == word[40] and first[size + 1 + 40]
    assert len(set(keys)) == len(keys) and max(map(len, keys)) < 90
