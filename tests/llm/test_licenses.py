import random

from conftest import prose
from hypothesis import given
from hypothesis import strategies as st

from convlens.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j], 0) for j in range(1, len(b) + 1)] if False else _step(row, x, b)
    return row[-1]


def _step(row, x, b):
    new = [0]
    for j, y in enumerate(b, 1):
        new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
    return new


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)


@given(st.lists(st.integers(0, 30), unique=True, max_size=20), st.randoms())
def test_rising_is_the_longest(values, rng):
    pairs = list(enumerate(values))
    got = licenses.rising(pairs)
    best = [0] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    assert len(got) == max(best, default=0) and all(x < y for (_, x), (_, y) in zip(got, got[1:]))


def test_planted_notices_are_found(spark):
    rng, rows, want = random.Random(1), [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        words = text.split(" ")
        if len(words) > 12:  # an edit that leaves enough of it
            words[5] = "changed"
        rows.append((i, f"{prose(rng.randint(0, 900), i)}\n{' '.join(words).upper() if i % 2 else ' '.join(words)} the license {prose(50, 99 + i)}"))
        want[i] = [name]
    rows.append((100, " ".join([licenses.TEMPLATES["MIT"], prose(30, 3), licenses.TEMPLATES["GPL-3.0"], licenses.TEMPLATES["MIT"]])))
    want[100] = ["MIT", "GPL-3.0", "MIT"]
    rows += [(101, prose(3000, 8)), (102, "the license is under the license of the license " * 50), (103, ""), (104, None), (None, licenses.TEMPLATES["MIT"])]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("begin_word").collect():
        assert r["coverage"] >= 0.8 and r["end_word"] > r["begin_word"]
        got.setdefault(r["doc_id"], []).append(r["license"])
    want[None] = ["MIT"]
    assert got == want


def test_frequent_words_hide_nothing(spark):
    text = "released under the license mit version " * 300 + licenses.TEMPLATES["MIT"]
    got = licenses.Scanner(licenses.TEMPLATES).scan([text.encode()])[0]
    assert any(name == "MIT" and coverage == 1.0 for name, coverage, _, _ in got)


def test_empty_table(no_docs):
    assert licenses.scan(no_docs).count() == 0


def test_adjacent_copies_are_all_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL header"]
    names = lambda text: [(name, begin, end) for name, _, begin, end in scanner.scan([text.encode()])[0]]
    assert names(f"the year. {mit} {mit} the end") == [("MIT", 2, 7), ("MIT", 7, 12)]
    assert names(f"{mit} {mit} {mit}") == [("MIT", 0, 5), ("MIT", 5, 10), ("MIT", 10, 15)]
    m = len(gpl.replace(":", "").replace("/", " ").split())
    assert names(f"the software is under the license {gpl} {gpl} you can the") == [("GPL header", 6, 6 + m), ("GPL header", 6 + m, 6 + 2 * m)]
    # in each copy another word is changed
    assert len(names(f"the {gpl.replace('redistribute', 'x')} of {gpl.replace('terms', 'y')} the")) == 2


@given(st.lists(st.integers(0, 3), max_size=10), st.lists(st.integers(0, 3), max_size=8))
def test_nearest_is_exact(words, template):
    got = licenses.nearest(words, list(range(1, len(words) + 1)), template)
    assert len(got) == lcs(words, template) + 1
    for k, distance in enumerate(got[1:], 1):
        assert lcs(words[:distance], template) == k > lcs(words[: distance - 1], template)
