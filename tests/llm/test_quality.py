import re
from collections import Counter

from convlens.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    w = W.findall(text or "")
    windows = list(zip(w, w[1:], w[2:]))
    times, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_figures_match_brute_force(docs, corpus):
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert len(got) == len(corpus)
    for i, text, _ in corpus:
        r = got[i]
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert own == figures(text), i
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["kept"] and r["base_failed"])


def test_overlapping_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b c d a b c e b c d", "x", "p q r p q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judged(rows).collect()}
    assert got == {i: figures(t)[4] for i, t in enumerate(texts)}


def test_estimate_finds_bad_texts():
    good, noisy, symbols, shouting = (1,) * 9, (1, 1, 1, 0, 1, 1, 1, 1, -1), (1, -1, -1, -1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1, 1, -1, -1)
    model = quality.fit_votes([(good, 900), (noisy, 5), (symbols, 60), (shouting, 40)], 9)
    assert model.posterior(good) > 0.9 and model.posterior((0,) * 9) > 0.5
    assert model.posterior(symbols) < 0.5 and model.posterior(shouting) < 0.5
    # bad texts are many: they must not swap places with the good ones
    model = quality.fit_votes([(good, 300), (symbols, 350), (shouting, 350)], 9)
    assert model.posterior(good) > 0.5 > model.posterior(symbols)


def test_filter_keeps_rows_as_they_came(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    judged = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == judged
    assert all(i in judged for i in range(12))


def test_empty_and_odd_tables(no_docs, odd_docs):
    assert quality.judged(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    assert quality.judged(odd_docs).count() == 7
    assert quality.keep_good(odd_docs).count() == 4
