import random
import re

import numpy as np
import pytest
from conftest import prose  # noqa: F401

from convlens.llm import passages
from convlens.llm.words import hashed_words, shingle_hashes

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(2)
    for n, width, high in ((80, 7, 2**60), (60, 5, 3), (40, 40, 2**60), (30, 31, 9)):
        values = (rng.integers(0, high, n).astype(np.uint64) << np.uint64(40)) if high < 100 else rng.integers(0, high, n).astype(np.uint64)
        begin, end = np.array([0, n // 2]), np.array([n // 2, n])
        number, lo, c, hi = passages.compact_windows(values, begin, end, width)
        for b, e in zip(begin, end):
            for i in range(b, e):
                for j in range(i + width - 1, e):
                    own = [k for k in range(len(c)) if lo[k] <= i <= c[k] <= j <= hi[k]]
                    assert len(own) == 1  # each passage lies in one window ...
                    top = values >> np.uint64(passages._BITS)
                    assert top[c[own[0]]] == top[i : j + 1].min()  # ... with its smallest value in the centre


def spans_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append((r["begin_word"], r["end_word"]))
    return out


def covered(spans, n):
    on = np.zeros(n + 1, bool)
    for a, b in spans:
        on[a:b] = True
    return on[:n]


def test_verbatim_passages_are_caught_but_one(docs, corpus):
    found = spans_of(passages.passages(docs).collect())
    texts = {i: (t or "") for i, t, _ in corpus}
    holders = {}
    for i, t in texts.items():
        words, _ = hashed_words([t.encode()], True)
        for p, h in enumerate(shingle_hashes(words, 50) if len(words) >= 50 else []):
            holders.setdefault(int(h), []).append((i, p))
    checked = 0
    for own in holders.values():
        if len({i for i, _ in own}) < 2:
            continue
        checked += 1
        whole = [i for i, p in own if not covered(found.get(i, []), 10**5)[p : p + 50].all()]
        assert len(set(whole)) <= 1
    assert checked > 100
    clean = {8, 9, 10, 11}  # share nothing with any other
    assert not clean & set(found)


@pytest.mark.parametrize("every", [50, 60])  # similarity 0.82 and 0.85
def test_edited_passages_are_caught(spark, every):
    from conftest import edited

    rows, n = [], 40
    for i in range(n):
        passage = prose(120, 5000 + i)
        rows += [(2 * i, prose(60, i) + " " + passage + " " + prose(50, 900 + i)), (2 * i + 1, prose(70, 300 + i) + " " + edited(passage, every, i) + " " + prose(30, 700 + i))]
    found = spans_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    caught = sum(2 * i in found or 2 * i + 1 in found for i in range(n))
    assert caught >= 0.95 * n
    for d, own in found.items():  # and little beyond them
        low, high = (60, 180) if d % 2 == 0 else (70, 190)
        assert all(a >= low - 12 and b <= high + 12 for a, b in own)


def test_passages_are_verified_for_similarity():
    x = list(range(100))
    y = x[:30] + [1000 + i for i in range(40)] + x[70:]
    assert passages.shared_passage(x, 10, y, 10) is None
    assert passages.shared_passage(x, 50, list(range(20, 90)), 30) == (20, 89, 0, 69)
    z = [500, 501, *x[20:45], 900, *x[46:80], 700]
    a, b, c, d = passages.shared_passage(x, 30, z, 12)
    assert (a, b) == (20, 79) and z[c] == 20 and z[d] == 79


def test_text_keeps_one_copy(docs, corpus):
    kept = passages.without_passages(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    texts = {i: t for i, t, _ in corpus}
    for i in (8, 9, 10, 11):
        assert got[i]["text"] == texts[i]
    joined = " ".join(r["text"] for r in got.values() if r["text"])
    passage = " ".join(W.findall(prose(70, 999)))
    assert " ".join(W.findall(joined)).count(passage) == 1
    assert " ".join(W.findall(joined)).count(texts[0]) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
    assert None in [r["text"] for r in got.values()] and "" in [r["text"] for r in got.values()]


def test_long_texts_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(passages, "_PIECE", 300)
    a, shared = prose(2000, 1), prose(400, 2)
    rows = spark.createDataFrame([(1, a + " " + shared), (2, shared + " " + prose(900, 3))], "doc_id long, text string")
    found = spans_of(passages.passages(rows).collect())
    (doc, own), = found.items()
    assert sum(b - a for a, b in passages_union(own)) >= 395 and doc in (1, 2)


def passages_union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_cut_words():
    assert passages.cut_words(b" a b  c\td ", [(1, 3)]) == b" a d "
    assert passages.cut_words(b"a b c", [(0, 1), (2, 3)]) == b"b"
    assert passages.cut_words(b"a b", [(0, 9)]) == b""
    assert passages.cut_words(b" a ", []) == b" a "


def test_empty_and_odd_tables(no_docs, odd_docs):
    assert passages.passages(no_docs).count() == 0 and passages.without_passages(no_docs).count() == 0
    assert passages.without_passages(odd_docs).where("text is null").count() == 3


def test_every_pair_of_windows_is_compared():
    """One original and copies that each differ from it in another word, so not from one another."""
    original = [f"w{i}" for i in range(60)]
    texts = [" ".join(original)]
    for i in range(5, 55, 5):
        own = original.copy()
        own[i] = f"other{i}"
        texts.append(" ".join(own))
    words = [hashed_words([t.encode()], True)[0] for t in texts]
    shingles = [shingle_hashes(w, 5).tolist() for w in words]
    # all hold the shingle at 31 and so one signature, the original comes last or in the middle
    holders = [s for s in shingles if s[31] == shingles[0][31]]
    for place in (0, 3, len(holders) - 1):
        rest = holders[1:]
        rows = [(k, 0, 31, s) for k, s in enumerate([*rest[:place], holders[0], *rest[place:]])]
        found = {r[0] for r in passages.group_spans(rows, [0] * len(rows), 80)}
        assert {k for k in range(1, len(rows)) if k >= place} <= found
        split = [k % 2 for k in range(len(rows))]
        found = {r[0] for r in passages.group_spans(rows, split, 80)}
        assert {k for k in range(place + 1, len(rows)) if split[k] != split[place]} <= found


@pytest.mark.parametrize("block", [1024, 4])
def test_passages_beside_a_frequent_line(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    line, rows = "all of these pages carry one line", []
    for i in range(12):  # twelve passages with the line inside, each in three texts with other surroundings
        passage = f"{prose(24, 40 + i)} {line} {prose(24, 80 + i)}"
        rows += [(3 * i + j, f"{prose(60, 1000 + 3 * i + j)} {passage} {prose(60, 2000 + 3 * i + j)}") for j in range(3)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = {i: [] for i in range(12)}
    for r in found:
        assert r["doc_id"] // 3 == r["source_doc_id"] // 3
        own[r["doc_id"] // 3].append(r)
    for x in own.values():
        assert len({r["doc_id"] for r in x}) == 2 == len({r["doc_id"] for r in x if r["n_words"] >= 54})


def test_stretches_inside_the_interval_are_tried():
    passage = list(range(100, 146))  # 46 shingles, five of them changed by a word
    other = passage[:30] + [900, 901, 902, 903, 904] + passage[35:]
    x = [1, 2, 3, *passage, *range(10, 40), 7]
    y = [4, 5, 6, 8, *other, *range(50, 80), 7]  # both go on to a phrase they share
    assert passages.shared_passage(x, 13, y, 14) == (3, 48, 4, 49)
    x, y = [7, *range(10, 40), *passage], [7, *range(50, 80), *other]
    assert passages.shared_passage(x, 41, y, 41) == (31, 76, 31, 76)
    # 52 words with the third one changed: 45 of 48 shingles, and the words before it count
    x, y = [*range(48), 500], [900, 901, 902, *range(3, 48), 600]
    a, b, c, d = passages.shared_passage(x, 20, y, 20)
    assert b - a + 1 >= passages.T and a <= 3 and b >= 47 and (a, b) == (c, d)
    assert passages.shared_passage(list(range(46)), 3, [*range(36), *range(700, 710)], 3) is None


def _brute(x, ix, y, iy, width):
    """Whether any two stretches around the shared shingle are similar."""
    for a in range(ix + 1):
        for c in range(max(ix, a + width - 1), len(x)):
            sx = set(x[a : c + 1])
            for b in range(iy + 1):
                for d in range(max(iy, b + width - 1), len(y)):
                    sy = set(y[b : d + 1])
                    n = len(sx & sy)
                    if 100 * n >= 80 * (len(sx) + len(sy) - n):
                        return True
    return False


def test_stretches_match_brute_force():
    rng, seen = random.Random(4), [0, 0]
    for _ in range(1500):
        x = list(range(rng.randint(10, 18)))
        y, fresh = [], 100
        for v in x:
            if rng.random() < 0.15 and v != 6:
                if rng.random() < 0.6:
                    y.append(fresh)
                fresh += 1
            else:
                y.append(v)
        y = [200 + i for i in range(rng.randint(0, 4))] + y + [300 + i for i in range(rng.randint(0, 4))]
        ix, iy = 6, y.index(6)
        if len(y) < 10:
            continue
        want, got = _brute(x, ix, y, iy, 10), passages.shared_passage(x, ix, y, iy, 80, 10)
        assert (got is not None) == want
        seen[want] += 1
    assert min(seen) > 30


def test_recall_at_the_threshold(spark):
    """Passages of 50 words at a similarity of 0.80, beside a phrase that both texts hold."""
    rows, n = [], 150
    for i in range(n):
        words = prose(50, 8000 + i).split(" ")
        other = words[:24] + [f"new{i}"] + words[25:]  # five of 46 shingles: 41 of 51, 0.804
        foot = prose(6, 70_000 + i)
        rows += [(2 * i, f"{prose(60, i)} {' '.join(words)} {prose(15, 900 + i)} {foot}"), (2 * i + 1, f"{prose(50, 300 + i)} {' '.join(other)} {prose(22, 500 + i)} {foot}")]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    caught = {r["doc_id"] // 2 for r in found}
    assert len(caught) >= 0.97 * n, len(caught)


def test_bits_never_leave_out_a_pair():
    rng = np.random.default_rng(8)
    for trial in range(60):
        size = int(rng.integers(2, 30))
        pool = rng.integers(0, 2**63, int(rng.integers(30, 400))).astype(np.uint64)  # repeats in small pools
        rows = [rng.choice(pool, int(rng.integers(45, 92))) for _ in range(size)]
        sig = np.sort(rng.integers(0, 5, size))
        number = np.array([len(r) for r in rows])
        bits, beyond = passages.interval_bits(np.concatenate(rows), np.cumsum(number) - number, number)
        may = passages.sharing(sig, bits, beyond, 36)
        for i in range(size):
            most = max([len(set(rows[i]) & set(rows[j])) for j in range(size) if j != i and sig[j] == sig[i]], default=0)
            assert may[i] or most < 36
    far = [rng.integers(0, 2**63, 91).astype(np.uint64) for _ in range(40)]
    bits, beyond = passages.interval_bits(np.concatenate(far), np.arange(40) * 91, np.full(40, 91))
    assert not passages.sharing(np.zeros(40, np.int64), bits, beyond, 36).any()


def test_density_around_the_centre():
    rng = np.random.default_rng(9)
    for trial in range(300):
        n, width = int(rng.integers(8, 25)), 8
        flags, centre = rng.random(n) < rng.uniform(0.5, 1), int(rng.integers(0, n))
        want = any(
            100 * flags[a : b + 1].sum() >= 80 * (b + 1 - a)
            for a in range(centre + 1) for b in range(max(centre, a + width - 1), n)
        )
        assert passages._dense(flags[None], centre, 80, width)[0] == want


def near_copies(n, seed, every=14):
    """Shingles of n texts of one passage, each with other words changed, and windows around one shingle that all hold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(110)]
    rows = []
    for k in range(n):
        own = [f"x{k}_{i}" if rng.random() < 1 / every and not 50 <= i < 60 else w for i, w in enumerate(base)]
        words = hashed_words([" ".join(own).encode()], True)[0]
        cut = rng.randint(0, 20)
        rows.append((k, cut, 52 - cut, shingle_hashes(words, 5).tolist()[cut : 106 - rng.randint(0, 20)][:91]))
    return rows


@pytest.mark.parametrize("blocks", [1, 2])
def test_no_shared_shingle_of_a_pair_is_left_out(blocks):
    seen = 0
    for seed in range(12):
        rows = near_copies(25, seed, every=(14, 30)[seed % 2])
        if seed % 3 == 0:  # some that repeat shingles, some in another order
            rows = [(k, f, c, [*s[10:20], *s[10:]] if k % 4 == 0 and c > 20 else [*s[:70], *s[80:85], *s[70:80], *s[85:]]) for k, f, c, s in rows]
        block = [k % blocks for k in range(len(rows))]
        found = {}
        for r in passages.group_spans(rows, block, 80):
            found[r[0]] = (r[2], r[3] - passages.WORDS, r[1])
        for i, x in enumerate(rows):
            for j in range(i):
                pair = passages.shared_passage(x[3], x[2], rows[j][3], rows[j][2], 80)
                if pair is None or (blocks > 1 and block[i] == block[j]):
                    continue
                a, b, c, d = pair
                other = set(rows[j][3][c : d + 1])
                both = [p for p in range(a, b + 1) if x[3][p] in other]
                assert x[0] in found and found[x[0]][0] <= x[1] + both[0] and x[1] + both[-1] <= found[x[0]][1]
                assert all(s < x[0] for s in found[x[0]][2])
                seen += 1
    assert seen > 300


def test_copies_are_verified_in_proportion_to_their_number(monkeypatch):
    """Every one of n near copies is verified with a few others, not with all before it, and gives one row."""
    calls, verify = [], passages.shared_passage
    monkeypatch.setattr(passages, "shared_passage", lambda *a: calls.append(1) or verify(*a))
    rows = near_copies(150, 1, every=30)
    found = passages.group_spans(rows, [0] * len(rows), 80)
    assert len({r[0] for r in found}) == len(found) > 100
    assert len(calls) < 4 * len(rows)


@pytest.mark.parametrize("block", [1024, 4])
def test_one_row_for_each_text_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(passages, "BLOCK", block)
    passage = prose(70, 31)
    rows = [(i, f"{prose(60, 100 + i)} {passage} {prose(60, 600 + i)}") for i in range(40)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len({r["doc_id"] for r in found}) == 39
    assert all(r["n_words"] >= 70 and r["source_doc_id"] in r["source_doc_ids"] and r["doc_id"] not in r["source_doc_ids"] for r in found)
    linked = {i: i for i in range(40)}  # all are reached by the links
    for r in found:
        for s in r["source_doc_ids"]:
            a, b = linked[r["doc_id"]], linked[s]
            linked = {k: a if v == b else v for k, v in linked.items()}
    assert len(set(linked.values())) == 1


def windows_of_copies(n, seed):
    """Rows of one signature: stretches of one text of 91 shingles around its middle, of other lengths and with other words."""
    rng = np.random.default_rng(seed)
    base, rows = np.arange(1, 92), []
    for key in range(n):
        own = base.copy()
        hit = rng.choice(np.delete(np.arange(91), 45), rng.integers(0, 14), replace=False)
        own[hit] = 1000 * (key + 1) + hit
        if key % 7 == 0:
            own[rng.integers(0, 45)] = own[50]  # repeats a shingle
        a, b = rng.integers(0, 30), rng.integers(76, 92)
        rows.append((int(key), 0, int(45 - a), own[a:b].tolist()))
    return rows


def test_windows_looked_at_in_order_of_shares_give_what_all_of_them_give(monkeypatch):
    rows = windows_of_copies(160, 4)
    blocks = [k % 2 for k in range(160)]
    every = []
    for ahead in (10_000, 32, 1):
        monkeypatch.setattr(passages, "AHEAD", ahead)
        every.append((passages.group_spans(rows, [0] * 160, 80), passages.group_spans(rows, blocks, 80)))
    assert every[0] == every[1] == every[2] and len(every[0][0]) > 100


def test_a_group_of_copies_does_not_look_at_every_pair_in_full(monkeypatch):
    looked, own = [], passages._both_reach
    monkeypatch.setattr(passages, "_both_reach", lambda place, *a: looked.append(len(place)) or own(place, *a))
    base = list(range(1, 92))
    rows = [(k, 0, 45, [*base[:89], 10_000 + k, 20_000 + k]) for k in range(300)]
    assert len(passages.group_spans(rows, [0] * 300, 80)) == 299
    assert sum(looked) <= 299 * passages.AHEAD  # 44,850 pairs
