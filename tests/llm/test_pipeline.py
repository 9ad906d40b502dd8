import re

import corpus_pipeline
import pytest
from conftest_tools import components_of

from convlens.llm import mixing, passages, quality

DIR = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents and of each stage's output."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(function(spark, out[-1], DIR), f"test-{name}"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in quality.judged(stages[0]).where("kept").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()


def test_near_duplicate_stage(stages):
    sets = {}
    for r in stages[1].collect():
        words = W.findall(r["text"].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components_of(sets, links)
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(i for i in sets if root[i] == i)


def test_passage_stage(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    spans = {}
    for r in passages.passages(stages[2]).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["begin_word"], r["end_word"]))
    for i, r in before.items():
        left = [w for p, w in enumerate(W.findall(r["text"])) if p not in spans.get(i, ())]
        assert (i in after) == bool(left)
        if left:
            assert W.findall(after[i]["text"]) == left and after[i]["n_chars"] == len(after[i]["text"])


def test_mix_stage(stages):
    sized, targets, lines = mixing._planned(stages[3])
    want = {r["doc_id"]: r["copies"] for r in mixing.with_copies(sized, targets, lines).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == want


def test_token_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r["ids"] == whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows)


def test_run_and_empty_table(spark, stages, no_docs):
    ran = corpus_pipeline.run(spark, DIR)
    assert sorted(map(str, ran.drop("ids").collect())) == sorted(map(str, stages[5].drop("ids").collect()))
    docs = no_docs
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, DIR)
    assert docs.count() == 0


def test_rows_with_nulls(spark, odd_docs):
    docs = odd_docs
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(function(spark, docs, DIR), f"test-odd-{name}")
    assert docs.count() > 0
