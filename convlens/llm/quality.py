"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on the figures of a text. Nobody labels
anything: expectation-maximisation over the vote patterns of the whole corpus estimates how each
rule votes on good and on bad texts and how common good texts are, and the posterior probability
that a text is good replaces the usual "must pass every rule".

The corpus enters the estimate as one row per vote pattern (at most 3 ** rules rows, whatever the
corpus), so the fit is one aggregation and a few sums on the driver.

Defined results: a null text counts as empty; an empty or blank text has no word, fails the base
rules and is not kept; an empty table gives no rows and keeps the prior; repeated rows count as
often as they occur; columns of the input beside id and text are not read, so their names cannot
clash; a null id is passed through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the list."""

    def covered(at: Column) -> Column:
        # at: ascending starts of repeated windows; overlapping windows share their words
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated_starts(windows: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        kept = F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | ((i > 0) & same(x, F.get(windows, F.greatest(i - 1, F.lit(0))))))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def of(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _bind(_bind(placed, repeated_starts), covered)
        )

    def windows(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - 2)
        return F.transform(starts, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    return _bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_bind(windows(w), of)))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def text_figures(text: Column) -> Column:
    """Struct of the figures the rules read; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    count = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    return F.struct(
        _bind(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        (F.length(text) - count("[" + SYMBOLS + "]+")).alias("n_symbols"),
        _dup_lines(text).alias("n_dup_lines"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        (F.length(text) - count(r"[\p{Lu}]+")).alias("n_upper"),
        (F.length(text) - count(r"[!?]+")).alias("n_shouts"),
        F.regexp_count(text, F.lit("[" + SYMBOLS + "]+")).cast("long").alias("n_marks"),
    )


@dataclass(frozen=True)
class Rule:
    """good / bad: conditions over the figure columns; neither holds: the rule abstains."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Thresholds of the rules, as parameters of the method.
RULES = (
    Rule("length", lambda: F.col("n_words") >= 50, lambda: F.col("n_words") < 20),
    Rule("marks", lambda: _per("n_marks", "n_words") < 0.02, lambda: _per("n_marks", "n_words") > 0.15),
    Rule("symbol_share", lambda: _per("n_symbols", "word_chars") < 0.01, lambda: _per("n_symbols", "word_chars") > 0.04),
    Rule("symbols", lambda: _per("n_symbols", "n_words") < 0.02, lambda: _per("n_symbols", "n_words") > 0.1),
    Rule("repeats", lambda: _per("n_repeat_words", "n_words") < 0.1, lambda: _per("n_repeat_words", "n_words") > 0.3),
    Rule("lines", lambda: _per("n_dup_lines", "n_lines") < 0.1, lambda: _per("n_dup_lines", "n_lines") > 0.3),
    Rule("word_length", lambda: _per("word_chars", "n_words").between(3, 8), lambda: ~_per("word_chars", "n_words").between(2, 12)),
    Rule("capitals", lambda: _per("n_upper", "word_chars") < 0.1, lambda: _per("n_upper", "word_chars") > 0.3),
    Rule("shouting", lambda: _per("n_shouts", "n_words") < 0.05, lambda: _per("n_shouts", "n_words") > 0.2),
)

@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts; wrong[r]: how often rule r, when it votes on a good text, calls it
    bad; found[r]: how often, when it votes on a bad text, it calls it bad. Abstaining says nothing
    about a text: rules abstain alike on both classes."""

    prior: float
    wrong: tuple[float, ...]
    found: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """(log odds of a vote for good, of a vote for bad) of each rule."""
        return [(math.log((1 - w) / (1 - f)), math.log(w / f)) for w, f in zip(self.wrong, self.found)]

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        odds += sum((up if v > 0 else down) for (up, down), v in zip(self.weights(), votes) if v)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


#: Where the estimate starts and the belief (in texts) that holds each figure near it: a bad text
#: breaks some rules and passes most others, a good one hardly ever breaks any. The limits say that
#: rules are better than chance; without them two kinds of bad text that never break the same rule
#: could each make the other look good.
START = VoteModel(0.9, (0.005,), (0.3,))
BELIEF = 20.0
MOST_WRONG, LEAST_FOUND = 0.01, 0.1


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over (votes, number of texts)."""
    model = VoteModel(START.prior, START.wrong * rules, START.found * rules)
    for _ in range(rounds):
        shares = [(votes, n, model.posterior(votes)) for votes, n in patterns]

        def called_bad(r: int, start: float, mass: Callable[[int, float], float]) -> float:
            spoke = sum(mass(n, p) for votes, n, p in shares if votes[r])
            bad = sum(mass(n, p) for votes, n, p in shares if votes[r] < 0)
            return (bad + BELIEF * start) / (spoke + BELIEF)

        n_good, total = sum(n * p for _, n, p in shares), sum(n for _, n, _ in shares)
        model = VoteModel(
            (n_good + BELIEF * START.prior) / (total + BELIEF),
            tuple(min(MOST_WRONG, called_bad(r, START.wrong[0], lambda n, p: n * p)) for r in range(rules)),
            tuple(max(LEAST_FOUND, called_bad(r, START.found[0], lambda n, p: n * (1 - p))) for r in range(rules)),
        )
    return model


def with_figures(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct ``__figures``."""
    rows = rows.withColumn("__raw", text_figures(F.col(text)))
    flat = ["n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_shouts", "n_marks"]
    figures = {c: F.col(f"__raw.w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}
    figures |= {c: F.col(f"__raw.{c}") for c in flat}
    # the figures sit in one struct: no column of the input can clash with them
    rows = rows.withColumn("__figures", F.struct(*[v.alias(k) for k, v in figures.items()])).drop("__raw")
    return rows


def votes_of(rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of votes; reads the figure columns."""
    vote = lambda r: F.when(r.bad(), -1).when(r.good(), 1).otherwise(0)
    return F.array(*[vote(r) for r in rules])


def base_failed() -> Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def fit(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """Fit on all rows of a table of figure columns: one row per vote pattern comes to the driver."""
    patterns = figures.groupBy(votes_of(rules).alias("votes")).count().collect()
    return fit_votes(sorted((tuple(r["votes"]), r["count"]) for r in patterns), len(rules))


def posterior(model: VoteModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """Posterior probability that a row is good, as an expression over the figure columns."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, (up, down) in zip(rules, model.weights()):
        odds = odds + F.when(r.bad(), down).when(r.good(), up).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, figures, base_failed, posterior, kept. Figures are staged: the fit
    and the verdicts read a few numbers per text, and the texts are read once."""
    narrow = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("__text"))
    figures = stage(with_figures(narrow, "__text").select("doc_id", "__figures.*"), "quality-figures")
    model = fit(figures)
    return figures.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(model)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents the judgement keeps, with their columns as they came.

    The verdict is computed from the row itself, so no text is shuffled and a repeated or null id
    does no harm; the fit before it reads the texts once more.
    """
    narrow = docs.select(F.col(text).alias("__text"))
    model = fit(with_figures(narrow, "__text").select("__figures.*"))
    failed, good = base_failed(), posterior(model) >= threshold
    marked = with_figures(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), "__text")
    return marked.select("__row", "__figures.*").where(~failed & good).select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept"
    )
