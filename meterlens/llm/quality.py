"""Quality by weak supervision: rules vote, and expectation-maximisation weighs the votes.

Every rule looks at one respect of a document and votes good, bad, or abstains between two bounds.
Rules know one respect each, so they conflict: a text full of symbols may well have sound sentences.
A rule has two accuracies: how often it votes good on a good document, and bad on a bad one; that it
abstains says nothing. Expectation-maximisation estimates both, and the share of good documents, from
how the rules agree: it computes each document's probability of being good under them, and them from
these probabilities, in turn. A document is judged by its posterior probability, not by having to
pass every rule: a fault that is common among otherwise good documents weighs little, and a good vote
of a rule that hardly tells the two apart does not save a document.

The counts are Spark expressions over the whole text. What the estimation needs is the number of
documents with each pattern of votes: 3 to the power of the rules at most, whatever the input.

Null and empty texts have no words: all counts are 0, all rules abstain and the document fails.
Repeated rows count and are judged each. Repeated three-word windows are told apart by 64-bit
hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import free_name

GOOD, BAD, SILENT = 1, -1, 0
LEAST_WORDS = 50
WINDOW_WORDS = 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, pattern: str) -> Column:
    return F.array_size(F.split(text, pattern, -1)) - 1


def _dup_lines(text: Column) -> Column:
    """(lines with a word, of these those equal to an earlier one)"""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _let(
        lines,
        lambda x: F.struct(
            F.array_size(x).alias("n"),
            (F.array_size(x) - F.array_size(F.array_distinct(x))).alias("dup"),
        ),
    )


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.array_size(w) - (WINDOW_WORDS - 1))
        return F.transform(
            starts,
            lambda n: F.xxhash64(*[F.element_at(w, n + k) for k in range(WINDOW_WORDS)]),
        )

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        done = F.aggregate(
            starts,
            zero,
            lambda a, s: F.struct(
                (a["n"] + s + WINDOW_WORDS - F.greatest(a["upto"], s)).alias("n"),
                (s + WINDOW_WORDS).alias("upto"),
            ),
        )
        return done["n"]

    def repeated(hashes: Column) -> Column:
        placed = F.sort_array(
            F.transform(hashes, lambda h, n: F.struct(h.alias("h"), n.alias("n")))
        )
        same = _let(
            placed,
            lambda p: F.filter(
                p,
                lambda x, k: (F.get(p, k - 1)["h"].eqNullSafe(x["h"]))
                | (F.get(p, k + 1)["h"].eqNullSafe(x["h"])),
            ),
        )
        return covered(F.sort_array(F.transform(same, lambda x: x["n"])))

    return F.when(F.array_size(words) < WINDOW_WORDS + 1, 0).otherwise(
        _let(
            windows(words),
            lambda h: F.when(F.array_size(F.array_distinct(h)) == F.array_size(h), 0).otherwise(
                repeated(h)
            ),
        )
    )


def counts(text: Column) -> Column:
    """All counts of a text as a struct of longs."""
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.array_size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("chars"),
            _repeat_words(w).alias("repeat"),
            F.array_size(F.array_distinct(w)).alias("distinct"),
        )

    def named(x: Column) -> Column:
        named_counts = {
            "n_words": x["words"]["n"],
            "word_chars": x["words"]["chars"],
            "n_symbols": _count(whole, r"[#*$%&|<>]"),
            "n_dup_lines": x["lines"]["dup"],
            "n_repeat_words": x["words"]["repeat"],
            "n_lines": x["lines"]["n"],
            "n_capitals": F.length(F.regexp_replace(whole, "[^A-Z]+", "")),
            "n_exclamations": _count(whole, "!"),
            "n_distinct_words": x["words"]["distinct"],
            "n_letters": F.length(whole) - F.length(F.regexp_replace(whole, r"\p{L}+", "")),
            "n_plain": _count(whole, r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]?+(?![^\x20\x09-\x0D])"),
            "n_ends": _count(whole, r"[.!?]+(?=[\x20\x09-\x0D]|\z)"),
        }
        return F.struct(*[c.cast("long").alias(name) for name, c in named_counts.items()])

    both = F.struct(_let(words, of_words).alias("words"), _dup_lines(whole).alias("lines"))
    return _let(both, named)


class Rule(NamedTuple):
    """Conditions on a struct of counts under which it votes good or bad; else it abstains."""

    name: str
    good: Callable[[Column], Column]
    bad: Callable[[Column], Column]


def _share(part: str, whole: str, good: float, bad: float, least: int = 1) -> tuple:
    """Good up to one share, bad from another one on (and from a number on)."""
    return (
        lambda c: c[part] <= good * c[whole],
        lambda c: (c[part] >= bad * c[whole]) & (c[part] >= least),
    )


RULES = (
    Rule("symbols", *_share("n_symbols", "n_words", 0.01, 0.05)),
    Rule("capitals", *_share("n_capitals", "word_chars", 0.12, 0.3)),
    Rule("exclamations", *_share("n_exclamations", "n_words", 0.02, 0.15)),
    Rule("lines", *_share("n_dup_lines", "n_lines", 0.0, 0.2)),
    Rule("windows", *_share("n_repeat_words", "n_words", 0.02, 0.15)),
    Rule(
        "variety",
        lambda c: c["n_distinct_words"] >= 0.25 * c["n_words"],
        lambda c: c["n_distinct_words"] <= 0.1 * c["n_words"],
    ),
    Rule(
        "word length",
        lambda c: c["word_chars"].between(3 * c["n_words"], 10 * c["n_words"]),
        lambda c: ~c["word_chars"].between(2 * c["n_words"], 15 * c["n_words"]),
    ),
    Rule(
        "letters",
        lambda c: c["n_letters"] >= 0.85 * c["word_chars"],
        lambda c: c["n_letters"] <= 0.7 * c["word_chars"],
    ),
    Rule(
        "plain words",
        lambda c: c["n_plain"] >= 0.8 * c["n_words"],
        lambda c: c["n_plain"] <= 0.6 * c["n_words"],
    ),
    Rule(
        "sentences",
        lambda c: (c["n_ends"] > 0) & c["n_words"].between(4 * c["n_ends"], 40 * c["n_ends"]),
        lambda c: ~c["n_words"].between(2 * c["n_ends"], 100 * F.greatest(c["n_ends"], F.lit(1))),
    ),
)


def votes(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One vote per rule, as an array of bytes."""
    some = found["n_words"] > 0
    cast = [
        F.when(some & r.bad(found), BAD).when(some & r.good(found), GOOD).otherwise(SILENT)
        for r in rules
    ]
    return F.array(*cast).cast("array<tinyint>")


#: Belief before any document is seen: a rule seldom accuses a good document, which is worth as many
#: votes as this share of the documents (faults come in kinds, and without it the estimation takes one
#: kind for all that is bad and the others for habits of good documents); and it sees some of the bad
#: ones, which is worth a few votes.
RIGHT_ON_GOOD, BELIEF = 0.99, 0.5
RIGHT_ON_BAD, FEW_VOTES = 0.3, 10.0
START_SHARE = 0.8
#: No accuracy or share goes beyond this, or under one less it.
MOST = 0.999


class VoteModel(NamedTuple):
    """How often each rule votes good on good documents and bad on bad ones, when it votes, and the
    share of good documents."""

    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    share: float

    def weights(self) -> list[tuple[float, float]]:
        """What a good and a bad vote of each rule add to the logarithm of the odds."""
        return [
            (log(g / (1 - b)), log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)
        ]

    def probability(self, pattern: tuple[int, ...]) -> float:
        odds = log(self.share / (1 - self.share))
        for vote, (good, bad) in zip(pattern, self.weights(), strict=True):
            odds += good if vote == GOOD else bad if vote == BAD else 0.0
        return 1 / (1 + exp(-odds))

    def posterior(self, cast: Column) -> Column:
        """Probability of being good, from a column of votes; the share if no rule votes."""
        odds = F.lit(log(self.share / (1 - self.share)))
        for n, (good, bad) in enumerate(self.weights()):
            vote = F.get(cast, F.lit(n))
            odds += F.when(vote == GOOD, good).when(vote == BAD, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, steps: int = 1000) -> VoteModel:
    """Expectation-maximisation over (votes, number of documents)."""

    def bounded(x: float) -> float:
        return min(MOST, max(1 - MOST, x))

    model = VoteModel((RIGHT_ON_GOOD,) * rules, (RIGHT_ON_BAD,) * rules, START_SHARE)
    # Documents on which every rule is silent say nothing about any of them.
    voted = [(p, n) for p, n in patterns if any(p)]
    belief = FEW_VOTES + BELIEF * sum(n for _, n in voted)
    for _ in range(steps):
        right = [[RIGHT_ON_GOOD * belief] * rules, [RIGHT_ON_BAD * FEW_VOTES] * rules]
        given = [[belief] * rules, [FEW_VOTES] * rules]
        good_ones, every = START_SHARE * FEW_VOTES, FEW_VOTES
        for pattern, n in voted:
            good = model.probability(pattern)
            good_ones += n * good
            every += n
            for k, vote in enumerate(pattern):
                if vote != SILENT:
                    for side, weight in enumerate((n * good, n * (1 - good))):
                        given[side][k] += weight
                        right[side][k] += weight * (vote == (GOOD, BAD)[side])
        was = model
        accuracies = [
            tuple(bounded(r / g) for r, g in zip(*side, strict=True))
            for side in zip(right, given, strict=True)
        ]
        model = VoteModel(*accuracies, bounded(good_ones / every))
        if max(abs(a - b) for a, b in zip(_flat(model), _flat(was), strict=True)) < 1e-10:
            break
    return model


def _flat(model: VoteModel) -> tuple[float, ...]:
    return (*model.on_good, *model.on_bad, model.share)


def fit(cast: DataFrame, column: str = "votes", rules: int = len(RULES)) -> VoteModel:
    """Estimate from a table of votes, one row per document."""
    patterns = cast.groupBy(F.col(column).alias("votes")).agg(F.count("*").alias("n")).collect()
    return estimate(sorted((tuple(r["votes"]), r["n"]) for r in patterns), rules)


def base_failed(found: Column) -> Column:
    """Too few words, or most words repeat."""
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > 50 * found["n_words"])


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that don't fail and are good with a probability of at least ``least``,
    with their own columns. The votes are counted in one pass and applied in another."""
    found, cast = free_name("counts", docs), free_name("votes", docs)
    voted = _with_votes(docs, F.col(text), found, cast)
    model = fit(voted, cast)
    kept = ~base_failed(F.col(found)) & (model.posterior(F.col(cast)) >= least)
    return voted.where(kept).select(*[docs[c] for c in docs.columns])


def _with_votes(docs: DataFrame, text: Column, found: str, cast: str) -> DataFrame:
    """Add the counts and the votes. They are generated columns, so that a filter by them does not
    repeat the counting in every place that names them."""
    counted = docs.select("*", F.explode(F.array(counts(text))).alias(found))
    return counted.select("*", F.explode(F.array(votes(F.col(found)))).alias(cast))
