"""Language identification by words first, with backoff to shorter and shorter n-grams.

A model holds, for every language, the logarithms of the relative frequencies of all its words and
character n-grams. A word that the model knows is scored by its own frequencies. For any other word
the longest n-grams are tried, then shorter ones, down to single letters; the first length of which
any n-gram is known gives the score, as the mean over the known ones. A text's score is the sum over
its words, and the language with the highest wins; of equal ones the first by name.

The counts are taken over all training rows by Spark and stay in stored tables, whole and for any
number of languages. The words seen most often are broadcast with their scores in all languages, as
many as ``COMMON_CELLS`` allows; texts are scored by these where they lie. Words of a text that are
not among them are looked up in the tables by joins, each distinct word once. Which words are
broadcast changes the cost, never a score: scores are whole billionths, so sums have no order. A word
that is looked up goes with its text as a 64-bit hash; the word itself is handed on once a task.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing
was learned. Rows without a language teach nothing. Repeated rows count each.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import (
    Memo,
    fit_to_broadcast,
    small_batches,
    stored,
    text_slices,
)

LONGEST_GRAM = 4
#: Scores (words times languages) that are broadcast; all others are joined.
COMMON_CELLS = 1_000_000
#: Scores of n-grams of one length up to which Spark may broadcast their table.
GRAM_CELLS = 1_000_000
#: Score (base 10 logarithm) of what a language does not know.
UNSEEN = -7.0
UNKNOWN = "und"

#: A gain is how far a score lies above ``UNSEEN``, in parts of this size.
PARTS = 1_000_000_000

#: Pieces of text that a worker remembers.
CHUNKS = 500_000

PREDICTION = "lang string, score double"
GAINS = "array<struct<place: int, gain: long>>"
SCORED = (
    "gains array<long>, words long, rest array<struct<w: long, n: int>>, "
    "new array<struct<w: long, word: string>>"
)

_letters = regex.compile(r"\p{L}+")


def words_in(chunk: str) -> list[str]:
    """Lower-case words of a piece of text; words are runs of letters."""
    low = chunk.lower()
    return [low] if low.isalpha() else _letters.findall(low)


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word with a blank at both ends; single ones are letters only."""
    padded = word if size == 1 else f" {word} "
    return [padded[n : n + size] for n in range(len(padded) - size + 1)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each word by language, summed as far as a task's memory allows."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        words = {lang: Counter() for lang in counts}
        for lang, chunks in counts.items():
            for chunk, n in chunks.items():
                for word in words_in(chunk):
                    words[lang][word] += n
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang for lang, c in words.items() for _ in c], pa.string()),
                pa.array([w for c in words.values() for w in c], pa.string()),
                pa.array([n for c in words.values() for n in c.values()], pa.int64()),
            ],
            ["lang", "word", "n"],
        )

    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang.as_py(), Counter()).update(text.as_py().split())
        if sum(map(len, counts.values())) > 500_000:
            yield rows(counts)
            counts = {}
    yield rows(counts)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of words by language and size, summed as far as a task's memory allows."""

    def rows(counts: dict[tuple[str, int], Counter]) -> pa.RecordBatch:
        flat = [(lang, size, g, n) for (lang, size), c in counts.items() for g, n in c.items()]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        columns = [pa.array([r[k] for r in flat], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "size", "entry", "n"])

    counts: dict[tuple[str, int], Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for size in range(1, LONGEST_GRAM + 1):
                own = counts.setdefault((lang, size), Counter())
                for g in grams(word, size):
                    own[g] += n
        if sum(map(len, counts.values())) > 500_000:
            yield rows(counts)
            counts = {}
    yield rows(counts)


class LanguageModel:
    """Languages, and tables of words and n-grams (``entry``), each with its gain in every language
    that has it (``gains``, by place among the languages)."""

    def __init__(self, languages: list[str], word_table: DataFrame, gram_table: DataFrame):
        self.languages, self.word_table, self.gram_table = languages, word_table, gram_table

    def _scores(self, table: DataFrame) -> dict[str, list[float]]:
        out: dict[str, list[float]] = {}
        for r in table.select("entry", "gains").collect():
            row = out[r["entry"]] = [UNSEEN] * len(self.languages)
            for place, gain in r["gains"]:
                row[place] = UNSEEN + gain / PARTS
        return out

    # Whole tables on the driver, to look at small models; predictions do not use them.

    @cached_property
    def words(self) -> dict[str, list[float]]:
        return self._scores(self.word_table)

    @cached_property
    def grams(self) -> dict[str, list[float]]:
        return self._scores(self.gram_table)

    def word_scores(self, word: str) -> list[float]:
        known = self.words.get(word)
        if known is not None:
            return known
        for size in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = map(self.grams.get, grams(word, size))
            found = [scores for scores in known if scores is not None]
            if found:
                return [sum(scores) / len(found) for scores in zip(*found, strict=True)]
        return [UNSEEN] * len(self.languages)


def _top(counts: DataFrame, most: int, *groups: str) -> DataFrame:
    """The most frequent entries of each group, at most so many; entries with equal counts are
    all in or all out. How many entries have which count gives the least count to take, so
    nothing is sorted and no task gets all entries of a language."""
    upto = F.sum("entries").over(W.partitionBy(*groups).orderBy(F.desc("n")))
    least = (
        counts.groupBy(*groups, "n")
        .agg(F.count("*").alias("entries"))
        .withColumn("upto", upto)
        .where(F.col("upto") <= most)
        .groupBy(*groups)
        .agg(F.min("n").alias("least"))
    )
    # One row for each group.
    return counts.join(F.broadcast(least), list(groups)).where("n >= least").drop("least")


def _gram_column(word: Column, size: int) -> Column:
    """The n-grams of a word, as ``grams`` gives them, with their size."""
    padded = word if size == 1 else F.concat(F.lit(" "), word, F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1)))
    pieces = F.transform(
        starts,
        lambda n: F.struct(F.lit(size).alias("size"), F.substr(padded, n, F.lit(size)).alias("entry")),
    )
    return F.filter(pieces, lambda p: F.length(p["entry"]) == size)


def _with_gains(counts: DataFrame, places: DataFrame, *keys: str) -> DataFrame:
    """One row per entry, with its gains by language and its count over all languages."""
    totals = counts.groupBy("lang", *keys).agg(F.sum("n").alias("total")).join(places, "lang")
    share = F.log10(F.col("n") / F.col("total"))
    gain = F.round((F.greatest(share, F.lit(UNSEEN)) - UNSEEN) * PARTS).cast("long")
    # One row for each language (and size of n-gram).
    return (
        counts.join(F.broadcast(totals), ["lang", *keys])
        .groupBy(*keys, "entry")
        .agg(
            F.sum("n").alias("n"),
            F.collect_list(F.struct("place", gain.alias("gain"))).cast(GAINS).alias("gains"),
        )
    )


def learn(rows: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """A model from rows with a text and a language."""
    spark = rows.sparkSession
    small_batches(spark)
    labelled = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    words = stored(
        labelled.mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", F.col("word").alias("entry"))
        .agg(F.sum("n").alias("n")),
        "words",
    )
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    places = spark.createDataFrame(
        [(name, n) for n, name in enumerate(languages)], "lang string, place int"
    )
    counted = (
        words.select("lang", "entry", "n")
        .mapInArrow(_gram_counts, "lang string, size int, entry string, n long")
        .groupBy("lang", "size", "entry")
        .agg(F.sum("n").alias("n"))
    )
    return LanguageModel(
        languages,
        stored(_with_gains(words, places), "vocabulary"),
        stored(_with_gains(stored(counted, "grams"), places, "size"), "gram_gains"),
    )


class _Scorer:
    """Gains of texts by the common words; pieces between white space are remembered."""

    def __init__(self, common: tuple[dict[str, int], np.ndarray]):
        self.places, self.gains = common
        self.chunks = Memo(self._chunk, CHUNKS)

    def _chunk(self, chunk: str) -> tuple[int | tuple[int, str], ...]:
        """Places of common words, and other words as they are, with their hashes."""
        return tuple(
            place if (place := self.places.get(w)) is not None else (_hash(w), w) for w in words_in(chunk)
        )

    def score(self, text: str | None) -> tuple[list[int], int, dict[tuple[int, str], int]]:
        """Gains of the common words, number of all words, and the other words with counts."""
        at, times, rest = [], [], {}
        for chunk, n in Counter(text.split() if text else ()).items():
            for word in self.chunks[chunk]:
                if word.__class__ is int:
                    at.append(word)
                    times.append(n)
                else:
                    rest[word] = rest.get(word, 0) + n
        gains = np.array(times, np.int64) @ self.gains[np.array(at, np.int64)]
        return gains.tolist(), sum(times) + sum(rest.values()), rest


def _hash(word: str) -> int:
    """64 bits, signed."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: The scorer of the model that this worker used last, by the model's name.
_scorers: dict[str, _Scorer] = {}


def _scorer(name: str, common) -> _Scorer:
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = _Scorer(common.value)
    return _scorers[name]


#: Words that a task remembers to have handed on.
GIVEN = 1_000_000


def _score(common):
    """common: broadcast places of words, and their gains by place. The last column is the text;
    those before it are kept. A word that is not common is named by its hash; the word itself is
    handed on with the first text of the task that has it."""
    name = uuid.uuid4().hex

    def pairs(rows: list[list[tuple]], kinds: list[pa.Field]) -> pa.Array:
        sizes = np.cumsum([0, *map(len, rows)])
        flat = [pa.array([p[n] for r in rows for p in r], kind.type) for n, kind in enumerate(kinds)]
        return pa.ListArray.from_arrays(
            pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(flat, fields=kinds)
        )

    w, n = pa.field("w", pa.int64()), pa.field("n", pa.int32())
    word = pa.field("word", pa.string())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, given = _scorer(name, common), set()
        for batch in batches:
            gains, words, rest, new = [], [], [], []
            for part in text_slices(batch.columns[-1]):
                scorer.chunks.trim()
                if len(given) > GIVEN:
                    given.clear()
                for text in part:
                    gain, count, others = scorer.score(text)
                    gains.append(gain)
                    words.append(count)
                    rest.append([(key[0], times) for key, times in others.items()])
                    new.append(fresh := [key for key in others if key[0] not in given])
                    given.update(key[0] for key in fresh)
            columns = [
                pa.array(gains, pa.list_(pa.int64())),
                pa.array(words, pa.int64()),
                pairs(rest, [w, n]),
                pairs(new, [w, word]),
            ]
            kept = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], [*kept, "gains", "words", "rest", "new"]
            )

    return score


def _common(model: LanguageModel) -> tuple[dict[str, int], np.ndarray]:
    """The words seen most often, as many as may be broadcast, with their gains."""
    count = len(model.languages)
    words = _top(model.word_table.withColumn("all", F.lit(0)), COMMON_CELLS // count, "all")
    table = _dense(words, count, "word").toArrow()
    gains = np.stack([table[f"g{n}"].to_numpy() for n in range(count)], axis=1)
    return {word: n for n, word in enumerate(table["word"].to_pylist())}, gains


def _dense(table: DataFrame, languages: int, key: str) -> DataFrame:
    """The gains of a table's entries as one column per language, 0 where it has none."""

    def gain(place: int) -> Column:
        own = F.filter("gains", lambda g: g["place"] == place)
        return F.coalesce(F.get(own, F.lit(0))["gain"], F.lit(0).cast("long")).alias(f"g{place}")

    return table.select(F.col("entry").alias(key), *map(gain, range(languages)))


def _gains_of(words: DataFrame, model: LanguageModel) -> DataFrame:
    """Gains (g0, g1, ...) of distinct words (w, word), by their own counts or else by n-grams."""
    count = len(model.languages)
    names = [f"g{n}" for n in range(count)]
    table = _dense(model.word_table, count, "word")
    looked = stored(words.join(table, "word", "left"), "looked")
    out = looked.where("g0 IS NOT NULL").select("w", *names)
    left = looked.where("g0 IS NULL").select("w", "word")
    for size in range(LONGEST_GRAM, 0, -1):
        if left.isEmpty():
            break
        grams_of = stored(
            _dense(model.gram_table.where(F.col("size") == size), count, "entry"), "dense"
        )
        pieces = left.select("w", F.explode(_gram_column(F.col("word"), size)).alias("g"))
        met = pieces.select("w", F.col("g.entry").alias("entry")).join(
            fit_to_broadcast(grams_of, GRAM_CELLS // count), "entry"
        )
        mean = [F.round(F.sum(g) / F.count("*")).cast("long").alias(g) for g in names]
        found = stored(met.groupBy("w").agg(*mean), "found")
        out = out.unionByName(found)
        left = stored(left.join(found.select("w"), "w", "left_anti"), "left")
    return out


def _decide_udf(languages: list[str]):
    kind = pa.struct({"lang": pa.string(), "score": pa.float64()})

    def decide(gains: list[int], words: int, more: list[int] | None) -> dict:
        if not words:
            return {"lang": UNKNOWN, "score": 0.0}
        total = np.array(gains, np.int64)
        if more is not None:
            total += np.array(more, np.int64)
        best = int(total.argmax())
        # Probability of the best, were each word an independent draw from a language.
        share = np.sum(10.0 ** np.maximum((total - total[best]) / PARTS, -300))
        return {"lang": languages[best], "score": 1 / float(share)}

    @F.arrow_udf(PREDICTION)
    def decided(gains: pa.Array, words: pa.Array, more: pa.Array) -> pa.Array:
        columns = (c.to_pylist() for c in (gains, words, more))
        return pa.array([decide(*row) for row in zip(*columns, strict=True)], kind)

    return decided


def with_language(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    into: str = "predicted",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct of the predicted language and its score. ``keep`` names the columns to keep; all
    by default."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    kept = [F.col(f"`{c}`") for c in columns]
    if not model.languages:
        unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        return docs.select(*kept, unknown.alias(into))
    rows = docs.select(
        *[c.alias(f"kept{n}") for n, c in enumerate(kept)], F.col(text).alias("text")
    )
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string(SCORED).fields])
    step = _score(spark.sparkContext.broadcast(_common(model)))
    # The ids of rows are written with them, so they stay the same.
    scored = stored(
        rows.mapInArrow(step, schema).withColumn("row", F.monotonically_increasing_id()), "scored"
    )
    words = scored.select(F.inline("new")).groupBy("w").agg(F.first("word").alias("word"))
    names = [f"g{n}" for n in range(len(model.languages))]
    sums = [F.sum(F.col("n") * F.col(g)) for g in names]
    more = (
        scored.select("row", F.inline("rest"))
        .join(stored(_gains_of(words, model), "gains"), "w")
        .groupBy("row")
        .agg(F.array(*sums).alias("more"))
    )
    decided = _decide_udf(model.languages)(F.col("gains"), F.col("words"), F.col("more"))
    return (
        scored.drop("rest", "new")
        .join(more, "row", "left")
        .select(*[F.col(f"kept{n}").alias(c) for n, c in enumerate(columns)], decided.alias(into))
    )
