"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A word's encoding always starts with the encoding of one of its prefixes. So the encoding
of a prefix is found from those of shorter ones: of all tokens that end it, exactly one
follows the last token of what stands before it as the merges would have it. One stored
token and count per prefix are enough, and no prefix is encoded from its start again. The
column holds the counts of prefixes that end with a word; prefixes that end inside a word are
counted where a budget is asked for, in the one word that crosses it.

Null and empty texts have no prefix and no tokens. Repeated rows are counted each. Other
columns are kept as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import Memo, small_batches, text_slices
from meterlens.llm.vocabulary import (
    DEFAULT_VOCABULARY,
    SPACE,
    WORD_END,
    vocabulary,
    words_of,
)

#: Words, pieces and pairs of tokens that a worker remembers of each.
CACHED = 800_000

PREFIX_TYPE = "ends array<int>, tokens array<int>"


class PrefixCounts:
    """Token counts of the prefixes of words."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.vocabulary = vocabulary(path)
        self._follows: dict[tuple[str, str], bool] = {}
        self._pieces = Memo(lambda piece: self.piece(piece)[1][-1], CACHED)
        self.words = Memo(self.word, CACHED)

    def follows(self, last: str, token: str) -> bool:
        """Whether the merges leave these two tokens as they are when one follows the other.
        At the start of a word nothing comes before, and ``last`` is empty."""
        pair = (last, token)
        found = self._follows.get(pair)
        if found is None:
            ids, ending = self.vocabulary.ids, token.endswith(WORD_END)
            together = self.vocabulary.encoded(last + token.removesuffix(WORD_END), ending)
            if len(self._follows) > CACHED:
                self._follows.clear()
            found = together == ([ids[last], ids[token]] if last else [ids[token]])
            self._follows[pair] = found
        return found

    def piece(self, piece: str, every: bool = False) -> tuple[list[int], list[int]]:
        """Counts of a piece's prefixes from length 0: inside a word, and as words of their own
        (these only for the whole piece unless ``every``)."""
        size, longest, ids = len(piece), self.vocabulary.longest, self.vocabulary.ids
        known, follows = self._follows.get, self.follows
        lasts, inside, alone = [""], [0], [0] if every else []
        ends = [(end, "") for end in range(1, size + every)]
        ends += [(end, WORD_END) for end in range(1 if every else size, size + 1)]
        for end, mark in ends:
            for start in range(max(0, end - longest), end):
                token = piece[start:end] + mark if mark else piece[start:end]
                if token in ids:
                    last = lasts[start]
                    fits = known((last, token))
                    if follows(last, token) if fits is None else fits:
                        break
            else:
                raise ValueError(f"the vocabulary has no symbol for {piece[:end]!r}")
            if mark:
                alone.append(inside[start] + 1)
            else:
                lasts.append(token)
                inside.append(inside[start] + 1)
        return inside, alone

    def word(self, word: str) -> int:
        """Tokens of what stands between white space."""
        parts = self.vocabulary.parts(word)
        return sum(1 if isinstance(p, int) else self._pieces[p] for p in parts)

    def longest(self, word: str, budget: int) -> int:
        """Code points of the longest prefix of a word that has at most so many tokens. Counts may
        fall as a prefix grows, so no prefix of the piece that crosses the budget is left out."""
        parts, size = self.vocabulary.parts(word), {}
        for c in set(word):
            size[c] = sum(len(p) if isinstance(p, str) else 0 for p in self.vocabulary.parts(c))
        ends = np.cumsum([0, *map(size.__getitem__, word)])
        if any(isinstance(p, int) for p in parts) or ends[-1] != sum(map(len, parts)):
            # Special strings, or code points that are joined with others: each prefix by itself.
            return next((n for n in range(len(word), 0, -1) if self.word(word[:n]) <= budget), 0)
        most = (budget + 1) * self.vocabulary.longest
        left, base = budget, 0
        for piece in parts:
            # A prefix of so many symbols has more tokens than are left.
            whole = self._pieces[piece] if len(piece) <= most else left + 1
            if whole > left:
                break
            left, base = left - whole, base + len(piece)
        else:
            return len(word)
        first, last = np.searchsorted(ends, [base, base + min(len(piece), most)], "right") - 1
        if len(piece) <= 3:  # such as 'll, which is no piece when it is cut
            fits = (n for n in range(last, first, -1) if self.word(word[:n]) <= budget)
        else:
            _, alone = self.piece(piece[:most], every=True)
            fits = (n for n in range(last, first, -1) if alone[ends[n] - base] <= left)
        return int(next(fits, first))

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends (in code points) of the prefixes that end with a word, and their tokens."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        words = words_of(text)
        counts = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return ends, np.cumsum(counts)

    def tidy(self) -> None:
        self.words.trim()
        self._pieces.trim()


@lru_cache(maxsize=2)
def _counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def _prefix_udf(path: str):
    @F.arrow_udf(PREFIX_TYPE)
    def prefixes(texts: pa.Array) -> pa.Array:
        counter = _counts(path)
        ends, tokens, sizes = [], [], [0]
        for part in text_slices(texts):
            counter.tidy()
            for text in part:
                found = counter.text(text or "")
                ends.append(found[0])
                tokens.append(found[1])
                sizes.append(len(found[0]))
        offsets = pa.array(np.cumsum(sizes), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([[], *x]).astype("int32")))
            for x in (ends, tokens)
        ]
        return pa.StructArray.from_arrays(lists, ["ends", "tokens"])

    return prefixes


def with_prefix_counts(
    docs: DataFrame, text: str = "text", into: str = "prefixes", path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """Add a struct of two arrays: the ends of all prefixes that end with a word, in code
    points, and the exact number of tokens up to there."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _prefix_udf(path)(F.col(text)))


def token_count(prefixes: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefixes["tokens"], F.lit(-1)), F.lit(0)).cast("long")


def _longest_udf(path: str):
    @F.arrow_udf("long")
    def longest(words: pa.Array, budgets: pa.Array) -> pa.Array:
        counter = _counts(path)
        out = []
        for scalar, budget in zip(words, budgets, strict=True):
            text = scalar.as_py()
            word = (text or "").lstrip(SPACE)
            found = counter.longest(word, budget.as_py()) if word else 0
            out.append(len(text) - len(word) + found if found else 0)
        return pa.array(out, pa.int64())

    return longest


def fitting_chars(
    prefixes: Column, budget: int, text: Column | None = None, path: str = DEFAULT_VOCABULARY
) -> Column:
    """Code points of the longest prefix that has at most so many tokens and ends with no white
    space. Without the text, of the longest such prefix that ends with a word."""
    fitting = F.array_size(F.filter(prefixes["tokens"], lambda n: n <= budget))
    end = F.when(fitting > 0, F.element_at(prefixes["ends"], fitting)).otherwise(0)
    if text is None:
        return end.cast("long")
    # The word that crosses the budget, with the blanks before it, and the tokens left for it.
    used = F.when(fitting > 0, F.element_at(prefixes["tokens"], fitting)).otherwise(0)
    until = F.try_element_at(prefixes["ends"], fitting + 1)
    crossing = F.substring(text, end + 1, until - end)
    return end.cast("long") + _longest_udf(path)(crossing, F.lit(budget) - used)
