"""BPE encoding and decoding with forced cuts.

Two bytes that no token of the vocabulary has side by side can never be merged over. A word
is cut between all such pairs, the fragments are encoded each by itself, and their ids are
put one after the other. The result is that of the whole word.

Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded
each. Other columns are kept as they are.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import Memo, small_batches, text_slices
from meterlens.llm.vocabulary import DEFAULT_VOCABULARY, WORD_END, vocabulary, words_of


#: Words that a worker remembers, and rows of ids that it holds (also of words forgotten since).
WORDS, ROWS = 200_000, 500_000


class FragmentEncoder:
    """Ids of texts, by fragments between forced cuts."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.vocabulary = vocabulary(path)
        #: Pairs of byte symbols that stand side by side in a token.
        self.inside = set()
        for token in self.vocabulary.ids:
            plain = token.removesuffix(WORD_END)
            self.inside.update(plain[n : n + 2] for n in range(len(plain) - 1))
        self.words = Memo(self._word, WORDS)
        self._clear()

    def _clear(self) -> None:
        """Ids of all words seen, one after the other, and where each word's begin."""
        self.words.forget()
        self.flat = array("i")
        self.starts = array("q", [0])

    def cut(self, piece: str) -> list[str]:
        """The fragments of a piece."""
        inside = self.inside
        if inside.issuperset(map(add, piece, piece[1:])):
            return [piece]
        cuts = [n for n in range(1, len(piece)) if piece[n - 1 : n + 1] not in inside]
        bounds = [0, *cuts, len(piece)]
        return [piece[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _word(self, word: str) -> int:
        encoded = self.vocabulary.encoded
        for part in self.vocabulary.parts(word):
            if isinstance(part, int):
                self.flat.append(part)
                continue
            fragments = self.cut(part)
            last = fragments.pop()
            for fragment in fragments:
                self.flat.extend(encoded(fragment, False))
            self.flat.extend(encoded(last, True))
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        self.words.trim()
        if len(self.starts) > ROWS:
            self._clear()
        lists = [words_of(t or "") for t in texts]
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        every = chain.from_iterable(lists)
        rows = np.fromiter(map(self.words.__getitem__, every), np.int64, many.sum())
        flat, starts = np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64)
        first, size = starts[rows], starts[rows + 1] - starts[rows]
        before = np.cumsum(size) - size
        ids = flat[np.repeat(first - before, size) + np.arange(size.sum())]
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(many))]
        return ids, np.diff(upto)


@lru_cache(maxsize=2)
def _encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def decoded(ids: np.ndarray, sizes: np.ndarray, path: str = DEFAULT_VOCABULARY) -> list[str]:
    """The texts of several rows of ids. The file names no decoder, so tokens are joined by a
    space; ids outside the vocabulary have no text."""
    tokens = vocabulary(path).tokens
    known = [tokens.get(n) for n in ids.tolist()]
    ends = np.cumsum(sizes).tolist()
    rows = (known[end - size : end] for end, size in zip(ends, sizes.tolist(), strict=True))
    if None in known:
        return [" ".join(t for t in row if t is not None) for row in rows]
    return [" ".join(row) for row in rows]


def _lists(ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([[], *ids]).astype("int32")))


def _encode_udf(path: str):
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        found = [_encoder(path).encode(part) for part in text_slices(texts)]
        return _lists([ids for ids, _ in found], [sizes for _, sizes in found])

    return encode


def _decode_udf(path: str):
    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(decoded(flat, sizes, path), pa.string())

    return decode


def _round_trip_udf(path: str):
    @F.arrow_udf("ids array<int>, decoded string")
    def round_trip(texts: pa.Array) -> pa.Array:
        ids, sizes, out = [], [], []
        for part in text_slices(texts):
            flat, many = _encoder(path).encode(part)
            ids.append(flat)
            sizes.append(many)
            out += decoded(flat, many, path)
        return pa.StructArray.from_arrays(
            [_lists(ids, sizes), pa.array(out, pa.string())], ["ids", "decoded"]
        )

    return round_trip


def encode(
    docs: DataFrame, text: str = "text", into: str = "ids", path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """Add the token ids of each whole text."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _encode_udf(path)(F.col(text)))


def decode(
    docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """Add the text that the ids stand for; special tokens are kept."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _decode_udf(path)(F.col(ids)))


def round_trip(
    docs: DataFrame, text: str = "text", into: str = "coded", path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """Add a struct of the ids and the text decoded from them, in one pass. (Of ``encode`` and
    ``decode`` one after the other Spark would make one step that encodes twice.)"""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _round_trip_udf(path)(F.col(text)))
