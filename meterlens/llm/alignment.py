"""Alignment of two tokenizers by sparse incidence matrices.

A text's tokens and its bytes form an incidence matrix for each tokenizer, kept in compressed sparse
rows that are built here. The product of one with the other's transpose, row by row (Gustavson),
holds for every two tokens how many bytes they share: its entries are the overlap links. Byte offsets
at which tokens of both end cut the tokens into groups; the product of the group incidences holds
the links of tokens in the same group.

Neither tokenizer merges over a blank that follows something else, so texts are cut there into
words. A word's tokens, links and groups are found once in a worker for as long as it remembers the
word, with the matrices of many words as blocks of one; a text's results are sums over its words.
A worker's tasks share what it remembers; when there is no more room, the words met most often stay.

How often two ids are linked is counted over the whole table, pre-summed in each task. The pairs that
are linked most often are broadcast, at most ``COMMON_PAIRS``; a text's links of other pairs are
joined with the table of counts. Which pairs are broadcast changes the cost, never a result.

Null and empty texts, and texts whose tokens do not give the bytes of the text back, have no tokens:
all numbers are 0 and the groups are an empty string. Repeated rows count each. Other columns are
kept, but for those that the result replaces. Very long texts are cut into words as well; a word
without blanks is held whole.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlens.llm.common import free_name, small_batches, stored, text_slices
from meterlens.llm.vocabulary import byte_symbols

FIRST = public_tokenizers.path("byte_bpe_50k.json")
SECOND = public_tokenizers.path("piece_bpe_32k.model")

#: Pairs of ids whose counts are broadcast.
COMMON_PAIRS = 1_000_000
#: Words and characters of words that a worker remembers.
WORDS, WORD_CHARS = 600_000, 16_000_000
#: Bytes of tokens in one row block of a product.
PRODUCT_BYTES = 4_000_000
#: Characters of words that are encoded as one text.
JOINED_CHARS = 4_000
#: Ids of the second tokenizer are below this.
WIDTH = 1 << 32

_cut = regex.compile(r"(?<=\S) (?!\Z)")
#: White space other than the blank, which has no more than this in Unicode.
_WHITE = [c for c in map(chr, range(0x3001)) if c != " " and regex.match(r"\s", c)]


class Csr(NamedTuple):
    """Compressed sparse rows: row r holds ``columns[starts[r] : starts[r + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens that lie one after the other, by the bytes that they hold."""
    starts = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return Csr(starts, np.arange(starts[-1], dtype=np.int64), int(starts[-1]))


def membership(groups: np.ndarray, count: int) -> Csr:
    """Tokens by their group."""
    return Csr(np.arange(len(groups) + 1, dtype=np.int64), groups.astype(np.int64), count)


def transposed(a: Csr) -> Csr:
    """The same entries by column; within a column by row."""
    rows = np.repeat(np.arange(len(a.starts) - 1, dtype=np.int64), np.diff(a.starts))
    counts = np.bincount(a.columns, minlength=a.width)
    order = np.argsort(a.columns, kind="stable")
    return Csr(np.append(0, np.cumsum(counts)), rows[order], len(a.starts) - 1)


def product(a: Csr, b: Csr, most: int = PRODUCT_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, columns and values of the entries of a times b, in blocks of rows: each row of a picks
    the rows of b that it names, and equal columns are added up."""
    sizes = np.diff(b.starts)
    work = np.append(0, np.cumsum(sizes[a.columns]))[a.starts]  # entries before each row of a
    begin, rows = 0, len(a.starts) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(work, work[begin] + most, "right")) - 1)
        picked = a.columns[a.starts[begin] : a.starts[end]]
        row = np.repeat(np.arange(begin, end), np.diff(a.starts[begin : end + 1]))
        many = sizes[picked]
        before = np.cumsum(many) - many
        at = np.repeat(b.starts[picked] - before, many) + np.arange(many.sum())
        keys = np.repeat(row, many) * b.width + b.columns[at]
        if len(keys) and (np.diff(keys) < 0).any():
            keys.sort()
        first = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else keys
        values = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        yield keys // max(b.width, 1), keys % max(b.width, 1), values
        begin = end


def _joined(blocks: Iterator[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    found = list(blocks) or [(np.zeros(0, np.int64),) * 3]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


class Tokens(NamedTuple):
    """Tokens of several words, one after the other: how many each word has of both kinds, their ids
    and lengths, and whether they give the word's bytes back (words that don't have no tokens)."""

    counts: tuple[np.ndarray, np.ndarray]
    ids: tuple[np.ndarray, np.ndarray]
    lengths: tuple[np.ndarray, np.ndarray]
    sound: np.ndarray


class Tokenizers:
    """Two tokenizers, and the bytes of their tokens."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = {c: n for n, c in enumerate(byte_symbols())}
        vocabulary = self.first.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            known = all(c in byte for c in token)
            self.bytes_a[n] = bytes(byte[c] for c in token) if known else token.encode()
        self.bytes_b = []
        for n in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(n)
            raw = bytes([int(piece[3:5], 16)]) if self.second.is_byte(n) else piece.replace("▁", " ").encode()
            self.bytes_b.append(raw)
        self.sizes = [np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b)]
        #: Ids of both kinds as text with each sign that may stand behind them.
        self.signed = [f"{n}{c}" for t in self.sizes for n in range(len(t)) for c in (",", "|", ";", "")]

    def encode(self, words: list[str]) -> Tokens:
        """Tokens of words as ``words_of`` gives them, in their order. Words are joined again by
        blanks, where both tokenizers cut, and many are encoded at once."""
        plain = [n for n, word in enumerate(words) if word and not word[-1].isspace()]
        parts, part, size = [], [], 0
        for n in plain:
            part.append(n)
            size += len(words[n])
            if size > JOINED_CHARS:
                parts.append(part)
                part, size = [], 0
        single = set(range(len(words))).difference(plain)
        parts += [part] if part else []
        parts += [[n] for n in sorted(single)]
        order, found = [], []
        joined = [" ".join([words[n] for n in part]) for part in parts]
        for part, text, tokens in zip(parts, joined, self._encoded(joined), strict=True):
            one_byte = text.isascii()
            sizes = np.array([len(words[n] if one_byte else words[n].encode()) + 1 for n in part])
            if tokens is not None:
                order += part
                found.append(self._split(tokens, sizes))
                continue
            # Something in it does not give its bytes back: each word by itself.
            alone = [words[n] for n in part]
            for n, one, own in zip(part, self._encoded(alone), sizes, strict=True):
                order.append(n)
                if one is None:
                    none = np.zeros(0, np.int64)
                    found.append((np.zeros((2, 1), np.int64), none, none, np.zeros(1, bool)))
                else:
                    found.append(self._split(one, np.array([own])))
        counts = np.concatenate([np.zeros((2, 0), np.int64), *[f[0] for f in found]], axis=1)
        ids = [np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (1, 2)]
        sound = np.concatenate([np.zeros(0, bool), *[f[3] for f in found]])
        # Back to the order of the words.
        back = np.argsort(np.array(order, np.int64), kind="stable")
        ids = [
            x[_picked(np.append(0, np.cumsum(n)), back)[0]] for x, n in zip(ids, counts, strict=True)
        ]
        lengths = [table[x] for table, x in zip(self.sizes, ids, strict=True)]
        return Tokens((counts[0][back], counts[1][back]), tuple(ids), tuple(lengths), sound[back])

    def _encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both kinds of whole texts; None if they don't give a text's bytes back."""
        spaced = [f" {t}" for t in texts]
        a = self.first.encode_batch_fast(spaced, add_special_tokens=False)
        b = self.second.encode(texts, num_threads=1) if texts else []
        out = []
        for text, x, y in zip(spaced, a, b, strict=True):
            raw, ids = text.encode(), x.ids
            same = raw == b"".join([self.bytes_a[n] for n in ids]) == b"".join(
                [self.bytes_b[n] for n in y]
            )
            out.append((ids, y) if same else None)
        return out

    def _split(self, tokens, sizes: np.ndarray) -> tuple:
        """How many of the tokens of joined words each word has, by their bytes."""
        ends = np.cumsum(sizes)
        tokens = [np.fromiter(ids, np.int64, len(ids)) for ids in tokens]
        counts = []
        for table, ids in zip(self.sizes, tokens, strict=True):
            upto = np.searchsorted(np.cumsum(table[ids]), ends) + 1
            counts.append(np.diff(np.append(0, upto)))
        return np.array(counts), *tokens, np.ones(len(sizes), bool)


def overlaps(tokens: Tokens) -> list[np.ndarray]:
    """Places of linked tokens of both kinds, and the bytes that they share."""
    a, b = (incidence(x) for x in tokens.lengths)
    return _joined(product(a, transposed(b)))


def grouped(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every token of both kinds, and the offsets at which groups end."""
    ends = [np.cumsum(x) for x in tokens.lengths]
    cuts = np.intersect1d(*ends, assume_unique=True)
    return np.searchsorted(cuts, ends[0]), np.searchsorted(cuts, ends[1]), cuts


def shared_links(tokens: Tokens, most: int = PRODUCT_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of tokens of both kinds that are in the same group, block by block."""
    in_a, in_b, cuts = grouped(tokens)
    a, b = (membership(x, len(cuts)) for x in (in_a, in_b))
    for rows, columns, _ in product(a, transposed(b), most):
        yield rows, columns


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive pieces."""
    upto = np.append(0, np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def _picked(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows, one after the other, and how many each row has."""
    first, size = starts[rows], starts[rows + 1] - starts[rows]
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum()), size


class Words:
    """Words that a worker remembers, with their tokens, links and groups."""

    def __init__(self, tokenizers: Tokenizers, pairs: Pairs | None = None):
        self.tokenizers, self.pairs = tokenizers, pairs
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.chars = 0
        #: Per word: tokens of both kinds, groups, links, links in groups, and whether it is sound.
        self.table = np.zeros((0, 6), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.keys = np.zeros(0, np.int64)
        self.groups: list[str] = []
        self.gains = np.zeros((0, 2), np.int64)
        self.rare_starts = np.zeros(1, np.int64)
        self.rare = np.zeros(0, np.int64)
        #: How often each word was met since words were forgotten last.
        self.met = np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.places) > WORDS or self.chars > WORD_CHARS

    def forget(self) -> None:
        """Make room: keep the words met most often, more than once and with half of the room at most.
        The places of words change."""
        words = list(self.places)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-self.met, kind="stable")
        room = (np.arange(1, len(words) + 1) <= WORDS // 2) & (np.cumsum(sizes[order]) <= WORD_CHARS // 2)
        keep = np.sort(order[room & (self.met[order] > 1)])
        kept = list(map(words.__getitem__, keep.tolist()))
        self.places = dict(zip(kept, range(len(kept)), strict=True))
        self.chars = int(sizes[keep].sum())
        self.table = self.table[keep]
        at, size = _picked(self.starts, keep)
        self.starts, self.keys = np.append(0, np.cumsum(size)), self.keys[at]
        self.met = np.zeros(len(kept), np.int64)
        if self.pairs is not None:
            self.groups = list(map(self.groups.__getitem__, keep.tolist()))
            self.gains = self.gains[keep]
            at, size = _picked(self.rare_starts, keep)
            self.rare_starts, self.rare = np.append(0, np.cumsum(size)), self.rare[at]

    def add(self, words: list[str]) -> None:
        """Tokenize new words and link their tokens."""
        tokens = self.tokenizers.encode(words)
        rows, columns, _ = overlaps(tokens)
        ids_a, ids_b = tokens.ids
        owner = np.repeat(np.arange(len(words)), tokens.counts[0])
        links = np.bincount(owner[rows], minlength=len(words))
        keys = ids_a[rows] * WIDTH + ids_b[columns]
        in_a, in_b, cuts = grouped(tokens)
        many = [np.bincount(x, minlength=len(cuts)) for x in (in_a, in_b)]
        # A group's word is that of its tokens; a word ends a group.
        of_group = np.zeros(len(cuts), np.int64)
        of_group[in_a] = owner
        groups = np.bincount(of_group, minlength=len(words))
        shared = np.bincount(of_group, many[0] * many[1], minlength=len(words)).astype(np.int64)
        new = np.stack([*tokens.counts, groups, links, shared, tokens.sound], axis=1)
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words)), strict=True))
        self.chars += sum(map(len, words))
        self.table = np.concatenate([self.table, new])
        self.met = np.append(self.met, np.zeros(len(words), np.int64))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(links))
        self.keys = np.concatenate([self.keys, keys])
        if self.pairs is not None:
            self.groups += self._texts(tokens, in_a, in_b, of_group)
            count, best, known = self.pairs.look(keys)
            gains = np.stack([_sums(best, links), _sums(count, links)], axis=1)
            self.gains = np.concatenate([self.gains, gains])
            self.rare_starts = np.append(self.rare_starts, self.rare_starts[-1] + np.cumsum(_sums(~known, links)))
            self.rare = np.concatenate([self.rare, keys[~known]])

    def _texts(self, tokens: Tokens, in_a: np.ndarray, in_b: np.ndarray, of_group: np.ndarray) -> list[str]:
        """The groups of each word as text: ids in the order of their groups, each with the sign that
        stands behind it."""
        kind = np.repeat([0, 1], [len(in_a), len(in_b)])
        group = np.concatenate([in_a, in_b])
        order = np.argsort(group * 2 + kind, kind="stable")
        group, kind = group[order], kind[order]
        ids = np.concatenate([tokens.ids[0], tokens.ids[1] + len(self.tokenizers.bytes_a)])[order]
        ends = np.append(group[1:] != group[:-1], True)
        last = np.append(of_group[group[1:]] != of_group[group[:-1]], True)
        turns = np.append(kind[1:] != kind[:-1], True)
        sign = np.where(last, 3, np.where(ends, 2, np.where(turns, 1, 0)))
        pieces = list(map(self.tokenizers.signed.__getitem__, (ids * 4 + sign).tolist()))
        sizes = (tokens.counts[0] + tokens.counts[1]).cumsum().tolist()
        return ["".join(pieces[i:j]) for i, j in zip([0, *sizes], sizes, strict=False)]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of the texts, and how many each text has."""
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        every, places = list(chain.from_iterable(lists)), self.places
        rows = np.fromiter(map(places.get, every, repeat(-1)), np.int64, len(every))
        unseen = np.flatnonzero(rows < 0)
        if len(unseen):
            words = list(map(every.__getitem__, unseen.tolist()))
            self.add(list(dict.fromkeys(words)))
            rows[unseen] = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        self.met += np.bincount(rows, minlength=len(self.met))
        return rows, counts


def words_of(text: str | None) -> list[str]:
    """The text's parts between blanks over which no token goes."""
    if not text:
        return []
    return _cut.split(text) if _odd(text) else text.split(" ")


def _odd(text: str) -> bool:
    """Whether the text begins or ends with a blank or has one behind white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return True
    return any(c in text and f"{c} " in text for c in _WHITE)


class Pairs:
    """Counts of the pairs linked most often, and whether they are the best of their second id."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts, self.best = keys[order], counts[order], best[order]

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.counts[at], 0), known & self.best[at], known


@lru_cache(maxsize=1)
def _tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


#: What this worker remembered last, by the name of the step that it is for.
_remembered: dict[str, Words] = {}


def _words(name: str, first: str, second: str, pairs=None) -> Words:
    """The words that this worker remembers for a step, also those of the step's other tasks."""
    if name not in _remembered:
        _remembered.clear()
        _remembered[name] = Words(_tokenizers(first, second), pairs and Pairs(*pairs.value))
    return _remembered[name]


def _count(first: str, second: str):
    """Texts to counts of linked pairs, summed as far as a task's memory allows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(f"{first} {second}", first, second)
        often = np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            here = np.flatnonzero(often)  # words of this task
            at, size = _picked(words.starts, here)
            keys, place = np.unique(words.keys[at], return_inverse=True)
            n = np.bincount(place, np.repeat(often[here], size), minlength=len(keys)).astype(np.int64)
            columns = [pa.array(x) for x in (keys // WIDTH, keys % WIDTH, n)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

        for batch in batches:
            for part in text_slices(batch["text"]):
                if words.full():
                    yield rows()
                    words.forget()
                    often = np.zeros(0, np.int64)
                placed, counts = words.of(part)
                often = np.pad(often, (0, len(words.places) - len(often)))
                sound = _sums(words.table[placed, 5], counts) == counts
                often += np.bincount(placed[np.repeat(sound, counts)], minlength=len(often))
        yield rows()

    return count


FOUND = (
    "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, n_shared long, "
    "groups string, rare array<struct<key: long, n: long>>"
)
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups"]


def _align_udf(first: str, second: str, pairs, digest: bool):
    name = uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def align(texts: pa.Array) -> pa.Array:
        words, parts = _words(name, first, second, pairs), []
        for part in text_slices(texts):
            if words.full():
                words.forget()
            parts.append(_aligned(words, part, digest))
        return pa.concat_arrays(parts or [_aligned(words, [], digest)])

    return align


def _aligned(words: Words, texts: list[str | None], digest: bool) -> pa.Array:
    """The texts' rows of ``FOUND``."""
    placed, counts = words.of(texts)
    sound = (_sums(words.table[placed, 5], counts) == counts) & (counts > 0)
    sums = [_sums(words.table[placed, k], counts) * sound for k in range(5)]
    gains = [_sums(words.gains[placed, k], counts) * sound for k in range(2)]
    groups, rare_keys, rare_times, rare_sizes = [], [], [], []
    ends = np.cumsum(counts)
    for begin, end, fine in zip((ends - counts).tolist(), ends.tolist(), sound.tolist(), strict=True):
        if not fine:
            groups.append("")
            rare_sizes.append(0)
            continue
        rows = placed[begin:end]
        text = ";".join(map(words.groups.__getitem__, rows.tolist()))
        groups.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
        at, _ = _picked(words.rare_starts, rows)
        keys, times = np.unique(words.rare[at], return_counts=True)
        rare_keys.append(keys)
        rare_times.append(times)
        rare_sizes.append(len(keys))
    pair = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (rare_keys, rare_times)],
        ["key", "n"],
    )
    rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare_sizes)), pa.int32()), pair)
    numbers = [*sums[:4], gains[0], gains[1], sums[4]]
    columns = [*(pa.array(x, pa.int64()) for x in numbers), pa.array(groups, pa.string()), rare]
    return pa.StructArray.from_arrays(columns, [*NAMES, "rare"])


def linked_pairs(
    docs: DataFrame, text: str = "text", first: str = FIRST, second: str = SECOND
) -> DataFrame:
    """a, b, n and best for all pairs of ids that are linked anywhere: how many links have them, and
    whether no other first id has more with the same second one."""
    small_batches(docs.sparkSession)
    counted = stored(
        docs.select(F.col(text).alias("text"))
        .mapInArrow(_count(first, second), "a long, b long, n long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n")),
        "pairs",
    )
    # One row for each id of the second vocabulary, at most.
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _common(pairs: DataFrame, most: int) -> tuple[tuple[np.ndarray, ...], int | None]:
    """The pairs linked most often, at most so many, and the count below which pairs are left out
    (None if all are in). Of equal counts all are in or out."""
    levels = stored(pairs.groupBy("n").agg(F.count("*").alias("pairs")), "levels")
    total = levels.agg(F.sum("pairs")).first()[0] or 0
    least = None
    if total > most:
        # The highest counts that fit; pairs with a count over total / most are fewer than that.
        least, taken = None, 0
        for row in levels.orderBy(F.desc("n")).limit(most + 1).toLocalIterator():
            taken += row["pairs"]
            if taken > most:
                break
            least = row["n"]
    taken = pairs if total <= most else pairs.where(F.col("n") >= least) if least else pairs.limit(0)
    key = (F.col("a") * F.lit(WIDTH) + F.col("b")).alias("key")
    table = taken.select(key, "n", "best").toArrow()
    columns = tuple(table[c].to_numpy() for c in ("key", "n", "best"))
    return columns, None if total <= most else (least or 1 << 62)


def with_alignment(
    docs: DataFrame,
    text: str = "text",
    digest: bool = False,
    first: str = FIRST,
    second: str = SECOND,
    common_pairs: int = COMMON_PAIRS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is linked most often among
    those with its second id), count_sum (of the counts of all links' pairs), n_shared (links within
    groups) and groups: the ids of each group, ``a1,a2|b1;a3|b2,b3`` (with ``digest``, its SHA-256).
    ``keep`` names the columns to keep; all by default."""
    spark = docs.sparkSession
    pairs = stored(linked_pairs(docs, text, first, second), "linked")
    common, least = _common(pairs, common_pairs)
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NAMES]
    kept, found = [F.col(f"`{c}`") for c in columns], free_name("found", docs)
    align = _align_udf(first, second, spark.sparkContext.broadcast(common), digest)
    aligned = docs.select(*kept, align(F.col(text)).alias(found))
    if least is None:
        return aligned.select(*kept, *[F.col(f"{found}.{n}") for n in NAMES])
    row, more = free_name("row", docs), free_name("more", docs)
    # The ids of rows are written with them, so they stay the same.
    aligned = stored(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    key = (F.col("a") * F.lit(WIDTH) + F.col("b")).alias("key")
    rare = pairs.where(F.col("n") < least).select(key, F.col("n").alias("count"), "best")
    times = F.col("n")
    sums = (
        aligned.select(F.col(row).alias("row"), F.inline(f"{found}.rare"))
        .join(rare, "key")
        .groupBy(F.col("row").alias(row))
        .agg(
            F.struct(
                F.sum(times * F.col("count")).alias("count_sum"),
                F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"),
            ).alias(more)
        )
    )

    def total(name: str):
        here = F.col(f"{found}.{name}")
        if name not in ("count_sum", "n_best"):
            return here
        return (here + F.coalesce(F.col(f"{more}.{name}"), F.lit(0))).alias(name)

    return aligned.join(sums, row, "left").select(*kept, *map(total, NAMES))
