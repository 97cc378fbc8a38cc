"""Benchmark decontamination with suffix arrays over the training texts.

Each task sorts the suffixes of its share of the training words (a shard) and looks up every
suffix of the test items by binary search. A test suffix that agrees with training suffixes in
a whole window marks their words as hit; matches that go on in the next suffix are joined to
the longest verbatim match. Windows that several items have are looked up once. Words that no test item has cannot be in a match, so only runs of
test words at least one window long enter the suffix array.

The test items go to the tasks in blocks of bounded size, one pass over the texts for each; the hits
of all blocks are joined by document. Null and empty texts have no words and no hits, items
without words have no windows, and repeated rows are judged each. Other columns are kept.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import free_name, hex_digest, small_batches, stored, text_slices
from meterlens.llm.words import plain_words

WINDOW = 13
#: Bytes of test items in one broadcast.
BLOCK_BYTES = 16_000_000

MATCH_TYPE = (
    "n_words int, spans array<struct<start:int,end:int>>, items array<string>, longest int"
)


class Suffixes:
    """The test items of a block, ready to be looked up in suffix arrays. Their words lie one after
    the other, each item behind a gap; equal windows are looked up once, and know all their places."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        same: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, text in items:
            if words := tuple(plain_words(text)):
                same[words].add(name)
        self.window = window
        self.names = [sorted(names) for names in same.values()]
        self.codes: dict[bytes, int] = {}
        sizes = np.fromiter(map(len, same), np.int64, len(same))
        begins = np.cumsum(sizes + 1) - sizes
        self.words = np.zeros(int((sizes + 1).sum()) + window + 1, np.int32)
        for begin, size, words in zip(begins, sizes, same, strict=True):
            coded = (self.codes.setdefault(w, len(self.codes) + 1) for w in words)
            self.words[begin : begin + size] = np.fromiter(coded, np.int32, size)
        widths = np.minimum(sizes, window)
        many = sizes - widths + 1
        before = np.cumsum(many) - many
        places = np.arange(many.sum()) + np.repeat(begins - before, many)
        width = np.repeat(widths, many)
        owner = np.repeat(np.arange(len(same)), many)
        self.shortest = int(widths.min()) if len(widths) else 0
        # Equal windows: the same ranks of their first words, and the same width.
        rank = _ranks(self.words, window)[places] if len(places) else places
        short = np.flatnonzero(width < window)
        if len(short):
            # A short item is one window; it ends with a gap, so no longer one is equal to it.
            rank = rank * 2
            rank[short] += 1
        _, first, self.kind = np.unique(rank, return_index=True, return_inverse=True)
        #: One place of each distinct window, and its width.
        self.tests, self.width = places[first], width[first]
        order = np.argsort(self.kind, kind="stable")
        #: All places of each, one after the other.
        self.places = places[order]
        self.starts = np.append(0, np.cumsum(np.bincount(self.kind, minlength=len(first))))
        owners = owner[order]
        # Windows of the same items have one list of them.
        lists: dict[bytes, int] = {}
        self.owners: list[np.ndarray] = []
        self.of_kind = np.zeros(len(first), np.int64)
        for n in range(len(first)):
            mine = np.unique(owners[self.starts[n] : self.starts[n + 1]])
            key = mine.tobytes()
            if key not in lists:
                lists[key] = len(self.owners)
                self.owners.append(mine)
            self.of_kind[n] = lists[key]

    def _runs(self, codes: np.ndarray) -> np.ndarray:
        """Where runs of test words are long enough for a window."""
        known = np.concatenate([[0], (codes > 0).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(known))
        starts, ends = turns[::2], turns[1::2]
        keep = ends - starts >= self.shortest
        marks = np.zeros(len(codes) + 1, np.int64)
        marks[starts[keep]] += 1
        marks[ends[keep]] -= 1
        return np.flatnonzero(np.cumsum(marks[:-1]))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` (0 for words without a code) where windows begin, and the distinct
        window of each."""
        none = np.zeros(0, np.int64)
        places = self._runs(codes) if len(self.tests) else none
        if not len(places):
            return none, none
        # What lies in the array: the kept words with a gap after each run.
        gaps = np.append(np.diff(places) > 1, True)
        at = np.arange(len(places)) + np.cumsum(gaps) - gaps
        shard = np.zeros(at[-1] + 1 + self.window, np.int32)
        shard[at] = codes[places]
        order = at[_ranks(shard, self.window)[at].argsort(kind="stable")]
        back = np.zeros(len(shard), np.int64)
        back[at] = places
        found, tests = [none], [none]
        for begin in range(0, len(self.tests), LOOKED_UP):
            some = slice(begin, begin + LOOKED_UP)
            low = self._bound(shard, order, some, after=False)
            many = self._bound(shard, order, some, after=True) - low
            hit = np.flatnonzero(many)
            many, low = many[hit], low[hit]
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(back[order[rows + np.repeat(low, many)]])
            tests.append(np.repeat(hit + begin, many))
        return np.concatenate(found), np.concatenate(tests)

    def _bound(self, shard: np.ndarray, order: np.ndarray, some: slice, after: bool) -> np.ndarray:
        """Binary search of several test suffixes at once: the first suffix of the shard that is
        not before a window, or that is after all that begin with it."""
        steps = np.arange(self.window)
        tests = self.words[self.tests[some][:, None] + steps]
        inside = steps < self.width[some][:, None]
        low = np.zeros(len(tests), np.int64)
        high = np.full(len(tests), len(order), np.int64)
        for _ in range(len(order).bit_length()):
            open_ = np.flatnonzero(low < high)
            middle = (low[open_] + high[open_]) // 2
            differ = shard[order[middle][:, None] + steps] - tests[open_]
            differ[~inside[open_]] = 0
            first = (differ != 0).argmax(axis=1)
            sign = differ[np.arange(len(open_)), first]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low

    def _longest(self, places: np.ndarray, kinds: np.ndarray) -> int:
        """Words of the longest match of one text (places ascending): windows that begin next to one
        another in the text and in an item go on."""
        best, before, seen, length = 0, -2, None, None
        short = self.width[kinds] < self.window
        if short.any():  # a whole short item
            best = int(self.width[kinds[short]].max())
        places, kinds = places[~short], kinds[~short]
        turns = np.flatnonzero(np.append(True, np.diff(places) != 0)) if len(places) else places
        for begin, end in zip(turns, [*turns[1:], len(places)], strict=False):
            place = int(places[begin])
            # Windows that differ only behind their last word stand at one place.
            here = np.sort(
                np.concatenate([self.places[self.starts[k] : self.starts[k + 1]] for k in kinds[begin:end]])
            )
            now = np.full(len(here), self.window, np.int64)
            if place == before + 1:
                at = np.searchsorted(seen, here - 1)
                at[at == len(seen)] = 0
                on = seen[at] == here - 1
                now[on] = length[at[on]] + 1
            best = max(best, int(now.max()))
            before, seen, length = place, here, now
        return best

    def judge(self, texts: list[str | None]) -> list[dict]:
        """Hits of each text."""
        get = self.codes.get
        lists = [plain_words(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.append(0, np.cumsum(sizes + 1))  # a gap after each text
        codes = np.zeros(starts[-1], np.int32)
        for start, size, words in zip(starts, sizes, lists, strict=False):
            codes[start : start + size] = np.fromiter((get(w, 0) for w in words), np.int32, size)
        out = [{"n_words": int(n), "spans": [], "items": [], "longest": 0} for n in sizes]
        places, kinds = self.find(codes)
        if not len(places):
            return out
        order = np.lexsort((kinds, places))
        places, kinds = places[order], kinds[order]
        ends = places + self.width[kinds]
        doc = np.searchsorted(starts, places, "right") - 1
        turns = np.flatnonzero(np.append(True, np.diff(doc) != 0))
        for begin, end in zip(turns, [*turns[1:], len(doc)], strict=True):
            found, start = out[doc[begin]], starts[doc[begin]]
            pairs = zip((places[begin:end] - start).tolist(), (ends[begin:end] - start).tolist(), strict=True)
            found["spans"] = [{"start": b, "end": e} for b, e in joined(list(pairs))]
            found["longest"] = self._longest(places[begin:end], kinds[begin:end])
            owners = np.unique(
                np.concatenate([self.owners[n] for n in np.unique(self.of_kind[kinds[begin:end]])])
            )
            found["items"] = sorted({name for n in owners for name in self.names[n]})
        return out


#: Test suffixes that are looked up at once.
LOOKED_UP = 100_000


def _ranks(words: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the suffixes by their first words, a window at least, by doubling."""
    rank, size = words.astype(np.int64), 1
    while size < window:
        key = rank * (int(rank.max()) + 1) + np.append(rank[size:], np.zeros(min(size, len(rank)), np.int64))
        rank = np.unique(key, return_inverse=True)[1]
        size *= 2
    return rank


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few that do not touch."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _match_udf(items, window: int):
    """items: a broadcast of (name, text) pairs."""
    ready: list[Suffixes] = []  # one for each worker, at its first batch
    kind = pa.struct(
        {
            "n_words": pa.int32(),
            "spans": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()})),
            "items": pa.list_(pa.string()),
            "longest": pa.int32(),
        }
    )

    @F.arrow_udf(MATCH_TYPE)
    def match(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Suffixes(items.value, window))
        found = [row for part in text_slices(texts, 16_000_000) for row in ready[0].judge(part)]
        return pa.array(found, kind)

    return match


def _named(tests: DataFrame, item: str, text: str) -> DataFrame:
    return tests.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
    ).where("length(text) > 0")


def with_matches(
    docs: DataFrame,
    tests: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "matches",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a struct: number of words, hit word spans (joined, end exclusive), ids of the test
    items with windows in the text, and the words of the longest verbatim match."""
    spark = docs.sparkSession
    small_batches(spark)
    named = _named(tests, item, item_text)
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count)) if count > 1 else F.lit(0)

    def block(n: int):
        """One block of test items, of about ``block_bytes`` (one item is not split)."""
        return spark.sparkContext.broadcast([tuple(r) for r in named.where(part == n).collect()])

    if count == 1:
        return docs.withColumn(into, _match_udf(block(0), window)(F.col(text)))
    # One pass for each block: only what it hits is written, and its broadcast is given back.
    row, found = free_name("row", docs), free_name("found", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    parts = []
    for n in range(count):
        items = block(n)
        matched = rows.select(row, _match_udf(items, window)(F.col(text)).alias(found))
        hits = matched if n == 0 else matched.where(F.size(F.col(found)["spans"]) > 0)
        parts.append(stored(hits, "hits"))
        items.destroy()
    # At most as many rows as blocks for each document; the first block has them all.
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    merged = every.groupBy(row).agg(F.collect_list(found).alias(found))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    return rows.join(merged, row).select(*[F.col(f"`{c}`") for c in kept], _together(F.col(found)).alias(into))


def _together(parts: Column) -> Column:
    """The matches of several blocks as one."""

    def all_of(name: str) -> Column:
        return F.flatten(F.transform(parts, lambda p: p[name]))

    def most(name: str) -> Column:
        return F.array_max(F.transform(parts, lambda p: p[name])).alias(name)

    spans = F.array_sort(all_of("spans"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def join(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
        )
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < span["start"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        )

    return F.struct(
        most("n_words"),
        F.aggregate(spans, empty, join).alias("spans"),
        F.array_sort(F.array_distinct(all_of("items"))).alias("items"),
        most("longest"),
    )


def hit_words(matches: Column) -> Column:
    """Words of the text inside any window."""
    return F.aggregate(
        matches["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
    )


def contaminated(matches: Column) -> Column:
    """At least a twentieth of the words is hit."""
    hits = hit_words(matches)
    return (hits > 0) & (20 * hits >= matches["n_words"])


def items_digest(matches: Column) -> Column:
    return hex_digest(F.array_join(matches["items"], ","))


def remove_contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    into = free_name("matches", docs)
    matched = with_matches(docs, tests, into=into, **options)
    return matched.where(~contaminated(F.col(into))).select(*[docs[c] for c in docs.columns])
