"""Near-duplicate documents by b-bit MinHash.

A text's set is that of its five-word shingles. 128 minima per set give 32 band keys of four
minima each, and a signature of the minima's lowest four bits, packed into eight longs. Texts
that share a band key are candidates; the share of equal lanes in two signatures, corrected for
chance collisions, estimates their similarity, and what passes it by a wide margin is confirmed
on the full sets.

A bucket (the texts of a band key) is never expanded into all its pairs. Each text is first held
against the smallest text of its buckets; what is linked forms components. Only buckets that still
hold several components are looked at again: a task gets the sets of such a bucket, compares
texts of different components, and hands on the links that join two of them, fewer than the bucket
has texts. A bucket too large for a task is cut into blocks, and every two blocks meet in some
task. So no link between components is passed over.

Texts are nodes by a 64-bit hash, so exact copies are one node from the start. Empty and null
texts have an empty set and are linked with nothing. Rows with a null doc_id take part; the id of
their component is the smallest one that is not null, if any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import (
    Memo,
    fit_to_broadcast,
    free_name,
    small_batches,
    stored,
    text_slices,
)
from meterlens.llm.components import components
from meterlens.llm.words import spaced_words

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
BANDS, BAND_SIZE = 32, 4
MINIMA = BANDS * BAND_SIZE
BITS = 4
LANES = 64 // BITS
#: Candidates whose estimated similarity is below this are dropped: five standard errors of the
#: estimate under the similarity of a link.
LEAST_ESTIMATE = 0.55

#: Texts of a bucket that are compared in one task, and their shingles together; larger buckets are
#: cut into blocks. The bits that a task keeps are at most one for each pair of a text and a shingle.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 400_000

_random = np.random.default_rng(9)
_ODD32 = (_random.integers(0, 2**31, MINIMA, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_ADD32 = _random.integers(0, 2**32, MINIMA, dtype=np.uint32)
_STEP = _random.integers(0, 2**63, SHINGLE_WORDS, dtype=np.uint64) * 2 + 1
_BAND = _random.integers(0, 2**63, (BANDS, BAND_SIZE), dtype=np.uint64) * 2 + 1

SIGNED_TYPE = "n_shingles int, bands array<long>, bits array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread each bit of 64 over the others."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct shingles as hashes; fewer words than a shingle has are one shingle."""
    memo = _word_hashes()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if 0 < len(h) < SHINGLE_WORDS:
        return _mixed((h * _STEP[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    size = max(0, len(h) - SHINGLE_WORDS + 1)
    total = np.zeros(size, np.uint64)
    for k, step in enumerate(_STEP):
        total += h[k : k + size] * step
    return np.unique(_mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for n in range(0, len(x), 4096):
        out = np.minimum(out, (_ODD32[:, None] * x[n : n + 4096] + _ADD32[:, None]).min(axis=1))
    return out


def signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the packed low bits, of the minima."""
    keys = _mixed((least.reshape(BANDS, BAND_SIZE) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, LANES)
    bits = (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), bits.view(np.int64)


def _signed(texts: pa.Array) -> pa.Array:
    sizes, bands, bits = [], [], []
    for part in text_slices(texts):
        _word_hashes().trim()
        for text in part:
            hashes = shingle_hashes(spaced_words(text))
            sizes.append(len(hashes))
            if len(hashes):
                keys, low = signature(minima(hashes))
                bands.append(keys)
                bits.append(low)
    has = np.array(sizes, np.int64) > 0

    def lists(rows: list[np.ndarray], width: int) -> pa.Array:
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * width)), pa.int32()), flat)

    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int32()), lists(bands, BANDS), lists(bits, MINIMA // LANES)],
        ["n_shingles", "bands", "bits"],
    )


def estimate(bits: Column, others: Column) -> Column:
    """Similarity from two packed signatures: the share of equal lanes, less what chance gives."""
    differing = F.lit(0)
    for n in range(MINIMA // LANES):
        x = F.element_at(bits, n + 1).bitwiseXOR(F.element_at(others, n + 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing += F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return (1 - differing / MINIMA - chance) / (1 - chance)


def shingles(text: str) -> set:
    """The full set of a text."""
    words = spaced_words(text)
    if len(words) < SHINGLE_WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE_WORDS)), strict=False))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose full sets are similar. Rows with the same b mostly follow each
    other, so its set is kept."""
    known: tuple[int | None, set] = (None, set())
    for batch in batches:
        a, b, text, other = batch.columns
        links = []
        for n in range(batch.num_rows):
            node = b[n].as_py()
            if known[0] != node:
                known = (node, shingles(other[n].as_py()))
            mine, theirs = shingles(text[n].as_py()), known[1]
            common = len(mine & theirs)
            if 100 * common >= SIMILAR_PERCENT * (len(mine) + len(theirs) - common):
                links.append(n)
        rows = pa.array(links, pa.int32())
        yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], ["a", "b"])


def _hashes(texts: pa.Array) -> pa.Array:
    """Distinct shingles of each text as hashes."""
    rows = []
    for part in text_slices(texts):
        _word_hashes().trim()
        rows += [shingle_hashes(spaced_words(t)).view(np.int64) for t in part]
    offsets = pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32())
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *rows]))


def linking(sets: list[np.ndarray], roots: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets that join different components, until no two components
    of different blocks (or of the one block) can be joined."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1  # what one set has alone is in no intersection
    column = np.unique(column[shared], return_inverse=True)[1]
    table = np.zeros((len(sets), column.max(initial=-1) // 8 + 1), np.uint8)
    np.bitwise_or.at(table, (owner[shared], column // 8), np.uint8(1) << (column % 8).astype(np.uint8))
    wide = -table.shape[1] % 8
    table = np.pad(table, ((0, 0), (0, wide))).view(np.uint64)
    part, block = np.unique(roots, return_inverse=True)[1], np.array(blocks)
    one = len(np.unique(block)) == 1
    main = np.bincount(part).argmax()
    out = []
    for i in np.flatnonzero(part != main):
        while True:  # again after each join, as the component has grown
            others = np.flatnonzero((part != part[i]) & (one | (block != block[i])))
            common = np.bitwise_count(table[others] & table[i]).sum(axis=1, dtype=np.int64)
            union = sizes[others] + sizes[i] - common
            similar = others[100 * common >= SIMILAR_PERCENT * union]
            if not len(similar):
                break
            out.append((int(i), int(similar[0])))
            part[part == part[i]] = part[similar[0]]
    return out


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components in the rows of each (key, first, second), as _apart gives them."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        nodes, roots = table["node"].to_numpy(), table["root"].to_numpy()
        own = table["own"].to_numpy()
        hashes = table["hashes"].combine_chunks()
        flat, at = hashes.values.to_numpy(), hashes.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        pairs = np.array(linking(sets, roots, own), np.int64).reshape(-1, 2)
        a, b = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"]
        )

    group: tuple | None = None
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        names = [batch[c].to_numpy() for c in ("key", "first", "second")]
        turns = np.flatnonzero(np.any([np.diff(x) != 0 for x in names], axis=0)) + 1
        for begin, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
            if begin == end:
                continue
            now = tuple(x[begin] for x in names)
            if rows and now != group:
                yield links(rows)
                rows = []
            group = now
            rows.append(batch.slice(begin, end - begin))
    if rows:
        yield links(rows)


def _text_node(text: str | Column) -> Column:
    return F.xxhash64(text)


class NearDuplicates:
    """The links among the documents of a table, and what follows from them."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.texts = docs.select(
            F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _text_node(text).alias("node")
        )
        #: One row per document: doc_id, node, n_shingles, bands, bits.
        self.signed = stored(
            self.texts.withColumn("s", F.arrow_udf(_signed, SIGNED_TYPE)("text")).select("doc_id", "node", "s.*"), "signed"
        )
        #: One row per text that is not empty.
        self.nodes = stored(
            self.signed.where("n_shingles > 0")
            .groupBy("node")
            .agg(
                F.min("doc_id").alias("doc_id"),
                F.first("n_shingles").alias("n"),
                F.first("bands").alias("bands"),
                F.first("bits").alias("bits"),
            ),
            "nodes",
        )
        self.roots = stored(self._roots(), "roots")

    def _roots(self) -> DataFrame:
        """(node, root) of the nodes that are linked with another."""
        rows = self.nodes.select("node", "n", F.explode("bands").alias("key"))
        buckets = (
            rows.groupBy("key")
            .agg(F.min("node").alias("center"), F.max("node").alias("most"))
            .where("center < most")
            .select("key", "center")
        )
        members = stored(rows.join(buckets, "key"), "members")
        pairs = members.where("node > center").select(F.col("node").alias("a"), F.col("center").alias("b"))
        links = stored(self._confirmed(pairs.distinct()), "links")
        roots = stored(components(links), "roots")
        found = self._apart(members, roots).mapInArrow(_linking, "a long, b long").distinct()
        more = stored(self._confirmed(found), "links")
        if more.isEmpty():
            return roots
        # What was linked before is one node now.
        root = roots.select(F.col("node"), "root")
        joined = more
        for side in ("a", "b"):
            joined = (
                joined.join(root.withColumnRenamed("node", side), side, "left")
                .withColumn(side, F.coalesce("root", side))
                .drop("root")
            )
        upper = components(joined).toDF("root", "top")
        ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        every = roots.unionByName(
            ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
        )
        return every.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    def _apart(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Buckets that hold several components, cut into blocks, with the sets of their texts:
        key, first and second block, own block, node, root, hashes. Every two blocks of a bucket
        are together once, in rows that follow each other."""
        placed = members.join(roots, "node", "left").select(
            "key", "node", "n", F.coalesce("root", "node").alias("root")
        )
        blocks = F.greatest(
            F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
        )
        # The smallest text of a bucket has been held against all others, so two are done.
        mixed = (
            placed.groupBy("key")
            .agg(
                F.min("root").alias("least"),
                F.max("root").alias("most"),
                F.count("*").alias("texts"),
                F.sum("n").alias("shingles"),
            )
            .where("least < most AND texts > 2")
            .select("key", blocks.cast("int").alias("blocks"))
        )
        rows = stored(placed.join(mixed, "key"), "mixed")
        texts = self._texts(rows.select("node").distinct())
        sets = stored(
            texts.select("node", F.arrow_udf(_hashes, "array<long>")("text").alias("hashes")), "sets"
        )
        own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return (
            rows.select("key", "node", "root", own.alias("own"), other.alias("other"))
            .select(
                "key",
                F.least("own", "other").alias("first"),
                F.greatest("own", "other").alias("second"),
                "own",
                "node",
                "root",
            )
            .join(sets, "node")
            .repartition("key", "first", "second")
            .sortWithinPartitions("key", "first", "second")
            .select("key", "first", "second", "own", "node", "root", "hashes")
        )

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """node, text: one row for each of the nodes."""
        wanted = stored(nodes.join(self.nodes.select("node", "doc_id"), "node"), "wanted")
        found = fit_to_broadcast(wanted.withColumnRenamed("doc_id", "one"))
        same = (self.texts["node"] == found["node"]) & F.col("doc_id").eqNullSafe(F.col("one"))
        rows = self.texts.join(found, same).select(self.texts["node"], "text")
        return rows.dropDuplicates(["node"])  # of rows given twice

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the estimate and then are similar by their full sets."""
        bits = self.nodes.select("node", "bits")
        likely = stored(
            pairs.join(bits.toDF("a", "bits_a"), "a")
            .join(bits.toDF("b", "bits_b"), "b")
            .where(estimate(F.col("bits_a"), F.col("bits_b")) >= LEAST_ESTIMATE)
            .select("a", "b"),
            "likely",
        )
        nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = stored(self._texts(nodes), "texts")
        both = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long")

    def result(self) -> DataFrame:
        """doc_id, node, n_shingles, component_id (smallest doc_id) and kept for every row."""
        return self.rooted().drop("root")

    def rooted(self) -> DataFrame:
        """The result with the root of each row's component (its own node if it has no other)."""
        joined = self.nodes.select("node", "doc_id").join(self.roots, "node")
        least = joined.groupBy("root").agg(F.min("doc_id").alias("least"))
        lone = F.when(F.col("n_shingles") > 0, F.coalesce("least", "one")).otherwise(F.col("doc_id"))
        ids = (
            self.nodes.select("node", F.col("doc_id").alias("one"))
            .join(self.roots, "node", "left")
            .join(least, "root", "left")
            .select("node", "one", "least", F.coalesce("root", "node").alias("root"))
        )
        return (
            self.signed.select("doc_id", "node", "n_shingles")
            .join(ids, "node", "left")
            .select("doc_id", "node", F.col("n_shingles").cast("long").alias("n_shingles"), lone.alias("component_id"), "root")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (hash of the text), n_shingles, component_id and kept, one row per row."""
    return NearDuplicates(docs, doc_id, text).result()


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns. Rows of a kept document that is
    given several times are one document; documents without words stay as they are."""
    result = stored(NearDuplicates(docs, doc_id, text).rooted(), "near_duplicates")
    groups = stored(
        result.where("kept")
        .groupBy("doc_id", "node")
        .agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows"), F.max("root").alias("root")),
        "groups",
    )
    # The smallest doc_id of a component, or none at all, may be that of several of its texts.
    full = groups.where("n > 0")
    least = full.groupBy("root").agg(F.min("node").alias("node")).select("root", "node")
    chosen = full.join(least, ["root", "node"], "left_semi").select(groups.columns)
    kept = stored(chosen.unionByName(groups.where("n IS NULL OR n <= 0")), "kept")
    node, key, rows = (free_name(n, docs) for n in ("kept_node", "kept_id", "kept_rows"))
    stay = fit_to_broadcast(
        kept.select(
            F.col("doc_id").alias(key), F.col("node").alias(node), (F.col("n") > 0).alias("full"), "rows"
        ).select(key, node, F.when(F.col("full"), F.col("rows")).otherwise(1).alias(rows))
    )
    same = (F.col(key).eqNullSafe(docs[doc_id])) & (F.col(node) == _text_node(docs[text]))
    left = docs.join(stay, same)
    columns = [docs[c] for c in docs.columns]
    if kept.where("n > 0 AND rows > 1").isEmpty():
        return left.select(*columns)
    once = left.where(F.col(rows) > 1).dropDuplicates([key, node])
    return left.where(F.col(rows) == 1).select(*columns).unionByName(once.select(*columns))
