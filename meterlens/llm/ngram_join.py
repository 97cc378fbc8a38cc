"""Similarity join of documents by a blocked sparse product of document and n-gram incidence.

A document's row of the incidence matrix has its distinct four-word shingles as columns. Two
documents are linked if their rows share at least 85 % of the columns that either has; how many they
share is an entry of the matrix times its transpose. Only a few blocks of that product are computed:

* Equal rows are one row from the start.
* A row of n columns shares ``ceil(0.85 n)`` with any row that it is linked with. So if all columns
  are put in some order, each of two linked rows has one of the shared columns among its first
  ``n - ceil(0.85 n) + 1``. The order begins with the quarter of the columns that have the lowest
  hashes, those in the fewest rows first; the others follow by hash. How many rows a column of that
  quarter has is counted over all rows. Rows whose first columns no other row has are done.
* The rows that have a column among their first ones are a bucket. A bucket is never expanded into its
  pairs. Each row is first held against the smallest row of its buckets, one row of the product for
  a block of rows; the links found make components.
* Buckets that still hold several components, or all of those whose components meet, are cut into
  blocks of bounded size, and every two blocks meet in a task, which accumulates the overlaps of rows of different components
  column by column, discards what is below the bound that follows from the sizes, and hands on the
  links that join two components, fewer than there are rows.

So no link between different components is passed over, and none that is found is inexact but for
collisions: shingles, rows and texts are known by 64-bit hashes.

Null and empty texts have no columns and are linked with nothing; texts of fewer words than a shingle
has are one shingle. Repeated rows are rows. Rows with a null doc_id take part; a component's id is
the smallest that is not null, if any. Other columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlens.llm.common import Memo, fit_to_broadcast, small_batches, stored, text_slices
from meterlens.llm.components import components
from meterlens.llm.words import spaced_words

SHINGLE_WORDS = 4
SIMILAR_PERCENT = 85
#: Columns with a hash below this are ordered by how many rows have them.
COUNTED = 1 << 62
#: Columns (of all rows together) in a block.
BLOCK_COLUMNS = 1_000_000

_STEP = np.random.default_rng(11).integers(0, 2**63, SHINGLE_WORDS, dtype=np.uint64) * 2 + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread each bit over the others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def columns_of(words: list[bytes]) -> np.ndarray:
    """Distinct shingles as sorted hashes."""
    memo = _word_hashes()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if 0 < len(h) < SHINGLE_WORDS:
        return _mixed((h * _STEP[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    size = max(0, len(h) - SHINGLE_WORDS + 1)
    total = np.zeros(size, np.uint64)
    for k, step in enumerate(_STEP):
        total += h[k : k + size] * step
    return np.unique(_mixed(total))


def least_shared(size: int, percent: int = SIMILAR_PERCENT) -> int:
    """Columns that a row shares at least with any row that it is linked with."""
    return -(-size * percent // 100)


def first_columns(columns: np.ndarray) -> np.ndarray:
    """Columns that can be among the first ones in the order, whatever the counts: those that are
    counted, and as many of the others as it takes."""
    counted = int(np.searchsorted(columns, np.uint64(COUNTED)))
    return columns[: max(counted, len(columns) - least_shared(len(columns)) + 1)]


def _texts_columns(texts: pa.Array) -> Iterator[np.ndarray]:
    for part in text_slices(texts):
        _word_hashes().trim()
        for text in part:
            yield columns_of(spaced_words(text))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32())
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(offsets, flat)


def _signed(texts: pa.Array) -> pa.Array:
    sizes, nodes, firsts = [], [], []
    for columns in _texts_columns(texts):
        sizes.append(len(columns))
        nodes.append(xxhash.xxh64_intdigest(columns.tobytes()))
        firsts.append(first_columns(columns) if len(columns) else columns)
    node = pa.array(np.array(nodes, np.uint64).view(np.int64))
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), node, _lists(firsts)], ["n", "node", "firsts"]
    )


def _all_columns(texts: pa.Array) -> pa.Array:
    return _lists(list(_texts_columns(texts)))


def _linked(common: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return 100 * common >= SIMILAR_PERCENT * (size + sizes - common)


class _Rows:
    """Rows of a group, as the tasks get them."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.node = table["node"].to_numpy()
        self.root = table["root"].to_numpy()
        self.own = table["own"].to_numpy()
        lists = table["columns"].combine_chunks()
        self.columns = lists.flatten().to_numpy()
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def star_links(rows: _Rows) -> pa.RecordBatch:
    """Links of a block of rows with the center, which is one of them: one row of the product."""
    owner = np.repeat(np.arange(len(rows.node)), rows.sizes)
    center = int(np.flatnonzero(rows.node == rows.root)[0])
    known = np.isin(rows.columns, rows.columns[owner == center])
    common = np.bincount(owner[known], minlength=len(rows.node))
    found = _linked(common, rows.sizes[center], rows.sizes) & (rows.node != rows.root)
    return _links(rows.node[found], rows.root[found])


def block_links(rows: _Rows) -> pa.RecordBatch:
    """Links that join rows of different components (and, if the rows are of two blocks, of different
    blocks), until no two can be joined."""
    count = len(rows.node)
    _, column, often = np.unique(rows.columns, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), rows.sizes)
    shared = often[column] > 1  # a column that one row has alone adds to no overlap
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    starts = np.append(0, np.cumsum(np.bincount(owner, minlength=count)))
    order = np.argsort(column, kind="stable")
    held, heads = owner[order], np.append(0, np.cumsum(np.bincount(column)))
    part = np.unique(rows.root, return_inverse=True)[1]
    one = rows.own.min() == rows.own.max()
    main = np.bincount(part).argmax()
    a, b = [], []
    for i in np.flatnonzero(part != main):
        names = column[starts[i] : starts[i + 1]]
        if 100 * len(names) < SIMILAR_PERCENT * rows.sizes[i]:
            continue  # too few columns are in any other row
        first, size = heads[names], heads[names + 1] - heads[names]
        before = np.cumsum(size) - size
        at = np.repeat(first - before, size) + np.arange(size.sum())
        common = np.bincount(held[at], minlength=count)
        found = _linked(common, rows.sizes[i], rows.sizes) & (part != part[i])
        if not one:
            found &= rows.own != rows.own[i]
        for j in np.flatnonzero(found):
            if part[j] != part[i]:
                a.append(rows.node[i])
                b.append(rows.node[j])
                part[part == part[i]] = part[j]
    return _links(np.array(a, np.int64), np.array(b, np.int64))


def _groups(step):
    """A function of the rows of each (key, first, second), which follow each other."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("key", "first", "second")])
            turns = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            for begin, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if begin == end:
                    continue
                key = tuple(keys[:, begin])
                if held and key != now:
                    yield step(_Rows(held))
                    held = []
                now = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield step(_Rows(held))

    return grouped


class NgramJoin:
    """The links among the documents of a table, and what follows from them."""

    def __init__(
        self,
        docs: DataFrame,
        doc_id: str = "doc_id",
        text: str = "text",
        block_columns: int = BLOCK_COLUMNS,
    ):
        small_batches(docs.sparkSession)
        self.block_columns = block_columns
        self.texts = docs.select(
            F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")
        )
        signed = F.arrow_udf(_signed, "n long, node long, firsts array<long>")("text")
        #: One row per document: doc_id, text_key, n, node, firsts.
        self.signed = stored(
            self.texts.withColumn("s", signed).select("doc_id", "text_key", "s.*"), "signed"
        )
        #: One row per set of shingles that is not empty, with one of its documents.
        self.nodes = stored(
            self.signed.where("n > 0")
            .groupBy("node")
            .agg(
                F.min(F.struct("doc_id", "text_key")).alias("one"),
                F.min("doc_id").alias("least"),
                F.first("n").alias("n"),
                F.first("firsts").alias("firsts"),
            ),
            "nodes",
        )
        self.roots = stored(self._roots(), "roots")

    def _members(self) -> DataFrame:
        """key (a column), node, n: rows by their first columns, where another row has it there."""
        every = self.nodes.select("node", "n", F.size("firsts").alias("listed"), F.explode("firsts").alias("key"))
        often = every.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
        shared = stored(every.join(often, "key"), "shared")
        node = W.partitionBy("node")
        wanted = F.col("n") - F.ceil(F.col("n") * SIMILAR_PERCENT / 100) + 1
        # Columns that no other row has are first; they fill up the first columns but make no bucket.
        alone = F.col("listed") - F.count("*").over(node)
        late = (F.shiftrightunsigned("key", 62) != 0).alias("late")
        firsts = (
            shared.select("*", late, wanted.alias("wanted"))
            .select(
                "key",
                "node",
                "n",
                (F.col("wanted") - alone).alias("left"),
                F.row_number().over(node.orderBy("late", "rows", "key")).alias("place"),
            )
            .where("place <= left")
            .select("key", "node", "n")
        )
        firsts = stored(firsts, "firsts")
        several = firsts.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
        return stored(firsts.join(several.select("key"), "key", "left_semi"), "members")

    def _roots(self) -> DataFrame:
        """(node, root) of the nodes that are linked with another."""
        members = self._members()
        sets = self._sets(members.select("node").distinct())
        least = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("center"))
        close = F.least("n", "center.n") * 100 >= F.greatest("n", "center.n") * SIMILAR_PERCENT
        pairs = (
            members.join(least, "key")
            .where((F.col("node") > F.col("center.node")) & close)
            .groupBy("node")
            .agg(F.min("center.node").alias("root"), F.first("n").alias("n"))
        )
        links = stored(self._stars(stored(pairs, "pairs"), sets), "links")
        roots = stored(components(links), "roots")
        more = stored(self._blocks(members, roots, sets).distinct(), "links")
        if more.isEmpty():
            return roots
        # What was linked before is one node now.
        joined = more
        for side in ("a", "b"):
            joined = (
                joined.join(roots.withColumnRenamed("node", side), side, "left")
                .withColumn(side, F.coalesce("root", side))
                .drop("root")
            )
        upper = components(joined).toDF("root", "top")
        ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        every = roots.unionByName(
            ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
        )
        return every.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    def _stars(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links of rows with their center, in blocks of rows that each hold the center too."""
        blocks = pairs.groupBy(F.col("root").alias("center")).agg(
            F.ceil(F.sum("n") / self.block_columns).cast("int").alias("blocks")
        )
        rows = pairs.select("node", "root").join(blocks, F.col("root") == F.col("center"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        centers = blocks.select(
            F.col("center").alias("node"),
            F.col("center").alias("root"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("first"),
        )
        placed = rows.select("node", "root", block.alias("first")).unionByName(centers)
        placed = placed.select(
            F.col("root").alias("key"), "first", F.lit(0).alias("second"), F.lit(0).alias("own"), "node", "root"
        )
        return self._grouped(placed, sets, star_links)

    def _blocks(self, members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between components within buckets. Of buckets with the same rows one is enough; and
        components that meet in some bucket form a group, whose rows are compared at once where
        that moves fewer columns than going through its buckets."""
        placed = members.join(roots, "node", "left").select(
            "key", "node", "n", F.coalesce("root", "node").alias("root")
        )
        same = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
        mixed = (
            placed.groupBy("key")
            .agg(
                F.min("root").alias("least"),
                F.max("root").alias("most"),
                F.count("*").alias("rows"),
                F.sum("n").alias("columns"),
                same.alias("same"),
            )
            .where("least < most")
            .groupBy("rows", "columns", "same", "least")
            .agg(F.min("key").alias("key"))
            .select("key", "least", "columns", self._in_blocks("columns").alias("blocks"))
        )
        mixed = stored(mixed, "buckets")
        rows = stored(placed.join(mixed, "key"), "mixed")
        meeting = components(rows.select(F.col("root").alias("a"), F.col("least").alias("b")))
        groups = stored(meeting.toDF("root", "group"), "groups")
        by_bucket = (
            mixed.join(groups, F.col("least") == F.col("root"))
            .groupBy("group")
            .agg(F.sum(F.col("columns") * F.col("blocks")).alias("moved"))
        )
        once = rows.select("node", "n", "root").distinct().join(groups, "root")
        sizes = once.groupBy("group").agg(F.sum("n").alias("columns"))
        blocks = self._in_blocks("columns").alias("group_blocks")
        chosen = (
            sizes.join(by_bucket, "group")
            .select("group", blocks, (F.col("columns") * blocks <= F.col("moved")).alias("whole"))
        )
        chosen = stored(groups.join(chosen, "group"), "chosen")
        whole = once.drop("group").join(chosen.where("whole"), "root").select(
            F.col("group").alias("key"), "node", "root", F.col("group_blocks").alias("blocks")
        )
        single = rows.join(chosen.where("NOT whole").select("root"), "root").select(
            "key", "node", "root", "blocks"
        )
        every = whole.unionByName(single)
        own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        paired = every.select("key", "node", "root", own.alias("own"), met.alias("met")).select(
            "key",
            F.least("own", "met").alias("first"),
            F.greatest("own", "met").alias("second"),
            "own",
            "node",
            "root",
        )
        return self._grouped(paired, sets, block_links)

    def _in_blocks(self, columns: str) -> Column:
        return F.ceil(F.col(columns) / self.block_columns).cast("int")

    @staticmethod
    def _grouped(placed: DataFrame, sets: DataFrame, step) -> DataFrame:
        names = ["key", "first", "second", "own", "node", "root", "columns"]
        return (
            placed.join(sets, "node")
            .repartition("key", "first", "second")
            .sortWithinPartitions("key", "first", "second")
            .select(*names)
            .mapInArrow(_groups(step), "a long, b long")
        )

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """node, columns: the whole row of each of the nodes, from the text of its document."""
        wanted = stored(nodes.join(self.nodes.select("node", "one"), "node"), "wanted")
        found = fit_to_broadcast(
            wanted.select("node", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("key"))
        )
        same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_key").eqNullSafe(F.col("key"))
        texts = self.texts.join(found, same).select("node", "text")
        whole = texts.dropDuplicates(["node"])  # of rows given twice
        return stored(
            whole.select("node", F.arrow_udf(_all_columns, "array<long>")("text").alias("columns")), "sets"
        )

    def result(self) -> DataFrame:
        """doc_id, n_shingles and component_id (smallest doc_id) for every row."""
        least = (
            self.nodes.join(self.roots, "node").groupBy("root").agg(F.min("least").alias("component"))
        )
        ids = (
            self.nodes.select("node", "least")
            .join(self.roots, "node", "left")
            .join(least, "root", "left")
            .select("node", F.coalesce("component", "least").alias("component"))
        )
        own: Column = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return (
            self.signed.select("doc_id", "n", "node")
            .join(ids, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
        )


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row."""
    return NgramJoin(docs, doc_id, text).result()
