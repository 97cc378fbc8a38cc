"""Similarity join against all pairs of a small table."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from meterlens.llm import ngram_join as N
from meterlens.llm.queries import similar_documents
from meterlens.llm.words import spaced_words

SCHEMA = "doc_id long, text string"


def row_of(text):
    words = spaced_words(text)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:], words[3:], strict=False))


def brute(rows):
    """n_shingles and component of every doc_id, by counting all overlaps."""
    sets = {d: row_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    held = defaultdict(list)
    for d, mine in sets.items():
        common = defaultdict(int)
        for shingle in mine:
            for other in held[shingle]:
                common[other] += 1
            held[shingle].append(d)
        for other, n in common.items():
            if 100 * n >= 85 * (len(mine) + len(sets[other]) - n):
                low, high = sorted((find(d), find(other)))
                root[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed):
    """Chains of copies that drift, a passage that many share, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    shared = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(25):
        text = rng.choices(vocabulary, k=rng.choice([2, 4, 6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 4, 15])):
            text = list(text)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    for n in range(60):  # from unlike to alike, around the bound
        own = rng.choices(vocabulary, k=3 + n % 20)
        rows.append(" ".join([*own, *shared]))
    rows += ["", " \n", "one", "ONE", "a b c", "a  b\tc", "a b c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, columns", [(1, N.BLOCK_COLUMNS), (2, 100), (3, 400)])
def test_components_equal_all_pairs(spark, seed, columns):
    rows = corpus(seed)
    got = N.NgramJoin(spark.createDataFrame(rows, SCHEMA), block_columns=columns).result().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = similar_documents(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_linked_rows_share_a_first_column():
    rng = random.Random(4)
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 40, 200]))]
        other = list(base)
        for _ in range(rng.randrange(3)):
            other[rng.randrange(len(other))] = "x"
        a, b = (N.columns_of([w.encode() for w in t]) for t in (base, other))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert len(np.intersect1d(N.first_columns(a), N.first_columns(b)))


def test_nulls_ties_repeated_rows_and_extra_columns(spark):
    same = "one two three four five six seven"
    rows = [
        (5, same, 1, "a"), (5, same, 1, "a"), (3, same.upper(), 2, "b"), (None, same, 3, "c"),
        (7, None, 4, "d"), (None, None, 5, "e"), (8, "", 6, "f"), (9, "a b", 7, "g"), (10, "A  B", 8, "h"),
        (None, "lonely words", 9, "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, key string")
    got = N.similar(docs).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    want = [
        (5, 4, 3), (5, 4, 3), (3, 4, 3), (None, 4, 3), (7, 0, 7), (None, 0, None), (8, 0, 8),
        (9, 1, 9), (10, 1, 9), (None, 1, None),
    ]
    assert found == sorted(want, key=str)
    assert N.similar(docs.limit(0)).count() == 0


def test_a_bucket_of_many_rows_in_several_components(spark):
    """All rows share a passage that is most, but not 85 %, of each: one bucket, no link but of
    neighbours, and a chain of these."""
    words = [f"w{n}" for n in range(400)]
    rows = [(n, " ".join(words[n : n + 100])) for n in range(0, 300, 5)]
    rows += [(1000 + n, " ".join(words[n : n + 100])) for n in range(0, 300, 50)]
    got = N.NgramJoin(spark.createDataFrame(rows, SCHEMA), block_columns=500).result().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
