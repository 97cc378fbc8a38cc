"""Alignment of two tokenizers against plain loops over byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from meterlens.llm import alignment as A
from meterlens.llm.queries import aligned_tokens

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def tokenizers():
    return A.Tokenizers()


def brute(texts, tokenizers):
    """The result of each text, by the whole texts' tokens."""

    def ranges(ids, table):
        out, at = [], 0
        for n in ids:
            out.append((at, at + len(table[n]), n))
            at += len(table[n])
        return out

    parts, counts = [], Counter()
    for text in texts:
        if not text:
            parts.append(None)
            continue
        raw = f" {text}".encode()
        ids_a = tokenizers.first.encode(f" {text}", add_special_tokens=False).ids
        ids_b = tokenizers.second.encode(text)
        a, b = ranges(ids_a, tokenizers.bytes_a), ranges(ids_b, tokenizers.bytes_b)
        if any(b"".join(t[n] for n in ids) != raw for ids, t in ((ids_a, tokenizers.bytes_a), (ids_b, tokenizers.bytes_b))):
            parts.append(None)
            continue
        links, at = [], 0
        for begin, end, x in a:
            while b[at][1] <= begin:
                at += 1
            k = at
            while k < len(b) and b[k][0] < end:
                links.append((x, b[k][2]))
                k += 1
        counts.update(links)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            mine, theirs = [], []
            while i < len(a) and a[i][1] <= cut:
                mine.append(str(a[i][2]))
                i += 1
            while j < len(b) and b[j][1] <= cut:
                theirs.append(str(b[j][2]))
                j += 1
            groups.append(f"{','.join(mine)}|{','.join(theirs)}")
        parts.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (0,) * 6 + ("",)
        if p is None
        else (*p[:3], len(p[3]), sum(counts[k] == best[k[1]] for k in p[3]), sum(counts[k] for k in p[3]), p[4])
        for p in parts
    ]


def generated(seed, many=400):
    rng = random.Random(seed)
    pieces = [
        " ", "  ", "\n", " \n", "a", "the", "é", "文", "\t", "'s", "<|endoftext|>", "</s>", "<0x41>", "<unk>",
        "　", "1", "!!", "\x00", "\xa0", "Straße", "ing", "tion", "-", "\x1c", "ﬁ", "🙂",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(many)]
    return [*texts, None, "", " ", "  ", " a", "a ", "a  ", "x▁y", "▁", "x" * 20_000, "文" * 3000]


def rows_of(df, key="id"):
    return {r[key]: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.mark.parametrize("common", [A.COMMON_PAIRS, 40, 0])
def test_equals_loops(spark, tokenizers, common):
    texts = generated(common % 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = rows_of(A.with_alignment(docs, common_pairs=common))
    assert got == dict(enumerate(brute(texts, tokenizers)))


def test_forgetting_words_changes_nothing(spark, tokenizers, monkeypatch):
    texts = generated(3, 60)
    words = A.Words(tokenizers)
    monkeypatch.setattr(A, "WORDS", 10)
    for text in texts:
        if words.full():
            words.clear()
        rows, counts = words.of([text])
        assert len(rows) == counts.sum()
        assert len(words.places) == len(words.table) == len(words.starts) - 1


def test_query(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute([r.text for r in docs], tokenizers)
    for row in aligned_tokens(spark, sf_dir).collect():
        n = next(k for k, r in enumerate(docs) if r.doc_id == row.doc_id)
        text = hashlib.sha256(want[n][6].encode()).hexdigest() if want[n][6] else ""
        assert tuple(row[c] for c in NAMES[:6]) == want[n][:6]
        assert row.groups_sha256 == text


def dense(matrix):
    out = np.zeros((len(matrix.starts) - 1, matrix.width), np.int64)
    for r in range(len(out)):
        for c in matrix.columns[matrix.starts[r] : matrix.starts[r + 1]]:
            out[r, c] += 1
    return out


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for most in (1, 7, 10**6):
        rows = [np.sort(rng.choice(9, rng.integers(0, 5), replace=False)) for _ in range(12)]
        starts = np.append(0, np.cumsum([len(r) for r in rows]))
        a = A.Csr(starts, np.concatenate(rows), 9)
        assert (dense(A.transposed(a)) == dense(a).T).all()
        want, got = dense(a) @ dense(a).T, np.zeros((12, 12), np.int64)
        for r, c, v in A.product(a, A.transposed(a), most):
            got[r, c] = v
        assert (got == want).all()


def test_overlaps_and_shared_groups(tokenizers):
    tokens = tokenizers.encode(["hello", "Donaudampfschiff", "文字"])
    rows, columns, shared = A.overlaps(tokens)
    ends = [np.cumsum(x) for x in tokens.lengths]
    begins = [e - x for e, x in zip(ends, tokens.lengths, strict=True)]
    for i in range(len(ends[0])):
        for j in range(len(ends[1])):
            both = min(ends[0][i], ends[1][j]) - max(begins[0][i], begins[1][j])
            at = np.flatnonzero((rows == i) & (columns == j))
            assert (shared[at].tolist() == [both]) if both > 0 else not len(at)
    in_a, in_b, _ = A.grouped(tokens)
    pairs = {(i, j) for r, c in A.shared_links(tokens, 3) for i, j in zip(r.tolist(), c.tolist(), strict=True)}
    assert pairs == {(i, j) for i in range(len(in_a)) for j in range(len(in_b)) if in_a[i] == in_b[j]}


def test_other_columns_nulls_and_empty_tables(spark):
    rows = [(1, "same text", "k", 5), (1, "same text", "k", 5), (None, None, "l", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, n_a int")
    for common in (A.COMMON_PAIRS, 0):
        got = A.with_alignment(docs, common_pairs=common)
        assert [c for c in got.columns if c not in A.NAMES] == ["doc_id", "text", "found"]
        assert len(got.collect()) == 3
        assert A.with_alignment(docs.limit(0), common_pairs=common).count() == 0


def test_tasks_share_words_and_frequent_ones_are_kept(monkeypatch):
    encoded = []
    plain = A.Tokenizers.encode
    monkeypatch.setattr(A.Tokenizers, "encode", lambda self, words: (encoded.extend(words), plain(self, words))[1])
    monkeypatch.setattr(A, "_remembered", {})
    monkeypatch.setattr(A, "WORDS", 8)
    count = A._count(A.FIRST, A.SECOND)

    def task(*texts):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        found = pa.Table.from_batches(count(iter([batch]))).to_pylist()
        return {(r["a"], r["b"]): r["n"] for r in found}

    first = task("the cat and the dog", "one two three", None)
    assert sorted(encoded) == ["and", "cat", "dog", "one", "the", "three", "two"]
    assert task("the cat and the dog", "one two three", None) == first
    assert len(encoded) == 7  # another task of the worker
    once = task("the four five six seven")
    assert len(encoded) == 11
    # Now there is no more room: words met twice at least stay, half of the room at most.
    assert task("the four five six seven") == once
    assert encoded.count("the") == 1
    assert len(encoded) == 15
    words = A._remembered[f"{A.FIRST} {A.SECOND}"]
    assert len(words.places) == len(words.table) == len(words.met) == len(words.starts) - 1


def test_kept_words_keep_their_results(tokenizers, monkeypatch):
    texts = generated(5, 80)
    rng = np.random.default_rng(2)
    every = A.Words(tokenizers)
    every.of(texts)
    keys = np.unique(every.keys)
    known = keys[rng.random(len(keys)) < 0.7]
    pairs = A.Pairs(known, rng.integers(1, 9, len(known)), rng.random(len(known)) < 0.5)
    want = A._aligned(A.Words(tokenizers, pairs), texts, False).to_pylist()
    monkeypatch.setattr(A, "WORDS", 40)
    words, got, kept = A.Words(tokenizers, pairs), [], 0
    for text in texts:
        if words.full():
            words.forget()
            kept += len(words.places)
            assert len(words.places) <= 20 and words.chars <= A.WORD_CHARS // 2
        got += A._aligned(words, [text], False).to_pylist()
    assert got == want
    assert kept


def test_words_are_cut_at_the_same_blanks_by_both_ways():
    rng = random.Random(4)
    signs = [chr(c) for c in range(0x110000) if regex.match(r"\s", chr(c))] + [" "] * 9 + list("abé文\x1c🙂")
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(1, 7)))
        assert A.words_of(text) == A._cut.split(text)
        assert A._odd(text) == bool(regex.search(r"\A |\s | \Z", text))
