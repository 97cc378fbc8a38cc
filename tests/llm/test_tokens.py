"""Token counts and BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlens.llm import bpe, token_counts
from meterlens.llm.bpe import FragmentEncoder
from meterlens.llm.queries import bpe_round_trip, count_tokens
from meterlens.llm.token_counts import PrefixCounts
from meterlens.llm.vocabulary import DEFAULT_VOCABULARY

LIBRARY = Tokenizer.from_file(DEFAULT_VOCABULARY)
ODD = "ab'sT é\n\t\x1c\x85\xa0ſİΣß文́​12¼²_-.ǅ"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pieces = [*ODD, "<|endoftext|>", "<|startoftext|>", "</w>", "don't", "I'LL", "<|ENDOFTEXT|>"]
    out = ["", " ", "a", "x" * 3000, "word " * 500, "\n\r\x0b\x0c", "naïve ΣΑΣ"]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(30)) for _ in range(200)]
    return out


def test_counts_are_the_library_s(texts):
    counter = PrefixCounts()
    for text in texts:
        ends, counts = counter.text(text)
        assert (counts[-1] if len(counts) else 0) == len(ids(text)), text


def test_every_prefix_that_ends_with_a_word(texts):
    counter = PrefixCounts()
    for text in texts[-300::5]:
        ends, counts = counter.text(text)
        for end, count in zip(ends, counts, strict=True):
            assert count == len(ids(text[:end])), (text, end)


def test_every_prefix_of_a_word():
    counter = PrefixCounts()
    for word in ("unbelievable", "thntatly", "antidisestablishment", "zzzzz"):
        _, alone = counter.piece(word, every=True)
        assert alone == [len(ids(word[:n])) for n in range(len(word) + 1)]


def test_budgets_inside_words(spark, texts):
    rng = random.Random(6)
    words = [
        "文字列" * 12, "ภาษาไทย" * 8, "thntatlyunbelievable" * 3, "we'll've'RE!!", "a1b22,c;;d''ll",
        "cafe\u0301s\u0301", "x<|endoftext|>yz", "İİΣΑΣ¼", "".join(rng.choices("aB9+/=", k=90)),
    ]
    cases = [*words, "one two " + words[0], "a\n  " + words[2] + " b", "", " ", *texts[7:60]]
    docs = spark.createDataFrame([(t,) for t in cases] + [(None,)], "text string")
    budgets = (0, 1, 2, 5, 11)
    counted = token_counts.with_prefix_counts(docs)
    fits = [token_counts.fitting_chars(F.col("prefixes"), b, F.col("text")) for b in budgets]
    got = counted.select("text", F.array(*fits).alias("fits")).collect()
    assert len(got) == len(cases) + 1
    blank = " \t\n\r\x0b\x0c"
    for r in got:
        text = r.text or ""
        ends = [n for n in range(1, len(text) + 1) if text[n - 1] not in blank]
        counts = {n: len(ids(text[:n])) for n in ends}
        want = [max((n for n in ends if counts[n] <= b), default=0) for b in budgets]
        assert list(r.fits) == want, r.text


def test_long_word_without_blanks():
    text = "文字" * 5000
    n = PrefixCounts().longest(text, 2048)
    assert n > 0 and len(ids(text[:n])) <= 2048 < min(len(ids(text[: n + k])) for k in range(1, 30))


def test_ids_are_the_library_s(texts):
    encoder = FragmentEncoder()
    flat, sizes = encoder.encode(texts)
    at = 0
    for text, size in zip(texts, sizes, strict=True):
        assert list(flat[at : at + size]) == ids(text), text
        at += size


def test_no_token_spans_a_cut():
    encoder = FragmentEncoder()
    for word in ("qxzvb", "thntatly", "q"):
        fragments = encoder.cut(word)
        assert "".join(fragments) == word
        for left, right in zip(fragments, fragments[1:], strict=False):
            pair = left[-1] + right[0]
            assert not any(pair in token.removesuffix("</w>") for token in encoder.vocabulary.ids)


def test_only_empty_texts():
    flat, sizes = FragmentEncoder().encode([None, ""])
    assert len(flat) == 0 and list(sizes) == [0, 0]


def test_columns_stay_and_nulls_have_no_tokens(spark):
    docs = spark.createDataFrame(
        [(1, "hello world", 9), (1, "hello world", 9), (None, None, None)],
        "doc_id long, text string, tokens int",
    )
    counted = token_counts.with_prefix_counts(docs).select(
        "*",
        token_counts.token_count(F.col("prefixes")).alias("n"),
        token_counts.fitting_chars(F.col("prefixes"), 1).alias("fit"),
    )
    got = sorted(((r.doc_id or 0, r.tokens, r.n, r.fit) for r in counted.collect()), key=str)
    assert got == [(0, None, 0, 0), (1, 9, 2, 5), (1, 9, 2, 5)]
    coded = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.decoded, list(r.ids)) for r in coded)[::2] == [
        ("", []),
        ("hello</w> world</w>", ids("hello world")),
    ]


def test_decoding_ids_of_any_kind(spark):
    rows = spark.createDataFrame([([320, 49407, 99999, None],), ([],), (None,)], "ids array<int>")
    assert sorted(r.decoded for r in bpe.decode(rows).collect()) == ["", "", "a</w> <|endoftext|>"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.with_prefix_counts(docs).count() == 0
    assert bpe.decode(bpe.encode(docs)).count() == 0
    assert bpe.round_trip(docs).count() == 0


def test_queries_over_documents(spark, sf_dir):
    docs = {
        r.doc_id: r.text
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    }
    counted = count_tokens(spark, sf_dir).collect()
    assert len(counted) == len(docs)
    for r in counted:
        n = len(ids(docs[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 2048)
        assert r.n_bytes == len((docs[r.doc_id] or "").encode())
        assert len(ids(docs[r.doc_id][: r.fitting_chars])) <= 2048
    for r in bpe_round_trip(spark, sf_dir).collect():
        want = ids(docs[r.doc_id])
        text = LIBRARY.decode(want, skip_special_tokens=False)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
