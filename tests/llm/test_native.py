"""Secret scans, shards and quality counts against plain Python."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from meterlens.llm import quality, secret_scan, sharding
from meterlens.llm.queries import quality_rules, shards
from meterlens.llm.secret_scan import BASE_RULES, RULES, Ledger, Rule, mask_secrets

SECRETS = {
    "assign": (
        re.compile(
            r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            re.A,
        ),
        2,
        6,
    ),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def secrets_in(text):
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(SECRETS.items()):
        out += [
            (m.start(), order, f"{kind}:{m.start()}:{m.end()}")
            for m in pattern.finditer(text or "")
            if len(m[group]) >= least
        ]
    return ",".join(span for *_, span in sorted(out))


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(2)
    pieces = [
        "token", "Secret", "api_key", "APIKEY", "passwd", "PASSWORD", " = ", ":", "=", '"', "'",
        "abcdef12", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJ0123456789", "é", "𝒳", "\n",
        " ", "x", "ecret:aaaaaaa", "token:abc:", "https://u:pwd123@h",
    ]
    texts = [None, "", "secret:ſabcdef"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(600)]
    return [(n if n % 9 else None, t, "kept") for n, t in enumerate(texts)]


def test_spans_equal_a_plain_search(spark, tmp_path, leaky):
    docs = spark.createDataFrame(leaky, "doc_id long, text string, spans string")
    ledger = Ledger(spark, str(tmp_path))
    found = ledger.on_paths(ledger.scan(docs))
    assert found.count() == len(leaky)
    listed = secret_scan.span_list(secret_scan.of_kinds(F.col("spans"), BASE_RULES))
    got = {r.blob: r.s for r in found.select("blob", listed.alias("s")).collect()}
    for r in docs.select("text", secret_scan.blob_of(F.col("text")).alias("blob")).collect():
        assert got[r.blob] == secrets_in(r.text), r.text


def test_only_unseen_pairs_are_scanned(spark, tmp_path, leaky):
    docs = spark.createDataFrame(leaky, "doc_id long, text string, spans string")
    ledger = Ledger(spark, str(tmp_path))
    blobs = docs.select(secret_scan.blob_of(F.col("text"))).distinct().count()
    ledger.scan(docs)
    assert ledger.scans().select("blob").distinct().count() == blobs
    before = ledger.scans().count()
    ledger.scan(docs)
    assert ledger.scans().count() == before
    more = spark.createDataFrame([(1, "new text token = abcdefgh", "")], docs.schema)
    again = ledger.on_paths(ledger.scan(docs.unionByName(more)))
    assert ledger.scans().count() == before + 1
    assert again.count() == len(leaky) + 1
    changed = (*RULES[:-1], Rule("url_password", "u:pwd123", version=2))
    ledger.scan(docs, rules=changed)
    fresh = ledger.scans().where(F.array_contains("rules", "url_password@2"))
    assert fresh.where("size(rules) <> 1").count() == 0
    assert fresh.select("blob").distinct().count() == blobs
    kinds = ledger.findings(changed).select(F.explode("spans").alias("s")).select("s.*")
    assert {(r.kind, r.version) for r in kinds.select("kind", "version").distinct().collect()} >= {
        ("url_password", 2)
    }
    assert kinds.where("kind = 'url_password' AND version = 1").count() == 0


def test_secrets_are_masked(spark, tmp_path):
    key = "0123456789abcdef01234567"
    rows = [
        (1, f'a token = "{key}" z', 40, "x"),
        (1, f'a token = "{key}" z', 40, "x"),
        (2, None, None, "x"),
        (3, "plain", 5, None),
        (4, f"{key} and {key}", 53, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, blob string")
    got = mask_secrets(docs, str(tmp_path))
    assert got.columns == docs.columns and got.schema["n_chars"] == docs.schema["n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [
            (1, 'a [secret]" z', 13, "x"),
            (1, 'a [secret]" z', 13, "x"),
            (2, None, None, "x"),
            (3, "plain", 5, None),
            (4, "[secret] and [secret]", 21, "x"),
        ],
        key=str,
    )
    assert mask_secrets(docs.limit(0), f"{tmp_path}/none").count() == 0


def score(key, shard, weight=1.0):
    h = xxhash.xxh64_intdigest(str(key).encode(), 42) if key is not None else 42
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
    return -weight / math.log(((h >> 11) + 0.5) * 2.0**-53)


def best(key, weights):
    return max(range(len(weights)), key=lambda n: score(key, n, weights[n]))


def test_shards_of_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = shards(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = {}
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
        assert r.shard == best(r.doc_id, [1.0] * 40)
        assert r.grown_shard == best(r.doc_id, [1.0] * 41)
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_nulls_and_repeated_rows(spark):
    rows = [(n % 3000 if n % 10 else None, "x") for n in range(6000)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.assign(docs, [1.0, 3.0]).collect()
    assert len(got) == len(rows)
    assert {r.shard for r in got if r.doc_id is None} == {best(None, [1.0, 3.0])}
    share = Counter(r.shard for r in got if r.doc_id is not None)
    assert 2.6 < share[1] / share[0] < 3.4
    for shard in (0, 1):
        assert sorted(r.slot for r in got if r.shard == shard) == list(
            range(sum(r.shard == shard for r in got))
        )
    assert [(r.size, r.text_crc32) for r in got if r.size == 16] == [(16, 0)]
    assert sharding.assign(docs.limit(0), [1.0]).count() == 0
    named = sharding.with_shard(docs.withColumn("shard", F.lit(9)), [1.0])
    assert named.columns == ["doc_id", "text", "shard", "shard_"]
    with pytest.raises(ValueError):
        sharding.assign(docs, [1.0, 0.0])


def counts_of(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    w = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {
        n + k for n in range(len(w) - 2) if windows[tuple(w[n : n + 3])] > 1 for k in range(3)
    }
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
    }


def test_counts_equal_plain_loops(spark):
    rng = random.Random(1)
    pieces = ["a ", "b\n", "a", "\t", "é ", "|", "\x0b", "\x1c", "\n", "a b c ", "𝒳 "]
    texts = [None, "", " \n\n \n", "a", "a b c", "a a a a"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", quality.counts(F.col("text")).alias("c")).collect():
        assert {k: r.c[k] for k in quality.COUNTS} == counts_of(r.text), r.text


def test_verdicts_agree_with_labels(spark, sf_dir):
    labels = {
        r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    }
    rows = quality_rules(spark, sf_dir).collect()
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    judged = [r for r in rows if r.doc_id in labels and not r.base_failed]
    right = sum(r.kept == bool(labels[r.doc_id]) for r in judged)
    assert right >= 0.97 * len(judged)


def votes_at_random(seed, rules, share, many=20_000):
    """Patterns of rules with known accuracies on good and on bad documents."""
    rng = random.Random(seed)
    seen = Counter()
    for _ in range(many):
        good = rng.random() < share
        vote = []
        for on_good, on_bad in rules:
            right = rng.random() < (on_good if good else on_bad)
            kind = quality.GOOD if right == good else quality.BAD
            vote.append(quality.SILENT if rng.random() < 0.2 else kind)
        seen[tuple(vote)] += 1
    return seen


def test_estimation_finds_accuracies():
    true = [(0.99, 0.7), (0.98, 0.5), (0.99, 0.8), (0.97, 0.6)]
    found = quality.estimate(sorted(votes_at_random(6, true, 0.8).items()), 4)
    assert all(abs(a - t[0]) < 0.02 for a, t in zip(found.on_good, true, strict=True))
    assert all(abs(b - t[1]) < 0.06 for b, t in zip(found.on_bad, true, strict=True))
    assert abs(found.share - 0.8) < 0.03


def slow_estimate(rows, rules):
    """The same estimation, one document at a time, with products instead of logarithms."""

    def bounded(x):
        return min(quality.MOST, max(1 - quality.MOST, x))

    def good_of(row):
        ways = [share, 1 - share]
        for vote, g, b in zip(row, on_good, on_bad, strict=True):
            if vote:
                ways[0] *= g if vote == quality.GOOD else 1 - g
                ways[1] *= 1 - b if vote == quality.GOOD else b
        return ways[0] / sum(ways)

    on_good, on_bad = [quality.RIGHT_ON_GOOD] * rules, [quality.RIGHT_ON_BAD] * rules
    share = quality.START_SHARE
    rows = [r for r in rows if any(r)]
    belief = quality.FEW_VOTES + quality.BELIEF * len(rows)
    for _ in range(400):
        good = [good_of(r) for r in rows]
        new_good, new_bad = [], []
        for k in range(rules):
            said = [(r[k], g) for r, g in zip(rows, good, strict=True) if r[k]]
            right = sum(g for v, g in said if v == quality.GOOD)
            new_good.append(bounded((quality.RIGHT_ON_GOOD * belief + right) / (belief + sum(g for _, g in said))))
            right = sum(1 - g for v, g in said if v == quality.BAD)
            few = quality.FEW_VOTES
            new_bad.append(bounded((quality.RIGHT_ON_BAD * few + right) / (few + sum(1 - g for _, g in said))))
        share = bounded((quality.START_SHARE * quality.FEW_VOTES + sum(good)) / (quality.FEW_VOTES + len(rows)))
        on_good, on_bad = new_good, new_bad
    return on_good, on_bad, share, good_of


def test_posterior_equals_a_slow_estimation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cast = quality.votes(quality.counts(F.col("text")))
    rows = {r.doc_id: tuple(r.v) for r in docs.select("doc_id", cast.alias("v")).collect()}
    *_, good_of = slow_estimate(list(rows.values()), len(quality.RULES))
    for r in quality_rules(spark, sf_dir).collect():
        assert abs(r.probability - good_of(rows[r.doc_id])) < 1e-6


def test_estimated_accuracies_decide():
    """The first rule accuses a third of the good documents, the last one hardly tells good from bad:
    neither a vote of the one against a document nor one of the other for it decides. With the
    accuracies believed before the estimation both do."""
    rules = [(0.65, 0.7), (0.99, 0.9), (0.99, 0.9), (0.99, 0.9), (0.6, 0.3)]
    model = quality.estimate(sorted(votes_at_random(3, rules, 0.45).items()), 5)
    constant = quality.VoteModel(
        (quality.RIGHT_ON_GOOD,) * 5, (quality.RIGHT_ON_BAD,) * 5, quality.START_SHARE
    )
    accused, praised = (-1, 0, 0, 1, 0), (0, 0, 0, 0, 1)
    assert model.probability(accused) > 0.5 > constant.probability(accused)
    assert model.probability(praised) < 0.5 < constant.probability(praised)


def test_a_common_habit_is_no_fault(spark):
    """A third of the sound documents have signs in them, which one rule accuses; they are kept."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(3000)]
    rows = []
    for n in range(300):
        signs = " & co" if n % 3 == 0 else ""
        lines = [f"{' '.join(rng.choices(words, k=9)).capitalize()}{signs}." for _ in range(12)]
        rows.append((n, "\n".join(lines)))
    for n in range(300, 340):
        rows.append((n, " ".join(f"{w.upper()}!!###" for w in rng.choices(words, k=90))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cast = quality.votes(quality.counts(F.col("text")))
    accused = {r.doc_id for r in docs.select("doc_id", cast.alias("v")).collect() if quality.BAD in r.v}
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert accused == {*range(0, 300, 3), *range(300, 340)} and kept == set(range(300))


def test_the_counting_is_planned_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000 and plan.count("regexp_extract_all") == 1


def test_quality_keeps_columns_and_takes_empty_tables(spark):
    prose = " ".join(f"word{n} goes." for n in range(60))
    rows = [(1, prose, 1), (1, prose, 1), (2, "### " * 100, 2), (3, None, 3), (4, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes int")
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    assert [tuple(r) for r in left.collect()] == rows[:2]
    assert quality.keep_good(docs.limit(0)).count() == 0
