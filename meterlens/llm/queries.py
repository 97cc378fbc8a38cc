"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm import (
    alignment,
    bpe,
    conversations,
    decontamination,
    html_text,
    language,
    licenses,
    near_dups,
    ngram_join,
    quality,
    secret_scan,
    sharding,
    token_counts,
)
from meterlens.llm.common import hex_digest, stored
from meterlens.sources.scratch import scratch_dir

SHARDS = 40
TOKEN_LIMIT = 2048
FOLDS, HELD_OUT_FOLD = 3, 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by a scan with a new ledger."""
    ledger = secret_scan.Ledger(spark, scratch_dir(spark, "ledger"))
    versions = ledger.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")

    return ledger.on_paths(versions).select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        secret_scan.span_digest(secret_scan.of_kinds(found, secret_scan.BASE_RULES)).alias(
            "base_sha256"
        ),
        secret_scan.span_list(found).alias("spans"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of equal weight, by key."""
    return sharding.assign(_table(spark, sf_dir, "documents"), [1.0] * SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and how much of a text the limit holds, from the counts of its prefixes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = token_counts.token_count(F.col("prefixes"))
    return token_counts.with_prefix_counts(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens.alias("n_tokens"),
        (tokens > TOKEN_LIMIT).alias("over_limit"),
        token_counts.fitting_chars(F.col("prefixes"), TOKEN_LIMIT, F.col("text")).alias(
            "fitting_chars"
        ),
    )


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("matches")
    return decontamination.with_matches(docs, _table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        found["n_words"].cast("long").alias("n_words"),
        decontamination.hit_words(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        decontamination.items_digest(found).alias("items_sha256"),
        decontamination.contaminated(found).alias("contaminated"),
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.with_main_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = F.col("counts")
    counted = docs.select("doc_id", quality.counts(F.col("text")).alias("counts"))
    voted = stored(counted.withColumn("votes", quality.votes(found)), "votes")
    probability = quality.fit(voted).posterior(F.col("votes"))
    return voted.select(
        "doc_id",
        *[found[c].alias(c) for c in quality.COUNTS],
        quality.base_failed(found).alias("base_failed"),
        (~quality.base_failed(found) & (probability >= 0.5)).alias("kept"),
        probability.alias("probability"),
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    held_out = F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))
    model = language.learn(docs.where(~held_out))
    found = language.with_language(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("predicted.lang").alias("lang_pred"),
        F.col("predicted.score").alias("score"),
    )


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    every = F.col("notices")["places"]
    base = licenses.base_places(F.col("notices"))
    words = F.transform(base, lambda p: p["word"])
    best = F.array_max(F.transform(every, lambda p: p["score"]))
    return licenses.with_notices(docs).select(
        "doc_id",
        F.col("notices.n_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"),
        F.array_max(words).cast("long").alias("last_word"),
        licenses.labels(base).alias("base_labels"),
        licenses.labels(every).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they stand for."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("coded.ids")
    return bpe.round_trip(docs).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        hex_digest(F.array_join(ids.cast("array<string>"), " ")).alias("ids_sha256"),
        hex_digest(F.col("coded.decoded")).alias("decoded_sha256"),
    )


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by the similarity of four-word shingles."""
    return ngram_join.similar(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document, and which ids go together."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.with_alignment(docs, digest=True, keep=["doc_id"]).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.col("groups").alias("groups_sha256"),
        "n_shared",
    )


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, repair and digest of every damaged conversation; those of which nothing is left
    have zeros, no audit and the digest of nothing."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.Conversations(conversations.damaged(rows)).result()
    every = rows.select("conv_id").distinct()
    nothing = {"audit": F.lit(""), "digest": hex_digest(F.lit(""))}
    columns = [
        F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(
            "repaired_sha256" if c == "digest" else c
        )
        for c in conversations.RESULT
    ]
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    return every.join(found, same, "left").select("conv_id", *columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": secret_scans,
        "op2_sharding": shards,
        "op3_token_counts": count_tokens,
        "op4_decontamination": benchmark_hits,
        "op5_html_extraction": page_texts,
        "op6_quality_rules": quality_rules,
        "op7_language_id": languages,
        "op8_license_scans": license_notices,
        "op9_minhash_near_dedup": near_duplicates,
        "op10_bpe": bpe_round_trip,
        "op11_ngram_jaccard_join": similar_documents,
        "op12_tokenizer_alignment": aligned_tokens,
        "op13_conversation_repair": repaired_conversations,
    }


_ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
    r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _secrets_sql() -> str:
    """Positions are summed over the pieces that a split at the matches leaves."""
    patterns = [("assign", _ASSIGN, 2, 6)]
    patterns += [(r.kind, r.pattern, 0, 1) for r in secret_scan.RULES[1:]]
    parts = [
        f"SELECT rid, {n} AS ord, '{kind}' AS kind, {least} AS least,"
        f" string_split_regex(text, '{pattern}') AS b, regexp_extract_all(text, '{pattern}') AS w,"
        f" regexp_extract_all(text, '{pattern}', {group}) AS g FROM d"
        for n, (kind, pattern, group, least) in enumerate(patterns)
    ]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
p AS (SELECT rid, ord, kind,
        CAST(list_sum([length(x) FOR x IN b[1:i]]) + coalesce(list_sum([length(x) FOR x IN w[1:i - 1]]), 0) AS BIGINT) AS s,
        length(w[i]) AS size
      FROM i WHERE length(g[i]) >= least),
c AS (SELECT rid, ord, s, kind || ':' || s || ':' || (s + size) AS span FROM p),
f AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access,
        count(*) FILTER (ord = 2) AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (ord < 3), '') AS base,
        string_agg(span, ',' ORDER BY s, ord) AS spans
      FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_BENCHMARK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({decontamination.WINDOW}, len(w)) AS size,
         unnest([array_to_string(w[s:s + least({decontamination.WINDOW}, len(w)) - 1], ' ')
                 FOR s IN range(1, greatest(len(w) - {decontamination.WINDOW} + 2, 2))]) AS win
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
starts AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT rid, s, size, item FROM (SELECT rid, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM starts) x
         JOIN bw USING (size, win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT rid, s, size FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""

_NEAR_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, greatest(len(w) - 3, 2))]) AS shingle
      FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
          FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * common >= {near_dups.SIMILAR_PERCENT} * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(r.low, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others depend on a tokenizer, a CRC, a fitted model or fuzzy matching."""
    return {
        "op1_secret_scans": _secrets_sql(),
        "op4_decontamination": _BENCHMARK_SQL,
        "op9_minhash_near_dedup": _NEAR_SQL,
    }
