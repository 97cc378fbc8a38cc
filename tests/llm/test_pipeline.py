"""Queries against their SQL, and the pipeline against its parts in plain Python."""

from __future__ import annotations

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from meterlens.llm import queries as llm
from meterlens.llm.near_dups import shingles
from meterlens.llm.vocabulary import DEFAULT_VOCABULARY

QUERIES, SQL = llm.queries(), llm.oracle_sql()


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(str(r[n]) for n in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert plain(names, want) == plain(got.columns, got.collect())


def test_all_are_registered():
    assert set(llm.queries()) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())
    assert [name.split("_")[0] for name in llm.queries()] == [f"op{n}" for n in range(1, 14)]


def test_stages(spark, sf_dir):
    """Each stage takes what it should from what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, found = docs.columns, {}
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert docs.columns == columns
        docs = docs.cache()
        found[name] = {r.doc_id: r for r in docs.collect()}
        assert len(found[name]) == docs.count()
    verdict = {r.doc_id for r in llm.quality_rules(spark, sf_dir).collect() if r.kept}
    assert set(found["quality_rules"]) == verdict
    kept = found["near_dedup"]
    assert set(kept) < verdict
    sets = {d: shingles(r.text) for d, r in kept.items()}
    for d in verdict - set(kept):  # each has a neighbour that is kept, by a chain of one here
        mine = shingles(rows[d].text)
        assert any(100 * len(mine & s) >= 60 * len(mine | s) for s in sets.values())
    hit = {r.doc_id for r in llm.benchmark_hits(spark, sf_dir).collect() if r.contaminated}
    assert set(found["decontaminate"]) == set(kept) - hit
    masked = found["secret_scans"]
    assert set(masked) == set(found["decontaminate"])
    leaky = {r.doc_id for r in llm.secret_scans(spark, sf_dir).collect() if r.spans}
    for d, r in masked.items():
        assert ("[secret]" in r.text) == (d in leaky)
        assert r.n_chars == len(r.text)
    library = Tokenizer.from_file(DEFAULT_VOCABULARY)
    for d, r in found["tokens"].items():
        assert list(r.token_ids) == library.encode(masked[d].text, add_special_tokens=False).ids
        assert r.n_tokens == len(r.token_ids)
    assert set(found["tokens"]) == set(masked)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids_sha256", "token_ids"} <= set(got.columns)
    assert "text" not in got.columns and got.count() > 0


def test_extra_columns_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "*", "1 AS votes", "2 AS node", "3 AS blob", "4 AS matches", "5 AS token_ids"
    )
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert docs.columns == columns
    assert {"votes", "token_ids", "token_ids_"} <= set(docs.columns)
    assert docs.where("votes = 1 AND node = 2 AND blob = 3 AND matches = 4").count() == docs.count()


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
