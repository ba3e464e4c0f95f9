"""Registered queries: those with SQL against DuckDB, and the pipeline stage by stage against brute force."""

import hashlib

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_operators import base_spans, brute_components, brute_targets, word_counts

import corpus_pipeline
from ladle.llm import pieces, pii, quality, queries


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = queries.QUERIES[key](spark, SF_SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[key]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_entry_registers_every_operator_once():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def test_pipeline_stages_equal_brute_force(spark):
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    text = {r.doc_id: r.text for r in docs.collect()}

    good = steps["quality rules"](spark, docs, SF_SMALL).cache()
    kept = {r.doc_id for r in good.collect()}
    judged = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    for i, t in text.items():
        n, _, _, _, rep = word_counts(t)
        failed = n < 50 or 100 * rep > 50 * n
        assert (i in kept) == (not failed and judged[i].quality_posterior >= 0.5)

    one = steps["near duplicates"](spark, good, SF_SMALL).cache()
    component, _ = brute_components({i: text[i] for i in kept}, 5, 80)
    left = {r.doc_id for r in one.collect()}
    assert left == set(component.values()) and one.count() == len(left)

    clean = steps["personal data"](spark, one, SF_SMALL).cache()
    rows = {r.doc_id: r for r in clean.collect()}
    assert set(rows) == left
    for i, r in rows.items():
        out, at = "", 0
        for start, kind, end in base_spans(text[i]):
            if start >= at:
                out += text[i][at:start] + f"<{pii.KINDS[kind].upper()}>"
            at = max(at, end)
        assert r.text == out + text[i][at:] and r.n_chars == len(r.text)

    mixed = steps["source mix"](spark, clean, SF_SMALL).cache()
    sizes, taken = {}, {}
    for r in rows.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert r.text == rows[r.doc_id].text
    longest = max(len(r.text.split()) for r in rows.values())
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= longest

    for df in (good, one, clean, mixed):
        assert df.columns == docs.columns
    last = steps["sentencepiece"](spark, mixed, SF_SMALL).collect()
    table = pieces.load(queries.tokenizer_path(queries.PIECE_MODEL))
    assert len(last) == mixed.count()
    for r in last:
        assert r.ids == table.encode(rows[r.doc_id].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.replace(pieces.MARK, " ").encode()).hexdigest()


def test_pipeline_runs_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter(F.lit(False))
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF_SMALL)
    assert docs.count() == 0
