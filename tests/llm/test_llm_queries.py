"""The queries of the package on the smallest tables, and the pipeline beside its plain version."""

from __future__ import annotations

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.compare import TABLES, difference
from tests.llm.plain import words
from tests.llm.test_dedup import plain_classes, plain_removal
from tests.llm.test_texts import full_ids, order, plain_counts, plain_distances, trimmed
from tidemill.llm import quality_rules
from tidemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert difference(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[:4] in ("op1_", "op2_", "op5_", "op10", "op9_")])
def test_every_document_has_its_row(spark, name):
    got = QUERIES[name](spark, SF)
    ids = got.where("piece = 0") if "piece" in got.columns else got
    assert order(r.doc_id for r in ids.collect()) == order(d for (d,) in rows_of(spark, "documents", "doc_id"))


def test_found_documents(spark):
    docs, items = rows_of(spark, "documents", "doc_id", "text"), rows_of(spark, "benchmark", "item_id", "text")
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_benchmark_decontamination"](spark, SF).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if trimmed(x) in trimmed(t)}
    assert {r.doc_id for r in QUERIES["op4_license_scan"](spark, SF).collect()} >= {d for d, t in docs if "Released under the MIT License." in (t or "")}
    made = QUERIES["op7_token_matrices"](spark, SF).collect()
    assert sum(r.n_tokens for r in made) == sum(len(ids) for _, ids in full_ids(docs))


def plain_pipeline(docs, items):
    """(doc_id, text) that reach packing."""
    kept, vectors = [], []
    for doc, text in docs:
        n, chars, symbols, dups, again = plain_counts(text)
        if n >= 10 and 100 * again <= 20 * n:
            kept.append((doc, text))
            lines = sum(1 for x in text.split("\n") if words(x))
            vectors.append([np.log(n), 2 * np.log1p(chars / n), np.sqrt(symbols / chars), np.sqrt(dups / max(lines, 1)), np.sqrt(again / n)])
    far = plain_distances(np.array(vectors))
    kept = [x for x, d in zip(kept, far) if d <= quality_rules.CUTOFF]
    kept = [x for x, (doc, _, least) in zip(kept, plain_classes(kept)) if doc == least]
    lost = {doc: gone for doc, _, gone, _ in plain_removal(kept)}
    first = {}
    for doc, text in kept:
        w = words(text)
        for s in range(len(w) - 12):
            first[tuple(w[s : s + 13])] = min(first.get(tuple(w[s : s + 13]), doc), doc)
    out = []
    for doc, text in kept:
        if lost[doc]:
            w, gone = words(text), set()
            for s in range(len(w) - 12):
                if first[tuple(w[s : s + 13])] < doc:
                    gone |= set(range(s, s + 13))
            text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        if not any(trimmed(x) in trimmed(text) for _, x in items):
            out.append((doc, text))
    return out


def test_pipeline_equals_its_plain_version(spark):
    docs, items = rows_of(spark, "documents", "doc_id", "text"), rows_of(spark, "benchmark", "item_id", "text")
    got = corpus_pipeline.run(spark, SF).toPandas()
    plain = plain_pipeline(docs, items)
    assert 0 < len(plain) < len(docs)
    want = [(d, n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4"))) for d, ids in full_ids(plain) for n, at in enumerate(range(0, len(ids), 4096))]
    assert order(tuple(map(int, r)) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == order(want)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "packing"]


def test_native_operators_run_no_python(spark):
    for name in ("op6_url_filters", "op10_quality_rules"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
