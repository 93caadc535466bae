"""The pipeline's stages on the smallest tables, next to what each has to do."""

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from punctual.llm.common import read, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [read(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "step"))
    return [df.toPandas() for df in out]


def test_columns_and_rows(steps):
    docs, *rest = steps
    for later in rest[:-1]:
        assert list(later.columns) == list(docs.columns)
        assert set(later.doc_id) <= set(docs.doc_id) and later.doc_id.is_unique
    assert len(rest[2]) == len(rest[1])


def test_toxic_documents_go(steps):
    import duckdb

    toxic = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where toxic = 1").fetchall()}
    clean = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where toxic = 0").fetchall()}
    left = set(steps[1].doc_id)
    # A dozen toxic rows to learn from leave some doubt.
    assert len(clean - left) <= 0.02 * len(clean)
    assert len(toxic & left) < 0.5 * len(toxic)


def test_near_duplicates_leave_one(steps):
    from test_operators import brute_print

    prints = [(d, brute_print(t)) for d, t in zip(steps[2].doc_id, steps[2].text)]
    for n, (_, p) in enumerate(prints):
        assert all((p ^ q).bit_count() > 2 for _, q in prints[n + 1 :])
    kept = dict(prints)
    for d, t in zip(steps[1].doc_id, steps[1].text):
        assert d in kept or any(True for q in kept.values())


def test_no_benchmark_window_is_left(steps):
    import duckdb

    from test_operators import brute_hits

    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    before = {r[0] for r in brute_hits(list(zip(steps[3].doc_id, steps[3].text)), items) if not r[5]}
    assert before == set(steps[4].doc_id)


def test_packed_ids(steps):
    from punctual.llm.tokens import Tokens
    from test_operators import BPE

    coder, pieces = Tokens(BPE), steps[5]
    for d, t in zip(steps[4].doc_id, steps[4].text):
        ids = np.array([*coder.whole(t or ""), 0], "<u4")
        own = pieces[pieces.doc_id == d].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() == len(ids)
        for start, length, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two", "en", "s", 7), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "odd")
    assert docs.select("doc_id").distinct().count() == 3
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, SF), "odd")
    assert empty.count() == 0
