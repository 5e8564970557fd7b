"""The pipeline's stages on odd tables and against plain versions."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from tidewatch.llm import bpe, mixing
from tidewatch.llm.common import stored

from test_operators import odd_rows, plain_measures, prose, split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    near = prose(77, 200)
    rows = [r[:5] for r in odd_rows()]
    rows += [(500 + i, near + f" tail{i}", "en", "a", 1) for i in range(6)]
    rows += [(600 + i, prose(600 + i, 120), "en", "abc"[i % 3], 1) for i in range(60)]
    path = str(tmp_path_factory.mktemp("pipe") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_quality_stage(spark, docs):
    out = STAGES["quality rules"](spark, docs, "")
    assert out.columns == docs.columns
    want = Counter()
    for r in docs.collect():
        n, _, _, _, repeated = plain_measures(r.text)
        want[r.doc_id] += not (n < 50 or 100 * repeated > 50 * n)
    assert ids(out) == +want


def test_exact_stage(spark, docs):
    out = STAGES["exact dedup"](spark, docs, "")
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    got = {r.text or "": -1 if r.doc_id is None else r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and got == best and out.count() == len(best)


def test_near_stage_keeps_one_of_the_group_and_all_others(spark, docs):
    good = stored(STAGES["exact dedup"](spark, STAGES["quality rules"](spark, docs, ""), ""), "good")
    out = STAGES["SimHash near-dedup"](spark, good, "")
    left = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns
    assert len(left & set(range(500, 506))) == 1 and 500 in left
    assert set(range(600, 660)) <= left


def test_mixing_stage_repeats_whole_documents(spark, docs):
    out = STAGES["mixing to target weights"](spark, docs, "")
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = out.collect()
    assert all((r.doc_id, r.text) in texts and split(r.text) for r in got)
    # Only the document at the end of a source's last pass is taken in part.
    largest = Counter()
    for r in docs.collect():
        largest[r.source] = max(largest[r.source], len(split(r.text)))
    taken = sum(r.taken for r in mixing.mixed(docs).collect())
    assert abs(sum(len(split(r.text)) for r in got) - taken) <= sum(largest.values())


def test_last_stage_and_run(spark, docs, sf):
    out = STAGES["byte-level BPE"](spark, docs, "")
    texts = Counter(r.text or "" for r in docs.collect())
    assert Counter(bytes(r.decoded).decode() for r in out.collect()) == texts
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() > 0 and "ids" in whole.columns


def test_stages_take_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    table = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, "").count() == 0


def test_shape():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert bpe.REMEMBERED > 0 and re.match("quality", corpus_pipeline.STAGES[0][0])
