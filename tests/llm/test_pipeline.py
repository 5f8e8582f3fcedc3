"""The pipeline against its stages and plain versions of them."""

import hashlib
from collections import Counter

import pytest

import brute_force as plain
import corpus_pipeline as cp
from seriesmill.llm import quality
from seriesmill.llm.bpe import encoding

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before each stage and after the last, each written and read again."""
    folder = tmp_path_factory.mktemp("steps")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{k}")
        docs.append(spark.read.parquet(f"{folder}/{k}"))
    return docs


def test_stages():
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "mix_sources", "bpe_tokens"]


def test_columns_stay_until_the_last_stage(steps):
    assert all(sorted(d.columns) == sorted(steps[0].columns) for d in steps[:-1])


def test_quality_drops_what_the_operator_rejects(steps):
    kept = {r.doc_id for r in quality.assess(steps[0]).filter("kept").collect()}
    assert {r.doc_id for r in steps[1].collect()} == kept and 0 < len(kept) < steps[0].count()


def test_one_document_of_each_group_stays(steps):
    groups = plain.near_duplicates([(r.doc_id, r.text) for r in steps[1].collect()])
    assert {r.doc_id for r in steps[2].collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_secrets_go_and_the_rest_stays(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    changed = 0
    for r in steps[3].collect():
        own = plain.secret_spans(before[r.doc_id])
        assert not plain.secret_spans(r.text) and r.n_chars == len(r.text)
        changed += bool(own)
        if not own and r.text != before[r.doc_id]:
            assert "[REDACTED]" in r.text
    assert changed and len(before) == steps[3].count()


def test_mixing_draws_whole_documents(steps):
    before = {(r.doc_id, r.text) for r in steps[3].collect()}
    drawn = Counter((r.doc_id, r.text) for r in steps[4].collect())
    assert set(drawn) <= before and max(drawn.values()) <= 4


def test_tokens_are_those_of_the_texts(steps):
    import public_tokenizers

    own = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    digest = lambda b: hashlib.md5(b).hexdigest()
    want = Counter((r.doc_id, digest(r.text.encode()), tuple(own.encode_ordinary(r.text))) for r in steps[4].collect())
    assert Counter((r.doc_id, digest(bytes(r.decoded)), tuple(r.ids)) for r in steps[5].collect()) == want


def test_run_applies_all_stages(spark, steps):
    out = cp.run(spark, SF)
    assert out.columns == steps[-1].columns and out.count() == steps[-1].count()


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 30, "en", None, 150), (2, "word " * 30, "en", None, 150)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() <= len(rows)
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
