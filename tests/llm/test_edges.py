"""Empty tables, repeated rows, missing values, very long texts and clashing columns."""

import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import ODD_TEXTS, frame, prose, with_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from logloom.llm import fingerprint, licenses, mixing, near_dedup, substrings, token_counts, toxicity  # noqa: E402
from logloom.llm.text import importable  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = prose(77, 40_000, 3000)


@pytest.fixture(scope="module")
def awkward(spark):
    """Odd texts, a very long one, a row without id, an id and a whole row that are repeated."""
    importable(spark)
    texts = [*ODD_TEXTS, LONG, prose(1, 200, 500)]
    return with_rows(frame(spark, texts), (None, prose(2, 60)), (3, "again"), (9, prose(1, 200, 500)), (9, prose(1, 200, 500)))


def _rows(awkward):
    return [(r.doc_id, r.text) for r in awkward.collect()]


def test_token_counts(spark, awkward):
    plain = Tokenizer.from_file(PATH)
    got = token_counts.section_tokens(awkward, PATH).collect()
    sums = {}
    for r in got:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for i, t in _rows(awkward):
        want[i] = want.get(i, 0) + len(plain.encode(t or "", add_special_tokens=False).ids)
    assert sums == want
    assert token_counts.section_tokens(awkward.limit(0), PATH).collect() == []


def test_substrings(spark, awkward):
    got = {}
    for r in substrings.remove_repeats(awkward).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    # The identical rows remove each other; the long text repeats no window of its own.
    assert got[9] == [(200, 200)] * 3 and got[8] == [(40_000, 0)] and got[None] == [(60, 0)] and got[1] == [(0, 0)]
    assert substrings.remove_repeats(awkward.limit(0)).collect() == []
    least = with_rows(frame(spark, ["a"]), (-(2**63), prose(5, 40)), (None, prose(6, 40)))
    assert {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(least).collect()} == {(0, 0), (-(2**63), 0), (None, 0)}


def test_near_duplicates(spark, awkward):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((i is None, i) for i in {i for i, _ in _rows(awkward)})
    assert all(r.kept for r in rows) and {r.doc_id: r.n_shingles for r in rows}[1] == 0
    assert near_dedup.near_duplicates(awkward.limit(0)).collect() == []


def test_toxicity(spark, awkward):
    labels = spark.createDataFrame([(0, 0), (9, 1), (9, 0), (8, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    rows = toxicity.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 9}) == 1
    assert toxicity.classify(awkward.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.classify(awkward, labels.limit(0)).collect()} == {0.0}


def test_mixing_replaces_its_own_columns(spark, awkward):
    from pyspark.sql import functions as F

    clash = awkward.withColumn("copy", F.lit("mine")).withColumn("mix_key", F.lit("mine"))
    rows = mixing.replicate(clash, size=100.0).collect()
    assert rows and {type(r.copy) for r in rows} == {int} and all(r.mix_key != "mine" for r in rows)
    plain = mixing.replicate(awkward, size=100.0).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.copy) for r in rows) == sorted((r.doc_id is None, r.doc_id, r.copy) for r in plain)


def test_fingerprints(spark, awkward):
    rows = fingerprint.edit_fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    assert len({r.fingerprint for r in rows if r.doc_id == 9}) == 1
    assert {r.n_chars for r in rows if r.doc_id == 8} == {len(LONG)}


def test_licences_of_repeated_rows(spark):
    importable(spark)
    notice = licenses.TEMPLATES[0][1]
    df = with_rows(frame(spark, [notice, prose(1, 30), None, ""]), (0, notice), (None, notice))
    rows = licenses.scan(df).where("confirmed").collect()
    assert [r.doc_id for r in rows].count(0) == 2 and [r.doc_id for r in rows].count(None) == 1


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, copy string, start string"


def _corpus(spark, root, rows, labels, items):
    spark.createDataFrame([(i, t, lang, s, n, "x", "x", "x") for i, t, lang, s, n in rows], DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")


def test_pipeline_with_nulls_and_other_columns(spark, tmp_path):
    importable(spark)
    item = f"{prose(900, 20, 5000).capitalize()}. {prose(901, 9, 5000)}."
    rows = [(i, prose(i, 120, 3000), "en", "s", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (None, prose(50, 90), None, "s", None)]
    rows += [(102, rows[0][1], "en", "s", 1), (103, f"{prose(60, 50)} {item} {prose(61, 50)}", "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    _corpus(spark, str(tmp_path), rows, [(1, 0, 0), (2, None, None), (None, 0, 1)], [(7, item), (8, None)])
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in last}
    assert ids and 102 not in ids and 103 not in ids and ids <= {i for i, *_ in rows}


def test_pipeline_without_documents(spark, tmp_path):
    importable(spark)
    _corpus(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
