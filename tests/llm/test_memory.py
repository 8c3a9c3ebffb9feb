"""What a task holds and hands on at a time."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import public_tokenizers

from logloom.llm import decontaminate, toxicity
from logloom.llm.text import ROWS, slices

BATCH = pa.RecordBatch.from_pydict({"doc_id": list(range(3 * ROWS + 5)), "text": ["a b"] * (3 * ROWS + 5)})


class Docs:
    """Gives the function that a job would run in its tasks."""

    schema = "doc_id bigint, text string"

    def mapInArrow(self, function, schema):
        return function


class Known:
    def judged(self, texts):
        assert len(texts) <= ROWS
        return [(0.0, [], [])] * len(texts)

    def forget(self):
        pass

    def matches(self, text, least):
        return []


def _all_rows_in_small_batches(function):
    found = list(function(iter([BATCH, BATCH.slice(0, 0), BATCH.slice(7, 3)])))
    assert max(b.num_rows for b in found) <= ROWS
    assert sum((b.column("doc_id").to_pylist() for b in found), []) == [*range(BATCH.num_rows), 7, 8, 9]


def test_slices_have_all_rows():
    _all_rows_in_small_batches(slices)


def test_clean_documents_are_handed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: ("key", None, 0.0))
    monkeypatch.setattr(toxicity, "_model", lambda *a: Known())
    _all_rows_in_small_batches(toxicity.drop_toxic(Docs(), None))


def test_documents_without_items_are_handed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(decontaminate, "_indexes", lambda *a: [("key", None)])
    monkeypatch.setattr(decontaminate, "_index", lambda *a: Known())
    _all_rows_in_small_batches(decontaminate.drop_contaminated(Docs(), None))


def test_a_tokenizer_leaves_little_behind():
    """Resident memory that an encoder adds, in MB: 120 before what its file took was given back."""
    code = """
import sys
from pathlib import Path
from logloom.llm.encoder import Numbered
def resident():
    return int(next(x for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("VmRSS")).split()[1]) / 1024
before = resident()
own = Numbered(sys.argv[1])
print(resident() - before)
"""
    path = public_tokenizers.path("byte_bpe_50k.json")
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code, path], capture_output=True, text=True, check=True, cwd=root)
    assert float(done.stdout) < 80


def test_fingerprints_in_many_runs_fit_a_small_driver(tmp_path):
    """As many runs as 6 GB of documents have, in a heap of 640 MB: the plan alone took over 750 MB before."""
    code = """
import sys
from logloom.llm import fingerprint
from logloom.session import build_session
settings = {"spark.driver.memory": "640m", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": sys.argv[1], "spark.local.dir": sys.argv[1]}
spark = build_session("small-driver", "local[2]", **settings)
docs = spark.createDataFrame([(i, f"Text {i}. End of {i}.") for i in range(600)], "doc_id bigint, text string")
rows = fingerprint.edit_fingerprints(docs, run_bytes=1)
print(rows.count(), rows.where("n_chars > 0 and length(edited_sha256) = 64").count(), len(fingerprint._cuts(docs.selectExpr("doc_id __order", "text __text"), 1)))
"""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=root)
    assert done.stdout.split() == ["600", "600", "600"], done.stderr[-2000:]
