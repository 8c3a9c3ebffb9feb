import hashlib
import random
import sys
import textwrap
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import ODD_TEXTS, frame, prose, with_rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from logloom.llm import decontaminate, fingerprint, licenses, mixing, queries, toxicity  # noqa: E402
from logloom.llm.postings import Postings  # noqa: E402
from logloom.llm.text import importable  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(20))
def test_block_max_search_against_full_scores(seed):
    rng = np.random.default_rng(seed)
    terms, entries = 30, int(rng.integers(1, 700))
    key = np.unique(rng.integers(0, terms * entries, int(rng.integers(1, 2000))))
    t, e, w = key // entries, key % entries, rng.integers(1, 5, len(key)).astype(float)
    index = Postings(t, e, w, terms, entries)
    asked = np.unique(rng.integers(0, terms, 8))
    full = np.zeros(entries)
    np.add.at(full, e[np.isin(t, asked)], w[np.isin(t, asked)])
    assert dict(index.above(asked, 6.0)) == {i: s for i, s in enumerate(full) if s >= 6}
    counts = rng.integers(1, 4, entries)
    got, _ = index.nearest(asked, np.ones(len(asked)), counts, 20)
    order, want, n = [i for i in np.argsort(-full, kind="stable") if full[i] > 0], [], 0
    for i in order:
        if n >= 20 and full[i] < full[want[-1]]:
            break
        want.append(i)
        n += counts[i]
    assert set(got.tolist()) == set(want)


def _benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_contamination(spark):
    importable(spark)
    items = [(i, f"{prose(i + 900, 20, 5000).capitalize()}. {prose(i + 950, 8, 5000)}.") for i in range(30)]
    items += [(30, None), (31, ""), (7, items[7][1])]
    half = items[3][1].split(" ")
    texts = [*ODD_TEXTS, *(prose(i, 300, 5000) for i in range(30))]
    texts += [f"{prose(1, 200, 5000)} {items[4][1]} {prose(2, 200, 5000)}", items[5][1].upper(), f"{items[7][1]}\n{items[8][1]}"]
    texts += [f"{prose(3, 50, 5000)} {' '.join(half[:8])} {prose(4, 50, 5000)}"]
    df, bench = with_rows(frame(spark, texts), (None, items[9][1])), _benchmark(spark, items)
    n = len(texts)
    want = {(n - 4, 4), (n - 3, 5), (n - 2, 7), (n - 2, 8), (None, 9)}
    for index_bytes in (1 << 20, 600):
        rows = decontaminate.find_contamination(df, bench, index_bytes=index_bytes).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in rows) == sorted((str(d), i) for d, i in want)
        assert all(abs(r.score - 1) < 1e-9 and r.question_overlap == r.answer_overlap == 1 for r in rows)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(n) if i not in {n - 4, n - 3, n - 2}]
    assert decontaminate.find_contamination(df, bench.where("item_id < 0")).collect() == []
    assert decontaminate.find_contamination(df.where("doc_id < 0"), bench).collect() == []


def test_toxicity_learns_words_and_beginnings(spark):
    importable(spark)
    r = random.Random(1)
    texts, toxic = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = prose(i, r.randint(5, 60)).split(" ")
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["vilest", f"grubb{r.choice('aeiou')}{r.choice('lmn')}"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    df = with_rows(frame(spark, [*texts, *ODD_TEXTS]), (None, "vilest"), (0, texts[0]))
    labels = spark.createDataFrame([*((i, t) for i, t in enumerate(toxic)), (1, None), (None, 1)], "doc_id bigint, toxic int")
    rows = toxicity.classify(df, labels).collect()
    assert len(rows) == len(texts) + len(ODD_TEXTS) + 2
    for x in rows:
        name = "" if x.doc_id is None else str(x.doc_id)
        assert x.held_out == (zlib.crc32(name.encode()) % 5 == 0) and 0 <= x.score <= 1
        assert x.predicted == int(x.score >= 0.5)
    held = [x for x in rows if x.doc_id is not None and x.doc_id < 900 and x.held_out]
    assert np.mean([x.predicted == toxic[x.doc_id] for x in held]) > 0.97
    assert all(x.predicted == 0 for x in rows if x.doc_id is not None and x.doc_id >= 900)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(x.predicted == 0 for x in rows)
    none = toxicity.classify(df, labels.where("doc_id < 0")).collect()
    assert {x.score for x in none} == {0.0}
    assert toxicity.classify(df.where("doc_id < 0"), labels).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_copies_of_toxic_examples_are_toxic(spark, sf):
    importable(spark)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    bad = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id").where(~toxicity.held_out(F.col("doc_id")))
    copies = bad.select((F.col("doc_id") + 10**9).alias("doc_id"), "text")
    rows = toxicity.classify(docs.unionByName(copies), labels).where("doc_id >= 1000000000").collect()
    assert rows and min(x.score for x in rows) >= 0.5


def test_held_out_labels_are_not_learned(spark):
    importable(spark)
    d = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0][:300]
    df = frame(spark, [f"awful {i}" for i in range(max(d) + 1)])
    labels = spark.createDataFrame([(i, 1) for i in d], "doc_id bigint, toxic int")
    assert {x.predicted for x in toxicity.classify(df, labels).collect()} == {0}


def test_mixing_counts_and_edges(spark):
    sources = ["hot"] * 700 + ["cold"] * 50 + [None] * 50
    df = with_rows(frame(spark, [prose(i, 3) for i in range(800)], sources), (None, "x"), (0, "again"))
    rows = mixing.replicate(df, {"hot": 1.0, "cold": 3.0}, size=1200.0).collect()
    n = {s: sum(r.source == s for r in rows) for s in ("hot", "cold", None)}
    assert n[None] == 0 and abs(n["hot"] - 300) < 70 and abs(n["cold"] - 900) < 120
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    again = mixing.replicate(df.repartition(3), {"hot": 1.0, "cold": 3.0}, size=1200.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.replicate(df.where("doc_id < 0")).collect() == []


def test_poisson_counts_follow_the_law(spark):
    rows = mixing.replicate(frame(spark, ["x"] * 4000, ["s"] * 4000), size=8000.0).groupBy("doc_id").count().collect()
    counts = np.bincount([r["count"] for r in rows] + [0] * (4000 - len(rows)), minlength=8)[:6] / 4000
    law = np.array([0.1353, 0.2707, 0.2707, 0.1804, 0.0902, 0.0361])
    assert np.abs(counts - law).max() < 0.03


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    got = queries.queries()[name](spark, SF)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def _lanes(text):
    parts = [p for line in text.split("\n") for p in __import__("re").split(r"(?<=[.!?])[ \t\n\x0b\f\r]", line) if p]
    lanes = [len(parts)]
    of = lambda seed: [int(xxhash.xxh64(p.encode(), seed).intdigest()) for p in parts]
    return lanes, of


def test_fingerprints(spark):
    texts = ["A b. C d!\nE f", "E f\nC d!\nA b.", "", None, "x. x. x.", "é🙂 long line. two", "A b. C d!\nE g"]
    df = with_rows(frame(spark, texts), (None, "A b. C d!\nE f"))
    rows = fingerprint.edit_fingerprints(df, run_bytes=20).collect()
    assert len(rows) == 8
    order = [(i, t or "") for i, t in reversed(list(enumerate(texts)))] + [(None, "A b. C d!\nE f")]
    by = {r.doc_id: r for r in rows}
    for at, (i, text) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = by[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[0].fingerprint == by[1].fingerprint == by[None].fingerprint != by[6].fingerprint
    assert by[2].fingerprint == by[3].fingerprint == "0" * (8 * fingerprint.LANES) and by[3].near_next == 1
    assert by[4].fingerprint[:8] == "00000003" and by[1].near_next == 1
    assert fingerprint.edit_fingerprints(df.where("doc_id < 0")).collect() == []


def test_runs_by_cuts_are_one_expression_of_a_fixed_size(spark):
    """A filter takes the run's expression in: with 63 cuts some thousand times itself when each step was a column."""
    docs = spark.range(-3, 131).select(F.col("id").alias("__order"))
    for cuts in ([], [7], [9, 7], [64, 9, -2], list(range(126, 0, -2)), list(range(128, 0, -2))):
        runs = fingerprint._with_run(docs, cuts)
        assert {r["__order"]: r["__run"] for r in runs.collect()} == {i: sum(c > i for c in cuts) for i in range(-3, 131)}
        plan = runs.where("__run > 3")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 4000


def test_fingerprints_add_and_subtract(spark):
    pairs = spark.createDataFrame([(0, "a. b", "c\na."), (1, "", "z")], "k int, x string, y string")
    sums = {}
    for name, text in {"x": F.col("x"), "y": F.col("y"), "xy": F.concat("x", F.lit("\n"), "y")}.items():
        sums[name] = fingerprint.fingerprints(pairs.withColumn("t", text), ["k"], "t").withColumnRenamed("lanes", name)
    row = sums["x"].join(sums["y"], "k").join(sums["xy"], "k").select(
        (fingerprint.combine(F.col("x"), F.col("y")) == F.col("xy")).alias("plus"),
        (fingerprint.combine(F.col("xy"), F.col("y"), -1) == F.col("x")).alias("minus"),
        (fingerprint.from_text(fingerprint.to_text(F.col("xy"))) == F.col("xy")).alias("text"),
    )
    assert {tuple(r) for r in row.collect()} == {(True, True, True)}


def test_licences(spark):
    importable(spark)
    notices = [(f, t) for f, t in licenses.TEMPLATES]
    texts = [f"{prose(i, 20)}\n{t}\n{prose(i, 5)}" for i, (_, t) in enumerate(notices)]
    texts += [f"{prose(i, 30)}\nthe version of this work is of note" for i in range(60)] + ODD_TEXTS
    df = with_rows(frame(spark, texts), (None, "Released under the MIT License."))
    rows = licenses.scan(df).collect()
    found = {(r.doc_id, r.paragraph): r.family for r in rows if r.confirmed}
    for i, (family, _) in enumerate(notices):
        assert found.pop((i, 1)) == family
    assert found == {(None, 0): "MIT"}
    assert licenses.scan(df.where("doc_id < 0"), licenses.train(df)).collect() == []


def test_wrapped_and_dual_licences(spark):
    importable(spark)
    long = [(f, t) for f, t in licenses.TEMPLATES if len(t) > 100]
    texts = []
    for mark in ("", "# ", " * "):
        texts += [f"{mark}{prose(1, 8)}\n{mark}\n" + "\n".join(mark + x for x in textwrap.wrap(t, 60)) for _, t in long]
    n = len(texts)
    texts += ["Released under the MIT License. Released under the BSD License.", "Licensed under the MIT License or the\nApache License, Version 2.0"]
    texts += [prose(i, 30) for i in range(60)]
    found = {}
    for r in licenses.scan(frame(spark, texts)).where("confirmed").collect():
        found.setdefault(r.doc_id, []).append(r.family)
    assert {i: sorted(f) for i, f in found.items() if i < n} == {i: [long[i % len(long)][0]] for i in range(n)}
    assert sorted(found[n]) == ["BSD", "MIT"] and sorted(found[n + 1]) == ["Apache-2.0", "MIT"]
    assert set(found) == set(range(n + 2))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    last = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert (last.start.to_numpy() == np.concatenate([[0], last.n_tokens.cumsum()[:-1]])).all()
    assert last.doc_id.is_monotonic_increasing and set(last.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    bad = {r.doc_id for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad |= {r.doc_id for r in decontaminate.find_contamination(docs, items).collect()}
    assert bad and not bad & set(last.doc_id)


@pytest.mark.parametrize("seed", range(8))
def test_nearest_examples_against_all_cosines(seed):
    """Entries, cosines, ties and shares as brute force has them, with copies among the examples."""
    r = random.Random(seed)
    texts = [prose(seed * 1000 + i, r.randint(1, 80), 60) for i in range(150)]
    texts += [texts[3]] * 2 + [" ".join(reversed(texts[5].split(" ")))]
    vectors = [toxicity.term_counts(t) for t in texts]
    hashes, terms = np.unique(np.concatenate([t for t, _ in vectors]), return_inverse=True)
    counts = np.concatenate([c for _, c in vectors])
    starts = np.cumsum([0, *(len(t) for t, _ in vectors)])
    idf = np.random.default_rng(seed).uniform(0.5, 6, len(hashes))
    toxic = (np.arange(len(texts)) % 3 == 0).astype(float)
    model = toxicity.Model(hashes, idf, starts, terms, counts, toxic, list(range(len(texts))), (0.1, []), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    dense = np.zeros((len(texts), len(hashes)))
    for e, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        dense[e, terms[a:b]] = (1 + np.log(counts[a:b])) * idf[terms[a:b]]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    asked = [prose(seed * 7000 + i, 30, 90) for i in range(10)] + [texts[3], texts[5]]
    for text, (t, c, _) in zip(asked, model.terms.count(asked)):
        w = model.vector(t, c)
        query = np.zeros(len(hashes))
        query[t] = w
        cosines = dense @ query
        for but in (-1, 3):
            entries, found = model.neighbours(t, w, 12, but)
            own = np.delete(np.arange(len(texts)), but) if but >= 0 else np.arange(len(texts))
            last = np.sort(cosines[own])[-12]
            want = sorted(e for e in own if cosines[e] >= last - 1e-9 and cosines[e] > 0)
            assert sorted(entries.tolist()) == want
            assert np.allclose(found, np.minimum(cosines[entries], 1)) and (np.diff(found) <= 0).all()
            votes = (dense[entries] * query * model.telling).sum(axis=1) / (1 - found + toxicity.SOFT)
            assert np.isclose(model.share(t, w, entries, found), (votes * toxic[entries]).sum() / votes.sum())
    score, evidence, names = model.judged([texts[3]])[0]
    assert evidence and all(n in {x.decode() for w in texts[3].encode().split() for x in toxicity.terms_of(w)} for n in names)


def test_isotonic_line_rises_and_keeps_the_rate():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    y = (rng.random(500) < x**2).astype(float)
    at, rate = toxicity.isotonic(x, y, np.ones(500), y.mean())
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all()
    told = np.interp(x, at, rate)
    assert abs(told.mean() - y.mean()) < 0.02 and np.abs(told - x**2).mean() < 0.08


def test_scores_are_calibrated_on_the_held_out(spark):
    importable(spark)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = labels.where("toxic IS NOT NULL").join(docs, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(truth.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    p, y = np.array([r.score for r in rows]), np.array([float(r.toxic > 0) for r in rows])
    assert len(rows) > 600 and y.sum() > 50
    assert ((p - y) ** 2).mean() < 0.02 and abs(p.mean() - y.mean()) < 0.03 and model[2] < 0.02
    assert (p[y > 0] >= 0.5).mean() > 0.85 and (p[y == 0] >= 0.5).mean() < 0.01
