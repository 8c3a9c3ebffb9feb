"""Vector search, lexical search and collocations against brute force."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import ODD_TEXTS, frame, prose, with_rows  # noqa: E402

from logloom.llm import collocations, lexical_search, vector_search  # noqa: E402
from logloom.llm.text import importable  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}


# --- op11 ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, n int, block string, score string, rank string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "x", "x") for i, v in rows], VECTORS)


def _quantised(vec):
    return [math.floor(256 * float(np.float32(x))) for x in vec]


def _nearest(rows, k, every):
    """Sorted (query_id, rank, vec_id, score) by comparing every query row with every other row."""
    good = [(i, _quantised(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(good) if a != b]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def _told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_vectors_against_all_pairs(spark, seed):
    importable(spark)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    rows = [(int(i), (centres[rng.integers(4)] * 0.3 + 0.1 * rng.normal(size=6)).tolist()) for i in range(300)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(90)]  # a hot vector
    rows += [(10, rows[3][1]), (10, rows[10][1]), (None, same), (None, rows[4][1])]  # repeated and missing ids
    rows += [(20, None), (30, [0.1, None, 0.2]), (40, [float("nan")] * 6), (50, [float("inf")] * 6), (60, []), (70, [0.5, -0.25])]
    got = vector_search.nearest(_vectors(spark, rows), 5, 10, pivots=7, sample=50, block=64)
    assert _told(got) == _nearest(rows, 5, 10)


def test_nearest_vectors_in_small_and_wide_tables(spark):
    importable(spark)
    assert _told(vector_search.nearest(_vectors(spark, []))) == []
    assert _told(vector_search.nearest(_vectors(spark, [(50, [1.0])]))) == []
    few = [(0, [1.0, 2.0]), (1, [0.0, -1.0]), (2, [3.0e7, 1.0e9])]
    assert _told(vector_search.nearest(_vectors(spark, few))) == _nearest(few, 5, 50)
    wide = vector_search.nearest(_vectors(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])]))
    assert _told(wide) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold_and_stop_exactly(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-200, 200, (int(rng.integers(2, 300)), int(rng.integers(1, 9))))
    pivots = vector_search.choose_pivots(rows, 5)
    blank = {"block": 0, "n": len(rows), "width": rows.shape[1], "ids": np.arange(len(rows)).tobytes(), "known": np.ones(len(rows), np.uint8).tobytes(),
             "vecs": rows.tobytes(), "distances": vector_search.distances(rows, pivots).tobytes(), "places": b"", "least": b""}
    block = vector_search.Block(blank)
    for i in range(min(5, len(rows))):
        exact = rows @ rows[i]
        assert (vector_search.upper_bounds(block, i, block) >= exact).all()
        at, scores = vector_search.best(block, i, block, 4, -np.inf)
        assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:4] and (exact[at] == scores).all()


# --- op12 ---------------------------------------------------------------------------


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _ranked(docs, items, k=10):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in counts:
            m = 10 + (90 * c.total() * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


ITEMS = "item_id bigint, text string, score string, term string"


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], ITEMS)


def test_lexical_search_against_all_documents(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(lexical_search, "SHARD", 64)
    texts = [*ODD_TEXTS, *(prose(i, 20 + i % 90, 300) for i in range(250)), prose(1, 30000, 3000)]
    texts += ["w1 w2 w3"] * 40 + ["W1, w2; w3!"] * 3  # ties
    more = [(None, "w1 w2 w3 w4"), (None, "w5"), (3, "w7 w8"), (3, "w7 w8")]
    df = with_rows(frame(spark, texts), *more)
    items = [(i, prose(900 + i, 12, 300)) for i in range(25)] + [(30, None), (31, ""), (32, "w1 w2"), (32, "w1 w2"), (32, "w9 w9"), (None, "w3"), (33, "zzz")]
    docs = [*enumerate(texts), *more]
    want = _ranked(docs, items)
    assert _told(lexical_search.search(df, _items(spark, items))) == want
    assert _told(lexical_search.search(df, _items(spark, items), query_bytes=500)) == want  # several passes


def test_lexical_search_in_empty_tables(spark):
    importable(spark)
    some = frame(spark, ["a b", "c"])
    assert _told(lexical_search.search(some.limit(0), _items(spark, [(1, "a")]))) == []
    assert _told(lexical_search.search(some, _items(spark, []))) == []
    assert _told(lexical_search.search(some, _items(spark, [(1, "a c")]))) == _ranked([(0, "a b"), (1, "c")], [(1, "a c")])


def test_summary_bounds_hold():
    """Every document's score is within the bound of each block that holds it."""
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 8)).encode()) for i in range(20)]
    asked = lexical_search.Queries(items)
    n, terms = 500, len(asked.names)
    sizes = rng.integers(0, 12, n)
    own = [np.sort(rng.choice(terms, s, replace=False)) for s in sizes]
    row = {"ids": np.arange(n).tobytes(), "known": np.ones(n, np.uint8).tobytes(), "lengths": (sizes * 3 + 1).astype(np.int64).tobytes(),
           "starts": np.cumsum([0, *sizes], dtype=np.int64).tobytes(), "terms": np.concatenate(own).astype(np.int32).tobytes(),
           "counts": rng.integers(1, 5, sizes.sum()).astype(np.int32).tobytes()}
    weights = rng.integers(1, 9000, terms)
    shard = lexical_search.Shard(lexical_search.index_shard(row, asked, weights, n, 10 * n, block=32), asked)
    opened = 0
    for own, places in zip(asked.items, asked.places):
        full = weights[own] @ shard.impacts[own]
        for t, at in zip(own.tolist(), places):
            bound = shard.summaries[t][:, at].astype(np.int64) @ (weights[own] * lexical_search.STEP)
            for b, most in zip(range(shard.lists[t], shard.lists[t + 1]), bound.tolist()):
                docs = shard.postings[shard.blocks[b] : shard.blocks[b + 1]]
                assert full[docs].max() <= most
                opened += 1
        best = lexical_search.Best(10)
        shard.search(own, places, weights, best)
        assert best.scores.tolist() == [s for s in sorted(full.tolist(), reverse=True)[:10] if s > 0]
    assert opened > 60


# --- op13 ---------------------------------------------------------------------------


def _collocations(rows, least, top):
    """Sorted rows of the result, by counting every phrase; rows are (lang, text)."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {p: f for p, f in counts.items() if f >= least and len(p) > 2}
    inside = Counter()
    for p, f in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                key = (p[0], *p[i : i + k])
                inside[key] = max(inside[key], f)
    found = {}
    for p, a in candidates.items():
        if inside[p] and 100 * inside[p] >= 100 * a:
            continue
        lang = p[0]
        cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[(lang, *p[k:])]), k) for k in range(2, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p[1:]).encode(), counts[p[:k]], counts[(lang, *p[k:])]))
    return sorted(
        (lang, rank, x.decode(), -a, left, right, n[lang], -s)
        for lang, own in found.items() for rank, (s, a, x, left, right) in enumerate(sorted(own)[:top], 1)
    )


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "x", "x", "x") for i, (lang, t) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, words string, f string, n string, a string")


def _phrase_rows(seed):
    rows = [(("en", "de", None, "und")[i % 4], prose(seed * 100 + i, 5 + i % 60, 12)) for i in range(80)]
    rows += [("en", "The hot phrase\tof  five, The hot phrase of five")] * 30  # a passage that many documents share
    rows += [("en", t) for t in ODD_TEXTS] + [("en", "a.b!c?d\x0be\x0cf\rg h\x1ci"), ("fr", "é É é É"), ("", "w1 w2"), (None, None)]
    rows += [("en", prose(5, 4000, 9))]
    return rows


@pytest.mark.parametrize("limit", [collocations.LIMIT, 300])
def test_collocations_against_all_phrases(spark, monkeypatch, limit):
    importable(spark)
    rows = _phrase_rows(1)
    got = collocations.collocations(_documents(spark, rows), least=4, top=50, limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == _collocations(rows, 4, 50)


def test_collocations_in_empty_tables(spark):
    importable(spark)
    for rows in ([], [("en", None)], [("en", "a b c")]):
        assert collocations.collocations(_documents(spark, rows)).collect() == []


def test_word_ids_differ_by_language_and_seed():
    ids = {collocations.word_id(lang, w, seed) for lang in (b"en", b"de") for w in (b"a", b"b") for seed in (0, 1)}
    assert len(ids) == 8


@pytest.mark.parametrize("seed", range(5))
def test_trie_spills_and_bursts_to_the_same_counts(monkeypatch, seed):
    monkeypatch.setattr(collocations, "BURST", 50)
    rng = np.random.default_rng(seed)
    ids = rng.integers(1, 2**63, 40).astype(np.uint64)
    trie, want, runs = collocations.Trie(3, 8, limit=400), Counter(), []
    for _ in range(30):
        rows = np.minimum(rng.zipf(1.5, (200, 3)), 39).astype(np.int32)
        want.update(map(tuple, ids[rows].tolist()))
        runs += list(trie.add(rows, ids))
    spilled = len(runs)
    runs += list(trie.rest(ids))
    got = Counter()
    for r in runs:
        words = np.frombuffer(r["words"], np.uint64).reshape(-1, 3)
        assert ((collocations.prefix_hashes(words) >> np.uint64(61)) == r["part"]).all()
        for w, n in zip(words.tolist(), np.frombuffer(r["counts"], np.int64).tolist()):
            got[tuple(w)] += n
    assert got == want and spilled > 0
