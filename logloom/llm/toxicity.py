"""Toxicity by the nearest labelled examples in TF-IDF cosine.

Terms are words and the beginnings of longer ones; all terms of the examples are indexed,
with document frequencies of all documents, and the NEIGHBOURS nearest examples by exact
cosine are found by block-max search. The metric knows nothing of labels. A neighbour's vote
weighs more the nearer it is, and the more of its cosine is owed to terms that go with the
toxic label (by their chi-square). The share of toxic votes becomes a score by isotonic
regression, fitted on the examples' own shares, each taken without itself, at the
labels' true proportions. The nearest examples and the terms shared with them are evidence.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.decontaminate import plain_words
from logloom.llm.lexical_search import cluster
from logloom.llm.postings import HeadedPostings
from logloom.llm.text import keep_only, mix, powers, release, slices

#: Labelled rows that are learned from: half of them of either label at most, those of the
#: smallest hashes, and as many as have so many bytes of text together. More are left out.
EXAMPLES, EXAMPLE_BYTES = 2_000, 32 << 20
#: Letters of a word's beginning that are a term, besides the word.
BEGINNING = 5
NEIGHBOURS = 50
#: A neighbour at cosine s weighs 1 / (1 - s + SOFT).
SOFT = 0.02
EVIDENCE = 3
#: Chi-square from which on a term tells the toxic label: 1 in 100 by chance.
LEAST_CHI2 = 6.63
#: Power of a term's toxic share in its weight for votes, so that words of a language or topic gain little.
SHARE_POWER = 4
#: Words and texts that a worker remembers; texts by a 128-bit hash.
WORDS, TEXTS = 100_000, 10_000
_BASE = 0x9E3779B97F4A7C15
#: Texts that are counted at once.
AT_ONCE = 128
SCORE_SCHEMA = "doc_id bigint, score double, evidence array<bigint>, evidence_terms array<string>"


def terms_of(word: bytes) -> list[bytes]:
    text = word.decode()
    return [word, f"{text[:BEGINNING]}*".encode()] if len(text) > BEGINNING else [word]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def term_hashes(words: list[bytes]) -> np.ndarray:
    """Two hashes for each word: its own, and that of its beginning; 0 for one without."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(words), np.uint8)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    values = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(sizes.max(initial=0)) + 1)[place]
    letters = np.cumsum((data & 0xC0) != 0x80)
    letters = letters - np.repeat(letters[starts] - 1, sizes)
    whole = mix(np.add.reduceat(values, starts))
    begun = mix(np.add.reduceat(np.where(letters <= BEGINNING, values, 0), starts) + np.uint64(1))
    begun[letters[starts + sizes - 1] <= BEGINNING] = 0
    return np.stack([whole, begun], axis=1)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct terms, and how often each occurs."""
    counts = Counter(plain_words(text))
    if not counts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = term_hashes(list(counts)).ravel()
    times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), 2)
    hashes, place = np.unique(found[found > 0], return_inverse=True)
    return hashes, np.bincount(place, times[found > 0], len(hashes)).astype(np.int64)


class Terms:
    """Numbers of the terms of words, in a sorted array of hashes; remembers a bounded number of words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: list[bytes] = []
        #: Numbers of the word itself and of its beginning, -1 for none in the index.
        self.of = np.empty((0, 2), np.int64)

    def _learn(self, words: list[bytes]) -> None:
        pairs = term_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, pairs), max(0, len(self.hashes) - 1))
        found = self.hashes[at] == pairs if len(self.hashes) else np.zeros(pairs.shape, bool)
        numbers = np.where(found & (pairs > 0), at, -1)
        self.known.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.words += words
        self.of = np.concatenate([self.of, numbers])

    def count(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: its terms in the index, ascending, how often each occurs, and its words' places here."""
        if len(self.words) > WORDS:
            self._forget()
        lists = [plain_words(x) for x in texts]
        if new := set().union(*lists).difference(self.known):
            self._learn(list(new))
        sizes = list(map(len, lists))
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, sum(sizes))
        docs = np.repeat(np.arange(len(texts)), sizes)
        n_words, n_terms = max(1, len(self.words)), max(1, len(self.hashes))
        pairs, times = np.unique(docs * n_words + words, return_counts=True)
        docs, words = pairs // n_words, pairs % n_words
        # Words are distinct within a text; beginnings are where several words may meet.
        own, first = self.of[words].T
        has = first >= 0
        begun, place = np.unique(docs[has] * n_terms + first[has], return_inverse=True)
        keys = np.concatenate([(docs * n_terms + own)[own >= 0], begun])
        counts = np.concatenate([times[own >= 0], np.bincount(place, times[has], len(begun)).astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        cuts = np.searchsorted(keys // n_terms, np.arange(len(texts) + 1))
        of_doc = np.searchsorted(docs, np.arange(len(texts) + 1))
        return [
            (keys[a:b] % n_terms, counts[a:b], words[c:d])
            for a, b, c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), of_doc[:-1].tolist(), of_doc[1:].tolist())
        ]


def _examples(docs: DataFrame, labels: DataFrame, learn: Column, n: int, n_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the labelled rows to learn from, and how many there are of either label.

    A repeated label counts once, conflicting ones as toxic; of rows that repeat a doc_id, the
    greatest text is taken.
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = own.withColumn("place", place).where(F.col("place") <= max(1, n // 2))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # `n` rows of 20 bytes at most.
    found = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.max("text").alias("text"))
    # A window over `n` rows at most.
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("place", "toxic", "doc_id"))
    return found.withColumn("bytes", so_far).where(F.col("bytes") <= n_bytes).select("doc_id", "toxic", "text"), totals


def _document_frequencies(docs: DataFrame, hashes) -> np.ndarray:
    """In how many of all documents each term of the broadcast array occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(hashes.value)
        total = np.zeros(len(own.hashes), np.int64)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                counted = own.count(batch.column("text").slice(at, AT_ONCE).to_pylist())
                total += np.bincount(np.concatenate([t for t, _, _ in counted]), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "n"])
        own._forget()
        release()

    counts = docs.select("text").mapInArrow(rows, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(hashes.value))
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    return df


def telling(entries_toxic: np.ndarray, terms: np.ndarray, entries: np.ndarray, n_terms: int) -> np.ndarray:
    """1 plus the chi-square of terms that go with the toxic label, times a power of their toxic share.

    It is 1 for terms whose chi-square is below LEAST_CHI2.
    """
    n, p = len(entries_toxic), float(entries_toxic.sum())
    if not 0 < p < n:
        return np.ones(n_terms)
    t = np.bincount(terms, entries_toxic[entries], n_terms)
    c = np.bincount(terms, 1 - entries_toxic[entries], n_terms)
    apart = t * (n - p) - c * p
    chi2 = n * apart * apart / (np.maximum(c + t, 1) * np.maximum(0.5, n - c - t) * p * (n - p))
    share = (t + p / n) / (c + t + 1)
    return 1 + np.where((apart > 0) & (chi2 >= LEAST_CHI2), chi2 * share**SHARE_POWER, 0.0)


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising line from x to the rate of y, by pooling adjacent violators.

    Each pool's rate has one observation of the base rate mixed in.
    """
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weights[order].tolist()):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    at = np.array([p[0] / p[2] for p in pools])
    rate = np.array([(p[1] + base) / (p[2] + 1) for p in pools])
    return at, np.maximum.accumulate(rate)


class Model:
    """The index of the examples with all that scoring needs; entries are distinct vectors."""

    def __init__(self, hashes, idf, starts, terms, counts, toxic, evidence, blank, line):
        self.terms, self.idf, self.toxic, self.evidence, self.blank, self.line = Terms(hashes), idf, toxic, evidence, blank, line
        n = len(toxic)
        entries = np.repeat(np.arange(n), np.diff(starts))
        weights = (1 + np.log(counts)) * idf[terms]
        norms = np.sqrt(np.bincount(entries, weights * weights, n))
        weights = weights / np.maximum(norms, 1e-300)[entries]
        self.telling = telling(toxic, terms, entries, len(hashes))
        #: The telling terms' weights in all entries, times what a vote owes to them; place of each term, or -1.
        told = np.flatnonzero(self.telling > 1)
        self.place = np.full(len(hashes), -1, np.int64)
        self.place[told] = np.arange(len(told))
        own = self.place[terms] >= 0
        self.owed = np.zeros((len(told), n))
        self.owed[self.place[terms[own]], entries[own]] = weights[own] * (self.telling[terms[own]] - 1)
        # Like entries are given neighbouring numbers, so that they share blocks.
        signs = np.random.default_rng(3).choice(np.array([-1.0, 1.0]), (len(hashes), 16))
        likeness = np.stack([np.bincount(entries, weights * signs[terms, k], n) for k in range(16)], axis=1) if n else np.zeros((0, 16))
        self.order = cluster(likeness / np.maximum(1e-30, np.linalg.norm(likeness, axis=1, keepdims=True)), 32) if n else np.arange(0)
        self.number = np.empty(n, np.int64)
        self.number[self.order] = np.arange(n)
        self.index = HeadedPostings(terms, self.number[entries], weights, len(hashes), n, share=0.3)
        self.starts, self.entry_terms, self.weights = starts, terms, weights
        self.memory: dict[bytes, tuple[float, list[int], list[str]]] = {}
        #: Weights of the text at hand by term, zero between texts.
        self.asked = np.zeros(len(hashes))

    def forget(self) -> None:
        """Drop the words and texts met, which are quickly learned again."""
        self.terms._forget()
        self.memory.clear()

    def vector(self, t: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[t]
        return w / (np.sqrt((w * w).sum()) or 1.0)

    def neighbours(self, t: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k nearest entries, nearest first, with all that tie with the last."""
        found, cosines = self.index.nearest(t, w, k, -1 if but < 0 else int(self.number[but]))
        entries, cosines = self.order[found], np.minimum(np.round(cosines, 9), 1.0)
        by = np.lexsort((entries, -cosines))
        return entries[by], cosines[by]

    def share(self, t: np.ndarray, w: np.ndarray, entries: np.ndarray, cosines: np.ndarray) -> float:
        """Of the neighbours' votes, the toxic share; NaN without neighbours."""
        if not len(entries):
            return float("nan")
        place = self.place[t]
        told = place >= 0
        owed = cosines + w[told] @ self.owed[np.ix_(place[told], entries)]
        votes = owed / (1 - cosines + SOFT)
        return float((votes * self.toxic[entries]).sum() / votes.sum())

    def score(self, share: float) -> float:
        return self.blank[0] if np.isnan(share) else float(np.interp(share, *self.line))

    def judged(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        """(score, evidence, terms) of each text; equal texts are judged once while they are remembered."""
        out = []
        for at in range(0, len(texts), AT_ONCE):
            few = texts[at : at + AT_ONCE]
            keys = [xxhash.xxh3_128_digest(x or "") for x in few]
            if len(self.memory) > TEXTS:
                self.memory.clear()
            new = {k: x for k, x in zip(keys, few) if k not in self.memory}
            self.memory.update(zip(new, map(self._judged, self.terms.count(list(new.values())))) if new else ())
            out += [self.memory[k] for k in keys]
        return out

    def _judged(self, counted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, list[int], list[str]]:
        t, counts, words = counted
        if not len(t):
            return self.blank[0], self.blank[1], []
        w = self.vector(t, counts)
        entries, cosines = self.neighbours(t, w, NEIGHBOURS)
        score = self.score(self.share(t, w, entries, cosines))
        # Evidence sides with the verdict: the nearest examples of its label.
        side = entries[(self.toxic[entries] >= 0.5) == (score >= 0.5)][:EVIDENCE]
        if not len(side):
            return score, [], []
        # The terms that the cosine with the nearest of them owes most to.
        own = slice(self.starts[side[0]], self.starts[side[0] + 1])
        terms = self.entry_terms[own]
        self.asked[t] = w * self.telling[t] if score >= 0.5 else w
        owed = self.asked[terms] * self.weights[own]
        self.asked[t] = 0
        best = np.argsort(-owed, kind="stable")[:EVIDENCE]
        names = []
        for term in terms[best[owed[best] > 0]].tolist():
            row, column = np.argwhere(self.terms.of[words] == term)[0].tolist()
            names.append(terms_of(self.terms.words[words[row]])[column].decode())
        return score, [self.evidence[e] for e in side.tolist()], names


def calibrate(model: Model, vectors: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, totals: dict[int, int], sampled: dict[int, int]):
    """(line, base rate, error): the isotonic line over the examples' shares, each without itself.

    Every example stands for as many labelled rows as the sample has left out of its label.
    The error is the mean squared one of scores by a line fitted on the other half.
    """
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    shares = np.array([model.share(t, w, *model.neighbours(t, w, NEIGHBOURS, e)) for e, (t, w) in enumerate(vectors)])
    weight = [totals.get(y, 0) / max(1, sampled.get(y, 0)) for y in (0, 1)]
    y = model.toxic
    weights = sizes * (y * weight[1] + (1 - y) * weight[0])
    rate = np.where(weights > 0, sizes * y * weight[1] / np.maximum(weights, 1e-300), 0)
    use = ~np.isnan(shares) & (weights > 0)
    if not use.any():
        return (np.array([0.0]), np.array([base])), base, float("nan")
    x, rate, weights = shares[use], rate[use], weights[use]
    error, half = 0.0, np.arange(len(x)) % 2 == 0
    for own in (half, ~half):
        if own.any() and (~own).any():
            told = np.interp(x[own], *isotonic(x[~own], rate[~own], weights[~own], base))
            error += float((weights[own] * (told - rate[own]) ** 2).sum() / weights.sum())
    return isotonic(x, rate, weights, base), base, error


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES):
    """A broadcast model. `learn` is a condition on doc_id; by default all but the held-out rows.

    Learned from at most `examples` labelled rows of at most `example_bytes` of text; their
    terms' hashes and counts, which that bounds, come to the driver. Document frequencies are
    those of all documents. The model's `error` tells the calibration's mean squared error.
    """
    spark = docs.sparkSession
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    own, totals = _examples(docs, labels, learn, examples, example_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [term_counts(x) for x in batch.column("text").to_pylist()]
            blobs = [pa.array([p[k].tobytes() for p in pairs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *blobs], names=["doc_id", "toxic", "terms", "counts"])

    told = own.mapInArrow(rows, "doc_id bigint, toxic int, terms binary, counts binary").toArrow()
    ids, marks = told.column("doc_id").to_pylist(), told.column("toxic").to_pylist()
    sampled = {y: marks.count(y) for y in (0, 1)}
    # Equal vectors are one entry: its sizes, toxic share, and evidence (a toxic one first).
    merged: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    for i, y, t, c in sorted(zip(ids, marks, told.column("terms").to_pylist(), told.column("counts").to_pylist())):
        terms, counts = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64)
        by = np.argsort(terms)
        merged.setdefault((terms[by].tobytes(), counts[by].tobytes()), []).append((i, y))
    blank = merged.pop((b"", b""), [])
    pairs = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64)) for t, c in merged]
    sizes = np.array([len(x) for x in merged.values()], np.float64)
    toxic = np.array([np.mean([y for _, y in x]) for x in merged.values()])
    evidence = [min(x, key=lambda r: (-r[1], r[0]))[0] for x in merged.values()]
    all_terms = np.concatenate([t for t, _ in pairs]) if pairs else np.empty(0, np.uint64)
    hashes, terms = np.unique(all_terms, return_inverse=True)
    counts = np.concatenate([c for _, c in pairs]) if pairs else np.empty(0, np.int64)
    starts = np.cumsum([0, *(len(t) for t, _ in pairs)], dtype=np.int64)
    df, n_docs = np.zeros(0), 0
    if len(hashes):
        df, n_docs = _document_frequencies(docs, spark.sparkContext.broadcast(hashes)), docs.count()
    idf = np.log(1 + n_docs / (1 + df))
    parts = [hashes, idf, starts, terms, counts, toxic, evidence]
    model = Model(*parts, (0.0, []), (np.array([0.0]), np.array([0.0])))
    vectors = [(terms[a:b], model.vector(terms[a:b], counts[a:b])) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    line, base, error = calibrate(model, vectors, sizes, totals, sampled)
    # What texts without any known term get: the rate of the examples without any.
    rate = (sum(y for _, y in blank) + base) / (len(blank) + 1)
    told_blank = (rate, [min(blank)[0]] if blank else [])
    return uuid.uuid4().hex, spark.sparkContext.broadcast((*parts, told_blank, line)), error


_models: dict[str, Model] = {}


def _model(key: str, broadcast, error: float) -> Model:
    """Built once per Python worker."""
    keep_only("toxicity", _models.clear)
    if key not in _models:
        _models.clear()
        _models[key] = Model(*broadcast.value)
    return _models[key]


def score(docs: DataFrame, model) -> DataFrame:
    """Per row: doc_id, score, evidence (doc_ids of nearest examples), evidence_terms (shared with the first).

    Null and empty texts, and texts without any term of the examples, get the rate of the
    examples without any, mixed with the base rate. Repeated rows are scored alike; a null
    doc_id stays null; neighbours that tie with the last all vote; without usable labels
    every score is the base rate (0 without any label). Other columns are ignored;
    nothing is shuffled.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(*model)
        for batch in slices(batches):
            scored = own.judged(batch.column("text").to_pylist())
            scores, evidence, terms = zip(*scored) if scored else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64())),
                 pa.array(terms, pa.list_(pa.string()))],
                names=["doc_id", "score", "evidence", "evidence_terms"],
            )
        own.forget()
        release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, SCORE_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """score() by a model of `labels` without the held-out rows, with held_out and predicted."""
    scored = score(docs, fit(docs, labels, examples=examples))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "evidence_terms",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, examples: int = EXAMPLES) -> DataFrame:
    """The rows of `docs`, all columns, that score below `least`."""
    model = fit(docs, labels, examples=examples)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(*model)
        for batch in slices(batches):
            yield batch.filter(pa.array([x[0] < least for x in own.judged(batch.column("text").to_pylist())], pa.bool_()))
        own.forget()
        release()

    return docs.mapInArrow(clean, docs.schema)
