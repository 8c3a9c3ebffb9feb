"""Benchmark decontamination: BM25 retrieval of test items by every training passage.

The test items are indexed, the passages are the queries. An item's BM25 weights are
divided by what it scores against itself, so a passage's score is the share of an item
that it matches, and one threshold fits short and long items. Retrieved items count if
their question and their answer both overlap the passage in word trigrams.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.postings import SLACK, Postings
from logloom.llm.text import keep_only, release, slices

K1, B = 1.2, 0.75
#: Least share of an item's own BM25 score for it to be retrieved.
LEAST_SCORE = 0.5
#: Least share of the trigrams of the question and of the answer that a passage has.
LEAST_OVERLAP = 0.6
GRAM = 3
#: Bytes of item texts in one index. A larger benchmark is searched in several.
INDEX_BYTES = 32 << 20
SCHEMA = (
    "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double,"
    " first_word bigint, last_word bigint"
)
_PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_MARKS = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def plain_words(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.lower().encode().translate(_MARKS).split() if text else []


def question_and_answer(text: str | None) -> tuple[str, str]:
    """The last sentence (of three words or more, with what follows) is the answer, the rest
    the question; a single sentence is cut after three quarters of its words."""
    sentences = _SENTENCE.split((text or "").strip())
    for i in range(len(sentences) - 1, 0, -1):
        tail = " ".join(sentences[i:])
        if len(plain_words(tail)) >= GRAM:
            return " ".join(sentences[:i]), tail
    words = (text or "").split()
    cut = len(words) - max(GRAM, len(words) // 4)
    return (" ".join(words[:cut]), " ".join(words[cut:])) if cut > 0 else (text or "", "")


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _overlap(item: set, length: int, passage: dict[int, set]) -> float:
    """1 for an empty part: there is nothing to find."""
    return len(item & passage[length]) / len(item) if item else 1.0


class Index:
    def __init__(self, items: list[tuple[int, str, str]], df: dict[bytes, int], n_items: int, mean: float, least: float):
        self.least = least
        # Items of like length share blocks: their weights are alike.
        items = sorted(items, key=lambda x: (len(plain_words(f"{x[1]} {x[2]}")), x[1], x[2], x[0]))
        self.ids = [i for i, _, _ in items]
        self.parts, rows = [], []
        self.vocabulary: dict[bytes, int] = {}
        self.longest = 1
        for entry, (_, question, answer) in enumerate(items):
            q, a = plain_words(question), plain_words(answer)
            words = q + a
            self.longest = max(self.longest, len(words))
            self.parts.append((grams(q), min(GRAM, len(q)), grams(a), min(GRAM, len(a))))
            own, total = {}, 0.0
            for w in words:
                own[w] = own.get(w, 0) + 1
            for w, tf in own.items():
                idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
                own[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                total += own[w]
            for w, x in own.items():
                rows.append((self.vocabulary.setdefault(w, len(self.vocabulary)), entry, x / total))
        table = np.array(rows, np.float64).reshape(-1, 3)
        self.postings = Postings(
            table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2], len(self.vocabulary), len(items)
        )

    def matches(self, text: str | None, least_overlap: float) -> list[tuple]:
        """The best passage for each item that is found: (entry, score, overlaps, first, last word)."""
        words = plain_words(text)
        if not words or not self.vocabulary:
            return []
        found = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(found >= 0)
        terms = found[places]
        if self.postings.most[terms].sum() < self.least - SLACK:
            return []
        # Passages of twice the longest item, each half over the last: an item lies whole in one.
        step = self.longest
        firsts = np.arange(0, max(1, len(words) - step), step)
        n_terms = len(self.vocabulary)
        near = np.concatenate([places // step, places // step - 1])
        both = np.concatenate([terms, terms])
        own = (near >= 0) & (near < len(firsts))
        pairs = np.unique(near[own] * n_terms + both[own])
        passages, terms = pairs // n_terms, pairs % n_terms
        best: dict[int, tuple] = {}
        retrieved = zip(*(x.tolist() for x in self.postings.above_groups(passages, terms, len(firsts), self.least)))
        for k, group in groupby(retrieved, key=lambda x: x[0]):
            first = int(firsts[k])
            passage = words[first : first + 2 * step]
            sets = {n: {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} for n in range(1, GRAM + 1)}
            for _, entry, score in group:
                q, nq, a, na = self.parts[entry]
                both = _overlap(q, nq, sets), _overlap(a, na, sets)
                if min(both) >= least_overlap:
                    row = (score, *both, first, first + len(passage) - 1)
                    if entry not in best or row[:3] > best[entry][:3]:
                        best[entry] = row
        return [(e, *row) for e, row in sorted(best.items())]


def _indexes(benchmark: DataFrame, least_score: float, index_bytes: int) -> list:
    """Broadcast indexes of all items: one for each `index_bytes` of their texts.

    Document frequencies and the mean length are those of all items in either case.
    """
    spark = benchmark.sparkSession
    named = {c.lower() for c in benchmark.columns}
    if {"question", "answer"} <= named:
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("question", "answer")]
    else:
        columns = [F.coalesce(F.col("text"), F.lit("")), F.lit(None).cast("string")]
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), columns[0].alias("a"), columns[1].alias("b"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                own = plain_words(f"{a} {b or ''}")
                words += set(own)
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, b""], pa.binary()), pa.array([*[1] * len(words), 0], pa.int64()),
                 pa.array([*[0] * len(words), sum(sizes)], pa.int64())],
                names=["term", "n", "n_words"],
            )

    n_items, n_bytes = items.agg(F.count("*"), F.sum(F.octet_length("a") + F.coalesce(F.octet_length("b"), F.lit(0)))).first()
    if not n_items:
        return []
    counts = items.select("a", "b").mapInArrow(terms, "term binary, n bigint, n_words bigint").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("n_words").alias("n_words")
    ).persist()
    mean = max(1.0, (counts.agg(F.sum("n_words")).first()[0] or 0) / n_items)
    shards = math.ceil((n_bytes or 1) / index_bytes)
    out = []
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "a"), F.lit(shards)) == shard).collect()
        own = sorted({(r.item_id, *((r.a, r.b) if r.b is not None else question_and_answer(r.a))) for r in rows}, key=repr)
        words = {w for _, q, a in own for w in plain_words(f"{q} {a}")}
        # Bounded by the shard's own words.
        mine = spark.createDataFrame([(bytearray(w),) for w in words] or [(bytearray(b""),)], "term binary")
        df = {bytes(r.term): r.n for r in counts.join(F.broadcast(mine), "term").select("term", "n").collect()}
        own = [x for x in own if plain_words(f"{x[1]} {x[2]}")]
        if own:
            index = (own, df, n_items, mean, least_score)
            out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(index)))
    counts.unpersist()
    return out


_built: dict[str, Index] = {}


def _index(key: str, broadcast) -> Index:
    """Built once per Python worker from the broadcast items; a few are kept."""
    keep_only("decontamination", _built.clear)
    if key not in _built:
        if len(_built) >= 4:
            _built.pop(next(iter(_built)))
        _built[key] = Index(*broadcast.value)
    return _built[key]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """Rows (doc_id, item_id, score, overlaps, first_word, last_word) for each item found in a document.

    Every passage of every whole text is a query against all items; the best passage of
    an item is told. Null and empty texts, and items without words, match nothing; a null
    doc_id stays null; repeated rows are told again, repeated items (same id and text) once;
    an empty benchmark finds nothing. Other columns are ignored. Documents are not shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    out = None
    for held in _indexes(benchmark, least_score, index_bytes):

        def rows(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(*held)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    for entry, *rest in index.matches(text.as_py(), least_overlap):
                        found.append((doc_id.as_py(), index.ids[entry], *rest))
                columns = zip(*found) if found else [()] * 7
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "last_word"],
                )

        one = texts.mapInArrow(rows, SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of `docs`, all columns, in whose text no item is found (see find_contamination)."""
    for held in _indexes(benchmark, least_score, index_bytes):

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(*held)
            for batch in slices(batches):
                keep = [not index.matches(t.as_py(), least_overlap) for t in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))
            release()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
