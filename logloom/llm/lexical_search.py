"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

The index holds what a given set of queries can ask for. Documents are indexed in shards,
so a term that most documents hold has its list spread over all of them and nothing is
shuffled by term. Within a shard each term's list is ordered by likeness (cosine to pivots
of the list, in a small random projection) and cut into blocks, and each block keeps the
coordinatewise maximum of its documents' impacts, rounded up to a byte, for the terms that
queries have beside the list's own. The product of a query with that summary is an upper
bound of the score of every document in the block. Blocks are opened by descending bound
and skipped only when their bound is below the last score kept, so the result is exact;
lists whose terms together cannot reach that score aren't entered at all.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import stored

K = 10
#: Bytes of item texts that are searched in one pass. A larger set takes several.
QUERY_BYTES = 1 << 20
#: Documents of a shard, at most; cells of its table of documents and terms.
SHARD, CELLS = 2048, 1 << 24
#: Documents of a block.
BLOCK = 256
#: Dimensions of the projection that likeness is measured in.
SKETCH = 16
#: Impacts are below 1,000,000; so much is one step of a summary's byte.
STEP = 3922

_BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BREAKS) + b"abcdefghijklmnopqrstuvwxyz")
_VECTORS = "n_docs bigint, n_terms bigint, ids binary, known binary, lengths binary, starts binary, terms binary, counts binary"
_INDEX = "ids binary, known binary, starts binary, terms binary, impacts binary, lists binary, blocks binary, postings binary, summaries binary"
_FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of other than ASCII characters, A to Z in lower case."""
    return text.translate(_PLAIN).split() if text else []


class Queries:
    """Items as term numbers, and for each term the terms that it shares an item with."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        names: dict[bytes, int] = {}
        self.items = []
        for _, text in items:
            own = sorted({names.setdefault(t, len(names)) for t in terms_of(text)})
            self.items.append(np.array(own, np.int64))
        self.names = names
        beside: list[set[int]] = [set() for _ in names]
        for own in self.items:
            for t in own.tolist():
                beside[t].update(own.tolist())
        self.beside = [np.array(sorted(x), np.int64) for x in beside]
        #: Per item and term, where the item's terms are among those beside the term.
        self.places = [[np.searchsorted(self.beside[t], own) for t in own.tolist()] for own in self.items]
        self.shard = max(64, min(SHARD, CELLS // max(1, len(names))))


_queries: dict[str, Queries] = {}


def _held(key: str, broadcast) -> Queries:
    """Built once per Python worker; a few are kept."""
    if key not in _queries:
        if len(_queries) >= 4:
            _queries.pop(next(iter(_queries)))
        _queries[key] = Queries(broadcast.value)
    return _queries[key]


def _batch(row: dict, schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "bigint": pa.int64()}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_pylist([row], pa.schema(fields))


def _vectors(docs: DataFrame, held) -> DataFrame:
    """Shards of documents as counts of the queries' terms, with their lengths in all terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _held(*held)
        number = queries.names.get
        ids, lengths, sizes, terms, counts = [], [], [], [], []

        def shard() -> pa.RecordBatch:
            row = {
                "n_docs": sum(n > 0 for n in lengths), "n_terms": sum(lengths),
                "ids": np.array([x or 0 for x in ids], np.int64).tobytes(),
                "known": np.array([x is not None for x in ids], np.uint8).tobytes(),
                "lengths": np.array(lengths, np.int64).tobytes(), "starts": np.cumsum([0, *sizes], dtype=np.int64).tobytes(),
                "terms": np.array(terms, np.int32).tobytes(), "counts": np.array(counts, np.int32).tobytes(),
            }
            for x in (ids, lengths, sizes, terms, counts):
                x.clear()
            return _batch(row, _VECTORS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms_of(text.as_py())
                found = Counter(map(number, words))
                found.pop(None, None)
                ids.append(doc_id)
                lengths.append(len(words))
                sizes.append(len(found))
                terms += found
                counts += found.values()
                if len(ids) == queries.shard:
                    yield shard()
        if ids:
            yield shard()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(rows, _VECTORS)


def _frequencies(vectors: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of the `n` terms occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                total += np.bincount(np.frombuffer(x.as_py(), np.int32), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["term", "df"])

    # A row for each term of the queries.
    found = vectors.select("terms").mapInArrow(rows, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 90 + (90 * lengths * n_docs) // max(1, n_terms)
    tf = counts.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int32)


def cluster(likeness: np.ndarray, block: int) -> np.ndarray:
    """An order of a list's documents in which like ones are side by side, by the nearest of some of them."""
    n = len(likeness)
    pivots = likeness[np.linspace(0, n - 1, -(-n // block)).astype(np.int64)]
    cosines = likeness @ pivots.T
    nearest = cosines.argmax(axis=1)
    return np.lexsort((-cosines[np.arange(n), nearest], nearest))


def index_shard(row: dict, queries: Queries, weights: np.ndarray, n_docs: int, n_terms: int, block: int = BLOCK) -> dict:
    """The lists, blocks and summaries of a shard, and its documents' impacts."""
    read = lambda c, kind: np.frombuffer(row[c], kind)
    starts, terms = read("starts", np.int64), read("terms", np.int32)
    docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    impacts = _impacts(read("counts", np.int32), read("lengths", np.int64)[docs], n_docs, n_terms)
    levels = np.zeros((len(starts) - 1, len(weights)), np.uint8)
    levels[docs, terms] = -(-impacts // STEP)
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(weights), SKETCH))
    heft = (impacts * weights[terms]).astype(np.float32)
    likeness = np.stack([np.bincount(docs, heft * signs[terms, k], len(starts) - 1) for k in range(SKETCH)], axis=1)
    likeness = likeness / np.maximum(1e-30, np.sqrt((likeness * likeness).sum(axis=1, keepdims=True)))
    order = np.argsort(terms, kind="stable")
    ends = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    lists, blocks, postings, summaries = [0], [0], [], []
    for t in range(len(weights)):
        own = docs[order[ends[t] : ends[t + 1]]]
        if len(own) > block:
            own = own[cluster(likeness[own], block)]
        for at in range(0, len(own), block):
            few = own[at : at + block]
            postings.append(few)
            blocks.append(blocks[-1] + len(few))
            summaries.append(levels[few].max(axis=0)[queries.beside[t]])
        lists.append(len(blocks) - 1)
    joined = lambda parts, kind: (np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)).tobytes()
    return {
        "ids": row["ids"], "known": row["known"], "starts": row["starts"], "terms": row["terms"], "impacts": impacts.tobytes(),
        "lists": np.array(lists, np.int64).tobytes(), "blocks": np.array(blocks, np.int64).tobytes(),
        "postings": joined(postings, np.uint16), "summaries": joined(summaries, np.uint8),
    }


class Shard:
    """An index shard to search in."""

    def __init__(self, row: dict, queries: Queries):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.known = read("ids", np.int64), read("known", np.uint8).astype(bool)
        starts, n_terms = read("starts", np.int64), len(queries.names)
        self.impacts = np.zeros((n_terms, len(self.ids)), np.int32)
        docs = np.repeat(np.arange(len(self.ids)), np.diff(starts))
        self.impacts[read("terms", np.int32), docs] = read("impacts", np.int32)
        self.lists, self.blocks, self.postings = read("lists", np.int64), read("blocks", np.int64), read("postings", np.uint16)
        summaries, at, self.summaries = read("summaries", np.uint8), 0, []
        for t, beside in enumerate(queries.beside):
            n = int(self.lists[t + 1] - self.lists[t])
            self.summaries.append(summaries[at : at + n * len(beside)].reshape(n, len(beside)))
            at += n * len(beside)

    def search(self, terms: np.ndarray, places: list[np.ndarray], weights: np.ndarray, best: "Best") -> None:
        by = weights[terms] * STEP
        bounds = [self.summaries[t][:, at].astype(np.int64) @ by for t, at in zip(terms.tolist(), places)]
        most = np.array([int(self.summaries[t][:, at[k]].max(initial=0)) for k, (t, at) in enumerate(zip(terms.tolist(), places))], np.int64) * by
        # Lists that all together stay below the least score are not entered.
        rising = np.argsort(most, kind="stable")
        entered = rising[np.searchsorted(np.cumsum(most[rising]), best.least, side="left") :]
        if not len(entered):
            return
        numbers = np.concatenate([np.arange(self.lists[t], self.lists[t + 1]) for t in terms[entered].tolist()])
        bound = np.concatenate([bounds[k] for k in entered.tolist()])
        seen = np.zeros(len(self.ids), bool)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < best.least:
                break
            docs = self.postings[self.blocks[numbers[k]] : self.blocks[numbers[k] + 1]]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                best.add(weights[terms] @ self.impacts[np.ix_(terms, docs)], self.ids[docs], self.known[docs])


class Best:
    """The k best documents of an item so far; `least` is the score to reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        hit = scores >= self.least
        if not hit.any():
            return
        scores, ids, known = (np.concatenate([a, b[hit]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        keep = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[keep], ids[keep], known[keep]
        if len(keep) == self.k:
            self.least = max(1, int(self.scores[-1]))


def build_index(vectors: DataFrame, held, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _held(*held)
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                yield _batch(index_shard(row, queries, weights, n_docs, n_terms), _INDEX)

    return vectors.mapInArrow(rows, _INDEX)


def search_index(index: DataFrame, held, weights: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item among the shards of each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _held(*held)
        best = [Best(k) for _ in queries.items]
        for batch in batches:
            for at in range(len(batch)):
                shard = Shard(batch.slice(at, 1).to_pylist()[0], queries)
                for terms, places, own in zip(queries.items, queries.places, best):
                    if len(terms):
                        shard.search(terms, places, weights, own)
        found = [(i, int(d) if known else None, int(s)) for i, b in enumerate(best) for s, d, known in zip(b.scores, b.ids, b.known)]
        columns = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"]
        )

    return index.mapInArrow(rows, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    Every whole text is indexed and every item is a query. The score is the integer one
    of term weights and impacts (see weight() and _impacts()); equal scores go by ascending
    doc_id, null ids last. Rows of `docs` that repeat a doc_id are documents of their own.
    Null, empty and termless texts have no term, count in no total and are never told; items
    without any known term get no row. Items that repeat an id and a text are one; items that
    share an id but not the text are ranked each. Other columns are ignored; empty tables
    give no row. At most `query_bytes` of item texts are broadcast at once.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / query_bytes))
    out = None
    for number in range(passes):
        own = asked.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == number)
        rows = sorted(((r.item_id, bytes(r.text)) for r in own.collect()), key=repr)
        queries = Queries(rows)
        if not queries.names:
            continue
        held = uuid.uuid4().hex, spark.sparkContext.broadcast(rows)
        vectors = stored(_vectors(docs, held), "lexical-vectors")
        n_docs, n_terms = vectors.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = n_docs or 0, n_terms or 0
        weights = np.array([weight(n_docs, int(x)) for x in _frequencies(vectors, len(queries.names))], np.int64)
        index = stored(build_index(vectors, held, weights, n_docs, n_terms), "lexical-index")
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item int, item_id bigint")
        ranking = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = search_index(index, held, weights, k).withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
        # As many rows as there are items in this pass.
        one = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS words
  FROM documents
),
totals AS (
  SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM docs
),
counts AS (
  SELECT place, doc_id, n, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(words) AS n, unnest(words) AS term FROM docs) GROUP BY place, doc_id, n, term
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts CROSS JOIN totals GROUP BY term
),
impacts AS (
  SELECT place, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS part
  FROM counts JOIN weights USING (term) CROSS JOIN totals
),
asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term
  FROM benchmark
),
scored AS (
  SELECT item_id, text, place, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impacts USING (term)
  GROUP BY item_id, text, place, doc_id HAVING sum(part) > 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
