"""Exact nearest vectors by inner product, with a pivot table to leave candidates out.

Every vector's distances to PIVOTS pivots are computed once and kept. By the triangle
inequality a query q and a candidate x are at least max |d(q, p) - d(x, p)| apart, and the
inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2, so each pivot gives an upper bound of the
score and the least of them counts. Candidates are evaluated in the order of their bounds
until no bound left reaches the last score kept, which makes the result exact.

The table is ordered by nearest pivot and distance to it and cut into blocks, whose least
and largest distances bound all pairs of a block of queries and a block of candidates at
once. Pairs of blocks that cannot matter are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import stored

K = 5
#: Pivots, and rows (of the smallest hashes) that they are chosen from. Any choice gives the
#: same result; the sample also gives each query a first score to beat.
PIVOTS, SAMPLE = 24, 2048
#: Rows of a block of candidates.
BLOCK = 2048
#: Blocks of queries that meet a block of candidates in one task.
AT_ONCE = 32
#: Against rounding in distances, as a share of the lengths involved.
SLACK = 1e-9
_EXACT = float(1 << 53)
_MEASURED = "vec_id bigint, vec array<bigint>, nearest int, radius double, place int"
_BLOCKS = (
    "block bigint, queries boolean, n int, width int, ids binary, known binary, vecs binary, distances binary,"
    " places binary, least binary, low array<double>, high array<double>, most double, threshold double"
)
_FOUND = "home bigint, place int, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, as 64-bit integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    """Not null, and neither are its components; all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def matrix(vectors: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of 64-bit integers, shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], pivots.shape[1])
    rows, pivots = widened(rows, width).astype(np.float64), widened(pivots, width).astype(np.float64)
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(rows), 0))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits the nearest 64-bit integer."""
    width = max(rows.shape[1], len(query))
    rows, query = widened(rows, width), widened(query[None, :], width)[0]
    most = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).max(initial=0))
    if most * max(1, width) < _EXACT:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(a * b for a, b in zip(r, query.tolist())), ends.min), ends.max) for r in rows.tolist()], np.int64)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Each pivot is the row farthest from those before it, so that they lie apart."""
    if not len(sample):
        return sample
    rows = sample.astype(np.float64)
    chosen, far = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(n, len(rows)):
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _smallest_type(rows: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if rows.size and rows.min() >= np.iinfo(kind).min and rows.max() <= np.iinfo(kind).max:
            return rows.astype(kind)
    return rows


class Block:
    """Rows of a stored block as arrays."""

    def __init__(self, row: dict):
        n, width = row["n"], row["width"]
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        size = len(row["vecs"]) // (n * width) if n * width else 8
        self.vecs = np.frombuffer(row["vecs"], f"i{size}").reshape(n, width)
        self.distances = np.frombuffer(row["distances"], np.float64).reshape(n, -1)
        self.places = np.frombuffer(row["places"], np.int32)
        self.least = np.frombuffer(row["least"], np.float64)
        self.squares = (self.vecs.astype(np.float64) ** 2).sum(axis=1)


def upper_bounds(q: Block, i: int, x: Block) -> np.ndarray:
    """Of the scores of all rows of x with the i-th row of q."""
    apart = np.zeros(len(x.ids))
    for k in range(x.distances.shape[1]):
        np.maximum(apart, np.abs(x.distances[:, k] - q.distances[i, k]), out=apart)
    both = x.squares + q.squares[i]
    apart = np.maximum(0, apart - SLACK * np.sqrt(both))
    return (both - apart * apart) / 2 + SLACK * both


def best(q: Block, i: int, x: Block, k: int, least: float, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best rows of x that reach `least`, ties to the smaller id.

    Rows are evaluated by descending bound, in growing numbers, until the next bound is
    below the k-th score.
    """
    bounds = upper_bounds(q, i, x)
    if skip >= 0:
        bounds[skip] = -np.inf
    order = np.flatnonzero(bounds >= least) if least > -np.inf else np.flatnonzero(np.arange(len(bounds)) != skip)
    order = order[np.argsort(-bounds[order], kind="stable")]
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step = 0, 64
    while at < len(order) and bounds[order[at]] >= least:
        few = order[at : at + step]
        own = products(x.vecs[few], q.vecs[i])
        rows, scores = np.concatenate([rows, few]), np.concatenate([scores, own])
        at, step = at + step, step * 2
        keep = np.lexsort((x.ids[rows], ~x.known[rows], ~scores))[:k]
        rows, scores = rows[keep], scores[keep]
        if len(scores) == k:
            least = max(least, float(scores[-1]) * (1 - SLACK) if scores[-1] > 0 else float(scores[-1]) * (1 + SLACK))
    hit = scores >= least
    return rows[hit], scores[hit]


def _measured(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors with their nearest pivot and the distance to it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            own = matrix(batch.column("vec"))
            to = distances(own, pivots)
            nearest = to.argmin(axis=1) if to.shape[1] else np.zeros(len(own), np.int64)
            radius = to.min(axis=1) if to.shape[1] else np.zeros(len(own))
            # Tells equal rows apart when the table is dealt out by ranges.
            place = (np.arange(done, done + len(own)) % (1 << 20)).astype(np.int32)
            done += len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(nearest.astype(np.int32)), pa.array(radius), pa.array(place)],
                names=["vec_id", "vec", "nearest", "radius", "place"],
            )

    return vectors.mapInArrow(rows, _MEASURED)


def _blocks(measured: DataFrame, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, every: int, block: int) -> DataFrame:
    """Blocks of candidates and, for those that hold queries, blocks of these beside them.

    A query's `least` is its k-th score among the rows of its own block or of the sample.
    """

    def as_row(number: int, queries: bool, own: Block, at: np.ndarray, least: np.ndarray) -> dict:
        to = own.distances[at]
        return {
            "block": number, "queries": queries, "n": len(at), "width": own.vecs.shape[1], "ids": own.ids[at].tobytes(),
            "known": own.known[at].astype(np.uint8).tobytes(), "vecs": own.vecs[at].tobytes(), "distances": to.tobytes(),
            "places": at.astype(np.int32).tobytes(), "least": least.tobytes(), "low": to.min(axis=0).tolist(),
            "high": to.max(axis=0).tolist(), "most": float(own.squares[at].max()), "threshold": float(least.min(initial=np.inf)),
        }

    def packed(number: int, ids: pa.Array, vecs: pa.Array) -> Iterator[dict]:
        rows = matrix(vecs)
        known = np.asarray(ids.is_valid())
        own = Block({
            "block": number, "n": len(rows), "width": rows.shape[1], "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
            "known": known.astype(np.uint8).tobytes(), "vecs": _smallest_type(rows).tobytes(),
            "distances": distances(rows, pivots).tobytes(), "places": b"", "least": b"",
        })
        every_row = np.arange(len(rows))
        yield as_row(number, False, own, every_row, np.empty(0))
        asked = every_row[known & (own.ids % every == 0)]
        if not len(asked):
            return
        least = np.full(len(asked), -np.inf)
        for j, i in enumerate(asked.tolist()):
            _, scores = best(own, i, own, k, -np.inf, i)
            others = products(sample, own.vecs[i])[sample_ids != own.ids[i]]
            for found in (scores, others):
                if len(found) >= k:
                    x = float(np.partition(found, -k)[-k])
                    least[j] = max(least[j], x - SLACK * abs(x))
        yield as_row(number, True, own, asked, least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def whole(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            table = pa.Table.from_batches(held).combine_chunks()
            n = len(table) if rest else len(table) // block * block
            for at in range(0, n, block):
                part = table.slice(at, block).combine_chunks()
                for row in packed(number, part.column("vec_id").combine_chunks(), part.column("vec").combine_chunks()):
                    yield pa.RecordBatch.from_pylist([row], schema)
                number += 1
            held = table.slice(n).to_batches()

        for batch in batches:
            held.append(batch.select(["vec_id", "vec"]))
            if sum(map(len, held)) >= block:
                yield from whole(False)
        if held:
            yield from whole(True)

    binary = ["ids", "known", "vecs", "distances", "places", "least"]
    schema = pa.schema([
        ("block", pa.int64()), ("queries", pa.bool_()), ("n", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in binary),
        ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("most", pa.float64()), ("threshold", pa.float64()),
    ])
    order = ["nearest", "radius", "vec_id", "place"]
    return measured.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(rows, _BLOCKS)


def _pairs(blocks: DataFrame) -> DataFrame:
    """(home, block): blocks of queries and of candidates whose bound reaches the least score of a query.

    Only the blocks' summaries are compared; each block of candidates falls in one of `ways`
    and each block of queries goes to all of them.
    """
    ways = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summary = ["low", "high", "most"]
    queries = blocks.where("queries").select(
        F.col("block").alias("home"), *[F.col(c).alias(f"q_{c}") for c in summary], "threshold",
        F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("way"),
    )
    rows = blocks.where("NOT queries").select("block", *summary, F.pmod(F.xxhash64("block"), F.lit(ways)).cast("int").alias("way"))
    both = rows.join(queries, "way").selectExpr(
        "home", "block", "threshold", "most + q_most AS squares",
        """greatest(0D, coalesce(array_max(zip_with(
            zip_with(low, q_high, (a, b) -> a - b), zip_with(q_low, high, (a, b) -> a - b), (a, b) -> greatest(a, b)
        )), 0D)) AS gap""",
    )
    apart = F.greatest(F.lit(0.0), F.col("gap") - SLACK * F.sqrt("squares"))
    return both.where((F.col("squares") - apart * apart) / 2 + SLACK * F.col("squares") >= F.col("threshold")).select("home", "block")


def nearest(embeddings: DataFrame, k: int = K, every: int = 50, *, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each query row.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but
    the query's own, so other rows that repeat its vec_id or its vector count. Ties go to
    the smaller vec_id, null ids last. Vectors that are null or hold null, NaN or infinite
    components take no part; components are floor(256 * x), within 64 bits. Of vectors of
    different lengths the shorter counts as filled up with zeros (so an empty one scores 0).
    Scores beyond 64 bits are the nearest 64-bit integer. A null vec_id is no query. Repeated
    query rows are told each. With k rows or fewer in the table, all others are told. Empty in,
    empty out. Other columns are ignored.
    """
    own = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vec"))
    vectors = own.where(usable(F.col("vec"))).select("vec_id", quantised(F.col("vec")).alias("vec"))
    # At most `sample` rows.
    few = vectors.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(sample).toArrow()
    rows = matrix(few.column("vec"))
    ids = np.array([-1 if x is None else x for x in few.column("vec_id").to_pylist()], np.int64)
    measured = _measured(vectors, (chosen := choose_pivots(rows, pivots)))
    blocks = stored(_blocks(measured, chosen, ids, rows, k, every, block), "pivot-blocks")
    pairs = stored(_pairs(blocks).withColumn("part", F.pmod(F.xxhash64("home"), F.lit(_parts(blocks))).cast("int")), "block-pairs")
    left = pairs.select("block", "part").distinct().join(blocks.where("NOT queries"), "block")
    payload = ["n", "width", "ids", "known", "vecs", "distances", "places", "least"]
    asking = blocks.where("queries").select(F.col("block").alias("home"), *[F.col(c).alias(f"q_{c}") for c in payload])
    right = pairs.select("home", F.col("block").alias("q_of"), F.col("part").alias("q_part")).join(asking, "home")

    def search(one: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _FOUND.split(", ")}
        for row in one.to_pylist():
            x = Block(row)
            for q in (Block({"block": r["home"]} | {c: r[f"q_{c}"] for c in payload}) for r in asked.to_pylist()):
                for i in range(len(q.ids)):
                    own = int(q.places[i]) if q.number == x.number else -1
                    at, scores = best(q, i, x, k, float(q.least[i]), own)
                    out["home"] += [q.number] * len(at)
                    out["place"] += [int(q.places[i])] * len(at)
                    out["query_id"] += [int(q.ids[i])] * len(at)
                    out["vec_id"] += [int(x.ids[j]) if x.known[j] else None for j in at.tolist()]
                    out["score"] += scores.tolist()
        kinds = {"place": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    found = left.groupBy("block", "part").cogroup(right.groupBy("q_of", "q_part")).applyInArrow(search, _FOUND)
    ranking = Window.partitionBy("home", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _parts(blocks: DataFrame) -> int:
    """Into how many parts the blocks of queries fall, so that a part has AT_ONCE of them."""
    return max(1, -(-blocks.where("queries").count() // AT_ONCE))


#: DuckDB: all pairs of a query and another row. `hugeint` sums are cast back.
NEAREST_SQL = """
WITH good AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, q.place, x.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good x ON q.place <> x.place WHERE q.vec_id % 50 = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
