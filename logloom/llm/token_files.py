"""Token ids of whole documents in binary segments, in ascending order of doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm import blocks
from logloom.llm.encoder import numbered
from logloom.llm.text import whole_text

END_ID = 2
#: A segment is closed once it has so many ids; a document is never split.
SEGMENT_IDS = 1 << 20
#: Texts encoded at a time.
BATCH = 1024
SEGMENT_SCHEMA = (
    "part int, segment int, n_docs bigint, n_ids bigint,"
    " doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
)
_SEGMENT_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_tokens(
    docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode `text` of every row and write segments below `root`.

    Partitions hold ascending ranges of doc_id and are sorted, so (part, segment,
    place) is the global order. Rows of one doc_id follow each other by text; a null
    doc_id comes first, a null text is an empty one (its only id is `end_id`). An empty
    table writes no segment. Other columns are ignored. Committed by Spark's writer:
    a lost executor costs a repeated task.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = numbered(tokenizer)
        end = np.array([end_id], np.uint32)
        part, made = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, names, sizes, held, made
            payload = blocks.encode(np.concatenate(ids))
            row = [[part], [made], [len(names)], [held], [names], [sizes], [payload]]
            ids, names, sizes, held, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, _SEGMENT_ARROW)], schema=_SEGMENT_ARROW
            )

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                few = batch.slice(at, BATCH)
                texts = few.column("text").to_pylist()
                for doc_id, own in zip(few.column("doc_id").to_pylist(), encoder.encode(texts)):
                    ids += [own, end]
                    names.append(doc_id)
                    sizes.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= segment_ids:
                        yield close()
        if names:
            yield close()

    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(segments, SEGMENT_SCHEMA)
        .write.parquet(root)
    )


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(root)


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """Rows (doc_id, part, segment, place, offset, ids) from the segments' payload."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, bounds, ids in _documents(batches):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*head, lists], names=[*_HEAD_NAMES, "ids"])

    return read_segments(spark, root).mapInArrow(rows, f"{_HEAD_SCHEMA}, ids array<int>")


_HEAD_NAMES = ["doc_id", "part", "segment", "place", "offset", "n_tokens"]
_HEAD_SCHEMA = "doc_id bigint, part int, segment int, place int, offset bigint, n_tokens bigint"


def _documents(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for r in range(batch.num_rows):
            part, segment, n, n_ids, names, sizes, payload = (batch.column(c)[r] for c in range(7))
            ids = blocks.decode(payload.as_buffer().to_pybytes())
            sizes = sizes.values.to_numpy()
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            if len(ids) != n_ids.as_py() or bounds[-1] != len(ids) or len(sizes) != n.as_py():
                raise ValueError("a segment's index and payload differ")
            m = len(sizes)
            head = [
                names.values, pa.array(np.full(m, part.as_py(), np.int32)),
                pa.array(np.full(m, segment.as_py(), np.int32)), pa.array(np.arange(m, dtype=np.int32)),
                pa.array(bounds[:-1].astype(np.int64)), pa.array(sizes.astype(np.int64)),
            ]
            yield head, bounds, ids


def document_digests(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it. Sizes are summed within a part and
    then over the parts (as many rows as the writer had tasks).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, bounds, ids in _documents(batches):
            data = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array(crcs, pa.int64())], names=[*_HEAD_NAMES, "ids_crc32"]
            )

    segments = read_segments(spark, root).select("part", "segment", "n_ids")
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = segments.withColumn("segment_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    starts = starts.join(parts, "part").select(
        "part", "segment", (F.col("part_start") + F.col("segment_start")).alias("base")
    )
    read = read_segments(spark, root).mapInArrow(rows, f"{_HEAD_SCHEMA}, ids_crc32 bigint")
    return read.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
