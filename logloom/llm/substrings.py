"""Substring dedup: removes the words of every long enough passage that occurs more than once.

Windows are extended level by level to twice their length, and only those that are
repeated at one length go on to the next: a quarter of the window, half of it, all.

At the first level not every place is looked at. Of the short windows within a long
one, the one of least hash (the leftmost of those) is its anchor. Equal long windows
have equal anchors at the same place, so long windows need comparing only if their anchor
is repeated. Consecutive starts mostly share an anchor: the words from the first such
window's start to the last one's end are a stretch. Stretches that repeat as a whole are
settled; the windows of the others are compared one by one, within the bounds that the
anchor's extensions to twice its length, to the left and to the right, leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import Windows, hashes, stored, words_of

WINDOW = 35
_NO_ID = -(1 << 63)
_STRETCH_FIELDS = [
    ("anchor", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()),
    ("a", pa.int32()), ("b", pa.int32()), ("p", pa.int32()), ("left", pa.int32()), ("right", pa.int32()),
]
STRETCH_SCHEMA = "anchor bigint, stretch bigint, doc bigint, version bigint, a int, b int, p int, `left` int, `right` int"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and version name a text: repeated ids, and rows without one, are told apart by the text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))
    has_id = F.col("doc_id").isNotNull().alias("has_id")
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("version"), has_id, text.alias("text"))


def stretches_of(word_hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...] | None:
    """(anchor, stretch, a, b, p, left, right): windows that start in a to b share the anchor at p."""
    n, seed = len(word_hashes), -(-window // 4)
    if n < window:
        return None
    windows = Windows(word_hashes)
    short = windows.all(seed)
    places = np.lib.stride_tricks.sliding_window_view(short, window - seed + 1).argmin(axis=1)
    places = places + np.arange(len(places))
    turns = np.flatnonzero(places[1:] != places[:-1]) + 1
    a, b = np.concatenate([[0], turns]), np.concatenate([turns - 1, [len(places) - 1]])
    p = places[a]
    # Extensions that every window of a part of the stretch contains; 0 where there is no such part.
    left = np.where(p - seed >= a, windows.of(np.maximum(p - seed, 0), 2 * seed), np.uint64(0))
    reach = p + 2 * seed <= b + window
    right = np.where(reach, windows.of(np.where(reach, p, 0), np.where(reach, 2 * seed, 0)), np.uint64(0))
    return short[p], windows.of(a, b - a + window), a, b, p, left >> np.uint64(32), right >> np.uint64(32)


def stretches(keyed: DataFrame, window: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text"):
                one = stretches_of(hashes(words_of(text.as_py())), window)
                sizes.append(0 if one is None else len(one[2]))
                if one is not None:
                    found.append(one)
            if not found:
                continue
            anchor, stretch, a, b, p, left, right = (np.concatenate(c) for c in zip(*found))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [
                pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)),
                batch.column("doc").take(at), batch.column("version").take(at),
                *(pa.array(x.astype(np.int32)) for x in (a, b, p)),
                *(pa.array(x.astype(np.uint32).view(np.int32)) for x in (left, right)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_STRETCH_FIELDS))

    return keyed.mapInArrow(rows, STRETCH_SCHEMA)


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, version, first, last): words covered by windows that occur elsewhere too, in parts."""
    keyed = _keyed(docs)
    seed = -(-window // 4)
    every = stretches(keyed, window)
    # First level: anchors that are repeated.
    again = every.groupBy("anchor").agg(F.count("*").alias("__n")).where("__n > 1").select("anchor")
    some = stored(every.join(again, "anchor", "left_semi"), "anchors")
    firsts = [F.first(c).alias(c) for c in ("doc", "version", "a", "b", "p", "left", "right")]
    distinct = stored(some.groupBy("anchor", "stretch").agg(F.count("*").alias("__n"), *firsts), "stretches")
    settled = distinct.where("__n > 1").select("anchor", "stretch")
    whole = some.join(settled, ["anchor", "stretch"], "left_semi").select(
        "doc", "version", F.col("a").alias("first"), (F.col("b") + (window - 1)).alias("last")
    )
    # Second level: the anchor with as many words again to its left, and to its right.
    sums = lambda side: distinct.groupBy("anchor", side).agg(F.sum("__n").alias(f"__{side}"))
    wider = distinct.join(sums("left"), ["anchor", "left"]).join(sums("right"), ["anchor", "right"])
    low = F.when(F.col("__left") > 1, F.col("a")).otherwise(F.greatest(F.col("a"), F.col("p") - (seed - 1)))
    high = F.when(F.col("__right") > 1, F.col("b")).otherwise(F.least(F.col("b"), F.col("p") + (2 * seed - window - 1)))
    wider = wider.withColumn("low", low).withColumn("high", high)
    alone = wider.where("__n = 1 AND low <= high")
    # Third level: single windows, those of settled stretches counting as repeated already.
    asked = alone.select("anchor").distinct()
    partners = wider.where("__n > 1").join(asked, "anchor", "left_semi")
    ask = alone.unionByName(partners).select("doc", "version", F.struct("anchor", "a", "low", "high", "b", "__n").alias("__ask"))
    ask = ask.groupBy("doc", "version").agg(F.collect_list("__ask").alias("asked"))
    full = keyed.join(ask, ["doc", "version"]).mapInArrow(_windows_of(window), _WINDOW_SCHEMA)
    often = full.groupBy("anchor", "content").agg(F.sum("weight").alias("__w")).where("__w > 1").select("anchor", "content")
    parts = full.where("weight = 1").join(often, ["anchor", "content"], "left_semi").select(
        "doc", "version", F.col("start").alias("first"), (F.col("start") + (window - 1)).alias("last")
    )
    return whole.unionByName(parts)


_WINDOW_SCHEMA = "anchor bigint, content bigint, doc bigint, version bigint, start int, weight int"


def _windows_of(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for doc, version, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "text", "asked"))):
                windows = Windows(hashes(words_of(text)))
                for x in asked:
                    alone = x["__n"] == 1
                    first, last = (x["low"], x["high"]) if alone else (x["a"], x["b"])
                    starts = np.arange(first, last + 1)
                    n = len(starts)
                    own = (
                        np.full(n, x["anchor"], np.int64), windows.of(starts, window).view(np.int64),
                        np.full(n, doc, np.int64), np.full(n, version, np.int64), starts.astype(np.int32),
                        np.full(n, 1 if alone else 2, np.int32),
                    )
                    for p, v in zip(parts, own):
                        p.append(v)
            if parts[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(p)) for p in parts],
                    names=["anchor", "content", "doc", "version", "start", "weight"],
                )

    return rows


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed (spans of word numbers).

    Each word is removed that lies in a window of `window` consecutive words of one document
    whose word sequence also starts anywhere else, the same document included; windows are
    judged on the input. Kept words are joined by one blank. A null or wordless text has no
    words and an empty kept text; shorter texts than a window lose nothing. Rows that repeat a
    doc_id are documents of their own (so identical rows remove each other's long passages),
    as are rows without doc_id. Other columns are ignored; empty in, empty out. A passage
    in a third of all documents moves as a few numbers for each of them.
    """
    ranges = repeated_ranges(docs, window).groupBy("doc", "version").agg(
        F.collect_set(F.struct("first", "last")).alias("ranges")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept, spans = [], [], [], []
            for text, own in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                words = words_of(text.as_py())
                edges = np.zeros(len(words) + 1, np.int64)
                for r in own or ():
                    edges[r["first"]] += 1
                    edges[r["last"] + 1] -= 1
                cover = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
                sizes.append(len(words))
                gone.append(int(cover.sum()))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turns[::2], turns[1::2])])
                kept.append(b" ".join(w for w, c in zip(words, cover.tolist()) if not c).decode() if own else b" ".join(words).decode())
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(batch.column("has_id"), batch.column("doc"), pa.scalar(None, pa.int64())),
                 pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(spans, span)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    return _keyed(docs).join(ranges, ["doc", "version"], "left").mapInArrow(
        rows, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<first: int, last: int>>"
    )
