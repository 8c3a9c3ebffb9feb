"""Near-duplicate documents by a multi-index join of MinHash signatures.

A document's set is that of its 5-word shingles. Its signature has SLOTS minimum
hashes of 32 bits, and the distance of two signatures is the number of slots in which
they differ. The slots are split into chunks of CHUNK; by the pigeonhole principle two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 slots differ in at most ERRORS
slots of some chunk. Those errors are enumerated: a chunk is indexed once for every way of
leaving ERRORS of its slots out, so all pairs within that distance meet in a bucket.
At the least likeness, 0.75, a slot differs with probability 1/4, and one of the 8
chunks is within its error with probability 1 - 2e-5.

Bucket members are never all paired in the output. A bucket's smallest member is its
centre, and all others are compared with it on full sets; that merges most groups of
copies, of any size, by as many comparisons as members. Buckets that still hold several
classes are cut into blocks of BLOCK members, and every two blocks are compared by one
task, which holds their sets and returns no more links than join their members (a
forest). Pairs that a bucket of lower number has in common, too, are left to that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.text import keep_only, lower_words_of, mix, release, shingle_set, slices, stored

SHINGLE = 5
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 75
CHUNKS, CHUNK, ERRORS = 8, 4, 1
SLOTS = CHUNKS * CHUNK
#: Members of a bucket that one side of a task holds.
BLOCK = 2048
_MASKS = list(combinations(range(CHUNK), CHUNK - ERRORS))
KEYS = CHUNKS * len(_MASKS)

#: Pairs whose signatures differ in more slots are not compared: at the least likeness
#: that happens to fewer than 2 pairs in a million.
MAX_DISTANCE = 21
SET_SCHEMA = "doc_id bigint, text_hash bigint, n_shingles bigint, set_hi bigint, set_lo bigint, signature array<int>"


_SEEDS = mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64))
_FACTORS = list(zip(_SEEDS[:SLOTS] | np.uint64(1), _SEEDS[SLOTS:]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum over the set of SLOTS hash functions, 32 bits each."""
    out = np.empty(SLOTS, np.uint64)
    for i, (a, b) in enumerate(_FACTORS):
        out[i] = (shingles * a + b).min()
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def chunk_keys(signature: Column) -> Column:
    """The KEYS bucket names of a signature, in order of number."""
    keys = []
    for c in range(CHUNKS):
        for m, mask in enumerate(_MASKS):
            slots = [F.get(signature, c * CHUNK + i) for i in mask]
            keys.append(F.xxhash64(F.lit(c * len(_MASKS) + m), *slots))
    return F.array(*keys)


def distance(a: Column, b: Column) -> Column:
    """Slots in which two signatures differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def _int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def document_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, a hash of the text, n_shingles, a 128-bit hash of the set, the signature."""
    none = np.empty(0, np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup", release)
        for batch in slices(batches):
            sizes, high, low, signatures = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(lower_words_of(text.as_py()), SHINGLE)
                sizes.append(len(s))
                high.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64)) if len(s) else 0)
                low.append(int(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
                signatures.append(signature(s) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in (sizes, high, low)),
                 _int_lists(signatures)],
                names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "signature"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(rows, SET_SCHEMA)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose full shingle sets are near enough. `texts` has (id, text).

    The text of `a` is joined first and moves; that of `b`, the centre of many pairs, is
    joined last and goes straight to the comparison, in runs of equal `b`.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup", release)
        last, centre = None, None
        for batch in slices(batches):
            keep = []
            for b, text_a, text_b in zip(*(batch.column(c) for c in ("b", "text_a", "text_b"))):
                if b.as_py() != last:
                    last, centre = b.as_py(), shingle_set(lower_words_of(text_b.as_py()), SHINGLE)
                own = shingle_set(lower_words_of(text_a.as_py()), SHINGLE)
                both = len(np.intersect1d(own, centre, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(own) + len(centre) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    near = near.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return near.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    Every id takes its neighbours' smallest id, and so does that one (hook and jump), until
    nothing changes; hot ids are pre-aggregated by the minimum before they are shuffled.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    parents = edges.select("u", "v").union(edges.select("v", F.col("v"))).groupBy("u").agg(F.min("v").alias("p"))
    state = stored(parents.select(F.col("u").alias("id"), F.col("p").alias("component")), "parents")
    while True:
        # An edge hands the smaller of its ends' components to the components of both.
        ends = edges.join(state.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u")
        ends = ends.join(state.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v")
        hooks = ends.where("cu <> cv").select(F.greatest("cu", "cv").alias("component"), F.least("cu", "cv").alias("to"))
        hooks = stored(hooks.groupBy("component").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return state
        # Follow the hooks among components to their ends before the ids are renamed.
        jumps = hooks
        while True:
            onward = hooks.select(F.col("component").alias("to"), F.col("to").alias("__next"))
            further = jumps.join(onward, "to", "left").select("component", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("__moved"))
            jumps = stored(further, "jumps")
            moved = jumps.where("__moved").isEmpty()
            jumps = jumps.select("component", "to")
            if moved:
                break
            hooks = jumps
        state = stored(
            state.join(jumps, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "parents"
        )


def _near_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose signatures are near enough for a link."""
    near = pairs.distinct().join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("__a")), "a")
    near = near.join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("__b")), "b")
    return near.where(distance(F.col("__a"), F.col("__b")) <= MAX_DISTANCE).select("a", "b")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first bucket that each signature of `a` shares with each of `b`, KEYS if none."""
    out = np.full((len(a), len(b)), KEYS, np.int16)
    for c in reversed(range(CHUNKS)):
        same = [a[:, None, c * CHUNK + i] == b[None, :, c * CHUNK + i] for i in range(CHUNK)]
        for m in reversed(range(len(_MASKS))):
            out[np.logical_and.reduce([same[i] for i in _MASKS[m]])] = c * len(_MASKS) + m
    return out


def _forest(number: int, first: list[dict], second: list[dict]) -> list[tuple[int, int]]:
    """Links that join the members of two blocks (or of one, given twice) of a bucket."""
    own = first is second
    signatures = [np.array([m["signature"] for m in block], np.int32) for block in (first, second)]
    names, ids = {}, [[m["id"] for m in block] for block in (first, second)]
    parent: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for block in (first, second):
        for m in block:
            if m["class"] not in names:
                names[m["class"]] = len(parent)
                parent.append(len(parent))
    classes = [np.array([names[m["class"]] for m in block]) for block in (first, second)]
    todo = _first_common(*signatures) == number
    todo &= classes[0][:, None] != classes[1][None, :]
    near = np.zeros(todo.shape, np.int16)
    for i in range(SLOTS):
        near += signatures[0][:, None, i] != signatures[1][None, :, i]
    todo &= near <= MAX_DISTANCE
    if own:
        todo = np.triu(todo, 1)
    if not todo.any():
        return []
    sets = [shingle_set(lower_words_of(m["text"]), SHINGLE) for m in second]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words, places = np.unique(np.concatenate(sets), return_inverse=True)
    links = []
    for i in np.flatnonzero(todo.any(axis=1)):
        mine = sets[i] if own else shingle_set(lower_words_of(first[i]["text"]), SHINGLE)
        hit = np.zeros(len(words), np.int64)
        hit[np.intersect1d(words, mine, assume_unique=True, return_indices=True)[1]] = 1
        both = np.add.reduceat(hit[places], starts)
        for j in np.flatnonzero(todo[i] & (100 * both >= PERCENT * (len(mine) + sizes - both))):
            x, y = root(int(classes[0][i])), root(int(classes[1][j]))
            if x != y:
                parent[x] = y
                links.append((max(ids[0][i], ids[1][j]), min(ids[0][i], ids[1][j])))
    return links


def _block_links(members: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes within buckets; members are (bucket, number, id, class, __n)."""
    blocks = F.ceil(F.col("__n") / F.lit(BLOCK)).cast("int")
    placed = members.withColumn("__blocks", blocks).withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")
    placed = placed.select("bucket", "number", "id", "class", "__block", other)
    full = placed.join(signatures, "id").join(texts, "id").select(
        "bucket", "number", "id", "class", "signature", "text", "__block",
        F.least("__block", "__other").alias("__low"), F.greatest("__block", "__other").alias("__high"),
    )

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        low, high = rows[0]["__low"], rows[0]["__high"]
        first = [r for r in rows if r["__block"] == low]
        second = first if low == high else [r for r in rows if r["__block"] == high]
        links = _forest(rows[0]["number"], first, second) if first and second else []
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("bucket", "__low", "__high").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id, n_links.

    Documents are linked if 100 * intersection >= 75 * union of their shingle sets, which is
    confirmed on the full sets; component_id is the smallest doc_id reachable. Equal
    sets form a class, represented by its smallest doc_id (class_id), which alone is
    compared; n_links counts the confirmed links with other classes that the join found
    for it. Null, empty and wordless texts have empty sets and are linked with
    nothing. Fewer than five words are one shingle. Rows that repeat a doc_id are one
    document, with the text of the largest hash; rows without doc_id are documents of their
    own, linked with nothing and kept. Other columns are ignored; empty in, empty out.
    """
    sets = stored(document_sets(docs), "sets")
    largest = F.max_by(F.struct("text_hash", "n_shingles", "set_hi", "set_lo", "signature"), "text_hash")
    one = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(largest.alias("__s")).select("doc_id", "__s.*")
    one = stored(one, "documents")
    key = ["n_shingles", "set_hi", "set_lo"]
    first = F.min_by(F.struct("text_hash", "signature"), "doc_id").alias("__s")
    classes = one.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), first)
    classes = stored(classes.select(*key, "id", "__s.*"), "classes")
    buckets = classes.select("id", F.posexplode(chunk_keys(F.col("signature"))).alias("number", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("__n")).where("__n > 1").select("bucket")
    found = _links(stored(buckets.join(shared, "bucket"), "buckets"), classes, docs)
    counts = found.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    labels = components(found).withColumnRenamed("id", "class_id")
    named = classes.select(*key, F.col("id").alias("class_id")).join(labels, "class_id", "left").join(counts, "class_id", "left")
    grouped = one.where("n_shingles > 0").select("doc_id", *key).join(named, key).select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    alone = one.where("n_shingles = 0").select("doc_id", "n_shingles").unionByName(
        sets.where("doc_id IS NULL").select("doc_id", "n_shingles")
    )
    alone = alone.select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"),
    )
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(buckets: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """All confirmed links (a, b), a > b, that the buckets (bucket, id) lead to."""
    signatures = classes.select("id", "signature")
    candidates = classes.select("id", "text_hash").join(buckets.select("id").distinct(), "id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = stored(texts.join(candidates, ["id", "text_hash"]).select("id", "text"), "candidates")
    # Every member against its bucket's centre.
    centres = buckets.groupBy("bucket").agg(F.min("id").alias("b"))
    centred = buckets.join(centres, "bucket").where("id <> b")
    pairs = _near_pairs(centred.select(F.col("id").alias("a"), "b"), signatures)
    found = stored(linked(pairs, texts).distinct(), "links")
    labels = components(found)
    # What the buckets hold besides their centres, if it is of several classes.
    rest = centred.select("bucket", "number", "id").join(labels, "id", "left")
    rest = stored(rest.select("bucket", "number", "id", F.coalesce("component", "id").alias("class")), "rest")
    still = rest.groupBy("bucket").agg(
        (F.min("class") != F.max("class")).alias("__several"), F.count("*").alias("__n")
    ).where("__several").select("bucket", "__n")
    more = _block_links(rest.join(still, "bucket"), signatures, texts)
    return found.unionByName(stored(more.distinct(), "block-links")).distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose document is the smallest of its component.

    Of rows that repeat a doc_id, one stays; rows without doc_id stay.
    """
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn("__doc", F.col("doc_id").cast("bigint"))
    left = named.join(gone, named["__doc"] == gone["__gone"], "left_anti")
    order = W.partitionBy("__doc").orderBy(F.desc(F.xxhash64("text")))
    one = left.withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
