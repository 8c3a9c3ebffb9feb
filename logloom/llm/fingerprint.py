"""Homomorphic fingerprints of documents, as sums of vectors hashed from their parts.

A text is a multiset of parts: its lines, cut after sentence ends. Each part is hashed
to a wide vector, and the fingerprint is the sum of the vectors, each lane modulo 2^32.
It does not depend on the parts' order, and parts can be put in or taken out by adding
or subtracting their vectors (`combine`).

Lanes: the number of parts; EXACT lanes that hold halves of seeded 64-bit hashes, for
equality; SIGNS lanes that count a bit of the hash each. A lane's count c over n parts
is the sum of signs 2c - n, so the squares of the lanes' differences estimate by how
many parts two texts differ.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.text import stored

SEEDS = (1, 2, 3, 4)
EXACT = 2 * len(SEEDS)
SIGNS = 64
LANES = 1 + EXACT + SIGNS
_LOW = 0xFFFFFFFF
_PAIR = 0x0000000100000001
PARTS = r"\n|(?<=[.!?])\s"
#: Bytes of text in a run of documents that one task orders.
RUN_BYTES = 16 << 20
_LEAST = -(1 << 63)


def parts_of(text: Column) -> Column:
    """Lines, cut at the blank after a sentence end; empty parts do not count."""
    return F.filter(F.split(text, PARTS), lambda p: p != "")


def _sums(part: Column) -> list[Column]:
    """Aggregates over parts; two lanes share a 64-bit sum that cannot overflow before 2^31 parts."""
    out = [F.count(part).alias("__n")]
    for s in SEEDS:
        h = F.when(part.isNotNull(), F.xxhash64(F.lit(s), part))
        out += [F.sum(h.bitwiseAND(F.lit(_LOW))).alias(f"__l{s}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"__h{s}")]
    h = F.when(part.isNotNull(), F.xxhash64(F.lit(0), part))
    out += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR))).alias(f"__b{j}") for j in range(SIGNS // 2)]
    return out


def _lanes() -> Column:
    """The array of lanes, each below 2^32, from the sums."""
    half = SIGNS // 2
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lanes = [F.col("__n")]
    lanes += [zero(f"__{x}{s}") for s in SEEDS for x in "lh"]
    lanes += [zero(f"__b{j}") for j in range(half)] + [F.shiftrightunsigned(zero(f"__b{j}"), 32) for j in range(half)]
    return F.array(*[x.bitwiseAND(F.lit(_LOW)) for x in lanes])


def to_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def from_text(fingerprint: Column) -> Column:
    at = F.sequence(F.lit(0), F.lit(LANES - 1))
    return F.transform(at, lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint (as lanes) of the union of two multisets, or with -1 of their difference."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of lanes: 1 - |A - B|^2 / (|A|^2 + |B|^2), 1 for equal ones."""
    n_a, n_b = F.get(a, 0), F.get(b, 0)
    signs = lambda x: F.slice(x, 2 + EXACT, SIGNS)
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    as_sums = lambda x, n: F.transform(signs(x), lambda c: (2 * c - n).cast("double"))
    one, two = as_sums(a, n_a), as_sums(b, n_b)
    apart = square(F.zip_with(one, two, lambda x, y: x - y))
    whole = square(one) + square(two)
    near = F.when(whole == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / F.nullif(whole, F.lit(0.0))))
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def fingerprints(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per key: the keys and `lanes`. A null or empty text has all lanes 0."""
    parts = texts.select(*keys, F.explode_outer(parts_of(F.coalesce(F.col(column), F.lit("")))).alias("__part"))
    return parts.groupBy(*keys).agg(*_sums(F.col("__part"))).select(*keys, _lanes().alias("lanes"))


def _cuts(docs: DataFrame, run_bytes: int) -> list[int]:
    """Values of the order that split the documents into runs of about as many bytes, descending."""
    n_bytes = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    n = math.ceil(n_bytes / run_bytes)
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("__order", shares, max(10_000, 20 * n))).first()[0]
    return sorted(set(cuts or ()), reverse=True)


def _with_run(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """`docs` with __run: how many cuts lie above the row's place in the order, by bisection.

    In one expression of a fixed size. Were each step a column, the optimizer would put the
    columns into one another, and each step would make the plan four times as large.
    """
    if not cuts:
        return docs.withColumn("__run", F.when(F.col("__order") >= _LEAST, 0).otherwise(1))  # 0, but no constant
    values = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def further(run: Column, step: Column) -> Column:
        at = run + step
        above = (at <= len(cuts)) & (F.coalesce(F.get(values, at - 1), F.lit(_LEAST)) > F.col("__order"))
        return F.when(above, at).otherwise(run)

    # Never null; known to be so, it need not be computed a second time to filter the join by it.
    return docs.withColumn("__run", F.coalesce(F.aggregate(steps, F.lit(0), further), F.lit(0)))


def with_next(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(__run, __place, doc_id, __text, __next): each text and the next one's by descending
    doc_id, the first following the last. Runs of ids are ordered apart, one shuffle in all;
    the next text of a run's last row is that of the following run's first.
    """
    base = docs.select(
        F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("__order"),
    )
    runs = _with_run(base, _cuts(base, run_bytes))
    order = W.partitionBy("__run").orderBy(F.desc("__order"), F.desc("__text"))
    rows = runs.select(
        "__run", F.row_number().over(order).alias("__place"), "doc_id", "__text",
        F.lead("__text").over(order).alias("__lead"),
    )
    # The first row of each run: its id from ids alone, then the text of that one row.
    # One row per `run_bytes` of text, of 12 bytes, so it can be broadcast at any size.
    firsts = stored(runs.groupBy("__run").agg(F.max("__order").alias("__order")), "runs")
    heads = base.select("__order", "__text").join(F.broadcast(firsts), "__order")
    heads = stored(heads.groupBy("__run").agg(F.max("__text").alias("__head")), "heads")
    in_order = W.orderBy("__run")
    following = firsts.select(
        "__run", F.coalesce(F.lead("__run").over(in_order), F.first("__run").over(in_order)).alias("__to")
    )
    heads = following.join(heads.withColumnRenamed("__run", "__to"), "__to").select("__run", "__head")
    return rows.join(heads, "__run").select(
        "__run", "__place", "doc_id", "__text", F.coalesce("__lead", "__head").alias("__next")
    )


def half_edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def edit_fingerprints(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Fingerprints of every text and of its half-edited one, and how near they are.

    One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is an empty one; equal
    texts have equal fingerprints and likeness 1, also two empty ones. Rows of one doc_id
    follow each other by descending text; a null doc_id comes last; a single row is its
    own next. Other columns are ignored; empty in, empty out.
    """
    rows = with_next(docs, run_bytes)
    edited = half_edited(F.col("__text"), F.col("__next"))
    rows = rows.select(
        "__run", "__place", "doc_id", F.char_length("__text").cast("bigint").alias("n_chars"),
        F.array("__text", edited, "__next").alias("__texts"),
    )
    kinds = rows.select(
        "__run", "__place", "doc_id", "n_chars", F.posexplode("__texts").alias("__kind", "__one")
    )
    digest = F.when(F.col("__kind") == 1, F.sha2(F.encode("__one", "UTF-8"), 256))
    keys = ["__run", "__place", "__kind"]
    parts = kinds.select(
        *keys, "doc_id", "n_chars", digest.alias("__sha"), F.explode_outer(parts_of(F.col("__one"))).alias("__part")
    )
    sums = parts.groupBy(*keys, "doc_id", "n_chars", "__sha").agg(*_sums(F.col("__part")))
    lanes = sums.select("__run", "__place", "doc_id", "n_chars", "__kind", "__sha", _lanes().alias("lanes"))
    of = lambda kind: F.max(F.when(F.col("__kind") == kind, F.col("lanes")))
    rows = lanes.groupBy("__run", "__place", "doc_id", "n_chars").agg(
        F.max("__sha").alias("edited_sha256"), of(0).alias("__own"), of(1).alias("__edited"), of(2).alias("__next")
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("__own")).alias("fingerprint"),
        to_text(F.col("__edited")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )
