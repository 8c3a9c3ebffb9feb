"""Phrases of two to five words that stand together more often than their parts would.

Words are counted first. A phrase can only be frequent if its words and pairs are, so the
texts are then read for pairs of frequent words, and once more for longer phrases all of
whose pairs are frequent. What is frequent goes to the tasks as a bitmap of bounded size: a
bit that is set by chance only costs work, as every count that matters is taken exactly.

Each task counts in a trie of word numbers that is shallow: it branches by prefix (all words
but the last, and a sixteenth of the last ones, so that no prefix is too common), and its
leaves are containers of whole phrases with counts. A container that outgrows BURST phrases
bursts into sixteen. When the trie outgrows its limit, its largest subtrees are spilled as
runs sorted by prefix, which are merged per prefix partition; the number of partitions
follows the number of words, so that each is small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import LOWER, mix, stored

LEAST, LONGEST, TOP = 100, 5, 2000
NO_LANG = "und"
#: Distinct words that a task counts before it hands them on.
WORDS = 500_000
#: Phrases of a container before it bursts; of a trie before it spills; of a partition, about.
BURST, LIMIT, PART = 1 << 17, 1 << 22, 1 << 21
#: Bits of a bitmap for each frequent phrase, and of the largest bitmap (16 MB).
BITS, MOST_BITS = 32, 1 << 27
#: Texts that are numbered at once.
AT_ONCE = 2000
_BREAK = b"."
_PLAIN = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" " + _BREAK * 9)
_PLAIN = bytes(LOWER[c] if c in range(65, 91) else _PLAIN[c] for c in range(256))
_RUNS = "part bigint, k int, words binary, counts binary"
_PHRASES = "words array<bigint>, f bigint"


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A to Z), with a full stop between the pieces of a text."""
    return text.translate(_PLAIN).replace(_BREAK, b" . ").split() if text else []


def word_id(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\0" + word, seed)


def row_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word ids, by its words and their order."""
    out = np.full(len(ids), ids.shape[1], np.uint64)
    for k in range(ids.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[:, k])
    return out


def prefix_hashes(ids: np.ndarray) -> np.ndarray:
    """Of all words but the last, and of the sixteenth that the last one falls in."""
    return mix(row_hashes(ids[:, :-1]) + (ids[:, -1] & np.uint64(15)))


def folded(rows: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows added up, in the order of `keys`, which equal rows share."""
    order = np.argsort(keys, kind="stable")
    rows, counts, keys = rows[order], counts[order], keys[order]
    other = (rows[1:] != rows[:-1]).any(axis=1)
    if (other & (keys[1:] == keys[:-1])).any():  # different rows of one key
        order = np.lexsort((*rows.T, keys))
        rows, counts, keys = rows[order], counts[order], keys[order]
        other = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(np.concatenate([[True], other])) if len(rows) else np.empty(0, np.int64)
    return rows[first], np.add.reduceat(counts, first) if len(first) else counts, keys[first]


class Node:
    """A container of phrases below `depth` hexadecimal digits of their prefix, or its sixteen children."""

    def __init__(self, depth: int):
        self.depth, self.children = depth, None
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, counts: np.ndarray, prefixes: np.ndarray) -> None:
        self.size += len(rows)
        if self.children is None:
            self.held.append((rows, counts, prefixes))
            if self.size > BURST:
                rows, counts, prefixes = self.fold()
                if self.size > BURST // 2 and self.depth < 15:
                    self.held, self.children = [], {}
                    self.size = 0
                    self.add(rows, counts, prefixes)
            return
        digits = (prefixes >> np.uint64(60 - 4 * self.depth)) & np.uint64(15)
        for digit in np.unique(digits).tolist():
            own = digits == digit
            child = self.children.setdefault(digit, Node(self.depth + 1))
            before = child.size
            child.add(rows[own], counts[own], prefixes[own])
            self.size += child.size - before - int(own.sum())

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All phrases of the subtree, equal ones added up, sorted by prefix."""
        parts = self.held if self.children is None else [c.fold() for _, c in sorted(self.children.items()) if c.size]
        rows, counts, prefixes = (np.concatenate(x) for x in zip(*parts))
        # The prefix alone sorts; within it rows are told apart by all words.
        whole = folded(rows, counts, prefixes)
        if self.children is None:
            self.held, self.size = [whole], len(whole[0])
        return whole


class Trie:
    """Counts of phrases of k word numbers. `ids` holds the word ids of the numbers."""

    def __init__(self, k: int, parts: int, limit: int = LIMIT):
        self.k, self.limit = k, limit
        self.shift = np.uint64(64 - (parts.bit_length() - 1)) if parts > 1 else None
        self.roots: dict[int, Node] = {}

    def add(self, rows: np.ndarray, ids: np.ndarray) -> Iterator[dict]:
        """Counts each row; yields what is spilled to make room."""
        if not len(rows):
            return
        own = ids[rows]
        rows, counts, _ = folded(rows, np.ones(len(rows), np.int64), row_hashes(own))
        prefixes = prefix_hashes(ids[rows])
        top = prefixes >> np.uint64(60)
        for digit in np.unique(top).tolist():
            at = top == digit
            self.roots.setdefault(digit, Node(1)).add(rows[at], counts[at], prefixes[at])
        if self.size > self.limit:
            for digit, node in sorted(self.roots.items(), key=lambda x: -x[1].size):
                yield from self._run(self.roots.pop(digit), ids)
                if self.size <= self.limit // 2:
                    break

    @property
    def size(self) -> int:
        return sum(node.size for node in self.roots.values())

    def _run(self, node: Node, ids: np.ndarray) -> Iterator[dict]:
        rows, counts, prefixes = node.fold()
        parts = np.zeros(len(rows), np.uint64) if self.shift is None else prefixes >> self.shift
        words = ids[rows]
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            yield {"part": int(parts[a]), "k": self.k, "words": words[a:b].tobytes(), "counts": counts[a:b].tobytes()}

    def rest(self, ids: np.ndarray) -> Iterator[dict]:
        for _, node in sorted(self.roots.items()):
            yield from self._run(node, ids)
        self.roots = {}


class Bitmap:
    """Of rows of word ids: False for all that were not put in, True for all that were."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(len(cells) * 64 - 1)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = row_hashes(ids) & self.mask
        return (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class PhraseCounter:
    """Counts the phrases of some lengths in texts, by numbers that words have in this task.

    The number of a word that is not frequent, and of a break, is 0.
    """

    def __init__(self, lengths: list[int], seed: int, is_frequent: Bitmap, is_pair: Bitmap | None, parts: int, limit: int):
        self.lengths, self.seed, self.is_frequent, self.is_pair = lengths, seed, is_frequent, is_pair
        self.tries = {k: Trie(k, parts, limit // len(lengths)) for k in lengths}
        self.ids = np.zeros(1, np.uint64)
        self.numbers: dict[bytes, dict[bytes, int]] = {}

    def _learn(self, lang: bytes, words: list[bytes]) -> None:
        own = np.fromiter((word_id(lang, w, self.seed) for w in words), np.uint64, len(words))
        frequent = self.is_frequent(own[:, None])
        numbers = np.where(frequent, np.cumsum(frequent) - 1 + len(self.ids), 0)
        self.ids = np.concatenate([self.ids, own[frequent]])
        self.numbers[lang].update(zip(words, numbers.tolist()))

    def add(self, langs: list[bytes], texts: list[bytes | None]) -> Iterator[dict]:
        """Counts the texts' phrases; yields the runs that are spilled."""
        by_lang: dict[bytes, list[list[bytes]]] = {}
        for lang, text in zip(langs, texts):
            if own := words_of(text):
                by_lang.setdefault(lang, []).append(own)
        lines = []
        for lang, docs in by_lang.items():
            numbers = self.numbers.setdefault(lang, {_BREAK: 0})
            if new := set().union(*docs).difference(numbers):
                self._learn(lang, list(new))
            for own in docs:
                lines.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                lines.append(np.zeros(1, np.int32))
        if lines:
            yield from self._count(np.concatenate(lines))
        if sum(map(len, self.numbers.values())) > 4 * WORDS:
            # Forget the words met so far, and so what is counted by their numbers.
            yield from self.rest()
            self.numbers, self.ids = {}, np.zeros(1, np.uint64)

    def _count(self, line: np.ndarray) -> Iterator[dict]:
        joined = (line[:-1] > 0) & (line[1:] > 0)
        if self.is_pair is not None:
            at = np.flatnonzero(joined)
            joined[at] = self.is_pair(self.ids[np.stack([line[at], line[at + 1]], axis=1)])
        whole = joined
        for k in range(2, max(self.lengths) + 1):
            if k > 2:
                whole = whole[:-1] & joined[k - 2 :]
            if k in self.tries:
                at = np.flatnonzero(whole)
                yield from self.tries[k].add(line[at[:, None] + np.arange(k)], self.ids)

    def rest(self) -> Iterator[dict]:
        for trie in self.tries.values():
            yield from trie.rest(self.ids)


def bitmap(phrases: DataFrame):
    """A broadcast bitmap of the rows of `phrases`, at most MOST_BITS / 8 bytes."""
    n = phrases.count()
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (n * BITS).bit_length()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ids = words.flatten().to_numpy().astype(np.uint64).reshape(len(words), -1)
            at = row_hashes(ids) & np.uint64(bits - 1) if len(words) else np.empty(0, np.uint64)
            cells = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(cells)], names=["cell", "bits"])

    found = phrases.select("words").mapInArrow(rows, "cell int, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells = np.zeros(bits // 64, np.uint64)
    cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(cells)


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).cast("binary").alias("lang")
    return docs.select(lang, F.col("text").cast("binary").alias("text"))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, f): how often each word occurs in each language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}

        def handed_on() -> pa.RecordBatch:
            found = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
            counts.clear()
            langs, words, ns = zip(*found) if found else ((), (), ())
            ids = np.fromiter((word_id(a, w, seed) for a, w in zip(langs, words)), np.uint64, len(words))
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.binary()), pa.array(words, pa.binary()), pa.array(ids.view(np.int64)), pa.array(ns, pa.int64())],
                names=["lang", "word", "id", "f"],
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = counts.setdefault(lang, Counter())
                own.update(words_of(text.as_py()))
                own.pop(_BREAK, None)
                if sum(map(len, counts.values())) > WORDS:
                    yield handed_on()
        yield handed_on()

    found = _texts(docs).mapInArrow(rows, "lang binary, word binary, id bigint, f bigint")
    return found.groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def count_phrases(docs: DataFrame, lengths: list[int], seed: int, words, pairs, parts: int, least: int, limit: int = LIMIT) -> DataFrame:
    """(words, f) of the phrases of these lengths that occur `least` times, all of whose words
    (and pairs, if that bitmap is given) are in the bitmaps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Bitmap(pairs.value) if pairs is not None else None
        counter = PhraseCounter(lengths, seed, Bitmap(words.value), near, parts, limit)
        for batch in batches:
            for start in range(0, len(batch), AT_ONCE):
                few = batch.slice(start, AT_ONCE)
                if found := list(counter.add(few.column("lang").to_pylist(), few.column("text").to_pylist())):
                    yield pa.RecordBatch.from_pylist(found, schema)
        for found in counter.rest():
            yield pa.RecordBatch.from_pylist([found], schema)

    def merged(table: pa.Table) -> pa.Table:
        """The runs of a prefix partition, merged."""
        out_words, out_counts = [], []
        for k in sorted(set(table.column("k").to_pylist())):
            own = table.filter(pa.compute.equal(table.column("k"), k))
            ids = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in own.column("words")]).reshape(-1, k)
            counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in own.column("counts")])
            ids, counts, _ = folded(ids, counts, row_hashes(ids))
            frequent = counts >= least
            out_words += ids[frequent].view(np.int64).tolist()
            out_counts += counts[frequent].tolist()
        return pa.table({"words": pa.array(out_words, pa.list_(pa.int64())), "f": pa.array(out_counts, pa.int64())})

    schema = pa.schema([("part", pa.int64()), ("k", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
    return _texts(docs).mapInArrow(rows, _RUNS).groupBy("part").applyInArrow(merged, _PHRASES)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): stored tables (lang, word, id, f) of all words and (words, f) of all
    phrases up to `longest` words, single ones included, that occur `least` times."""
    seed = 0
    while True:
        words = stored(count_words(docs, seed), "collocation-words")
        named = F.struct("lang", "word")
        if words.groupBy("id").agg(F.min(named).alias("a"), F.max(named).alias("b")).where("a <> b").isEmpty():
            break
        seed += 1  # two words share an id: others are taken
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = 1 << max(0, (total // PART).bit_length())
    single = words.where(F.col("f") >= least).select(F.array("id").alias("words"), "f")
    known = bitmap(single)
    pairs = stored(count_phrases(docs, [2], seed, known, None, parts, least, limit), "collocation-pairs")
    found = single.unionByName(pairs)
    if longest > 2:
        lengths = list(range(3, longest + 1))
        longer = count_phrases(docs, lengths, seed, known, bitmap(pairs), parts, least, limit)
        found = found.unionByName(stored(longer, "collocation-longer"))
    return words, found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    Phrases are runs of two to `longest` words within a piece (texts are cut at
    . , ; : ! ? and line breaks) that occur `least` times or more; a null lang is "und". The
    score is that of the cut of least floor(1000 * a * n / (l * r)), ties to the earliest;
    phrases within a longer one that occurs as often are left out. All arithmetic is exact.
    Null and empty texts have no words; repeated rows count each; an empty table, or one
    without frequent phrases, gives no row. Other columns are ignored.
    """
    words, counted = frequent_phrases(docs, least, longest, limit)
    candidates = counted.where(F.size("words") > 1).select("words", F.col("f").alias("a"))
    names = words.where(F.col("f") >= least).select("id", "lang", "word")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n")).withColumnRenamed("lang", "of")
    spelt = (
        candidates.select("words", "a", F.posexplode("words").alias("place", "id")).join(names, "id")
        .groupBy("words", "a").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))).alias("spelt"))
        .select("words", "a", "lang", F.array_join(F.transform("spelt", lambda x: x["word"]), " ").alias("phrase"))
    )
    rows = spelt.join(totals, F.col("lang") == F.col("of")).drop("of")
    cuts = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("cut"))).withColumn(
        "right", F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut"))
    )
    sides = [counted.select(F.col("words").alias(w), F.col("f").alias(f)) for w, f in (("left", "l"), ("right", "r"))]
    cuts = cuts.join(sides[0], "left").join(sides[1], "right")
    wide = "decimal(19,0)"
    cuts = cuts.withColumn("score", F.expr(
        f"(cast(1000 * a AS {wide}) * cast(n AS {wide})) div (cast(l AS {wide}) * cast(r AS {wide}))"
    ))
    scored = cuts.groupBy("words", "a", "n", "lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("least")
    ).select("words", "a", "n", "lang", "phrase", "least.*")
    # All phrases of two words or more within a longer one.
    within = candidates.where(F.size("words") > 2).select(F.col("a").alias("longer"), F.explode(F.expr("""
        filter(flatten(transform(sequence(2, size(words) - 1), m ->
            transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m)))), x -> size(x) > 1)
    """)).alias("words")).groupBy("words").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    ranking = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top)
    return ranked.select(F.col("lang").cast("string").alias("lang"), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
counts AS (
  SELECT lang, p, count(*) AS f FROM (SELECT lang, list_slice(w, i, i + k - 1) AS p FROM places) GROUP BY lang, p HAVING count(*) >= 100
),
cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS cut FROM counts WHERE len(p) > 1
),
scored AS (
  SELECT c.lang, c.p, a, cut, x.f AS l, y.f AS r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, cut)
  JOIN counts y ON y.lang = c.lang AND y.p = list_slice(c.p, cut + 1, len(c.p))
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS place FROM scored),
inner_phrases AS (
  SELECT lang, list_slice(p, i, i + m - 1) AS p, max(a) AS longer FROM (
    SELECT lang, p, f AS a, m, unnest(range(1, len(p) - m + 2)) AS i FROM (
      SELECT lang, p, f, unnest(range(2, len(p))) AS m FROM counts WHERE len(p) > 2))
  GROUP BY ALL
),
kept AS (
  SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM lowest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.p = s.p
  WHERE place = 1 AND (longer IS NULL OR longer < a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= 2000
"""
