"""Line dedup by a log-template tree: templates that recur across documents are dropped.

The tree has a fixed depth: a line goes to a leaf by its number of tokens and its first
tokens, with tokens that hold a digit masked as fields. A leaf that too few lines reach is no
leaf: its lines go to the best filled of the wildcard leaves that take any token in the place
of one of the leading ones. Within a leaf a token is part of the template where enough lines
have it at that place, and a field, masked too, elsewhere. Lines of one template are one kind
of line, whatever their fields hold; a template without fields recurs as soon as two
documents have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.collocations import Bitmap, bitmap
from logloom.llm.text import stored

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Documents in which a template with fields must occur to be dropped. Lines (each counted once
#: in a document) that a leaf has, and that a token has at its place to be part of a template.
LEAST_DOCUMENTS = 20
#: Documents in which a line without fields must occur, word for word, to be dropped.
LEAST_COPIES = 2
#: Least share of a line's tokens that must be fixed; vaguer lines have no template.
LEAST_FIXED = 0.5
FIELD = "<*>"
_FIELD = FIELD.encode()
_DIGIT = re.compile(rb"[0-9]")
_LINES = "doc bigint, first boolean, fixed boolean, m1 bigint, m2 bigint, leaf bigint, wild array<bigint>, mask string"
_SIGNED = 1 << 63


def masked(line: bytes) -> bytes:
    """Tokens with a digit as fields, single blanks, none at the ends."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [_FIELD if _DIGIT.search(t) else t for t in tokens]
    return b" ".join(tokens)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGNED else x


def name_of(mask: bytes) -> tuple[int, int]:
    """128 bits that stand for a masked line, as two longs."""
    x = xxhash.xxh3_128_intdigest(mask)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def leaves_of(mask: bytes) -> tuple[int, list[int]]:
    """Names of the line's leaf, and of the wildcard leaves that leave out one leading token."""
    n = mask.count(b" ") + 1
    head = mask.split(b" ", DEPTH)[:DEPTH]
    own = xxhash.xxh3_64_intdigest(b"%d\0" % n + b"\0".join(head))
    wild = [
        _signed(xxhash.xxh3_64_intdigest(b"%d\1%d\0" % (n, i) + b"\0".join(head[:i] + head[i + 1 :])))
        for i in range(len(head) if n > 1 else 0)
    ]
    return _signed(own), wild


def _masks(text: bytes | None) -> dict[bytes, None]:
    """The distinct masked lines of a text that have any token."""
    found = dict.fromkeys(map(masked, set((text or b"").split(b"\n"))))
    found.pop(b"", None)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """`doc` names a document: rows of the same doc_id and text are one."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    return keyed.withColumn("text", F.col("text").cast("binary"))


def _lines(keyed: DataFrame) -> DataFrame:
    """A row per document and distinct masked line; `first` marks one row of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                few = batch.slice(at, 1000)
                found = [list(_masks(x.as_py())) for x in few.column("text")]
                masks = [m for own in found for m in own]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                docs = np.repeat(few.column("doc").to_numpy(), sizes)
                first = np.zeros(len(masks), bool)
                first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
                fixed = [_FIELD not in m or _FIELD not in m.split(b" ") for m in masks]
                names = [name_of(m) for m in masks]
                leaves = [leaves_of(m) for m in masks]
                longs = [pa.array([x[k] for x in y], pa.int64()) for y, k in ((names, 0), (names, 1), (leaves, 0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs), pa.array(first), pa.array(fixed, pa.bool_()), *longs,
                     pa.array([x[1] for x in leaves], pa.list_(pa.int64())), pa.array(masks, pa.binary()).cast(pa.string())],
                    names=["doc", "first", "fixed", "m1", "m2", "leaf", "wild", "mask"],
                )

    lines = stored(keyed.select("doc", "text").mapInArrow(rows, _LINES), "lines")
    # Documents that are repeated as whole rows: rare, so only their lines are made distinct.
    twice = lines.where("first").groupBy("doc").agg(F.count("*").alias("__n")).where("__n > 1").select("doc")
    twice = stored(twice, "repeated")
    if twice.isEmpty():
        return lines
    again = _with(lines, twice, ["doc"]).dropDuplicates(["doc", "m1", "m2"])
    return _without(lines, twice, ["doc"]).unionByName(stored(again, "distinct"))


def _by_bitmap(rows: DataFrame, known, columns: list[str], within: bool) -> DataFrame:
    """The rows whose `columns` have their bit in the broadcast bitmap, or those that don't."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Bitmap(known.value)
        for batch in batches:
            found = near(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in columns], axis=1))
            yield batch.filter(pa.array(found if within else ~found))

    return rows.mapInArrow(kept, rows.schema)


def _with(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """rows.join(names, columns, "left_semi"), for which only rows are shuffled that a bitmap lets through."""
    known = bitmap(names.select(F.array(*columns).alias("words")))
    return _by_bitmap(rows, known, columns, True).join(names, columns, "left_semi").select(*rows.columns)


def _without(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """The same with "left_anti"."""
    known = bitmap(names.select(F.array(*columns).alias("words")))
    near = _by_bitmap(rows, known, columns, True).join(names, columns, "left_anti").select(*rows.columns)
    return _by_bitmap(rows, known, columns, False).unionByName(near)


_NAME = ["m1", "m2"]


def _counted(lines: DataFrame, least_documents: int) -> DataFrame:
    """(leaf, m1, m2, n, mask): the masked lines of the leaves, with their documents."""
    # On hashes alone, with partial counts first: no leaf is gathered. Texts are not shuffled but
    # for those of the leaves, which are few.
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_documents).select("leaf")
    leaves = stored(leaves, "leaves")
    own = _with(lines.select("leaf", *_NAME), leaves, ["leaf"]).groupBy("leaf", *_NAME).agg(F.count("*").alias("n"))
    rare = _without(lines.select("leaf", *_NAME, "wild"), leaves, ["leaf"])
    rare = rare.select(*_NAME, F.posexplode("wild").alias("__i", "leaf"))
    wild = rare.groupBy("leaf").agg(F.count("*").alias("__s")).where(F.col("__s") >= least_documents)
    wild = stored(wild, "wild-leaves")
    # A line is in one of its wildcard leaves as often as in the others.
    reached = _with(rare, wild.select("leaf"), ["leaf"]).groupBy("leaf", "__i", *_NAME).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("leaf", "n"), F.struct("__s", -F.col("__i"))).alias("__b")
    chosen = reached.join(wild, "leaf").groupBy(*_NAME).agg(best).select("__b.leaf", *_NAME, "__b.n")
    counted = stored(own.unionByName(chosen), "counted")
    masks = _with(lines.select(*_NAME, "mask"), counted.select(*_NAME), _NAME).groupBy(*_NAME).agg(F.first("mask").alias("mask"))
    return stored(counted.join(masks, _NAME).select("leaf", *_NAME, "n", "mask"), "masks")


def _templates(docs: DataFrame, least_documents: int, least_copies: int, least_fixed: float) -> tuple[DataFrame, DataFrame]:
    """(lines, (m1, m2, template, n_documents) of the masked lines to drop)."""
    lines = _lines(_keyed(docs))
    counted = _counted(lines, least_documents)
    tokens = counted.select("leaf", *_NAME, "n", F.posexplode(F.split("mask", " ")).alias("place", "token"))
    support = tokens.groupBy("leaf", "place", "token").agg(F.sum("n").alias("__s"))
    fixed = (F.col("__s") >= least_documents) & (F.col("token") != FIELD)
    marked = tokens.join(support, ["leaf", "place", "token"]).select(
        *_NAME, "n", "place", F.when(fixed, F.col("token")).otherwise(FIELD).alias("token")
    )
    shaped = marked.groupBy(*_NAME).agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("__t"),
        F.avg((F.col("token") != FIELD).cast("double")).alias("__fixed"),
        F.first("n").alias("n"),
    ).where(F.col("__fixed") >= least_fixed)
    shaped = shaped.select(*_NAME, "n", F.array_join(F.col("__t.token"), " ").alias("template"))
    # A document may have several lines of a template, so it is documents that are counted;
    # as many lines are there at least.
    likely = shaped.groupBy("template").agg(F.sum("n").alias("__n")).where(F.col("__n") >= least_documents).select("template")
    shaped = stored(shaped.join(likely, "template"), "shaped")
    found = _with(lines.select("doc", *_NAME), shaped.select(*_NAME), _NAME)
    found = found.join(shaped, _NAME).select("template", "doc").distinct()
    often = found.groupBy("template").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= least_documents)
    general = shaped.join(often, "template").select(*_NAME, "template", "n_documents")
    copies = lines.where("fixed").groupBy(*_NAME).agg(F.count("*").alias("n_documents"), F.first("mask").alias("template"))
    copies = copies.where(F.col("n_documents") >= least_copies).select(*_NAME, "template", "n_documents")
    return lines, general.unionByName(copies)


def templates(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_copies: int = LEAST_COPIES, least_fixed: float = LEAST_FIXED
) -> DataFrame:
    """(template, n_documents): the templates with lines in enough documents to be dropped.

    Leaves with few lines are left before any token is looked at, and equal masked lines
    count once with the documents that have them, so the tokens of a line that all
    documents share are split once.
    """
    _, found = _templates(docs, least_documents, least_copies, least_fixed)
    return found.groupBy("template").agg(F.max("n_documents").alias("n_documents"))


def drop_templates(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_copies: int = LEAST_COPIES, least_fixed: float = LEAST_FIXED
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Lines of a recurring template are dropped, all of them, so documents that are copies of
    one another lose all lines; the others are kept as they are, joined by line feeds. Blank
    lines have no template and stay. A null text is an empty one: a single blank line. Rows of
    the same doc_id and text count as one document; a null doc_id stays null. Other columns
    are ignored; empty in, empty out. Lines are told apart by 128 bits of hash.
    """
    lines, found = _templates(docs, least_documents, least_copies, least_fixed)
    dropped = stored(found.select(*_NAME).distinct(), "dropped")
    # At most as many as the document has lines.
    gone = _with(lines.select("doc", *_NAME), dropped, _NAME).groupBy("doc").agg(F.collect_list(F.struct(*_NAME)).alias("gone"))
    rows = _keyed(docs).join(gone, "doc", "left").select("doc_id", "text", F.col("gone.m1").alias("g1"), F.col("gone.m2").alias("g2"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, drops, texts = [], [], []
            columns = [batch.column(c) for c in ("text", "g1", "g2")]
            for text, g1, g2 in zip(*columns):
                whole = text.as_py()
                own = whole.split(b"\n")
                rest = own
                if g1.is_valid:
                    names = set(zip(g1.as_py(), g2.as_py()))
                    rest = [x for x in own if not (m := masked(x)) or name_of(m) not in names]
                sizes.append(len(own))
                drops.append(len(own) - len(rest))
                texts.append(whole if rest is own else b"\n".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(drops, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(kept, f"doc_id {kind}, n_lines bigint, n_dropped int, kept_text string").withColumn(
        "n_dropped", F.col("n_dropped").cast("bigint")
    )


#: drop_templates over the table `documents` with the defaults above.
DROP_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
docs AS (SELECT DISTINCT doc_id, text FROM rows),
numbered AS (SELECT row_number() OVER () AS doc, doc_id, text FROM docs),
split AS (SELECT doc, unnest(string_split(text, chr(10))) AS line FROM numbered),
masks AS (
  SELECT DISTINCT doc, line, trim(regexp_replace(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '{FIELD}', 'g'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS mask FROM split),
lines AS (
  SELECT DISTINCT doc, mask, len(string_split(mask, ' ')) AS n, string_split(mask, ' ')[1:{DEPTH}] AS head
  FROM masks WHERE mask <> ''),
leaves AS (SELECT n, head FROM lines GROUP BY n, head HAVING count(*) >= {LEAST_DOCUMENTS}),
rare AS (SELECT l.* FROM lines l ANTI JOIN leaves e ON l.n = e.n AND l.head = e.head),
wild AS (
  SELECT doc, mask, n, i, list_concat(head[1:i - 1], head[i + 1:]) AS rest
  FROM (SELECT *, unnest(range(1, len(head) + 1)) AS i FROM rare WHERE n > 1)),
wild_leaves AS (SELECT n, i, rest, count(*) AS s FROM wild GROUP BY n, i, rest HAVING count(*) >= {LEAST_DOCUMENTS}),
chosen AS (
  SELECT mask, n, i, rest FROM (
    SELECT *, row_number() OVER (PARTITION BY mask ORDER BY s DESC, i) AS r
    FROM (SELECT DISTINCT mask, n, i, rest FROM wild) JOIN wild_leaves USING (n, i, rest))
  WHERE r = 1),
own AS (
  SELECT l.doc, l.mask, l.n, 0 AS i, l.head FROM lines l SEMI JOIN leaves e ON l.n = e.n AND l.head = e.head
  UNION ALL SELECT l.doc, l.mask, c.n, c.i, c.rest FROM lines l JOIN chosen c USING (mask)),
counted AS (SELECT n, i, head, mask, count(*) AS docs FROM own GROUP BY ALL),
tokens AS (
  SELECT n, i, head, mask, docs, unnest(string_split(mask, ' ')) AS token, generate_subscripts(string_split(mask, ' '), 1) AS place FROM counted),
support AS (SELECT n, i, head, place, token, sum(docs) AS s FROM tokens GROUP BY ALL),
marked AS (
  SELECT mask, place, CASE WHEN s >= {LEAST_DOCUMENTS} THEN token ELSE '{FIELD}' END AS token
  FROM tokens JOIN support USING (n, i, head, place, token)),
shaped AS (
  SELECT mask, string_agg(token, ' ' ORDER BY place) AS template FROM marked GROUP BY mask
  HAVING avg(CASE WHEN token <> '{FIELD}' THEN 1.0 ELSE 0.0 END) >= {LEAST_FIXED}),
often AS (
  SELECT template FROM own JOIN shaped USING (mask) GROUP BY template HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}),
gone AS (
  SELECT mask FROM shaped SEMI JOIN often USING (template)
  UNION SELECT mask FROM lines WHERE NOT list_contains(string_split(mask, ' '), '{FIELD}')
  GROUP BY mask HAVING count(DISTINCT doc) >= {LEAST_COPIES}),
dropped AS (SELECT DISTINCT line FROM masks SEMI JOIN gone USING (mask)),
parts AS (
  SELECT n.doc, n.doc_id, u.line, u.place FROM numbered n,
    LATERAL (SELECT unnest(string_split(n.text, chr(10))) AS line, generate_subscripts(string_split(n.text, chr(10)), 1) AS place) u)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(d.line) AS n_dropped,
  coalesce(string_agg(p.line, chr(10) ORDER BY p.place) FILTER (d.line IS NULL), '') AS kept_text
FROM parts p LEFT JOIN dropped d ON p.line = d.line GROUP BY p.doc
"""
