"""Token counts of the sections of documents, from one encoding of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.encoder import numbered
from logloom.llm.text import whole_text

RULES = ("majority", "first", "last")
BATCH = 256
SCHEMA = (
    "doc_id bigint, section int, char_start bigint, char_end bigint,"
    " n_tokens bigint, n_crossing bigint, n_inside bigint"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("section", pa.int32()), ("char_start", pa.int64()),
    ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()),
    ("n_inside", pa.int64()),
])


def line_sections(text: str) -> np.ndarray:
    """Ends of the sections: every line with its line feed; an empty text is one section."""
    lines = text.split("\n")
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    ends[-1] -= 1
    return ends[:-1] if len(ends) > 1 and not lines[-1] else ends


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans to the sections that end at `bounds` (and tile the text).

    Returns each token's section and whether its span crosses a boundary. A crossing
    token goes to one section: with "first" that of its first character, with "last" that
    of its last, with "majority" that which has most of its characters, the earliest of
    those that tie. A token without characters belongs where it stands.
    """
    last_section = len(bounds) - 1
    first = np.minimum(np.searchsorted(bounds, starts, side="right"), last_section)
    last = np.minimum(np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right"), last_section)
    crossing = last > first
    to = last.copy() if rule == "last" else first.copy()
    if rule == "majority":
        for i in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[i]], bounds[first[i] : last[i]], [ends[i]]])
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    return to, crossing


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "majority", split=line_sections) -> DataFrame:
    """One row per section: its characters' span, tokens, crossing tokens and whole ones.

    `split` gives a text's section ends; sections tile the text, so counts add up to the
    tokens of the whole text. `n_crossing` counts the allocated tokens that also cover
    characters of another section. A null text is an empty one: one empty section without tokens. Repeated
    rows and ids give repeated results; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows. One document is in memory at a time (a batch
    of 256 texts as a stream of them), and nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = numbered(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                few = batch.slice(at, BATCH)
                texts = few.column("text").to_pylist()
                counts, sections = [], []
                for text, (first, after) in zip(texts, encoder.spans(texts)):
                    ends = split(text)
                    to, crossing = allocate(first, after, ends, rule)
                    m = len(ends)
                    n = np.bincount(to, minlength=m)
                    c = np.bincount(to[crossing], minlength=m)
                    sections.append(np.arange(m, dtype=np.int32))
                    counts.append(np.stack([np.concatenate([[0], ends[:-1]]), ends, n, c, n - c]))
                table = np.concatenate(counts, axis=1)
                ids = few.column("doc_id").take(
                    pa.array(np.repeat(np.arange(len(texts)), [len(s) for s in sections]))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.concatenate(sections)), *(pa.array(x.astype(np.int64)) for x in table)],
                    schema=_ARROW,
                )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")
    ).mapInArrow(rows, SCHEMA)
