"""The registered queries of the operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    collocations, decontaminate, fingerprint, lexical_search, licenses, line_templates, mixing, near_dedup, substrings, token_counts,
    token_files, toxicity, vector_search,
)
from logloom.llm.text import importable, table
from logloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages, as digests of the kept words."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids, and what the files say of each."""
    root = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), root, tokenizer_path())
    return token_files.document_digests(spark, root)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the labelled ones that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the square root of the sources' sizes."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their half-edited texts."""
    return fingerprint.edit_fingerprints(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates."""
    return line_templates.drop_templates(table(spark, sf_dir, "documents"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth embedding among all."""
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every test item among all."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


_ALL = [
    op1_token_counts,
    op2_decontamination,
    op3_substring_dedup,
    op4_token_files,
    op5_toxicity,
    op6_mix_sources,
    op7_near_duplicates,
    op8_fingerprints,
    op9_line_dedup,
    op10_licenses,
    op11_nearest_vectors,
    op12_lexical_search,
    op13_collocations,
]


def queries() -> dict[str, Query]:
    def ready(query: Query) -> Query:
        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return query(spark, sf_dir)

        return run

    return {q.__name__: ready(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mix_sources": mixing.REPLICATE_SQL,
        "op9_line_dedup": line_templates.DROP_SQL,
        "op11_nearest_vectors": vector_search.NEAREST_SQL,
        "op12_lexical_search": lexical_search.SEARCH_SQL,
        "op13_collocations": collocations.COLLOCATIONS_SQL,
    }
