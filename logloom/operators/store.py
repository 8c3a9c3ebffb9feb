"""The report store: cells (table, row key, family, qualifier, part, value) in parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.ranking import distributed_rank
from logloom.schema import CELL_COLUMNS, CELL_SCHEMA, FAMILY
from logloom.session import scratch_path
from logloom.sources.files import delete

# A table of unlimited length is stored in parts of this many rows, in order, so that
# no cell grows with the data and part 0 is the head of the table.
PART_ROWS = 1000


def row_key(date: Column) -> Column:
    return F.concat(F.lit("date="), date)


def _cells(table: str, qualifier: Column, part: Column, value: Column) -> list[Column]:
    return [
        F.lit(table).alias("table"),
        row_key(F.col("date")).alias("row_key"),
        F.lit(FAMILY).alias("family"),
        qualifier.alias("qualifier"),
        part.cast("int").alias("part"),
        value.alias("value"),
    ]


def scalar_cells(kpis: DataFrame, table: str, names: Sequence[str]) -> DataFrame:
    """One cell per day and figure, the value as text; a null figure has no cell."""
    texts = kpis.select("date", *[F.col(n).cast("string").alias(n) for n in names])
    return (
        texts.unpivot(["date"], list(names), "qualifier", "text")
        .where(F.col("text").isNotNull())
        .select(*_cells(table, F.col("qualifier"), F.lit(0), F.col("text")))
    )


def table_cells(
    rows: DataFrame,
    table: str,
    fields: Sequence[str],
    keys: Sequence[str],
    *,
    count_as_text: bool = True,
    unlimited: bool = False,
) -> DataFrame:
    """One cell per day and `qualifier`: its rows as a JSON array, by count desc and key.

    Fields are text, the count too unless `count_as_text` is off; null fields are
    left out, and so are rows without a count (see empty_tables()). With `unlimited`, a
    table of any length is cut by rank: part 0 has its rows 1 to PART_ROWS, part 1 the next
    PART_ROWS, and so on.
    """
    has_row = F.col("count").isNotNull()
    part = F.lit(0)
    if unlimited:
        rank = [F.col("count").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in keys]]
        rows = distributed_rank(rows, ["date", "qualifier"], rank)
        # A placeholder ranks behind all rows; it makes no part of its own.
        part = F.when(has_row, F.floor((F.col("rank") - 1) / PART_ROWS)).otherwise(0)
    packed = F.struct(
        *[
            F.col(f) if f == "count" and not count_as_text else F.col(f).cast("string").alias(f)
            for f in fields
        ]
    )
    order = [(-F.col("count")).alias("_by"), *[F.col(c).alias(f"_{c}") for c in keys]]
    arrays = rows.groupBy("date", "qualifier", part.alias("part")).agg(
        F.array_sort(
            F.collect_list(F.when(has_row, F.struct(*order, packed.alias("row"))))
        ).alias("rows")
    )
    value = F.to_json(F.transform("rows", lambda r: r["row"]))
    return arrays.select(*_cells(table, F.col("qualifier"), F.col("part"), value))


def empty_tables(days: DataFrame, qualifiers: Sequence[str]) -> DataFrame:
    """Placeholders (date, qualifier): a table without rows still gets its cell, `[]`."""
    return days.select("date", F.explode(F.array(*map(F.lit, qualifiers))).alias("qualifier"))


def marker_cells(days: DataFrame, table: str, qualifier: str) -> DataFrame:
    """The cell that says a day is done."""
    return days.select("date").select(*_cells(table, F.lit(qualifier), F.lit(0), F.lit("1")))


def write_cells(cells: DataFrame, root: str, *, mode: str = "replace_rows") -> None:
    """`replace_rows` swaps whole rows of the store in one job; `append` adds cells to them."""
    writer = (
        cells.select(*CELL_COLUMNS)
        .hint("rebalance", F.col("table"), F.col("row_key"))
        .write.partitionBy("table", "row_key")
    )
    if mode == "append":
        writer.mode("append").parquet(root)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """All cells; a filter on table and row_key reads just those directories."""
    schema = T.StructType([f for f in CELL_SCHEMA if f.name not in ("table", "row_key")])
    schema = schema.add("table", T.StringType()).add("row_key", T.StringType())
    return spark.read.schema(schema).parquet(root).select(*CELL_COLUMNS)


def head(cells: DataFrame, table: str, rows: int, *, reverse: bool = False) -> DataFrame:
    """Cells of the first (or last) rows of a table by row key."""
    own = cells.where(F.col("table") == table)
    key = F.col("row_key").desc() if reverse else F.col("row_key").asc()
    first = own.select("row_key").distinct().orderBy(key).limit(rows)
    return own.join(first, "row_key", "left_semi").select(*cells.columns)


def get_rows(cells: DataFrame, table: str, *row_keys: str) -> DataFrame:
    """Cells of the named rows of a table; a missing row yields nothing."""
    return cells.where((F.col("table") == table) & F.col("row_key").isin(*row_keys))


def get_rows_in(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Cells of the rows whose (table, row_key) is listed in another table."""
    address = ["table", "row_key"]
    return cells.join(keys.select(*address), address, "left_semi").select(*cells.columns)


def put_cells(puts: DataFrame, root: str, sequence: str | None = None) -> None:
    """Upsert cells into the store: a put replaces the value of its address or adds the cell.

    Only the rows touched are read, folded and swapped; their other cells stay. Of puts to
    the same address the last one counts: the greatest in column `sequence`, or without one
    the last in the order of the rows of `puts`; puts of one sequence go by their value. The
    store keeps no versions. The folded rows are written aside first, so a job that dies
    leaves each row as it was or as it shall be.
    """
    spark = puts.sparkSession
    address = [c for c in CELL_COLUMNS if c != "value"]
    at = F.col(sequence) if sequence else F.monotonically_increasing_id()
    numbered = puts.select(*CELL_COLUMNS, at.alias("_at"))
    new = numbered.groupBy(*address).agg(F.max(F.struct("_at", "value"))["value"].alias("value"))
    touched = get_rows_in(read_cells(spark, root), new.select("table", "row_key").distinct())
    kept = touched.join(new.select(*address), address, "left_anti")
    aside = scratch_path(spark, "puts")
    kept.select(*CELL_COLUMNS).unionByName(new.select(*CELL_COLUMNS)).write.parquet(aside)
    write_cells(spark.read.parquet(aside), root)


def split_conflicts(
    puts: DataFrame, families: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, DataFrame]:
    """(valid, conflicting): a put to a family its table does not declare is a conflict."""
    declared = F.lit(False)
    for table, names in families.items():
        declared |= (F.col("table") == table) & F.col("family").isin(*names)
    return puts.where(declared), puts.where(~declared)


def nested_rows(cells: DataFrame, page: int = 0) -> DataFrame:
    """One record per row: its key, then families, then (column, value) in byte order of the column.

    A column's value is one page of it: page 0 is the whole of every figure and short
    table, and the first PART_ROWS rows of a long one, so that a record stays small however
    long a table is. Rows without a column of that page are left out.
    """
    own = cells.where(F.col("part") == page)
    families = own.groupBy("table", "row_key", "family").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("qualifier").alias("column"), F.col("value")))
        ).alias("columnValues")
    )
    return families.groupBy("table", F.col("row_key").alias("rowKey")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("family").alias("familyName"), "columnValues"))
        ).alias("columnFamilies")
    )


def drop_rows(spark: SparkSession, root: str, table: str, row_keys: Sequence[str]) -> None:
    """Delete whole rows of a table."""
    for key in row_keys:
        delete(spark, f"{root}/table={table}/row_key={key.replace('=', '%3D')}")
