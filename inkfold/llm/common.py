"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.sources.scratch import stored as stash  # noqa: F401

#: The separators of words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (a null text is empty), whatever other columns docs has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_tag() -> Column:
    """Tells texts of rows with one id, or none, apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def identity(doc_id: Column, tag: Column) -> list[Column]:
    """no_id, id and tag: columns without nulls that tell rows apart by their ids and texts."""
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), tag.alias("tag")]


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string"))


def java_words(text: Column) -> Column:
    """The words of a text, in order; none for a text without any."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside hands Python so many rows at once: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """rows joined with groups (a row for each key; column n: how many rows have it). Keys that hold over one in `share`
    of the counted rows, so fewer than `share` of them at any size, are joined by broadcast: no task gets all rows of a
    common key. Both sides are read twice: give written tables."""
    counted = groups.agg(F.sum("n")).first()[0] or 0
    place = F.xxhash64(*keys)
    common_keys = [r[0] for r in groups.where(F.col("n") * share > counted).select(place).collect()]
    if not common_keys:
        return rows.join(groups, keys)
    few, rest = place.isin(common_keys), ~place.isin(common_keys)
    return rows.where(few).join(F.broadcast(groups.where(few)), keys).unionByName(rows.where(rest).join(groups.where(rest), keys))
