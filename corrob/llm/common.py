"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrob.session import working_table

#: What separates words: the space and the five ASCII control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Its rows are then fixed: no later step computes them again, and a lost
    executor costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = working_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the corpus: joined by a shuffle, whatever its size.

    Spark judges a written table by the size of its files.  Pairs of numbers
    that take less than the 10 MB of a broadcast there take half a gigabyte of
    the driver's memory.
    """
    return df.hint("merge")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def text_or_empty(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column], F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters between blanks."""
    return F.array_remove(F.split(text, BLANK_RUN, -1), "")


def count_of(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))
