"""Ordered dictionaries: code order equals string order, so ranges of strings are ranges of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ordinals import number_rows


def build(df: DataFrame, column: str, keep_empty: bool = True) -> DataFrame:
    """(str, code): the distinct non-null values of a column in order, coded from 0."""
    values = df.select(F.col(column).alias("str")).where(F.col("str").isNotNull()).distinct()
    return number_rows(values if keep_empty else values.where("str <> ''"), "str", name="code")


def merge(*dictionaries: DataFrame) -> DataFrame:
    """The dictionary of the union of the strings of several."""
    union = dictionaries[0].select("str")
    for d in dictionaries[1:]:
        union = union.union(d.select("str"))
    return build(union, "str")


def encode(df: DataFrame, column: str, dictionary: DataFrame, name: str = "code") -> DataFrame:
    """Adds the code of each value (absent: -1)."""
    d = dictionary.select(F.col("str").alias("_str"), F.col("code").alias("_code"))
    return df.join(d, df[column] == F.col("_str"), "left").withColumn(name, F.coalesce("_code", F.lit(-1)).cast("long")).drop("_str", "_code")


def decode(df: DataFrame, code: str, dictionary: DataFrame, name: str = "str") -> DataFrame:
    """Adds the string of each code (absent: '')."""
    d = dictionary.select(F.col("str").alias("_str"), F.col("code").alias("_code"))
    return df.join(d, df[code] == F.col("_code"), "left").withColumn(name, F.coalesce("_str", F.lit(""))).drop("_str", "_code")


def code_range(dictionary: DataFrame, low: str, high: str) -> DataFrame:
    """(lo, hi): the codes of the strings in [low, high]; lo > hi if there are none."""
    return dictionary.agg(F.count_if(F.col("str") < low).alias("lo"), (F.count_if(F.col("str") <= high) - 1).alias("hi"))


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_code, new_code) for the strings of a dictionary that another replaces."""
    return old.select("str", F.col("code").alias("old_code")).join(new.select("str", F.col("code").alias("new_code")), "str").select("old_code", "new_code")
