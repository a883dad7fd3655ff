"""Gram postings: an optional side table that finds substrings by equi-joins.

Worth it where one catalog answers many rare-substring queries from storage that is
bucketed by gram; a plain scan answers the same and is what ``search`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int = 3) -> Column:
    """The distinct byte substrings of length ``n``, as hex."""
    size = F.octet_length(text)
    raw = F.encode(text, "UTF-8")
    every = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.hex(F.substring(raw, i, F.lit(n))))
    return F.when(size >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, column: str = "normalized_name", key: str = "path", n: int = 3) -> DataFrame:
    """(gram, key), each once."""
    return df.select(F.explode(grams(F.col(column), n)).alias("gram"), key)


def candidates(posts: DataFrame, token: str, key: str = "path", n: int = 3) -> DataFrame:
    """Keys that have all grams of a token: a superset of those that contain it."""
    raw = token.encode()
    wanted = sorted({raw[i : i + n].hex().upper() for i in range(len(raw) - n + 1)})
    if not wanted:
        return posts.select(key).distinct()
    return posts.where(F.col("gram").isin(wanted)).groupBy(key).agg(F.countDistinct("gram").alias("_n")).where(F.col("_n") == len(wanted)).select(key)


def containing(df: DataFrame, posts: DataFrame, token: str, column: str = "normalized_name", key: str = "path", n: int = 3) -> DataFrame:
    """Rows that contain a token: postings first, the text itself decides."""
    return df.join(candidates(posts, token, key, n), key, "left_semi").where(F.col(column).contains(token))


def write(posts: DataFrame, path: str) -> None:
    """Sorted by gram, so that Parquet's statistics skip most row groups."""
    posts.repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)
