"""Parquet sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of ``sf_dir`` (one file or a folder of files), pruned to ``columns``.

    Columns may be nested paths (``"ticket.cleaned_text"``); they keep the last part as name.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that were delivered again, with the same key and all else equal but the time of arrival, count once.

    Rows whose key is null can't be told apart, so they are dropped. Prune the columns first:
    all that are left go through one hash exchange on the key, combined on the map side before it.
    """
    return df.dropna(subset=list(keys)).dropDuplicates(list(keys))
