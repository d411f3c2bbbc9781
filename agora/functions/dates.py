"""Dates: epoch detection and period buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequency codes as truncation units.
UNITS = {"D": "day", "W": "week", "M": "month", "MS": "month", "ME": "month", "Q": "quarter", "Y": "year", "A": "year"}
MILLISECONDS_FROM = 1e11


def detect(df: DataFrame, column: str, group: str | None = None, out: str = "created_dt") -> DataFrame:
    """``out``: the column as timestamps. If over half of all rows (of a group) are numbers, they are epochs, in
    milliseconds if their median is over 1e11; otherwise texts are parsed, and what can't be is null."""
    number = F.expr(f"try_cast(`{column}` AS double)")
    key = F.col(group) if group else F.lit("")
    numeric = F.avg(F.when(number.isNotNull(), 1.0).otherwise(0.0))
    facts = df.groupBy(key.alias("_g")).agg(numeric.alias("_share"), F.percentile_approx(number, 0.5, 10_000).alias("_median"))
    d = df.join(facts, key.eqNullSafe(F.col("_g")), "left").drop("_g")
    seconds = F.when(F.col("_median") > MILLISECONDS_FROM, number / 1000).otherwise(number)
    epoch = F.timestamp_micros((seconds * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    parsed = F.expr(f"try_to_timestamp(CAST(`{column}` AS string))").cast("timestamp_ntz")
    return d.withColumn(out, F.when(F.col("_share") > 0.5, epoch).otherwise(parsed)).drop("_share", "_median")


def period(ts: Column, freq: str = "M") -> Column:
    return F.date_trunc(UNITS[freq], ts).cast("timestamp_ntz")
