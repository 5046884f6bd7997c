"""Byte profiles of samples: histograms, lanes, entropy, NUL density, chi-square.

The Arrow form keeps a sample's counts in one array row, so every statistic below is a
shuffle-free expression over it. The relational form does the same with explode and groupBy; it needs
no Python and serves as a cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrow import byte_histogram, lane_histogram


def with_byte_histogram(df: DataFrame, sample: Column, into: str = "histogram") -> DataFrame:
    return df.withColumn(into, byte_histogram(sample))


def with_lane_histogram(df: DataFrame, sample: Column, unit: int, into: str = "lanes") -> DataFrame:
    """Counts per (position mod 4, byte), leaving out an unfinished last code unit of ``unit`` bytes."""
    whole = F.substring(sample, F.lit(1), F.length(sample) - F.length(sample) % unit)
    return df.withColumn(into, lane_histogram(whole))


def unfold_histogram(df: DataFrame, keys: list[str], histogram: str = "histogram") -> DataFrame:
    """(keys, byte, n) for bytes that occur."""
    return df.select(*keys, F.posexplode(histogram).alias("byte", "n")).filter("n > 0")


def unfold_lanes(df: DataFrame, keys: list[str], lanes: str = "lanes") -> DataFrame:
    """(keys, lane, byte, n) for bytes that occur."""
    flat = df.select(*keys, F.posexplode(lanes).alias("slot", "n")).filter("n > 0")
    return flat.select(
        *keys, F.shiftright("slot", 8).alias("lane"), F.col("slot").bitwiseAND(255).alias("byte"), "n"
    )


def array_sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)


def entropy(histogram: Column) -> Column:
    """Shannon entropy in bits per byte; 0 for an empty sample."""
    total = array_sum(histogram)
    # sum(-p log2 p) = log2 N - sum(n log2 n) / N: the total is taken once, not once per bin
    spread = F.aggregate(
        histogram, F.lit(0.0), lambda a, n: a + F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)
    )
    return F.when(total > 0, F.log2(total.cast("double")) - spread / total).otherwise(0.0)


def channel(lanes: Column, odd: bool) -> Column:
    """256 counts of the even or odd positions, out of the 4 lanes."""
    first = 256 if odd else 0
    return F.zip_with(
        F.slice(lanes, first + 1, 256), F.slice(lanes, first + 513, 256), lambda a, b: a + b
    )


def chi_square(counts: Column) -> Column:
    """Chi-square against a uniform spread over all 256 values; NULL for an empty sample."""
    units = array_sum(counts)
    squares = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint") * n)
    return F.when(units > 0, squares / (units / F.lit(256.0)) - units)


def nul_density(counts: Column) -> Column:
    units = array_sum(counts)
    return F.when(units > 0, F.get(counts, F.lit(0)) / units)


def relational_bytes(df: DataFrame, sample: Column, keys: list[str]) -> DataFrame:
    """One row per byte: (keys, char) where ``char`` is the ISO-8859-1 character of the byte.

    Splitting a string is far cheaper than slicing a binary once per position, and the sample itself is not
    carried into the rows.
    """
    chars = df.select(*keys, F.explode(F.split(F.decode(sample, "ISO-8859-1"), "")).alias("char"))
    return chars.filter(F.col("char") != "")  # an empty sample splits into one empty string


def relational_histogram(df: DataFrame, sample: Column, keys: list[str]) -> DataFrame:
    """(keys, byte, n) without Python; partial aggregation leaves at most 256 rows per key to shuffle."""
    counted = relational_bytes(df, sample, keys).groupBy(*keys, "char").agg(F.count("*").alias("n"))
    return counted.select(*keys, F.ascii("char").alias("byte"), "n")


def relational_entropy(histogram: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    return histogram.groupBy(*keys).agg(
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy")
    )
