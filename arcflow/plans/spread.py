"""Joins of many rows with one row for each key, where a key may hold a large share of the rows.

Adaptive execution splits a hot partition of a join only if both its inputs come straight
from a shuffle, and only beyond a size. So hot keys are named by their counts, and both
sides are dealt by key and salt: a hot key has a salt for each even partition's share of
its rows, and its one row on the other side is repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_limit(rows: DataFrame, total: int) -> int:
    """Keys with more rows than half an even partition's share are hot: fewer than twice the number of partitions."""
    return max(1, total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def salts_of(hot: dict, limit: int, key: str) -> Column:
    """Number of salts of each row's key: a power of two that leaves a salt about `limit` rows, 1 if the key isn't among the hot."""
    tiers: dict[int, list] = {}
    for value, n in hot.items():
        tiers.setdefault(1 << (-(-n // limit) - 1).bit_length(), []).append(value)
    out = F.lit(1)
    for salts, values in sorted(tiers.items()):
        # A list of some length becomes a set beside the generated code, which so stays the same from round to round.
        more = [f"~{k}" if isinstance(values[0], str) else ~k for k in range(12)]  # not hot, perhaps; both sides salt them alike
        out = F.when(F.col(key).isin(values + more), salts).otherwise(out)
    return out


def hot_keys(single: DataFrame, key: str, count: str, total: int, most: int) -> tuple[dict, int]:
    """Hot keys and their counts, and the limit above which a key is hot; one job more only if there are any."""
    limit, hot = hot_limit(single, total), {}
    if most > limit:
        for r in single.where(F.col(count) > limit).select(key, count).collect():
            hot[r[0]] = max(r[1], hot.get(r[0], 0))
    return hot, limit


def join_salted(rows: DataFrame, single: DataFrame, keys: list[str], salts: Column, spread: list[str]) -> DataFrame:
    """Inner join in which a key's rows are dealt by `spread`, columns of `rows`, over as many salts as `salts` says of the key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
    repeated = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def join_counted(rows: DataFrame, single: DataFrame, keys: list[str], count: str, spread: list[str]) -> DataFrame:
    """Inner join of `rows` with `single`, in which each key is once and `count` is the number of its `rows`.

    Rows of a hot key are dealt by `spread`, columns of `rows`. Hot keys are named by their first column;
    fewer than 2 * partitions go to the driver. `single` is read several times, so it should be written or cheap.
    """
    sizes = single.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    hot, limit = hot_keys(single, keys[0], count, sizes["total"] or 0, sizes["most"] or 0)
    return join_salted(rows, single, keys, salts_of(hot, limit, keys[0]), spread) if hot else rows.join(single, keys)
