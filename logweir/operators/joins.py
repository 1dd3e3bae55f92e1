"""Joining a large table to a small one whose size is checked first."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 64


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """At most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def join_small(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
    spread: str = "seq", rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``big`` joined to ``small`` on equal keys without ever gathering one hot key in one task.

    Up to ``rows`` rows the small side is broadcast. Beyond that it is repeated once per salt and
    ``big`` is spread over the salts by hash of ``spread``, so a key holding a third of all rows
    still lands on many tasks.
    """
    if is_small(small, rows):
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread_rows = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return spread_rows.join(salted, [*keys, "_salt"], how).drop("_salt")
