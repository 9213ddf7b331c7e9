"""Lookups whose key may be held by a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
#: Rows of a few numbers and short names that are broadcast at most: some 10 MB in memory.
BROADCAST_ROWS = 100_000


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, rows: int, salts: int = 16, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has at most a few narrow rows for each key, and ``rows`` in all.

    ``rows`` is counted or bounded by the caller. Up to BROADCAST_ROWS the small side is broadcast.
    Beyond, it is repeated ``salts`` times and ``big`` is spread over the salts by ``spread`` (a
    column that varies within a key), so a hot key is shared by ``salts`` tasks of a sort-merge
    join; that is asked for by a hint, as Spark's estimate knows nothing of the repetition.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    left = big.withColumn(SALT, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, SALT], how).drop(SALT)
