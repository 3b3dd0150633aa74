"""Joins of rows with one row for each key, where a key may hold a third of all rows.

Adaptive execution cannot split such a join: the side of one row for each key
is the output of an aggregate, not of a shuffle of its own. Here the keys that
hold more than one row in ``HOT_SHARE`` (there are fewer than that many, so
their list may be broadcast) are spread over ``SALTS`` tasks; their single rows
are repeated for each. The task of a row follows from its columns, so that a
repeated task sends every row where it went before.

Defined cases: null keys meet nothing; keys without a partner are dropped; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one of so many rows; an upper bound of the number of hot keys.
HOT_SHARE = 1000
#: Tasks that a hot key is spread over.
SALTS = 64


def joined_unique(rows: DataFrame, unique: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` on ``key``; ``unique`` has one row for each key and the number of its rows in ``weight``."""
    keys = [key] if isinstance(key, str) else key
    total = unique.agg(F.sum(weight).alias("_total"))
    marked = unique.join(F.broadcast(total), F.lit(True)).withColumn("_hot", F.col(weight) * HOT_SHARE > F.col("_total")).drop("_total")
    hot = marked.where("_hot").select(*keys, F.lit(SALTS).alias("_salts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS))).otherwise(0).cast("int")).drop("_salts")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(marked.withColumn("_salt", F.explode(copies)).drop("_hot"), [*keys, "_salt"]).drop("_salt")
