"""Bloom filters as columns: Catalyst's own aggregate and membership expressions.

The session must be a classic (not a remote) one; ``available`` tells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Bits of one filter, the most that Spark's aggregate makes by default (8 MiB), and the most filters that are
#: broadcast together. Keys are dealt to the filters by hash.
MAX_BITS, MAX_FILTERS = 1 << 26, 8
#: Bits a key that a filter is made for, and those below which it would let so much through that it is left out.
BITS_PER_KEY, LEAST_BITS_PER_KEY = 12, 3


def available(spark: SparkSession) -> bool:
    return hasattr(spark, "_jvm") and spark._jvm is not None


def _column(spark: SparkSession, expression) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _expression(spark: SparkSession, column: Column):
    return spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)


def filters_for(keys: int) -> int:
    """How many filters these keys need; 0 if they are too many for MAX_FILTERS.

    With 12 bits a key about 1 key in 300 passes wrongly, with 6 bits 1 in 18, with 3 bits 1 in 4.
    """
    if keys * LEAST_BITS_PER_KEY > MAX_BITS * MAX_FILTERS:
        return 0
    return max(1, min(MAX_FILTERS, math.ceil(keys * BITS_PER_KEY / MAX_BITS)))


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 40), F.lit(n))


def bloom_of(df: DataFrame, key: Column, keys: int) -> list[DataFrame] | None:
    """Filters of the 64-bit ``key`` over all rows of ``df``, with ``keys`` of them at most: one frame of one row and one column ``bloom`` each,
    null of no rows. None if there are too many keys. Partial filters are merged on the executors, and the result is written to scratch.
    """
    spark, n = df.sparkSession, filters_for(keys)
    if not n:
        return None
    each = max(1, math.ceil(keys / n))
    bits = max(1024, min(MAX_BITS, 1 << math.ceil(math.log2(each * BITS_PER_KEY))))
    items = max(1, min(each, bits // LEAST_BITS_PER_KEY))
    hashed = df.select(key.alias("h"))
    plan = spark._jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(
        _expression(spark, F.col("h")), _expression(spark, F.lit(items).cast("long")), _expression(spark, F.lit(bits).cast("long"))
    )
    made = hashed.groupBy(_bucket(F.col("h"), n).alias("bucket")) if n > 1 else hashed
    stored = Scratch(spark, "bloom").save(made.agg(_column(spark, plan.toAggregateExpression()).alias("bloom")))[0]
    return [stored.where(F.col("bucket") == i).select("bloom") for i in range(n)] if n > 1 else [stored]


def might_contain(blooms: list[DataFrame], key: Column) -> Column:
    """Whether ``key`` may be among the filters' keys; false is certain.

    A filter reaches the tasks as a scalar subquery's value. As a literal it would be spelt out in every
    description of the plan.
    """
    spark, out = blooms[0].sparkSession, F.lit(False)
    for i, bloom in enumerate(blooms):
        found = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(_expression(spark, bloom.scalar()), _expression(spark, key))
        here = F.coalesce(_column(spark, found), F.lit(False))
        out = here if len(blooms) == 1 else F.when(_bucket(key, len(blooms)) == i, here).otherwise(out)
    return out
