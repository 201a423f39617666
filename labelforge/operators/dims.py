"""Every row of a large table combined with every row of a dimension (prompt
catalogue, label list), as one plan for any size of the dimension.

Each row of the dimension is copied under a number of key values and each row of
the table gets one of them by hash, so the combination is an equi-join: Spark
broadcasts a side whose size it knows to be small, and otherwise shuffles both
by a key that no single row of the dimension makes hot. The number of keys
follows from the sizes that Catalyst estimates for both sides; nothing is read
while the plan is built."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the table that meet one copy of the dimension, at most.
SHARE_BYTES = 64 << 20
#: Keys for each shuffle partition, so that hashed keys leave none empty; and the
#: most keys a plan asks for.
KEYS_A_PARTITION = 8
MOST_KEYS = 1 << 20
UNKNOWN = 1 << 60


def estimated_bytes(df: DataFrame) -> int:
    """What Catalyst expects ``df`` to hold (files' sizes, local rows); no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def copies(table_bytes: int, dim_bytes: int, partitions: int) -> int:
    """Copies of the dimension: enough to fill every partition and to leave each
    key ``SHARE_BYTES`` of the table at most; beyond a copy for each partition
    no more than move as many bytes as the table itself. Catalyst gives sides it
    knows nothing of a size beyond any real one; such a dimension counts as small."""
    wanted = max(KEYS_A_PARTITION * partitions, ceil(table_bytes / SHARE_BYTES))
    free = table_bytes // max(1, dim_bytes) if dim_bytes < UNKNOWN else wanted
    return max(1, partitions, min(wanted, free, MOST_KEYS))


def attach(df: DataFrame, dim: DataFrame, keys: int | None = None) -> DataFrame:
    """Every row of ``df`` combined with every row of ``dim``."""
    if keys is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = copies(estimated_bytes(df), estimated_bytes(dim), partitions)
    hashed = [c for c, f in zip(df.columns, df.schema.fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    copied = dim.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))))
    return df.withColumn("__copy", F.pmod(F.xxhash64(*hashed), F.lit(keys))).join(copied, "__copy").drop("__copy")
