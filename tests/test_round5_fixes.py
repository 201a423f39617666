"""Python workers hold few prompts at a time, however many a task has."""

import pandas as pd
from pyspark.sql import functions as F

from labelforge.operators import inference as INF


def test_scorers_get_bounded_bytes(spark):
    def sizes():  # tells how many characters came with each prompt's batch
        return lambda p: pd.Series([str(int(p.str.len().fillna(0).sum()))] * len(p), index=p.index)

    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), 10_000)).alias("prompt"))
    got = [int(r["response"]) for r in INF.batch_inference(df, sizes, keys=["id"]).collect()]
    assert len(got) == 3000 and max(got) <= 5 << 20
    # one prompt beyond the bound comes, whole
    long = df.withColumn("prompt", F.when(F.col("id") == 5, F.repeat(F.lit("y"), 6 << 20)).otherwise(F.col("prompt")))
    got = {r["id"]: int(r["response"]) for r in INF.batch_inference(long, sizes, keys=["id"]).collect()}
    assert len(got) == 3000 and got[5] >= 6 << 20
