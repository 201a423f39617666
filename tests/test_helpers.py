"""Small helpers: catalogue checks, routing, dimension inlining, quantiles, sinks."""

from pyspark.sql import functions as F

from labelforge.operators import dims as D
from labelforge.operators import prepare as P
from labelforge.operators import prompts as PR
from labelforge.schema import LABELS, label_dim


def test_placeholder_check_and_routing(spark):
    cat = spark.createDataFrame([(0, "a", "{report}"), (1, "b", "{report} {y_i}"), (2, "c", "{reprot}")],
                                "ord int, prompt_id string, template string")
    bad = [r["prompt_id"] for r in PR.check_placeholders(cat).collect()]
    assert bad == ["c"]
    groups = {r["prompt_id"]: r["grp"] for r in PR.route_groups(cat, 2).collect()}
    assert groups == {"a": "before", "b": "before", "c": "after"}


def test_attach_gives_every_combination_without_a_cross_join(spark):
    big = spark.range(500).withColumnRenamed("id", "rid")
    dim = label_dim(spark)
    out = D.attach(big, dim)
    assert sorted((r["rid"], r["label"]) for r in out.collect()) == sorted((i, lab) for i in range(500) for lab in LABELS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert D.attach(big, spark.range(2000).withColumnRenamed("id", "d")).count() == 1_000_000


def test_expand_keeps_types_and_nulls(spark):
    cat = spark.createDataFrame([(0, "a", None)], "ord int, prompt_id string, template string")
    out = PR.expand(spark.range(2), cat)
    assert out.schema["ord"].dataType.simpleString() == "int"
    assert [r["template"] for r in out.collect()] == [None, None]


def test_length_quantiles_and_audit(spark):
    df = spark.createDataFrame([(" ".join(["w"] * n),) for n in range(1, 101)], "text string")
    q = P.length_quantiles(df, qs=(0.5, 0.9)).first()["quantiles"]
    assert q == [50, 90]
    a = P.length_audit(df, max_words=90).first()
    assert (a["n_rows"], a["n_over_limit"], a["max_words"], a["min_words"]) == (100, 10, 100, 1)


def test_label_dim_order(spark):
    assert [r["label"] for r in label_dim(spark).orderBy("ord").collect()] == LABELS


def test_length_grouped_sorts_within_partitions(spark):
    df = spark.createDataFrame([(i, "x" * ((i * 37) % 50)) for i in range(200)], "id int, text string").repartition(4)
    out = P.length_grouped(df, "text")
    parts = out.select(F.spark_partition_id().alias("p"), F.length("text").alias("n")).collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r["p"], []).append(r["n"])
    assert all(v == sorted(v) for v in by_part.values()) and sum(map(len, by_part.values())) == 200


def test_oracle_count_rewrite_handles_nesting():
    from labelforge.plans.catalog import bigint_counts

    sql = "SELECT count_if(a = (1)), round(count_if(coalesce(b, false)) / count(*), 9) FROM t"
    assert bigint_counts(sql) == ("SELECT count(*) FILTER (WHERE a = (1)), "
                                  "round(count(*) FILTER (WHERE coalesce(b, false)) / count(*), 9) FROM t")
