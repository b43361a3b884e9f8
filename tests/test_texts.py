from pyspark.sql import functions as F

from routeloom.operators import learned, multiclass, outcomes, simulated, texts
from routeloom.operators.texts import once_per_text, spread
from routeloom.plans import inputs


def test_equal_texts_are_worked_on_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(x, y):
        calls.add(1)
        return len(x or "") + 10 * len(y or "")

    rows = [(i, *[("ab", "c"), (None, "c"), ("ab", None), ("ab", "c")][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, q string, own_q string").coalesce(1)
    got = once_per_text(df, ["q", "own_q"], lambda x: x.withColumn("n", length("q", "own_q")))
    assert got.columns == ["id", "q", "own_q", "n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(*r, len(r[1] or "") + 10 * len(r[2] or "")) for r in rows]
    assert calls.value == 3


def test_spread_uses_all_cores(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_out_of_fold_uses_all_cores(spark):
    one = spark.range(300).selectExpr("id", "id % 7 AS x", "cast(id % 3 = 0 AS int) AS y").coalesce(1)
    got = learned.out_of_fold(one, "logistic", "id", ["x"], "y")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert got.count() == 300


def test_partitions_of_candidates_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "LINES", 100, raising=False)
    n = 4000
    spark.range(n).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "cast(id % 9 AS double) AS l_quantity", "id AS l_suppkey", "id AS l_partkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    wide = outcomes.pivot_outcomes(inputs.candidates(spark, str(tmp_path)), "prompt_id", ["a0", "a1", "a2", "a3"])
    assert wide.rdd.getNumPartitions() > n // 100
    assert wide.where("cost_a0 is not null and cost_a3 is not null").count() == n // 4


def test_instances_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(texts, "ROWS", 100, raising=False)
    t = spark.range(4000).selectExpr("id div 20 AS i", "id AS q", "30 AS budget", "array(0.1D, 0.3D, 0.4D) AS curve")
    for levels in (simulated.equal_levels(t, "i", "q", [0, 1, 2]), simulated.knapsack_levels(t, "i", "q", [0, 1, 2])):
        assert levels.rdd.getNumPartitions() > 4000 // 100
        assert levels.where("level >= 0").count() == 4000
    with monkeypatch.context() as m:
        m.setattr(texts, "ROWS", 100_000)
        assert simulated.equal_levels(t, "i", "q", [0, 1, 2]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_levels_meet_curves_without_a_broadcast(spark):
    t = spark.range(400).selectExpr("id div 20 AS i", "id AS q", "array(0.1D, 0.3D, 0.4D) AS curve")
    runs = simulated.budget_sweep(t, "i", "q", [0, 1, 2], [10, 30])
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert runs.count() == 20 * 2 * 2


def test_rows_of_many_actions_are_made_once(spark):
    rows = spark.range(600).groupBy(F.col("id").alias("k")).agg(F.max(F.col("id") % 7).alias("x"), F.max((F.col("id") % 3).cast("string")).alias("y"))
    got = multiclass.out_of_fold(rows, "tree", "k", ["x"], "y")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert got.count() == 600
