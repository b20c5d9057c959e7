import random

from pyspark.sql import functions as F

from switchboard.operators import ordered as O


def test_halo_gives_every_row_its_predecessors(spark):
    rng = random.Random(5)
    data = [("a", s) for s in rng.sample(range(200), 90)] + [("b", s) for s in range(5)]
    df = spark.createDataFrame(data, "k string, s int").withColumn("v", F.col("s"))
    for n in (1, 4, 9):
        rows = O.with_halo(O.cut(df, "s", 8), ["k"], ["s"], n, ["v"])
        w = O.window(["k"], ["s"]).rowsBetween(-n, -1)
        got = {(r["k"], r["s"]): r["before"] for r in rows.withColumn("before", F.collect_list("v").over(w)).where(~F.col(O.HALO)).collect()}
        for k in ("a", "b"):
            ordered = sorted(s for kk, s in data if kk == k)
            for i, s in enumerate(ordered):
                assert got[k, s] == ordered[max(0, i - n):i]


def test_carry_sums_earlier_blocks(spark):
    df = O.cut(spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("s")), "s", 7)
    blocks = df.groupBy("k", O.BLOCK).agg(F.sum("s").alias("part"))
    before = blocks.select("k", O.BLOCK, F.sum("part").over(O.earlier_blocks(["k"])).alias("before"))
    for r in df.join(before, ["k", O.BLOCK]).collect():
        first = r["s"] // 7 * 7
        assert r["before"] == (sum(range(first)) if first else None)


def test_probe(spark):
    assert not O.has_long_keys(spark.range(10).withColumnRenamed("id", "s"), "s", 10)
    assert O.has_long_keys(spark.range(11).withColumnRenamed("id", "s"), "s", 10)
