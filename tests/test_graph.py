"""Connected components against a plain search, and global ranks."""

import random

from pyspark.sql import functions as F

from quarry.operators.graph import connected_components
from quarry.plans.lineage import global_rank


def test_components(spark):
    rng = random.Random(9)
    for n, m in ((30, 20), (40, 60), (60, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(200, 230)] + [(None, 3), (7, 7), (500, 200)]
        near = {}
        for a, b in edges:
            if a is not None and b is not None and a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = {}
        for k in sorted(near):
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = k
                    todo += near[x]
        df = spark.createDataFrame(edges, "src long, dst long")
        assert {tuple(r) for r in connected_components(df).collect()} == set(want.items())
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [r["x"] for r in global_rank(df, [F.col("x")], "at").orderBy("at").collect()]
    assert got == sorted(got)
    assert global_rank(df.limit(0), [F.col("x")]).count() == 0
