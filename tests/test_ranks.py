import random
from itertools import groupby

from stylespark.operators.ranks import running


def test_running_sums_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), None if k % 50 == 0 and k else k, rng.randrange(9)) for k in range(400)]
    rows = list({(g, x): (g, x, n) for g, x, n in rows}.values())
    df = spark.createDataFrame(rows, "g string, x long, n long")
    got = {(r.g, r.x): r.before for r in running(df, ["g"], ["x"], {"before": "n"}, parts=7).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    want = {}
    for _, group in groupby(order, key=lambda r: r[0]):
        total = 0
        for g, x, n in group:
            want[g, x] = total
            total += n
    assert got == want


def test_one_group_spreads_over_all_tasks(spark):
    df = spark.range(20_000).selectExpr("id AS x", "1 AS one", "'odd' AS _part_")
    got = running(df, [], ["x"], {"place": "one"}, parts=5)
    assert got.columns == ["x", "one", "_part_", "place"]
    assert got.where("place <> x").count() == 0
    assert running(df.where("false"), [], ["x"], {"place": "one"}).count() == 0
