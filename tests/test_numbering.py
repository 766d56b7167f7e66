"""Numbers inside groups, one of which holds most of the rows."""
import random
from collections import defaultdict

from patronage.operators.numbering import numbered


def test_numbers_in_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 18 + ["a", None]), rng.randint(0, 40), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, day int, id long").repartition(6)
    want, seen = {}, defaultdict(int)
    for g, day, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        seen[g] += 1
        want[i] = seen[g]
    assert {r.id: r.n for r in numbered(df, ["g"], ["day", "id"], "n").collect()} == want
    whole = {r.id: r.n for r in numbered(df, [], ["day", "id"], "n").collect()}
    assert whole == {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: r[1:]))}
    assert numbered(df.limit(0), ["g"], ["day", "id"], "n").collect() == []
