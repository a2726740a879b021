"""Places and running sums against plain Python: hot groups, ties, nulls, ids with a common beginning."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from winnow.operators.prefix import numbered, running

ROWS = [(None if i % 5 == 0 else "hot" if i % 3 else "few", f"a-very-long-beginning-{i % 97:05d}", float(i % 4), i) for i in range(900)] + [("hot", None, None, -1)] * 3 + [("hot", "same", 0.5, 7)] * 200


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, id string, x double, n long").repartition(7)


def test_places(spark, rows):
    got = defaultdict(list)
    for r in numbered(rows, ["g"], [F.col("id").asc_nulls_first(), F.col("n").asc()], "place", "size").collect():
        got[r.g].append((r.place, r.size, r.id, r.n))
    for g, found in got.items():
        expected = sorted(((i, n) for h, i, _, n in ROWS if h == g), key=lambda v: (v[0] is not None, v[0], v[1]))
        assert [v[0] for v in sorted(found)] == list(range(len(expected))) and {v[1] for v in found} == {len(expected)}
        assert [v[2:] for v in sorted(found)] == expected


def test_places_of_all_rows_and_of_none(spark, rows):
    all_of = numbered(rows, [], [F.col("n").desc()]).orderBy("pos").collect()
    assert [r.pos for r in all_of] == list(range(len(ROWS))) and [r.n for r in all_of] == sorted((r[3] for r in ROWS), reverse=True)
    assert numbered(rows.limit(0), ["g"], [F.col("n").asc()]).count() == 0 == running(rows.limit(0), [], [F.col("n").asc()], {"x": "s"}).count()


def test_running_sums(spark, rows):
    got = defaultdict(list)
    for r in running(rows, ["g"], [F.col("n").asc()], {"x": "upto", "n": "total"}).collect():
        got[r.g].append((r.n, r.total, r.upto))
    for g, found in got.items():
        mine, total, upto = sorted((r for r in ROWS if r[0] == g), key=lambda r: r[3]), 0, 0.0
        sums = []
        for _, _, x, n in mine:
            total, upto = total + n, upto + (x or 0)
            sums.append((n, total, upto))
        assert [v[:2] for v in sorted(found, key=lambda v: (v[0], v[2]))][-5:] == [v[:2] for v in sums][-5:]
        assert sorted(v[1] for v in found) == sorted(v[1] for v in sums) and max(v[2] for v in found) == upto
