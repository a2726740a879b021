"""Resampling against plain Python: nulls, repeated rows, ties of scores, few pivots."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import prose
from winnow.llm import resampling
from winnow.llm.resampling import gains, kth_key, op11_resampling, resampled

ROWS = [(i, prose(i % 50, 10 + i % 40)) for i in range(300)] + [(300, None), (301, ""), (302, "Wörter, ZWEI 2-2 ÉÉ\x00x"), (303, prose(9, 20_000)), (None, prose(3, 40))] + [(7, prose(7, 30))] * 25
TARGET = [(1, prose(5, 300)), (2, None), (3, "")]


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(rows, target):
    s, t = (Counter(b for _, x in of for b in features(x)[1]) for of in (rows, target))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (wanted + 10_000))))
    out = []
    for i, text in rows:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    best = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    best = best[: 25 * len(best) // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(best)] + [(*r[:4], None) for r in (Counter(out) - Counter(best)).elements()])


@pytest.mark.parametrize("pivots", [1, 2, 24])
def test_op11_is_the_plain_version(spark, tmp_path, monkeypatch, pivots):
    monkeypatch.setattr(resampling.kth_key, "__defaults__", (pivots, resampling.SEED))
    spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"Score": F.lit("x"), "rank": F.lit(1), "row": F.lit(2)}).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TARGET, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op11_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(ROWS, TARGET)


def test_kth_key_with_ties_and_nulls(spark):
    keys = [(i % 3, None if i % 4 == 0 else i % 7, i % 2, i) for i in range(120)]
    df = spark.createDataFrame(keys, "low long, doc_id long, text_key long, row long").repartition(5)
    expected = sorted(keys, key=lambda r: tuple((x is not None, x or 0) for x in r))
    for k in (1, 2, 60, 119, 120):
        assert kth_key(df, k, pivots=3) == expected[k - 1]
    assert kth_key(df, 0) is kth_key(df, 121) is kth_key(df.limit(0), 1) is None


def test_no_rows_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, prose(1, 30)), (2, "a")], "doc_id long, text string")
    assert resampled(none, some).count() == 0 and set(gains([0] * 4, [0] * 4)) == {0}
    assert {(r.doc_id, r["rank"]) for r in resampled(some, none, percent=100).collect()} == {(1, 1), (2, None)}
