"""Readers, writers, ingest, splits, joins, intervals and certification against plain Python, with nulls, ties and small tables."""

import datetime
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions import text as T
from winnow.operators import bootstrap, certify, ingest, metrics, sampling, simjoin
from winnow.operators.scorers import KmerScreener, LinearScreener, score_grid
from winnow.sources import files
from winnow.streaming.scoring import score_stream


def test_fasta(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">id1 change A->B\nab\ncd\n>id2>x\r\nef\r\n\n>id3\n>id4 last\ngh")
    got = {r.header: r.text for r in files.read_fasta(spark, str(tmp_path / "in.fasta")).collect()}
    assert got == {"id1 change A->B": "abcd", "id2>x": "ef", "id3": "", "id4 last": "gh"}
    df = spark.createDataFrame([("a", "xyz", "t", None), ("b", None, "u", "v")], "id string, text string, tag string, more string")
    files.write_fasta(df, str(tmp_path / "out"), "id", "text", ["tag", "more"])
    assert {(r.header, r.text) for r in files.read_fasta(spark, str(tmp_path / "out")).collect()} == {("a|t|", "xyz"), ("b|u|v", "")}
    assert files.read_fasta(spark, str(tmp_path / "out")).where("false").count() == 0


def test_csv_json_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a,b"), (2, float("nan"), None)], "id long, x double, t string")
    files.write_csv(df, str(tmp_path / "csv"), drop=["t"])
    assert Counter(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == Counter([("1", "0.5"), ("2", "NaN")])
    files.write_json(df, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": 1, "x": 0.5, "t": "a,b"}, {"id": 2}]
    (tmp_path / "h.json").write_text(json.dumps({"loss": [3.0, 2.0], "area": [0.5, None]}))
    assert [tuple(r) for r in files.read_history(spark, str(tmp_path / "h.json"), ["loss", "area"]).collect()] == [(0, 3.0, 0.5), (1, 2.0, None)]
    vectors = spark.createDataFrame([(1, [1.0, 2.0], [[1.0], [2.0]])], "id long, embedding array<float>, states array<array<float>>")
    for c in ("embedding", "states"):
        files.write_vectors(vectors.select("id", c), str(tmp_path / c))
        again = files.read_or_empty(spark, str(tmp_path / c), vectors.select("id", c).schema)
        assert again.collect() == vectors.select("id", c).collect()
    assert files.read_or_empty(spark, str(tmp_path / "nowhere"), df.schema).collect() == []
    row = spark.createDataFrame([("m", 0.12346, 3, 0.1, 0.2, True), ("n", 1.0, None, None, 0.2, True)], "m string, x double, k int, lo double, hi double, ok boolean")
    assert [r.line for r in files.latex_rows(row, ["m", "x", "k"]).collect()] == [r"m & 0.1235 & 3 \\", r"n & 1.0000 &  \\"]
    assert [r[0] for r in row.select(files.interval_text("lo", "hi", "ok")).collect()] == ["[0.1000, 0.2000]", "[N/A]"]


def test_positives_are_appended_only_if_new(spark):
    train = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    extra = spark.createDataFrame([(3, "z")], "id long, more string")
    assert Counter((r.id, r.y, r.more) for r in files.append_positives(train, extra).collect()) == Counter([(1, 0, None), (2, 1, None), (3, 1, "z")])
    with pytest.raises(ValueError, match="both tables"):
        files.append_positives(train, spark.createDataFrame([(2,)], "id long")).collect()
    held = spark.createDataFrame([(3,), (None,)], "id long")
    with pytest.raises(ValueError, match="held-out"):
        files.append_positives(train, extra, held_out=held).collect()
    assert files.append_positives(train, extra, held_out=held.where("id is null")).count() == 3


def test_ingest(spark, tmp_path):
    body = lambda n: {"value": "x" * n, "length": n}
    entries = [
        {"id": "a", "body": body(50), "xrefs": [{"database": "Terms", "id": "t", "props": None}, {"database": "Families", "id": "f"}], "comments": [{"type": "FUNCTION", "texts": []}, {"type": "FUNCTION", "texts": [{"value": "one"}]}]},
        {"id": "b", "name": "B", "organism": {"name": "O"}, "body": body(49)},
        {"id": "c", "body": {"value": "y" * 51}},
        {"id": "d", "body": {"value": ""}},
        {"body": body(60)},
    ]
    (tmp_path / "e.json").write_text("\n".join([*map(json.dumps, entries), "{broken"]))
    got = {r.id: r for r in ingest.parse_entries(ingest.read_entries(spark, str(tmp_path / "e.json"))).collect()}
    assert got.keys() == {"a", "b", "c"} and got["a"].name == "a" and got["a"].organism == "Unknown" and got["a"].terms == ["t:"] and got["a"].family_ids == ["f"]
    assert got["a"].description == "one" and got["c"].length == 51 and got["b"].name == "B" and got["b"].description == "" and got["b"].family_ids == []
    flat = spark.createDataFrame([(1, "k", 49), (2, "k", 50), (3, "k", 2000), (4, None, 60), (5, "m", 2001)], "n int, key string, length int")
    assert {r.n for r in ingest.first_wins(ingest.within_length(flat), "key", ["n"]).collect()} == {2, 4}
    assert {r.n for r in ingest.capped(flat, "key", ["n"], 2).collect()} == {1, 2, 4, 5}
    assert [r.is_hard_negative for r in ingest.with_hard_flag(flat, "key", ["k"]).orderBy("n").collect()] == [True, True, True, False, False]


def split_table(spark, pos, hard, easy, divergent=0):
    rows = [(i, 1, False, "s") for i in range(pos + divergent)] + [(1000 + i, 0, True, "s") for i in range(hard)] + [(2000 + i, 0, None, "s") for i in range(easy)]
    sims = spark.createDataFrame([(i, 0.9) for i in range(pos)], "id long, max_sim double")
    return spark.createDataFrame(rows, "id long, y int, hard boolean, kind string"), sims


def test_splits(spark):
    df, sims = split_table(spark, 40, 20, 40, divergent=3)
    of = {}
    for r in sampling.create_splits(df, sims, "id", "y", "hard", "kind").collect():
        of.setdefault(r.split, []).append(r.id)
    n = {k: Counter(i // 1000 for i in v) for k, v in of.items()}
    assert all(len(v) == len(set(v)) for v in of.values())
    assert n["train"] == {0: 24, 1: 7, 2: 24} and n["val"] == {0: 6, 1: 3, 2: 6}
    assert n["test_standard"] == {0: 10, 1: 3, 2: 10} and n["test_hard_negative"] == {0: 10, 1: 10} and n["test_seq_divergent"] == {0: 3, 1: 3, 2: 3}
    assert {i for i in of["test_seq_divergent"] if i < 1000} == {40, 41, 42} and set(of["test_hard_negative"]) & set(range(1000)) == set(of["test_standard"]) & set(range(1000))
    assert not set(of["train"]) & set(of["test_standard"]) and not set(of["train"]) & set(of["val"])


def test_few_rows(spark):
    df, sims = split_table(spark, 4, 5, 3)
    with pytest.raises(ValueError, match="ten positives"):
        sampling.create_splits(df, sims, "id", "y", "hard")
    of = {}
    for r in sampling.create_splits(df, sims, "id", "y", "hard", small="reuse").collect():
        of.setdefault(r.split, set()).add(r.id)
    assert {0, 1, 2, 3} <= of["train"] and {0, 1, 2, 3} <= of["val"] and {0, 1, 2, 3} <= of["test_standard"] and {2000, 2001, 2002} <= of["train"]
    assert len([i for i in of["train"] if 1000 <= i < 2000]) == 2 and len([i for i in of["val"] if i >= 1000]) == 2 and len([i for i in of["test_hard_negative"] if i >= 1000]) == 1


def test_folds_with_and_without_test_negatives(spark):
    df = spark.createDataFrame([(i, int(i < 8), "ab"[i % 2] if i < 8 else "c") for i in range(40)] + [(99, 1, "few")], "id long, y int, g string")
    apart = Counter((r.fold, r.id) for r in sampling.leave_one_group_out(df, "id", "y", "g", negatives=10).collect())
    assert {f for f, _ in apart} == {"a", "b"} and set(apart.values()) == {1}
    both = Counter((r.fold, r.id) for r in sampling.leave_one_group_out(df, "id", "y", "g", negatives=10, exclude_test_negatives=False).collect())
    assert sorted(both.values())[-20:] == [2] * 20


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "id")
    assert sampling.fraction(df, "id", 0.255).count() == 26 and sampling.fraction(df.limit(0), "id", 0.5).count() == 0
    assert [r.id for r in sampling.shuffled(df, "id").collect()] != list(range(100)) and sampling.subsample(df, "id", 7).count() == 7
    assert sampling.class_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int"), "y").where("y = 1").first().weight == 2.0


def test_character_groups():
    assert T.character_groups({"x": "ab", "y": "c"}) == {"a": "x", "b": "x", "c": "y"}
    with pytest.raises(ValueError, match="groups"):
        T.character_groups({"x": "ab", "y": "b"})


def test_pairs_that_share_an_item(spark):
    rng = np.random.default_rng(1)
    sets = [(i, [f"x{j}" for j in rng.integers(0, 12, 6)]) for i in range(30)] + [(30, None), (31, [])]
    df = spark.createDataFrame(sets, "id long, items array<string>")
    pairs = {(r.id_a, r.id_b): r.sim for r in simjoin.pairwise_jaccard(df, "id", "items").collect()}
    plain = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert all(a < b for a, b in pairs) and pairs == pytest.approx({(i, j): plain(a, b) for i, a in sets for j, b in sets if i < j and a and b and set(a) & set(b)})


def test_nearest_both_ways_with_nulls_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(40, rows[3][1]), (41, [0.0] * 4), (42, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    known = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if x]
    unit = {i: x / (np.linalg.norm(x) or 1) for i, x in known}
    expected = {i: [j for _, j in sorted((-round(float(unit[i] @ unit[j]), 12), j) for j in unit if j != i)[:3]] for i in unit}
    for most in (8_000_000, 10):
        monkeypatch.setattr(simjoin, "COMPONENTS", most)
        got = {}
        for r in simjoin.nearest(df, df, 3, exclude_self=True, rows=9).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.ref)
        assert got == expected
    none = df.limit(0)
    assert simjoin.nearest(df, none, 3).count() == 0 == simjoin.nearest(none, df, 3).count()
    assert {r.score for r in simjoin.cosine_topk_mean(df, none).collect()} == {0.0} and simjoin.cosine_topk_mean(df, df).count() == 43
    with pytest.raises(KeyError):
        simjoin.aligned(df, spark.createDataFrame([(77, 1)], "id long, y int"))


def test_metrics_of_one_class_and_missing_scores(spark):
    rows = [("s", "m", i, 1, 0.5) for i in range(3)] + [("t", "m", i, i % 2, x) for i, x in enumerate([0.1, 0.9, float("nan"), None, 0.1])]
    df = spark.createDataFrame(rows, "split string, method string, id long, y int, score double")
    got = {r.split: r for r in metrics.metric_rows(df).collect()}
    assert (got["s"].auroc, got["s"].auprc, got["s"].fpr_at_95_recall, got["s"].f1_optimal, got["s"].n_samples) == (0, 0, 1, 0, 3)
    assert got["t"].n_samples == 3 and got["t"].auroc == 1.0
    ci = {r.split: r for r in bootstrap.metric_rows_with_intervals(df, 30).collect()}
    assert ci["s"].auroc_lo is None and ci["t"].auroc_lo is not None


def test_lower_bounds():
    assert certify.lower_bound(0, 10) == 0 and abs(certify.lower_bound(10, 10) - 0.001 ** (1 / 10)) < 1e-9
    n, k, a = 30, 21, 0.05
    p = certify.lower_bound(k, n, a)
    assert abs(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1)) - a) < 1e-9


def test_substitutions_stay_within_their_kind():
    rng = np.random.default_rng(0)
    text, group_of = "abcabc, xyz", {"a": "v", "b": "v", "x": "w", "y": "w"}
    for kind in ("none", "grouped", "random"):
        for t in certify._Substitutes(text, kind, group_of).drawn(200, 3, rng):
            assert len(t) == len(text) and sum(x != y for x, y in zip(t, text, strict=True)) <= 3
            if kind == "none":
                assert t == text
            if kind == "grouped":
                assert all(x == y or group_of.get(x) == group_of.get(y) is not None for x, y in zip(t, text, strict=True))
    assert certify._Substitutes("", "random", {}).drawn(2, 3, rng) == ["", ""]


def test_certificates(spark):
    items = spark.createDataFrame([(1, "e" * 40, 1), (2, "b" * 40, 0), (3, None, 0)], "id long, text string, y int")
    counted = certify.votes(items, certify.word_share_scorer("e"), {"vowels": "aeiou"}, ["none", "random"], [2], 40)
    assert counted.columns == ["id", "y", "kind", "n_changes", "first_n", "first_votes", "n", "votes"]
    got = {(r.id, r.kind): r for r in certify.certificates(counted).collect()}
    assert got[1, "none"].predicted_class == 1 and got[1, "none"].certified and got[2, "none"].predicted_class == 0 and got[1, "none"].n_samples_certify == 30
    assert abs(got[1, "none"].p_lower - 0.001 ** (1 / 30)) < 1e-9
    grid = certify.certification_grid(items, certify.word_share_scorer("e"), {}, ["random", "none"], [2, 1], 40).collect()
    assert [(r.kind, r.n_changes) for r in grid] == [("none", 1), ("none", 2), ("random", 1), ("random", 2)] and all(r.gap == r.accuracy - r.certified_accuracy for r in grid)


def test_screeners(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abcdefgh", [1.0, 0.0], 1), (2, "abcdefgx", [0.9, 0.1], 1), (3, "zzzzzzz", [0.0, 1.0], 0), (4, None, [0.1, 1.0], 0)], "id long, text string, embedding array<float>, y int")
    k = {r.id: r.score for r in KmerScreener().fit(rows).transform(rows).collect()}
    assert k[1] == k[2] == 1.0 and k[3] == k[4] == 0.0
    fitted = LinearScreener().fit(rows)
    fitted.save(str(tmp_path / "m"))
    a, b = ({r.id: r.score for r in m.transform(rows).collect()} for m in (fitted, LinearScreener.load(str(tmp_path / "m"))))
    assert a == b and a[1] > 0.5 > a[3]
    grid = score_grid({"linear": fitted, "kmer": KmerScreener().fit(rows)}, {"all": rows, "one": rows.where("id = 1")})
    assert Counter((r.split, r.method) for r in grid.collect()) == {("all", "linear"): 4, ("all", "kmer"): 4, ("one", "linear"): 1, ("one", "kmer"): 1}


def test_scoring_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 0), (3, [0.9, 0.2], 1)], "id long, embedding array<float>, y int")
    rows.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    started = score_stream(arriving, LinearScreener().fit(rows), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    started.awaitTermination()
    got = {r.id: r.flagged for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_bins_and_labels(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.7, 0.69, 0.2, 0.1, 0.05, -0.1)], "x double")
    lo, hi = metrics.similarity_bin(F.col("x"), (1.0, 0.7, 0.5, 0.3, 0.2, 0.1))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(1.0, 1.01), (0.7, 1.0), (0.5, 0.7), (0.2, 0.3), (0.1, 0.2), (0.0, 0.1), (0.0, 0.1)]
    top = df.limit(1).select(T.top_positions(F.expr("array(0.1, 0.5, cast(null as double), 0.5)"), 3)).first()[0]
    assert [(x.pos, x.weight) for x in top][:2] in ([(1, 0.5), (3, 0.5)], [(2, None), (1, 0.5)])


def test_dates_are_utc(spark):
    assert spark.sql("select timestamp'2020-01-01'").first()[0] == datetime.datetime(2020, 1, 1)
