"""The best reference of each set, held by tasks and by prefix joins, against brute force: hot items, copies, equal ids, nulls."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from winnow.operators import simjoin


def jaccard(a, b):
    a, b = set(a or ()) - {None}, set(b or ()) - {None}
    return len(a & b) / len(a | b) if a and b else 0.0


def plain(queries, references, exclude_self):
    return Counter((i, round(max([jaccard(a, b) for j, b in references if not (exclude_self and i == j)], default=0.0), 9)) for i, a in queries)


def sets(seed, n, first=0):
    """Sets with an item that all have, some that a third have, a crowd of copies and one of near copies."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        items = ["all"] + ["third"] * (i % 3 == 0) + [f"r{x}" for x in rng.zipf(1.4, rng.integers(1, 25)) % 400]
        if i % 4 == 1:
            items = ["all", "copy", "of", "one"]
        if i % 5 == 2:
            items = [f"near{k}" for k in range(20) if k != i % 20] + ["all"]
        out.append((first + i, items))
    return out


ODD = [(9001, None), (9002, []), (9003, ["only mine"]), (9004, ["all"]), (9005, ["all", None]), (None, ["third", "r1"]), (9006, ["all", "all", "r2"])]


@pytest.mark.parametrize("most", [2_000_000, 10])
@pytest.mark.parametrize("rounds", [simjoin.ROUNDS, ()])
def test_best_of_peers_and_of_others(spark, monkeypatch, most, rounds):
    monkeypatch.setattr(simjoin, "POSTINGS", most)
    monkeypatch.setattr(simjoin, "ROUNDS", rounds)
    peers, others = sets(1, 90) + ODD + [(5, ["r1", "r2", "r3"])], sets(2, 40, 60) + ODD[:6]
    frame = lambda rows: spark.createDataFrame(rows, "id long, items array<string>").repartition(3)
    found = lambda df: Counter((r.id, round(r.max_sim, 9)) for r in df.collect())
    one = frame(peers)
    known = [p for p in peers if p[0] is not None]
    assert found(simjoin.peer_max(frame(known), "id", "items")) == plain(known, known, True)
    assert found(simjoin.max_jaccard(one, frame(others), "id", "id", "items", "items")) == plain(peers, others, False)
    assert found(simjoin.max_jaccard(one, one.limit(0), "id", "id", "items", "items")) == Counter((i, 0.0) for i, _ in peers)
    assert simjoin.peer_max(one.limit(0), "id", "items").count() == 0


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_substrings_of_texts(spark, monkeypatch, most):
    monkeypatch.setattr(simjoin, "POSTINGS", most)
    rng = np.random.default_rng(3)
    texts = [(i, "".join(rng.choice([*"abcdé\n"], rng.integers(0, 30)))) for i in range(60)] + [(60, None), (61, "ab"), (62, "abcabcabcabc")]
    of = lambda t: {t[i : i + 3] for i in range(len(t or "") - 2)}
    df = spark.createDataFrame(texts, "id long, text string")
    got = Counter((r.id, round(r.max_sim, 9)) for r in simjoin.max_kmer_jaccard(df.where("id % 2 = 0"), df, "id", "id", k=3, exclude_self=True).collect())
    every = [(i, of(t)) for i, t in texts]
    assert got == plain([x for x in every if x[0] % 2 == 0], every, True)


@pytest.mark.parametrize("items", [8_000_000, 60])
def test_blocks_hold_a_bounded_number_of_items(spark, monkeypatch, items):
    """Beyond the bound no task is given more of the references than a block, and pairs are those of brute force, hot items or not."""
    monkeypatch.setattr(simjoin, "POSTINGS", 10)
    monkeypatch.setattr(simjoin, "BLOCK_ITEMS", items)
    most, whole = spark.sparkContext.accumulator(0), simjoin._Block

    def block(sizes, flat):
        most.add(int(len(flat) > 4 * items))
        return whole(sizes, flat)

    monkeypatch.setattr(simjoin, "_Block", block)
    rows = [r for r in sets(4, 90) if r[0] is not None]
    df = spark.createDataFrame(rows, "id long, items array<string>")
    got = Counter((r.id, round(r.max_sim, 9)) for r in simjoin.peer_max(df, "id", "items").collect())
    assert got == plain(rows, rows, True) and most.value == 0
    pairs = {(r.id_a, r.id_b): round(r.sim, 9) for r in simjoin.pairwise_jaccard(df, "id", "items").collect()}
    assert pairs == {(i, j): round(jaccard(a, b), 9) for i, a in rows for j, b in rows if i < j and jaccard(a, b) > 0}


def test_texts_that_joins_drop_are_not_cut_into_sets(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "POSTINGS", 10)
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cut.add(1)
        return text.split()

    texts = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3}") for i in range(400)], "id long, text string")
    asked = texts.join(spark.createDataFrame([(i,) for i in range(10)], "id long").hint("merge"), "id")
    assert simjoin.peer_max(asked, "id", words("text")).count() == 10
    assert cut.value <= 40


@pytest.mark.parametrize("most", [1_000_000, 700])
def test_places_that_sets_are_met_at_are_counted_piece_by_piece(monkeypatch, most):
    """Sets that share nearly all of their items, which aren't columns of the matrix, meet in far more places than there are pairs of sets."""
    monkeypatch.setattr(simjoin, "HOT_ITEMS", 5)
    monkeypatch.setattr(simjoin, "MET_PAIRS", most)
    rng = np.random.default_rng(7)
    n, width = (120, 1000) if most > 1000 else (40, 60)
    has = rng.random((n, width)) < 0.9
    sizes, flat = has.sum(1).astype(np.int32), np.nonzero(has)[1]
    block = simjoin._Block(sizes, flat)
    turns = [*block.turns(sizes)]
    assert [a for a, _ in turns] == [0, *(b for _, b in turns[:-1])] and turns[-1][1] == n
    assert all(b - a <= block.at_once and (b - a == 1 or sizes[a:b].sum() <= most) for a, b in turns)
    tracemalloc.start()
    got = block.common(sizes, flat)  # all at once: 11.6 million places of 120 x 120 pairs
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == has.astype(int) @ has.T.astype(int)).all() and peak < 60e6
