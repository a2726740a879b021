"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from winnow.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
#: They train or draw, which SQL can't express: held to plain Python in test_learners.py and test_folds.py, to the shape of their rows here.
WITHOUT_SQL = {"screen_metrics", "linear_scores", "contrastive_scores", "ablation_grid", "certification_grid", "pca_map", "neighbour_graph", "neighbour_map", "saved_embeddings", "train_auroc", "ngram_embeddings", "attention_positions", "loso_rows", "evaluation_rows"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows) -> list[tuple]:
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{float(x):.5f}" if isinstance(x, int | float) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(map(value, r)) for r in rows)


def close(a: list[tuple], b: list[tuple]) -> bool:
    def same(x, y):
        try:
            return x == y or abs(float(x) - float(y)) <= 2e-5
        except ValueError:
            return False

    return len(a) == len(b) and all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_sql_is_missing_only_where_it_cannot_be():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    mine = QUERIES[name](spark, str(DATA))
    theirs = duck.sql(ORACLES[name])
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    assert close(plain(mine.select(*names).collect()), plain(theirs.select(*[f'"{n}"' for n in names]).fetchall()))


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_queries_without_sql_give_rows(spark, name):
    # no language of the smallest tables has the three positives that a fold asks for
    df = QUERIES[name](spark, str(DATA.with_name("sf0.01") if name == "loso_rows" else DATA))
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
