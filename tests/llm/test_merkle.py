"""The manifest against a plain tree in Python: odd rows, one row, many groups, repeated rows, clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA
from winnow.llm.merkle import FIELDS, LOWER, UPPER, manifest, op13_merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for x in levels[:-1]:
        a, b = i // 8 * 8, i
        out.append(("".join(x[a:b]), "".join(x[b + 1 : a + 8])))
        i //= 8
    return out


def plain(rows):
    trees = []
    for g in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == g), key=lambda x: x[:3])
        trees.append((mine, levels_of([m[2] for m in mine])))
    top, out = levels_of([t[-1][0] for _, t in trees]), []
    for k, (mine, levels) in enumerate(trees):
        for i, (_, _, own, (doc_id, text, *rest)) in enumerate(mine):
            path = way(levels, i) + way(top, k)
            hit = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            h = leaf(doc_id, text.translate(str.maketrans(UPPER, LOWER)), *rest) if hit else own
            for left, right in path:
                h = H(left + h + right)
            out.append((doc_id, own, levels[-1][0], top[-1][0], H("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


MANY = [(i, f"Text {i}" * (i % 5), ["en", "de", "fr", None, "É"][min(i % 11, 4)], "s" if i % 3 else None, i) for i in range(700)]
CASES = {
    "many": MANY,
    "odd": [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Null", "en", "a", 4), (None, "Other", "en", "a", 4), (7, "Größe ÄB" * 5000, "de", "x", 40000)] + [(3, "Same", "en", "a", 4)] * 20,
    "one": [(5, "Alone", "en", "a", 5)],
    "nine": [(i, "T", "en", "a", 1) for i in range(9)],
    "groups": [(i, "T", f"l{i % 70:02d}", "a", 1) for i in range(150)],
}


@pytest.mark.parametrize("name", list(CASES))
def test_op13_is_the_plain_tree(spark, tmp_path, name):
    spark.createDataFrame(CASES[name], SCHEMA).withColumns({"hash": F.lit("clash"), "POS": F.lit(1), "g": F.lit(2)}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(CASES[name])


def test_no_rows_and_unchanged_rows(spark):
    assert manifest(spark.createDataFrame([], SCHEMA), "lang", "doc_id", FIELDS).count() == 0
    got = manifest(spark.createDataFrame(MANY, SCHEMA), "lang", "doc_id", FIELDS).collect()
    assert len(got) == len(MANY) and all(r.verified for r in got)
