"""Operators that SQL can't express, and the pipeline, against plain Python on small folders of tables."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, prose, words
from tests.llm.test_operators import brute_components
from winnow.llm import mixing, packing, pii, quality, setjoin, syncmers, tokens, toxicity
from winnow.llm.common import saved
from winnow.llm.queries import oracle_sql, queries


def odd_rows():
    long = prose(1, 300).split()
    rows = [(i, prose(100 + i, 20 + 7 * i)) for i in range(30)]
    rows += [(40, prose(1, 300)), (41, " ".join([*long[:150], "changed", *long[151:]])), (42, prose(1, 300)), (43, None), (44, ""), (45, "One"), (46, "Größe über\n\nÉcole, 12,5."), (47, " \t"), (48, prose(5, 6000))]
    return [(i, t, "en", None if i % 7 == 0 else "big" if i % 3 else "small", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(3, 90)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4").tobytes()


def md5(s: str, n: int) -> str:
    return hashlib.md5(s.encode()).hexdigest()[:n]


def anchors(text: str) -> list[tuple[int, str]]:
    w = words(text)
    if len(w) < syncmers.K:
        return [(i, md5(x, 6)) for i, x in enumerate(w)]
    g = [md5(f"{a} {b}", 8) for a, b in zip(w, w[1:], strict=False)]
    mers = [(i, g[i : i + 7]) for i in range(len(g) - 6)]
    closed = [(i, m) for i, m in mers if min(m[0], m[-1]) <= min(m[1:-1])]
    return [(i, md5("".join(m[::2]), 6)) for i, m in closed or mers]


def test_op3_is_the_plain_version(spark, folder):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), reverse=True)
    expected = {}
    for k, (i, t) in enumerate(rows):
        follow, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        a = [anchors(x) for x in (t, edited, follow)]
        print_of = lambda x: "".join(f"{p - q}{h}" for (p, h), (q, _) in zip(x, [(0, ""), *x], strict=False))
        units = [{(x[0][1],)} if len(x) == 1 else {(h, q - p, j) for (p, h), (q, j) in zip(x, x[1:], strict=False)} for x in a]
        near = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        expected[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), print_of(a[0]), print_of(a[1]), near(units[0], units[1]), near(units[0], units[2]))
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op3_fingerprints"](spark, folder).collect()}
    assert got == expected and max(len(x[2]) for x in got.values()) > 7 * 1000
    assert got[40][2] == got[42][2] != got[41][2] and got[42][5] > 0.9 and 0.3 < got[48][4] < 0.7


def test_op3_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, prose(i, 30)) for i in range(40)] + [(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    got = syncmers.fingerprints(docs).collect()
    assert len(got) == 43 and sum(r.doc_id is None for r in got) == 40
    # after the null ids, in the order of their texts' hashes, comes the greatest id
    last = min(docs.where("doc_id is null").select("text", F.xxhash64("text").alias("h")).collect(), key=lambda r: r.h).text
    edited = last[: len(last) - len(last) // 2]
    assert hashlib.sha256(edited.encode()).hexdigest() in {r.edited_sha256 for r in got}


def test_op4_is_whole_and_gapless(spark, folder, tokenizer):
    ids = {r[0]: tokenizer(r[1]) for r in odd_rows()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries()["op4_packing"](spark, folder).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) // 4 and r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for lists, ends in ((pieces, {i: {len(x) // 4} for i, x in ids.items()}), (windows, None)):
        for k, parts in lists.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at in ends[k] if ends else at <= 4096
    total = sum(len(x) // 4 for x in ids.values())
    assert len(windows) <= math.ceil(total / 4096) + 1


def test_open_windows_take_the_tightest_and_emit_the_fullest():
    w = packing.OpenWindows(size=10, most=2, first_id=0)
    put = lambda n: [(still, [(p[0], p[2]) for p in pieces]) for still, pieces in w.put(n, b"\0\0\0\0" * n)]
    assert put(6) == put(7) == [] and put(3) == [(False, [(7, 7), (3, 3)])]
    assert put(8) == [] and put(5) == [(False, [(8, 8)])] and put(4) == [(False, [(6, 6), (4, 4)])]
    assert [p for _, p in w.put(23, b"\0\0\0\0" * 23)][0][0][:5] == (23, 0, 10, 23, 4) and sum(1 for _ in w.rest()) == 1


def spark_hash(values) -> int:
    h = 42
    for kind, x in values:
        if x is not None:
            h = xxhash.xxh64_intdigest(x.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def plain_stream(rows, limit: float, block_tokens: int):
    """(doc_id, source, n_tokens, epoch, block, place) of each row in the stream, by the whole running sum of each source."""
    held = Counter((i, s, spark_hash([("s", t)]), n) for i, s, t, n in rows)
    sums, sizes = Counter(), Counter()
    for (_, s, _, n), c in held.items():
        sums[s] += n * c
        sizes[s] += 1
    total = sum(sums.values())
    weights = lambda e: {s: (x / total) ** e / sum((y / total) ** e for y in sums.values()) for s, x in sums.items()}
    low, high = 0.0, 1.0
    spread = lambda e: max(w / sums[s] for s, w in weights(e).items()) / min(w / sums[s] for s, w in weights(e).items())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if spread(middle) <= limit else (middle, high)
    w = weights(high)
    budget = max(x / w[s] for s, x in sums.items())
    out = Counter()
    for s in sums:
        repeats, parts = max(1.0, w[s] * budget / sums[s]), max(1, math.isqrt(sizes[s]))
        for epoch in range(math.ceil(repeats)):
            placed = []
            for (i, of, key, n), c in held.items():
                if of == s:
                    place = spark_hash([("i", 17), ("i", epoch), ("q", i), ("q", key)])
                    placed.append(((place >> 20) % parts, place, i, n, c))
            at = 0
            for _, place, i, n, c in sorted(placed):
                if at < (repeats - epoch) * sums[s]:
                    out[(i, s, n, epoch, int((epoch * sums[s] + at) // (w[s] * block_tokens)), place)] += c
                at += n * c
    return out, w


def test_op5_is_the_plain_stream(spark, folder, tokenizer):
    rows = [(i, s, t if t is not None else None, len(tokenizer(t)) // 4) for i, t, _, s, _ in odd_rows()]
    held = [(i, s, t, n) for i, s, t, n in rows]
    expected, weights = plain_stream([(i, s, t, n) for i, s, t, n in held], 1.7, 500)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter()
    for r in mixing.assign(docs, max_repeats=1.7, block_tokens=500).collect():
        got[(r.doc_id, r.source, r.n_tokens, r.epoch, r.block, r.place)] += r.copies
        assert abs(r.weight - weights[r.source]) < 1e-9
    assert got == expected and {k[3] for k in got} == {0, 1}
    query = queries()["op5_mixing"](spark, folder)
    assert query.columns == ["doc_id", "source", "n_tokens", "weight", "epoch", "block", "place"] and query.where("epoch = 0").count() == len(rows)


def test_exponents():
    shares, counts = [0.9, 0.02], [1, 5]
    e = mixing.find_exponent(shares, counts, target_entropy=0.8)
    assert abs(mixing.entropy(mixing.tempered(shares, counts, e), counts) - 0.8) < 1e-9
    assert mixing.find_exponent(shares, counts, target_entropy=9) == 0 and mixing.find_exponent(shares, counts, target_entropy=0.01) == 1
    e = mixing.find_exponent(shares, counts, max_repeats=3.0)
    repeats = [w / s for w, s in zip(mixing.tempered(shares, counts, e), shares, strict=True)]
    assert abs(max(repeats) / min(repeats) - 3) < 1e-9


def test_mixing_keeps_each_row(spark):
    rows = [(1, "x", "a")] * 3 + [(None, None, None), (2, "", "b"), (2, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixed(docs, max_repeats=1.0).where("epoch = 0").count() == 6 <= mixing.mixing_stage(spark, docs, "").count() <= 12
    assert mixing.mixing_stage(spark, docs.limit(0), "").count() == 0


def toxic_rows():
    """Texts of which every fifth has one of two words that no other has; more documents than labels."""
    rng = np.random.default_rng(0)
    return [(i, prose(i, 60) + (f" {rng.choice(['vile', 'foulword'])}x" if i % 5 == 0 else "")) for i in range(700)]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labelled"))
    rows = [*toxic_rows(), (1000, None), (1001, ""), (1002, "x" * 300_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(500)] + [(None, 1, None), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain_features(text: str) -> list[int]:
    out = []
    for w in {x.encode() for x in text.lower().split()}:
        edged = b"\x01" + w.strip(b".,;:!?\"'()[]*#$%&|<>") + b"\x02"
        grams = {zlib.crc32(w), *(zlib.crc32(edged[i : i + n]) for n in toxicity.GRAMS for i in range(len(edged) - n + 1))}
        out += {g >> 32 - toxicity.BITS for g in grams}
    return out


def test_op1_is_fitted_and_scored_as_the_plain_version(spark, labelled):
    texts = dict(toxic_rows()) | {1001: "", 1002: "x" * 300_000}
    apart = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = [i for i in range(500) if not apart(i)]
    pos, unl = [i for i in train if i % 5 == 0], [i for i in texts if not apart(i)]
    prior = (len(pos) + (not apart(9999))) / (len(train) + (not apart(9999)))
    counts = [Counter(f for i in side for f in set(plain_features(texts[i]))) for side in (pos, unl)]
    chosen = sorted(f for f, n in counts[0].items() if n >= 3 and (prior * n / len(pos) * len(unl) + prior) / (counts[1][f] + 1) > 0.5)
    model = toxicity.fit_on(spark.read.parquet(f"{labelled}/documents.parquet"), spark.read.parquet(f"{labelled}/labels.parquet"))
    assert model.features.tolist() == chosen and abs(model.prior - prior) < 1e-12
    weight = dict(zip(chosen, model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in queries()["op1_toxicity"](spark, labelled).collect()}
    for i, t in [*texts.items(), (1000, "")]:
        z = model.bias + sum(weight.get(f, 0.0) for f in plain_features(t))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[i].held_out == apart(i) and got[i].predicted == int(got[i].score >= 0.5)
    right = [got[i].predicted == int(i % 5 == 0) for i in range(700) if apart(i)]
    assert np.mean(right) > 0.97 and got[1000].score == got[1001].score < 0.5


def test_non_negative_risk_by_hand():
    """The first steps on a tiny problem, with dense matrices and the risk written out."""
    pos, unl, width, prior = [np.array([0, 1]), np.array([0])], [np.array([0]), np.array([1, 1]), np.array([2])], 3, 0.9
    dense = lambda rows: np.array([np.bincount(r, minlength=width) for r in rows], float)
    p, u, w, b, m, v = dense(pos), dense(unl), np.zeros(3), 0.0, np.zeros(4), np.zeros(4)
    sigmoid, negative_seen = lambda z: 1 / (1 + np.exp(-z)), False
    for t in range(1, 31):
        gp, gu = p @ w + b, u @ w + b
        positive = lambda s: np.append(p.T @ s, s.sum())
        unlabelled = lambda s: np.append(u.T @ s, s.sum())
        g_pos, g_neg = positive(-prior * sigmoid(-gp) / 2), unlabelled(sigmoid(gu) / 3) - positive(prior * sigmoid(gp) / 2)
        risk = np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()
        negative_seen |= risk < 0
        g = (g_pos + g_neg if risk >= 0 else -g_neg) + np.append(1e-3 * w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        step = 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:3], b - step[3]
    got = toxicity.nn_pu_fit(pos, unl, width, prior, steps=30)
    assert negative_seen and np.allclose(got[0], w) and abs(got[1] - b) < 1e-9


def test_toxicity_stage(spark, labelled):
    docs = spark.read.parquet(f"{labelled}/documents.parquet").withColumn("_toxicity", F.lit("own"))
    kept = toxicity.toxicity_stage(spark, docs, labelled)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {1000, 1001} <= ids and np.mean([i in ids for i in range(700) if i % 5]) == 1 and sum(i in ids for i in range(0, 700, 5)) < 5
    none = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit_on(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.scores(none, model).count() == 0 and len(model.features) == 0
    alone = toxicity.fit_on(none, spark.read.parquet(f"{labelled}/labels.parquet"))  # labels without documents
    assert len(alone.features) == 0


def test_op10_probability_and_held_out_accuracy(spark):
    texts = {i: " ".join(w + ("***" if i % 4 == 0 and w < "w3" else "") for w in prose(i, 80).split()) for i in range(400)} | {500: None, 501: "", 502: "y" * 200_000}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    seen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in seen], "doc_id long, quality int, toxic int")
    model = quality.fit_on(docs, labels)
    got = {r.doc_id: r for r in quality.rules(docs, model).collect()}
    for i, t in texts.items():
        found = [w.encode() for w in words(t)]
        total = sum(model.weights[f] for w in found for f in quality.word_features(w))
        mark = lambda w: np.uint64(zlib.crc32(w) | zlib.adler32(w) << 32)
        total += sum(model.weights[quality.pair_features(np.array([mark(a), mark(b)]))[0]] for a, b in zip(found, found[1:], strict=False))
        z = model.slope * (model.bias + total / max(1, len(found))) + model.shift
        assert abs(got[i].probability - 1 / (1 + math.exp(-min(60, max(-60, z))))) < 1e-6
        assert got[i].kept == (not got[i].base_failed and got[i].probability >= 0.5)
    apart = [i for i in range(400) if i not in set(seen)]
    assert np.mean([got[i].kept == (i % 4 != 0) for i in apart]) > 0.95
    rates = [got[i].probability for i in apart]
    assert abs(np.mean(rates) - np.mean([i % 4 != 0 for i in apart])) < 0.1  # calibrated
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.fit_on(none, labels) is quality.NO_MODEL and quality.fit_on(docs, labels.limit(0)) is quality.NO_MODEL


def test_windows_of_very_many_words():
    numbers = np.array([1, 7, 9, 1, (1 << 21) + 7, 9, 5, 1, 7, 9])
    assert quality.repeated_words(numbers) == 6 and quality.repeated_words(np.arange(3_000_000)) == 0


def test_sparse_rows():
    parts = [(np.array([0, 2], np.int32), np.array([1, 2], np.float32)), (np.zeros(0, np.int32), np.zeros(0, np.float32)), (np.array([1], np.int32), np.array([3], np.float32))]
    rows = quality.Rows.of(parts)
    assert rows.margins(np.array([1.0, 10, 100])).tolist() == [201, 0, 30] and rows.gradient(np.array([1.0, 5, 2]), 3).tolist() == [1, 6, 2]


def test_packing_stage(spark, tokenizer):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (2, "")]
    out = packing.packing_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == Counter((i, tokenizer(t)) for i, t in rows)


def test_pipeline_is_its_stages_and_the_plain_outcome(spark, tmp_path, tokenizer):
    toxic = toxic_rows()
    rows = [(i, t) for i, t in toxic if i < 300]
    base = prose(9000, 120).split()
    rows += [(1000 + k, " ".join([*base[: 5 * k], *(["new"] if k else []), *base[5 * k :]])) for k in range(6)] + [(2000, "mail ann@example.com now please " + prose(7, 40)), (2001, None), (2002, "")]
    documents = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in rows]
    spark.createDataFrame(documents, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        held = {}
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
            if name != "packing":
                assert docs.columns == before.columns
            held[name] = docs.collect()
        run = Counter((r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    clean = {r.doc_id for r in held["toxicity"]}
    assert {i for i, _ in rows if i % 5 or i >= 1000} <= clean and len([i for i in clean if i < 300 and i % 5 == 0]) < 5
    left = [(r.doc_id, r.text or "") for r in held["toxicity"]]
    expected = {i for (i, _, c), _ in brute_components(left, 5, 80).items() if i == c}
    assert {r.doc_id for r in held["near_dedup"]} == expected and 1000 in expected and 1003 not in expected
    assert Counter(r.doc_id for r in held["pii"]) == Counter(expected) and "ann@" not in next(r.text for r in held["pii"] if r.doc_id == 2000)
    text = {r.doc_id: r.text for r in held["pii"]}
    assert all(r.text == text[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text)) for r in held["mixing"])
    counts = Counter(r.doc_id for r in held["mixing"])
    assert counts.keys() == text.keys() and set(counts.values()) <= {1, 2}
    packed = Counter()
    for r in held["packing"]:
        packed[(r.doc_id, r.start, bytes(r.ids))] += 1
    assert packed == run == Counter({(i, 0, tokenizer(text[i])): n for i, n in counts.items()})


def test_no_rows_and_stages(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("pages", "page_id long, url string, html string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, none, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_sql_is_there_where_it_can_be():
    assert set(oracle_sql()) == {"op3_fingerprints", "op6_near_dedup", "op7_suffix_dedup", "op9_warc", "op11_resampling", "op13_merkle"} and set(oracle_sql()) < set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name, folder, tmp_path):
    import duckdb

    pages = [(i, f"http://h/{i}", None if i == 3 else "<p>é</p>" * (i % 5)) for i in range(30)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t, at in (("documents", folder), ("pages", tmp_path), ("benchmark", folder)):
        con.execute(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
    mine = queries()[name](spark, str(tmp_path) if name == "op9_warc" else folder)
    theirs = con.sql(oracle_sql()[name])
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    tidy = lambda rows: Counter(tuple(x if not isinstance(x, float) else round(x, 12) for x in r) for r in rows)
    assert tidy(mine.select(*names).collect()) == tidy(theirs.select(*[f'"{n}"' for n in names]).fetchall())


def test_nodes_of_too_many_shingles_meet_in_blocks(spark):
    rows = []
    for i in range(40):
        own = prose(4000 + i // 2, 100).split()
        rows.append((i, " ".join([*prose(3999, 20).split(), *own[: 100 - i % 2]])))
    before = setjoin.LARGEST_CROWD
    setjoin.LARGEST_CROWD = 300  # so that crowds, then nodes of more than two classes, are too large
    try:
        got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    finally:
        setjoin.LARGEST_CROWD = before
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 80)


def test_blocks_stay_in_order_through_mixing_and_packing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30 + i % 50), "big" if i % 3 else f"s{i % 5}") for i in range(600)], "doc_id long, text string, source string").repartition(6)
    stream = mixing.assign
    monkeypatch.setattr(mixing, "assign", lambda d, **o: stream(d, block_tokens=4000, **o))
    expected = [(r.block, r.place, r.doc_id) for r in stream(docs, block_tokens=4000).orderBy("block", "place").collect()]
    written = saved(mixing.mixing_stage(spark, docs, ""), "ordered")
    again = written.select("_metadata.file_name", "_metadata.row_index", "doc_id").orderBy("file_name", "row_index")
    assert [r.doc_id for r in again.collect()] == [i for _, _, i in expected] and expected[-1][0] > 5
    at = defaultdict(list)
    for k, (_, _, i) in enumerate(expected):
        at[i].append(k)
    read = packing.in_file_order(written).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n"), "doc_id").orderBy("n").collect()
    assert [r.doc_id for r in read] == [i for _, _, i in expected]
    once = {i: k[0] for i, k in at.items() if len(k) == 1}
    firsts = sorted((r.sequence_id, once[r.doc_id]) for r in packing.packing_stage(spark, written, "").where("offset = 0 and start = 0").collect() if r.doc_id in once)
    assert len(firsts) > 10 and [k for _, k in firsts] == sorted(k for _, k in firsts)
    assert packing.in_file_order(docs).columns == docs.columns
