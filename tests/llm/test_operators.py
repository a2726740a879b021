"""The corpus operators against brute force on small fixtures, with nulls, empty texts, ties and repeated rows."""

import datetime
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, prose
from winnow.llm import common, mixing, packing, pii, quality, setjoin, suffixes, syncmers, token_files, tokens, toxicity, warc

@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 300).split()
    near = [*long[:150], "changed", *long[151:]]
    passage = prose(77, 60)
    rows = [
        (1, prose(1, 300)),
        (2, " ".join(near)),
        (3, prose(1, 300)),
        (4, prose(2, 120) + " " + passage + " " + prose(3, 90)),
        (5, prose(4, 40) + " " + passage),
        (6, None),
        (7, ""),
        (8, "One two"),
        (9, "one  two"),
        (10, "Größe über\n\nÉcole, it's 12,5. <|endoftext|>"),
        (11, prose(5, 9000)),
        (12, " \t\n"),
        (None, "no id here"),
        (13, "x"),
        (13, "x"),
    ]
    data = [(i, t, "en", "a" if (i or 0) % 3 else None, len(t or "")) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file())
    return lambda text: np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_words_of_bytes_are_the_contract_s():
    text = "a\x0bb\x0cc\x1cd e f\x85g\nh\r\ti"
    assert [w.decode() for w in text.encode().split()] == re.findall(common.WORD, text)


def test_encoder_matches_the_library(tokenizer):
    e = tokens.Encoder(open(tokens.tokenizer_file(), encoding="utf-8").read(), most_words=5)
    for text in ["", "It's Über’s ÉCOLE, o'clock 12,5.", "<|endoftext|>x <|ENDOFTEXT|> \x01 a\x01b", "ÿ÷ß é İstanbul ΣΑΣ. ., .. x.y"]:
        assert e.encode([text.encode()])[0] + b"\x02\0\0\0" == tokenizer(text)


def test_token_files(spark, docs, tokenizer):
    manifest = token_files.write_token_files(docs, common.new_path(spark, "t"), frame_bytes=4096)
    got = token_files.read_token_files(manifest).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, tokenizer(t)) for i, t in rows_of(docs))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    some = token_files.read_documents(manifest, spark.createDataFrame([(5,), (11,)], "doc_id long")).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {i: tokenizer(t) for i, t in rows_of(docs) if i in (5, 11)}


def test_damaged_frame_is_found(spark, docs):
    manifest = token_files.write_token_files(docs.where("doc_id = 11"), common.new_path(spark, "t"))
    path = manifest.first().path
    raw = bytearray(open(path.removeprefix("file://"), "rb").read())
    raw[40] ^= 255
    open(path.removeprefix("file://"), "wb").write(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_files.ShardReader(path).ids(0)


def test_packing(docs, tokenizer):
    pieces = packing.pack(docs, size=256, open_windows=4).collect()
    windows, of_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        of_doc[p.doc_id].append((p.start, bytes(p.ids)))
        assert len(p.ids) == 4 * p.length and p.length > 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 256
    for i, t in rows_of(docs):
        if i not in (13,):
            assert b"".join(x for _, x in sorted(of_doc[i])) == tokenizer(t)
    assert len(of_doc[13]) == 2


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(common.WORD, "".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for x in range(len(rows)):
        if sets[x] and rows[x][0] is not None:
            least[find(x)] = min(least.get(find(x), rows[x][0]), rows[x][0])
    return Counter((i, len(s), least.get(find(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    got = setjoin.near_duplicates(docs, k=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows_of(docs), k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowds_of_near_copies(spark):
    """One crowd of many different near copies, by bits and by sorted sets, and split node by node."""
    base = prose(9, 200).split()
    rows = []
    for i in range(60):
        own = [*base]
        for j in np.random.default_rng(i).integers(0, 200, i % 7):
            own[j] = f"e{i}{j}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows, 4, 80)
    got = lambda: Counter((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.near_duplicates(df, k=4).collect())
    assert got() == expected
    before = setjoin.LARGEST_CROWD
    setjoin.LARGEST_CROWD = 100
    try:
        assert got() == expected
    finally:
        setjoin.LARGEST_CROWD = before


def test_isolated_pairs_in_a_crowd(spark):
    """Texts on one template, just under the threshold alike, and few pairs over it; nodes hold far fewer than there are texts."""
    template, rows = prose(900, 80), []
    for i in range(240):
        own = [f"o{i}{x}" for x in range(10)]
        rows.append((i, f"{template} {' '.join(own)}"))
        if i % 6 == 0:
            rows.append((1000 + i, f"{template} {' '.join(own[:-1])} other{i}"))
    expected = brute_components(rows, 4, 80)
    assert len({c for _, _, c in expected}) == 240
    before = setjoin.LARGEST_NODE, setjoin.DEPTH
    setjoin.LARGEST_NODE, setjoin.DEPTH = 8, 1
    try:
        got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, trees=4).collect()
    finally:
        setjoin.LARGEST_NODE, setjoin.DEPTH = before
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_trees_give_the_recall():
    assert setjoin.met(8, 0.8) >= setjoin.RECALL > setjoin.met(7, 0.8) and setjoin.trees_for(setjoin.RECALL, 0.8) == 8


def test_near_dedup_stage(spark, docs):
    kept = setjoin.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 4, 5, 6, 7, 8, 10, 11, 12, None, 13])


def test_repeated_passages(docs):
    rows = [(i, t.split(" ") if not t.strip() else re.findall(common.WORD, t)) for i, t in rows_of(docs)]
    runs = defaultdict(set)
    for x, (_, w) in enumerate(rows):
        for j in range(len(w) - 49):
            runs[tuple(w[j : j + 50])].add(x)
    expected = defaultdict(set)
    for x, (i, w) in enumerate(rows):
        for j in range(len(w) - 49):
            if len(runs[tuple(w[j : j + 50])]) > 1:
                expected[i].update(range(j, j + 50))
    got = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.other_id != r.doc_id and r.n_words >= 50
    assert got == expected and {4, 5, 1, 2, 3} <= set(got)


def held_passages(rows):
    """Word places by document that lie in a run of 50 words which another document has too."""
    runs, out = defaultdict(set), defaultdict(set)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            runs[tuple(w[j : j + 50])].add((i, j))
    for at in runs.values():
        if len({i for i, _ in at}) > 1:
            for i, j in at:
                out[i].update(range(j, j + 50))
    return out


def found_passages(spark, rows):
    got = defaultdict(set)
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    return got


def test_passages_around_a_common_core(spark):
    """Pairs share 55 words around a core of 30 to 49 that many other texts have too; a text has a shared window twice."""
    rows = []
    for c in range(8):
        core, before, after = prose(500 + c, 30 + c * 19 // 7).split(), prose(600 + c, 30).split(), prose(700 + c, 30).split()
        own = 55 - len(core)
        shared = [*before[: own // 2], *core, *after[: own - own // 2]]
        around = [shared if x < 2 else core for x in range(12)]
        rows += [(100 * c + x, f"{prose(1000 * c + x, 40)} {' '.join(mid)} {prose(1000 * c + 500 + x, 40)}") for x, mid in enumerate(around)]
        rows.append((100 * c + 50, f"{' '.join(shared)} {prose(1000 * c + 900, 20)} {' '.join(shared)}"))
    assert found_passages(spark, rows) == held_passages(rows)


def test_passages_whatever_the_partitions(spark):
    """Pairs share a very common minimiser and 24 words before it, and go on differently; the ranges are cut within its rows."""
    seed = lambda t: suffixes.window_hashes(common.WordHashes().of(t.encode().split()), 26)[0]
    core, rows = min((prose(8000 + x, 26) for x in range(2000)), key=seed), []
    for x in range(120):
        before = prose(810 + x % 60, 24)
        rows.append((x, f"{prose(2000 + x, 20)} {before} {core} {prose(3000 + x, 40)}"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        assert found_passages(spark, rows) == held_passages(rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_minimisers_cover_every_window():
    h = np.random.default_rng(3).integers(0, 50, 300).astype(np.uint64)
    at = suffixes.minimisers(common.mixed(h), 25)
    assert max(np.diff(at)) <= 25 and at[0] < 25 and at[-1] >= 275


def test_anchors_are_closed_and_context_free(spark):
    a, b, c = prose(21, 80), prose(22, 30), prose(23, 30)
    df = spark.createDataFrame([(1, a), (2, b + " " + a + " " + c)], "doc_id long, text string")
    at = defaultdict(set)
    for r in syncmers.anchor_positions(df).collect():
        at[r.doc_id].add((r.pos - 30 * (r.doc_id - 1), r.hash))
    assert at[1] and at[1] <= at[2]


def luhn(s):
    d = [int(x) for x in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pii(spark):
    rows = [
        (1, "mail Bosbt.42@mail8.example.com; card 4944339490429605 or 4944-3394-9042-9605, bad 4944339490429606, ip 70.123.182.155. no 300.1.1.1"),
        (2, "+1 (988) 555-2485, ssn 123-45-6789, on 2024-02-29, 29/02/2024, 29.02.2024, not 2023-02-29"),
        (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" DE89370400440532013000'),
        (4, None),
        (5, ""),
        (6, "nothing here"),
        (7, "4944339490429605"),
    ]
    got = {r.doc_id: r for r in pii.with_pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    t = got[1].text
    cards = re.findall(r"\d{16}", t)
    assert cards[0] != "4944339490429605" and luhn(cards[0]) and cards[1] == "4944339490429606" and "300.1.1.1" in t
    assert re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", t)[0].replace("-", "") == cards[0] == got[7].text
    assert "bosbt" not in t.lower() and re.search(r"[a-z0-9]{5}\.[a-z0-9]{2}@[a-z0-9]{5}\.[a-z0-9]{7}\.com", t)
    assert "70.123.182.155" not in t and all(int(o) < 256 for o in re.search(r"ip ([\d.]+)\.", t)[1].split("."))
    u = got[2].text
    day = datetime.date.fromisoformat(re.search(r"on (\d{4}-\d{2}-\d{2})", u)[1])
    assert day.strftime("%d/%m/%Y") in u and day.strftime("%d.%m.%Y") in u and "2024" not in u and "2023-02-29" in u
    iban = re.search(r"DE\d{20}", got[3].text)[0]
    assert iban != "DE89370400440532013000" and int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    assert "24be64" not in got[3].text and re.search(r'"[0-9a-f]{40}"', got[3].text)
    assert (got[4].text, got[5].text, got[6].text) == (None, "", "nothing here") and got[6].n_replaced == 0


def test_pii_of_numbers_beside_each_other(spark):
    """Cards with other numbers before, after and between them; dates of all years."""
    card = "4944339490429605"
    spaced = "4944 3394 9042 9605"
    amex = "3782 822463 10005"
    texts = [
        card, f"{card} 12/27", f"{card} 123", f"order 12 {card}", f"{spaced} 100.00", f"12 {spaced} 123", f"{card} {card}-7", f"1234 {amex} 99",
        f"{card} 2024-02-29", f"{card} 29/02/2024", f"{card} 123-45-6789 12", f"{card} 988.555.2485", f"{card} 70.123.182.155", f"{card} 12a@b.com", f"{card} 988 555 2485",
        "0987-05-04 04/05/0987 04.05.0987", "2345-06-07", "9999-12-31 0001-01-01", "12 4944339490429606 34", "9" * 3000, "1 " * 5000,
    ]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.with_pseudonyms(df, "k").collect()}
    t = [got[i].text for i in range(len(texts))]
    new = t[0]
    assert new != card and luhn(new)
    four = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    assert t[1:7] == [f"{new} 12/27", f"{new} 123", f"order 12 {new}", f"{four} 100.00", f"12 {four} 123", f"{new} {new}-7"]
    one = re.fullmatch(r"1234 (\d{4} \d{6} \d{5}) 99", t[7])[1]
    assert one != amex and luhn(one.replace(" ", ""))
    for i in range(8, 15):
        assert t[i].startswith(new + " ") and t[i][17:] != texts[i][17:] and got[i].n_replaced == 2
    assert t[10].endswith(" 12") and got[6].n_replaced == 2 and got[1].n_replaced == 1
    iso, slashed, dotted = t[15].split()
    day = datetime.date.fromisoformat(iso)
    assert iso != "0987-05-04" and [day.day, day.month, day.year] == [int(x) for x in slashed.split("/")] == [int(x) for x in dotted.split(".")]
    assert t[16] != texts[16] and datetime.date.fromisoformat(t[16]) and all(x != y and datetime.date.fromisoformat(x) for x, y in zip(t[17].split(), texts[17].split(), strict=True))
    assert t[18:20] == texts[18:20] and len(t[20]) == len(texts[20])


def test_dates_outside_the_calendar_s_period_are_permuted(spark):
    df = spark.sql("select id, date_format(date_add(date'0001-01-01', cast(id * 97 as int)), 'yyyy-MM-dd') as text from range(37650)")
    got = pii.with_pseudonyms(df, "k")
    assert got.select("text").distinct().count() == 37650 and got.where("n_replaced = 0").count() < 5
    assert got.where("text >= '1700' and text < '2100'").count() == df.where("text >= '1700' and text < '2100'").count()


def test_feistel_is_a_bijection(spark):
    df = spark.range(1000).select(F.expr(pii.chars_feistel("lpad(cast(id as string), 3, '0')", pii.DIGITS, "t", "k")).alias("x"), F.expr(pii.sides_feistel("id div 8", "id % 8", (125, 8), "t", "k")).alias("y"))
    assert df.select("x").distinct().count() == 1000 == df.select("y").distinct().count()


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/b c", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\nz"), (None, "http://f", "<p>x</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: tuple(r)[1:] for r in warc.op9_warc(spark, str(tmp_path)).collect()}
    sha = lambda b: warc.digest(b)
    assert got == {
        1: (8, sha(b"<p>x</p>"), "response", None), 2: (8, sha(b"<p>x</p>"), "revisit", 1), 3: (0, sha(b""), "response", None),
        4: (0, sha(b""), "revisit", 3), 5: (7, sha("é\r\n\r\nz".encode()), "response", None), None: (8, sha(b"<p>x</p>"), "revisit", 1),
    }


def test_arc_versions_and_kinds():
    about = {"URL": b"dns:x", "IP-address": b"1.2.3.4", "Archive-date": b"199901020304", "Content-type": b"text/dns", "Archive-length": b"3"}
    record = warc.to_warc("f", 1, about, b"abc", None)
    assert b"WARC-Type: response" in record and b"WARC-Date: 1999-01-02T03:04:00Z" in record and b"Content-Type: text/dns" in record
    short = warc.to_warc("f", 1, about | {"Archive-length": b"9", "URL": b"ftp://x"}, b"abc", None)
    assert b"WARC-Type: resource" in short and b"WARC-Truncated" in short
    line = warc.arc_header(2, b"http://a b", b"1.1.1.1", b"20200101000000", b"text/html", 5)
    assert dict(zip(warc.ARC_FIELDS[2], line.rstrip().rsplit(b" ", 9), strict=True))["URL"] == b"http://a b"


def test_quality_counts_and_classifier(spark):
    texts = {i: (" ".join(w + ("*** &&&" if i % 4 == 0 else "") for w in prose(i, 80).split())) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "a b\n\na b\na c a b d", 1003: "x y z " * 40}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rules(docs, quality.fit_on(docs, labels)).collect()}
    for i, t in texts.items():
        t = t or ""
        w = re.findall(common.WORD, t)
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = Counter(windows)
        again = {j + o for j, x in enumerate(windows) if often[x] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if re.search(common.WORD, x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
    assert not got[1003].kept and not got[1000].kept
    assert np.mean([got[i].kept == (i % 4 != 0) for i in range(300)]) > 0.97


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).count() == setjoin.near_duplicates(none).count() == suffixes.repeated_passages(none).count() == 0
    assert syncmers.fingerprints(none).count() == mixing.assign(none).count() == pii.with_pseudonyms(none, "k").count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, common.new_path(spark, "t"))).count() == 0
    assert toxicity.scores(none, toxicity.fit([], [], np.zeros(0, np.int32), 0.0)).count() == quality.rules(none, quality.NO_MODEL).count() == 0


def test_clashing_columns(spark, docs):
    more = docs.withColumn("score", F.lit("x")).withColumn("cls", F.lit(1)).withColumn("n_replaced", F.lit("y")).withColumn("place", F.lit(2))
    assert toxicity.scores(more, toxicity.fit([], [], np.zeros(0, np.int32), 0.0), "score").columns[-1] == "score"
    assert setjoin.near_dedup_stage(spark, more, "").columns == more.columns
    assert dict(pii.with_pseudonyms(more, "k").dtypes)["n_replaced"] == "int"
    assert packing.pack(more).count() > 0 and mixing.mixed(more).count() > 0
    odd = docs.withColumns({c: F.lit(c) for c in ("_id", "_key", "_text_key", "_of_id", "_of_key", "_source", "_pii", "_toxicity", "_mix_place", "_mix_doc_id", "epoch", "block", "place", "node", "cls", "crowd")})
    assert setjoin.near_dedup_stage(spark, odd, "").columns == odd.columns
    for out in (mixing.mixing_stage(spark, odd, ""), toxicity.scores(odd, toxicity.fit([], [], np.zeros(0, np.int32), 0.0), "toxicity").drop("toxicity")):
        assert out.columns == odd.columns and out.where("not (_id = '_id' and place = 'place' and _toxicity = '_toxicity' and epoch = 'epoch')").count() == 0 < out.count()
    assert mixing.mixed(odd).columns == [c for c in odd.columns if c not in ("epoch", "block", "place")] + ["epoch", "block", "place"]
