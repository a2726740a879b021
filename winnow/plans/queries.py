"""The engine's queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.config import CONFIG
from winnow.functions import text as T
from winnow.functions import vector as V
from winnow.operators import bootstrap, metrics, sampling, simjoin
from winnow.operators.curation import curate
from winnow.operators.ingest import capped, entries_of, first_wins, parse_entries, running_totals, with_hard_flag, within_length
from winnow.operators.prefix import numbered
from winnow.plans.frames import SCORES_SQL, positives, raw_entries, scores, vector_parts, vectors
from winnow.session import new_path, table
from winnow.sources.files import append_positives, fasta_records, interval_text, latex_rows
from winnow.sources.paged import LandedPages, read_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHORT = 4  # k of k-mers over names


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c) -> F.Column:
    return F.round(c, 6)


def kmers_sql(text: str, k: int) -> str:
    return f"case when length({text}) >= {k} then list_distinct([substr({text}, i, {k}) for i in range(1, length({text}) - {k} + 2)]) else []::varchar[] end"


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
COS = "({dot} / sqrt({aa}) / sqrt({bb}))"


def cos_sql(a: str, b: str) -> str:
    return COS.format(dot=DOT.format(a=a, b=b), aa=DOT.format(a=a, b=a), bb=DOT.format(a=b, b=b))


# --- counts and statistics ---------------------------------------------------------------------------------------------


@query("label_counts", "select count(*) as n_total, sum((toxic = 1)::int)::bigint as n_pos, sum((toxic = 0)::int)::bigint as n_neg, sum((toxic = 0 and quality = 0)::int)::bigint as n_hard from labels")
def _(spark, d):
    t = table(spark, d, "labels")
    return t.agg(F.count("*").alias("n_total"), F.count_if(F.col("toxic") == 1).alias("n_pos"), F.count_if(F.col("toxic") == 0).alias("n_neg"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 0)).alias("n_hard"))


@query("value_counts", "select source, lang, count(*) as n from documents group by 1, 2 order by n desc, source, lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang")


@query("length_stats", "select lang, round(avg(n_chars), 6) as mean, median(n_chars)::double as median, min(n_chars) as least, max(n_chars) as most, count(distinct source) as n_sources from documents group by lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(r6(F.avg("n_chars")).alias("mean"), F.median("n_chars").alias("median"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_distinct("source").alias("n_sources"))


@query("hard_flag", "select l.doc_id, d.source in ('src1', 'src2', 'src3') as is_hard_negative, l.toxic as y from labels l join documents d on l.doc_id = d.doc_id")
def _(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return with_hard_flag(j, "source", ["src1", "src2", "src3"]).select("doc_id", "is_hard_negative", F.col("toxic").alias("y"))


@query("running_totals", "select source, n, sum(n) over (order by source)::bigint as running from (select source, count(*) as n from documents group by 1)")
def _(spark, d):
    return running_totals(table(spark, d, "documents"), "source")


@query("length_range", "select doc_id, n_chars, substr(text, 1, 1024) as head from documents where n_chars between 50 and 2000")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("n_chars").between(50, 2000)).select("doc_id", "n_chars", T.truncated("text").alias("head"))


@query("group_distribution", "select lang, round(avg(n_chars), 6) as mean, quantile_cont(n_chars::double, 0.25) as q1, quantile_cont(n_chars::double, 0.5) as median, quantile_cont(n_chars::double, 0.75) as q3 from documents group by lang")
def _(spark, d):
    q = lambda p: F.percentile("n_chars", F.lit(p))
    return table(spark, d, "documents").groupBy("lang").agg(r6(F.avg("n_chars")).alias("mean"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


@query("json_fields", "select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, length(props) as n from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.length("props").cast("long").alias("n"))


# --- strings and sets --------------------------------------------------------------------------------------------------


@query("kmer_sets", f"select p_partkey, len({kmers_sql('p_name', 5)}) as n_kmers, array_to_string(list_sort({kmers_sql('p_name', 5)}), '|') as kmers from part")
def _(spark, d):
    k = T.kmers("p_name", 5)
    return table(spark, d, "part").select("p_partkey", F.size(k).cast("long").alias("n_kmers"), F.array_join(F.sort_array(k), "|").alias("kmers"))


@query(
    "kmer_max_jaccard",
    f"with q as (select distinct doc_id as id, unnest({kmers_sql('text', 5)}) as k from documents), r as (select distinct item_id as ref, unnest({kmers_sql('text', 5)}) as k from benchmark), "
    "nq as (select id, count(*) as n from q group by 1), nr as (select ref, count(*) as n from r group by 1), "
    "c as (select id, ref, count(*) as c from q join r using (k) group by 1, 2), "
    "b as (select id, max(c / (nq.n + nr.n - c)::double) as s from c join nq using (id) join nr using (ref) group by 1) "
    "select doc_id as id, round(coalesce(s, 0), 6) as max_sim from documents left join b on doc_id = id",
)
def _(spark, d):
    m = simjoin.max_kmer_jaccard(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", k=5)
    return m.select("id", r6("max_sim").alias("max_sim"))


WORD_SETS = "list_distinct([array_to_string(list_slice(w, i, i + 2), ' ') for i in range(1, len(w) - 1)])"
PEERS = (
    "with p as (select d.doc_id as id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as w from documents d join labels l on d.doc_id = l.doc_id where toxic = 1), "
    f"s as (select id, unnest(case when len(w) >= 3 then {WORD_SETS} else []::varchar[] end) as k from p), n as (select id, count(*) as n from s group by 1), "
    "c as (select a.id as id_a, b.id as id_b, count(*) as c from s a join s b on a.k = b.k and a.id < b.id group by 1, 2), "
    "j as (select id_a, id_b, c / (x.n + y.n - c)::double as sim from c join n x on x.id = id_a join n y on y.id = id_b) "
)


@query("pairwise_jaccard", PEERS + "select id_a, id_b, round(sim, 6) as sim from j")
def _(spark, d):
    p = simjoin.pairwise_jaccard(positives(spark, d), "doc_id", T.shingles("text", 3))
    return p.select("id_a", "id_b", r6("sim").alias("sim"))


@query("peer_max_sim", PEERS + ", b as (select id, max(sim) as s from (select id_a as id, sim from j union all select id_b, sim from j) group by 1) select p.id, round(coalesce(s, 0), 6) as max_sim from p left join b on p.id = b.id")
def _(spark, d):
    return simjoin.peer_max(positives(spark, d), "doc_id", T.shingles("text", 3)).select("id", r6("max_sim").alias("max_sim"))


@query(
    "positional_identity",
    "with p as (select p_partkey, p_name as a, lead(p_name) over (order by p_partkey) as b from part) select p_partkey, round(case when least(length(a), length(b)) = 0 then 0 else list_sum([case when substr(a, i, 1) = substr(b, i, 1) then 1 else 0 end for i in range(1, least(length(a), length(b)) + 1)]) / greatest(length(a), length(b))::double end, 6) as identity from p where b is not null",
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    follows = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(follows, "p_partkey").select("p_partkey", r6(T.positional_identity("p_name", "b")).alias("identity"))


@query("fasta_records", "select '>' || doc_id || '|' || lang || '|' || source || chr(10) || text as record from documents")
def _(spark, d):
    return fasta_records(table(spark, d, "documents"), "doc_id", "text", ["lang", "source"])


@query("latex_rows", "select r_name || ' & ' || n || ' ' || chr(92) || chr(92) as line from (select r_name, count(*) as n from region join nation on r_regionkey = n_regionkey group by 1)")
def _(spark, d):
    n = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return latex_rows(n, ["r_name", "n"])


# --- vectors -----------------------------------------------------------------------------------------------------------

SPLIT_SQL = "with v as (select vec_id as id, embedding as e, label, (label = 0)::int as y from embeddings), te as (select * from v where id % 5 = 0), tr as (select * from v where id % 5 <> 0) "


@query("unit_vectors", f"with u as (select vec_id as id, unnest(range(0, 64)) as pos, unnest(embedding) as x, sqrt({DOT.format(a='embedding', b='embedding')}) as size from embeddings) select id, pos::int as pos, round(x::double / size, 6) as value from u")
def _(spark, d):
    return vectors(spark, d).select("id", F.posexplode(V.unit("embedding")).alias("pos", "value")).select("id", "pos", r6("value").alias("value"))


@query("cosine_topk_mean", SPLIT_SQL + f", s as (select te.id, tr.id as ref, {cos_sql('te.e', 'tr.e')} as c from te, tr where tr.y = 1), k as (select *, row_number() over (partition by id order by round(c, 12) desc, ref) as rn from s) select id, round(avg(c), 6) as score from k where rn <= 5 group by id")
def _(spark, d):
    train, test = vector_parts(spark, d)
    return simjoin.cosine_topk_mean(test, train.where("y = 1")).select("id", r6("score").alias("score"))


@query("knn_vote", SPLIT_SQL + f", s as (select te.id, tr.id as ref, tr.y, {cos_sql('te.e', 'tr.e')} as c from te, tr), k as (select *, row_number() over (partition by id order by round(c, 12) desc, ref) as rn from s), n as (select id, y, greatest(0, round(1 - c, 12)) as dist from k where rn <= 5), z as (select id, min(dist) = 0 as exact from n group by 1) select id, round(sum(w * y) / sum(w), 6) as score from (select n.id, y, case when exact then (dist = 0)::int::double else 1 / dist end as w from n join z on n.id = z.id) group by id")
def _(spark, d):
    train, test = vector_parts(spark, d)
    return simjoin.knn_vote(test, train).select("id", r6("score").alias("score"))


NEGATIVES_SQL = f", s as (select p.id, n.id as ref, {cos_sql('p.e', 'n.e')} as c from v p, v n where p.y = 1 and n.y = 0), k as (select *, row_number() over (partition by id order by round(c, 12) desc, ref) as rn from s) "


@query("hard_negatives", SPLIT_SQL + NEGATIVES_SQL + "select id, ref, round(c, 6) as cosine, rn as rank from k where rn <= 3")
def _(spark, d):
    v = vectors(spark, d)
    h = simjoin.hard_negatives(v.where("y = 1"), v.where("y = 0"))
    return h.select("id", "ref", r6("cosine").alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("hard_negative_expansion", SPLIT_SQL + NEGATIVES_SQL + "select id as anchor, 0::bigint as slot, id, 1 as y from v where y = 1 union all select id, rn, ref, 0 from k where rn <= 3")
def _(spark, d):
    v = vectors(spark, d)
    pos = v.where("y = 1")
    return simjoin.expanded(pos, simjoin.hard_negatives(pos, v.where("y = 0"))).withColumn("slot", F.col("slot").cast("long"))


@query("align_embeddings", "select vec_id as id, label, len(embedding) as width from embeddings")
def _(spark, d):
    v = vectors(spark, d)
    return simjoin.aligned(v.select("id", "embedding"), v.select("id", "label")).select("id", "label", F.size("embedding").cast("long").alias("width"))


@query("missing_embeddings", "select doc_id as id from documents where doc_id not in (select vec_id from embeddings)")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(vectors(spark, d), "id", "left_anti")


@query("kept_in_train", "select vec_id as id from embeddings where vec_id in (select doc_id from labels where toxic = 0)")
def _(spark, d):
    return vectors(spark, d).select("id").join(table(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("id")), "id", "left_semi")


@query("masked_mean_pool", "with e as (select vec_id as id, unnest(range(0, 64)) as k, unnest(embedding)::double as x from embeddings) select id, (k % 4)::int as pos, round(coalesce(avg(x) filter ((id + k // 4) % 3 <> 0), 0), 6) as value from e group by id, k % 4")
def _(spark, d):
    """Each vector as sixteen states of four components, a third of which is masked."""
    v = vectors(spark, d)
    at = F.sequence(F.lit(0), F.lit(15))
    states = F.transform(at, lambda p: F.slice("embedding", p * 4 + 1, F.lit(4)))
    ragged = v.select("id", states.alias("states"), F.transform(at, lambda p: ((F.col("id") + p) % 3 != 0).cast("int")).alias("mask"))
    pooled = V.mean_pooled(ragged, "id", "states", "mask").select("id", F.posexplode("pooled").alias("pos", "value"))
    return pooled.select("id", "pos", r6("value").alias("value"))


@query("mixup_pairs", "with o as (select vec_id as id, label, embedding as e, row_number() over (partition by label order by ('0x' || substr(md5('42|' || vec_id::varchar), 1, 8))::bigint, vec_id) as i, count(*) over (partition by label) as n from embeddings), p as (select a.id, b.id as partner, unnest(range(0, 64)) as pos, unnest(a.e)::double as x, unnest(b.e)::double as y from o a join o b on a.label = b.label and b.i = a.i % a.n + 1) select id, partner, pos::int as pos, round(0.2 * x + 0.8 * y, 6) as value from p")
def _(spark, d):
    from winnow.operators.neural import mixup

    return mixup(vectors(spark, d), 0.2).select("id", "partner", F.posexplode("mixed").alias("pos", "value")).select("id", "partner", "pos", r6("value").alias("value"))


@query("supcon_loss", SPLIT_SQL + f", s as (select a.id, a.label = b.label as same, exp({cos_sql('a.e', 'b.e')} / 0.1) as e, {cos_sql('a.e', 'b.e')} / 0.1 as z from te a, te b where a.id <> b.id), g as (select id, ln(sum(e)) as lse, sum(case when same then z else 0 end) as zs, sum(same::int) as np from s group by 1) select count(*) as n, round(sum(case when np > 0 then (lse * np - zs) / np else 0 end) / count(*), 6) as loss from g")
def _(spark, d):
    from winnow.operators.neural import supcon_loss

    return supcon_loss(vector_parts(spark, d)[1]).select("n", r6("loss").alias("loss"))


# --- splits ------------------------------------------------------------------------------------------------------------

RANK = "row_number() over (partition by {by} order by ('0x' || substr(md5('42|' || doc_id::varchar), 1, 8))::bigint, doc_id)"


@query("train_test_split", f"select doc_id, case when {RANK.format(by='1')} <= ceil(count(*) over () * 0.25::double) then 'test' else 'train' end as split from documents")
def _(spark, d):
    return sampling.train_test_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.25)


@query("stratified_split", f"select doc_id, lang, case when {RANK.format(by='lang')} <= ceil(count(*) over (partition by lang) * 0.25::double) then 'test' else 'train' end as split from documents")
def _(spark, d):
    return sampling.train_test_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.25, strata=["lang"])


@query("fraction_sample", f"select doc_id from (select doc_id, {RANK.format(by='1')} as rn, count(*) over () as n from documents) where rn <= round_even(n * 0.3::double, 0)")
def _(spark, d):
    return sampling.fraction(table(spark, d, "documents").select("doc_id"), "doc_id", 0.3)


@query("class_weights", "select toxic, n as n_class, round(t / (k * n)::double, 6) as weight from (select toxic, count(*) as n, sum(count(*)) over () as t, count(*) over () as k from labels group by toxic)")
def _(spark, d):
    return sampling.class_weights(table(spark, d, "labels"), "toxic").select("toxic", "n_class", r6("weight").alias("weight"))


@query("dedup_first", "select text, doc_id, source from (select *, row_number() over (partition by text order by source, doc_id) as rn from documents where n_chars >= 50) where rn = 1")
def _(spark, d):
    return first_wins(table(spark, d, "documents").where("n_chars >= 50"), "text", ["source", "doc_id"]).select("text", "doc_id", "source")


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("hard", F.col("quality") == 0)


def _ranks(by: str, seed: int) -> str:
    return f"row_number() over (partition by {by} order by ('0x' || substr(md5('{seed}|' || doc_id::varchar), 1, 8))::bigint, doc_id)"


SPLITS_SQL = PEERS + (
    ", mx as (select id, max(sim) as s from (select id_a as id, sim from j union all select id_b, sim from j) group by 1), "
    "f as (select l.doc_id, toxic, lang, case when toxic = 1 then case when coalesce(s, 0) < 0.3 then 'divergent' else 'positive' end when quality = 0 then 'hard' else 'easy' end as kind from labels l join documents d on l.doc_id = d.doc_id left join mx on mx.id = l.doc_id and toxic = 1), "
    "g as (select *, case when kind = 'positive' then lang end as stratum, count(*) over (partition by kind) < 10 as few from f where kind <> 'divergent'), "
    f"a as (select *, not few and {_ranks('kind, stratum', 42)} <= ceil(count(*) over (partition by kind, stratum) * case kind when 'hard' then 0.5 else 0.25 end::double) as tested, "
    f"few and (kind <> 'hard' or {_ranks('kind', 42)} <= round_even(count(*) over (partition by kind) * 0.5::double, 0)) as trained from g), "
    f"v as (select *, {_ranks('kind', 43)} <= case when few then round_even(count(*) over (partition by kind) * 0.5::double, 0) else ceil(count(*) over (partition by kind) * case kind when 'hard' then 0.3 else 0.2 end::double) end as val from a where not tested and not trained), "
    f"t as (select *, kind <> 'positive' and {_ranks('kind', 44)} <= round_even(count(*) over (partition by kind) * 0.3::double, 0) as mix from (select doc_id, toxic, kind from a where tested union all select doc_id, toxic, kind from v where few and not val)), "
    f"w as (select doc_id, toxic, {_ranks('kind', 42)} as i, {_ranks('kind', 43)} as j from g where few and kind = 'positive'), "
    "o as (select doc_id, toxic, 'train' as split from a where trained union all select doc_id, toxic, case when val then 'val' else 'train' end from v where val or not few union all select doc_id, toxic, 'test_standard' from t where kind <> 'hard' or mix "
    "union all select doc_id, toxic, 'test_hard_negative' from t where kind <> 'easy' union all select doc_id, toxic, 'test_seq_divergent' from t where mix union all select doc_id, toxic, 'test_seq_divergent' from f where kind = 'divergent' "
    "union all select doc_id, toxic, 'val' from w where i <= 5 union all select doc_id, toxic, unnest(['test_standard', 'test_hard_negative']) from w where j <= 5) "
)


def _splits(spark, d):
    sims = simjoin.peer_max(positives(spark, d), "doc_id", T.shingles("text", 3)).withColumnRenamed("id", "doc_id")
    return sampling.create_splits(_labelled(spark, d).select("doc_id", "toxic", "hard", "lang"), sims, "doc_id", "toxic", "hard", "lang", small="reuse")


@query("split_rows", SPLITS_SQL + "select doc_id, split from o")
def _(spark, d):
    return _splits(spark, d).select("doc_id", "split")


@query("split_counts", SPLITS_SQL + "select split, count(*) as n, sum(toxic)::bigint as n_pos from o group by 1")
def _(spark, d):
    return _splits(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_pos"))


@query(
    "loso_folds",
    "with l as (select l.doc_id, toxic, lang from labels l join documents d on l.doc_id = d.doc_id), g as (select lang as fold from l where toxic = 1 group by 1 having count(*) >= 3), "
    "t as (select doc_id from (select doc_id, row_number() over (order by ('0x' || substr(md5('42|' || doc_id::varchar), 1, 8))::bigint, doc_id) as rn from l where toxic = 0) where rn <= 100) "
    "select fold, l.doc_id, case when (toxic = 1 and lang = fold) or t.doc_id is not null then 'test' when ('0x' || substr(md5('43|' || l.doc_id::varchar), 1, 8))::bigint < 858993459 then 'validation' else 'train' end as role from g cross join l left join t on l.doc_id = t.doc_id",
)
def _(spark, d):
    return sampling.leave_one_group_out(_labelled(spark, d), "doc_id", "toxic", "lang")


@query("loso_rows")
def _(spark, d):
    """A model for each language of toxic documents left out, over vectors of the documents' n-grams."""
    from winnow.operators.embedders import HashedNgrams, embedded
    from winnow.operators.folds import leave_one_out_rows

    docs = _labelled(spark, d).select(F.col("doc_id").alias("id"), "text", F.col("toxic").alias("y"), "lang")
    r = leave_one_out_rows(embedded(docs, HashedNgrams(), most=None).select("id", "embedding", "y", "lang"), "lang")
    return r.select("fold", "n_pos", "n_neg", *[r6(c).alias(c) for c in ("auroc", "auroc_lo", "auroc_hi", "detection_rate")])


@query("evaluation_rows")
def _(spark, d):
    """All methods over all test splits, one metric row with bounds for each; texts by k-mers, vectors by their n-grams."""
    from winnow.operators.bootstrap import metric_rows_with_intervals
    from winnow.operators.scorers import evaluation_scores

    docs = _labelled(spark, d).select("doc_id", F.col("doc_id").alias("id"), "text")
    rows = _splits(spark, d).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), "split").join(docs.drop("doc_id"), "id")
    m = metric_rows_with_intervals(evaluation_scores(rows))
    return m.select("split", "method", "n_samples", "n_pos", "n_neg", *[r6(c).alias(c) for c in m.columns if c not in ("split", "method", "n_samples", "n_pos", "n_neg")])


# --- metrics -----------------------------------------------------------------------------------------------------------

CURVE_SQL = SCORES_SQL + ", h as (select split, method, score, sum(y) as pos, sum(1 - y) as neg from scores group by 1, 2, 3), c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over a as p, sum(neg) over a as n from h window w as (partition by split, method order by score desc), a as (partition by split, method)) "
BOTH = "p > 0 and n > 0"
RANKING_SQL = f"round(sum(case when {BOTH} then pos * (n - fp + neg / 2.0::double) / p / n else 0 end), 6) as auroc, round(sum(case when {BOTH} then pos / p::double * tp / (tp + fp) else 0 end), 6) as auprc"


@query("roc_points", CURVE_SQL + "select split, method, score, round(fp / n::double, 6) as fpr, round(tp / p::double, 6) as tpr from c where p > 0 and n > 0")
def _(spark, d):
    return metrics.roc_points(scores(spark, d)).select("split", "method", "score", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("pr_points", CURVE_SQL + "select split, method, score, round(tp / (tp + fp)::double, 6) as precision, round(tp / p::double, 6) as recall from c where p > 0 union all select distinct split, method, null::double, 1.0::double, 0.0::double from c where p > 0")
def _(spark, d):
    return metrics.pr_points(scores(spark, d)).select("split", "method", "score", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("auroc_average_precision", CURVE_SQL + f"select split, method, {RANKING_SQL} from c group by 1, 2")
def _(spark, d):
    r = metrics.ranking(metrics.curve(scores(spark, d)))
    return r.select("split", "method", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query(
    "recall_and_fpr_at",
    CURVE_SQL
    + "select split, method, "
    + ", ".join(f"round(case when max({BOTH}::int) = 1 then coalesce(max(tp / p::double) filter (tp / (tp + fp)::double >= {t}), 0) else 0 end, 6) as recall_at_{t * 100:.0f}_precision" for t in (0.95, 0.99))
    + ", "
    + ", ".join(f"round(case when max({BOTH}::int) = 1 then coalesce(min(fp / n::double) filter (tp / p::double >= {t}), 1) else 1 end, 6) as fpr_at_{t * 100:.0f}_recall" for t in (0.95, 0.99))
    + " from c group by 1, 2",
)
def _(spark, d):
    r = metrics.ranking(metrics.curve(scores(spark, d)))
    return r.select("split", "method", *[r6(c).alias(c) for c in ("recall_at_95_precision", "recall_at_99_precision", "fpr_at_95_recall", "fpr_at_99_recall")])


F1_SQL = SCORES_SQL + (
    ", t as (select split, method, i, sum((score >= i / 199.0::double)::int * y) as tp, sum((score >= i / 199.0::double)::int * (1 - y)) as fp, sum(y) as p, sum(1 - y) as n from scores cross join (select unnest(range(0, 200)) as i) group by 1, 2, 3), "
    "f as (select *, case when tp > 0 then 2 * tp / (tp + fp + p)::double else 0 end as f1, (tp + n - fp) / (p + n)::double as acc from t), b as (select *, row_number() over (partition by split, method order by f1 desc, i) as rn from f) "
)


@query("best_f1", F1_SQL + "select split, method, round(f1, 6) as f1_optimal, round(i / 199.0::double, 6) as threshold, round(acc, 6) as accuracy_optimal from b where rn = 1")
def _(spark, d):
    b = metrics.best_f1(scores(spark, d))
    return b.select("split", "method", *[r6(c).alias(c) for c in ("f1_optimal", "threshold", "accuracy_optimal")])


@query("metric_rows", F1_SQL.replace("with u", "with u", 1) + ", h as (select split, method, score, sum(y) as pos, sum(1 - y) as neg from scores group by 1, 2, 3), c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over a as p, sum(neg) over a as n from h window w as (partition by split, method order by score desc), a as (partition by split, method)), "
       f"m as (select split, method, {RANKING_SQL}, max(p)::bigint as n_pos, max(n)::bigint as n_neg from c group by 1, 2) select m.split, m.method, auroc, auprc, round(case when n_pos > 0 and n_neg > 0 then f1 else 0 end, 6) as f1_optimal, round(case when n_pos > 0 and n_neg > 0 then acc else 0 end, 6) as accuracy_optimal, n_pos + n_neg as n_samples, n_pos, n_neg from m join b on m.split = b.split and m.method = b.method where rn = 1")
def _(spark, d):
    m = metrics.metric_rows(scores(spark, d))
    return m.select("split", "method", *[r6(c).alias(c) for c in ("auroc", "auprc", "f1_optimal", "accuracy_optimal")], "n_samples", "n_pos", "n_neg")


BIN_SQL = "case when s >= 1 then 1.0 when s >= 0.7 then 0.7 when s >= 0.5 then 0.5 when s >= 0.3 then 0.3 when s >= 0.2 then 0.2 when s >= 0.1 then 0.1 else 0.0 end::double"


@query("detection_by_bin", SCORES_SQL + f", s as (select split, method, score, (id % 100) / 99.0::double as s from scores where y = 1) select split, method, {BIN_SQL} as bin_lo, round(avg((score >= 0.5)::int), 6) as detection_rate, count(*) as n_samples, round(avg(score), 6) as mean_score from s group by 1, 2, 3")
def _(spark, d):
    s = scores(spark, d)
    sims = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100 / 99.0).alias("similarity"))
    b = metrics.detection_by_bin(s, sims)
    return b.select("split", "method", "bin_lo", r6("detection_rate").alias("detection_rate"), "n_samples", r6("mean_score").alias("mean_score"))


@query("ood_fpr", SCORES_SQL + "select split, method, round(avg((score >= 0.5)::int), 6) as fpr, round(avg(score), 6) as mean_score, max(score) as max_score, count(*) as n_samples from scores where y = 0 group by 1, 2")
def _(spark, d):
    f = metrics.false_positives(scores(spark, d))
    return f.select("split", "method", r6("fpr").alias("fpr"), r6("mean_score").alias("mean_score"), "max_score", "n_samples")


@query("macro_fpr", SCORES_SQL + "select method, round(avg(f), 6) as macro_fpr from (select split, method, avg((score >= 0.5)::int) as f from scores where y = 0 group by 1, 2) group by 1")
def _(spark, d):
    return metrics.false_positives(scores(spark, d)).groupBy("method").agg(r6(F.avg("fpr")).alias("macro_fpr"))


@query("pivot_auroc", CURVE_SQL + f", m as (select split, method, {RANKING_SQL} from c group by 1, 2) select split, max(auroc) filter (method = 'plain') as plain, max(auroc) filter (method = 'sharp') as sharp from m group by 1")
def _(spark, d):
    r = metrics.ranking(metrics.curve(scores(spark, d)))
    return r.groupBy("split").pivot("method", ["plain", "sharp"]).agg(F.first(F.round("auroc", 6)))


@query("score_histogram", SCORES_SQL + ", e as (select split, method, min(score) as lo, max(score) as hi from scores group by 1, 2) select s.split, s.method, least(29, floor((score - lo) / (hi - lo) * 30))::int as bin, count(*) as n from scores s join e on s.split = e.split and s.method = e.method group by 1, 2, 3")
def _(spark, d):
    return metrics.score_histogram(scores(spark, d))


# the smallest k whose binomial distribution function reaches u: nn draws of probability p
QUANTILE_SQL = (
    "list_reduce(list_transform(range(lo, hi + 1), lambda k: exp(lgamma(nn + 1) - lgamma(k + 1) - lgamma(nn - k + 1) + k * ln(p) + (nn - k) * ln(1 - p))), "
    "lambda s, x: {'c': s.c + x, 'k': s.k + (s.c + x < u)::bigint}, {'c': 0.0::double, 'k': lo}).k"
)


def draws_sql(cells: str, keys: str, order: str) -> str:
    """CTEs from cells (keys, n, ...) to drawn: cells with iter and times; each cell in turn gets a binomial part of the draws left."""
    same = " and ".join(f"a.{k.strip()} is not distinct from b.{k.strip()}" for k in keys.split(","))
    spread = "8 * sqrt(nn * p * (1 - p)) + 8"
    return (
        f", ce as (select *, row_number() over w - 1 as i, sum(n) over (partition by {keys} order by {order} rows between current row and unbounded following) as rest from {cells} window w as (partition by {keys} order by {order})), "
        f"ch as (select distinct {keys}, -1::bigint as i, iter, 0::bigint as times, total as nleft from (select {keys}, sum(n)::bigint as total from {cells} group by {keys}), (select unnest(range(0, {CONFIG.iterations})) as iter) "
        f"union all select {keys}, i, iter, times, nleft - times from (select {keys}, i, iter, nleft, case when n = rest then nleft else {QUANTILE_SQL} end as times from ("
        f"select *, greatest(0, floor(nn * p - ({spread})))::bigint as lo, least(nn, ceil(nn * p + {spread}))::bigint as hi from ("
        f"select {', '.join('a.' + k.strip() for k in keys.split(','))}, b.i, a.iter, a.nleft, a.nleft as nn, b.n, b.rest, b.n / b.rest::double as p, (('0x' || substr(md5(a.iter || '|' || b.i), 1, 8))::bigint + 0.5::double) / 4294967296::double as u from ch a join ce b on b.i = a.i + 1 and {same})))), "
        f"drawn as (select b.*, a.iter, a.times from ch a join ce b on a.i = b.i and {same} where a.times > 0) "
    )


BOOT_SQL = SCORES_SQL.replace("with u as", "with recursive u as", 1) + ", cl as (select split, method, score, y, count(*) as n from scores group by 1, 2, 3, 4)" + draws_sql("cl", "split, method", "score, y") + (
    ", h as (select split, method, iter, score, sum(y * times) as pos, sum((1 - y) * times) as neg from drawn group by 1, 2, 3, 4), "
    "c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over a as p, sum(neg) over a as n from h window w as (partition by split, method, iter order by score desc), a as (partition by split, method, iter)), "
    "it as (select split, method, iter, sum(pos * (n - fp + neg / 2.0::double) / p / n) as auroc, sum(pos / p::double * tp / (tp + fp)) as auprc from c where p > 0 and n > 0 group by 1, 2, 3) "
)
PAIRED_SQL = SCORES_SQL.replace("with u as", "with recursive u as", 1) + ", pr as (select split, id, y, max(score) filter (method = 'sharp') as a, max(score) filter (method = 'plain') as b from scores group by 1, 2, 3), cl as (select split, y, a, b, count(*) as n from pr group by 1, 2, 3, 4)" + draws_sql("cl", "split", "y, a, b") + (
    ", e as (select split, iter, y, times, unnest(['sharp', 'plain']) as method, unnest([a, b]) as score from drawn), h as (select split, method, iter, score, sum(y * times) as pos, sum((1 - y) * times) as neg from e group by 1, 2, 3, 4), "
    "c as (select *, sum(neg) over (partition by split, method, iter order by score desc) as fp, sum(pos) over (partition by split, method, iter) as p, sum(neg) over (partition by split, method, iter) as n from h), "
    "it as (select split, method, iter, sum(pos * (n - fp + neg / 2.0::double) / p / n) as auroc from c where p > 0 and n > 0 group by 1, 2, 3) "
)

# the point estimate: a group of one class has the fixed value 0
POINT_SQL = (
    ", h0 as (select split, method, score, sum(y) as pos, sum(1 - y) as neg from scores group by 1, 2, 3), c0 as (select *, sum(neg) over (partition by split, method order by score desc) as fp, sum(pos) over (partition by split, method) as p, sum(neg) over (partition by split, method) as n from h0), "
    "pt as (select split, method, sum(case when p > 0 and n > 0 then pos * (n - fp + neg / 2.0::double) / p / n else 0 end) as auroc from c0 group by 1, 2)"
)


@query(
    "bootstrap_auroc_ci",
    BOOT_SQL + POINT_SQL + ", v as (select split, method, quantile_cont(auroc, 0.025) as lo, quantile_cont(auroc, 0.975) as hi, count(*) as n_valid from it group by 1, 2) "
    "select split, method, round(case when coalesce(n_valid, 0) < 10 then auroc else lo end, 6) as auroc_lo, round(case when coalesce(n_valid, 0) < 10 then auroc else hi end, 6) as auroc_hi, coalesce(n_valid, 0) as n_valid from pt left join v using (split, method)",
)
def _(spark, d):
    i = bootstrap.intervals(scores(spark, d))
    return i.select("split", "method", r6("auroc_lo").alias("auroc_lo"), r6("auroc_hi").alias("auroc_hi"), "n_valid")


@query(
    "paired_bootstrap",
    PAIRED_SQL + POINT_SQL + ", df as (select a.split, a.auroc - b.auroc as diff from pt a join pt b on a.split = b.split and a.method = 'sharp' and b.method = 'plain'), "
    "di as (select a.split, a.auroc - b.auroc as d from it a join it b on a.split = b.split and a.iter = b.iter and a.method = 'sharp' and b.method = 'plain') select df.split, round(max(diff), 6) as difference, round(coalesce(avg((d * sign(diff) <= 0)::int), 1), 6) as p_value from df left join di on df.split = di.split group by 1",
)
def _(spark, d):
    p = bootstrap.paired_p_value(scores(spark, d), "sharp", "plain")
    return p.select("split", r6("difference").alias("difference"), r6("p_value").alias("p_value"))


@query(
    "metric_rows_ci",
    BOOT_SQL + ", h0 as (select split, method, score, sum(y) as pos, sum(1 - y) as neg from scores group by 1, 2, 3), c0 as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over a as p, sum(neg) over a as n from h0 window w as (partition by split, method order by score desc), a as (partition by split, method)), "
    f"pt as (select split, method, sum(case when {BOTH} then pos * (n - fp + neg / 2.0::double) / p / n else 0 end) as auroc, sum(case when {BOTH} then pos / p::double * tp / (tp + fp) else 0 end) as auprc, max(p)::bigint as n_pos, max(n)::bigint as n_neg from c0 group by 1, 2), "
    "v as (select split, method, quantile_cont(auroc, 0.025) as al, quantile_cont(auroc, 0.975) as ah, quantile_cont(auprc, 0.025) as pl, quantile_cont(auprc, 0.975) as ph, count(*) as k from it group by 1, 2) "
    "select split, method, n_pos, n_neg, round(auroc, 6) as auroc, round(auprc, 6) as auprc, "
    + ", ".join(f"round(case when n_pos = 0 or n_neg = 0 then null when coalesce(k, 0) < 10 then {m} else {e} end, 6) as {m}_{o}" for m, e, o in (("auroc", "al", "lo"), ("auroc", "ah", "hi"), ("auprc", "pl", "lo"), ("auprc", "ph", "hi")))
    + " from pt left join v using (split, method)",
)
def _(spark, d):
    m = bootstrap.metric_rows_with_intervals(scores(spark, d))
    return m.select("split", "method", "n_pos", "n_neg", *[r6(c).alias(c) for c in ("auroc", "auprc", "auroc_lo", "auroc_hi", "auprc_lo", "auprc_hi")])


def _four(c: str) -> str:
    return f"floor({c} * 10000 + 0.5) / 10000"


@query(
    "result_table",
    f"with m as ({ORACLES['metric_rows_ci']}) select split || ' & ' || method || ' & ' || printf('%.4f', {_four('auroc')}) || ' & ' || case when auroc_lo is null then '[N/A]' else printf('[%.4f, %.4f]', {_four('auroc_lo')}, {_four('auroc_hi')}) end "
    f"|| ' & ' || printf('%.4f', {_four('auprc')}) || ' & ' || case when auprc_lo is null then '[N/A]' else printf('[%.4f, %.4f]', {_four('auprc_lo')}, {_four('auprc_hi')}) end || ' ' || chr(92) || chr(92) as line from m",
)
def _(spark, d):
    """Rows of the results' table with intervals as text; halves are rounded up before they are printed, as engines print halves differently."""
    m = QUERIES["metric_rows_ci"](spark, d)
    m = m.withColumn("known", (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).withColumns({c: F.expr(_four(c)) for c in ("auroc", "auroc_lo", "auroc_hi", "auprc", "auprc_lo", "auprc_hi")})
    m = m.withColumns({f"{c}_ci": interval_text(f"{c}_lo", f"{c}_hi", "known") for c in ("auroc", "auprc")})
    return latex_rows(m, ["split", "method", "auroc", "auroc_ci", "auprc", "auprc_ci"])


@query(
    "detection_bin_ci",
    SCORES_SQL.replace("with u as", "with recursive u as", 1) + f", bs as (select *, {BIN_SQL} as bin_lo from (select *, (id % 100) / 99.0::double as s from scores where y = 1)), cl as (select split, method, bin_lo, score >= 0.5 as hit, count(*) as n from bs group by 1, 2, 3, 4)"
    + draws_sql("cl", "split, method, bin_lo", "hit")
    + ", r as (select split, method, bin_lo, iter, sum(hit::int * times) / sum(times)::double as rate from drawn group by 1, 2, 3, 4), "
    "e as (select split, method, bin_lo, quantile_cont(rate, 0.025) as lo, quantile_cont(rate, 0.975) as hi from r group by 1, 2, 3) "
    "select b.split, b.method, b.bin_lo, round(avg((score >= 0.5)::int), 6) as detection_rate, count(*) as n_samples, round(min(lo), 6) as ci_lower, round(min(hi), 6) as ci_upper from bs b join e using (split, method, bin_lo) group by 1, 2, 3",
)
def _(spark, d):
    sims = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100 / 99.0).alias("similarity"))
    i = bootstrap.detection_intervals(scores(spark, d), sims, CONFIG.divergence_bounds)
    return i.select("split", "method", "bin_lo", r6("detection_rate").alias("detection_rate"), "n_samples", r6("ci_lower").alias("ci_lower"), r6("ci_upper").alias("ci_upper"))


@query(
    "detection_by_identity",
    SCORES_SQL + ", s as (select split, method, score, (id % 100) / 99.0::double as s from scores where y = 1) select split, method, case when s >= 1 then 1.0 when s >= 0.9 then 0.9 when s >= 0.7 then 0.7 when s >= 0.5 then 0.5 when s >= 0.3 then 0.3 when s >= 0.2 then 0.2 else 0.0 end::double as bin_lo, round(avg((score >= 0.5)::int), 6) as detection_rate, count(*) as n_samples from s group by 1, 2, 3",
)
def _(spark, d):
    sims = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100 / 99.0).alias("similarity"))
    b = metrics.detection_by_bin(scores(spark, d), sims, CONFIG.identity_bounds)
    return b.select("split", "method", "bin_lo", r6("detection_rate").alias("detection_rate"), "n_samples")


@query("held_out_detection", SCORES_SQL + "select method, round(avg((score >= 0.5)::int), 6) as detection_rate, count(*) as n from scores where y = 1 group by 1")
def _(spark, d):
    return scores(spark, d).where("y = 1").groupBy("method").agg(r6(F.avg((F.col("score") >= 0.5).cast("double"))).alias("detection_rate"), F.count("*").alias("n"))


# --- learners and certification ----------------------------------------------------------------------------------------


@query("screen_metrics")
def _(spark, d):
    """The flagship: vectors scored by the three methods on vectors, one metric row for each; evaluation_rows has the k-mer method too."""
    from winnow.operators.scorers import embedding_scores

    train, test = vector_parts(spark, d)
    return metrics.metric_rows(embedding_scores(train, test))


@query("linear_scores")
def _(spark, d):
    from winnow.operators.scorers import LinearScreener

    train, test = vector_parts(spark, d)
    return LinearScreener().fit(train).transform(test).select("id", "y", "score")


@query("contrastive_scores")
def _(spark, d):
    from winnow.operators.neural import train_screener

    train, test = vector_parts(spark, d)
    val, fit = train.where("id % 5 = 1"), train.where("id % 5 <> 1")
    return train_screener(fit, val).transform(test).select("id", "y", "score")


@query("ablation_grid")
def _(spark, d):
    from winnow.operators.neural import ablation

    train, test = vector_parts(spark, d)
    return ablation(train, test, {"projection_dim": [128, 256, 512, 1024], "negatives": [1, 3, 5], "temperature": [0.05, 0.07, 0.1, 0.2], "multi_scale": [True], "use_mixup": [True]})


@query("certification_grid")
def _(spark, d):
    from winnow.operators.certify import certification_grid, word_share_scorer

    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(1).alias("y"))
    return certification_grid(items, word_share_scorer("e"), groups={"vowels": "aeiou"}, kinds=["grouped", "random"], counts=[1, 2, 3, 5, 8, 10])


@query("pca_map")
def _(spark, d):
    from winnow.operators.scorers import pca_map

    return pca_map(vectors(spark, d))


@query("neighbour_graph")
def _(spark, d):
    from winnow.operators.neighbour_map import neighbour_graph

    return neighbour_graph(vectors(spark, d))


@query("neighbour_map")
def _(spark, d):
    from winnow.operators.neighbour_map import neighbour_map

    return neighbour_map(vectors(spark, d))


@query("train_auroc")
def _(spark, d):
    from winnow.operators.scorers import NeighbourScreener, train_auroc

    train, _ = vector_parts(spark, d)
    return train_auroc(NeighbourScreener().fit(train), train)


@query("ngram_embeddings")
def _(spark, d):
    from winnow.operators.embedders import HashedNgrams, embedded

    return embedded(table(spark, d, "documents").select("doc_id", "text"), HashedNgrams()).select("doc_id", "embedding")


@query("saved_embeddings")
def _(spark, d):
    """Vectors of whole texts, written and read back."""
    from winnow.operators.embedders import HashedNgrams, embed_and_save

    return embed_and_save(table(spark, d, "documents"), HashedNgrams(), new_path(spark, "embeddings"), key="doc_id", most=None)


@query("attention_positions")
def _(spark, d):
    """Positions that attention pooling weighs most, over hidden states of the benchmark's texts."""
    from winnow.operators.embedders import HashedNgrams, hidden_states
    from winnow.operators.neural import AttentionPool

    states = hidden_states(table(spark, d, "benchmark"), HashedNgrams(16)).select("item_id", "states")
    pooled = AttentionPool.drawn(16).transform(states)
    return pooled.select("item_id", F.explode(T.top_positions("attention")).alias("top")).select("item_id", "top.pos", "top.weight")


# --- ingest and small expressions --------------------------------------------------------------------------------------


@query(
    "curated_entries",
    "select 'e' || doc_id as id, case when doc_id % 3 <> 0 then 'n' || doc_id else 'e' || doc_id end as name, n_chars::int as length, case when doc_id % 4 <> 0 then lang else 'Unknown' end as organism, 'f' || (doc_id % 5) as families, 't' || (doc_id % 7) || ':' || source || '|u:' as terms, source as description "
    "from documents where doc_id % 50 <> 7 and n_chars between 50 and 2000",
)
def _(spark, d):
    e = within_length(parse_entries(entries_of(raw_entries(spark, d))))
    return e.select("id", "name", "length", "organism", F.array_join("family_ids", "|").alias("families"), F.array_join("terms", "|").alias("terms"), "description")


@query("capped_per_source", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 5")
def _(spark, d):
    return capped(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query("appended_vectors", "select vec_id as id, case when label = 0 or vec_id % 5 = 1 then 1 else 0 end as y from embeddings where vec_id % 5 <> 0")
def _(spark, d):
    train, test = vector_parts(spark, d)
    return append_positives(train.where("id % 5 <> 1").select("id", "y"), train.where("id % 5 = 1").select("id"), held_out=test)


@query(
    "paged_entries",
    "select source as query, ((rn - 1) // 40)::int as page, ((rn - 1) % 40)::int as place, 'e' || doc_id as id, true as complete from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 100",
)
def _(spark, d):
    """Entries landed as pages of forty for each source, read as a paged service would be, at most a hundred of a source."""
    docs = numbered(table(spark, d, "documents").select("source", "doc_id", F.to_json(F.struct(F.concat(F.lit("e"), "doc_id").alias("id"), "lang", "text")).alias("entry")), ["source"], [F.col("doc_id").asc()])
    pages = docs.groupBy(F.col("source").alias("query"), F.expr("cast(pos div 40 as int)").alias("page")).agg(F.sort_array(F.collect_list(F.struct("pos", "entry"))).alias("e"))
    path = new_path(spark, "landed-pages")
    pages.select("query", "page", F.transform("e", lambda x: x["entry"]).alias("entries")).repartitionByRange("query", "page").sortWithinPartitions("query", "page").write.parquet(path)
    sources = [r[0] for r in table(spark, d, "documents").select("source").distinct().collect()]  # the questions that a service is asked
    return read_pages(spark, sources, LandedPages(path), limit=100, wait=0, pace=0).select("query", "page", "place", F.get_json_object("entry", "$.id").alias("id"), "complete")


CURATED_DOCS = (
    "dd as (select 'e' || doc_id as doc_id, text, lang, source from documents where doc_id % 50 <> 7 and n_chars between 50 and 2000), "
    "ll as (select 'e' || l.doc_id as doc_id, toxic, case when source in ('src1', 'src2', 'src3') then 0 else 1 end as quality from labels l join documents d on l.doc_id = d.doc_id), "
)


@query("curated_splits", SPLITS_SQL.replace("documents d", "dd d").replace("labels l", "ll l").replace("with p as", f"with {CURATED_DOCS} p as", 1).replace("case when kind = 'positive' then lang end as stratum", "null::varchar as stratum") + "select doc_id as id, o.split, o.toxic as y, dd.source as subcategory, dd.source in ('src1', 'src2', 'src3') as is_hard_negative from o join dd using (doc_id)")
def _(spark, d):
    """The whole curation: labelled entries, some of which come again from a later query, to splits that are read back."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    raw = raw_entries(spark, d).select(F.coalesce(F.get_json_object("value", "$.id"), F.lit("")).alias("id"), "value")
    known = docs.join(table(spark, d, "labels"), "doc_id").select(F.concat(F.lit("e"), "doc_id").alias("id"), F.col("toxic").alias("y"), F.col("source").alias("subcategory"))
    first = known.join(raw, "id").withColumns({"query_ord": F.lit(0), "row_ord": F.col("id")})
    again = first.where("y = 1").withColumns({"query_ord": F.lit(1), "y": F.lit(0), "subcategory": F.lit("later")})
    done = curate(first.unionByName(again), new_path(spark, "curation"), ["src1", "src2", "src3"], items=T.shingles("text", 3), strata=None, small="reuse")
    return done.split_rows(spark).select("id", "split", "y", "subcategory", "is_hard_negative")


@query(
    "text_functions",
    f"with p as (select p_partkey, p_size, 'id=' || p_partkey || case when p_partkey % 7 = 0 then ', score=x' when p_partkey % 5 = 0 then '' else ', score=' || p_size || '.5' end as header, {kmers_sql('p_name', 3)} as a, {kmers_sql('p_type', 3)} as b, case when p_partkey % 3 = 0 then null else p_size / 50.0::double end as s from part) "
    "select p_partkey, round(case when len(list_distinct(a || b)) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(a || b))::double end, 6) as jaccard, coalesce(try_cast(nullif(regexp_extract(header, '(?:^|[ ,])score=(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') as double), 0) as score, coalesce(s, 1) as identity, "
    "case when coalesce(s, 1) >= 0.9 then '>90%' when coalesce(s, 1) >= 0.7 then '70%-90%' when coalesce(s, 1) >= 0.5 then '50%-70%' when coalesce(s, 1) >= 0.3 then '30%-50%' when coalesce(s, 1) >= 0.2 then '20%-30%' else '<20%' end as identity_label, "
    "case when coalesce(s, 1) >= 1 then '[1.0, 1.0)' when coalesce(s, 1) >= 0.7 then '[0.7, 1.0)' when coalesce(s, 1) >= 0.5 then '[0.5, 0.7)' when coalesce(s, 1) >= 0.3 then '[0.3, 0.5)' when coalesce(s, 1) >= 0.2 then '[0.2, 0.3)' when coalesce(s, 1) >= 0.1 then '[0.1, 0.2)' else '[0.0, 0.1)' end as bin_label from p",
)
def _(spark, d):
    number = F.when(F.col("p_partkey") % 7 == 0, ", score=x").when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(", score="), "p_size", F.lit(".5")))
    p = table(spark, d, "part").withColumn("header", F.concat(F.lit("id="), "p_partkey", number))
    p = p.withColumn("identity", T.filled(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50)))
    lo, hi = metrics.similarity_bin(F.col("identity"), CONFIG.divergence_bounds)
    return p.select("p_partkey", r6(T.set_jaccard(T.kmers("p_name", 3), T.kmers("p_type", 3))).alias("jaccard"), T.header_number("header", "score").alias("score"), "identity", T.identity_label("identity", CONFIG.identity_bounds).alias("identity_label"), T.bin_label(lo, hi).alias("bin_label"))


FIVE = "list_slice(embedding, 1, 5)"


@query(
    "vector_functions",
    f"with v as (select vec_id as id, [x::double for x in {FIVE}] as a, [x::double for x in list_slice(embedding, 6, 10)] as b from embeddings) "
    "select id, round(exp(a[1] - list_max(a)) / list_sum([exp(x - list_max(a)) for x in a]), 6) as softmax_first, round(1 / (1 + exp(-a[1])), 6) as sigmoid_first, "
    f"len(a || b) as joined_width, round({cos_sql('a', 'b')}, 6) as cosine, round(a[1] / (sqrt({DOT.format(a='a', b='a')}) + 1e-8), 6) as unit_first, round(0.3 * a[2] + 0.7 * b[2], 6) as between_second, "
    "(select string_agg(i - 1, ',' order by a[i] desc, i) from (select unnest(range(1, 6)) as i) where (select count(*) from (select unnest(range(1, 6)) as k) where a[k] > a[i] or (a[k] = a[i] and k < i)) < 3) as top_three from v",
)
def _(spark, d):
    v = vectors(spark, d).select("id", F.slice("embedding", 1, 5).alias("a"), F.slice("embedding", 6, 5).alias("b"))
    top = F.array_join(F.transform(T.top_positions("a", 3), lambda x: x["pos"].cast("string")), ",")
    return v.select("id", r6(V.softmax("a")[0]).alias("softmax_first"), r6(V.sigmoid(F.col("a")[0].cast("double"))).alias("sigmoid_first"), F.size(V.joined("a", "b")).cast("long").alias("joined_width"), r6(V.cosine("a", "b")).alias("cosine"), r6(V.unit("a", 1e-8)[0]).alias("unit_first"), r6(V.interpolate("a", "b", 0.3)[1]).alias("between_second"), top.alias("top_three"))


@query("best_epoch", "with h as (select o_orderkey % 40 as epoch, avg(o_totalprice::double) as loss, case when o_orderkey % 40 % 7 = 3 then null else avg(o_totalprice::double) end as metric from orders group by 1, o_orderkey % 40 % 7) select epoch, round(metric, 4) as metric from h where metric is not null order by h.metric desc, epoch limit 1")
def _(spark, d):
    """The epoch with the greatest mean, of those that have one; every seventh has none."""
    from winnow.operators.neural import best_epoch

    epoch = F.col("o_orderkey") % 40
    means = table(spark, d, "orders").groupBy(epoch.alias("epoch")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("metric"))
    history = means.withColumn("metric", F.when(F.col("epoch") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("metric")))
    return best_epoch(history, "metric").select("epoch", F.round("metric", 4).alias("metric"))


@query("hourly_alerts", "select time_bucket(interval 1 hour, ts) as hour, event_type, round(avg((value >= 50)::int), 6) as alert_rate, count(*) as n from events group by 1, 2")
def _(spark, d):
    from winnow.streaming.scoring import alert_rates

    a = alert_rates(table(spark, d, "events"), 50.0)
    return a.select(F.col("w.start").alias("hour"), "event_type", r6("alert_rate").alias("alert_rate"), "n")
