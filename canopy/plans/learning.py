"""Queries of embeddings, metrics, n-lets and constraint graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators import filters, graph, metrics, mining, nlets, vectors
from canopy.plans.registry import query
from canopy.sources.scratch import Scratch
from canopy.sources.views import Views

ID = "tracking_frame_feature_id"


def _rows(v: Views) -> DataFrame:
    return v.vectors.withColumnRenamed("vec_id", "id")


def _val(v: Views) -> DataFrame:
    return _rows(v).where("partition = 'val'")


@query("select a.id as a, b.id as b, round(list_distance(a.v, b.v), 6) as d from vec a join vec b on a.fold = b.fold and a.id < b.id where a.label = b.label")
def pairwise_l2(v: Views) -> DataFrame:
    a, b = (_rows(v).select(F.col("id").alias(n), "fold", "label", F.col("v").alias(f"v{n}")) for n in "ab")
    return a.join(b, ["fold", "label"]).where("a < b").select("a", "b", F.round(F.sqrt(vectors.squared_l2(F.col("va"), F.col("vb"))), 6).alias("d"))


@query("select a.id as a, b.id as b, round(greatest(0, least(1, (1-list_cosine_similarity(a.v, b.v))/2)), 6) as d from vec a join vec b on a.fold = b.fold and a.id < b.id where a.label = b.label")
def pairwise_angular(v: Views) -> DataFrame:
    a, b = (_rows(v).select(F.col("id").alias(n), "fold", "label", F.col("v").alias(f"v{n}")) for n in "ab")
    return a.join(b, ["fold", "label"]).where("a < b").select("a", "b", F.round(vectors.angular(F.col("va"), F.col("vb")), 6).alias("d"))


_NEAR = "select id, i as rank, neighbour, round(d, 6) as d from (select a.id, b.id as neighbour, {d} as d, row_number() over (partition by a.id order by {d}, b.id) as i from vec a join vec b on a.id <> b.id where a.partition = 'val' and b.partition = 'val') where i <= 5"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("id", F.col("rank").cast("bigint").alias("rank"), "neighbour", F.round("d", 6).alias("d"))


@query(_NEAR.format(d="list_distance(a.v, b.v)"))
def knn_topk(v: Views) -> DataFrame:
    return _rounded(vectors.nearest(_val(v), _val(v), 5))


@query(_NEAR.format(d="1 - list_cosine_similarity(a.v, b.v)"))
def knn_cos(v: Views) -> DataFrame:
    return _rounded(vectors.nearest(_val(v), _val(v), 5, "cosine"))


def _knn_sql(k: int, average: str = "weighted", d: str = "list_distance(a.v, b.v)", train: bool = False, cross: bool = False, few: bool = False, fold: int | None = None) -> str:
    pool = "true" if train else "partition = 'val'" if fold is None else f"partition = 'val' and fold = {fold}"
    scored = "select id, label from pool where partition = 'val'"
    if cross:
        scored = f"select id, label from (select *, count(*) over (partition by label) - count(*) over (partition by individual_video_id) as n from vec where {pool}) where n >= 3 and partition = 'val'"
    if few:
        scored = f"select id, label from ({scored}) where label in (select label from vec where partition = 'val' group by 1 having count(*) >= {k // 2 + 2})"
    weight = "support" if average == "weighted" else "1"
    mean = lambda x: f"round(sum({x}*{weight})/sum({weight}), 6)"
    top = "accuracy" if k < 5 else "(select round(avg(cast(hit as int)), 6) from hits)"
    return f"""with pool as (select * from vec where {pool}),
near as (select a.id, b.label as said, row_number() over (partition by a.id order by {d}, b.id) as i from pool a join pool b on a.id <> b.id {'and a.individual_video_id <> b.individual_video_id' if cross else ''} where a.partition = 'val'),
votes as (select id, said, count(*) as n, min(i) as f from near where i <= {k} group by 1, 2),
ranked as (select *, row_number() over (partition by id order by n desc, f) as place from votes),
pred as (select id, said from ranked where place = 1),
scored as ({scored}),
rows as (select s.id, s.label, p.said from scored s join pred p using (id)),
hits as (select r.id, max(cast(n.said = r.label and n.place <= 5 as int)) as hit from rows r join ranked n on n.id = r.id group by 1),
cls as (select distinct label as c from rows union select said from rows),
conf as (select c, count(*) filter (where label = c) as support, count(*) filter (where label = c and said = c) as tp, count(*) filter (where said = c and label <> c) as fp from cls, rows group by 1),
each as (select support, coalesce(tp/nullif(support, 0), 0) as recall, coalesce(tp/nullif(tp+fp, 0), 0) as precision, coalesce(2*tp/nullif(support+tp+fp, 0), 0) as f1 from conf),
out as (select {mean('recall')} as accuracy, {mean('f1')} as f1, {mean('precision')} as precision from each)
select accuracy, {top} as accuracy_top5, f1, precision from out"""


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) for c in df.columns))


def _knn(name: str, k: int, sql: dict, **how) -> None:
    query(_knn_sql(k, **sql), name=name)(lambda v: _round_all(metrics.knn(_rows(v), k, **how)))


_COS = "1 - list_cosine_similarity(a.v, b.v)"
_knn("knn", 1, {})
_knn("knn5", 5, {})
_knn("knn9", 9, {})
_knn("knn5_macro", 5, {"average": "macro"}, average="macro")
_knn("knn5_cos", 5, {"d": _COS}, metric="cosine")
_knn("knn_with_train", 5, {"train": True}, with_train=True)
_knn("knn_crossvideo", 5, {"cross": True}, cross_video=True)
_knn("knn_filter", 5, {"few": True}, use_filter=True)


_GRID = [(m, k, a) for m in ("euclidean", "cosine") for k in (1, 5) for a in ("weighted", "macro")]


@query(" union all ".join(f"select '{m}' as metric, {k} as k, '{a}' as average, * from ({_knn_sql(k, a, **({'d': _COS} if m == 'cosine' else {}))})" for m, k, a in _GRID))
def knn_grid(v: Views) -> DataFrame:
    out = metrics.knn_grid(_rows(v), Scratch(v.spark, "knn"))
    return out.select("metric", "k", "average", *(F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_top5", "f1", "precision")))


_FOLDS = " union all ".join(f"select accuracy, f1, precision from ({_knn_sql(5, fold=f)})" for f in range(4))


@query(f"select round(avg(accuracy), 5) as accuracy, round(avg(f1), 5) as f1, round(avg(precision), 5) as precision from ({_FOLDS})")
def knn_kfold(v: Views) -> DataFrame:
    return metrics.knn_folds(_rows(v)).select(*(F.round(c, 5).alias(c) for c in ("accuracy", "f1", "precision")))


@query("""with near as (select a.id, a.label, b.label as said, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as i from vec a join vec b on a.id <> b.id and (b.label = a.label or b.label = (a.label + 1) % 10)),
votes as (select id, label, said, count(*) as n from near where i <= 5 group by all)
select id, label, said as predicted, hit5 from (select *, row_number() over (partition by id order by n desc, said) as r from votes) join (select id, max(cast(said = label as int)) as hit5 from near where i <= 5 group by 1) using (id) where r = 1""")
def knn_ssl(v: Views) -> DataFrame:
    rows = _rows(v).select("id", "label", "v")
    neg = rows.select("label").distinct().select("label", ((F.col("label") + 1) % 10).alias("negative"))
    return metrics.knn_negatives(rows, neg, 5)


@query("""with near as (select a.id, b.label as said, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as i from vec a join vec b on a.id <> b.id where a.partition = 'val' and b.partition = 'val'),
s as (select r.id, r.label, c.c, count(n.said) as n from (select id, label from vec where partition = 'val') r cross join (select distinct label as c from vec where partition = 'val') c left join near n on n.id = r.id and n.said = c.c and n.i <= 5 group by all),
each as (select p.c, avg(case when p.n > q.n then 1.0 when p.n = q.n then 0.5 else 0.0 end) as auc from s p join s q on p.c = q.c where p.label = p.c and q.label <> q.c group by 1)
select round(avg(auc), 6) as auroc from each""")
def knn_auroc(v: Views) -> DataFrame:
    own = _val(v)
    return _round_all(metrics.auroc(metrics.votes(vectors.nearest(own, own, 5), own), own))


@query("select label, count(*) as support, count(*) filter (where label = said) as tp, count(*) filter (where label <> said) as fn from (select label, (id * 7) % 10 as said from vec) group by 1")
def cls_metrics(v: Views) -> DataFrame:
    return metrics.confusion(_rows(v).select("label", ((F.col("id") * 7) % 10).cast("int").alias("predicted"))).select("label", "support", "tp", "fn")


@query("""with near as (select a.id, a.label, b.id as neighbour, b.label as said, row_number() over (partition by a.id order by list_distance(a.v, b.v), b.id) as i from vec a join vec b on a.id <> b.id where a.partition = 'val' and b.partition = 'val'),
votes as (select id, label, said, count(*) as n, min(i) as f from near where i <= 5 group by all),
pred as (select * from (select *, row_number() over (partition by id order by n desc, f) as r from votes) where r = 1)
select p.id, p.label, p.said as predicted, (select string_agg(cast(neighbour as varchar), ',' order by i) from near n where n.id = p.id and i <= 5) as neighbours from pred p where p.said <> p.label""")
def misclassified(v: Views) -> DataFrame:
    own = _val(v)
    out = metrics.misclassified(vectors.nearest(own, own, 5), own, 5)
    return out.select("id", "label", "predicted", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("select label, round(avg(v[1]), 6) as x1, round(avg(v[64]), 6) as x64 from vec group by 1")
def prototypes(v: Views) -> DataFrame:
    return vectors.prototypes(_rows(v)).select("label", F.round(F.col("v")[0], 6).alias("x1"), F.round(F.col("v")[63], 6).alias("x64"))


@query("""with e as (select label, generate_subscripts(v, 1) as p, unnest(v) as x from vec), m as (select label, p, avg(x) as x from e group by 1, 2), c as (select label, list(x order by p) as m from m group by 1),
s as (select vec.id, vec.label, c.label as predicted, list_cosine_similarity(v, m) as s from vec, c),
r as (select *, row_number() over (partition by id order by s desc, predicted) as i, sum(exp(64*s)) over (partition by id) as t from s)
select id, label, predicted, round(exp(64*s)/t, 6) as probability from r where i = 1""")
def proto_classify(v: Views) -> DataFrame:
    return vectors.classify_by_prototype(_rows(v)).withColumn("probability", F.round("probability", 6))


@query("""with e as (select label, generate_subscripts(v, 1) as p, unnest(v) as x from vec), m as (select label, p, avg(x) as x from e group by 1, 2), c as (select label, list(x order by p) as m from m group by 1),
s as (select vec.id, vec.label, c.label as l, 64 * list_cosine_similarity(v, m) as s from vec, c),
r as (select id, max(s) filter (where l = label) as own, max(s) as top from s group by 1)
select round(avg(x), 5) as loss from (select r.id, any_value(top) + ln(sum(exp(s - top))) - any_value(own) as x from r join s using (id) group by 1)""")
def proto_loss(v: Views) -> DataFrame:
    return vectors.prototype_loss(_rows(v)).select(F.round("loss", 5).alias("loss"))


@query("""with r as (select *, id // 32 as b, row_number() over (partition by id // 32 order by id) as i, row_number() over (partition by id // 32 order by (id*2654435761+3)%4294967296, id) as j from vec)
select p.id, q.id as partner, p.label, q.label as other, round(0.25*p.v[1] + 0.75*q.v[1], 6) as x1, round(0.25*p.v[64] + 0.75*q.v[64], 6) as x64 from r p join r q on p.b = q.b and p.i = q.j""")
def mixup(v: Views) -> DataFrame:
    out = vectors.mixup(_rows(v), 0.25, 32, 3)
    return out.select("id", "partner", "label", "other", F.round(F.col("v")[0], 6).alias("x1"), F.round(F.col("v")[63], 6).alias("x64"))


_UNIT = "u as (select *, [x / sqrt(list_inner_product(v, v)) for x in v] as w from vec)"
_NEAR9 = "n as (select id, neighbour from (select a.id, b.id as neighbour, list_distance(a.w, b.w) as d, row_number() over (partition by a.id order by list_distance(a.w, b.w), b.id) as i from u a join u b on a.id <> b.id) where i <= 8 and d*d < 1.2)"


@query(f"""with recursive {_UNIT}, {_NEAR9}, e as (select id as a, neighbour as b from n union select neighbour, id from n),
r as (select id as a, id as b from vec union select r.a, e.b from r join e on r.b = e.a),
c as (select a as id, min(b) as root from r group by 1)
select id, root, row_number() over (partition by root order by id) <= 5 as kept from c""")
def dedup_self(v: Views) -> DataFrame:
    return vectors.self_duplicates(_rows(v), 1.2)


@query(f"""with {_UNIT} select a.id from u a where a.partition = 'val' and not exists (select 1 from u b where b.partition = 'train' and list_distance(a.w, b.w)*list_distance(a.w, b.w) < 1.2)""")
def dedup_relative(v: Views) -> DataFrame:
    return vectors.without_near(_val(v), _rows(v).where("partition = 'train'"), 1.2).select("id")


# --- triplets -----------------------------------------------------------------------------------------------------

#: Ids in a batch of triplets. The loss is that of batches, and the batches cover the whole table.
_BATCH = 50
_TRIPLE = f"""t as (select a.id as a, p.id as p, n.id as n, a.individual_video_id as av, p.individual_video_id as pv, list_distance(a.v, p.v) as d_ap, list_distance(a.v, n.v) as d_an from vec a join vec p on a.id // {_BATCH} = p.id // {_BATCH} and a.label = p.label and a.id <> p.id join vec n on n.id // {_BATCH} = a.id // {_BATCH} and n.label <> a.label)"""
_LOSS = "select count(*) as n, round(coalesce(sum(greatest(0, d_ap-d_an+0.5)), 0)/(count(*)+1e-16), 6) as loss, round(coalesce(sum(d_ap), 0)/(count(*)+1e-16), 6) as d_p, round(coalesce(sum(d_an), 0)/(count(*)+1e-16), 6) as d_n from"


def _triplets(v: Views, kind: str = "soft", cross_video: str | None = None) -> DataFrame:
    return vectors.triplets(_rows(v), 0.5, kind, cross_video, _BATCH)


def _loss(found: DataFrame) -> DataFrame:
    out = vectors.triplet_loss(found, 0.5)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("loss", "d_p", "d_n")))


@query(f"with {_TRIPLE} select a, p, n from t")
def triplets(v: Views) -> DataFrame:
    return _triplets(v).select("a", "p", "n")


@query(f"with {_TRIPLE} {_LOSS} t")
def triplet_soft(v: Views) -> DataFrame:
    return _loss(_triplets(v))


@query(f"with {_TRIPLE} {_LOSS} t where d_an - d_ap > 0 and d_an - d_ap < 0.5")
def triplet_semi(v: Views) -> DataFrame:
    return _loss(_triplets(v, "semi"))


@query(f"with {_TRIPLE}, h as (select a, max(d_ap) as d_ap, min(d_an) as d_an from t group by 1) {_LOSS} h")
def triplet_hard(v: Views) -> DataFrame:
    return _loss(_triplets(v, "hard"))


@query(f"with {_TRIPLE} {_LOSS} t where av <> pv")
def triplet_xvideo(v: Views) -> DataFrame:
    return _loss(_triplets(v, cross_video="individual_video_id"))


@query("select a.id, round(greatest(0, list_distance(a.v, p.v) - list_distance(a.v, n.v) + 1), 6) as loss from vec a join vec p on p.id = a.id + 100 join vec n on n.id = a.id + 200")
def triplet_offline(v: Views) -> DataFrame:
    a = _rows(v).select("id", "v")
    p, n = (_rows(v).select((F.col("id") - k).alias("id"), F.col("v").alias(c)) for k, c in ((100, "p"), (200, "n")))
    d = lambda c: F.sqrt(vectors.squared_l2(F.col("v"), F.col(c)))
    return a.join(p, "id").join(n, "id").select("id", F.round(F.greatest(F.lit(0.0), d("p") - d("n") + 1), 6).alias("loss"))


@query()
def pca(v: Views) -> DataFrame:
    """The plane of the two leading principal components, from second moments that are summed up by position."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _rows(v).select("id", array_to_vector("v").alias("x"))
    out = PCA(k=2, inputCol="x", outputCol="y").fit(rows).transform(rows)
    return out.select("id", vector_to_array("y")[0].alias("x"), vector_to_array("y")[1].alias("y"))


# --- encodings ------------------------------------------------------------------------------------------------------


@query("select vec_id, dense_rank() over (order by f) - 1 as code from (select vec_id, min(vec_id) over (partition by label) as f from emb)")
def label_encode(v: Views) -> DataFrame:
    first = v.emb.groupBy("label").agg(F.min("vec_id").alias("f"))
    codes = mining.with_rank(first, "f").select("label", (F.col("rank") - 1).alias("code"))
    return v.emb.select("vec_id", "label").join(codes, "label").select("vec_id", "code")


@query("select vec_id, unnest(range(0, 10)) as pos, cast(unnest(range(0, 10)) = label as int) as hot from emb")
def one_hot(v: Views) -> DataFrame:
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("int"))
    return v.emb.select("vec_id", F.posexplode(hot).alias("pos", "hot")).withColumn("pos", F.col("pos").cast("bigint"))


@query("select vec_id, r // 32 as batch from (select vec_id, row_number() over (order by vec_id) - 1 as r, count(*) over () as n from emb) where r // 32 < n // 32")
def batching(v: Views) -> DataFrame:
    ranked = mining.with_rank(v.emb.select("vec_id"), "vec_id")
    return nlets.batches(ranked, F.col("rank") - 1, 32, True, v.emb.count()).select("vec_id", "batch")


@query("select vec_id, 'a' as role, 0 as pos from emb union all select vec_id + 1, 'p', 1 from emb")
def flatten_batch(v: Views) -> DataFrame:
    one = v.emb.select(F.array(F.struct(F.col("vec_id").alias("i"), F.lit("a").alias("role")), F.struct((F.col("vec_id") + 1).alias("i"), F.lit("p").alias("role"))).alias("x"))
    return one.select(F.posexplode("x").alias("pos", "s")).select(F.col("s.i").alias("vec_id"), F.col("s.role").alias("role"), "pos")


@query("select vec_id as id, label, cast(label as varchar) as label_string, len(embedding) as dim from emb")
def emb_table(v: Views) -> DataFrame:
    return v.emb.select(F.col("vec_id").alias("id"), "label", F.col("label").cast("string").alias("label_string"), F.size("embedding").cast("bigint").alias("dim"))


@query("select distinct a.label, b.label as negative from emb a, emb b where a.label <> b.label")
def negative_classes(v: Views) -> DataFrame:
    own = v.emb.select("label").distinct()
    every = own.agg(F.sort_array(F.collect_set("label")).alias("l"))  # labels are few
    return own.join(F.broadcast(every)).select("label", F.explode("l").alias("negative")).where("label <> negative")


# --- n-lets ---------------------------------------------------------------------------------------------------------

_H = "({c}*2654435761+{s})%4294967296"
_POS = f"num as (select id, label, individual_video_id, row_number() over (partition by label order by {_H.format(c='id', s=0)}, id) - 1 as i, count(*) over (partition by label) as n from vec), pos as (select a.id, b.id as positive from num a join num b on a.label = b.label and b.i = (a.i + case when a.n > 1 then 1 + {_H.format(c='a.id', s=1)} % greatest(a.n - 1, 1) else 0 end) % a.n)"
_NEG = f"grp as (select label, row_number() over (order by min(id)) - 1 as g, count(*) as m, count(*) over () as k from vec group by 1), neg as (select a.id, b.id as negative from num a join grp ga on ga.label = a.label join grp gb on gb.g = (ga.g + 1 + {_H.format(c='a.id', s=2)} % (ga.k - 1)) % ga.k join num b on b.label = gb.label and b.i = {_H.format(c='a.id', s=3)} % gb.m)"


@query("select id from vec")
def nlet_onelet(v: Views) -> DataFrame:
    return nlets.onelets(_rows(v))


@query(f"with {_POS} select * from pos")
def nlet_pair(v: Views) -> DataFrame:
    return nlets.pairs(_rows(v))


@query(f"with {_POS}, {_NEG} select id, positive, negative from pos join neg using (id)")
def nlet_triplet(v: Views) -> DataFrame:
    return nlets.triplets(_rows(v))


@query(f"with {_POS}, {_NEG} select pos.id, pos.positive, neg.negative as anchor_negative, q.positive as negative from pos join neg using (id) join pos q on q.id = neg.negative")
def nlet_quadlet(v: Views) -> DataFrame:
    return nlets.quadlets(_rows(v))


_PLACED = f"o as (select id, label, individual_video_id as vid, row_number() over (partition by label order by individual_video_id, {_H.format(c='id', s=0)}, id) - 1 as i, count(*) over (partition by label) as n, count(*) over (partition by label, individual_video_id) as m from vec), placed as (select *, min(i) over (partition by label, vid) as f, {_H.format(c='id', s=1)} as h from o)"


@query(f"with {_PLACED} select a.id, b.id as positive from placed a join placed b on a.label = b.label and b.i = case when a.m < a.n then (a.f + a.m + a.h % greatest(a.n - a.m, 1)) % a.n when a.n > 1 then (a.i + 1 + a.h % greatest(a.n - 1, 1)) % a.n else a.i end")
def nlet_xenc(v: Views) -> DataFrame:
    return nlets.cross_encounter(_rows(v))


@query("select id from vec where label in (select label from vec group by 1 having count(distinct individual_video_id) > 1)")
def nlet_hard_xenc(v: Views) -> DataFrame:
    return nlets.cross_encounter(_rows(v), hard=True).select("id")


_OTHER = f"grp as (select label, label % 2 as origin, row_number() over (partition by label % 2 order by min(id)) - 1 as g, count(*) as m, count(*) over (partition by label % 2) as k from vec group by label)"


@query(f"with {_POS}, {_OTHER} select a.id, b.id as negative from num a join grp ga on ga.label = a.label and ga.k > 1 join grp gb on gb.origin = ga.origin and gb.g = (ga.g + 1 + {_H.format(c='a.id', s=2)} % (ga.k - 1)) % ga.k join num b on b.label = gb.label and b.i = {_H.format(c='a.id', s=3)} % gb.m")
def nlet_species(v: Views) -> DataFrame:
    return nlets.negatives(_rows(v).select("id", "label", (F.col("label") % 2).alias("origin")), within="origin")


# --- graphs -----------------------------------------------------------------------------------------------------------

# Every edge leads to a larger id, at most one from each vertex, so a component is what ends at the same vertex.
_CC = """e as (select tracking_frame_feature_id as a, tracking_frame_feature_id + 1 + tracking_frame_feature_id % 3 as b from tff where tracking_frame_feature_id % 4 <> 0),
p as (select a as vertex, b as reach from e union all select p.vertex, e.b from p join e on e.a = p.reach), ends as (select vertex, max(reach) as top from p group by 1),
c as (select vertex, min(vertex) over (partition by top) as root from (select vertex, top from ends union select top, top from ends))"""


def _merges(v: Views) -> DataFrame:
    return v.tff.where(f"{ID} % 4 <> 0").select(F.col(ID).alias("a"), (F.col(ID) + 1 + F.col(ID) % 3).alias("b"))


@query(f"with recursive {_CC} select vertex, root from c")
def cc(v: Views) -> DataFrame:
    return graph.components(_merges(v))


@query(f"with recursive {_CC} select t.tracking_frame_feature_id as vertex, coalesce(c.root, t.tracking_frame_feature_id) as root from tff t left join c on c.vertex = t.tracking_frame_feature_id")
def clique_merge(v: Views) -> DataFrame:
    return graph.cliques(v.tff.select(F.col(ID).alias("vertex")), _merges(v))


@query(f"with recursive {_CC} select root, min(vertex) as least, count(*) as members from c group by 1")
def clique_rep(v: Views) -> DataFrame:
    return cc(v).groupBy("root").agg(F.min("vertex").alias("least"), F.count("*").alias("members"))


_OWN = "own as (select tracking_id as vertex, video_id*100 + tracking_id % 3 as root from tracking), cuts as (select l.tracking_id as a, r.tracking_id as b from spans l join spans r on l.video_id = r.video_id and l.tracking_id < r.tracking_id and l.f0 <= r.f1 and r.f0 <= l.f1), rc as (select distinct a.root as a, b.root as b from cuts join own a on a.vertex = cuts.a join own b on b.vertex = cuts.b), ways as (select a, b from rc union select b, a from rc)"


def _own(v: Views) -> tuple[DataFrame, DataFrame]:
    own = v.tracking.select(F.col("tracking_id").alias("vertex"), (F.col("video_id") * 100 + F.col("tracking_id") % 3).alias("root"))
    return own, mining.overlapping_trackings(v.tff).toDF("a", "b")


@query(f"with {_OWN} select * from ways")
def clique_cut(v: Views) -> DataFrame:
    return graph.root_cuts(*_own(v))


@query(f"with {_OWN} select cuts.a, cuts.b from cuts join own a on a.vertex = cuts.a join own b on b.vertex = cuts.b where a.root = b.root")
def clique_conflict(v: Views) -> DataFrame:
    return graph.conflicts(*_own(v))


@query(f"with {_OWN} select a as root, count(distinct b) as neighbours from ways group by 1")
def clique_adjacent(v: Views) -> DataFrame:
    return graph.root_cuts(*_own(v)).groupBy(F.col("a").alias("root")).agg(F.count_distinct("b").alias("neighbours"))


@query(f"with {_OWN} select vertex, root from own where root in (select a from ways)")
def clique_prune(v: Views) -> DataFrame:
    own, cuts = _own(v)
    return graph.pruned(own, graph.root_cuts(own, cuts))


_APART = "own as (select l.tracking_id as a, r.tracking_id as b from spans l join spans r on l.video_id = r.video_id and l.tracking_id <> r.tracking_id and l.f0 <= r.f1 and r.f0 <= l.f1)"


def _social(v: Views) -> tuple[DataFrame, DataFrame]:
    """Cuts between trackings that overlap, and the social group of each tracking whose video has one."""
    own = v.tracking.select(F.col("tracking_id").alias("vertex"), F.col("tracking_id").alias("root"))
    cuts = graph.root_cuts(own, mining.overlapping_trackings(v.tff).toDF("a", "b"))
    return cuts, v.tracking.join(v.video_feature, "video_id").select(F.col("tracking_id").alias("root"), F.col("value").alias("g"))


@query(f"with {_APART}, g as (select t.tracking_id as root, f.value as g from tracking t join video_feature f on f.video_id = t.video_id), s as (select g, count(*) as m from g group by 1), n as (select root, (select sum(m) from s) - m as n from g join s using (g) union all select a, 1 from own) select root, cast(sum(n) as bigint) as neighbours from n group by 1 having sum(n) > 0")
def clique_multilayer(v: Views) -> DataFrame:
    """Of each tracking how many it is cut from: those it overlaps, and those of videos of other social groups."""
    cuts, groups = _social(v)
    own = v.tracking.select(F.col("tracking_id").alias("vertex"), F.col("tracking_id").alias("root"))
    return graph.layered_degrees(own, cuts, groups)


def _features(v: Views) -> DataFrame:
    rows = v.tff.transform(filters.associated).transform(filters.cached)
    return rows.select(F.col(ID).alias("vertex"), F.col("tracking_id").alias("root"))


@query("with m as (select tracking_id as root, tracking_frame_feature_id as vertex from tff where tracking_id is not null and cached), c as (select l.tracking_id as a, r.tracking_id as b from spans l join spans r on l.video_id = r.video_id and l.tracking_id <> r.tracking_id and l.f0 <= r.f1 and r.f0 <= l.f1) select vertex as id from m where root in (select a from c where b in (select root from m))")
def ssl_overlap(v: Views) -> DataFrame:
    own = _features(v)
    cuts = graph.root_cuts(v.tracking.select(F.col("tracking_id").alias("vertex"), F.col("tracking_id").alias("root")), mining.overlapping_trackings(v.tff).toDF("a", "b"))
    return nlets.clique_negatives(own, cuts).select("id")


@query(f"with {_APART}, m as (select tracking_id as root, tracking_frame_feature_id as vertex, video_id from tff where tracking_id is not null and cached), g as (select distinct m.root, f.value as g from m join video_feature f on f.video_id = m.video_id) select vertex as id, true as apart from m where (root in (select root from g) and (select count(distinct g) from g) > 1) or root in (select a from own where b in (select root from m))")
def ssl_social(v: Views) -> DataFrame:
    """Which features have a negative over the layers, and whether the cliques of the two are cut apart."""
    own, (cuts, groups) = _features(v), _social(v)
    side = own.join(groups, "root", "left")
    got = nlets.layered_negatives(own, cuts, groups).join(side.toDF("a", "id", "ga"), "id").join(side.toDF("b", "negative", "gb"), "negative")
    hit = got.join(cuts.withColumn("cut", F.lit(True)), ["a", "b"], "left")
    return hit.select("id", (F.coalesce(F.col("ga") != F.col("gb"), F.lit(False)) | F.col("cut").isNotNull()).alias("apart"))


@query("with m as (select tracking_id as root, tracking_frame_feature_id as vertex from tff where tracking_id is not null and cached), c as (select l.tracking_id as a, r.tracking_id as b from spans l join spans r on l.video_id = r.video_id and l.tracking_id <> r.tracking_id and l.f0 <= r.f1 and r.f0 <= l.f1) select count(*) as n, count(*) as good from m where root in (select a from c where b in (select root from m))")
def nlet_clique(v: Views) -> DataFrame:
    """How many negatives there are, and how many of them lie in a clique that is cut from the anchor's."""
    own = _features(v)
    cuts = graph.root_cuts(v.tracking.select(F.col("tracking_id").alias("vertex"), F.col("tracking_id").alias("root")), mining.overlapping_trackings(v.tff).toDF("a", "b"))
    got = nlets.clique_negatives(own, cuts).join(own.toDF("id", "a"), "id").join(own.toDF("negative", "b"), "negative")
    hit = got.join(cuts.withColumn("ok", F.lit(1)), ["a", "b"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("ok").alias("good"))
