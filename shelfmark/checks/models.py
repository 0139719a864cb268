"""Queries over classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import features as fc
from shelfmark.checks import fixtures as fx
from shelfmark.checks.metrics import r9
from shelfmark.checks.registry import query
from shelfmark.operators import bayes, clusters, ensemble, neighbours, ridge
from shelfmark.operators import features as ft
from shelfmark.operators.evaluate import classified
from shelfmark.operators.match import match_confidences
from shelfmark.operators.skew import DOC
from shelfmark.session import cut

FOLDED = fc.TERMS + ", d as (select doc_idx, target, {fold} as fold from fx_docs where fulltext<>'')"

# Every document scored by the model of its fold, trained on the documents with another fold.
BAYES = """, m as (select a.fold, d.target, term, sum(value) as n from (select distinct fold from d) a join d on {train} join tf using (doc_idx) group by 1,2,3),
voc as (select fold, term from m group by 1,2), v as (select fold, count(*) as v from voc group by fold),
cl as (select a.fold, d.target, count(*) as nd from (select distinct fold from d) a join d on {train} group by 1,2),
tok as (select fold, target, sum(n) as nt from m group by 1,2),
cs as (select cl.fold, cl.target, ln(nd / sum(nd) over (partition by cl.fold)) as prior, coalesce(nt,0)+v as den from cl left join tok using (fold, target) join v on v.fold=cl.fold),
ln_ as (select d.doc_idx, sum(value) as len from d join tf using (doc_idx) join voc on voc.fold=d.fold and voc.term=tf.term group by 1),
gain as (select d.doc_idx, m.target, sum(value*ln(n+1)) as g from d join tf using (doc_idx) join m on m.fold=d.fold and m.term=tf.term group by 1,2),
s as (select d.doc_idx, cs.target, prior + coalesce(g,0) - coalesce(len,0)*ln(den) as s from d join cs using (fold) left join gain on gain.doc_idx=d.doc_idx and gain.target=cs.target left join ln_ on ln_.doc_idx=d.doc_idx),
e as (select doc_idx, target, exp(s - max(s) over (partition by doc_idx)) as e from s),
nb as (select doc_idx, target, e/sum(e) over (partition by doc_idx) as confidence from e)"""


def text_sets(spark, sf, fold):
    """Count vectors and documents; fold and class ride along from the document, so no cell is joined with its document."""
    docs = fx.docs(spark, sf).filter("fulltext <> ''").select(DOC, "target", fold.cast("int").alias("fold"), "fulltext")
    keys = ("fold", DOC, "target")
    terms = ft.count_vectors(ft.analyse_kinds(docs, fc.TEXT, keys), keys)
    return terms.select(*keys, "term", "value"), docs.drop("fulltext")


@query("i01_naive_bayes", FOLDED.replace("{fold}", "doc_idx%3") + BAYES.format(train="d.fold<>a.fold") + " select doc_idx, target, round(confidence, 6) as confidence from nb")
def i01(spark, sf):
    """Three cross-validated models in one job."""
    terms, docs = text_sets(spark, sf, F.col(DOC) % 3)
    model = bayes.fit(*bayes.cross_fold_sums(terms, docs, 3))
    return bayes.score(model, terms, docs).select(DOC, "target", F.round("confidence", 6).alias("confidence"))


LOO = fc.KIND_TERMS.replace("tf as (select doc_idx, kind, term, cast(count(*) as double) as value from t group by all)", """tk as (select doc_idx, term, cast(count(*) as double) as x from t where kind in ('brand_grams','status') group by all),
d as (select doc_idx, status[1] as y, target[1] as target from fx_items where len(target)>0), f as (select d.*, term, x from d join tk using (doc_idx)),
tt as (select target, term, sum(x) as n from f group by all), ta as (select term, sum(n) as total from tt group by term), nt as (select target, sum(n) as tok from tt group by target),
nd as (select target, count(*) as docs from d group by target), al as (select count(*) as n, (select count(*) from ta) as v from d),
ln_ as (select doc_idx, sum(x) as full_len, sum(case when total>x then x else 0 end) as len, count(*) filter (where total<=x) as lone from f join ta using (term) group by doc_idx),
g as (select f.doc_idx, tt.target, sum(case when total>x then x*ln(n - (case when tt.target=f.target then x else 0 end) + 1) else 0 end) as g from f join tt using (term) join ta using (term) group by f.doc_idx, tt.target),
s as (select d.doc_idx, nd.target, ln((docs - (case when nd.target=d.target then 1 else 0 end)) / (al.n-1)) + coalesce(g,0) - coalesce(len,0)*ln(tok - (case when nd.target=d.target then coalesce(full_len,0) else 0 end) + al.v - coalesce(lone,0)) as s
 from d join nd on true join al on true join nt on nt.target=nd.target left join ln_ on ln_.doc_idx=d.doc_idx left join g on g.doc_idx=d.doc_idx and g.target=nd.target),
e as (select doc_idx, target, exp(s - max(s) over (partition by doc_idx)) as e from s)""")


@query("e10_leave_one_out", LOO + " select doc_idx, target, round(e/sum(e) over (partition by doc_idx), 6) as confidence from e")
def e10(spark, sf):
    """Naive Bayes over two metadata fields, every document scored by the model of all others, in one pass."""
    df = cut(fx.record_items(spark, sf))  # read several times below
    docs = df.filter(F.size("target") > 0).select(DOC, F.get("target", F.lit(0)).alias("target"), F.lit(0).alias("fold"))
    kinds = {k: fc.KINDS[k] for k in ("status", "brand_grams")}
    terms = ft.count_vectors(ft.analyse_kinds(df, kinds)).select(F.lit(0).alias("fold"), DOC, "term", "value")
    terms = terms.join(docs.select(DOC), DOC, "left_semi")
    model = bayes.fit(*bayes.class_sums(terms, docs))
    out = bayes.score(model, terms, docs, leave_own_out=True)
    return out.select(DOC, "target", F.round("confidence", 6).alias("confidence"))


def embeddings(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias(DOC), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("target"))


def inverse_sql(size: int) -> str:
    """``inv`` (i, j, x): inverse of the matrix ``a`` (i, j, x) of this size by elimination, a column at a time."""
    parts = [f""", s0 as materialized (select i, j, x from a union all select i, j, case when i=j-{size} then 1.0::double else 0.0::double end from range({size}) r(i), range({size}, {2 * size}) c(j))"""]
    for k in range(size):
        parts.append(f""", s{k + 1} as materialized (select s.i, s.j, case when s.i={k} then p.x/d.x else s.x - f.x*p.x/d.x end as x from s{k} s join s{k} p on p.i={k} and p.j=s.j join s{k} f on f.i=s.i and f.j={k}, (select x from s{k} where i={k} and j={k}) d)""")
    return "".join(parts) + f", inv as materialized (select i, j-{size} as j, x from s{size} where j>={size})"


VECTOR = 64  # values of an embedding


@query("e10_leave_one_out_ridge", f"""with e as materialized (select vec_id as doc_idx, list_append(embedding::double[], 1.0::double) as v, 'c'||label as target from embeddings),
x as materialized (select doc_idx, target, unnest(v) as x, generate_subscripts(v,1)-1 as i from e),
a as materialized (select p.i, q.i as j, sum(p.x*q.x) + case when p.i=q.i then 1.0 else 0.0 end as x from x p join x q using (doc_idx) group by p.i, q.i)
{inverse_sql(VECTOR + 1)}, c as (select distinct target from e where target is not null),
b as (select c.target, i, sum(x*case when x.target=c.target then 1.0 else -1.0 end) as x from x, c group by all),
w as materialized (select target, inv.i, sum(inv.x*b.x) as x from inv join b on b.i=inv.j group by all),
g as materialized (select doc_idx, inv.i, sum(x.x*inv.x) as x from x join inv on inv.j=x.i group by all),
h as (select doc_idx, sum(x.x*g.x) as h from x join g using (doc_idx, i) group by doc_idx),
m as (select doc_idx, x.target as own, w.target, sum(x.x*w.x) as m from x join w using (i) group by all)
select doc_idx, target, round((m - h*case when own=target then 1.0 else -1.0 end)/(1-h), 6) as margin from m join h using (doc_idx)""")
def e10_ridge(spark, sf):
    """Every embedding scored for every class by the ridge regression of all others, in closed form."""
    return ridge.leave_one_out(embeddings(spark, sf)).withColumn("margin", F.round("margin", 6))


KNN = """with e as (select vec_id as doc_idx, embedding::double[] as v, 'c'||label as target from embeddings),
p as (select a.doc_idx, b.doc_idx as neighbour, b.target, list_distance(a.v, b.v) as distance from e a join e b on {on}),
n as (select *, row_number() over (partition by doc_idx order by distance, neighbour) as rank from p), k as (select * from n where rank<=5)"""


@query("c11_nearest_neighbours", KNN.format(on="a.doc_idx<>b.doc_idx") + " select doc_idx, neighbour, round(distance, 9) as distance, rank from k")
def c11(spark, sf):
    e = embeddings(spark, sf)
    df = neighbours.nearest_neighbours(e, e, 5, exclude_self=True)
    return r9(df.withColumn("rank", F.col("rank").cast("bigint")))


@query("i04_neighbour_vote", KNN.format(on="b.doc_idx%3<>0") + """, w as (select doc_idx, target, sum(case when distance>0 then 1/distance else 0 end) as w, sum(case when distance=0 then 1.0 else 0 end) as z, count(*) as u from k group by 1,2),
c as (select doc_idx, target, case when sum(z) over (partition by doc_idx)>0 then z/sum(z) over (partition by doc_idx) else w/sum(w) over (partition by doc_idx) end as d, u/sum(u) over (partition by doc_idx) as u from w)
select doc_idx, target, 'distance' as weights, round(d, 9) as confidence from c union all select doc_idx, target, 'uniform', round(u, 9) from c""")
def i04(spark, sf):
    e = embeddings(spark, sf)
    train = e.filter(F.col(DOC) % 3 != 0)
    found = neighbours.nearest_neighbours(train, e, 5)
    kinds = [neighbours.vote(found, train, w).withColumn("weights", F.lit(w)) for w in ("uniform", "distance")]
    return r9(kinds[0].unionByName(kinds[1]))


@query("i06_match_target_classifier", f"with {fc.DOCS}{fc.NAMES} select doc_idx, target, round(value/sum(value) over (partition by doc_idx), 9) as confidence from hits")
def i06(spark, sf):
    return r9(match_confidences(fc.match_rows(spark, sf)))


CENTRES = """with e as (select vec_id as doc_idx, embedding::double[] as v, 'c'||label as target from embeddings),
x as (select target, unnest(v) as x, generate_subscripts(v,1)-1 as pos from e), cen as (select target, pos, avg(x) as value from x group by target, pos)"""


@query("d18_class_centroids", CENTRES + " select target, pos, round(value, 9) as value from cen")
def d18(spark, sf):
    e = embeddings(spark, sf)
    return r9(clusters.centroids(e, e).withColumn("pos", F.col("pos").cast("bigint")))


@query("d19_cluster_counts", "select 'c'||label as target, vec_id%7 as cluster, count(*) as n from embeddings group by all")
def d19(spark, sf):
    return clusters.cluster_counts(embeddings(spark, sf).withColumn("cluster", F.col(DOC) % 7))


@query("c12_nearest_free_clusters", CENTRES + """, f as (select vec_id%9 as cluster, unnest(embedding::double[]) as x, generate_subscripts(embedding,1)-1 as pos from embeddings), fc as (select cluster, pos, avg(x) as value from f where cluster in (2,5,7) group by all),
dd as (select target, cluster, sqrt(sum((cen.value-fc.value)*(cen.value-fc.value))) as distance from cen join fc using (pos) group by all)
select target, cluster, round(distance, 9) as distance, row_number() over (partition by target order by distance, cluster) as rank from dd""")
def c12(spark, sf):
    e = embeddings(spark, sf)
    pack = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c")).select(key, F.col("c.value").alias("vector"))
    centres = pack(clusters.centroids(e, e), "target")
    groups = e.select(DOC, (F.col(DOC) % 9).alias("target")).filter(F.col("target").isin(2, 5, 7))
    free = pack(clusters.centroids(e, groups).withColumnRenamed("target", "cluster"), "cluster")
    df = clusters.nearest_clusters(centres, free.withColumn("cluster", F.col("cluster").cast("int")))
    return r9(df.withColumn("rank", F.col("rank").cast("bigint")).withColumn("cluster", F.col("cluster").cast("bigint")))


def matching_sql(name: str, wishes: str, rounds: int = 60) -> str:
    """``<name>`` (target, cluster): deferred acceptance over ``wishes`` (target, cluster, wish, claim)."""
    parts = [f", {name}0 as materialized (select *, row_number() over (partition by target order by wish, cluster) as place from ({wishes}))"]
    for r in range(rounds):
        parts.append(f""", {name}p{r} as materialized (select *, row_number() over (partition by cluster order by claim, target) as rk from (select * from {name}{r} qualify place=min(place) over (partition by target))),
{name}{r + 1} as materialized (select * from {name}{r} anti join (select target, place from {name}p{r} where rk>1) using (target, place))""")
    return "".join(parts) + f", {name} as materialized (select target, cluster from {name}p{rounds - 1})"


def lloyd_sql(iterations: int) -> str:
    """Centres ``k<iterations>`` (cluster, c) of the rows ``tr`` (doc_idx, v, target) from the seeds ``k0``."""
    return "".join(f""", s{i} as (select doc_idx, v, arg_min(cluster, (list_distance(v, c), cluster)) as cluster from tr, k{i - 1} group by doc_idx, v),
m{i} as (select cluster, list(x order by pos) as c from (select cluster, pos, avg(x) as x from (select cluster, unnest(v) as x, generate_subscripts(v,1) as pos from s{i}) group by cluster, pos) group by cluster),
k{i} as materialized (select cluster, coalesce(m.c, k.c) as c from k{i - 1} k left join m{i} m using (cluster))""" for i in range(1, iterations + 1))


KMEANS_STEPS = 20
KMEANS = f"""with e as (select vec_id as doc_idx, embedding::double[] as v, 'c'||label as target from embeddings), tr as materialized (select * from e where doc_idx%4<>0),
sd as (select v, row_number() over (order by substr(md5('3:'||doc_idx), 1, 15), doc_idx)-1 as cluster from tr),
k0 as materialized (select cluster, v as c from sd where cluster < (select count(distinct target) from tr)){lloyd_sql(KMEANS_STEPS)},
fin as materialized (select cluster, c from k{KMEANS_STEPS}), al as (select doc_idx, tr.target, arg_min(cluster, (list_distance(v, c), cluster)) as cluster from tr, fin group by doc_idx, tr.target),
cc as materialized (select target, cluster, -count(*) as wish, -count(*) as claim from al group by target, cluster),
ce as (select target, list(x order by pos) as v from (select target, pos, avg(x) as x from (select target, unnest(v) as x, generate_subscripts(v,1) as pos from tr) group by target, pos) group by target),
nd as materialized (select target, cluster, list_distance(v, c) as wish, list_distance(v, c) as claim from ce, fin)
{matching_sql("hd", "select * from cc")}{matching_sql("fr", "select * from nd where target not in (select target from hd) and cluster not in (select cluster from hd)", 20)},
mt as materialized (select * from hd union all select * from fr)"""


@query("i07_kmeans_fit", KMEANS + " select target, cluster, pos, round(x, 9) as value from (select target, cluster, unnest(c) as x, generate_subscripts(c,1)-1 as pos from fin left join mt using (cluster))")
def i07_fit(spark, sf):
    """Centres and classes of a fit from seeds chosen by hash."""
    train = embeddings(spark, sf).filter(F.col(DOC) % 4 != 0)
    fitted = clusters.fit_kmeans(train, train, seed=3, iterations=KMEANS_STEPS)
    rows = fitted.select("target", F.col("cluster").cast("bigint").alias("cluster"), F.posexplode("vector").alias("pos", "value"))
    return r9(rows.withColumn("pos", F.col("pos").cast("bigint")))


@query("i07_kmeans_classifier", KMEANS + """, dd as (select doc_idx, mt.target, list_distance(v, c) as distance from e, fin join mt using (cluster)),
w as (select doc_idx, target, case when bool_or(distance=0) over (partition by doc_idx) then (distance=0)::double else 1/distance end as w from dd)
select doc_idx, target, round(w/sum(w) over (partition by doc_idx), 9) as confidence from w""")
def i07(spark, sf):
    e = embeddings(spark, sf)
    train = e.filter(F.col(DOC) % 4 != 0)
    return r9(clusters.score_kmeans(clusters.fit_kmeans(train, train, seed=3, iterations=KMEANS_STEPS), e))


@query("i07_kmeans_scores", CENTRES + """, dd as (select doc_idx, cen.target, sqrt(sum((x.x-value)*(x.x-value))) as distance from (select vec_id as doc_idx, unnest(embedding::double[]) as x, generate_subscripts(embedding,1)-1 as pos from embeddings) x join cen using (pos) group by all),
h as (select *, bool_or(distance=0) over (partition by doc_idx) as hit from dd), w as (select doc_idx, target, case when hit then (distance=0)::double else 1/distance end as w from h)
select doc_idx, target, round(w/sum(w) over (partition by doc_idx), 9) as confidence from w""")
def i07_scores(spark, sf):
    """Confidences from given clusters: the centroid of every class."""
    e = embeddings(spark, sf)
    lists = clusters.centroids(e, e).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c"))
    given = lists.select("target", F.lit(0).alias("cluster"), F.col("c.value").alias("vector"))
    return r9(clusters.score_kmeans(given, e))


AUTO = FOLDED.replace("{fold}", "doc_idx%4") + BAYES.format(train="d.fold<>a.fold") + """, p as (select nb.doc_idx, d.fold, d.target, nb.target as predicted, row_number() over (partition by nb.doc_idx order by confidence desc, nb.target) as rk from nb join d using (doc_idx)),
vt as (select * from p where rk=1), lab as (select fold, target as label from vt union select fold, predicted from vt),
f as (select fold, label, (select count(*) from vt where vt.fold=lab.fold and vt.target=label and vt.predicted=label) as tp, (select count(*) from vt where vt.fold=lab.fold and vt.target=label) as t, (select count(*) from vt where vt.fold=lab.fold and vt.predicted=label) as np from lab)
select 0 as classifier_id, label as target, round(avg(case when tp>0 then 2.0*tp/(t+np) else 0.0 end), 6) as weight from f group by label"""


@query("i14_automatic_weights", AUTO)
def i14(spark, sf):
    terms, docs = text_sets(spark, sf, F.col(DOC) % 4)
    scores = bayes.score(bayes.fit(*bayes.cross_fold_sums(terms, docs, 4)), terms, docs)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "target")).alias("b")
    votes = scores.groupBy(DOC).agg(best).select(DOC, F.col("b.target").alias("predicted")).join(docs, DOC)
    votes = classified(votes.withColumn("classifier_id", F.lit(0)))
    df = ensemble.automatic_weights(votes, docs.withColumn("classifier_id", F.lit(0)))
    return df.withColumn("weight", F.round("weight", 6))
