"""Queries over balancing and cross-validation splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import fixtures as fx
from shelfmark.checks.registry import query
from shelfmark.operators import sampling, splits
from shelfmark.operators.skew import DOC

DOCS = fx.DOCS_SQL
RANKED = f"""with {DOCS}, sz as (select target, count(*) as size from fx_docs group by target), mx as (select max(size) as largest from sz),
r as (select doc_idx, d.target, size, largest, row_number() over (partition by d.target order by {fx.key_sql('doc_idx', seed=5)}, doc_idx) as rank from fx_docs d join sz using (target), mx)"""


def labelled(spark, sf):
    return fx.docs(spark, sf).select(DOC, "target")


@query("e04_under_sampling", RANKED + " select doc_idx, target from r where rank <= ceil(largest*0.3)")
def e04(spark, sf):
    return sampling.under_sample(labelled(spark, sf), 0.3, seed=5)


@query("e05_over_sampling", RANKED.replace("|| cast(doc_idx as varchar)), 1, 15)", "|| cast(doc_idx as varchar) || ':' || '0'), 1, 15)") + """, c as (select doc_idx, target, greatest(floor((greatest(ceil(largest*1.2)-size,0) - rank + size)/size), 0) as clones from r)
select doc_idx, target, cast(unnest(range(0, cast(clones as bigint)+1)) as int) as copy from c""")
def e05(spark, sf):
    return sampling.over_sample(labelled(spark, sf), 1.2, seed=5)


@query("e06_sampler_chain", RANKED + f""", u as (select doc_idx, target from r where rank <= ceil(largest*0.5)), sz2 as (select target, count(*) as size from u group by target),
r2 as (select u.doc_idx, u.target, size, (select max(size) from sz2) as largest, row_number() over (partition by u.target order by {fx.key_sql('doc_idx', '0', seed=5)}, doc_idx) as rank from u join sz2 using (target)),
c as (select doc_idx, target, greatest(floor((greatest(ceil(largest*0.9)-size,0) - rank + size)/size), 0) as clones from r2)
select doc_idx, target, cast(unnest(range(0, cast(clones as bigint)+1)) as int) as copy from c""")
def e06(spark, sf):
    return sampling.balance(labelled(spark, sf), [("under", 0.5), ("over", 0.9)], seed=5)


@query("e07_stratified_folds", f"with {DOCS} select doc_idx, target, ntile(4) over (partition by target order by doc_idx)-1 as fold from fx_docs")
def e07(spark, sf):
    df = splits.stratified_folds(labelled(spark, sf), 4, block_rows=128)
    return df.withColumn("fold", F.col("fold").cast("bigint"))


@query("e08_plain_folds", f"with {DOCS} select doc_idx, target, ntile(7) over (order by doc_idx)-1 as fold from fx_docs")
def e08(spark, sf):
    df = splits.plain_folds(labelled(spark, sf), 7, block_rows=128)
    return df.withColumn("fold", F.col("fold").cast("bigint"))


@query("e09_stratified_shuffle", f"""with {DOCS}, sz as (select target, count(*) as size, sum(count(*)) over () as total from fx_docs group by target),
q as (select target, ceil(0.2*total)*size/total as q, ceil(0.2*total) as wanted from sz), fl as (select target, floor(q) as w, q-floor(q) as rest, wanted from q),
lim as (select target, w + case when row_number() over (order by rest desc, target) <= wanted - sum(w) over () then 1 else 0 end as lim from fl),
r as (select doc_idx, d.target, f.fold, lim, row_number() over (partition by f.fold, d.target order by {fx.key_sql('doc_idx', 'f.fold', seed=3)}, doc_idx) as rank from fx_docs d join lim using (target), (select unnest([0,1,2]) as fold) f)
select doc_idx, target, cast(fold as int) as fold, cast(rank<=lim as int) as is_test from r""")
def e09(spark, sf):
    return splits.stratified_shuffle(labelled(spark, sf), 3, 0.2, seed=3)


FOLDS = f"with {DOCS}, f as (select doc_idx, target, ntile(3) over (partition by target order by doc_idx)-1 as own from fx_docs)"


@query("e11_train_test_sets", FOLDS + " select doc_idx, target, hier, cast(a.fold as int) as fold, case when own=a.fold then 'test' else 'train' end as role from f join fx_docs using (doc_idx, target), (select unnest([0,1,2]) as fold) a")
def e11(spark, sf):
    d = fx.docs(spark, sf).select(DOC, "target", "hier")
    return splits.materialise(d, splits.stratified_folds(d.select(DOC, "target"), 3), 3)


@query("e12_consistency", FOLDS + " select role, count(*) as n from f, (select unnest(['train','test']) as role) group by role")
def e12(spark, sf):
    return splits.consistency(labelled(spark, sf)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
