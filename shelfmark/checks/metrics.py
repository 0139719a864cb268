"""Queries over hierarchy functions, n-best lists, metrics and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.checks import fixtures as fx
from shelfmark.checks.registry import query
from shelfmark.functions import hierarchy as h
from shelfmark.operators import counts, ensemble, evaluate, nbest
from shelfmark.operators.skew import DOC, dense_index
from shelfmark.session import scratch_path
from shelfmark.sources import sinks

PRED, SCORES, WEIGHTS, DOCS = fx.PRED_SQL, fx.SCORES_SQL, fx.WEIGHTS_SQL, fx.DOCS_SQL


def r9(df):
    """Doubles rounded to 9 digits."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("b17_unclassified_filter", f"with {PRED} select doc_idx, fold, target, predicted from fx_pred where predicted <> ''")
def b17(spark, sf):
    return evaluate.classified(fx.predictions(spark, sf))


@query("g15_levels", f"with {DOCS} select doc_idx, len(string_split(hier,'->')) as depth, string_split(hier,'->')[2] as second from fx_docs")
def g15(spark, sf):
    return fx.docs(spark, sf).select(
        DOC, F.size(h.levels("hier")).cast("bigint").alias("depth"), F.get(h.levels("hier"), F.lit(1)).alias("second")
    )


@query("g16_top_level", f"with {DOCS} select doc_idx, string_split(hier,'->')[1] as top from fx_docs")
def g16(spark, sf):
    return fx.docs(spark, sf).select(DOC, h.top_level("hier").alias("top"))


FAMILY = f"""with {PRED}, l as (select doc_idx, string_split(target,'->') as t, string_split(predicted,'->') as p from fx_pred where predicted<>''),
f as (select *, t[1:least(len(t),len(p))] = p[1:least(len(t),len(p))] as fam, t[1]=p[1] as top from l)"""


@query("g17_same_top_level", FAMILY + " select doc_idx, cast(top as int) as flag from f")
def g17(spark, sf):
    return evaluate.classified(fx.predictions(spark, sf)).select(
        DOC, h.same_top_level("target", "predicted").cast("int").alias("flag")
    )


@query("g18_same_family", FAMILY + " select doc_idx, cast(fam as int) as flag from f")
def g18(spark, sf):
    return evaluate.classified(fx.predictions(spark, sf)).select(
        DOC, h.same_family("target", "predicted").cast("int").alias("flag")
    )


@query("g19_direct_family", FAMILY + " select doc_idx, cast(fam and abs(len(t)-len(p))<=1 as int) as flag from f")
def g19(spark, sf):
    return evaluate.classified(fx.predictions(spark, sf)).select(
        DOC, h.direct_family("target", "predicted").cast("int").alias("flag")
    )


@query("g20_target_codes", f"with {DOCS} select doc_idx, hier, dense_rank() over (order by hier) - 1 as code from fx_docs")
def g20(spark, sf):
    d = fx.docs(spark, sf).select(DOC, "hier")
    return d.join(dense_index(d.select("hier").distinct(), ["hier"], "code"), "hier")


@query("d06_branch_counts", f"""with {DOCS}, l as (select string_split(hier,'->') as p from fx_docs),
x as (select unnest(list_transform(range(1, len(p)+1), lambda n: p[1:n])) as prefix from l)
select array_to_string(prefix,'->') as path, len(prefix) as depth, count(*) as n_docs from x group by prefix""")
def d06(spark, sf):
    df = counts.branch_counts(fx.docs(spark, sf), "hier")
    return df.withColumn("depth", F.col("depth").cast("bigint"))


PRF = f"""with {PRED}, c as (select * from fx_pred where predicted<>''),
lab as (select fold, target as label from c union select fold, predicted from c),
s as (select fold, label, (select count(*) from c where c.fold=lab.fold and c.target=label and c.predicted=label) as tp,
 (select count(*) from c where c.fold=lab.fold and c.target=label) as support,
 (select count(*) from c where c.fold=lab.fold and c.predicted=label) as np from lab),
prf as (select fold, label as target, support, case when np>0 then tp/np else 0.0 end::double as precision,
 case when support>0 then tp/support else 0.0 end::double as recall,
 case when tp>0 then 2.0*tp/(np+support) else 0.0 end::double as f1, tp from s),
tr as (select a.fold, b.target, count(*) as n_train from (select distinct fold from fx_pred) a join fx_pred b on a.fold<>b.fold group by 1,2),
per_target as (select prf.fold, prf.target, support, precision, recall, f1,
  coalesce(n_train,0) as n_train from prf left join tr using (fold, target) where support>0)"""


def _scores(spark, sf):
    pred = fx.predictions(spark, sf)
    return evaluate.target_scores(pred, evaluate.train_counts(pred, 3))


@query("d10_target_scores", PRF + " select fold, target, support, round(precision,9) as precision, round(recall,9) as recall, round(f1,9) as f1, n_train from per_target")
def d10(spark, sf):
    return r9(_scores(spark, sf))


AVERAGES = """, av as (
select fold, 'micro' as average, sum(tp)/sum(support) as precision, sum(tp)/sum(support) as recall, sum(tp)/sum(support) as f1 from prf group by fold
union all select fold, 'macro', avg(precision), avg(recall), avg(f1) from prf group by fold
union all select fold, 'weighted (support)', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support) from prf group by fold)"""


@query("d11_average_scores", PRF + AVERAGES + " select fold, average, round(precision,9) as precision, round(recall,9) as recall, round(f1,9) as f1 from av")
def d11(spark, sf):
    return r9(evaluate.average_scores(fx.predictions(spark, sf)))


@query("d12_cross_fold_means", PRF + """ select target, round(avg(precision),9) as precision, round(avg(recall),9) as recall,
round(avg(f1),9) as f1, round(avg(support),9) as support, round(avg(n_train),9) as n_train from per_target group by target""")
def d12(spark, sf):
    return r9(evaluate.cross_fold_means(_scores(spark, sf)))


COMBINED = f"""with {SCORES}, {WEIGHTS}, {DOCS}, comb as (
select s.doc_idx, s.target, case when t.w>0 then sum(s.confidence*w.weight)/t.w else 0.0 end::double as confidence
from fx_scores s join fx_weights w using (classifier_id, target) join (select target, sum(weight) as w from fx_weights group by target) t using (target)
group by s.doc_idx, s.target, t.w),
ranked as (select *, row_number() over (partition by doc_idx order by confidence desc, target) as rank from comb)"""


def _combined(spark, sf):
    return ensemble.weighted_mean(fx.scores(spark, sf), fx.weights(spark))


TOPN = COMBINED + """, t as (select d.doc_idx, d.doc_idx%3 as fold, d.target||'->'||(case d.doc_idx%2 when 0 then 'x' else 'y' end) as target from fx_docs d),
cand as (select doc_idx, rank, case when doc_idx%5=0 then target||'->x' when doc_idx%5=1 then target||'->x->deep' else target end as candidate from ranked where confidence>0 and rank<=3),
j as (select fold, t.doc_idx, rank, string_split(target,'->') as t, string_split(candidate,'->') as c, target, candidate from t join cand using (doc_idx)),
f as (select *, t[1:least(len(t),len(c))] = c[1:least(len(t),len(c))] as fam from j),
m as (select fold, doc_idx, min(rank) filter (where target=candidate) as e, min(rank) filter (where fam and abs(len(t)-len(c))<=1) as d,
  min(rank) filter (where fam) as f, min(rank) filter (where t[1]=c[1]) as p from f group by fold, doc_idx)
select fold, n.n as n, l.level as level, round(avg(case when coalesce(case l.level when 'exact match' then e when 'direct family' then d when 'family' then f else p end, 99) <= n.n then 1.0 else 0.0 end), 9) as accuracy
from m, (select unnest([1,2,3]) as n) n, (select unnest(['exact match','direct family','family','same top level']) as level) l group by fold, n.n, l.level"""


@query("d13_top_n_accuracy", TOPN)
def d13(spark, sf):
    five, two = F.col(DOC) % 5, F.col(DOC) % 2
    ranked = nbest.rank_targets(_combined(spark, sf), 3)
    name = (
        F.when(five == 0, F.concat("target", F.lit("->x")))
        .when(five == 1, F.concat("target", F.lit("->x->deep")))
        .otherwise(F.col("target"))
    )
    truth = fx.docs(spark, sf).select(
        DOC, (F.col(DOC) % 3).alias("fold"),
        F.concat_ws("->", "target", F.when(two == 0, "x").otherwise("y")).alias("target"),
        F.lit("any").alias("predicted"),
    )
    return r9(evaluate.top_n_accuracy(truth, ranked.withColumn("target", name), 3))


CONFUSION = f"""with {PRED}, p as (select target, case when predicted='' then '(unclassified)' else predicted end as predicted from fx_pred),
cm as (select case when grouping(target)=1 then 'All' else target end as target, case when grouping(predicted)=1 then 'All' else predicted end as predicted,
count(*) as n from p group by cube (target, predicted))"""


@query("d14_confusion_matrix", CONFUSION + " select * from cm")
def d14(spark, sf):
    return evaluate.confusion_matrix(fx.predictions(spark, sf))


@query("d15_unclassified", f"""with {PRED}, u as (select fold, count(*) filter (where predicted='') as n from fx_pred group by fold)
select cast(sum(n) as bigint) as total, round(avg(n),9) as mean_per_fold from u""")
def d15(spark, sf):
    return r9(evaluate.unclassified_summary(fx.predictions(spark, sf)))


@query("d22_match_flags", f"with {PRED} select doc_idx, fold, target, predicted, cast(target=predicted as int) as match from fx_pred")
def d22(spark, sf):
    return evaluate.match_flags(fx.predictions(spark, sf))


@query("b15_classifier_threshold", f"""with {SCORES} select doc_idx, classifier_id, target,
case when confidence >= (case classifier_id when 0 then 0.5 when 1 then 0.25 else 0.0 end) then confidence else 0.0 end as confidence from fx_scores""")
def b15(spark, sf):
    return ensemble.above_threshold(fx.scores(spark, sf), {0: 0.5, 1: 0.25})


@query("b16_final_threshold", COMBINED + " select doc_idx, target, round(case when confidence>=0.4 then confidence else 0.0 end, 9) as confidence from comb")
def b16(spark, sf):
    return r9(ensemble.final_threshold(_combined(spark, sf), 0.4))


@query("c14_class_grid", f"""with {SCORES}, {DOCS}, s as (select * from fx_scores where classifier_id=0 and target in ('en','fr')),
g as (select doc_idx, t.lang as target from fx_docs, (select unnest(['de','en','es','fr']) lang) t)
select g.doc_idx, g.target, coalesce(s.confidence, 0.0) as confidence from g left join s using (doc_idx, target)""")
def c14(spark, sf):
    s = fx.scores(spark, sf).filter((F.col("classifier_id") == 0) & F.col("target").isin("en", "fr"))
    return ensemble.full_grid(fx.docs(spark, sf), s, fx.LANGS)


@query("f04_set_difference", f"with {DOCS} select distinct hier as target from fx_docs where hier not in (select hier from fx_docs where doc_idx%5=0)")
def f04(spark, sf):
    d = fx.docs(spark, sf).select(DOC, F.col("hier").alias("target"))
    return ensemble.missing_targets(d, d.filter(F.col(DOC) % 5 == 0))


VOTES = f"""with {SCORES}, {WEIGHTS}, {DOCS}, votes as (select doc_idx, classifier_id, target as predicted from (
select *, row_number() over (partition by doc_idx, classifier_id order by confidence desc, target) as rk from fx_scores where confidence>0) where rk=1),
sums as (select doc_idx, predicted, sum(weight) as w, min(v.classifier_id) as c from votes v join fx_weights w on v.classifier_id=w.classifier_id and v.predicted=w.target group by doc_idx, predicted),
win as (select doc_idx, predicted from (select *, row_number() over (partition by doc_idx order by round(w,9) desc, c, predicted) as rk from sums) where rk=1)
select d.doc_idx, d.target, coalesce(win.predicted,'') as predicted from fx_docs d left join win using (doc_idx)"""


def _votes(spark, sf):
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "target")).alias("b")
    picked = fx.scores(spark, sf).filter("confidence > 0").groupBy(DOC, "classifier_id").agg(best)
    return picked.select(DOC, "classifier_id", F.col("b.target").alias("predicted"))


@query("d16_weighted_vote", VOTES)
def d16(spark, sf):
    return ensemble.weighted_vote(fx.docs(spark, sf).select(DOC, "target"), _votes(spark, sf), fx.weights(spark))


@query("d17_weighted_mean", COMBINED + " select doc_idx, target, round(confidence,9) as confidence from comb")
def d17(spark, sf):
    return r9(_combined(spark, sf))


@query("e01_n_best", COMBINED + " select doc_idx, target, round(confidence,9) as confidence, rank from ranked where confidence>0 and rank<=3")
def e01(spark, sf):
    df = nbest.rank_targets(_combined(spark, sf), 3)
    return r9(df.withColumn("rank", F.col("rank").cast("bigint")))


@query("e02_best_target", COMBINED + """ select d.doc_idx, coalesce(r.target,'') as predicted, round(coalesce(r.confidence,0.0),9) as confidence
from fx_docs d left join (select * from ranked where rank=1 and confidence>0) r using (doc_idx)""")
def e02(spark, sf):
    return r9(nbest.best_target(fx.docs(spark, sf).select(DOC), _combined(spark, sf)))


PREDICTED = COMBINED + """, wide as (select doc_idx, max(target) filter (where rank=1) as p1, max(target) filter (where rank=2) as p2,
max(round(confidence,6)) filter (where rank=1) as c1, max(round(confidence,6)) filter (where rank=2) as c2 from ranked where confidence>0 group by doc_idx)"""


def _prediction_rows(spark, sf):
    scores = _combined(spark, sf)
    docs = fx.docs(spark, sf).select(DOC, "hier", F.split("hier", "->").alias("path"))
    return nbest.prediction_rows(docs, scores, 2, ["hier", "path"], confidence="_CONF")


PREDICTED_COLUMNS = """coalesce(p1,'') as "PREDICTED", round(coalesce(c1,0.0),6) as "PREDICTED_CONF", coalesce(p2,'') as "BEST_2",
round(coalesce(c2,0.0),6) as "BEST_2_CONF", hier, replace(hier,'->','$|$') as path"""


def _numbers(df):
    number = lambda c: F.round(F.coalesce(F.when(F.col(c) != "", F.col(c)).cast("double"), F.lit(0.0)), 6).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return df.select(*[number(c) if c.endswith("_CONF") else text(c) for c in df.columns])


@query("c13_predictions_with_fields", PREDICTED + " select cast(d.doc_idx as varchar) as doc_idx, " + PREDICTED_COLUMNS + " from fx_docs d left join wide using (doc_idx)")
def c13(spark, sf):
    return _numbers(_prediction_rows(spark, sf).withColumn(DOC, F.col(DOC).cast("string")))


@query("a15_prediction_sink", PREDICTED + " select " + PREDICTED_COLUMNS + " from fx_docs d left join wide using (doc_idx)")
def a15(spark, sf):
    path = scratch_path(spark, "predictions.csv")
    sinks.write_predictions(_prediction_rows(spark, sf), path)
    return _numbers(spark.read.csv(path, header=True, escape='"'))


@query("a16_predictions_per_fold", PREDICTED + " select cast(d.doc_idx%3 as bigint) as fold, " + PREDICTED_COLUMNS + " from fx_docs d left join wide using (doc_idx)")
def a16(spark, sf):
    path = scratch_path(spark, "folds")
    rows = _prediction_rows(spark, sf).withColumn("fold", F.col(DOC) % 3)
    sinks.write_predictions(rows, path, by_fold=True)
    out = spark.read.csv(path, header=True, escape='"')
    return _numbers_with_fold(out)


def _numbers_with_fold(out):
    cells = [c for c in out.columns if c not in (DOC, "fold")]
    number = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6).alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(F.col("fold").cast("bigint").alias("fold"), *[number(c) if c.endswith("_CONF") else text(c) for c in cells])


@query("a17_confusion_sink", CONFUSION + """ select target, cast(coalesce(max(n) filter (where predicted='en'),0) as bigint) as en,
cast(coalesce(max(n) filter (where predicted='(unclassified)'),0) as bigint) as unclassified, cast(coalesce(max(n) filter (where predicted='All'),0) as bigint) as all_docs from cm group by target""")
def a17(spark, sf):
    path = scratch_path(spark, "confusion")
    evaluate.wide_confusion_matrix(fx.predictions(spark, sf)).write.parquet(path)
    df = spark.read.parquet(path)
    return df.select("target", "en", F.col("(unclassified)").alias("unclassified"), F.col("All").alias("all_docs"))


@query("i09_confusion_redistribution", f"""with {SCORES}, {DOCS}, s as (select doc_idx, target, confidence from fx_scores where classifier_id=1),
pred as (select doc_idx, target as predicted from (select *, row_number() over (partition by doc_idx order by confidence desc, target) as rk from s) where rk=1),
cm as (select predicted, d.target as meant, count(*) as n from pred join fx_docs d using (doc_idx) group by 1,2),
sh as (select predicted, meant, n/sum(n) over (partition by predicted) as share from cm)
select doc_idx, meant as target, round(sum(confidence*share),9) as confidence from s join sh on s.target=sh.predicted where confidence>1e-8 group by doc_idx, meant""")
def i09(spark, sf):
    s = fx.scores(spark, sf).filter("classifier_id = 1").select(DOC, "target", "confidence")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "target")).alias("b")
    picked = s.groupBy(DOC).agg(best).select(DOC, F.col("b.target").alias("predicted"))
    pred = fx.docs(spark, sf).select(DOC, "target").join(picked, DOC)
    return r9(ensemble.redistribute(s, ensemble.confusion_shares(pred)))


THRESHOLDED = COMBINED.replace("sum(s.confidence*w.weight)", "sum(case when s.confidence >= (case classifier_id when 0 then 0.5 when 1 then 0.25 else 0.0 end) then s.confidence*w.weight else 0.0 end)")


@query("i11_ensemble_by_confidence", THRESHOLDED + " select doc_idx, target, round(case when confidence>=0.3 then confidence else 0.0 end, 9) as confidence from comb")
def i11(spark, sf):
    return r9(ensemble.combine_confidences(fx.scores(spark, sf), fx.weights(spark), {0: 0.5, 1: 0.25}, 0.3))


@query("i12_ensemble_by_vote", VOTES.replace("v join fx_weights w on", "v left join fx_weights w on").replace("sum(weight) as w", "sum(coalesce(weight*2, 0)) as w"))
def i12(spark, sf):
    doubled = fx.weights(spark).withColumn("weight", F.col("weight") * 2)
    return ensemble.weighted_vote(fx.docs(spark, sf).select(DOC, "target"), _votes(spark, sf), doubled)


@query("i15_training_report", f"""with {DOCS}, k as (select 0 as classifier_id, target from fx_docs where fulltext<>'' union all select 1, target from fx_docs where quality is not null)
select classifier_id, count(*) as n_docs, count(distinct target) as n_targets from k group by classifier_id""")
def i15(spark, sf):
    d = fx.docs(spark, sf)
    kinds = d.filter("fulltext <> ''").select(F.lit(0).alias("classifier_id"), "target").unionByName(
        d.filter(F.col("quality").isNotNull()).select(F.lit(1).alias("classifier_id"), "target")
    )
    return ensemble.training_report(kinds)


WEIGHTED = f"""with {SCORES}, {DOCS}, v as (select classifier_id, doc_idx%3 as fold, d.target, s.target as predicted from (
select *, row_number() over (partition by doc_idx, classifier_id order by confidence desc, target) as rk from fx_scores) s join fx_docs d using (doc_idx) where rk=1),
lab as (select classifier_id, fold, target as label from v union select classifier_id, fold, predicted from v),
f as (select l.classifier_id, l.fold, label, (select count(*) from v where v.classifier_id=l.classifier_id and v.fold=l.fold and v.target=label and v.predicted=label) as tp,
(select count(*) from v where v.classifier_id=l.classifier_id and v.fold=l.fold and v.target=label) as t, (select count(*) from v where v.classifier_id=l.classifier_id and v.fold=l.fold and v.predicted=label) as p from lab l),
tr as (select classifier_id, count(distinct target) as seen from v where not (classifier_id=2 and target='es') group by classifier_id)
select classifier_id, label as target, round(avg(case when tp>0 then 2.0*tp/(t+p) else 0.0 end) * any_value(seen)/4.0, 9) as weight from f join tr using (classifier_id) group by classifier_id, label"""


@query("d20_automatic_weights", WEIGHTED)
def d20(spark, sf):
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "target")).alias("b")
    picked = fx.scores(spark, sf).groupBy(DOC, "classifier_id").agg(best)
    votes = picked.select(DOC, "classifier_id", (F.col(DOC) % 3).alias("fold"), F.col("b.target").alias("predicted"))
    votes = votes.join(fx.docs(spark, sf).select(DOC, "target"), DOC)
    trained = votes.filter(~((F.col("classifier_id") == 2) & (F.col("target") == "es")))
    return r9(ensemble.automatic_weights(votes, trained))
