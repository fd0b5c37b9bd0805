"""Performance metrics by group, over lineitem, orders, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import stats
from ..operators import calibration, scores
from ..registry import query

R = 6


def binary(read) -> DataFrame:
    """Open lines against a rule on the quantity; a rule value of 0 decides nothing."""
    return read("lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("y"), (F.col("l_quantity") - 25).cast("double").alias("p"))


B = "(SELECT l_returnflag, CASE WHEN l_linestatus='O' THEN 1 ELSE -1 END AS y, CAST(l_quantity-25 AS DOUBLE) AS p FROM lineitem)"
C = f"""(SELECT l_returnflag, CAST(sum(CASE WHEN y>0 AND p>0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y<0 AND p<0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
 CAST(sum(CASE WHEN y<0 AND p>0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN y>0 AND p<0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
 CAST(sum(CASE WHEN y>0 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, 100*avg(CASE WHEN sign(p)=y THEN 1.0 ELSE 0.0 END) AS acc FROM {B} GROUP BY 1)"""
S, Z = "(100*tp/nullif(tp+fn,0))", "(100*tn/nullif(tn+fp,0))"
PPV, NPV = "coalesce(100*tp/nullif(tp+fp,0),0)", "coalesce(100*tn/nullif(tn+fn,0),0)"
N = "(tp+tn+fp+fn)"
PE = f"(((tp+fp)*(tp+fn)+(tn+fp)*(tn+fn))/({N}*{N}))"
SQL = {
    "accuracy": "acc", "tpr": "100*tp/nullif(pos,0)", "sensitivity": S, "specificity": Z, "fpr": f"100-{Z}", "ppv": PPV, "npv": NPV,
    "mcc": "coalesce((tp*tn-fp*fn)/nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),0),0)", "bac": f"coalesce(({S}+{Z})/2,{S},{Z})", "bac2": f"coalesce({S}*{Z}/100,{S},{Z})",
    "fscore": "coalesce(100*2*tp/nullif(2*tp+fn+fp,0),0)", "gmean": f"sqrt({S}*{Z})/100", "psi": f"{PPV}+{NPV}-100", "nnp": f"coalesce(abs(100/nullif({PPV}+{NPV}-100,0)),0)",
    "plr": f"coalesce({S}/nullif(100-{Z},0),0)", "nlr": f"coalesce({Z}/nullif(100-{S},0),0)", "nlr_usual": f"coalesce((100-{S})/nullif({Z},0),0)", "dor": f"{S}*{Z}/nullif((100-{S})*(100-{Z}),0)",
    "youden": f"({S}+{Z})/100-1", "kappa": f"((tp+tn)/{N}-{PE})/nullif(1-{PE},0)",
}

for _name, _f in m.BINARY.items():
    query(f"metric_{_name}", f"SELECT l_returnflag, round({SQL[_name]},{R}) AS {_name} FROM {C}")(
        lambda read, name=_name, f=_f: binary(read).groupBy("l_returnflag").agg(F.round(f(F.col("y"), F.col("p")), R).alias(name))
    )

query("metric_all_binary", f"SELECT l_returnflag, {', '.join(f'round({v},{R}) AS {k}' for k, v in SQL.items())} FROM {C}")(
    lambda read: binary(read).groupBy("l_returnflag").agg(*(F.round(f(F.col("y"), F.col("p")), R).alias(k) for k, f in m.BINARY.items()))
)

REG = "(SELECT l_returnflag, l_extendedprice AS y, l_quantity*1500.0 AS p FROM lineitem)"
E2 = "pow(p-y,2)"
CC = "(CASE WHEN min(p)=max(p) THEN 0 ELSE corr(y,p) END)"
REG_SQL = {"mse": f"avg({E2})", "mae": "avg(abs(p-y))", "mae_sd": "stddev_samp(abs(p-y))", "rmsd": f"sqrt(avg({E2}))", "nrmsd": f"100*sqrt(avg({E2}))/nullif(max(y)-min(y),0)", "nrsmd": f"100*sqrt(sum({E2})/nullif(sum(y*y),0))", "cc": CC, "scc": f"100*pow({CC},2)"}
for _name, _f in m.REGRESSION.items():
    query(f"metric_{_name}", f"SELECT l_returnflag, round({REG_SQL[_name]},4) AS {_name} FROM {REG} GROUP BY 1")(
        lambda read, name=_name, f=_f: read("lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p")).groupBy("l_returnflag").agg(F.round(f(F.col("y"), F.col("p")), 4).alias(name))
    )

AUC = f"""(SELECT l_returnflag, (sum(CASE WHEN y>0 THEN r ELSE 0 END) - np*(np+1)/2)/(np*nn) AS auc, np, nn FROM (
 SELECT l_returnflag, y, rank() OVER (PARTITION BY l_returnflag ORDER BY p) + (count(*) OVER (PARTITION BY l_returnflag, p) - 1)/2.0 AS r,
 CAST(sum(CASE WHEN y>0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS np, CAST(sum(CASE WHEN y<0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS nn FROM {B})
 WHERE np>0 AND nn>0 GROUP BY l_returnflag, np, nn)"""


@query("metric_auc", f"SELECT l_returnflag, round(auc,{R}) AS auc FROM {AUC}")
def _auc(read):
    return stats.auc(binary(read), ["l_returnflag"], "y", "p").filter("auc is not null").select("l_returnflag", F.round("auc", R).alias("auc"))


@query("metric_auc_interval", f"""SELECT l_returnflag, round(auc,{R}) AS auc, round(auc-1.96*se,{R}) AS low, round(auc+1.96*se,{R}) AS high FROM (SELECT *,
 sqrt((auc*(1-auc)+(np-1)*(auc/(2-auc)-auc*auc)+(nn-1)*(2*auc*auc/(1+auc)-auc*auc))/(np*nn)) AS se FROM {AUC})""")
def _auc_ci(read):
    """Hanley-McNeil limits."""
    df = binary(read)
    n = df.groupBy("l_returnflag").agg(F.sum((F.col("y") > 0).cast("double")).alias("np"), F.sum((F.col("y") < 0).cast("double")).alias("nn"))
    return scores.auc_interval(stats.auc(df, ["l_returnflag"], "y", "p").join(n, "l_returnflag").filter("auc is not null")).select("l_returnflag", *(F.round(c, R).alias(c) for c in ("auc", "low", "high")))


@query("metric_roc_curve", f"""SELECT l_returnflag, p AS threshold, CAST(sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER w AS BIGINT) AS fp FROM (SELECT l_returnflag, p, sum(CASE WHEN y>0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN y<0 THEN 1 ELSE 0 END) AS b
 FROM {B} GROUP BY 1,2) WINDOW w AS (PARTITION BY l_returnflag ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def _roc(read):
    return scores.roc(binary(read), ["l_returnflag"], "y", "p").select("l_returnflag", "threshold", "tp", "fp")


@query("metric_precision_recall", f"""SELECT l_returnflag, p AS threshold, round(sum(a) OVER w/CAST(sum(a+b) OVER w AS DOUBLE),{R}) AS precision_, round(sum(a) OVER w/nullif(CAST(sum(a) OVER (PARTITION BY l_returnflag) AS DOUBLE),0),{R}) AS recall_
 FROM (SELECT l_returnflag, p, sum(CASE WHEN y>0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN y<0 THEN 1 ELSE 0 END) AS b FROM {B} GROUP BY 1,2) WINDOW w AS (PARTITION BY l_returnflag ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def _pr(read):
    r = scores.roc(binary(read), ["l_returnflag"], "y", "p")
    return r.select("l_returnflag", "threshold", F.round(stats.ratio(F.col("tp"), F.col("tp") + F.col("fp")), R).alias("precision_"), F.round(stats.ratio(F.col("tp"), F.col("pos")), R).alias("recall_"))


PROB = "(SELECT l_returnflag, CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS y, l_discount*10 AS p FROM lineitem)"


def probable(read) -> DataFrame:
    return read("lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))


BIN = "least(CAST(floor(round(p*10,9)) AS BIGINT),9)"


@query("metric_brier", f"SELECT l_returnflag, round(avg(pow(p-y,2)),{R}) AS brier FROM {PROB} GROUP BY 1")
def _brier(read):
    return probable(read).groupBy("l_returnflag").agg(F.round(m.brier(F.col("y"), F.col("p")), R).alias("brier"))


@query("calibration_reliability_bins", f"SELECT l_returnflag, {BIN} AS bin, count(*) AS n, round(avg(p),{R}) AS mean_p, round(avg(y),{R}) AS observed FROM {PROB} GROUP BY 1,2")
def _bins(read):
    return calibration.reliability(probable(read), ["l_returnflag"], "y", "p").select("l_returnflag", "bin", "n", F.round("mean_p", R).alias("mean_p"), F.round("observed", R).alias("observed"))


@query("metric_ece", f"SELECT l_returnflag, round(sum(n*abs(a-b))/sum(n),{R}) AS ece, round(max(abs(a-b)),{R}) AS worst FROM (SELECT l_returnflag, {BIN} AS bin, count(*) AS n, avg(p) AS a, avg(y) AS b FROM {PROB} GROUP BY 1,2) GROUP BY 1")
def _ece(read):
    return calibration.expected_error(probable(read), ["l_returnflag"], "y", "p").select("l_returnflag", F.round("ece", R).alias("ece"), F.round("worst", R).alias("worst"))


DOC = "(SELECT l.doc_id, l.quality AS y, round(least(d.n_chars,4000)/4000.0,6) AS p FROM labels l JOIN documents d ON l.doc_id=d.doc_id)"


def rated(read) -> DataFrame:
    return read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.round(F.least("n_chars", F.lit(4000)) / 4000.0, 6).alias("p"))


@query("metric_mce", f"SELECT round(max(abs(a-b)),{R}) AS mce FROM (SELECT g, avg(y) AS a, avg(p) AS b FROM (SELECT *, ntile(10) OVER (ORDER BY p, y) AS g FROM {DOC}) GROUP BY g)")
def _mce(read):
    return calibration.maximum_error(rated(read), "y", "p").select(F.round("mce", R).alias("mce"))


@query("metric_net_benefit", f"SELECT l_returnflag, round(sum(CASE WHEN y>0 AND p>=0.3 THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE)-sum(CASE WHEN y<=0 AND p>=0.3 THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE)*(0.3/0.7),{R}) AS net_benefit FROM {PROB} GROUP BY 1")
def _nb(read):
    return probable(read).groupBy("l_returnflag").agg(F.round(m.net_benefit(F.col("y"), F.col("p"), 0.3), R).alias("net_benefit"))


@query("metric_decision_curve", f"""SELECT t AS threshold, round(tp/n-fp/n*t/(1-t),{R}) AS net_benefit, round(prev-(1-prev)*t/(1-t),{R}) AS treat_all FROM (SELECT t, CAST(count(*) AS DOUBLE) AS n, avg(y) AS prev,
 sum(CASE WHEN y=1 AND p>=t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y=0 AND p>=t THEN 1 ELSE 0 END) AS fp FROM {DOC}, (SELECT k/20.0::DOUBLE AS t FROM range(1,20) r(k)) GROUP BY t)""")
def _dca(read):
    return calibration.decision_curve(rated(read), "y", "p", [k / 20 for k in range(1, 20)]).select("threshold", F.round("net_benefit", R).alias("net_benefit"), F.round("treat_all", R).alias("treat_all"))


MULTI = "(SELECT o_orderpriority, o_orderstatus AS y, CASE WHEN o_totalprice<100000 THEN 'F' WHEN o_totalprice<200000 THEN 'O' ELSE 'P' END AS p FROM orders)"


def classes(read) -> DataFrame:
    return read("orders").select("o_orderpriority", F.col("o_orderstatus").alias("y"), F.when(F.col("o_totalprice") < 100000, "F").when(F.col("o_totalprice") < 200000, "O").otherwise("P").alias("p"))


@query("agg_confusion_matrix", f"SELECT y, " + ", ".join(f"sum(CASE WHEN p='{k}' THEN 1 ELSE 0 END)::BIGINT AS {k}_" for k in "FOP") + f" FROM {MULTI} GROUP BY y")
def _conf(read):
    return scores.confusion(classes(read), "y", "p", ["F", "O", "P"]).select("y", *(F.col(k).alias(f"{k}_") for k in "FOP"))


OVR = "(SELECT k, sum(CASE WHEN y=k AND p=k THEN 1 ELSE 0 END)/nullif(CAST(sum(CASE WHEN y=k THEN 1 ELSE 0 END) AS DOUBLE),0) AS tpr, sum(CASE WHEN y<>k AND p<>k THEN 1 ELSE 0 END)/nullif(CAST(sum(CASE WHEN y<>k THEN 1 ELSE 0 END) AS DOUBLE),0) AS tnr FROM " + MULTI + ", (VALUES ('F'),('O'),('P')) v(k) GROUP BY k)"


@query("metric_one_vs_rest", f"SELECT k AS class_, round(100*tpr,{R}) AS sensitivity, round(100*tnr,{R}) AS specificity, round(50*(tpr+tnr),{R}) AS bac FROM {OVR}")
def _ovr(read):
    return scores.one_vs_rest(classes(read), "y", "p", ["F", "O", "P"]).select("class_", *(F.round(c, R).alias(c) for c in ("sensitivity", "specificity", "bac")))


@query("metric_multiclass", f"SELECT round((SELECT 100*avg(CASE WHEN y=p THEN 1.0 ELSE 0.0 END) FROM {MULTI}),{R}) AS accuracy, round(avg(50*(tpr+tnr)),{R}) AS mean_bac FROM {OVR}")
def _multi(read):
    return scores.multiclass(classes(read), "y", "p", ["F", "O", "P"]).select(F.round("accuracy", R).alias("accuracy"), F.round("mean_bac", R).alias("mean_bac"))


OFF = f"(SELECT y, p, count(*)/CAST(sum(count(*)) OVER (PARTITION BY y) AS DOUBLE) AS rate FROM {MULTI} GROUP BY y, p)"


@query("metric_ratio_to_random", f"SELECT round(100*(1-(SELECT sum(rate) FROM {OFF} WHERE y<>p)/(3*2/3.0)),{R}) AS ratio_to_random")
def _rand(read):
    return scores.ratio_to_random(classes(read), "y", "p", 3).select(F.round("ratio_to_random", R).alias("ratio_to_random"))


@query("metric_area_ratio", f"""SELECT round(sum(r1*r2)/sum(m1*m2),{R}) AS area_ratio FROM (SELECT rate AS m1, lead(rate,1,first) OVER (ORDER BY y,p) AS m2, 1/3.0 AS r1, 1/3.0 AS r2 FROM
 (SELECT g.y, g.p, coalesce(o.rate,0) AS rate, first_value(coalesce(o.rate,0)) OVER (ORDER BY g.y,g.p) AS first FROM (SELECT a.k AS y, b.k AS p FROM (VALUES ('F'),('O'),('P')) a(k), (VALUES ('F'),('O'),('P')) b(k) WHERE a.k<>b.k) g LEFT JOIN {OFF} o ON g.y=o.y AND g.p=o.p))""")
def _area(read):
    return scores.area_ratio(classes(read), "y", "p", ["F", "O", "P"]).select(F.round("area_ratio", R).alias("area_ratio"))


@query("metric_by_site", f"SELECT o_orderpriority, round(100*avg(CASE WHEN y=p THEN 1.0 ELSE 0.0 END),{R}) AS accuracy, count(*) AS n FROM {MULTI} GROUP BY 1")
def _site(read):
    return classes(read).groupBy("o_orderpriority").agg(F.round(100 * F.avg((F.col("y") == F.col("p")).cast("double")), R).alias("accuracy"), F.count(F.lit(1)).alias("n"))


SUB = f"(SELECT l_orderkey % 5 AS fold, l_returnflag, CASE WHEN l_linestatus='O' THEN 1 ELSE -1 END AS y, CAST(l_quantity-25 AS DOUBLE) AS p FROM lineitem)"


@query("metric_by_subgroup_and_fold", f"SELECT fold, l_returnflag, round(100*avg(CASE WHEN sign(p)=y THEN 1.0 ELSE 0.0 END),{R}) AS accuracy FROM {SUB} GROUP BY 1,2")
def _sub(read):
    df = read("lineitem").select((F.col("l_orderkey") % 5).alias("fold"), "l_returnflag", F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("y"), (F.col("l_quantity") - 25).cast("double").alias("p"))
    return df.groupBy("fold", "l_returnflag").agg(F.round(m.accuracy(F.col("y"), F.col("p")), R).alias("accuracy"))


@query("metric_rows", f"SELECT l_returnflag, u.metric, round(u.value,{R}) AS value FROM (SELECT l_returnflag, {S} AS sensitivity, {Z} AS specificity FROM {C}), LATERAL (VALUES ('sensitivity', sensitivity), ('specificity', specificity)) u(metric, value)")
def _rows(read):
    wide = binary(read).groupBy("l_returnflag").agg(m.sensitivity(F.col("y"), F.col("p")).alias("sensitivity"), m.specificity(F.col("y"), F.col("p")).alias("specificity"))
    return wide.unpivot("l_returnflag", ["sensitivity", "specificity"], "metric", "value").withColumn("value", F.round("value", R))


@query("metric_inverse_density_mse", f"""SELECT round(sum(w*pow(p-y,2))/sum(w),{R}) AS mse FROM (SELECT g.y, g.p, g.c/(SELECT sum(k.n*exp(-0.5*pow((g.y-k.y)/s.h,2))) FROM
 (SELECT y, count(*) AS n FROM {{T}} GROUP BY y) k) AS w FROM (SELECT y, p, CAST(count(*) AS DOUBLE) AS c FROM {{T}} GROUP BY y, p) g, (SELECT 1.06*stddev_samp(y)*pow(count(*),-0.2) AS h FROM {{T}}) s)""".replace("{T}", "(SELECT CAST(p_size AS DOUBLE) AS y, round(p_retailprice/40,0) AS p FROM part)"))
def _density(read):
    df = read("part").select(F.col("p_size").cast("double").alias("y"), F.round(F.col("p_retailprice") / 40, 0).alias("p"))
    return scores.inverse_density_mse(df, "y", "p").select(F.round("mse", R).alias("mse"))


@query("metric_criteria")
def _criteria(read):
    """Criterion names with the direction in which they are better."""
    spark = read("region").sparkSession
    return spark.createDataFrame([(k, m.direction(k)) for k in [*m.BINARY, *m.REGRESSION]], "criterion string, direction string")
