"""Preprocessing, feature ranking and reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocess as p
from ..operators import ranking as r
from ..operators import reduction
from ..registry import query as q

C = "customer"
TRAIN = "c_custkey%3<>0"


def cust(t):
    return t(C).select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("x"))


def train(t):
    return cust(t).filter("c_custkey % 3 <> 0")


X = f"(SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal AS x FROM customer)"
P = f"(SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS med FROM customer WHERE {TRAIN})"
for _mode, _sql in ((1, "(x-lo)/(hi-lo)"), (2, "2*(x-lo)/(hi-lo)-1"), (3, "x/greatest(abs(lo),abs(hi))")):
    q(f"scale_mode_{_mode}", f"SELECT c_custkey, round({_sql},9) AS x FROM {X}, {P}")(lambda t, m=_mode: p.scale(cust(t), train(t), ["x"], m).select("c_custkey", F.round("x", 9).alias("x")))
q("scale_revert", f"SELECT c_custkey, round(x,6) AS x FROM {X}")(lambda t: p.scale(cust(t).withColumn("lo", F.lit(-1000.0)), cust(t), ["x"], 2).join(F.broadcast(t(C).agg(F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))), F.lit(True)).select("c_custkey", F.round((F.col("x") / 2 + 0.5) * (F.col("b") - F.col("a")) + F.col("a"), 6).alias("x")))
q("standardise_mean", f"SELECT c_custkey, round(round((x-m)/s,9),6) AS x FROM {X}, {P}")(lambda t: p.standardise(cust(t), train(t), "x").select("c_custkey", F.round("x", 6).alias("x")))
_IQR = f"(SELECT l[floor(n*0.25+0.5)::INT]+(l[floor(n*0.25+0.5)::INT+1]-l[floor(n*0.25+0.5)::INT])*(n*0.25+0.5-floor(n*0.25+0.5)) AS a, l[floor(n*0.75+0.5)::INT]+(l[floor(n*0.75+0.5)::INT+1]-l[floor(n*0.75+0.5)::INT])*(n*0.75+0.5-floor(n*0.75+0.5)) AS b FROM (SELECT list_sort(list(c_acctbal)) AS l, count(*)::DOUBLE AS n FROM customer WHERE {TRAIN}))"
q("standardise_median", f"SELECT c_custkey, round(round((x-med)/(b-a),9),6) AS x FROM {X}, {P}, {_IQR}")(lambda t: p.standardise(cust(t), train(t), "x", "median").select("c_custkey", F.round("x", 6).alias("x")))
_CL = "greatest(-1,least(1,(x-m)/s))"
q("standardise_winsor", f"SELECT c_custkey, round({_CL}-(SELECT avg({_CL}) FROM {X}, {P} WHERE {TRAIN}),6) AS x FROM {X}, {P}")(lambda t: p.standardise(cust(t), train(t), "x", winsor=1.0).select("c_custkey", F.round("x", 6).alias("x")))
q("centre_mean", f"SELECT c_custkey, round(x-m,6) AS x FROM {X}, {P}")(lambda t: p.centre(cust(t), train(t), "x").select("c_custkey", F.round("x", 6).alias("x")))
q("unit_norm", f"SELECT c_custkey, round((x-m)/(SELECT sum(abs(x-m)) FROM {X}, {P} WHERE {TRAIN}),9) AS x FROM {X}, {P}")(lambda t: p.unit_norm(cust(t), train(t), "x").select("c_custkey", F.round("x", 9).alias("x")))
q("normalise_percent", f"SELECT c_custkey, round(100*x/(g+1)-100,6) AS x FROM {X} JOIN (SELECT c_mktsegment, avg(c_acctbal) AS g FROM customer WHERE {TRAIN} GROUP BY 1) USING (c_mktsegment)")(lambda t: p.percent_of_group(cust(t), train(t), "x", "c_mktsegment").select("c_custkey", F.round("x", 6).alias("x")))
q("remove_mean_difference", f"SELECT c_custkey, round(x-(coalesce(g,o)-m),6) AS x FROM {X} LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS g FROM customer WHERE {TRAIN} AND c_nationkey>3 GROUP BY 1) USING (c_nationkey) JOIN (SELECT c_nationkey, avg(c_acctbal) AS o FROM customer GROUP BY 1) USING (c_nationkey), (SELECT avg(c_acctbal) AS m FROM customer WHERE {TRAIN} AND c_nationkey>3)")(
    lambda t: p.remove_mean_difference(cust(t), train(t).filter("c_nationkey > 3"), "x", "c_nationkey").select("c_custkey", F.round("x", 6).alias("x"))
)
q("residualise_covariate", "SELECT p_partkey, round(p_retailprice-(s*p_size+i),6) AS y FROM part, (SELECT regr_slope(p_retailprice,p_size) AS s, regr_intercept(p_retailprice,p_size) AS i FROM part WHERE p_partkey%3<>0)")(
    lambda t: p.residualise(t("part").withColumn("y", F.col("p_retailprice")), t("part").filter("p_partkey % 3 <> 0").withColumn("y", F.col("p_retailprice")), ["y"], ["p_size"]).select("p_partkey", F.round("y", 6).alias("y"))
)
q("residualise_revert", "SELECT p_partkey, round(p_retailprice,4) AS y FROM part")(
    lambda t: (lambda d: p.residualise(p.residualise(d, d, ["y"], ["p_size"]), d, ["y"], ["p_size"], revert=True).select("p_partkey", F.round("y", 4).alias("y")))(t("part").withColumn("y", F.col("p_retailprice")))
)


def holes(t):
    return t("part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("a"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("b"), (F.col("p_partkey") % 11).cast("double").alias("c"))


H = "(SELECT p_partkey, CASE WHEN p_partkey%4<>0 THEN p_size::DOUBLE END AS a, CASE WHEN p_partkey%5<>0 THEN p_retailprice END AS b, (p_partkey%11)::DOUBLE AS c FROM part)"
q("impute_column_mean", f"SELECT p_partkey, round(coalesce(a,ma),6) AS a, round(coalesce(b,mb),6) AS b FROM {H}, (SELECT avg(a) AS ma, avg(b) AS mb FROM {H})")(lambda t: p.impute_mean(holes(t), holes(t), ["a", "b"]).select("p_partkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b")))
q("impute_case_median", f"SELECT p_partkey, coalesce(a,med) AS a, coalesce(b,med) AS b FROM (SELECT *, list_median(list_filter([a,b,c], lambda x: x IS NOT NULL)) AS med FROM {H})".replace("list_median", "list_aggregate").replace("x IS NOT NULL))", "x IS NOT NULL), 'median')"))(lambda t: p.impute_case_median(holes(t), ["a", "b", "c"]).select("p_partkey", "a", "b"))
_HAVE = lambda f: "+".join(f"coalesce({f.replace('#', c)},0)" for c in "abc")
_NORM = lambda v: f"greatest(sqrt({_HAVE(f'CASE WHEN h.# IS NOT NULL THEN {v}.#*{v}.# END')}),1e-300)"
for _m, _sql in (("euclidean", f"sqrt({_HAVE('pow(h.#-d.#,2)')})"), ("cityblock", _HAVE("abs(h.#-d.#)")), ("cosine", f"1-({_HAVE('h.#*d.#')})/({_NORM('h')}*{_NORM('d')})"), ("hamming", f"({_HAVE('(h.#<>d.#)::INT')})::DOUBLE/({_HAVE('(h.#=h.#)::INT')})")):
    q(f"impute_knn_{_m}", f"""SELECT p_partkey, round(coalesce(h.a,n.a),6) AS a, round(coalesce(h.b,n.b),6) AS b, h.c AS c FROM {H} h LEFT JOIN (SELECT id, median(a) AS a, median(b) AS b FROM
 (SELECT h.p_partkey AS id, d.a, d.b, row_number() OVER (PARTITION BY h.p_partkey ORDER BY round({_sql},12), d.a, d.b, d.c) AS k FROM {H} h JOIN {H} d ON (h.a IS NULL OR h.b IS NULL) AND d.a IS NOT NULL AND d.b IS NOT NULL) WHERE k<=5 GROUP BY 1) n ON id=p_partkey""")(
        lambda t, m=_m: p.impute_knn(holes(t), holes(t), ["a", "b", "c"], 5, m).withColumns({c: F.round(c, 6) for c in "ab"})
    )
q("impute_downshift")(lambda t: p.impute_downshift(holes(t), holes(t), "b", "p_partkey"))
q("discretise", f"SELECT c_custkey, sign((x-m)/s)*least(5,ceil(round(abs((x-m)/s)/0.5,9))*0.5) AS x FROM {X}, {P}")(lambda t: p.discretise(cust(t), train(t), "x").select("c_custkey", "x"))
q("apply_binning", "SELECT p_partkey, (p_size>=10)::INT+(p_size>=20)::INT+(p_size>=40)::INT AS bin FROM part")(lambda t: t("part").select("p_partkey", p.binned(F.col("p_size"), [10, 20, 40]).alias("bin")))
q("eliminate_uninformative", "SELECT p_partkey, p_size, p_retailprice FROM part")(lambda t: (lambda d: d.select("p_partkey", *p.keep_informative(d, ["p_size", "p_retailprice", "zero", "gap"])))(t("part").withColumn("zero", F.lit(1.0)).withColumn("gap", F.nullif("p_size", F.lit(1)))))
q("copy_features", "SELECT * FROM supplier")(lambda t: t("supplier").select("*"))
q("zero_out", "SELECT p_partkey, coalesce(nullif(p_size,1),0) AS a FROM part")(lambda t: t("part").select("p_partkey", F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0)).alias("a")))
_YJ = "(CASE WHEN z>=0 THEN (pow(z+1,0.5)-1)/0.5 ELSE -(pow(1-z,1.5)-1)/1.5 END)"
q("yeo_johnson_fixed", f"SELECT c_custkey, round({_YJ},9) AS x FROM (SELECT c_custkey, c_acctbal/1000 AS z FROM customer)")(lambda t: cust(t).select("c_custkey", F.round(p.yeo_johnson(F.col("x") / 1000, 0.5), 9).alias("x")))
q("yeo_johnson_fitted")(lambda t: (lambda d: d.withColumn("y", p.yeo_johnson(F.col("x"), p.yeo_johnson_lambda(d, "x"))))(t("events").select("event_id", F.col("value").alias("x"))))
q("box_cox_log", "SELECT c_custkey, round(ln(c_acctbal-lo+1),9) AS x FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)")(lambda t: cust(t).join(F.broadcast(cust(t).agg(F.min("x").alias("lo"))), F.lit(True)).select("c_custkey", F.round(p.box_cox(F.col("x"), 0, 1 - F.col("lo")), 9).alias("x")))
q("disparate_impact_removal")(lambda t: p.disparate_impact(cust(t), train(t), "x", "c_mktsegment"))
q("combat_harmonise")(lambda t: p.combat(t("lineitem").select("l_orderkey", "l_linestatus", "l_quantity", "l_extendedprice", "l_tax", "l_discount"), t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_discount"], "l_linestatus"))
q("oversample_adasyn")(lambda t: p.oversample(t("part").select((F.col("p_size") > 40).cast("int").alias("y"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), ["a", "b"], "y"))
q("intensity_normalisation", "SELECT c_custkey, round(x-(g-m),6) AS x FROM (SELECT c_custkey, c_mktsegment, c_acctbal AS x, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS g, avg(c_acctbal) OVER () AS m FROM customer)")(lambda t: p.remove_mean_difference(cust(t), cust(t), "x", "c_mktsegment").select("c_custkey", F.round("x", 6).alias("x")))
q("custom_step", "SELECT c_custkey, c_acctbal*2 AS x FROM customer")(lambda t: cust(t).select("c_custkey", "x").mapInPandas(lambda it: (d.assign(x=d.x * 2) for d in it), "c_custkey long, x double"))
EDGES = "(SELECT least(c_nationkey,s_nationkey) AS a, greatest(c_nationkey,s_nationkey) AS b, count(*)::DOUBLE AS w FROM (SELECT c_nationkey, (c_nationkey*7+c_custkey%5)%25 AS s_nationkey FROM customer) WHERE c_nationkey<>s_nationkey GROUP BY 1,2)"


def edges(t):
    e = t(C).select("c_nationkey", ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 5) % 25).alias("o")).filter("c_nationkey <> o")
    return e.groupBy(F.least("c_nationkey", "o").alias("a"), F.greatest("c_nationkey", "o").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))


_BOTH = f"(SELECT a AS u, b AS v, w FROM {EDGES} UNION ALL SELECT b, a, w FROM {EDGES})"
q("graph_metrics", f"""SELECT d.u AS node, degree, strength, coalesce(tri,0)::BIGINT AS triangles, round(CASE WHEN degree>1 THEN 2.0*coalesce(tri,0)/(degree*(degree-1)) ELSE 0 END,9) AS clustering FROM (SELECT u, count(*) AS degree, sum(w) AS strength FROM {_BOTH} GROUP BY 1) d
 LEFT JOIN (SELECT x.u, count(*)/2 AS tri FROM {_BOTH} x JOIN {_BOTH} y ON x.v=y.u JOIN {_BOTH} z ON y.v=z.u AND z.v=x.u GROUP BY 1) t ON d.u=t.u""")(lambda t: p.graph_metrics(edges(t)).withColumn("clustering", F.round("clustering", 9)))
q("graph_sparsity", f"SELECT a, b, w FROM (SELECT *, percent_rank() OVER (PARTITION BY a ORDER BY abs(w) DESC) AS p FROM {EDGES}) WHERE p<0.3")(lambda t: p.sparsify(edges(t), "a", "w", 0.3))
q("roi_means", "SELECT p_brand, p_type, round(avg(p_retailprice),6) AS m FROM part GROUP BY 1,2")(lambda t: t("part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("m")))

# ranking
L = "(SELECT l_linestatus, l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem)"
COLS = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]


def _each(sql):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, round({sql.replace('#', c)},6) AS weight FROM {L}" for c in COLS)


def lines(t):
    return t("lineitem").select("l_linestatus", (F.col("l_linestatus") == "O").cast("int").alias("y"), *COLS)


_AV = lambda k, f: f"{f}(CASE WHEN l_linestatus='{k}' THEN # END)"
q("rank_variance", _each("var_samp(#)"))(lambda t: r.variance(lines(t), COLS).withColumn("weight", F.round("weight", 6)))
q("rank_fscore", _each(f"pow({_AV('O', 'avg')}-{_AV('F', 'avg')},2)/({_AV('O', 'stddev_pop')}+{_AV('F', 'stddev_pop')})"))(lambda t: r.fscore(lines(t), COLS, "y").withColumn("weight", F.round("weight", 6)))
q("rank_fscore_sample_sd", _each(f"pow({_AV('O', 'avg')}-{_AV('F', 'avg')},2)/({_AV('O', 'stddev_samp')}+{_AV('F', 'stddev_samp')})"))(lambda t: r.fscore(lines(t), COLS, "y", sample=True).withColumn("weight", F.round("weight", 6)))
q("rank_pearson", _each("abs(corr(#,CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END))"))(lambda t: r.pearson(lines(t), COLS, "y").withColumn("weight", F.round("weight", 6)))
_SSB = "({n1}*pow({m1}-avg(#),2)+{n0}*pow({m0}-avg(#),2))".format(n1=_AV("O", "count"), n0=_AV("F", "count"), m1=_AV("O", "avg"), m0=_AV("F", "avg"))
q("rank_anova", _each(f"{_SSB}/((var_pop(#)*count(#)-{_SSB})/(count(#)-2))"))(lambda t: r.anova(lines(t), COLS, "y").select("feature", F.round("f", 6).alias("weight")))
q("rank_anova_p")(lambda t: r.anova(lines(t), COLS, "y"))
_AUCF = " UNION ALL ".join(f"SELECT '{c}' AS feature, round((sum(CASE WHEN y=1 THEN rk END)-n1*(n1+1)/2)/(n1*n0),6) AS weight FROM (SELECT y, rank() OVER (ORDER BY {c})+(count(*) OVER (PARTITION BY {c})-1)/2.0 AS rk, CAST(sum(y) OVER () AS DOUBLE) AS n1, CAST(sum(1-y) OVER () AS DOUBLE) AS n0 FROM (SELECT CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS y, {c} FROM lineitem)) GROUP BY n1,n0" for c in COLS)
q("rank_auc", _AUCF)(lambda t: r.auc(lines(t), COLS, "y").withColumn("weight", F.round("weight", 6)))
_MI = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(sum(p*log2(p/(px*py))),6) AS weight FROM (SELECT p, sum(p) OVER (PARTITION BY b) AS px, sum(p) OVER (PARTITION BY y) AS py FROM (SELECT l_linestatus AS y, least(floor(({c}-lo)/(hi-lo)*10),9) AS b, count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1,2))" for c in COLS)
q("rank_mutual_information", _MI)(lambda t: r.mutual_information(lines(t), COLS, "y").withColumn("weight", F.round("weight", 6)))
for _c in ("mrmr", "jmi", "cmim", "disr", "icap", "fcbf"):
    q(f"rank_{_c}")(lambda t, c=_c: r.greedy(lines(t), COLS, "y", c))
q("rank_relief")(lambda t: r.relief(lines(t), COLS, "y"))
q("rank_linear_svm")(lambda t: r.linear_svm(lines(t), COLS, "y"))
q("rank_postprocess", "SELECT feature, round((w-min(w) OVER ())/(max(w) OVER ()-min(w) OVER ()),9) AS weight FROM (VALUES ('a',1.0::DOUBLE),('b',3.0),('c',2.5)) v(feature,w)")(lambda t: r.rescale(t("region").sparkSession.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 2.5)], "feature string, weight double")).withColumn("weight", F.round("weight", 9)))
q("feature_subsets", "SELECT s.k AS subset, v.feature FROM (VALUES ('a',1),('b',2),('c',3),('d',4)) v(feature,r), (VALUES (1),(2),(4)) s(k) WHERE r<=k")(lambda t: r.subsets(t("region").sparkSession.createDataFrame([("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0)], "feature string, weight double"), [1, 2, 4]))
q("selection_consensus", "SELECT l_linenumber AS feature, round(avg(s),6) AS share FROM (SELECT l_linenumber, l_orderkey%5 AS fold, CASE WHEN avg(l_discount)>0.05 THEN 1.0 ELSE 0.0 END AS s FROM lineitem GROUP BY 1,2) GROUP BY 1")(
    lambda t: t("lineitem").groupBy(F.col("l_linenumber").alias("feature"), (F.col("l_orderkey") % 5).alias("fold")).agg((F.avg("l_discount") > 0.05).cast("double").alias("s")).groupBy("feature").agg(F.round(F.avg("s"), 6).alias("share"))
)
for _m in ("pca", "lda", "pls", "nmf", "kernel_pca", "fast_ica", "lpp"):
    q(f"reduce_{_m}")(lambda t, m=_m: reduction.reduce(lines(t), COLS, "y", m, 2))
