"""Selection, picks, robust scales, filters, component bookkeeping, out-of-fold lines and export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closed_forms as c
from ..registry import query as q


def part(t):
    return t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")


def cust(t):
    return t("customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")


q("pick_variates", "SELECT p_partkey, p_size, p_retailprice FROM part")(lambda t: c.pick_variates(t("part"), {"shape": ["p_size"], "price": ["p_retailprice"], "kind": ["p_brand"]}, ["shape", "price"], ["p_partkey"]))
q("commit_selection", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 10")(lambda t: c.commit_selection(cust(t), F.col("c_nationkey") < 10, ["c_acctbal"], ["c_custkey"]))
q("swap_holdout", "SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN 'discovery' ELSE 'holdout' END AS role FROM customer")(
    lambda t: c.swap_roles(cust(t).filter("c_custkey % 3 <> 0").select("c_custkey"), cust(t).filter("c_custkey % 3 = 0").select("c_custkey"))
)
q("combination_at", "SELECT n_nationkey, [x,y,z]::VARCHAR AS members FROM nation JOIN (SELECT x,y,z,row_number() OVER (ORDER BY x,y,z) AS m FROM range(1,8) a(x), range(1,8) b(y), range(1,8) d(z) WHERE x<y AND y<z) ON m=n_nationkey+1")(
    lambda t: t("nation").select("n_nationkey", F.concat(F.lit("["), F.concat_ws(", ", c.combination_at(F.col("n_nationkey") + 1, 7, 3).cast("array<string>")), F.lit("]")).alias("members"))
)
q("random_subsets")(lambda t: c.random_subsets(t("region").sparkSession, 12, 4, 100, seed=5))
_U = "(SELECT c_custkey, ((c_custkey%97)+0.5)/97.0 AS u FROM customer)"
_W = "(SELECT n_nationkey, sum(n_nationkey+1) OVER (ORDER BY n_nationkey) AS cum, sum(n_nationkey+1) OVER () AS total FROM nation)"
q("weighted_pick", f"SELECT c_custkey, min(n_nationkey) AS n_nationkey FROM {_U} JOIN {_W} ON cum::DOUBLE > u*total GROUP BY 1")(
    lambda t: c.weighted_pick(t("nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("w")), t("customer").select("c_custkey", ((F.col("c_custkey") % 97 + 0.5) / 97).alias("u")), "n_nationkey", "w", "u").select("c_custkey", "n_nationkey")
)
q("rank_uniform", "SELECT o_orderkey, round((row_number() OVER (ORDER BY o_totalprice,o_orderkey)-1)/(count(*) OVER ()-1)::DOUBLE,6) AS r FROM orders")(
    lambda t: c.rank_uniform(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "r").select("o_orderkey", F.round("r", 6).alias("r"))
)
q("toeplitz", """SELECT a.n_nationkey+1 AS i, b.n_nationkey+1 AS j, CASE WHEN a.n_nationkey>=b.n_nationkey THEN 10.0*(a.n_nationkey-b.n_nationkey) ELSE (b.n_nationkey-a.n_nationkey)+0.5 END::DOUBLE AS "value" FROM nation a, nation b""")(
    lambda t: c.toeplitz(t("nation").select((F.col("n_nationkey") + 1).alias("p"), (10.0 * F.col("n_nationkey")).alias("c"), (F.col("n_nationkey") + 0.5).alias("r")), "p", "c", "r")
)
_PS = "(SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_size::DOUBLE AS x FROM part WHERE p_partkey%3<>0)"
_V = "(SELECT p_size::DOUBLE AS v, count(*) AS c FROM part WHERE p_partkey%3<>0 GROUP BY 1)"
_N = "(SELECT count(*) AS n FROM part WHERE p_partkey%3<>0)"
q("scale_sn", f"""WITH v AS {_V}, n AS {_N}, d AS (SELECT a.v AS x, a.c AS cx, abs(a.v-b.v) AS d, sum(b.c) AS c FROM v a, v b GROUP BY 1,2,3),
 hi AS (SELECT x, any_value(cx) AS cx, min(d) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY x ORDER BY d) AS cum FROM d), n WHERE cum >= n//2+1 GROUP BY 1),
 lo AS (SELECT min(h) AS h FROM (SELECT h, sum(sum(cx)) OVER (ORDER BY h) AS cum FROM hi GROUP BY 1), n WHERE cum >= (n+1)//2)
 SELECT p_partkey, round(p_size/(1.1926*h),6) AS x FROM part, lo""")(lambda t: c.scale_by(part(t), part(t).filter("p_partkey % 3 <> 0"), "p_size", "sn").select("p_partkey", F.round("p_size", 6).alias("x")))
q("scale_qn", f"""WITH v AS {_V}, n AS {_N}, d AS (SELECT b.v-a.v AS d, sum(CASE WHEN a.v=b.v THEN a.c*(a.c-1)/2 ELSE a.c*b.c END) AS c FROM v a JOIN v b ON b.v>=a.v GROUP BY 1),
 k AS (SELECT min(d) AS d FROM (SELECT d, sum(c) OVER (ORDER BY d) AS cum FROM d WHERE c>0), n WHERE cum >= (n//2+1)*(n//2)/2) SELECT p_partkey, round(p_size/(2.2219*d),6) AS x FROM part, k""")(
    lambda t: c.scale_by(part(t), part(t).filter("p_partkey % 3 <> 0"), "p_size", "qn").select("p_partkey", F.round("p_size", 6).alias("x"))
)
_L = "(SELECT (l_returnflag='R')::INT AS y, l_linenumber, l_quantity::INT AS l_quantity, (l_discount*100)::INT AS disc FROM lineitem)"


def lines(t):
    return t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"))


_LF = f"(SELECT y, unnest(['l_linenumber','l_quantity','disc']) AS feature, unnest([l_linenumber,l_quantity,disc]) AS x FROM {_L})"
q("rank_fscore_robust", f"""WITH f AS {_LF}, k AS (SELECT feature, y, l[ceil(n*0.25)::INT] AS a, l[ceil(n*0.5)::INT] AS b, l[ceil(n*0.75)::INT] AS d FROM (SELECT feature, y, list_sort(list(x)) AS l, count(*) AS n FROM f GROUP BY 1,2)),
 w AS (SELECT feature, l[ceil(n*0.5)::INT] AS m FROM (SELECT feature, list_sort(list(x)) AS l, count(*) AS n FROM f GROUP BY 1)) SELECT feature, round(sum(pow(b-m,2))/nullif(sum(pow(d-a,2)),0),6) AS score FROM k JOIN w USING (feature) GROUP BY 1""")(
    lambda t: c.robust_fscore(lines(t), ["l_linenumber", "l_quantity", "disc"], "y").withColumn("score", F.round("score", 6))
)
q("rank_entropy", f"SELECT feature, round(-sum(n/t*log2(n/t)),6) AS entropy FROM (SELECT feature, x, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY feature)::DOUBLE AS t FROM {_LF} GROUP BY 1,2) GROUP BY 1")(
    lambda t: c.entropy_filter(lines(t), ["l_linenumber", "l_quantity", "disc"]).withColumn("entropy", F.round("entropy", 6))
)
q("rank_information", f"""SELECT feature, round(sum(n/t*log2(n*t/(nx*ny))),9) AS information FROM (SELECT *, sum(n) OVER (PARTITION BY feature,x) AS nx, sum(n) OVER (PARTITION BY feature,y) AS ny, sum(n) OVER (PARTITION BY feature) AS t
 FROM (SELECT feature, x, y, count(*)::DOUBLE AS n FROM {_LF} GROUP BY 1,2,3)) GROUP BY 1""")(lambda t: c.information_filter(lines(t), ["l_linenumber", "l_quantity", "disc"], "y").withColumn("information", F.round("information", 9)))
q("correct_tails", """SELECT p_partkey, round(pred+s*pred+i,6) AS fixed FROM (SELECT p_partkey, p_size*20.0+800 AS pred FROM part),
 (SELECT regr_slope(p_retailprice-(p_size*20.0+800),p_size*20.0+800) AS s, regr_intercept(p_retailprice-(p_size*20.0+800),p_size*20.0+800) AS i FROM part WHERE p_partkey%3<>0)""")(
    lambda t: c.correct_tails(part(t).withColumn("pred", F.col("p_size") * 20.0 + 800), part(t).withColumn("pred", F.col("p_size") * 20.0 + 800).filter("p_partkey % 3 <> 0"), "p_retailprice", "pred", "fixed").select("p_partkey", F.round("fixed", 6).alias("fixed"))
)
_E = "(SELECT l_linenumber AS component, sum(l_quantity)::DOUBLE AS variance FROM lineitem GROUP BY 1)"
q("keep_components", f"""SELECT component, variance, round(variance/t,9) AS explained, round(cum/t,9) AS cumulative FROM (SELECT *, sum(variance) OVER (ORDER BY variance DESC, component ROWS UNBOUNDED PRECEDING) AS cum, sum(variance) OVER () AS t FROM {_E}) WHERE (cum-variance)/t<0.7""")(
    lambda t: c.keep_components(t("lineitem").groupBy(F.col("l_linenumber").alias("component")).agg(F.sum(F.col("l_quantity").cast("double")).alias("variance")), "component", "variance", 0.7).withColumns({n: F.round(n, 9) for n in ("explained", "cumulative")})
)
_CR = " UNION ALL ".join(f"SELECT '{a}' AS component, '{b}' AS reference, corr({a},{b}) AS r FROM lineitem" for a in ("l_quantity", "l_discount") for b in ("l_extendedprice", "l_tax", "l_linenumber"))
q("sort_components", f"SELECT component, reference, round(abs(r),6) AS similarity, sign(r)::INT AS sign FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(r) DESC, reference DESC) AS k FROM ({_CR})) WHERE k=1")(
    lambda t: c.sort_components(t("lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax", "l_linenumber"]).withColumn("similarity", F.round("similarity", 6))
)
q("component_contributions", """SELECT p_partkey, round(0.5*p_size-0.01*p_retailprice+3,6) AS decision, round(0.5*p_size,6) AS part_p_size, round(-0.01*p_retailprice,6) AS part_p_retailprice,
 round(0.5*p_size/(0.5*p_size+0.01*p_retailprice),9) AS share_p_size, round(0.01*p_retailprice/(0.5*p_size+0.01*p_retailprice),9) AS share_p_retailprice FROM part""")(
    lambda t: c.contributions(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], [0.5, -0.01], 3.0).select(
        "p_partkey", *(F.round(n, 9 if n.startswith("share") else 6).alias(n) for n in ("decision", "part_p_size", "part_p_retailprice", "share_p_size", "share_p_retailprice")))
)
q("permutation_index", """SELECT a.c_custkey, a.c_mktsegment, b.c_custkey AS stand_in FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) a
 JOIN (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0:3:'||c_custkey), c_custkey) AS n FROM customer) b ON a.c_mktsegment=b.c_mktsegment AND a.n=b.n""")(
    lambda t: c.permutation_index(cust(t), "c_custkey", ["c_mktsegment"], 3)
)
q("class_folds", """SELECT c_custkey, c_mktsegment, fold, d AS dichotomiser, CASE WHEN c_mktsegment=a THEN 1 ELSE -1 END AS side FROM (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)-1)%4 AS fold FROM customer)
 JOIN (VALUES (0,'BUILDING','MACHINERY'),(1,'AUTOMOBILE','BUILDING')) v(d,a,b) ON c_mktsegment IN (a,b)""")(
    lambda t: c.class_folds(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", [("BUILDING", "MACHINERY"), ("AUTOMOBILE", "BUILDING")], 4)
)
q("parameter_text", "SELECT n_nationkey, concat_ws(' ', '-c '||n_regionkey, CASE WHEN n_nationkey%2=0 THEN '-g '||n_nationkey END) AS params FROM nation")(
    lambda t: t("nation").withColumn("g", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))).select("n_nationkey", c.parameter_text({"-c": "n_regionkey", "-g": "g"}).alias("params"))
)
q("out_of_fold_line", """SELECT p_partkey, round(i+s*p_size,4) AS pred FROM part JOIN (SELECT k, regr_slope(p_retailprice,p_size) AS s, regr_intercept(p_retailprice,p_size) AS i FROM part, range(5) f(k) WHERE p_partkey%5<>k GROUP BY 1) ON p_partkey%5=k""")(
    lambda t: c.out_of_fold_line(part(t).withColumn("fold", F.col("p_partkey") % 5), "fold", "p_size", "p_retailprice", "pred").select("p_partkey", F.round("pred", 4).alias("pred"))
)
_PM = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(pow(a.p_retailprice-({m}),2))-avg(pow(a.p_retailprice-(900+2*a.p_size+0.1*a.k),2)) AS importance FROM {{0}} a JOIN {{1}} b ON a.n=b.n" for f, m in (("p_size", "900+2*b.p_size+0.1*a.k"), ("k", "900+2*a.p_size+0.1*b.k"))
).format("(SELECT *, p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS n FROM part)", "(SELECT *, p_partkey AS k, row_number() OVER (ORDER BY md5('0:0:'||p_partkey), p_partkey) AS n FROM part)")
q("permutation_importance", f"SELECT feature, round(importance,4) AS importance FROM ({_PM})")(
    lambda t: c.permutation_importance(part(t).withColumn("k", F.col("p_partkey")), "p_partkey", 900 + 2 * F.col("p_size") + 0.1 * F.col("k"), ["p_size", "k"], "p_retailprice").withColumn("importance", F.round("importance", 4))
)
_AB, _AC, _BC = "(p_size-25)", "(p_retailprice-1200)", "(p_partkey%5-2)"
q("hierarchical_pairs", f"SELECT p_partkey, CASE WHEN {_AB}<0 THEN CASE WHEN {_BC}<0 THEN 'C' ELSE 'B' END ELSE CASE WHEN {_AC}<0 THEN 'C' ELSE 'A' END END AS won FROM part")(
    lambda t: part(t).select("p_partkey", c.hierarchical_pairs(["A", "B", "C"], {("A", "B"): F.col("p_size") - 25, ("A", "C"): F.col("p_retailprice") - 1200, ("B", "C"): F.col("p_partkey") % 5 - 2}).alias("won"))
)
q("weight_features_soft", "SELECT p_partkey, p_size*1.0::DOUBLE AS p_size, round(p_retailprice*0.25,6) AS p_retailprice FROM part")(
    lambda t: c.weight_features(part(t).drop("p_brand"), ["p_size", "p_retailprice"], {"p_size": 2.0, "p_retailprice": -0.5}).withColumn("p_retailprice", F.round("p_retailprice", 6))
)
q("weight_features_hard", "SELECT p_partkey, p_size FROM part")(lambda t: c.weight_features(part(t).drop("p_brand"), ["p_size", "p_retailprice"], {"p_size": 2.0, "p_retailprice": -0.5}, hard=0.5))
_SC = "(SELECT l_suppkey AS case_id, CASE WHEN l_suppkey%2=0 THEN 1 ELSE -1 END AS label, l_quantity-25 AS score FROM lineitem)"
q("export_predictions", f"""SELECT case_id, label, n, round(m,6) AS mean, round(s,6) AS sd, round(r,6) AS "right", round(m-1.96*s/sqrt(n),6) AS low, round(m+1.96*s/sqrt(n),6) AS high
 FROM (SELECT case_id, label, count(score) AS n, avg(score) AS m, stddev_samp(score) AS s, avg((sign(score)=sign(label))::INT) AS r FROM {_SC} GROUP BY 1,2)""")(
    lambda t: c.prediction_table(t("lineitem").select(F.col("l_suppkey").alias("case_id"), F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1).alias("label"), (F.col("l_quantity") - 25).alias("score")), "case_id", "score", "label").withColumns({n: F.round(n, 6) for n in ("mean", "sd", "right", "low", "high")})
)
q("export_relevance", """SELECT l_linenumber, round(avg((l_tax<0.05)::INT),6) AS probability, round(avg(w),6) AS mean, round(stddev_samp(w)/sqrt(count(w)),6) AS error, round(avg((w>0)::INT),6) AS positive
 FROM (SELECT l_linenumber, l_tax, CASE WHEN l_tax<0.05 THEN l_discount-0.05 END AS w FROM lineitem) GROUP BY 1""")(
    lambda t: c.relevance_table(t("lineitem").select("l_linenumber", (F.col("l_discount") - 0.05).alias("w"), (F.col("l_tax") < 0.05).alias("chosen")), "l_linenumber", "w", "chosen").withColumns({n: F.round(n, 6) for n in ("probability", "mean", "error", "positive")})
)
q("consistency_significance", "SELECT c_custkey, round(c_acctbal/(SELECT stddev_samp(c_acctbal) FROM customer),6) AS z FROM customer")(lambda t: c.consistency_significance(cust(t), "c_custkey", "c_acctbal").withColumn("z", F.round("z", 6)))
q("redundancy_penalty", "SELECT p_partkey, round(2*greatest(0,least(1,(p_size/50.0-0.3)/0.5)),6) AS pen FROM part")(
    lambda t: c.redundancy_penalty(part(t).withColumn("s", F.col("p_size") / 50.0), "s", 0.3, 0.8, 2.0, "pen").select("p_partkey", F.round("pen", 6).alias("pen"))
)
