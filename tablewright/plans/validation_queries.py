"""Folds, corrections for many tests, tests, interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as v
from ..registry import query as q

q("cv_stratified_folds", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)-1)%5 AS fold FROM orders")(lambda t: v.stratified_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], 5).select("o_orderkey", "fold"))
q("cv_repeated_folds")(lambda t: v.stratified_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], 10, seed=1, perm=2, salt=16).groupBy("o_orderstatus", "fold").count())
q("cv_leave_one_out", "SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS fold FROM labels")(lambda t: v.leave_group_out(t("labels").select("doc_id"), "doc_id"))
q("cv_leave_group_out", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment)-1 AS fold FROM customer")(lambda t: v.leave_group_out(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"))
q("cv_nested_folds", """SELECT o_orderkey, o_orderstatus, fold2, "outer", (row_number() OVER (PARTITION BY o_orderstatus,"outer" ORDER BY o_orderkey)-1)%3 AS fold1 FROM (SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)-1)%4 AS fold2 FROM orders), range(0,4) r("outer") WHERE fold2<>"outer" """)(
    lambda t: v.nested_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], 4, 3)
)
_N = "(SELECT l_linenumber AS node, (l_linenumber%3)::DOUBLE AS complexity, round(avg(l_quantity),2) AS worth FROM lineitem GROUP BY 1)"
q("search_optimum", f"SELECT node, complexity, worth, round(worth-0.5*complexity,9) AS penalised FROM {_N} ORDER BY round(worth-0.5*complexity,9) DESC, complexity, node LIMIT 1")(
    lambda t: v.optimum(t("lineitem").groupBy(F.col("l_linenumber").alias("node")).agg(F.round(F.avg("l_quantity"), 2).alias("worth")).withColumn("complexity", (F.col("node") % 3).cast("double")), "worth", "complexity", "node", lam=0.5).withColumn("penalised", F.round("penalised", 9))
)
PV = "(SELECT p_partkey, (p_retailprice-800)/2000.0*((p_partkey%97)+1)/97 AS p FROM part)"


def ps(t):
    return t("part").select("p_partkey", ((F.col("p_retailprice") - 800) / 2000.0 * ((F.col("p_partkey") % 97) + 1) / 97).alias("p"))


_FDR = "least(1,min(p*n*{h}/cum) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"
for _name, _h in (("bh", "1"), ("by", "(SELECT sum(1.0/i) FROM range(1,(SELECT count(*)+1 FROM part)) r(i))")):
    q(f"correct_fdr_{_name}", f"SELECT a.p_partkey, round(b.adj,6) AS adjusted FROM {PV} a JOIN (SELECT p, {_FDR.format(h=_h)} AS adj FROM (SELECT p, sum(count(*)) OVER (ORDER BY p) AS cum, sum(count(*)) OVER () AS n FROM {PV} GROUP BY p)) b ON a.p=b.p")(
        lambda t, d=_name == "by": v.fdr(ps(t), "p", "p_partkey", dependent=d).select("p_partkey", F.round("adjusted", 6).alias("adjusted"))
    )
q("correct_holm", f"SELECT p_partkey, round(least(1,max(raw) OVER (ORDER BY p,p_partkey ROWS UNBOUNDED PRECEDING)),6) AS adjusted FROM (SELECT *, p*(count(*) OVER ()-row_number() OVER (ORDER BY p,p_partkey)+1) AS raw FROM {PV})")(lambda t: v.holm(ps(t), "p", "p_partkey").select("p_partkey", F.round("adjusted", 6).alias("adjusted")))
q("combine_fisher", "SELECT n_regionkey, round(2*h,6) AS statistic, k, round(exp(-h)*(1+h+h*h/2+h*h*h/6+h*h*h*h/24),9) AS p FROM (SELECT n_regionkey, -sum(ln((n_nationkey+1)/26.0)) AS h, count(*) AS k FROM nation GROUP BY 1) WHERE k=5")(
    lambda t: v.fisher_combine(t("nation").withColumn("p", (F.col("n_nationkey") + 1) / 26.0), ["n_regionkey"], "p").filter("k = 5").withColumns({"statistic": F.round("statistic", 6), "p": F.round("p", 9)})
)
q("combine_stouffer")(lambda t: v.stouffer(t("nation").withColumn("p", (F.col("n_nationkey") + 1) / 27.0), ["n_regionkey"], "p"))
q("test_wilcoxon", """SELECT p_brand, plus, minus, n, round((plus-n*(n+1)/4.0)/sqrt((n*(n+1)*(2*n+1)-t/2.0)/24.0),6) AS z FROM (SELECT p_brand, sum(CASE WHEN d>0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d<0 THEN r ELSE 0 END) AS minus, count(*) AS n, sum(c*c-1.0) AS t
 FROM (SELECT p_brand, d, rank() OVER (PARTITION BY p_brand ORDER BY abs(d))+(count(*) OVER (PARTITION BY p_brand, abs(d))-1)/2.0 AS r, count(*) OVER (PARTITION BY p_brand, abs(d)) AS c FROM (SELECT p_brand, p_size-25 AS d FROM part WHERE p_size<>25)) GROUP BY 1)""")(
    lambda t: v.wilcoxon(t("part").withColumn("d", F.col("p_size") - 25), ["p_brand"], "d").select("p_brand", "plus", "minus", "n", F.round("z", 6).alias("z"))
)
_C = "(SELECT p_brand, (p_size<20)::INT AS a, (p_retailprice<1100)::INT AS b FROM part)"


def correct(t):
    return t("part").select("p_brand", (F.col("p_size") < 20).cast("int").alias("a"), (F.col("p_retailprice") < 1100).cast("int").alias("b"))


q("test_mcnemar", f"SELECT p_brand, b::DOUBLE AS b, c::DOUBLE AS c, round(pow(abs(b-c)-1,2)/nullif(b+c,0),6) AS chi2 FROM (SELECT p_brand, sum((a=1 AND b=0)::INT) AS b, sum((a=0 AND b=1)::INT) AS c FROM {_C} GROUP BY 1)")(lambda t: v.mcnemar(correct(t), ["p_brand"], "a", "b").select("p_brand", "b", "c", F.round("chi2", 6).alias("chi2")))
q("test_mcnemar_p")(lambda t: v.mcnemar(correct(t), ["p_brand"], "a", "b"))
q("test_liddell")(lambda t: v.liddell(correct(t), ["p_brand"], "a", "b"))


def blocks(t):
    return t("lineitem").groupBy((F.col("l_orderkey") % 8).alias("block"), "l_linenumber").agg(F.round(F.avg("l_discount"), 12).alias("x"))  # equal means are ties, whatever the order of their sums


_K = "(SELECT l_orderkey%8 AS block, l_linenumber, avg(l_discount) AS x FROM lineitem GROUP BY 1,2)"
_RK = f"(SELECT *, rank() OVER (PARTITION BY block ORDER BY x)+(count(*) OVER (PARTITION BY block, x)-1)/2.0 AS r, count(*) OVER (PARTITION BY block) AS t FROM {_K})"
q("test_friedman", f"SELECT round(12*sum(s*s)/(8*max(t)*(max(t)+1))-3*8*(max(t)+1),6) AS statistic FROM (SELECT l_linenumber, sum(r) AS s, max(t)::DOUBLE AS t FROM {_RK} GROUP BY 1)")(lambda t: v.block_ranks(blocks(t), "block", "l_linenumber", "x", False).select(F.round("statistic", 6).alias("statistic")))
q("test_quade", f"""SELECT round(7*b/(a-b),5) AS statistic FROM (SELECT (SELECT sum(pow(s,2)) FROM (SELECT q*(r-(t+1)/2.0) AS s FROM {_RK} JOIN (SELECT block, rank() OVER (ORDER BY w)*1.0 AS q FROM (SELECT block, max(x)-min(x) AS w FROM {_K} GROUP BY 1)) USING (block))) AS a,
 (SELECT sum(pow(s,2))/8 FROM (SELECT l_linenumber, sum(q*(r-(t+1)/2.0)) AS s FROM {_RK} JOIN (SELECT block, rank() OVER (ORDER BY w)*1.0 AS q FROM (SELECT block, max(x)-min(x) AS w FROM {_K} GROUP BY 1)) USING (block) GROUP BY 1)) AS b)""")(lambda t: v.block_ranks(blocks(t), "block", "l_linenumber", "x", True).select(F.round("statistic", 5).alias("statistic")))
q("test_quade_p")(lambda t: v.block_ranks(blocks(t), "block", "l_linenumber", "x", True))
_DL = "(SELECT l_orderkey%10 AS rep, avg(l_discount)-avg(l_tax)*1.2 AS d FROM lineitem GROUP BY 1)"


def deltas(t):
    return t("lineitem").groupBy((F.col("l_orderkey") % 10).alias("rep")).agg((F.avg("l_discount") - F.avg("l_tax") * 1.2).alias("d"))


q("test_corrected_resampled", f"SELECT round(avg(d)/sqrt((1.0/count(*)+1.0/4)*var_samp(d)),5) AS t FROM {_DL}")(lambda t: v.corrected_resampled(deltas(t), "d", 5).select(F.round("t", 5).alias("t")))
q("test_five_by_two", f"SELECT round(sum(q)/(2*sum(2*s)),5) AS f FROM (SELECT rep%5 AS r, sum(d*d) AS q, var_pop(d) AS s FROM {_DL} GROUP BY 1)")(lambda t: v.five_by_two(deltas(t).withColumn("r", F.col("rep") % 5), "r", "rep", "d").select(F.round("f", 5).alias("f")))
q("pairwise_deltas", "SELECT a.l_linenumber AS i, b.l_linenumber AS j, round(avg(a.x-b.x),9) AS mean_delta FROM " + _K + " a JOIN " + _K + " b ON a.block=b.block AND a.l_linenumber<b.l_linenumber GROUP BY 1,2")(
    lambda t: blocks(t).select("block", F.col("l_linenumber").alias("i"), "x").join(blocks(t).select("block", F.col("l_linenumber").alias("j"), F.col("x").alias("y")), "block").filter("i < j").groupBy("i", "j").agg(F.round(F.avg(F.col("x") - F.col("y")), 9).alias("mean_delta"))
)
q("effect_size_of_auc")(lambda t: t("nation").select("n_nationkey", v.effect_size((F.col("n_nationkey") + 1) / 27.0).alias("d")))
_WT = "(SELECT l_linenumber, CASE WHEN l_orderkey%11=0 THEN NULL ELSE l_discount-0.04 END AS w FROM lineitem)"
q("sign_consistency", f"SELECT l_linenumber, round(abs(avg(CASE WHEN w>0 THEN 1.0 WHEN w<=0 THEN 0.0 END)-avg(CASE WHEN w<0 THEN 1.0 WHEN w>=0 THEN 0.0 END))*count(w)/count(*),6) AS consistency FROM {_WT} GROUP BY 1")(
    lambda t: v.sign_consistency(t("lineitem").select("l_linenumber", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_discount") - 0.04).alias("w")), ["l_linenumber"], "w").withColumn("consistency", F.round("consistency", 6))
)
q("interpret_perturb_median", "SELECT p_partkey, (SELECT median(p_size) FROM part) AS p_size FROM part")(lambda t: v.perturb(t("part").select("p_partkey", "p_size"), t("part"), "p_size", "median"))
for _h in ("flip", "mirror"):
    q(f"interpret_perturb_{_h}")(lambda t, h=_h: v.perturb(t("part").select("p_partkey", "p_size"), t("part"), "p_size", h))
q("interpret_relevance", "SELECT p_brand, round(median(x),6) AS relevance, count(*) AS n FROM (SELECT p_brand, 100*(p_size-25)/50.0 AS x FROM part WHERE p_size<>25) GROUP BY 1")(lambda t: v.relevance(t("part").withColumn("o", F.lit(25)), "p_brand", "o", "p_size", 50.0).select("p_brand", F.round("relevance", 6).alias("relevance"), "n"))
q("interpret_component_share", "SELECT p_partkey, round(p_size*0.3/(p_size*0.3+p_retailprice*0.01),9) AS share FROM part")(lambda t: t("part").select("p_partkey", F.round(F.col("p_size") * 0.3 / (F.col("p_size") * 0.3 + F.col("p_retailprice") * 0.01), 9).alias("share")))
q("interpret_coalitions", """SELECT list_aggregate([j for j in range(5) if (m>>j)&1=1],'string_agg',',') AS subset, round(4.0/([5,10,10,5][bit_count(m)]*bit_count(m)*(5-bit_count(m))),9)::DOUBLE AS weight FROM (SELECT m::INT AS m FROM range(1,31) r(m))""")(
    lambda t: t("region").sparkSession.createDataFrame(v.coalitions(5), "subset array<int>, weight double").select(F.concat_ws(",", F.col("subset").cast("array<string>")).alias("subset"), F.round("weight", 9).alias("weight"))
)
q("diagnostics_2x2", "SELECT 'dor' AS name, round(731*1500/(270*78.0::DOUBLE),6) AS value UNION ALL SELECT 'youden', round(731/809.0::DOUBLE+1500/1770.0::DOUBLE-1,6)")(
    lambda t: t("region").sparkSession.createDataFrame([(k, round(x, 6)) for k, x in v.diagnostics(731, 270, 78, 1500).items() if k in ("dor", "youden")], "name string, value double")
)
