"""Chains applied to unseen rows, ensemble construction, calibration by binning, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model_building as b
from ..operators import ranking
from ..registry import query as q

TRAIN = "p_partkey % 3 <> 0"


def part(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand")


def lines(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))


q("chain_holdout", f"""SELECT p_partkey, round((p_size-m)/s,6) AS p_size, round(i+k*(p_size-m)/s,4) AS pred FROM part, (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s, regr_slope(p_retailprice,p_size)*stddev_samp(p_size) AS k, avg(p_retailprice) AS i
 FROM part WHERE {TRAIN}) WHERE p_partkey%3=0""")(
    lambda t: b.Chain(b.standardising(["p_size"]), b.line("p_size", "p_retailprice", "pred")).fit(part(t).filter(TRAIN)).apply(part(t).filter("p_partkey % 3 = 0")).select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("pred", 4).alias("pred"))
)
q("chain_unseen_components")(lambda t: b.Chain(b.standardising(["l_quantity", "l_discount", "l_tax"]), b.principal_components(["l_quantity", "l_discount", "l_tax"], 2)).fit(lines(t).filter("l_orderkey % 2 = 0")).apply(lines(t).filter("l_orderkey % 2 = 1")))
q("remove_component_of_covariate")(lambda t: b.without_components_of(["l_quantity", "l_extendedprice", "l_discount"], ["l_tax", "l_quantity"], 0.5)(lines(t))(lines(t)))
_LV = "(SELECT p_partkey, p_size/50.0 AS x, p_retailprice/2000.0 AS y, CASE WHEN p_partkey%50<>0 THEN p_brand END AS brand FROM part)"
q("impute_labels", f"""SELECT p_partkey, brand FROM (SELECT a.p_partkey, c.brand, row_number() OVER (PARTITION BY a.p_partkey ORDER BY sqrt(pow(a.x-c.x,2)+pow(a.y-c.y,2)), c.p_partkey) AS k FROM {_LV} a JOIN {_LV} c ON a.brand IS NULL AND c.brand IS NOT NULL) WHERE k=1""")(
    lambda t: b.impute_labels(part(t).select("p_partkey", F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0).alias("v"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_brand")).alias("brand")), "p_partkey", "v", "brand")
)
q("impute_sequential")(lambda t: b.impute_sequentially(t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("n"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") * 2).alias("d")), "s_suppkey", ["a", "n", "d"]))


def votes(t):
    return lines(t).select((F.col("l_quantity") - 24).alias("h0"), (F.col("l_discount") - 0.06).alias("h1"), (0.05 - F.col("l_tax")).alias("h2"), (F.col("l_linenumber") - 3.0).alias("h3"), (F.col("l_extendedprice") - 36000).alias("y"))


def table(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


_H = ["h0", "h1", "h2", "h3"]
q("ensemble_boosting_weights")(lambda t: table(t, [(f"h{i}", float(w)) for i, w in enumerate(b.boosting_weights(*b.vote_patterns(votes(t), _H, "y")))], "learner string, weight double"))
for _c in ("accuracy", "entropy", "diversity"):
    q(f"ensemble_build_{_c}")(lambda t, c=_c: table(t, [(f"h{i}",) for i in b.build_ensemble(*b.vote_patterns(votes(t), _H, "y"), c, 0.02)], "learner string"))


def risky(t):
    return t("part").select("p_partkey", (F.col("p_size") / 51.0).alias("p"), (F.col("p_retailprice") > 1300).cast("int").alias("y"))


q("calibrate_bbq")(lambda t: b.bbq_apply(risky(t), "p", b.bbq(risky(t), "p", "y"), "calibrated"))
_G = {"low": [0, 10, 20, 30], "high": [20, 30, 40, 51]}


def best(t, search):
    rows = {(x["p_size"]): (x["n"], x["s"]) for x in part(t).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.sum("p_retailprice").alias("s")).collect()}

    def worth(point):
        inside = [v for k, v in rows.items() if point[0] <= k < point[1]]
        return sum(s for _, s in inside) / max(1, sum(n for n, _ in inside))

    point, value, tried = search(worth, _G)
    return table(t, [(int(point[0]), int(point[1]), float(value), tried)], "low int, high int, worth double, tried int")


q("search_annealing")(lambda t: best(t, b.anneal))
q("search_bayes")(lambda t: best(t, b.bayes_search))
_LC = ["l_quantity", "l_discount", "l_tax"]
q("wrapper_forward")(lambda t: table(t, ranking.forward(_LC, b.explained(lines(t), _LC, "l_extendedprice")), "feature string, worth double"))
q("wrapper_backward")(lambda t: table(t, [(c,) for c in ranking.backward(_LC, b.explained(lines(t), _LC, "l_extendedprice"))], "feature string"))
q("external_weights", "SELECT p_partkey, feature, round(value,6) AS value FROM (SELECT p_partkey, 'p_size' AS feature, p_size*0.5::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice*2.0::DOUBLE FROM part)")(
    lambda t: b.external_weights(part(t), ["p_partkey"], ["p_size", "p_retailprice"], table(t, [("p_size", 0.5), ("p_retailprice", 2.0)], "feature string, w double"), "feature", "w").select("p_partkey", "feature", F.round("value", 6).alias("value"))
)
