"""Learners, search, sources, streams and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners as l
from ..operators import simulation, validation
from ..registry import query as q
from ..sources import io
from ..streaming import events as s

X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", *X, (F.col("l_quantity") * 2000 + F.col("l_tax") * 100000 - F.col("l_extendedprice") > 0).cast("int").alias("y"))
    return d.withColumn("fold", (F.col("id") % 4).cast("int"))


_Y = f"SELECT l_orderkey%4 AS fold, {', '.join(X)}, (l_quantity*2000+l_tax*100000-l_extendedprice>0)::INT AS y FROM lineitem"
_NB = f"""WITH d AS ({_Y}), g AS (SELECT y AS c, ln(count(*)) AS p, {", ".join(f"avg({x}) AS m{i}, var_pop({x})+any_value(lift) AS v{i}" for i, x in enumerate(X))} FROM d, (SELECT 1e-9*greatest({",".join(f"var_pop({x})" for x in X)}) AS lift FROM d WHERE fold<>0) WHERE fold<>0 GROUP BY 1)
 SELECT pred::DOUBLE AS prediction, y, count(*) AS count FROM (SELECT max_by(c,s) AS pred, any_value(y) AS y FROM (SELECT r, y, c, p-0.5*({"+".join(f"ln(v{i})+pow({x}-m{i},2)/v{i}" for i, x in enumerate(X))}) AS s FROM (SELECT *, row_number() OVER () AS r FROM d WHERE fold=0), g) GROUP BY r) GROUP BY 1,2"""
_OLS = """WITH m AS (SELECT avg(p_size) AS ma, avg(p_partkey) AS mb, avg(p_retailprice) AS my, covar_pop(p_size,p_size) AS aa, covar_pop(p_partkey,p_partkey) AS bb, covar_pop(p_size,p_partkey) AS ab, covar_pop(p_size,p_retailprice) AS ay, covar_pop(p_partkey,p_retailprice) AS byy FROM part WHERE p_partkey%4<>0)
 SELECT p_partkey, round(my+(p_size-ma)*(ay*bb-byy*ab)/(aa*bb-ab*ab)+(p_partkey-mb)*(byy*aa-ay*ab)/(aa*bb-ab*ab),4) AS prediction FROM part, m WHERE p_partkey%4=0"""
for _n in l.CLASSIFIERS:
    q(f"learn_classifier_{_n}", _NB if _n == "naive_bayes" else None)(lambda t, n=_n: l.fit(n, lines(t).filter("fold <> 0"), X, "y")(lines(t).filter("fold = 0")).groupBy("prediction", "y").count())
for _n in l.REGRESSORS:
    q(f"learn_regressor_{_n}", _OLS if _n in ("linear", "glm") else None)(lambda t, n=_n: l.fit(n, t("part").filter("p_partkey % 4 <> 0"), ["p_size", "p_partkey"], "p_retailprice", True)(t("part").filter("p_partkey % 4 = 0")).select("p_partkey", F.round("prediction", 4).alias("prediction")))
q("learn_perceptron")(lambda t: l.perceptron(lines(t).filter("fold <> 0"), X, "y")(lines(t).filter("fold = 0")).groupBy("prediction", "y").count())
q("learn_survival")(lambda t: l.survival(t("part").select("p_partkey", F.col("p_size").cast("double").alias("t"), (F.col("p_partkey") % 5 > 0).cast("double").alias("e"), (F.col("p_retailprice") / 1000).alias("x")), ["x"], "t", "e")(t("part").select("p_partkey", F.col("p_size").cast("double").alias("t"), (F.col("p_retailprice") / 1000).alias("x"))).select("p_partkey", "prediction", "survival", "hazard"))
q("learn_mixture")(lambda t: l.mixture(t("customer"), ["c_acctbal"], 2)(t("customer")).select("c_custkey", "prediction"))
q("learn_per_fold")(lambda t: l.train_folds(t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 10).cast("double").alias("x"), "p_retailprice", (F.col("p_partkey") % 3).cast("int").alias("fold")), "p_partkey", ["p_size", "x"], "p_retailprice", "fold", list(l.SMALL), per_fold=300))
q("learn_sequential")(lambda t: l.sequential(lines(t), ["l_discount", "l_tax", "l_quantity"]).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score")))
q("learn_policy_value", "SELECT treatment, round(avg(pred+CASE WHEN given=treatment THEN (y-pred)/greatest(0.2,0.01) ELSE 0 END),6) AS value FROM (SELECT c_nationkey%5 AS given, c_acctbal AS y, k AS treatment, 100.0*k AS pred FROM customer, range(0,5) r(k)) GROUP BY 1")(
    lambda t: l.policy_value(t("customer").select((F.col("c_nationkey") % 5).alias("given"), F.col("c_acctbal").alias("y"), F.lit(0.2).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("treatment")).withColumn("pred", 100.0 * F.col("treatment")).withColumn("treatment", F.col("treatment").cast("long")), "treatment", "y", "p", "pred").withColumn("value", F.round("value", 6))
)
q("search_grid")(lambda t: simulation.grid_search(lines(t), X, "y", [0.001, 0.1], [0.0, 1.0]))

# sources
q("source_select_columns", "SELECT c_custkey, c_name FROM customer")(lambda t: t("customer").select("c_custkey", "c_name"))
q("source_count_rows", "SELECT count(*) AS n FROM lineitem")(lambda t: t("lineitem").agg(F.count(F.lit(1)).alias("n")))
q("source_sql_text", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey=n_regionkey GROUP BY 1")(lambda t: t("region").sparkSession.sql("SELECT r_name, count(*) AS n FROM {r} JOIN {n} ON r_regionkey = n_regionkey GROUP BY 1", r=t("region"), n=t("nation")))
q("source_catalogue", "SELECT 'nation' AS table_name, u.c AS column_name, u.p::INT AS position FROM (VALUES ('n_nationkey',0),('n_name',1),('n_regionkey',2)) u(c,p)")(lambda t: io.describe(t("nation"), "nation").drop("type"))
q("source_nan_to_null", "SELECT event_id, CASE WHEN event_id%3<>0 THEN value END AS v FROM events")(lambda t: io.nan_to_null(t("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(float("nan")).alias("v"))))
q("source_correspondence", "SELECT c_custkey AS id, c_acctbal AS bal FROM customer")(lambda t: io.correspond(t("customer"), {"c_custkey": "id", "c_acctbal": "bal"}, ["id", "bal"]))
q("source_scramble")(lambda t: io.scramble(t("part").select("p_partkey", "p_size"), ["p_size"]))

# windows over events, as on a stream
q("stream_tumbling", "SELECT date_trunc('day',ts) AS start, event_type, count(*) AS n, round(avg(value),6) AS mean, max(value) AS top FROM events GROUP BY 1,2")(lambda t: s.windowed(t("events"), "ts", ["event_type"], "value").select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "top"))
q("stream_sliding", "SELECT event_type, sum(n)::BIGINT AS n FROM (SELECT event_type, count(*)*2 AS n FROM events GROUP BY 1) GROUP BY 1")(lambda t: s.windowed(t("events"), "ts", ["event_type"], "value", "2 days", "1 day").groupBy("event_type").agg(F.sum("n").alias("n")))
q("stream_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts>=p+INTERVAL 2 HOURS GROUP BY 1")(lambda t: s.sessions(t("events"), "ts", ["user_id"], "2 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions")))

# simulation
q("simulate_scenarios", "SELECT n.v::BIGINT AS n, p.v::DOUBLE AS prevalence, e.v::DOUBLE AS effect FROM (VALUES (100),(400)) n(v), (VALUES (0.2),(0.5)) p(v), (VALUES (0.0),(0.8)) e(v)")(lambda t: simulation.scenarios(t("region").sparkSession, [100, 400], [0.2, 0.5], [0.0, 0.8]).withColumn("n", F.col("n").cast("long")))
q("simulate_performance")(lambda t: simulation.performance(simulation.scenarios(t("region").sparkSession, [100, 400], [0.2, 0.5], [0.0, 0.8]), 20))
q("simulate_copula")(lambda t: simulation.copula(t("part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], 500))
q("simulate_neighbours")(lambda t: simulation.between_neighbours(t("part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], 200))
q("simulate_power")(lambda t: t("nation").select("n_nationkey", validation.effect_size(0.5 + F.col("n_nationkey") / 60.0).alias("d")).withColumn("power", numeric_power(F.col("d"))))


def numeric_power(d, n: int = 50, alpha_z: float = 1.959963984540054):
    """Power of a two-sided comparison of two groups of n."""
    from ..functions.special import cdf

    return cdf(d * (n / 2) ** 0.5 - alpha_z)


