"""Ensembles and decoding, on three rule classifiers of lines and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as c
from ..operators import ensembles as e
from ..registry import query as q


def votes(t):
    """Three rules vote on each part: small, cheap, even; the label is whether its price is under 1000."""
    d = t("part").select("p_partkey", F.when(F.col("p_retailprice") < 1000, 1).otherwise(-1).alias("y"), F.array(F.when(F.col("p_size") < 20, 1).otherwise(-1), F.when(F.col("p_retailprice") < 1100, 1).otherwise(-1), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)).alias("v"))
    return d.select("p_partkey", "y", F.posexplode("v").alias("learner", "vote")).withColumn("correct", (F.col("vote") == F.col("y")).cast("int"))


V = """(SELECT p_partkey, CASE WHEN p_retailprice<1000 THEN 1 ELSE -1 END AS y, k AS learner, CASE k WHEN 0 THEN (CASE WHEN p_size<20 THEN 1 ELSE -1 END) WHEN 1 THEN (CASE WHEN p_retailprice<1100 THEN 1 ELSE -1 END) ELSE (CASE WHEN p_partkey%2=0 THEN 1 ELSE -1 END) END AS vote FROM part, range(0,3) r(k))"""
W = f"(SELECT *, (vote=y)::INT AS correct FROM {V})"
q("ensemble_decision", f"SELECT p_partkey, round(avg(vote),9) AS score, CASE WHEN avg(vote)>=0 THEN 1 ELSE -1 END AS decision FROM {V} GROUP BY 1")(lambda t: e.decide(votes(t), "p_partkey", "vote").withColumn("score", F.round("score", 9)))
_P = f"(SELECT p_partkey, count(*)/3.0::DOUBLE AS p FROM {V} GROUP BY p_partkey, vote)"
q("ensemble_vote_entropy", f"SELECT round(avg(h)/log2(2),6) AS entropy FROM (SELECT -sum(p*log2(p)) AS h FROM {_P} GROUP BY p_partkey)")(lambda t: e.vote_entropy(votes(t), "p_partkey", "vote", 2).select(F.round("entropy", 6).alias("entropy")))
q("ensemble_ambiguity", f"SELECT round(avg(h),6) AS ambiguity FROM (SELECT -sum(p*ln(p)) AS h FROM {_P} GROUP BY p_partkey)")(lambda t: e.ambiguity(votes(t), "p_partkey", "vote").select(F.round("ambiguity", 6).alias("ambiguity")))
q("ensemble_regression_ambiguity", f"SELECT round(avg(v),6) AS ambiguity FROM (SELECT var_pop(vote) AS v FROM {V} GROUP BY p_partkey)")(lambda t: e.regression_ambiguity(votes(t), "p_partkey", "vote").select(F.round("ambiguity", 6).alias("ambiguity")))
q("ensemble_pair_diversity", f"""SELECT round(avg((n11*n00-n10*n01)/(n11*n00+n10*n01)),6) AS q, round(avg(n00/n),6) AS double_fault FROM (SELECT a.learner, b.learner AS l2, count(*)::DOUBLE AS n, sum((a.correct=1 AND b.correct=1)::INT)+0.5::DOUBLE AS n11, sum((a.correct=0 AND b.correct=0)::INT)+0.5::DOUBLE AS n00,
 sum((a.correct=1 AND b.correct=0)::INT)+0.5::DOUBLE AS n10, sum((a.correct=0 AND b.correct=1)::INT)+0.5::DOUBLE AS n01 FROM {W} a JOIN {W} b ON a.p_partkey=b.p_partkey AND a.learner<b.learner GROUP BY 1,2)""")(lambda t: e.pair_diversity(votes(t), "p_partkey", "learner", "correct").select(F.round("q", 6).alias("q"), F.round("double_fault", 6).alias("double_fault")))
q("ensemble_kappa_diversity", f"SELECT round(1-(p-(qq*qq+(1-qq)*(1-qq)))/(1-(qq*qq+(1-qq)*(1-qq))),6) AS diversity FROM (SELECT avg((r*(r-1)+(3-r)*(2-r))/6.0) AS p, sum(r)/(3.0*count(*)) AS qq FROM (SELECT sum(correct)::DOUBLE AS r FROM {W} GROUP BY p_partkey))")(lambda t: e.kappa_diversity(votes(t), "p_partkey", "correct").select(F.round("diversity", 6).alias("diversity")))
q("ensemble_lobag", f"SELECT round(avg(b+v*(1-b)-v*b),6) AS lobag FROM (SELECT CASE WHEN sign(avg(vote))<>min(y) THEN 1.0 ELSE 0.0 END AS b, 1-pow(avg(vote),2) AS v FROM {V} GROUP BY p_partkey)")(lambda t: e.lobag(votes(t), "p_partkey", "vote", "y").select(F.round("lobag", 6).alias("lobag")))


def models(t):
    return t("lineitem").groupBy("l_linenumber", (F.col("l_orderkey") % 6).alias("model")).agg(F.round(F.avg("l_quantity"), 6).alias("worth"))


_M = "(SELECT l_linenumber, l_orderkey%6 AS model, round(avg(l_quantity),6) AS worth FROM lineitem GROUP BY 1,2)"
for _s, _sql in (("all", "TRUE"), ("winner", "rn=1"), ("range", "worth>=0.99*best"), ("percentile", "pr>=0.5")):
    q(f"ensemble_subspace_{_s}", f"SELECT l_linenumber, model, round((worth-low)/(best-low),6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY worth DESC, model) AS rn, percent_rank() OVER (PARTITION BY l_linenumber ORDER BY worth) AS pr, max(worth) OVER (PARTITION BY l_linenumber) AS best, min(worth) OVER (PARTITION BY l_linenumber) AS low FROM {_M}) WHERE {_sql}")(
        lambda t, s=_s: e.subspace_weights(models(t), ["l_linenumber"], "worth", s, 0.99 if s == "range" else 0.5).select("l_linenumber", "model", F.round("weight", 6).alias("weight"))
    )


def pair_scores(t):
    """Scores of the three pairs of order states, from the price."""
    x = F.col("o_totalprice") / 1000
    return t("orders").select("o_orderkey", (150 - x).alias("s0"), (120 - x).alias("s1"), (x - 180).alias("s2"))


S = "(SELECT o_orderkey, 150-o_totalprice/1000 AS s0, 120-o_totalprice/1000 AS s1, o_totalprice/1000-180 AS s2 FROM orders)"
_LONG = f"(SELECT o_orderkey, k, CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS v FROM {S}, range(0,3) r(k))"
_CODES = "(VALUES ('F',0,1),('O',0,-1),('P',0,0),('F',1,1),('O',1,0),('P',1,-1),('F',2,0),('O',2,1),('P',2,-1)) c(cls,k,code)"


def long(t):
    return pair_scores(t).select("o_orderkey", F.posexplode(F.array("s0", "s1", "s2")).alias("k", "v"))


def codes(t):
    return t("region").sparkSession.createDataFrame(e.one_vs_one_codes(["F", "O", "P"]), "cls string, k int, code int")


for _d, _sql in (("hamming", "sum(abs(sign(v)-code))/2"), ("euclidean", "sqrt(sum(pow(v-code,2)))"), ("attenuated", "sqrt(sum(pow(v-code,2)*code*code))"), ("linear", "-sum(v*code)"), ("laplacian", "(sum((sign(v)=code AND code<>0)::INT)+sum((sign(v)<>code AND code<>0)::INT)+2.0)/(sum((sign(v)=code AND code<>0)::INT)+1.0)")):
    q(f"decode_ecoc_{_d}", f"SELECT o_orderkey, min_by(cls,(d,cls)) AS cls, round(min(d),5) AS distance FROM (SELECT o_orderkey, cls, {_sql} AS d FROM {_LONG} l JOIN {_CODES} ON l.k=c.k GROUP BY 1,2) GROUP BY 1")(
        lambda t, d=_d: e.ecoc(long(t), "o_orderkey", "k", "v", codes(t), "cls", "code", d).withColumn("distance", F.round("distance", 5))
    )
for _h, _sql in (("sum", "sum(v)"), ("mean", "avg(CASE WHEN v<>0 THEN v END)"), ("median", "median(CASE WHEN v<>0 THEN v END)"), ("majority", "sum((v>0)::INT)::DOUBLE")):
    q(f"decode_max_wins_{_h}", f"SELECT o_orderkey, min_by(cls,(-s,cls)) AS cls FROM (SELECT o_orderkey, cls, {_sql} AS s FROM (SELECT o_orderkey, cls, v*code AS v FROM {_LONG} l JOIN {_CODES} ON l.k=c.k WHERE code<>0) GROUP BY 1,2) GROUP BY 1")(
        lambda t, h=_h: e.max_wins(long(t).join(F.broadcast(codes(t)), "k").filter("code <> 0").withColumn("v", F.col("v") * F.col("code")), "o_orderkey", "cls", "v", h)
    )
q("decode_dag", f"SELECT o_orderkey, CASE WHEN s1>0 THEN (CASE WHEN s0>0 THEN 'F' ELSE 'O' END) ELSE (CASE WHEN s2>0 THEN 'O' ELSE 'P' END) END AS cls FROM {S}")(lambda t: pair_scores(t).select("o_orderkey", e.dag(["F", "O", "P"], {("F", "O"): F.col("s0"), ("F", "P"): F.col("s1"), ("O", "P"): F.col("s2")}).alias("cls")))
q("codes_one_vs_one", f"SELECT * FROM {_CODES}")(codes)
q("codes_one_vs_all", "SELECT * FROM (VALUES ('F',0,1),('O',0,-1),('P',0,-1),('F',1,-1),('O',1,1),('P',1,-1),('F',2,-1),('O',2,-1),('P',2,1)) c(cls,k,code)")(lambda t: t("region").sparkSession.createDataFrame(e.one_vs_all_codes(["F", "O", "P"]), "cls string, k int, code int"))
q("fusion_late", f"SELECT o_orderkey, round((s0+s2)/2,6) AS s FROM {S}")(lambda t: e.late_fusion([pair_scores(t).select("o_orderkey", F.col("s0").alias("s")), pair_scores(t).select("o_orderkey", F.col("s2").alias("s"))], "o_orderkey", "s").withColumn("s", F.round("s", 6)))
q("fusion_stacking", f"SELECT p_partkey, max(CASE WHEN learner=0 THEN vote END) AS l0, max(CASE WHEN learner=1 THEN vote END) AS l1, max(CASE WHEN learner=2 THEN vote END) AS l2 FROM {V} GROUP BY 1")(lambda t: e.stack(votes(t), "p_partkey", "learner", "vote", [0, 1, 2]).toDF("p_partkey", "l0", "l1", "l2"))


# calibration of scores
def rated(t):
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), (F.least("n_chars", F.lit(4000)) / 4000.0).alias("s"))


q("calibrate_platt")(lambda t: c.platt(rated(t), "y", "s")(rated(t)).select("doc_id", F.round("probability", 6).alias("probability")))
q("calibrate_isotonic")(lambda t: c.isotonic(rated(t), "y", "s")(rated(t)).select("doc_id", F.round("probability", 6).alias("probability")))
q("calibrate_isotonic_ensemble")(lambda t: c.isotonic_ensemble(rated(t), "y", "s", "doc_id")(rated(t)).select("doc_id", F.round("probability", 6).alias("probability")))
_E = "(SELECT p_partkey, p_retailprice AS y, p_size*20.0+600 AS p FROM part)"
q("calibrate_detrend", f"SELECT p_partkey, round((p-i)/(1+s),4) AS corrected FROM {_E}, (SELECT regr_slope(p-y,y) AS s, regr_intercept(p-y,y) AS i FROM {_E})")(
    lambda t: (lambda d: c.apply_detrend(d, "p", c.detrend(d, "y", "p")).select("p_partkey", F.round("corrected", 4).alias("corrected")))(t("part").select("p_partkey", F.col("p_retailprice").alias("y"), (F.col("p_size") * 20.0 + 600).alias("p")))
)
for _k, _sql in (("scale", "(p_retailprice-900)/(2000.0-900)"), ("power", "pow(p_retailprice,0.5)"), ("log", "ln(p_retailprice)")):
    q(f"label_transform_{_k}", f"SELECT p_partkey, round({_sql},6) AS y FROM part")(lambda t, k=_k: t("part").select("p_partkey", F.round(c.label_transform(F.col("p_retailprice"), k, 900.0, 2000.0, 0.5), 6).alias("y")))
