"""Consensus over partitions and models, references within tolerances, filters on volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as c
from ..operators import spatial
from ..registry import query as q


def masks(t):
    return t("lineitem").groupBy("l_suppkey", "l_linenumber").agg((F.max("l_quantity") >= 46).cast("int").alias("chosen"))


_M = "(SELECT l_suppkey, l_linenumber, (max(l_quantity)>=46)::INT AS chosen FROM lineitem GROUP BY 1,2)"
_A = f"(SELECT l_suppkey, 100*sum(chosen)::DOUBLE/count(*) AS agreement FROM {_M} GROUP BY 1)"
_T = f"(SELECT max(s) AS cut FROM (SELECT s, sum((agreement>=s)::INT) AS n FROM {_A}, (SELECT 100-unnest(range(31)) AS s) GROUP BY 1) WHERE n>=3)"
for _mode, _at, _keep, _more in (("threshold", 100, f"agreement >= (SELECT cut FROM {_T})", {"tolerance": 30, "least": 3}), ("top", 12, "k <= 12", {}), ("share", 35, "k <= ceil(n*0.35)", {}), ("above", 80, "agreement > 80", {})):
    q(f"features_agreement_{_mode}", f"SELECT l_suppkey, round(agreement,6) AS agreement, {_keep} AS keep FROM (SELECT *, row_number() OVER (ORDER BY agreement DESC, l_suppkey) AS k, count(*) OVER () AS n FROM {_A})")(
        lambda t, m=_mode, a=_at, more=_more: c.agreement(masks(t), "l_suppkey", "chosen", m, a, **more).withColumn("agreement", F.round("agreement", 6))
    )
q("features_agreement_pruned", f"SELECT l_suppkey, l_linenumber, CASE WHEN agreement>80 THEN chosen ELSE 0 END AS chosen FROM {_M} JOIN {_A} USING (l_suppkey)")(lambda t: c.prune_masks(masks(t), c.agreement(masks(t), "l_suppkey", "chosen", "above", 80), "l_suppkey", "chosen"))

_V = """(SELECT o_orderkey, k, l, CASE k WHEN 0 THEN o_totalprice/100000-2 WHEN 1 THEN (o_custkey%7)-3.0 ELSE (o_orderkey%5)-2.0 END + l*((o_orderkey+k)%3) AS v,
 CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders, range(3) a(k), range(3) b(l))"""


def class_votes(t):
    o = t("orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(2))))
    v = F.when(F.col("k") == 0, F.col("o_totalprice") / 100000 - 2).when(F.col("k") == 1, F.col("o_custkey") % 7 - 3.0).otherwise(F.col("o_orderkey") % 5 - 2.0)
    return o.select("o_orderkey", "k", "l", (v + F.col("l") * ((F.col("o_orderkey") + F.col("k")) % 3)).alias("v"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"))


q("diversity_lobag_multi", f"""SELECT round(avg((won<>y)::INT)+coalesce(avg(s) FILTER (WHERE won=y),0)-coalesce(avg(s) FILTER (WHERE won<>y),0),6) AS lobag FROM
 (SELECT o_orderkey, any_value(y) AS y, avg(s) AS s, min_by(k,(-round(t,9),k)) AS won FROM (SELECT o_orderkey, k, any_value(y) AS y, var_pop(v) AS s, sum(v) AS t FROM {_V} GROUP BY 1,2) GROUP BY 1)""")(
    lambda t: c.lobag_multi(class_votes(t), "o_orderkey", "k", "v", "y").withColumn("lobag", F.round("lobag", 6))
)


def by_line(t, which):
    return t("lineitem").filter(which).select("l_suppkey", (F.col("l_quantity") - 25.0).alias("s"))


q("fusion_holdout_bagging", "SELECT l_suppkey, count(*) AS n, round(median(l_quantity-25.0),6) AS s, round(stddev_samp(l_quantity),6) AS sd, round(avg((l_quantity>25)::INT),6) AS positive FROM lineitem WHERE l_linenumber<=4 GROUP BY 1")(
    lambda t: c.bag_holdouts([by_line(t, f"l_linenumber = {i}") for i in range(1, 5)], "l_suppkey", "s").withColumns({n: F.round(n, 6) for n in ("s", "sd", "positive")})
)


def sources(t):
    p = t("part")
    return {"size": p.select("p_partkey", F.col("p_size").cast("double").alias("a")), "price": p.select("p_partkey", F.col("p_retailprice").alias("b"))}


def shares(df):
    """Columns as shares of the row's largest column: what this gives depends on whether sources are joined before."""
    cols = [x for x in df.columns if x != "p_partkey"]
    top = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    return df.withColumns({x: F.col(x) / (top + 1) for x in cols})


def added(df):
    return df.select("p_partkey", sum(F.col(x) for x in df.columns if x != "p_partkey").alias("score"))


_F = ("p_size/(greatest(p_size,p_retailprice)+1)", "p_retailprice/(greatest(p_size,p_retailprice)+1)", "p_size/(p_size+1.0)", "p_retailprice/(p_retailprice+1)")
for _i, (_n, _sql) in enumerate((
    ("none", f"SELECT p_partkey, round({_F[2]},6) AS score, 'size' AS source FROM part UNION ALL SELECT p_partkey, round({_F[3]},6), 'price' FROM part"), ("early", f"SELECT p_partkey, round({_F[0]}+{_F[1]},6) AS score FROM part"),
    ("intermediate", f"SELECT p_partkey, round({_F[2]}+{_F[3]},6) AS score FROM part"), ("late_parts", f"SELECT p_partkey, round(({_F[2]}+{_F[3]})/2,6) AS score FROM part"),
)):
    q(f"fusion_mode_{_n}", _sql)(lambda t, i=_i: c.fuse(sources(t), "p_partkey", i, shares, added).withColumn("score", F.round("score", 6)))

_N = "(SELECT l_returnflag AS cls, l_linenumber AS node, avg(l_quantity) AS worth FROM lineitem GROUP BY 1,2)"
_S = "(SELECT l_returnflag AS cls, l_linenumber AS node, l_suppkey AS id, avg(l_quantity-25.5) AS score, CASE WHEN l_suppkey%2=0 THEN 1 ELSE -1 END AS y FROM lineitem GROUP BY 1,2,3)"


def nodes(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("cls"), F.col("l_linenumber").alias("node")).agg(F.avg("l_quantity").alias("worth"))


def node_scores(t):
    s = t("lineitem").groupBy(F.col("l_returnflag").alias("cls"), F.col("l_linenumber").alias("node"), F.col("l_suppkey").alias("id")).agg(F.avg(F.col("l_quantity") - 25.5).alias("score"))
    return s.withColumn("y", F.when(F.col("id") % 2 == 0, 1).otherwise(-1))


_CUT = f"(SELECT cls, unnest([0.0,40.0,80.0]) AS percent, unnest([quantile_cont(worth,0.0),quantile_cont(worth,0.4),quantile_cont(worth,0.8)]) AS cut FROM {_N} GROUP BY cls)"
q("choose_node_percentile", f"""WITH r AS (SELECT cls, percent, avg((CASE WHEN m>=0 THEN 1 ELSE -1 END=y)::INT) AS accuracy, max(k) AS nodes FROM
 (SELECT s.cls, percent, id, avg(score) AS m, count(*) AS k, any_value(y) AS y FROM {_S} s JOIN {_N} n ON s.cls=n.cls AND s.node=n.node JOIN {_CUT} c ON n.cls=c.cls AND worth>=cut GROUP BY 1,2,3) GROUP BY 1,2)
 SELECT cls, percent::DOUBLE AS percent, nodes, round(accuracy,6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY accuracy DESC, percent DESC) AS r FROM r) WHERE r=1""")(
    lambda t: c.choose_percentile(nodes(t), node_scores(t), "cls", "node", "worth", "id", "score", "y", [0, 40, 80]).withColumn("accuracy", F.round("accuracy", 6))
)
q("search_work_blocks", "SELECT n_nationkey, n_regionkey, ((row_number() OVER (ORDER BY n_regionkey, n_nationkey)-1)//7+1)::INT AS worker FROM nation")(lambda t: c.work_blocks(t("nation").select("n_nationkey", "n_regionkey"), ["n_regionkey", "n_nationkey"], 4))


def cust(t):
    return t("customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"), F.length("c_mktsegment").cast("double").alias("seg"), "c_acctbal")


_C = "(SELECT c_custkey, c_nationkey::DOUBLE AS nation, length(c_mktsegment)::DOUBLE AS seg, c_acctbal FROM customer)"
_R = f"FROM {_C} a LEFT JOIN {_C} b ON b.c_custkey%5<>0 AND abs(b.nation-a.nation)<=2 AND abs(b.seg-a.seg)<=1 WHERE a.c_custkey%5=0 GROUP BY a.c_custkey, a.c_acctbal, a.nation"
for _h, _sql in (("znorm", "(a.c_acctbal-median(b.c_acctbal))/stddev_samp(b.c_acctbal)"), ("partcorr", "a.c_acctbal-regr_intercept(b.c_acctbal,b.nation)-regr_slope(b.c_acctbal,b.nation)*a.nation")):
    q(f"correct_local_{_h}", f"SELECT a.c_custkey, round({_sql},4) AS z, count(b.c_custkey) AS n {_R}")(
        lambda t, h=_h: c.local_reference(cust(t).filter("c_custkey % 5 <> 0"), cust(t).filter("c_custkey % 5 = 0"), {"nation": 2, "seg": 1}, "c_acctbal", h).select("c_custkey", F.round("c_acctbal", 4).alias("z"), "n")
    )

# the 64 entries of an embedding as a box of 4 x 4 x 4
_E = "(SELECT vec_id, embedding, i, i%4 AS x, (i//4)%4 AS y, i//16 AS z FROM embeddings, range(64) r(i))"
_AT = lambda x, y, z: f"embedding[1+{x}+4*({y})+16*({z})]::DOUBLE"
_EDGE = lambda v, s: f"greatest(0,least(3,{v}{s}))"
_ABS = "+".join(f"abs({_AT(*(_EDGE(v, s) if v == a else v for v in 'xyz'))}-{_AT('x', 'y', 'z')})" for a in "xyz" for s in ("-1", "+1"))
_CUBE = "list_value(" + ",".join(_AT(_EDGE("x", a), _EDGE("y", b), _EDGE("z", d)) for a in ("-1", "+0", "+1") for b in ("-1", "+0", "+1") for d in ("-1", "+0", "+1")) + ")"


def voxels(t, how, digits=6, **settings):
    one = spatial.filter_volumes(t("embeddings").select("vec_id", "embedding"), "embedding", (4, 4, 4), how, **settings)
    return one.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", digits))


for _n, _sql in (("differences6", f"SELECT vec_id, i::INT AS i, {_ABS} AS v FROM {_E}"), ("variance27", f"SELECT vec_id, i::INT AS i, list_aggregate({_CUBE},'var_pop') AS v FROM {_E}")):
    q(f"volume_{_n}", f"SELECT vec_id, i, round(v,6) AS v FROM ({_sql})")(lambda t, n=_n: voxels(t, n))
q("volume_consistency", f"SELECT vec_id, i, round(v/max(v) OVER (PARTITION BY vec_id),6) AS v FROM (SELECT vec_id, i::INT AS i, {_ABS} AS v FROM {_E})")(lambda t: voxels(t, "consistency"))
q("volume_over_differences6", f"SELECT vec_id, i::INT AS i, round({_AT('x', 'y', 'z')}/({_ABS}),5) AS v FROM {_E}")(lambda t: voxels(t, "over_differences6", 5))
q("volume_over_variance27", f"SELECT vec_id, i, round(e/(ln(v)/max(ln(v)) OVER (PARTITION BY vec_id)),4) AS v FROM (SELECT vec_id, i::INT AS i, {_AT('x', 'y', 'z')} AS e, list_aggregate({_CUBE},'var_pop') AS v FROM {_E})")(
    lambda t: voxels(t, "over_variance27", 4)
)
_FROM = "(SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS j FROM embeddings)"
_PAIR = lambda k: "*".join(f"{k}[1+4*({p.replace('#', 'i')})+({p.replace('#', 'j')})]" for p in ("#%4", "(#//4)%4", "#//16"))
_GK = "(SELECT [exp(-0.5*pow((a//4-a%4)/s,2))/w for a in range(16)] AS k FROM (SELECT s, list_sum([exp(-0.5*pow(r/s,2)) for r in range(-4,5)]) AS w FROM (SELECT 2.0/sqrt(8*ln(2)) AS s)))"
_SUM = lambda k: f"SELECT vec_id, i::INT AS i, round(sum(e*{_PAIR('k')}),5) AS v FROM {_FROM}, range(64) r(i), {k} GROUP BY 1,2"
q("volume_gaussian", _SUM(_GK))(lambda t: voxels(t, "gaussian", 5, fwhm=2.0))
for _how in ("approximation", "soft", "hard"):
    q(f"volume_wavelet_{_how}")(lambda t, h=_how: voxels(t, "wavelet", level=2, keep=h))
q("volume_clusters")(lambda t: voxels(t, "clusters", threshold=0.1))
