"""Statistics, similarities, ranks and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import special, stats, vectors
from ..operators import aggregates as a
from ..operators import numeric
from ..registry import query as q

R = 6
_V = "(SELECT event_type, event_id, CASE WHEN event_id%7=0 THEN NULL ELSE value END AS v FROM events)"


def gaps(t):
    return t("events").select("event_type", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


for _n, _sql, _f in (
    ("nan_mean", "avg(v)", F.avg), ("nan_std", "stddev_samp(v)", F.stddev_samp), ("min_max_range", "max(v)-min(v)", lambda c: F.max(c) - F.min(c)),
    ("kurtosis", "kurtosis_pop(v)", F.kurtosis), ("skewness", "(avg(pow(v,3))-3*avg(v)*avg(v*v)+2*pow(avg(v),3))/pow(var_pop(v),1.5)", F.skewness),
    ("skewness_sample_sd", "(avg(pow(v,3))-3*avg(v)*avg(v*v)+2*pow(avg(v),3))/pow(stddev_samp(v),3)", lambda c: stats.skew_sample_sd(F.col(c))),
    ("weighted_mean", "sum(v*event_id)/sum(CASE WHEN v IS NOT NULL THEN event_id END)", lambda c: stats.weighted_mean(F.col(c), F.col("event_id"))),
):
    q(f"agg_{_n}", f"SELECT event_type, round({_sql},4) AS x FROM {_V} GROUP BY 1")(lambda t, f=_f: gaps(t).groupBy("event_type").agg(F.round(f("v"), 4).alias("x")))
q("agg_nan_count", f"SELECT event_type, count(v) AS n, count(*)-count(v) AS missing FROM {_V} GROUP BY 1")(lambda t: gaps(t).groupBy("event_type").agg(F.count("v").alias("n"), F.sum(F.col("v").isNull().cast("long")).alias("missing")))
q("agg_nan_median", f"SELECT event_type, round(median(v),{R}) AS x FROM {_V} GROUP BY 1")(lambda t: gaps(t).groupBy("event_type").agg(F.round(F.median("v"), R).alias("x")))
q("agg_nan_plus", f"SELECT event_id, coalesce(v,0)+coalesce(nullif(event_id%3,0),0) AS x FROM {_V}")(lambda t: gaps(t).select("event_id", stats.plus(F.col("v"), F.nullif(F.col("event_id") % 3, F.lit(0))).alias("x")))
_HZ = "(SELECT o_orderpriority, p, list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders, (VALUES (0.1),(0.25),(0.5),(0.9)) v(p) GROUP BY 1,2)"
_POS = "greatest(1.0,least(n::DOUBLE,n*p::DOUBLE+0.5))"
q("agg_hazen_percentile", f"SELECT o_orderpriority, p::DOUBLE AS p, round(l[floor({_POS})::INT]+(l[least(floor({_POS})::INT+1,n)]-l[floor({_POS})::INT])*({_POS}-floor({_POS})),4) AS q FROM {_HZ}")(
    lambda t: stats.hazen(t("orders"), ["o_orderpriority"], "o_totalprice", [0.1, 0.25, 0.5, 0.9]).withColumn("q", F.round("q", 4))
)
q("agg_percentile_rank", "SELECT p::DOUBLE AS point, round(100*(sum(CASE WHEN o_totalprice<p THEN 1.0 ELSE 0 END)+0.5*sum(CASE WHEN o_totalprice=p THEN 1.0 ELSE 0 END))/count(*),6) AS percentile FROM orders, (VALUES (50000),(150000),(250000)) v(p) GROUP BY p")(
    lambda t: a.percentile_rank(t("orders"), "o_totalprice", [50000, 150000, 250000]).withColumn("percentile", F.round("percentile", 6))
)
q("agg_quantile_split", """SELECT o_orderkey, 1+(CASE WHEN o_totalprice>=q[1] THEN 1 ELSE 0 END)+(CASE WHEN o_totalprice>=q[2] THEN 1 ELSE 0 END)+(CASE WHEN o_totalprice>=q[3] THEN 1 ELSE 0 END) AS bin FROM orders,
 (SELECT list_transform([0.25,0.5,0.75], lambda p: l[floor(n*p+0.5)::INT]+(l[floor(n*p+0.5)::INT+1]-l[floor(n*p+0.5)::INT])*(n*p::DOUBLE+0.5-floor(n*p+0.5))) AS q FROM (SELECT list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders))""")(
    lambda t: a.quantile_split(t("orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice", 4).select("o_orderkey", "bin")
)
q("agg_unique_counts", """SELECT feature, count(*) AS n_unique, round(100*max(n)/sum(n),6) AS top_percent, 100*max(n)/sum(n)>=40 AS flagged FROM (SELECT 'l_linenumber' AS feature, l_linenumber::DOUBLE AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY 2
 UNION ALL SELECT 'l_discount', l_discount, count(*) FROM lineitem GROUP BY 2) GROUP BY 1""")(lambda t: a.unique_counts(t("lineitem"), ["l_linenumber", "l_discount"], 40).withColumn("top_percent", F.round("top_percent", 6)))
q("agg_frequency_table", "SELECT p_size, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),6) AS percent FROM part GROUP BY 1")(lambda t: a.value_table(t("part"), "p_size").withColumn("percent", F.round("percent", 6)))
q("agg_feature_quality", """SELECT 'v' AS feature, count(v) AS n, count(*)-count(v) AS missing, round(avg(v),4) AS mean, round(stddev_samp(v),4) AS sd, min(v)=max(v) AS constant FROM """ + _V + """ UNION ALL SELECT 'event_id', count(event_id), 0, round(avg(event_id),4), round(stddev_samp(event_id),4), min(event_id)=max(event_id) FROM events""")(
    lambda t: a.quality_summary(gaps(t), ["v", "event_id"]).withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})
)
q("agg_label_summary", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1,2")(lambda t: t("labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")))
q("agg_group_sizes", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")(lambda t: t("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
q("agg_correlation_matrix", """SELECT 'l_quantity' AS a,'l_extendedprice' AS b,count(*) AS n,round(corr(l_quantity,l_extendedprice),6) AS r FROM lineitem UNION ALL SELECT 'l_quantity','l_tax',count(*),round(corr(l_quantity,l_tax),6) FROM lineitem
 UNION ALL SELECT 'l_extendedprice','l_tax',count(*),round(corr(l_extendedprice,l_tax),6) FROM lineitem""")(lambda t: a.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", F.round("r", 6)))
_RANK = "rank() OVER (PARTITION BY p_brand ORDER BY {c})+(count(*) OVER (PARTITION BY p_brand,{c})-1)/2.0"
q("agg_spearman", f"SELECT p_brand, round(corr(a,b),6) AS rho FROM (SELECT p_brand, {_RANK.format(c='p_size')} AS a, {_RANK.format(c='p_retailprice')} AS b FROM part) GROUP BY 1")(lambda t: a.spearman(t("part"), ["p_brand"], "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6)))
q("agg_p_from_r")(lambda t: a.correlations(t("part"), ["p_size", "p_retailprice"]).withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).withColumn("p", special.t_p(F.col("t"), (F.col("n") - 2).cast("double"))))
q("agg_fisher_z", "SELECT l_orderkey, l_linenumber, l_partkey, round(atanh(l_discount*9),9) AS z FROM lineitem")(lambda t: t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.atanh(F.col("l_discount") * 9), 9).alias("z")))
q("agg_fisher_inverse", "SELECT c_custkey, round(tanh(c_acctbal/5000),9) AS r FROM customer")(lambda t: t("customer").select("c_custkey", F.round(F.tanh(F.col("c_acctbal") / 5000), 9).alias("r")))
q("agg_biweight", """SELECT p_brand, round(sum(za*zb)/sqrt(sum(za*za)*sum(zb*zb)),6) AS r FROM (SELECT p_brand, (a-ma)*(CASE WHEN abs((a-ma)/(9*sa))<1 THEN pow(1-pow((a-ma)/(9*sa),2),2) ELSE 0 END) AS za, (b-mb)*(CASE WHEN abs((b-mb)/(9*sb))<1 THEN pow(1-pow((b-mb)/(9*sb),2),2) ELSE 0 END) AS zb
 FROM (SELECT *, median(abs(a-ma)) OVER (PARTITION BY p_brand) AS sa, median(abs(b-mb)) OVER (PARTITION BY p_brand) AS sb FROM (SELECT p_brand, p_size::DOUBLE AS a, p_retailprice AS b, median(p_size::DOUBLE) OVER (PARTITION BY p_brand) AS ma, median(p_retailprice) OVER (PARTITION BY p_brand) AS mb FROM part))) GROUP BY 1""")(
    lambda t: a.biweight(t("part").select("p_brand", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), ["p_brand"], "a", "b").withColumn("r", F.round("r", 6))
)
_PAIR = "(SELECT x.vec_id AS i, y.vec_id AS j, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id=x.vec_id+1)"


def pairs(t):
    e = t("embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("b")), "i")


_D = "list_inner_product({},{})"
_COS = f"({_D.format('a', 'b')}/(sqrt({_D.format('a', 'a')})*sqrt({_D.format('b', 'b')})))"
q("similarity_cosine", f"SELECT i, round({_COS},5) AS s FROM {_PAIR}")(lambda t: pairs(t).select("i", F.round(vectors.cosine(F.col("a"), F.col("b")), 5).alias("s")))
q("similarity_euclidean", f"SELECT i, round(1-sqrt(greatest(2-2*{_COS},0))/2,5) AS s FROM {_PAIR}")(lambda t: pairs(t).select("i", F.round(vectors.euclidean_similarity(F.col("a"), F.col("b")), 5).alias("s")))
q("similarity_pearson", f"SELECT i, round((64*{_D.format('a', 'b')}-list_sum(a)*list_sum(b))/(sqrt(64*{_D.format('a', 'a')}-pow(list_sum(a),2))*sqrt(64*{_D.format('b', 'b')}-pow(list_sum(b),2))),5) AS s FROM {_PAIR}")(lambda t: pairs(t).select("i", F.round(vectors.pearson(F.col("a"), F.col("b")), 5).alias("s")))
q("similarity_total_kl", """SELECT i, round(list_sum([p[k]*ln(p[k]/r[k]) for k in range(1,65)])/sqrt(1+list_sum([x*pow(1+ln(x),2) for x in r])),5) AS s FROM (SELECT i, [exp(x)/list_sum([exp(y) for y in a]) for x in a] AS p, [exp(x)/list_sum([exp(y) for y in b]) for x in b] AS r FROM """ + _PAIR + ")")(
    lambda t: pairs(t).select("i", F.round(vectors.total_kl(F.transform("a", lambda x: F.exp(x.cast("double"))), F.transform("b", lambda x: F.exp(x.cast("double")))), 5).alias("s"))
)
_G = "(SELECT max(p_size)-min(p_size) AS rs, max(p_retailprice)-min(p_retailprice) AS rp FROM part)"
q("similarity_gower", f"SELECT a.p_partkey AS i, b.p_partkey AS j, round((1-abs(a.p_size-b.p_size)/rs::DOUBLE+1-abs(a.p_retailprice-b.p_retailprice)/rp+(a.p_brand=b.p_brand)::INT)/3,9) AS s FROM part a JOIN part b ON a.p_partkey%50=0 AND a.p_partkey<>b.p_partkey, {_G}")(lambda t: (lambda d: numeric.gower(d, "p_partkey", ["p_size", "p_retailprice"], ["p_brand"], d.filter("p_partkey % 50 = 0")))(t("part").select("p_partkey", "p_size", "p_retailprice", "p_brand")))
_L3 = ("l_quantity", "l_extendedprice", "l_tax")
_CV = ", ".join(f"covar_samp({a},{b}) AS s{i}{j}" for i, a in enumerate(_L3) for j, b in enumerate(_L3))
_DET = lambda s: f"({s('00')}*({s('11')}*{s('22')}-{s('12')}*{s('12')})-{s('01')}*({s('01')}*{s('22')}-{s('12')}*{s('02')})+{s('02')}*({s('01')}*{s('12')}-{s('11')}*{s('02')}))"
_ADJ = {"00": "m11*m22-m12*m12", "11": "m00*m22-m02*m02", "22": "m00*m11-m01*m01", "01": "m02*m12-m01*m22", "02": "m01*m12-m02*m11", "12": "m01*m02-m00*m12"}
_MAHA = "+".join(f"d{i}*d{j}*({_ADJ[''.join(sorted(f'{i}{j}'))]})" for i in range(3) for j in range(3))
SMALL = {
    "bhattacharyya": f"""SELECT round(({_MAHA})/{_DET(lambda k: 'm' + k)}/8+0.5*ln({_DET(lambda k: 'm' + k)}/sqrt({_DET(lambda k: 'a.s' + k)}*{_DET(lambda k: 'b.s' + k)})),6) AS distance
 FROM (SELECT *, {", ".join(f"(a.s{i}{j}+b.s{i}{j})/2 AS m{i}{j}" for i in range(3) for j in range(3))}, {", ".join(f"a.u{i}-b.u{i} AS d{i}" for i in range(3))}, a, b FROM c a JOIN c b ON a.l_linestatus='F' AND b.l_linestatus='O')""",
    "kl_similarity": """SELECT a.g AS a, b.g AS b, round(exp(-0.5*((a.v+pow(a.m-b.m,2))/b.v+(b.v+pow(a.m-b.m,2))/a.v-2)),9) AS similarity FROM g a JOIN g b ON a.g<b.g""",
    "mahalanobis": "SELECT p_partkey, round(sqrt((pow(p_size-mx,2)*vy-2*(p_size-mx)*(p_retailprice-my)*c+pow(p_retailprice-my,2)*vx)/(vx*vy-c*c)),6) AS distance FROM part, (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS vx, var_samp(p_retailprice) AS vy, covar_samp(p_size,p_retailprice) AS c FROM part)",
    "kernel_density": """SELECT round(lo+step*i,4) AS x, round(sum(c*exp(-0.5*pow(step*(i-b)/h,2)))/(any_value(n)*any_value(h)*sqrt(2*pi())),12) AS density FROM s, (SELECT round((o_totalprice-lo)/step)::INT AS b, count(*) AS c FROM orders, s GROUP BY 1), range(256) r(i) GROUP BY i, lo, step""",
    "knee_point": """SELECT k::INT AS index, any_value(n)::DOUBLE AS "value" FROM (SELECT k, sum(e) AS e FROM (SELECT k, regr_syy(y,i)-coalesce(pow(regr_sxy(y,i),2)/nullif(regr_sxx(y,i),0),0) AS e FROM t, range(1,1000) r(k), (VALUES (0),(1)) s(side)
 WHERE k<(SELECT max(i) FROM t) AND CASE WHEN side=0 THEN i<=k ELSE i>=k END GROUP BY k, side) GROUP BY 1) JOIN (SELECT i, n FROM t) ON i=k GROUP BY k, e QUALIFY row_number() OVER (ORDER BY round(e,6), k)=1""",
}
WITH = {
    "bhattacharyya": f"c AS (SELECT l_linestatus, {_CV}, {', '.join(f'avg({c}) AS u{i}' for i, c in enumerate(_L3))} FROM lineitem GROUP BY 1)", "kl_similarity": "g AS (SELECT c_mktsegment AS g, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1)",
    "kernel_density": "s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice)-min(o_totalprice))/255 AS step, count(*) AS n, 1.06*stddev_samp(o_totalprice)*pow(count(*),-0.2) AS h FROM orders)",
    "knee_point": "t AS (SELECT row_number() OVER (ORDER BY n DESC)-1 AS i, n, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS y FROM (SELECT count(*) AS n FROM part GROUP BY p_brand))",
}
ROUNDED = {"bhattacharyya": {"distance": 6}, "kl_similarity": {"similarity": 9}, "kernel_density": {"x": 4, "density": 12}}
for _n in ("bhattacharyya", "kl_similarity", "mahalanobis", "randomised_dependence", "kernel_density", "knee_point", "linkage"):
    q(f"numeric_{_n}", (f"WITH {WITH[_n]} " if _n in WITH else "") + SMALL[_n] if _n in SMALL else None)(lambda t, n=_n: getattr(numeric, n)(t).withColumns({c: F.round(c, d) for c, d in ROUNDED.get(n, {}).items()}))
q("agg_mutual_information", """SELECT round(sum(p*log2(p/(px*py))),6) AS mi, round(-sum(p*log2(p/py)),6) AS h_x_given_y FROM (SELECT p, sum(p) OVER (PARTITION BY x) AS px, sum(p) OVER (PARTITION BY y) AS py FROM (SELECT l_returnflag AS x, l_linestatus AS y, count(*)/CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM lineitem GROUP BY 1,2))""")(
    lambda t: a.mutual_information(t("lineitem"), "l_returnflag", "l_linestatus").select(F.round("mi", 6).alias("mi"), F.round("h_x_given_y", 6).alias("h_x_given_y"))
)
q("agg_entropy", "SELECT c_mktsegment, round(-sum(p*log2(p)),6) AS entropy FROM (SELECT c_mktsegment, c_nationkey, count(*)/CAST(sum(count(*)) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS p FROM customer GROUP BY 1,2) GROUP BY 1")(lambda t: a.entropy(t("customer"), ["c_mktsegment"], "c_nationkey").withColumn("entropy", F.round("entropy", 6)))
q("agg_kernel_estimate_2d", """SELECT gx, gy, round(sum(w*z)/sum(w),6) AS z FROM (SELECT x.k*10.0::DOUBLE AS gx, y.k*400.0+900::DOUBLE AS gy, exp(-0.5*(pow((p.p_size-x.k*10.0)/10,2)+pow((p.p_retailprice-(y.k*400.0+900))/400,2))) AS w, p.p_size*1.0 AS z FROM part p, range(0,6) x(k), range(0,4) y(k)) GROUP BY 1,2""")(
    lambda t: numeric.kernel_2d(t("part"), "p_size", "p_retailprice", F.col("p_size") * 1.0, [k * 10.0 for k in range(6)], [k * 400.0 + 900 for k in range(4)], 10, 400).withColumn("z", F.round("z", 6))
)
q("agg_cv_ratio", "SELECT event_type, round(avg(value),6) AS mean, round(avg(value)/(stddev_pop(value)/sqrt(count(value))),4) AS ratio FROM events GROUP BY 1")(lambda t: a.cv_ratio(t("events"), ["event_type"], "value").withColumns({"mean": F.round("mean", 6), "ratio": F.round("ratio", 4)}))
q("agg_fold_mean_sd", "SELECT l_linenumber, round(avg(acc),6) AS mean, round(stddev_samp(acc),6) AS sd FROM (SELECT l_linenumber, l_orderkey%5 AS fold, avg(l_discount) AS acc FROM lineitem GROUP BY 1,2) GROUP BY 1")(
    lambda t: t("lineitem").groupBy("l_linenumber", (F.col("l_orderkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("acc")).groupBy("l_linenumber").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("sd"))
)
q("agg_weighted_median", "SELECT p_brand, min(p_size) AS median FROM (SELECT p_brand, p_size, sum(sum(p_retailprice)) OVER (PARTITION BY p_brand ORDER BY p_size) AS c, sum(sum(p_retailprice)) OVER (PARTITION BY p_brand) AS t FROM part GROUP BY 1,2) WHERE 2*c>=t GROUP BY 1")(lambda t: a.weighted_median(t("part"), ["p_brand"], "p_size", "p_retailprice"))
q("agg_majority_vote", """SELECT o_custkey, o_orderstatus, round(n/CAST(t AS DOUBLE),6) AS share, ties>1 AS tie FROM (SELECT *, sum(CASE WHEN k=1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS ties FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS t,
 row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r, rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) AS k FROM orders GROUP BY 1,2)) WHERE r=1""")(lambda t: a.majority(t("orders"), ["o_custkey"], "o_orderstatus").withColumn("share", F.round("share", 6)))
q("agg_vote_probabilities", "SELECT o_custkey, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus='{k}' THEN 1.0 ELSE 0.0 END),6) AS p_{k}" for k in "FOP") + " FROM orders GROUP BY 1")(lambda t: t("orders").groupBy("o_custkey").agg(*(F.round(F.avg((F.col("o_orderstatus") == k).cast("double")), 6).alias(f"p_{k}") for k in "FOP")))

# windows and ranks
q("window_moving_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) AS m FROM events")(lambda t: a.moving_mean(t("events"), ["user_id"], ["ts", "event_id"], "value", 5, "m").select("event_id", F.round("m", 6).alias("m")))
q("window_sliding_rate", """SELECT event_id, round(rate,6) AS rate, round(mean_x,6) AS mean_x FROM (SELECT event_id, sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) OVER w/10.0 AS rate, avg(value) OVER w AS mean_x, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)) WHERE n=11""")(
    lambda t: a.sliding_rate(t("events").withColumn("hit", (F.col("event_type") == "click").cast("int")), ["user_id"], ["value", "event_id"], "hit", "value", 10).select("event_id", F.round("rate", 6).alias("rate"), F.round("mean_x", 6).alias("mean_x"))
)
q("window_tied_rank", f"SELECT p_partkey, {_RANK.format(c='p_size')} AS r FROM part")(lambda t: stats.tied_rank(t("part"), ["p_brand"], "p_size").select("p_partkey", "r"))
q("window_rank_transform", """SELECT c_custkey, round((SELECT 100*(sum(CASE WHEN s_acctbal<c_acctbal THEN 1.0 ELSE 0 END)+0.5*sum(CASE WHEN s_acctbal=c_acctbal THEN 1.0 ELSE 0 END))/count(*) FROM supplier),6) AS pr FROM customer""")(lambda t: numeric.rank_against(t("customer"), "c_acctbal", t("supplier"), "s_acctbal", "pr").select("c_custkey", F.round("pr", 6).alias("pr")))
q("window_ordinal_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer")(lambda t: t("customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).alias("r")))
q("window_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part")(lambda t: t("part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("r")))
q("window_average_rank", "SELECT p_partkey, round(((rank() OVER (ORDER BY p_size))+(rank() OVER (ORDER BY p_retailprice)))/2.0,6) AS r FROM part")(
    lambda t: (lambda x: stats.value_counts(x, [], "p_size").select("p_size", (F.col("cum") - F.col("n") + 1).alias("a")).join(x, "p_size").join(stats.value_counts(x, [], "p_retailprice").select("p_retailprice", (F.col("cum") - F.col("n") + 1).alias("b")), "p_retailprice").select("p_partkey", F.round((F.col("a") + F.col("b")) / 2, 6).alias("r")))(t("part"))
)
q("sort_rows", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")(lambda t: t("nation").select("n_nationkey", "n_name").orderBy("n_name"))
q("arg_max", "SELECT c_nationkey, max_by(c_custkey, (c_acctbal, -c_custkey)) AS k FROM customer GROUP BY 1")(lambda t: t("customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("k")))
q("binary_search", "SELECT p_partkey, (SELECT count(*) FROM nation WHERE n_nationkey*2<=p_size) AS pos FROM part")(lambda t: numeric.positions(t("part"), "p_size", t("nation").select((F.col("n_nationkey") * 2).alias("v")), "v", "pos").select("p_partkey", "pos"))
q("top_k_features", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r<=3")(
    lambda t: t("part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("r")).filter("r <= 3").drop("r")
)
q("cumulative_energy", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, coalesce(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b, sum(p_retailprice) OVER (PARTITION BY p_brand) AS t FROM part) WHERE b<0.2*t")(
    lambda t: a.leading(t("part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], "p_retailprice", 0.2).drop("p_retailprice")
)
q("detrend_linear", "SELECT event_id, round(value-(regr_slope(value,event_id) OVER (PARTITION BY event_type)*event_id+regr_intercept(value,event_id) OVER (PARTITION BY event_type)),4) AS d FROM events")(lambda t: a.detrended(t("events"), ["event_type"], "event_id", "value", "d").select("event_id", F.round("d", 4).alias("d")))
q("softmax_sharp", "SELECT p_partkey, round(exp(3*p_size/50.0)/sum(exp(3*p_size/50.0)) OVER (PARTITION BY p_brand),9) AS s FROM part")(lambda t: t("part").select("p_partkey", F.round(stats.softmax(F.col("p_size") / 50.0, ["p_brand"]), 9).alias("s")))
q("logistic", "SELECT c_custkey, round(1/(1+exp(-c_acctbal/1000)),9) AS s FROM customer")(lambda t: t("customer").select("c_custkey", F.round(1 / (1 + F.exp(-F.col("c_acctbal") / 1000)), 9).alias("s")))
q("normal_pdf", "SELECT c_custkey, round(exp(-0.5*pow((c_acctbal-100)/2000,2))/(2000*sqrt(2*pi())),12) AS s FROM customer")(lambda t: t("customer").select("c_custkey", F.round(stats.normal_pdf(F.col("c_acctbal"), 100, 2000), 12).alias("s")))
q("normal_cdf")(lambda t: t("customer").select("c_custkey", F.round(special.cdf(F.col("c_acctbal") / 5000), 9).alias("s")))
q("exponent_grid", "SELECT k AS i, round(pow(2.0,k),6) AS v FROM range(-3,4) r(k)")(lambda t: t("region").limit(1).select(F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("i")).select(F.col("i").cast("long"), F.round(F.pow(F.lit(2.0), "i"), 6).alias("v")))
q("geometric_halving", "SELECT k AS i, round(64*pow(0.5,k),6) AS v FROM range(0,7) r(k)")(lambda t: t("region").limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select(F.col("i").cast("long"), F.round(64 * F.pow(F.lit(0.5), "i"), 6).alias("v")))
q("score_map_lookup", "SELECT p_partkey, round(CASE WHEN p_size<=1 THEN 0 WHEN p_size<=20 THEN (p_size-1)*0.3/19 ELSE 0.3+(least(p_size,50)-20)*0.7/30 END::DOUBLE,9) AS p FROM part")(
    lambda t: numeric.interpolate(t("part"), "p_size", [(1, 0.0), (20, 0.3), (50, 1.0)], "p").select("p_partkey", F.round("p", 9).alias("p"))
)
