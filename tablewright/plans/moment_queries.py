"""Moment-based ranks, matches and maps; kernel learners; values inside JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernel_learners as k
from ..operators import moment_forms as m
from ..operators import reduction
from ..operators.model_building import Chain, principal_components
from ..registry import query as q
from ..sources import io

X = ["l_quantity", "l_discount", "l_tax"]


def lines(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").cast("int").alias("y"), *(F.col(c).cast("double").alias(c) for c in [*X, "l_extendedprice"]))


def _loo(skip: str) -> str:
    """One over the two-class distance on the two other columns."""
    a, b = (c for c in X if c != skip)
    cov = ", ".join(f"{f}({u},{v}) AS {n}" for f, u, v, n in (("covar_samp", a, a, "p"), ("covar_samp", b, b, "r"), ("covar_samp", a, b, "o")))
    det = lambda s: f"({s('p')}*{s('r')}-pow({s('o')},2))"
    mid, one, two = (lambda c: f"((f.{c}+o.{c})/2)"), (lambda c: f"f.{c}"), (lambda c: f"o.{c}")
    d = f"(pow(f.ma-o.ma,2)*{mid('r')}-2*(f.ma-o.ma)*(f.mb-o.mb)*{mid('o')}+pow(f.mb-o.mb,2)*{mid('p')})/{det(mid)}/8+0.5*ln({det(mid)}/sqrt({det(one)}*{det(two)}))"
    g = f"(SELECT l_linestatus AS s, avg({a}) AS ma, avg({b}) AS mb, {cov} FROM lineitem GROUP BY 1)"
    return f"SELECT '{skip}' AS feature, round(ln(1/({d})),4) AS weight FROM {g} f JOIN {g} o ON f.s='F' AND o.s='O'"


q("rank_bhattacharyya", " UNION ALL ".join(map(_loo, X)))(lambda t: m.bhattacharyya_rank(lines(t), X, "y").withColumn("weight", F.round(F.ln("weight"), 4)))
q("weights_analytic_p")(lambda t: m.analytic_p(lines(t), X, "y", 1, [0.2, -1.0, 0.4]))
q("match_components")(lambda t: m.match_components(lines(t), ["l_extendedprice", "l_linenumber"], X))
q("merge_references")(lambda t: m.merge_references(lines(t), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.5))
q("simulate_components")(lambda t: m.component_cases(t("part").select("p_size", "p_retailprice", (F.col("p_partkey") % 3).alias("label")), ["p_size", "p_retailprice", "label"], 500, 1))

_D = "(SELECT l_orderkey, l_linenumber, l_quantity AS u, l_discount AS v, (l_linestatus='O')::INT AS y FROM lineitem)"
_S = f"(SELECT avg(u) AS mu, avg(v) AS mv, stddev_samp(u) AS su, stddev_samp(v) AS sv, covar_samp(u,y) AS uy, covar_samp(v,y) AS vy FROM {_D})"
_W = f"(SELECT sum((n-1)*uu) AS uu, sum((n-1)*vv) AS vv, sum((n-1)*uv) AS uv, sum((2*y-1)*a) AS da, sum((2*y-1)*b) AS db FROM (SELECT y, count(*) AS n, avg(u) AS a, avg(v) AS b, var_samp(u) AS uu, var_samp(v) AS vv, covar_samp(u,v) AS uv FROM {_D} GROUP BY 1))"
_Z = "SELECT l_orderkey, l_linenumber, round(((u-mu)/su*a+(v-mv)/sv*b)/sqrt(a*a+b*b)*CASE WHEN abs(a)>=abs(b) THEN sign(a) ELSE sign(b) END,5) AS z1 FROM {0}, (SELECT mu, mv, su, sv, {1} AS a, {2} AS b FROM {3})"
for _m, _a, _b, _t in (("lda", "vv/(sv*sv)*da/su-uv/(su*sv)*db/sv", "uu/(su*su)*db/sv-uv/(su*sv)*da/su", f"{_S}, {_W}"), ("pls", "uy/su", "vy/sv", _S)):
    q(f"reduce_{_m}_pair", _Z.format(_D, _a, _b, _t))(lambda t, w=_m: reduction.reduce(lines(t), ["l_quantity", "l_discount"], "y", w, 1).select("l_orderkey", "l_linenumber", F.round("z1", 5).alias("z1")))
q("reduce_ppca")(lambda t: reduction.reduce(lines(t), [*X, "l_extendedprice"], "y", "ppca", 2))
_PC = "(SELECT avg(p_size) AS mu, avg(p_retailprice) AS mv, 0.5*atan2(2*covar_samp(p_size,p_retailprice),var_samp(p_size)-var_samp(p_retailprice)) AS th FROM part WHERE p_partkey%3<>0)"
q("chain_unseen_pair", f"SELECT p_partkey, round(((p_size-mu)*cos(th)+(p_retailprice-mv)*sin(th))*CASE WHEN abs(cos(th))>=abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END,5) AS pc1 FROM part, {_PC} WHERE p_partkey%3=0")(
    lambda t: Chain(principal_components(["p_size", "p_retailprice"], 1)).fit(t("part").filter("p_partkey % 3 <> 0")).apply(t("part").filter("p_partkey % 3 = 0")).select("p_partkey", F.round("pc1", 5).alias("pc1"))
)


def part(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 7).cast("double").alias("k"), "p_retailprice", (F.col("p_size") > 25).cast("int").alias("big"))


for _n in k.LEARNERS:
    _l = {"support_classifier": "big", "relevance_classifier": "big", "one_class": None}.get(_n, "p_retailprice")
    q(f"learn_{_n}")(lambda t, n=_n, y=_l: k.fit(n, part(t).filter("p_partkey % 4 <> 0"), ["p_size", "k"], y, sample=300)(part(t).filter("p_partkey % 4 = 0")))
q("struct_find_deep", "SELECT event_id, '$.k' AS path FROM events WHERE json_extract(props,'$.k')::INT%5=2")(lambda t: io.find_in_json(t("events"), "props", lambda v: isinstance(v, int) and v % 5 == 2).select("event_id", F.explode("paths").alias("path")))
