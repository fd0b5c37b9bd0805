"""Selection, matching, sets, strings and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours
from ..operators import relational as r
from ..registry import query


def q(name, sql=None):
    return query(name, sql)


q("row_select", "SELECT * FROM nation WHERE n_nationkey IN (3,5,7)")(lambda t: t("nation").filter(F.col("n_nationkey").isin(3, 5, 7)))
q("row_set", "SELECT n_nationkey, CASE WHEN n_nationkey=3 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation")(lambda t: r.set_row(t("nation"), "n_nationkey", 3, {"n_name": "X"}))
q("row_insert", "SELECT r_regionkey, r_name, NULL::INT AS n_nationkey FROM region UNION ALL SELECT NULL, n_name, n_nationkey FROM nation WHERE n_nationkey<3")(
    lambda t: r.append(t("region"), t("nation").filter("n_nationkey < 3").select(F.col("n_name").alias("r_name"), "n_nationkey"))
)
q("row_match", "SELECT * FROM part WHERE p_brand='Brand#1' AND p_size=5")(lambda t: r.match_row(t("part"), {"p_brand": "Brand#1", "p_size": 5}))
_HOLES = "(SELECT p_partkey, nullif(p_size,1) AS a, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_retailprice END AS b, CASE WHEN p_partkey>0 THEN NULL ELSE 1 END AS c FROM part)"


def holes(t):
    return t("part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("a"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("b"), F.when(F.col("p_partkey") <= 0, 1).alias("c"))


q("nan_prune_all", f"SELECT * FROM {_HOLES} WHERE NOT (a IS NULL AND b IS NULL)")(lambda t: r.prune(holes(t), ["a", "b"], "all"))
q("nan_prune_any", f"SELECT * FROM {_HOLES} WHERE a IS NOT NULL AND b IS NOT NULL")(lambda t: r.prune(holes(t), ["a", "b"], "any"))
q("nan_restore", f"SELECT p.p_partkey, h.a, h.b FROM part p LEFT JOIN (SELECT * FROM {_HOLES} WHERE a IS NOT NULL AND b IS NOT NULL) h ON p.p_partkey=h.p_partkey")(
    lambda t: r.restore(t("part"), r.prune(holes(t), ["a", "b"], "any").select("p_partkey", "a", "b"), "p_partkey")
)
q("nan_inform", f"""SELECT feature, round(missing,6) AS missing, CASE WHEN missing=0 THEN 'none' WHEN missing<=25 THEN 'to 25' WHEN missing<=50 THEN 'to 50' WHEN missing<100 THEN 'to 99' ELSE 'all' END AS bin
 FROM (SELECT u.* FROM (SELECT 100*avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END) AS a, 100*avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0 END) AS b, 100*avg(CASE WHEN c IS NULL THEN 1.0 ELSE 0 END) AS c FROM {_HOLES}) s, LATERAL (VALUES ('a',a),('b',b),('c',c)) u(feature,missing))""")(
    lambda t: r.missing_bins(holes(t), ["a", "b", "c"]).withColumn("missing", F.round("missing", 6))
)
q("nan_unlabeled_cases", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id WHERE l.quality IS NULL")(lambda t: t("documents").select("doc_id").join(t("labels"), "doc_id", "left").filter("quality is null").select("doc_id"))
q("holdout_split", "SELECT CASE WHEN c_custkey%4=0 THEN 'holdout' ELSE 'discovery' END AS part, c_mktsegment, count(*) AS n FROM customer GROUP BY 1,2")(
    lambda t: t("customer").groupBy(F.when(F.col("c_custkey") % 4 == 0, "holdout").otherwise("discovery").alias("part"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
)
q("metadata_query", "SELECT p_partkey FROM part WHERE p_brand='Brand#2' AND contains(lower(p_type),'s') AND p_size IN (1,2,3,4,5,6,7,8,9)")(
    lambda t: r.query_index(t("part"), {"p_brand": "Brand#2"}, {"p_type": "s"}, {"p_size": range(1, 10)}).select("p_partkey")
)
q("metadata_unique", "SELECT * FROM nation WHERE n_nationkey=7")(lambda t: r.only(t("nation").filter("n_nationkey = 7")))
q("metadata_values", "SELECT DISTINCT p_type FROM part")(lambda t: t("part").select("p_type").distinct())
q("text_to_number", "SELECT p_partkey, try_cast(CASE WHEN p_partkey%5=0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS v FROM part")(
    lambda t: t("part").select("p_partkey", r.to_number(F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_size").cast("string"))).alias("v"))
)
q("nan_token_map", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN NULL ELSE c_mktsegment END AS seg FROM customer")(lambda t: t("customer").select("c_custkey", r.tokens_to_missing(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("seg")))
q("class_map_fit", "SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment)::INT AS class_id FROM (SELECT DISTINCT c_mktsegment FROM customer)")(lambda t: r.class_map(t("customer"), "c_mktsegment"))
q("class_map_apply", """SELECT o.o_orderkey, o.o_orderpriority, m.class_id::INT AS class_id, m.class_id IS NULL AS unseen FROM orders o LEFT JOIN
 (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS class_id FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority<>'1-URGENT')) m ON o.o_orderpriority=m.o_orderpriority""")(
    lambda t: r.apply_class_map(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", r.class_map(t("orders").filter("o_orderpriority <> '1-URGENT'"), "o_orderpriority"))
)
q("dummy_coding", "SELECT o_orderkey, (o_orderstatus='F')::INT AS o_orderstatus_F, (o_orderstatus='O')::INT AS o_orderstatus_O, (o_orderstatus='P')::INT AS o_orderstatus_P FROM orders")(lambda t: r.dummies(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "FOP").drop("o_orderstatus"))
q("dichotomise_one_vs_one", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS y FROM orders")(lambda t: t("orders").select("o_orderkey", r.dichotomise(F.col("o_orderstatus"), "F", "O").alias("y")))
q("dichotomise_one_vs_all", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END AS y FROM orders")(lambda t: t("orders").select("o_orderkey", r.dichotomise(F.col("o_orderstatus"), "F").alias("y")))
q("binarise_regression", "SELECT o_orderkey, CASE WHEN o_totalprice>=150000 THEN 1 ELSE -1 END AS y FROM orders")(lambda t: t("orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 150000, 1).otherwise(-1).alias("y")))
q("bind_columns", "SELECT c.c_custkey, c.c_acctbal, o.n FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey=o.o_custkey")(
    lambda t: t("customer").select("c_custkey", "c_acctbal").join(t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")), "c_custkey")
)
q("bind_rows", "SELECT c_acctbal AS bal FROM customer UNION ALL SELECT s_acctbal FROM supplier")(lambda t: t("customer").select(F.col("c_acctbal").alias("bal")).unionByName(t("supplier").select(F.col("s_acctbal").alias("bal"))))
q("parameter_grid", "SELECT a.c::DOUBLE AS cost, b.g::DOUBLE AS gamma, k.k AS kernel FROM (VALUES (0.5),(1.0),(2.0)) a(c), (VALUES (0.1),(1.0)) b(g), (VALUES ('linear'),('rbf')) k(k)")(
    lambda t: r.grid(t("region").sparkSession, {"cost": [0.5, 1.0, 2.0], "gamma": [0.1, 1.0], "kernel": ["linear", "rbf"]})
)
q("k_combinations", "SELECT a.n_nationkey AS c1, b.n_nationkey AS c2, c.n_nationkey AS c3 FROM nation a, nation b, nation c WHERE a.n_nationkey<b.n_nationkey AND b.n_nationkey<c.n_nationkey")(lambda t: r.combinations(t("nation"), "n_nationkey", 3))
q("sample_without_replacement")(lambda t: r.pick(t("orders").select("o_orderkey"), "o_orderkey", 100, 7))
q("sample_with_replacement")(lambda t: r.bootstrap(t("orders").select("o_orderkey"), "o_orderkey", 7))
_BINS = "least(floor((p_retailprice-lo)/(hi-lo)*5),4)"
q("equalise_histogram", f"""SELECT p_partkey, CAST(bin AS BIGINT) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY p_partkey) AS rn, (SELECT min(n) FROM (SELECT count(*) AS n FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY {_BINS})) AS m
 FROM (SELECT p_partkey, {_BINS} AS bin FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part))) WHERE rn<=m""")(lambda t: r.equalise(t("part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 5).select("p_partkey", "bin"))

# matching of case axes
_FIRST = "(SELECT o_custkey AS id, min_by(o_orderkey,o_orderkey) AS o_orderkey, min_by(o_totalprice,o_orderkey) AS o_totalprice FROM orders GROUP BY 1)"


def _match(act):
    return lambda t: r.id_match(t("orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice"), t("customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id", act, "o_orderkey")


q("id_match_intersect", f"SELECT c.c_custkey AS id, c.c_acctbal, s.o_orderkey, s.o_totalprice FROM customer c JOIN {_FIRST} s ON c.c_custkey=s.id")(_match("intersect"))
q("id_match_intersectnan", f"SELECT c.c_custkey AS id, c.c_acctbal, s.o_orderkey, s.o_totalprice FROM customer c LEFT JOIN {_FIRST} s ON c.c_custkey=s.id")(_match("intersectnan"))
q("id_match_src_not_dst", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: r.id_match(t("documents").select("doc_id"), t("labels").select("doc_id"), "doc_id", "src_not_dst"))
q("id_match_dst_not_src", "SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(_match("dst_not_src"))
q("id_match_substring", "SELECT DISTINCT p.p_type, n.n_name FROM (SELECT DISTINCT p_type FROM part) p, (SELECT DISTINCT substr(p_type,1,5) AS n_name FROM part) n WHERE length(p_type)>=4 AND length(n_name)>=4 AND (contains(p.p_type,n.n_name) OR contains(n.n_name,p.p_type))")(
    lambda t: r.substring_match(t("part").select("p_type").distinct(), t("part").select(F.substring("p_type", 1, 5).alias("n_name")).distinct(), "p_type", "n_name")
)
q("axis_integrity", """SELECT sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS shared, sum(CASE WHEN b IS NULL THEN 1 ELSE 0 END)::BIGINT AS left_only, sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END)::BIGINT AS right_only, sum(CASE WHEN a<>b THEN 1 ELSE 0 END)::BIGINT AS displaced
 FROM (SELECT doc_id, doc_id AS a FROM documents) x FULL JOIN (SELECT doc_id, doc_id+quality AS b FROM labels) y USING (doc_id)""")(lambda t: r.axis_check(t("documents").select("doc_id", F.col("doc_id").alias("pos")), t("labels").select("doc_id", (F.col("doc_id") + F.col("quality")).alias("pos")), "doc_id", "pos"))
q("axis_remap", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id")(lambda t: r.restore(t("documents"), t("labels").select("doc_id", "quality"), "doc_id"))
q("axis_union", "SELECT coalesce(c.k,s.k) AS k, c.c_acctbal, s.s_acctbal FROM (SELECT c_custkey AS k, c_acctbal FROM customer) c FULL JOIN (SELECT s_suppkey AS k, s_acctbal FROM supplier) s ON c.k=s.k")(
    lambda t: t("customer").select(F.col("c_custkey").alias("k"), "c_acctbal").join(t("supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal"), "k", "full")
)
q("modal_fusion", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id=l.doc_id")(lambda t: t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id"))
q("group_intersection", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")(lambda t: t("customer").select("c_custkey").join(t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"))
_DIST = "(SELECT q.vec_id AS q, b.vec_id AS b, sqrt(list_sum(list_transform(range(1,65), lambda i: pow(q.embedding[i]::DOUBLE-b.embedding[i]::DOUBLE,2)))) AS d, b.label FROM embeddings q, embeddings b WHERE q.vec_id%50=0 AND b.vec_id<>q.vec_id)"
q("knn_search", f"SELECT q, b, round(d,5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS rn FROM {_DIST}) WHERE rn<=5")(
    lambda t: neighbours.search(t("embeddings"), t("embeddings").filter("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("q", "b", F.round("d", 5).alias("d"))
)
q("knn_class_vote", f"""SELECT q, label FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, b) AS rk FROM {_DIST}) WHERE rk<=7 GROUP BY q, label) WHERE rn=1""")(
    lambda t: neighbours.vote(t("embeddings"), t("embeddings").filter("vec_id % 50 = 0"), "vec_id", "embedding", "label", 7)
)
q("pairwise_euclidean", f"SELECT q, b, round(d,5) AS d FROM {_DIST}")(lambda t: neighbours.distances(t("embeddings"), t("embeddings").filter("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("d", F.round("d", 5)))
q("assignment")(lambda t: neighbours.assign_nearest(t("embeddings"), t("embeddings").filter("vec_id % 50 = 0"), "vec_id", "embedding"))

# sets, strings, formats
q("set_subset_flag", "SELECT n_nationkey, n_nationkey IN (1,2,30) AS inside FROM nation")(lambda t: t("nation").select("n_nationkey", F.col("n_nationkey").isin(1, 2, 30).alias("inside")))
q("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda t: t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey")))
q("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(lambda t: t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct())
q("set_symmetric_difference", "(SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT p_size FROM part)")(
    lambda t: (lambda a, b: a.subtract(b).unionAll(b.subtract(a)))(t("part").select(F.col("p_size").alias("k")), t("nation").select(F.col("n_nationkey").alias("k")))
)
q("string_split", "SELECT p_partkey, string_split(p_type,' ')[1] AS head, len(string_split(p_type,' '))::INT AS n FROM part")(lambda t: t("part").select("p_partkey", F.split("p_type", " ")[0].alias("head"), F.size(F.split("p_type", " ")).alias("n")))
q("string_clean", "SELECT p_partkey, regexp_replace(p_brand,'[#,]','','g') AS brand FROM part")(lambda t: t("part").select("p_partkey", F.regexp_replace("p_brand", "[#,]", "").alias("brand")))
q("string_extract_id", "SELECT c_custkey, regexp_extract(c_name,'([0-9]+)',1) AS id FROM customer")(lambda t: t("customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).alias("id")))
q("path_parts", "SELECT page_id, regexp_extract(url,'^(.*/)',1) AS dir, regexp_extract(url,'([^/]*)$',1) AS name FROM pages")(lambda t: t("pages").select("page_id", F.regexp_extract("url", "^(.*/)", 1).alias("dir"), F.regexp_extract("url", "([^/]*)$", 1).alias("name")))
q("format_numbers", "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey) AS list FROM nation GROUP BY 1")(lambda t: t("nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string")), ", ").alias("list")))
q("parameter_string", "SELECT p_partkey, concat_ws('_',p_brand,p_size::VARCHAR) AS s FROM part")(lambda t: t("part").select("p_partkey", F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("s")))
q("time_stamp", "SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M') AS stamp FROM events")(lambda t: t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("stamp")))
q("struct_flatten", "SELECT n_nationkey, n_name FROM nation")(lambda t: t("nation").select(F.struct("n_nationkey", "n_name").alias("s")).select("s.*"))
q("map_merge", "SELECT n_nationkey, n_regionkey AS a, n_nationkey AS b FROM nation")(
    lambda t: t("nation").select("n_nationkey", F.map_from_entries(F.map_entries(F.map_zip_with(F.create_map(F.lit("a"), F.lit(-1), F.lit("b"), F.col("n_nationkey")), F.create_map(F.lit("a"), F.col("n_regionkey")), lambda k, x, y: F.coalesce(y, x)))).alias("m")).select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))
)
q("struct_compare", "SELECT c.c_custkey, c.c_nationkey IS DISTINCT FROM s.s_nationkey AS nation_differs, c.c_acctbal IS DISTINCT FROM s.s_acctbal AS bal_differs FROM customer c JOIN supplier s ON c.c_custkey=s.s_suppkey")(
    lambda t: t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", (~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey"))).alias("nation_differs"), (~F.col("c_acctbal").eqNullSafe(F.col("s_acctbal"))).alias("bal_differs"))
)
q("struct_find", "SELECT conv_id, count(*) AS n FROM conversations WHERE role='user' GROUP BY 1")(
    lambda t: t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns")).select("conv_id", F.size(F.filter("turns", lambda x: x["role"] == "user")).cast("long").alias("n")).filter("n > 0")
)
q("json_decode", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")(lambda t: t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
q("nan_triplet_round_trip", "SELECT p_partkey, CASE WHEN p_partkey%4=0 THEN 'missing' WHEN p_partkey%4=1 THEN 'large' ELSE 'number' END AS kind FROM part")(
    lambda t: t("part").select("p_partkey", r.unpack_nan(r.pack_nan(F.when(F.col("p_partkey") % 4 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("p_retailprice")))).alias("v")).select("p_partkey", F.when(F.isnan("v"), "missing").when(F.col("v") == float("inf"), "large").otherwise("number").alias("kind"))
)
q("duplicate_names", "SELECT p_partkey, CASE WHEN rn=1 THEN p_type ELSE p_type||'_'||rn::VARCHAR END AS name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part)")(lambda t: r.number_repeats(t("part").select("p_partkey", "p_type"), "p_type", "p_partkey", "name").select("p_partkey", "name"))
q("unique_rows", "SELECT DISTINCT p_brand, p_size FROM part")(lambda t: t("part").select("p_brand", "p_size").dropDuplicates())
