"""Rows, columns, keys: selection, matching of case axes, combination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_row(df: DataFrame, key: str, value, row: dict) -> DataFrame:
    """Overwrites the columns in `row` where key equals value."""
    return df.withColumns({c: F.when(F.col(key) == value, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in row.items()})


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that one lacks is missing there."""
    return a.unionByName(b, allowMissingColumns=True)


def match_row(df: DataFrame, row: dict) -> DataFrame:
    """Rows equal to `row` in its columns, missing equal to missing."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in row.items())))


def prune(df: DataFrame, columns: Sequence[str], how: str = "all") -> DataFrame:
    """Drops rows with all (or any) of the columns missing."""
    return df.dropna(how=how, subset=list(columns))


def restore(axis: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Puts pruned rows back on the axis, with missing values."""
    return axis.select(key).join(df, key, "left")


def missing_bins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values of each column in percent, and the bin: 0, <=25, <=50, <100, 100."""
    one = df.agg(*((100 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns))
    long = one.unpivot([], list(columns), "feature", "missing")
    x = F.col("missing")
    return long.withColumn("bin", F.when(x == 0, "none").when(x <= 25, "to 25").when(x <= 50, "to 50").when(x < 100, "to 99").otherwise("all"))


def tokens_to_missing(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~F.trim(c).isin(list(tokens)), c)


def to_number(c: Column) -> Column:
    """NULL where a text is no number."""
    return c.try_cast("double")


def dummies(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in levels})


def dichotomise(label: Column, positive, negative=None) -> Column:
    """1 and -1 for a pair of classes (0: neither), or one class against all others."""
    other = label != positive if negative is None else label == negative
    return F.when(label == positive, 1).when(other, -1).otherwise(0)


def class_map(df: DataFrame, label: str) -> DataFrame:
    """label, class_id: sorted values numbered from 1; a few rows."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("class_id", F.row_number().over(Window.orderBy(label)))


def apply_class_map(df: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """class_id of the training map; `unseen` marks labels that it lacks. No class is ever added."""
    return df.join(known, label, "left").withColumn("unseen", F.col(label).isNotNull() & F.col("class_id").isNull())


def id_match(source: DataFrame, target: DataFrame, key: str, act: str = "intersect", order: str | None = None) -> DataFrame:
    """Matches cases by trimmed key.

    intersect: target rows with the first source row (by `order`) of their key. intersectnan: all target rows, missing where there is none.
    src_not_dst, dst_not_src: rows of one side that the other lacks.
    """
    trim = lambda df: df.withColumn("_k", F.trim(F.col(key).cast("string")))
    s, t = trim(source), trim(target)
    if act == "src_not_dst":
        return s.join(t.select("_k"), "_k", "left_anti").drop("_k")
    if act == "dst_not_src":
        return t.join(s.select("_k"), "_k", "left_anti").drop("_k")
    first = s.groupBy("_k").agg(F.min_by(F.struct(*(c for c in source.columns if c != key)), F.col(order or key)).alias("_s"))
    how = {"intersect": "inner", "intersectnan": "left"}[act]
    return t.join(first, "_k", how).select(*target.columns, *(F.col("_s")[c].alias(c) for c in source.columns if c != key))


def substring_match(a: DataFrame, b: DataFrame, left: str, right: str, gram: int = 4) -> DataFrame:
    """Pairs where one text holds the other, either way; texts of `gram` characters or more.

    The shorter text's first characters are looked up among all those of the longer one, so candidates come from
    an equi-join and are then checked.
    """

    def inside(x: DataFrame, y: DataFrame, short: str, long: str) -> DataFrame:
        s = x.filter(F.length(short) >= gram).withColumn("_g", F.substring(short, 1, gram))
        n = F.length(long)
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - gram + 1, F.lit(1))), lambda i: F.substr(F.col(long), i, F.lit(gram))))
        return s.join(y.filter(n >= gram).withColumn("_g", F.explode(grams)), "_g").filter(F.expr(f"instr(`{long}`, `{short}`) > 0")).drop("_g")

    cols = [*a.columns, *b.columns]
    return inside(a, b, left, right).select(*cols).union(inside(b, a, right, left).select(*cols)).distinct()


def axis_check(a: DataFrame, b: DataFrame, key: str, position: str) -> DataFrame:
    """Counts of shared, left-only, right-only and displaced cases."""
    x, y = a.select(key, F.col(position).alias("_a")), b.select(key, F.col(position).alias("_b"))
    j = x.join(y, key, "full")
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), n(F.col("_b").isNull()).alias("left_only"), n(F.col("_a").isNull()).alias("right_only"), n(F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))).alias("displaced"))


def combinations(df: DataFrame, column: str, k: int) -> DataFrame:
    """All k-subsets of a column's distinct values, c1 < c2 < ...; the result is what is asked for, of size n over k."""
    one = df.select(column).distinct()
    out = one.select(F.col(column).alias("c1"))
    for i in range(2, k + 1):
        out = out.join(one.select(F.col(column).alias(f"c{i}")), F.col(f"c{i}") > F.col(f"c{i - 1}"))
    return out


def grid(spark, values: dict[str, Sequence]) -> DataFrame:
    """All combinations of parameter lists, numbered; its size is the product of theirs."""
    arrays = [F.array(*(F.lit(v) for v in vs)) for vs in values.values()]
    df = spark.range(1)
    for name, a in zip(values, arrays, strict=True):
        df = df.withColumn(name, F.explode(a))
    return df.drop("id")


def pick(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by hash of the id; the same ones at any parallelism."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), row_id)).orderBy("_h", row_id).limit(n).drop("_h")


def bootstrap(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """Rows with replacement: each drawn Poisson(1) times, from a uniform number hashed from its id."""
    u = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(1 << 40)) / float(1 << 40)
    e = 2.718281828459045
    cuts, p, total = [], 1 / e, 0.0
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    times = sum((u >= c).cast("int") for c in cuts)
    return df.withColumn("_n", times).withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))))).filter("_n > 0").drop("_n", "_i")


def equalise(df: DataFrame, value: str, row_id: str, bins: int, seed: int | None = None) -> DataFrame:
    """Cuts every equal-width bin of a value to the size of the smallest filled one; rows by hash of id (seed) or by id. Missing values are left out."""
    df = df.filter(F.col(value).isNotNull())
    r = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.least(F.coalesce(F.floor((F.col(value) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1))
    x = df.join(F.broadcast(r), F.lit(True)).withColumn("bin", b)  # one row
    least = x.groupBy("bin").count().agg(F.min("count").alias("_m"))
    order = F.col(row_id) if seed is None else F.xxhash64(F.lit(seed), row_id)
    return x.withColumn("_r", F.row_number().over(Window.partitionBy("bin").orderBy(order, row_id))).join(F.broadcast(least), F.lit(True)).filter("_r <= _m").drop("_r", "_m", "_lo", "_hi")


def number_repeats(df: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """Adds _2, _3, ... to repeated texts, in order."""
    n = F.row_number().over(Window.partitionBy(value).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(value)).otherwise(F.concat_ws("_", F.col(value), n.cast("string"))))


def unpack_nan(c: Column) -> Column:
    """Numbers from texts that carry NaN and infinities by name."""
    return F.when(c == "NaN", F.lit(float("nan"))).when(c == "Inf", F.lit(float("inf"))).when(c == "-Inf", F.lit(float("-inf"))).otherwise(c.try_cast("double"))


def pack_nan(c: Column) -> Column:
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "Inf").when(c == float("-inf"), "-Inf").otherwise(c.cast("string"))


def query_index(df: DataFrame, equal: dict | None = None, contains: dict | None = None, one_of: dict | None = None) -> DataFrame:
    """Rows that meet all conditions: equal values, texts that contain, values in a list."""
    conds = [F.col(k).eqNullSafe(F.lit(v)) for k, v in (equal or {}).items()] + [F.contains(F.lower(k), F.lit(v.lower())) for k, v in (contains or {}).items()] + [F.col(k).isin(list(v)) for k, v in (one_of or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, conds, F.lit(True)))


def only(df: DataFrame) -> DataFrame:
    """The one row there is; an error at run time for more or none."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return df.limit(2).withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, "not exactly one match").isNull()).drop("_n")
