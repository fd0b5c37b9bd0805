"""N-gram Jaccard join by a prefix tree over globally ordered n-gram sets.

A text's set holds its distinct `n`-word shingles, A-Z lower-cased, as 48-bit hashes. Documents of equal sets form
a class; classes are joined, copies are not expanded into pairs.

1. Order: one order of all shingles for all sets: those of one document, those of a few, those not counted, those of many.
   Occurrences are counted over all documents, for the lowest ORDER_SHARE of hash values; filters mark what occurs
   again, and often. Any order is right, this one keeps groups small: a shingle that no filter marks although it was
   counted is in one document only, links nothing, and is sent nowhere.
2. Two sets as alike as the threshold share one of their first size - ceil(threshold * size) + 1 shingles, and what can match
   before and behind it is enough. These prefixes are dealt out by shingle; of the classes that share one and fit, a task sends on
   which hang together. A shingle of more than STAR classes makes a chain of them by size, cut where sizes no longer fit.
   So each link lies inside a group, and no pair is sent.
3. The whole sets of a group meet in a prefix tree, walked once with all of the group as probes (prefix_trie.py): the walk carries
   partial overlaps down shared paths and cuts subtrees by what their longest path has left. It gives each class the number of its
   links and the least class that it reaches. Small groups share a tree, a group of more than BLOCK classes is split into
   blocks, and a tree of one block is walked with each other block.
4. Components are those of the links found.

Links are counted inside a group of copies that all differ, so that the time for such a group grows with its square; rows made grow
with classes times blocks.

A text with fewer words than `n` has one shingle, all its words; a text without words (or null) has none and links with nothing. Texts of
any length are read whole. A null id counts as greater than all others. Rows that share an id go each by its own text. An empty
table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import filters
from .common import U64, buckets_for, give_back, mix, release, table, text_chunks, word_hashes
from .components import components
from .prefix_trie import Sets, joined, least_overlap, least_size, spanning
from .substring_dedup import _by_bucket, _from_six, _six

NO_ID = 2**63 - 1
ORDER_SHARE, FREQUENT, STAR, BLOCK = 0.3, 50, 32, 4096
PER_BUCKET, TREE = 4 << 20, 1 << 20  # shingles that meet in a task when counted or dealt out, and in a tree
MASK = U64((1 << 48) - 1)
_PLACE = mix(np.arange(11, 75, dtype=U64)) | U64(1)


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of each distinct shingle, sorted by row, then hash."""
    h, row = word_hashes(data, offs)
    rows = len(offs) - 1
    parts, where = [], []
    if len(h) >= n:
        s = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            s += h[k : len(h) - n + 1 + k] * _PLACE[k % 64]
        inside = row[: len(s)] == row[n - 1 :]
        parts.append(mix(s[inside]))
        where.append(row[: len(s)][inside])
    count = np.bincount(row, minlength=rows)
    short = (count < n)[row]
    if short.any():
        r, first = row[short], np.cumsum(count) - count
        at = np.flatnonzero(short) - first[r]
        total = np.zeros(rows, U64)
        np.add.at(total, r, h[short] * _PLACE[at % 64])
        some = np.flatnonzero((count > 0) & (count < n))
        parts.append(mix(total[some] + count[some].astype(U64) * _PLACE[63]))
        where.append(some)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    key = np.sort((np.concatenate(where).astype(U64) << U64(48)) | (np.concatenate(parts) & MASK))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> U64(48)).astype(np.int64), key & MASK


def _sizes(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set, and its class: a hash of the set."""
    size, a = np.bincount(row, minlength=rows), np.zeros(rows, U64)
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        a[row[at]] = np.add.reduceat(mix(token + U64(0x632BE59BD9B4E019)), at)
    return size, mix(a + size.astype(U64) * _PLACE[62]).view(np.int64)


def frequent(texts: DataFrame, n: int, buckets: int) -> tuple[filters.Filter, filters.Filter]:
    """Filters of the shingles that two documents hold or more, and more than FREQUENT; for the lowest ORDER_SHARE of hash values.

    Equal sets count once in a chunk of texts.
    """
    top = U64(int(ORDER_SHARE * (1 << 48)))

    def count(batches):
        for _, data, offs in text_chunks(batches, "text"):
            row, token = shingles(data, offs, n)
            _, cls = _sizes(row, token, len(offs) - 1)
            only = np.zeros(len(cls), bool)
            only[np.unique(cls, return_index=True)[1]] = True
            token, times = np.unique(token[(token < top) & only[row]], return_counts=True)
            found = list(_by_bucket(((token >> U64(8)) % U64(buckets)).astype(np.int64), buckets))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([_six(token[i]) for _, i in found], pa.binary()), pa.array([np.minimum(times[i], 255).astype(np.uint8).tobytes() for _, i in found], pa.binary())], names=["bucket", "tokens", "times"])

    def total(key, group):
        token, times = _from_six(b"".join(group.column("tokens").to_pylist())), np.frombuffer(b"".join(group.column("times").to_pylist()), np.uint8)
        order = np.argsort(token, kind="stable")
        token = token[order]
        g = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        n_docs = np.add.reduceat(times[order].astype(np.int64), g)
        parts = [filters.slabs(token[g][n_docs > most]) for most in (1, FREQUENT)]
        give_back()
        return pa.table({"level": pa.array([k for k, p in enumerate(parts) for _ in p[0]], pa.int32()), "slab": pa.array([x for p in parts for x in p[0]], pa.int32()), "slots": pa.array([x for p in parts for x in p[1]], pa.binary())})

    found = table(texts.mapInArrow(count, "bucket int, tokens binary, times binary").groupBy("bucket").applyInArrow(total, "level int, slab int, slots binary"), "shingle-counts")
    both = tuple(filters.build(found.filter(F.col("level") == k).select("slab", "slots")) for k in (0, 1))
    release(found)
    return both


def hang_together(token: np.ndarray, cls: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int, star: int = STAR) -> tuple[np.ndarray, np.ndarray]:
    """Classes that a shared prefix shingle ties together, each with the least of its group here.

    Rows are (token, class, size of its set, place of the token in it).
    """
    order = np.lexsort((cls, size, token))
    token, cls, size, pos = (x[order] for x in (token, cls, size, pos))
    new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])] if len(token) else np.zeros(0, bool)
    token, cls, size, pos = token[new], cls[new], size[new], pos[new]
    g = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    many = np.diff(g, append=len(token))
    n = np.repeat(many, many)
    left, right = [], []
    for d in range(1, min(star, int(many.max(initial=0)))):
        i = np.flatnonzero((token[:-d] == token[d:]) & (n[:-d] <= star))
        i = i[_fits(size[i], size[i + d], pos[i], pos[i + d], percent)]
        left.append(cls[i])
        right.append(cls[i + d])
    # sorted by size: two that fit have only such between them as fit their neighbours
    i = np.flatnonzero((token[:-1] == token[1:]) & (n[:-1] > star))
    i = i[size[i] >= least_size(size[i + 1], percent)]
    left.append(cls[i])
    right.append(cls[i + 1])
    return spanning(np.concatenate(left), np.concatenate(right))


def _fits(na, nb, pa_, pb, percent):
    """Sizes, and what can match up to and behind a common shingle at places pa_ and pb, leave the threshold within reach."""
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return (np.minimum(na, nb) >= least_size(np.maximum(na, nb), percent)) & (most >= least_overlap(na, nb, percent))


def _sets(group: pa.Table, rows: np.ndarray, names: np.ndarray, token: np.ndarray, edge: np.ndarray, root: np.ndarray) -> Sets:
    n = np.diff(edge)[rows]
    which = np.repeat(edge[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return Sets(root[rows], group.column("size").to_numpy()[rows].astype(np.int64), token[which], np.r_[0, np.cumsum(n)])


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", star: int = STAR, block: int = BLOCK, per_tree: int = TREE) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, n_links (links of its class to other classes), text_hash of every document."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(id_col).isNull().alias("void"))

    def measure(batches):
        for rows, data, offs in text_chunks(batches, "text"):
            row, token = shingles(data, offs, n)
            size, cls = _sizes(row, token, len(rows))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(size.astype(np.int64)), pa.array(cls)], names=["k", "t", "void", "size", "cls"])

    sets = table(texts.mapInArrow(measure, "k long, t long, void boolean, size long, cls long"), "set-sizes")
    info = sets.filter("size > 0").groupBy("cls").agg(F.min(F.struct("k", "void")).alias("least"))
    buckets = buckets_for(docs, sets.agg(F.sum("size").alias("n")).first()["n"] or 0, PER_BUCKET)
    (again, often), top = frequent(texts, n, buckets), U64(int(ORDER_SHARE * (1 << 48)))

    def ranks(token: np.ndarray) -> np.ndarray:
        """3: many documents hold it, 2: not counted, 1: some do, 0: one does."""
        out = np.full(len(token), 2, np.int64)
        i = np.flatnonzero(token < top)
        out[i] = np.where(often.has(token[i]), 3, again.has(token[i]))
        return out

    def prefixes(batches):
        for _, data, offs in text_chunks(batches, "text"):
            row, token = shingles(data, offs, n)
            size, cls = _sizes(row, token, len(offs) - 1)
            _, first = np.unique(cls, return_index=True)
            only = np.zeros(len(size), bool)
            only[first] = True
            keep = only[row]
            row, token = row[keep], token[keep]
            key = np.sort((row.astype(U64) << U64(50)) | (ranks(token).astype(U64) << U64(48)) | token)
            row, rank, token = (key >> U64(50)).astype(np.int64), (key >> U64(48)) & U64(3), key & MASK
            kept = np.where(only, size, 0)
            pos = np.arange(len(row)) - (np.cumsum(kept) - kept)[row]
            i = np.flatnonzero((pos < size[row] - least_size(size[row], percent) + 1) & (rank > 0))
            row, token, pos = row[i], token[i], pos[i]
            found = list(_by_bucket(((token >> U64(8)) % U64(buckets)).astype(np.int64), buckets))
            packed = [np.rec.fromarrays([token[j].astype("<u8"), cls[row[j]], size[row[j]].astype("<i4"), pos[j].astype("<i4")]).tobytes() for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "rows"])

    def ties(key, group):
        x = np.frombuffer(b"".join(group.column("rows").to_pylist()), np.dtype([("t", "<u8"), ("c", "<i8"), ("n", "<i4"), ("p", "<i4")]))
        a, b = hang_together(x["t"].astype(U64), x["c"].astype(np.int64), x["n"].astype(np.int64), x["p"].astype(np.int64), percent, star)
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    groups = components(texts.mapInArrow(prefixes, "bucket int, rows binary").groupBy("bucket").applyInArrow(ties, "a long, b long"))
    grouped = table(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")).join(info.select("cls", F.col("least.k").alias("k")), "cls"), "groups")
    wanted = filters.of_values(grouped.select(F.expr("cls ^ k")))

    def whole(batches):
        """The documents that stand for grouped classes (some more may pass): shingles in the order of the walk, without those of one document."""
        for rows, data, offs in text_chunks(batches, "text"):
            row, token = shingles(data, offs, n)
            size, cls = _sizes(row, token, len(offs) - 1)
            k = rows.column(0).to_numpy()
            use = wanted.has((cls ^ k).view(U64)) & (size > 0)
            row, token = row[use[row]], token[use[row]]
            rank = ranks(token)
            row, token, rank = row[rank > 0], token[rank > 0], rank[rank > 0]
            key = np.sort((row.astype(U64) << U64(50)) | ((3 - rank).astype(U64) << U64(48)) | token)
            row, rank, token = (key >> U64(50)).astype(np.int64), ((key >> U64(48)) & U64(3)).astype(np.int64), key & MASK
            edge = np.searchsorted(row, np.arange(len(offs)))
            some = np.flatnonzero(use)
            ends = [np.searchsorted(row * 4 + rank, some * 4 + r) - edge[some] for r in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(k[some]), pa.array(size[some].astype(np.int64)), *(pa.array(e, pa.int64()) for e in ends), pa.array([_six(token[edge[x] : edge[x + 1]]) for x in some], pa.binary())], names=["cls", "k", "size", "often", "unknown", "tokens"])

    members = table(texts.mapInArrow(whole, "cls long, k long, size long, often long, unknown long, tokens binary").join(grouped, ["cls", "k"]).dropDuplicates(["cls"]).drop("k"), "members")
    for f in (again, often, wanted):
        f.drop()
    total = members.agg(F.sum(F.length("tokens") / 6).cast("long").alias("n")).first()["n"] or 0
    trees = buckets_for(docs, total, per_tree)
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("tokens")) / (6 * 4 * per_tree))).cast("int").alias("blocks"))
    large = members.join(sizes.filter("blocks > 1"), "grp")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    spread = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    small = members.join(sizes.filter("blocks = 1"), "grp").select("grp", *(c for c in members.columns if c != "grp"), F.lit(-1).alias("own"), F.pmod(F.xxhash64("grp"), F.lit(trees)).cast("int").alias("i"), F.lit(-1).alias("j"))
    dealt = small.withColumn("tree", F.lit(None).cast("long")).unionByName(spread.withColumn("tree", F.col("grp")))

    def meet(key, group):
        """cls, its links here, the least class it reaches here."""
        i, j = key[1].as_py(), key[2].as_py()
        cls, root = group.column("cls").to_numpy(), np.unique(group.column("grp").to_numpy(), return_inverse=True)[1]
        raw = group.column("tokens").to_pylist()
        n = np.array([len(x) // 6 for x in raw])
        edge = np.r_[0, np.cumsum(n)]
        place = np.arange(edge[-1]) - np.repeat(edge[:-1], n)
        order = (place >= np.repeat(group.column("often").to_numpy(), n)).astype(U64) + (place >= np.repeat(group.column("unknown").to_numpy(), n)).astype(U64)
        names, token = np.unique((order << U64(48)) | _from_six(b"".join(raw)), return_inverse=True)
        own = group.column("own").to_numpy()
        first, second = np.flatnonzero(own == i) if j >= 0 else np.arange(len(cls)), np.flatnonzero(own == j) if j > i else None
        links, label = joined(_sets(group, first, names, token, edge, root), None if second is None else _sets(group, second, names, token, edge, root), percent)
        cls = cls[first if second is None else np.r_[first, second]]
        some = np.flatnonzero(links)
        give_back()
        return pa.table({"cls": pa.array(cls[some], pa.int64()), "n_links": pa.array(links[some], pa.int64()), "reach": pa.array(cls[label[some]], pa.int64())})

    links = table(dealt.groupBy("tree", "i", "j").applyInArrow(meet, "cls long, n_links long, reach long"), "links")
    found = components(links.select(F.col("cls").alias("a"), F.col("reach").alias("b")))
    degree = links.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    labels = info.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = labels.groupBy("root").agg(F.min("least").alias("of"))
    by_class = labels.join(least, "root").join(degree, "cls", "left").select("cls", "least", "of", "n_links")
    out = sets.join(by_class, "cls", "left")
    own_id = F.struct("k", "void")
    id_of = lambda c, name: F.when(~c["void"], c["k"]).alias(name)
    return out.select(
        id_of(own_id, "doc_id"), F.col("size").alias("n_shingles"), id_of(F.coalesce("least", own_id), "class_id"), id_of(F.coalesce("of", own_id), "component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("t").alias("text_hash"),
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a smaller id, or an equal row (id and text), in their component; columns stay, whatever their names.

    Texts without words are in no component and all stay. Only rows that a filter holds to have such a partner are shuffled, to
    be told for certain.
    """
    found = table(join(docs, n, percent, id_col, text_col).filter("n_shingles > 0"), "near-duplicates")
    rows = found.groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("times"))
    doubtful = rows.filter("not (doc_id <=> component_id) or times > 1")
    held = filters.of_values(doubtful.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k")))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def mark(batches):
        for b in batches:
            yield b.append_column("doubt", pa.array(held.has(b.column(0).to_numpy().astype(U64))))

    marked = keyed.mapInArrow(mark, StructType([*keyed.schema, StructField("doubt", BooleanType())]))
    sure = marked.filter("not doubt").select("row.*")
    told = doubtful.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k"), F.col("text_hash").alias("t"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays"))
    rest = marked.filter("doubt").join(told, ["k", "t"], "left").filter("stays is null or stays")
    first = F.row_number().over(Window.partitionBy("k", "t").orderBy("k"))
    return sure.unionByName(rest.withColumn("nth", first).filter("nth = 1 or stays is null").select("row.*"))
