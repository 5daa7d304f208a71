"""Embedding near-duplicates by NN-descent.

Equal vectors form a class first.  Neighbour lists of ``k`` entries start from
random-projection buckets (sign patterns of as many bits as keep buckets small,
in several tables); then neighbours of neighbours are joined, round by round,
until no list changes.  Links are the list entries at or above the threshold.
A list that is full of links is saturated and is enlarged, by joins of its
neighbours' lists, to twice its length and again up to ``ENLARGED`` times.  Vectors
whose lists are full even then are searched exactly against all rows: balls of
them cover each component, the triangle inequality of angles leaves few rows
outside it that can link into a ball, and links so found unite components.  All
members of a component with such lists are then compared, block against block,
so every link is counted while pairs never become rows.  The final links and components are audited against
brute force on query vectors, by the average recall of a query, apart for
components with saturated lists and for all other rows; below the target, more
tables are added and the search repeated, and at the last step all rows are
compared with all rows.

Bounds: blocks hold about ``BLOCK`` vectors (``WIDE`` where links are counted); only entries within ``margin`` of
the threshold are kept in lists; reverse neighbours joined in one round are at
most ``k`` per vector (saturated lists are completed exactly, as above); the
audit has ``AUDIT`` query vectors in components with saturated lists and
``8 * AUDIT`` elsewhere (all, if there are fewer), which run against all rows; at most ``CHUNK`` vectors
are sent to the executors at once.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing and are kept; vectors of different
length never link; repeated rows link with each other; a row without an id is
returned with what its vector has; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, materialize

THRESHOLD, K, TABLES, MOST_TABLES, BLOCK, WIDE, ENLARGED, AUDIT, CHUNK = 0.95, 10, 16, 128, 512, 4096, 4, 256, 8192


def _matrix(lists) -> np.ndarray:
    """Vectors of equal length as doubles."""
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


def _signatures(tables: int, bits: int, seed: int):
    """(cid, table, key, dim): the sign pattern of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = _matrix(batch.column(1).take(pa.array(at)))
                planes = np.random.default_rng(seed + int(dim)).normal(size=(int(dim), tables * bits))
                on = (x @ planes > 0).reshape(len(at), tables, bits)
                key = (on * (1 << np.arange(bits))).sum(axis=2)
                cid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[at], tables)
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.tile(np.arange(tables), len(at))), pa.array(key.ravel()), pa.array(np.full(len(cid), dim, dtype=np.int64))], ["cid", "table", "key", "dim"])

    return run


def _block_lists(k: int, floor: float):
    """Blocks (arrays of cid and vector) to each member's best k others above the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                ids = members.values.field("cid").to_numpy(zero_copy_only=False)
                vecs = members.values.field("vec")
                sizes = np.asarray(vecs.value_lengths())
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    cos = _cosine(x := _matrix(vecs.take(pa.array(at))), x)
                    np.fill_diagonal(cos, -2)
                    n = len(at)
                    if n > k + 1:
                        best = np.argpartition(-cos, k, axis=1)[:, :k]
                    else:
                        best = np.tile(np.arange(n), (n, 1))
                    u, v = np.repeat(np.arange(n), best.shape[1]), best.ravel()
                    ok = cos[u, v] >= floor
                    u, v = u[ok], v[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[u]]), pa.array(ids[at[v]]), pa.array(cos[u, v])], ["u", "v", "cos"])

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best entries of each list."""
    once = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    top = once.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), "v"))), 1, k).alias("top"))
    return top.select("u", F.explode("top").alias("t")).select("u", "t.v", (-F.col("t.d")).alias("cos"))


def _around(lists: DataFrame, k: int) -> DataFrame:
    """(c, cid): each vector with the vectors of its list and at most ``k`` whose lists it is in, one of each hash bucket."""
    h = F.xxhash64("u", "v")
    back = lists.groupBy(F.col("v").alias("c"), F.pmod(h, F.lit(k)).alias("b")).agg(F.min(F.struct(h.alias("h"), "u")).alias("r")).select("c", F.col("r.u").alias("cid"))
    own = lists.select(F.col("u").alias("c"), F.col("v").alias("cid")).unionAll(lists.select(F.col("u").alias("c"), F.col("u").alias("cid")))
    return own.unionAll(back).distinct()


def neighbour_lists(vectors: DataFrame, n: int, k: int, floor: float, tables: int) -> DataFrame:
    """(u, v, cos): neighbour lists of the vectors (cid, vec)."""
    bits = min(40, max(2, round(math.log2(max(n, 1) / 128)) if n > 512 else 2))
    keys = materialize(vectors.mapInArrow(_signatures(tables, bits, 17), "cid long, table long, key long, dim long"), "keys")
    size = materialize(keys.groupBy("table", "key", "dim").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    placed = keys.join(size, ["table", "key", "dim"]).withColumn("block", F.pmod(F.xxhash64("cid", "table"), F.ceil(F.col("n") / BLOCK)))
    groups = placed.join(vectors, "cid").groupBy("table", "key", "dim", "block").agg(F.collect_list(F.struct("cid", "vec")).alias("m")).select("m")
    lists = materialize(_best(groups.mapInArrow(_block_lists(k, floor), "u long, v long, cos double"), k), "lists")
    before = None
    while True:
        mark = lists.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        local = _around(lists, k).join(vectors, "cid").groupBy("c").agg(F.collect_list(F.struct("cid", "vec")).alias("m")).select("m")
        found = local.mapInArrow(_block_lists(k, floor), "u long, v long, cos double")
        lists, old = materialize(_best(lists.unionAll(found), k), "lists"), lists
        discard(old)
    return lists


def saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u): vectors with at least ``k`` links in their list."""
    return lists.filter(F.col("cos") >= threshold).groupBy("u").agg(F.count("*").alias("c")).filter(F.col("c") >= k).select("u")


def enlarge(lists: DataFrame, vectors: DataFrame, k: int, floor: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(lists, full): saturated lists made longer, and the vectors whose lists are full at the greatest length."""
    most = k * ENLARGED
    full = materialize(saturated(lists, k, threshold), "full")
    while k < most and full.first():
        k *= 2
        local = _around(lists.join(full, "u", "left_semi"), k).join(vectors, "cid").groupBy("c").agg(F.collect_list(F.struct("cid", "vec")).alias("m")).select("m")
        found = local.mapInArrow(_block_lists(k, floor), "u long, v long, cos double")
        longer = _best(lists.unionAll(found), k).join(full, "u", "left_semi")
        lists, old = materialize(lists.join(full, "u", "left_anti").unionAll(longer), "lists"), lists
        discard(old)
        full = materialize(saturated(lists.join(full, "u", "left_semi"), k, threshold), "full")
    return lists, full


def _count_links(threshold: float):
    """Pairs of blocks to (cid, n): links of each member to the other block, weighted by class sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, members in zip(batch.column(0), batch.column(1)):
                m = members.values
                ids, side, size = (m.field(x).to_numpy(zero_copy_only=False) for x in ("cid", "side", "n"))
                x = _matrix(m.field("vec"))
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if same.as_py():
                    a = b = np.arange(len(ids))
                out = np.zeros(len(ids), dtype=np.int64)
                for s in range(0, len(a), BLOCK):
                    strip = a[s : s + BLOCK]
                    linked = (_cosine(x[strip], x[b]) >= threshold) & (ids[strip][:, None] != ids[b][None, :])
                    out[strip] += linked @ size[b]
                    if not same.as_py():
                        out[b] += linked.T @ size[strip]
                who = ids
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(out.astype(np.int64))], ["cid", "links"])

    return run


def _balls(cover: float):
    """Blocks (root, members) to (ball, root, cid, reach): each ball's leader is its first member, ``reach`` its widest angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, members in zip(batch.column(0), batch.column(1)):
                ids = members.values.field("cid").to_numpy(zero_copy_only=False)
                x = _matrix(members.values.field("vec"))
                angle = np.arccos(np.clip(_cosine(x, x), -1, 1))
                np.fill_diagonal(angle, 0)
                free = np.ones(len(ids), dtype=bool)
                while free.any():
                    lead = int(np.argmax(free))
                    own = np.flatnonzero(free & (angle[lead] <= cover))
                    free[own] = False
                    columns = [np.full(len(own), ids[lead]), np.full(len(own), root.as_py()), ids[own], np.full(len(own), angle[lead, own].max())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ball", "root", "cid", "reach"])

    return run


def _near_balls(shared, theta: float):
    """Vectors (cid, root, vec) to (ball, cid): balls of other roots that a vector's links may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: dict[int, tuple] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                sizes = np.asarray(part.column(2).value_lengths())
                for dim in np.unique(sizes):
                    if dim not in leaders:
                        own = [r for r in shared.value if len(r[3]) == dim]
                        leaders[dim] = (np.array([r[0] for r in own]), np.array([r[1] for r in own]), np.cos(np.minimum(np.pi, np.array([r[2] for r in own]) + theta + 1e-6)), np.array([r[3] for r in own]))
                    ball, root, least, x = leaders[dim]
                    if not len(ball):
                        continue
                    at = np.flatnonzero(sizes == dim)
                    ids, roots = (part.column(c).to_numpy(zero_copy_only=False)[at] for c in (0, 1))
                    i, j = np.nonzero(_cosine(_matrix(part.column(2).take(pa.array(at))), x) >= least[None, :])
                    other = roots[i] != root[j]
                    yield pa.RecordBatch.from_arrays([pa.array(ball[j[other]]), pa.array(ids[i[other]])], ["ball", "cid"])

    return run


def _first_links(threshold: float):
    """(members, rows) to (u, v): one link into the members for each row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, rows in zip(batch.column(0), batch.column(1)):
                (a, x), (b, y) = ((m.values.field("cid").to_numpy(zero_copy_only=False), _matrix(m.values.field("vec"))) for m in (members, rows))
                linked = _cosine(y, x) >= threshold
                some = np.flatnonzero(linked.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(a[linked[some].argmax(axis=1)]), pa.array(b[some])], ["u", "v"])

    return run


def _chunks(df: DataFrame, n: int, key: str) -> Iterator[list]:
    """The rows of ``df`` in lists of about ``CHUNK``, dealt by the hash of ``key``."""
    parts = -(-n // CHUNK)
    for i in range(parts):
        found = df.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(parts)) == i).collect()
        if found:
            yield found


def saturated_links(vectors: DataFrame, roots: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(u, v): for each row outside a component and each ball of the component's saturated vectors it links with, one such link."""
    spark, theta = vectors.sparkSession, math.acos(threshold)
    own = roots.join(full.select(F.col("u").alias("node")), "node").select(F.col("node").alias("cid"), "root")
    blocks = materialize(own.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    placed = own.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).join(vectors, "cid")
    balls = materialize(placed.groupBy("root", "block").agg(F.collect_list(F.struct("cid", "vec")).alias("m")).select("root", "m").mapInArrow(_balls(theta), "ball long, root long, cid long, reach double"), "balls")
    leaders = balls.filter("ball = cid").join(vectors, "cid").select("ball", "root", "reach", "vec")
    rooted = vectors.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "vec")
    near = spark.createDataFrame([], "ball long, cid long")
    for found in _chunks(leaders, leaders.count(), "ball"):
        shared = spark.sparkContext.broadcast([(r.ball, r.root, r.reach, np.array(r.vec, dtype=np.float64)) for r in found])
        near = near.unionAll(materialize(rooted.mapInArrow(_near_balls(shared, theta), "ball long, cid long"), "near"))
        shared.destroy()
    blocks = materialize(near.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    rows = near.join(blocks, "ball").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).join(vectors, "cid").groupBy("ball", "block").agg(F.collect_list(F.struct("cid", "vec")).alias("rows"))
    members = balls.join(blocks, "ball", "left_semi").join(vectors, "cid").groupBy("ball").agg(F.collect_list(F.struct("cid", "vec")).alias("members"))
    return rows.join(members, "ball").select("members", "rows").mapInArrow(_first_links(threshold), "u long, v long")


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least row of the component that each row and each column of a bipartite link matrix is in (only where it links)."""
    rows = np.arange(len(linked))
    while True:
        columns = np.where(linked, rows[:, None], len(linked)).min(axis=0)
        new = np.minimum(rows, np.where(linked, columns[None, :], len(linked)).min(axis=1))
        if (new == rows).all():
            return rows, columns
        rows = new


def _compare_all(shared, threshold: float):
    """Vectors (cid, vec) against a chunk to (u, v, links): links of u, weighted by class sizes, and a forest of the links as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                sizes = np.asarray(part.column(1).value_lengths())
                for dim in np.unique(sizes):
                    own = [r for r in shared.value if len(r[2]) == dim]
                    if not own:
                        continue
                    at = np.flatnonzero(sizes == dim)
                    ids = part.column(0).to_numpy(zero_copy_only=False)[at]
                    others, n = (np.array([r[c] for r in own]) for c in (0, 1))
                    linked = (_cosine(_matrix(part.column(1).take(pa.array(at))), np.array([r[2] for r in own])) >= threshold) & (ids[:, None] != others[None, :])
                    i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                    if len(i):
                        rows, columns = _forest(linked[np.ix_(i, j)])
                        u, v = np.concatenate([ids[i], others[j]]), ids[i][np.concatenate([rows, columns])]
                        links = np.concatenate([linked[i] @ n, np.zeros(len(j), dtype=np.int64)])
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(links.astype(np.int64))], ["u", "v", "links"])

    return run


def exact_links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(u, v, links) of all rows against all rows: the links of u sum to its number, (u, v) connect the components."""
    spark, vectors = classes.sparkSession, classes.select("cid", "vec")
    out = spark.createDataFrame([], "u long, v long, links long")
    for found in _chunks(classes.select("cid", "n", "vec"), n, "cid"):
        shared = spark.sparkContext.broadcast([(r.cid, r.n, np.array(r.vec, dtype=np.float64)) for r in found])
        out = out.unionAll(materialize(vectors.mapInArrow(_compare_all(shared, threshold), "u long, v long, links long"), "exact"))
        shared.destroy()
    return out


def _audit(vectors: DataFrame, links: DataFrame, whole: DataFrame, threshold: float) -> float:
    """Average recall of a query vector over its true links, the lesser of two audits.

    One is over members of ``whole`` (node, root), the components whose members
    are all compared, and one over all other rows.  A true link is found where
    it is counted: in ``links``, or between members of one component of ``whole``.
    """
    members = whole.select(F.col("node").alias("cid"))
    drawn = lambda df, want: df.orderBy(F.xxhash64(F.lit(5), "cid"), "cid").limit(want).collect()
    picked = drawn(vectors.join(members, "cid", "left_semi"), AUDIT) + drawn(vectors.join(members, "cid", "left_anti"), 8 * AUDIT)
    if not picked:
        return 1.0
    shared = vectors.sparkSession.sparkContext.broadcast([(r.cid, np.array(r.vec, dtype=np.float64)) for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                sizes = np.asarray(part.column(1).value_lengths())
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    own = [(c, v) for c, v in shared.value if len(v) == dim]
                    if own:
                        cos = _cosine(np.array([v for _, v in own]), _matrix(part.column(1).take(pa.array(at))))
                        ids = part.column(0).to_numpy(zero_copy_only=False)[at]
                        i, j = np.nonzero((cos >= threshold) & (np.array([c for c, _ in own])[:, None] != ids[None, :]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.array([own[x][0] for x in i], dtype=np.int64)), pa.array(ids[j])], ["u", "v"])

    true = vectors.mapInArrow(run, "u long, v long").join(links.select("u", "v", F.lit(True).alias("hit")), ["u", "v"], "left")
    for c in ("u", "v"):
        true = true.join(whole.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    query = true.groupBy("u", F.col("root_u").isNotNull().alias("inside")).agg(F.avg(F.coalesce("hit", F.col("root_u") == F.col("root_v"), F.lit(False)).cast("int")).alias("recall"))
    return min([r.recall for r in query.groupBy("inside").agg(F.avg("recall").alias("recall")).collect()], default=1.0)


def _links_of(classes: DataFrame, links: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """(cid, links): by blocks for members of ``whole`` (node, root), from ``links`` for the others."""
    sizes = materialize(whole.groupBy("root").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks")), "blocks")
    members = whole.select(F.col("node").alias("cid"), "root").join(classes, "cid")
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.struct("cid", (F.col("block") > F.col("other")).cast("int").alias("side"), "n", "vec").alias("m"))
    met = paired.groupBy("root", "a", "b").agg(F.collect_list("m").alias("m")).select((F.col("a") == F.col("b")).alias("same"), "m")
    counted = met.mapInArrow(_count_links(threshold), "cid long, links long")
    small = links.join(whole.select(F.col("node").alias("u")), "u", "left_anti").join(classes.select(F.col("cid").alias("v"), "n"), "v").select(F.col("u").alias("cid"), F.col("n").alias("links"))
    return counted.unionAll(small).groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD, k: int = K, tables: int = TABLES, margin: float = 0.1, target: float = 0.99) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)
    marked = rows.select("vec_id", F.when(usable, F.transform(e, lambda x: x + 0)).alias("vec")).withColumn("cid", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    classes = materialize(marked.filter("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")
    vectors = classes.select("cid", "vec")
    n = classes.count()
    while True:
        lists, full = enlarge(neighbour_lists(vectors, n, k, threshold - margin, tables), vectors, k, threshold - margin, threshold)
        links = lists.filter(F.col("cos") >= threshold).select("u", "v")
        # a pair found from a list that was enlarged counts for both
        links = materialize(links.unionAll(links.select("v", "u")).distinct(), "links")
        roots = materialize(components(links), "roots")
        across = materialize(saturated_links(vectors, roots, full, threshold), "across")
        if across.first():
            roots = materialize(components(links.unionAll(across)), "roots")
        large = roots.join(full.select(F.col("u").alias("node")), "node").select("root").distinct()
        whole = materialize(roots.join(large, "root").select("node", "root"), "whole")
        if _audit(vectors, links, whole, threshold) >= target:
            total = _links_of(classes, links, whole, threshold)
            break
        if tables >= MOST_TABLES:
            exact = exact_links(classes, n, threshold)
            roots = materialize(components(exact.select("u", "v")), "roots")
            total = exact.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
            break
        tables *= 2
    rooted = materialize(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", "first_id", F.coalesce("root", "cid").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    per_class = rooted.join(least, "root").join(materialize(total, "total"), "cid", "left").select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = marked.select("vec_id", "cid").join(per_class, "cid", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op7_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
