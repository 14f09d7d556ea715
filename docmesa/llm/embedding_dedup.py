"""Near-duplicate vectors by NN-descent, within labels.

Equal vectors become one point with a weight. Points start with neighbours from small shards (the
leaves of a few random projection trees), where lists are refined among neighbours of
neighbours. Then the graph is refined across shards: the neighbours of each point, in both directions, are
joined with each other. A node whose list is full of links has a longer list wanted: its
component is joined block by block, so it gets all links there. Recall is audited label by label on a
sample of points against all points of their label, until enough of them have a link, and the refinement
goes on while it is low. Labels of one shard, labels with too few links to audit and labels that
refinement does not complete are joined block by block as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmesa.llm.common import materialise, partitions
from docmesa.llm.components import components

#: Neighbours of a point, most neighbours while a shard's lists are enlarged, trees, rows of a shard, rows of a block.
NEIGHBOURS, MOST, TREES, SHARD, BLOCK = 10, 40, 4, 600, 1024
#: Points of a label first asked in the audit, linked points it must see, recall that ends refinement, rounds before a label is joined as a whole.
AUDIT, LINKED, ENOUGH, ROUNDS = 300, 100, 1.0, 4
#: Rows of a block where a whole label is joined, rows of it that are compared at a time.
WIDE, STRIP = 8192, 256
#: Likeness below the threshold at which neighbours still lead on to others.
MARGIN = 0.2


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, v: the unit vector in doubles; null where it links with nothing."""
    for b in batches:
        out = []
        for e, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = None
            if e and label is not None and None not in e:
                a = np.array(e, dtype=np.float64)
                peak = np.abs(a).max()
                if np.isfinite(peak) and peak > 0:
                    a = a / peak
                    x = (a / np.sqrt(a @ a)).tobytes()
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def planes(dim: int, tree: int, depth: int) -> np.ndarray:
    return np.random.default_rng(1000 * tree + 17).standard_normal((depth, dim))


def _shards(depths: dict[tuple[int, int], int], trees: range):
    """Each point once a tree, with its leaf. depths: of (label, bytes of a vector)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, vs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            out: list[tuple] = []
            for key in sorted({(int(n), len(v)) for n, v in zip(labels, vs, strict=True)}):
                at = [i for i, v in enumerate(vs) if labels[i] == key[0] and len(v) == key[1]]
                x = np.frombuffer(b"".join([vs[i] for i in at]), dtype=np.float64).reshape(len(at), -1)
                depth = depths.get(key, 0)
                for t in trees:
                    code = (x @ planes(x.shape[1], t, depth).T > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(at), dtype=np.int64)
                    out += [(ids[i], vs[i], key[0], key[1], t, int(c)) for i, c in zip(at, code, strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "v", "label", "size", "tree", "leaf"])

    return rows


def descend(x: np.ndarray, threshold: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """NN-descent on the rows of x: neighbours and likenesses, best first; lists are doubled while any is full of links."""
    n = len(x)
    r = np.random.default_rng(seed)
    k = min(NEIGHBOURS, n - 1)
    near = (np.arange(n)[:, None] + r.integers(1, n, (n, k))) % n
    like = np.einsum("ijk,ik->ij", x[near], x)
    while True:
        for _ in range(12):
            source = np.repeat(np.arange(n), near.shape[1])
            order = r.permutation(n * near.shape[1])
            order = order[np.argsort(near.ravel()[order], kind="stable")]
            count = np.bincount(near.ravel(), minlength=n)
            back = np.repeat(np.arange(n)[:, None], k, axis=1)  # as many of those that point here
            start = np.append(0, np.cumsum(count)[:-1])
            for j in range(k):
                has = count > j
                back[has, j] = source[order[start[has] + j]]
            both = np.concatenate([near, back], axis=1)
            picks = both[np.arange(n)[:, None], r.integers(0, both.shape[1], (n, min(both.shape[1], 8)))]
            wide = both[picks].reshape(n, -1)
            wide = np.concatenate([near, back, wide], axis=1)
            wide.sort(axis=1)
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            wide[wide == np.arange(n)[:, None]] = -1
            score = np.full(wide.shape, -2.0)
            for s in range(0, n, 128):
                part = wide[s : s + 128]
                score[s : s + 128] = np.where(part < 0, -2.0, np.einsum("ijk,ik->ij", x[part], x[s : s + 128]))
            best = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < wide.shape[1] else np.argsort(-score, axis=1)
            fresh, fresh_like = np.take_along_axis(wide, best, 1), np.take_along_axis(score, best, 1)
            empty = fresh < 0
            fresh[empty] = np.where(empty, (np.arange(n)[:, None] + 1) % n, fresh)[empty]
            fresh_like[empty] = np.einsum("ijk,ik->ij", x[fresh], x)[empty] if empty.any() else fresh_like[empty]
            gained = float(fresh_like.sum() - like.sum())
            near, like = fresh, fresh_like
            if gained < 1e-3 * n * k:
                break
        if k >= min(MOST, n - 1) or not (like.min(axis=1) >= threshold).any():
            return near, like
        grown = min(2 * k, n - 1)
        more = (np.arange(n)[:, None] + r.integers(1, n, (n, grown - k))) % n
        near, like = np.concatenate([near, more], axis=1), np.concatenate([like, np.einsum("ijk,ik->ij", x[more], x)], axis=1)
        k = grown


_EDGES = "a bigint, b bigint, s double"


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
    keep = a != b
    low, high = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
    return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64()), "s": pa.array(s[keep], pa.float64())})


def _shard_group(threshold: float):
    def group(table: pa.Table) -> pa.Table:
        if len(table) < 2:
            return _edges(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, float)))
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        x, ids = _matrix(table["v"])[order], table["id"].to_numpy()[order]
        near, like = descend(x, threshold)
        keep = like >= threshold - MARGIN
        return _edges(np.repeat(ids, keep.sum(axis=1)), ids[near[keep]], like[keep])

    return group


def _local_join(threshold: float):
    """Neighbours of neighbours: the neighbours of each point in the bucket against each other."""

    def group(table: pa.Table) -> pa.Table:
        hub = table["hub"].to_numpy()
        order = np.argsort(hub, kind="stable")
        x, ids, hub = _matrix(table["v"])[order], table["id"].to_numpy()[order], hub[order]
        out = []
        for part in np.split(np.arange(len(hub)), np.flatnonzero(np.diff(hub)) + 1):
            if len(part) > 1:
                like = x[part] @ x[part].T
                i, j = np.nonzero(np.triu(like >= threshold - MARGIN, 1))
                out.append((ids[part[i]], ids[part[j]], like[i, j]))
        return _edges(*(np.concatenate(c) for c in zip(*out, strict=True))) if out else _edges(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, float)))

    return group


def best_edges(edges: DataFrame, keep: int) -> DataFrame:
    """Edges that are among the `keep` best of either end, once each."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    directed = once.select(F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("id")), F.struct(F.col("b").alias("hub"), F.col("a").alias("id")))).alias("e"), "s").select("e.hub", "e.id", "s")
    rank = F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("s"), "id"))
    return directed.withColumn("r", rank).filter(F.col("r") <= keep).drop("r")


def _within(points: DataFrame, labels: Iterable[tuple[int, int]]) -> DataFrame:
    """The points of some labels, of (label, bytes of a vector)."""
    return points.join(points.sparkSession.createDataFrame(sorted(labels), "label bigint, size int"), ["label", "size"], "left_semi")


def _hits(threshold: float):
    """For each asked point of a block, its true links there, and how many of them have its root."""

    def group(table: pa.Table) -> pa.Table:
        x, ids, root, asked = _matrix(table["v"]), table["id"].to_numpy(), table["root"].to_numpy(), table["asked"].to_numpy(zero_copy_only=False).astype(bool)
        at, of = np.flatnonzero(~asked), np.flatnonzero(asked)
        n, k = np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
        for s in range(0, len(of), STRIP):
            rows = of[s : s + STRIP]
            hit = (x[rows] @ x[at].T >= threshold) & (ids[rows][:, None] != ids[at])
            n[s : s + STRIP], k[s : s + STRIP] = hit.sum(axis=1), (hit & (root[rows][:, None] == root[at])).sum(axis=1)
        return pa.table({"label": table["label"].take(pa.array(of)), "size": table["size"].take(pa.array(of)), "id": pa.array(ids[of], pa.int64()), "n": pa.array(n), "k": pa.array(k)})

    return group


def audit(points: DataFrame, roots: DataFrame, sizes: dict[tuple[int, int], int], threshold: float) -> dict[tuple[int, int], float | None]:
    """For each label the mean share, over a sample of its linked points, of a point's true links whose ends one component holds.

    The sample grows until LINKED of its points have a link; None where more than half of the points would have to be asked for that.
    """
    found: dict[tuple[int, int], float | None] = {}
    rooted = points.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    ask = AUDIT
    while left := {key: n for key, n in sizes.items() if key not in found}:
        found |= {key: None for key, n in left.items() if 2 * ask > n}
        left = {key: n for key, n in left.items() if key not in found}
        if not left:
            break
        counted = points.sparkSession.createDataFrame([(*key, n) for key, n in sorted(left.items())], "label bigint, size int, n bigint")
        split = lambda rows, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(rows / F.lit(WIDE)).cast("bigint"))
        every = lambda rows: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(rows / F.lit(WIDE)).cast("bigint") - 1))
        here = rooted.join(counted, ["label", "size"])
        asked = here.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")) < ask)
        columns = ["label", "size", "id", "v", "root", "asked", "i", "j"]
        own = here.withColumn("asked", F.lit(False)).withColumn("i", split(F.col("n"), 7)).withColumn("j", every(F.lit(ask))).select(columns)
        dealt = own.unionByName(asked.withColumn("asked", F.lit(True)).withColumn("i", every(F.col("n"))).withColumn("j", split(F.lit(ask), 11)).select(columns))
        hits = dealt.groupBy("label", "size", "i", "j").applyInArrow(_hits(threshold), "label bigint, size int, id bigint, n bigint, k bigint")
        of = hits.groupBy("label", "size", "id").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).filter("n > 0")
        seen = of.groupBy("label", "size").agg(F.count("*").alias("linked"), F.avg(F.col("k") / F.col("n")).alias("recall")).collect()  # a row for each large label
        found |= {(r.label, r.size): r.recall for r in seen if r.linked >= LINKED}
        ask *= 10
    return found


def _ties(threshold: float):
    """Edges that tie together the points of two blocks which links between the blocks join: at most one a point, however many links there are."""

    def group(table: pa.Table) -> pa.Table:
        x, ids, side = _matrix(table["v"]), table["id"].to_numpy(), table["side"].to_numpy()
        i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: the block with itself
        root = np.arange(len(ids))
        for s in range(0, len(i), STRIP):
            rows = i[s : s + STRIP]
            hit = x[rows] @ x[j].T >= threshold
            while True:
                p, q = np.nonzero(hit & (root[rows][:, None] != root[j]))
                if not len(p):
                    break
                up = np.arange(len(ids))
                np.minimum.at(up, np.maximum(root[rows[p]], root[j[q]]), np.minimum(root[rows[p]], root[j[q]]))
                while (up[up] != up).any():
                    up = up[up]
                root = up[root]
        return _edges(ids, ids[root], np.ones(len(ids)))

    return group


def _dealt(members: DataFrame, key: list[str], count: str, rows: int) -> DataFrame:
    """Each member once for every pair (i, j) of blocks of its group that its block is in; side: 0 in i, 1 in j, 2 where they are one."""
    blocks = members.withColumn("blocks", F.ceil(F.col(count) / rows).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return dealt.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), "id", "w", "v")


def exact_ties(points: DataFrame, threshold: float) -> DataFrame:
    """All points of a label against each other, block by block: edges with the components that all links make."""
    counted = points.join(points.groupBy("label", "size").agg(F.count("*").alias("n")).filter("n > 1"), ["label", "size"])
    return _dealt(counted, ["label", "size"], "n", WIDE).groupBy("label", "size", "i", "j").applyInArrow(_ties(threshold), _EDGES)


def _block_pairs(threshold: float):
    """Links between the blocks of a component, counted for each point and weighed by the other end."""

    def group(table: pa.Table) -> pa.Table:
        x, ids, w, side = _matrix(table["v"]), table["id"].to_numpy(), table["w"].to_numpy(), table["side"].to_numpy()
        i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: the block with itself
        hit = (x[i] @ x[j].T >= threshold).astype(float)
        if (side == 2).all():
            np.fill_diagonal(hit, 0)
            return pa.table({"id": pa.array(ids[i], pa.int64()), "links": pa.array((hit @ w[j]).astype(np.int64))})
        return pa.table({"id": pa.array(np.concatenate([ids[i], ids[j]]), pa.int64()), "links": pa.array(np.concatenate([hit @ w[j], hit.T @ w[i]]).astype(np.int64))})

    return group


def near_duplicates(df: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in double precision is at least
    the threshold. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing. Rows with equal ids are vectors of their own and link like others; a null id is
    never a component's id unless all of it are null. An empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    n = partitions(spark)
    raw = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("bigint").alias("label"))
    every = materialise(raw.mapInArrow(_prepared, "vec_id bigint, label bigint, v binary"), "vectors")
    # equal vectors: a point, its number is a hash of label and vector
    every = every.withColumn("id", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    points = materialise(every.filter("id is not null").groupBy("id", "label", "v").agg(F.count("*").alias("w"), F.min("vec_id").alias("first")), "points")
    plain = points.select("id", "label", "w", "v", F.octet_length("v").alias("size"))
    sizes = {(r.label, r.size): r.n for r in plain.groupBy("label", "size").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD).collect()}  # a row for each large label
    depths = {k: int(np.ceil(np.log2(c / SHARD))) for k, c in sizes.items()}

    def trees(some: DataFrame, which: range) -> DataFrame:
        leaves = some.select("id", "label", "w", "v").mapInArrow(_shards(depths, which), "id bigint, v binary, label bigint, size int, tree int, leaf bigint")
        keyed = leaves.withColumn("chunk", F.pmod(F.xxhash64("id", "tree"), F.lit(1 << 30)))
        counted = leaves.groupBy("label", "size", "tree", "leaf").count()
        # leaves that did not split, as of a dense cluster, are dealt into chunks at random, other ones in each tree
        sized = keyed.join(counted, ["label", "size", "tree", "leaf"]).withColumn("chunk", F.expr(f"chunk % cast(ceil(count / {4 * SHARD}) as bigint)"))
        return sized.select("id", "v", "label", "size", "tree", "leaf", "chunk").groupBy("label", "size", "tree", "leaf", "chunk").applyInArrow(_shard_group(threshold), _EDGES)

    big = spark.createDataFrame(sorted(sizes), "label bigint, size int")
    ties = exact_ties(plain.join(big, ["label", "size"], "left_anti"), threshold)
    recall = 1.0
    if sizes:
        edges = materialise(trees(_within(plain, sizes), range(TREES)), "neighbours")
        left, exact = dict(sizes), set()
        for turn in range(ROUNDS):
            some = _within(plain, left).select(plain.columns)
            lists = best_edges(edges, 2 * NEIGHBOURS)
            vectors = lists.join(some.select("id", "v"), "id")
            self_ = some.select("id", "v", F.col("id").alias("hub"))
            local = vectors.select("id", "v", "hub").unionByName(self_).withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(4 * n))).withColumn("size", F.octet_length("v"))
            refined = local.groupBy("bucket", "size").applyInArrow(_local_join(threshold), _EDGES)
            more = [edges, refined] + ([trees(some, range(TREES * (turn + 1), TREES * (turn + 2)))] if turn else [])
            union = more[0]
            for m in more[1:]:
                union = union.unionByName(m)
            edges = materialise(union.groupBy("a", "b").agg(F.max("s").alias("s")), "neighbours")
            for key, share in audit(some, components(edges.filter(F.col("s") >= threshold)), left, threshold).items():
                if share is None or share >= ENOUGH:
                    del left[key]
                    recall = min(recall, 1.0 if share is None else share)
                    exact |= {key} if share is None else set()
            if not left:
                break
        ties = ties.unionByName(edges.filter(F.col("s") >= threshold))
        if exact := exact | set(left):
            ties = ties.unionByName(exact_ties(_within(plain, exact), threshold))
    roots = components(ties)
    members = plain.join(roots.withColumnRenamed("node", "id"), "id")
    counts = members.groupBy("root").agg(F.count("*").alias("c"))
    dealt = _dealt(members.join(counts, "root"), ["root"], "c", BLOCK)
    linked = dealt.groupBy("root", "i", "j").applyInArrow(_block_pairs(threshold), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))
    named = points.select("id", "w", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").join(linked, "id", "left").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = every.select("vec_id", "id").join(of, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
