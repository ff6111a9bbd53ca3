"""Embedding near-duplicates: a forest of random-projection trees with spill, compared in leaves, verified and joined.

Equal vectors of a label are one class each. A label of more than a leaf's classes is split by several trees: at a cut of
a random projection, again and again, and a vector near the cut goes to both sides (spill), so close pairs stay together
and trees make up for each other. Trees are fitted on bounded samples in executors, in rounds, until no leaf is too
large; of several directions and cuts the one with the least spill is taken, so a cut runs around a dense cluster rather
than through it, and a node that every cut would only copy stays whole.

Leaves compare their vectors in double precision. A pair that meets in several leaves is counted in the one with the
least number, which each can tell as rows carry the numbers of all their leaves; so links are counted exactly once
without rows of pairs. Two things keep dense clusters from being quadratic in copies. A core is all vectors within half
the threshold's angle of one representative: any two of them link, so they are counted and joined without comparisons.
A leaf that stays too large is compared block against block, less the blocks that share a core or an earlier such leaf.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .components import components

THRESHOLD = 0.98
#: Trees, and classes of a leaf, about; a leaf of over twice as many is compared in blocks of four times as many.
TREES, LEAF = 5, 512
#: Half the width in which both sides get a vector, in deviations of the projected distance of a pair at the threshold.
SPILL = 0.5
#: Directions tried for a node, quantiles tried as its cut (outer ones only where inner ones spill too much), and the share
#: of a node that may spill: a node that every cut would copy more than that stays whole.
DIRECTIONS, INNER, OUTER, MOST_SPILL = 4, (0.5, 0.4, 0.6, 0.3, 0.7), (0.2, 0.8, 0.12, 0.88), 0.25
#: Vectors that fit one node's subtree at most, about, and those that a node of the subtree has at least.
SAMPLE, LEAST_SAMPLE = 20_000, 48
#: Cores of a label and of all; a core has at least this share of its label. What is no core is compared.
CORES, ALL_CORES, CORE_SHARE = 16, 20_000, 0.02
#: Nodes of all trees, about, at most (25 bytes each are broadcast): with more classes leaves are larger.
MOST_NODES = 4_000_000
#: Rows of one comparison, and the core of a vector that links with nothing in any core.
BLOCK, FAR = 1024, -2
#: Bytes of directions that a worker keeps at hand.
KNOWN = 64 << 20


def _normal(seed: int, dim: int) -> np.ndarray:
    r = np.random.default_rng(seed).standard_normal(dim)
    return r / np.linalg.norm(r)


def _spill(dim: int, threshold: float) -> float:
    return float(SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(dim))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers to evenly spread ones."""
    return (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def fit_subtree(x: np.ndarray, size: float, seed: int, leaf: int, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
    """Nodes (seed, cut, low, high) of a subtree fitted on x (unit rows), a sample of `size` vectors; children by their
    place in the list, -1 and -2 for a leaf: one that may be split further once it is counted, and one that may not."""
    spill, each = _spill(x.shape[1], threshold), size / max(1, len(x))
    nodes: list[tuple[int, float, int, int]] = [(0, 0.0, -1, -1)]
    stack = [(0, np.arange(len(x)))]
    while stack:
        k, rows = stack.pop()
        if len(rows) * each <= leaf or len(rows) < LEAST_SAMPLE:
            continue
        seeds = [(seed * 1_000_003 + k * DIRECTIONS + choice) & 0x7FFFFFFF for choice in range(DIRECTIONS)]
        ats = x[rows] @ np.stack([_normal(s, x.shape[1]) for s in seeds], 1)
        for quantiles in (INNER, OUTER):
            middles = np.quantile(ats, quantiles, axis=0)
            spilt = np.stack([(np.abs(ats - m) <= spill).sum(0) for m in middles])
            q, d = divmod(int(spilt.argmin()), DIRECTIONS)
            both, s, middle, at = int(spilt[q, d]), seeds[d], float(middles[q, d]), ats[:, d]
            if both <= MOST_SPILL * len(rows):
                break
        else:
            nodes[k] = (0, 0.0, -2, -2)
            continue
        nodes[k] = (s, middle, len(nodes), len(nodes) + 1)
        stack += [(len(nodes), rows[at <= middle + spill]), (len(nodes) + 1, rows[at > middle - spill])]
        nodes += [(0, 0.0, -1, -1)] * 2
    return nodes


def fit_cores(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Representatives (rows of x, a sample) with the most others within half the angle, none within another's reach."""
    near = x @ x.T >= _core_cosine(threshold)
    free, out = np.ones(len(x), bool), []
    while len(out) < CORES:
        counts = (near[:, free].sum(1)) * free
        k = int(counts.argmax())
        if counts[k] < max(8, CORE_SHARE * len(x)):
            break
        out.append(k)
        free &= ~near[k]
    return np.array(out, int)


def _far_cosine(threshold: float) -> float:
    """Below this cosine with a representative a vector links with nothing in its core."""
    return float(np.cos(min(np.pi, 1.5 * np.arccos(threshold)))) - 1e-9


def _core_cosine(threshold: float) -> float:
    """The cosine of half the threshold's angle, a little more to be on the safe side of rounding."""
    return float(np.cos(np.arccos(threshold) / 2)) + 1e-9


class Forest:
    """Nodes of all trees in arrays, and the roots of each label (by hash of label and length) that has trees."""

    def __init__(self) -> None:
        self.seed, self.cut = np.zeros(0, np.int64), np.zeros(0)
        self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.roots: dict[int, list[int]] = {}

    def state(self) -> tuple:
        return self.seed, self.cut, self.low, self.high, self.roots

    @classmethod
    def of(cls, state: tuple) -> Forest:
        forest = cls()
        forest.seed, forest.cut, forest.low, forest.high, forest.roots = state
        return forest

    def add(self, subtrees: list[tuple[tuple[np.ndarray, ...], int | None]]) -> list[int]:
        """Put subtrees in (seeds, cuts, low and high children of each node, its root first), each in place of a leaf if
        that is given; returns the roots' numbers. Arrays are copied once, so give all subtrees of a round together."""
        parts, roots, end = [], [], len(self.seed)
        for (seed, cut_, low, high), at in subtrees:
            first = end - (at is not None)
            low, high = (np.where(c >= 0, c + first, c).astype(np.int64) for c in (low, high))
            keep = slice(0 if at is None else 1, None)
            parts.append((seed[keep].astype(np.int64), cut_[keep], low[keep], high[keep]))
            roots.append((first, None) if at is None else (at, (seed[0], cut_[0], low[0], high[0])))
            end += len(parts[-1][0])
        old = (self.seed, self.cut, self.low, self.high)
        self.seed, self.cut, self.low, self.high = (np.concatenate([c, *(p[k] for p in parts)]) for k, c in enumerate(old))
        for at, root in roots:
            if root is not None:
                self.seed[at], self.cut[at], self.low[at], self.high[at] = root
        return [at for at, _ in roots]

    def route(self, x: np.ndarray, keys: np.ndarray, threshold: float, known: dict) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that each row of x (unit rows of one length) gets to, sorted by row and leaf."""
        rows, at = [], []
        for key in np.unique(keys):
            if roots := self.roots.get(int(key)):
                here = np.flatnonzero(keys == key)
                rows.append(np.tile(here, len(roots)))
                at.append(np.repeat(np.array(roots), len(here)))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int)
        row, node = np.concatenate(rows), np.concatenate(at)
        spill, out = _spill(x.shape[1], threshold), []
        while len(row):
            inner = self.low[node] >= 0
            out.append((row[~inner], node[~inner]))
            row, node = row[inner], node[inner]
            if not len(row):
                break
            distinct, of = np.unique(node, return_inverse=True)
            if (len(known) + len(distinct)) * 8 * x.shape[1] > KNOWN:
                known.clear()
            for n in distinct:
                if (int(n), x.shape[1]) not in known:
                    known[int(n), x.shape[1]] = _normal(int(self.seed[n]), x.shape[1])
            directions = np.stack([known[int(n), x.shape[1]] for n in distinct])
            p = np.einsum("ij,ij->i", x[row], directions[of]) - self.cut[node]
            low, high = p <= spill, p > -spill
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.low[node[low]], self.high[node[high]]])
        row, node = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort([node, row])
        return row[order], node[order]


def usable(vectors: DataFrame, vec_col: str, embedding_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (array of float or double) of vectors that can link: label and vector set, not zero, all finite."""
    given = vectors.schema[embedding_col].dataType.simpleString()
    v = F.col(embedding_col) if given == "array<float>" else F.col(embedding_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    can = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col(vec_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), can.alias("can"))


def near_duplicates(vectors: DataFrame, *, vec_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id = component_id), one row per row of vectors.

    Vectors link if their labels are equal and their cosine is at least the threshold (over 0, under 1); vectors of
    different lengths don't. Null, zero or non-finite vectors and null labels link with nothing: no links, their own
    component. Rows that repeat an id are rows of their own and link with each other; a null id is never a component's
    least. Links are the pairs that share a leaf of the forest, so a few may be missed, and none is below the threshold.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors.select(vec_col, embedding_col, label_col), vec_col, embedding_col, label_col)
    # Two hashes name a class: 128 bits, so classes are not mixed up at any size.
    hashes = [F.xxhash64("label", F.size("v"), "v").alias("h1"), F.xxhash64(F.lit(1), "label", F.size("v"), "v").alias("h2")]
    good = rows.where("can")
    classes = good.select("vec_id", "label", "v", *hashes).groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "label", F.size("v").alias("dim"), F.xxhash64("label", F.size("v")).alias("key"), "m", "least", "v"))
    found = _links(classes.select("cls", "label", "dim", "key", "m", "v"), threshold, trees, leaf)
    edges, counts = found.where("counted is null").select("u", "v"), found.where("counted is not null").groupBy(F.col("u").alias("cls")).agg(F.sum("counted").alias("others"))
    roots = cut(components(edges))
    linked = classes.select("cls", "least").join(roots, F.col("cls") == F.col("node")).select("cls", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.select("cls", "root").join(least, "root").select("cls", "component_id")
    # Copies link with each other; classes without an edge have no other links.
    of_class = classes.select("cls", "h1", "h2", "m", "least").join(known, "cls", "left").join(counts, "cls", "left")
    of_class = of_class.select("h1", "h2", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    joined = good.select("vec_id", *hashes).join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not can").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, threshold: float, trees: int, leaf: int) -> DataFrame:
    """(cls, label, dim, key, m, v) -> edges (u, v, counted null) that join what links, and rows (u, v null, counted) whose
    sum for a class is the number of vectors of other classes it links with. Materialised."""
    sizes = classes.groupBy("key").agg(F.count("*").alias("n"))
    n_all = classes.count()
    leaf = max(leaf, int(4 * n_all * trees / MOST_NODES))
    large = {r.key: r.n for r in sizes.where(F.col("n") > 2 * leaf).collect()}  # at most classes / leaf of them
    classes, core_rows = _with_cores(classes, large, threshold)
    forest, counts = _grow(classes, large, threshold, trees, leaf)
    blocks = _plan_blocks(classes, forest, {n: c for n, c in counts.items() if c > 2 * leaf}, threshold, 4 * leaf)
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((forest.state(), blocks))  # 25 bytes a node, see MOST_NODES; a few numbers a block kind
    label_type = classes.schema["label"].dataType.simpleString()
    v_type = classes.schema["v"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, blocks = Forest.of(shared.value[0]), shared.value[1]
        known: dict = {}
        for b in batches:
            for part, row, node in _routed(b, forest, threshold, known):
                cells = _lists(row, node, part.num_rows)
                ids, cores = part.column("cls").to_numpy(), part.column("core").to_numpy()
                rows, nodes, first, second, own = [], [], [], [], []
                alone = np.setdiff1d(np.arange(part.num_rows), row)  # labels of one leaf
                plain = np.array([int(n) not in blocks for n in node], bool) if len(node) else np.zeros(0, bool)
                for r, n in ((alone, np.full(len(alone), -1)), (row[plain], node[plain])):
                    rows.append(r), nodes.append(n), first.append(np.zeros(len(r), int)), second.append(np.zeros(len(r), int)), own.append(np.zeros(len(r), int))
                for r, n in zip(row[~plain], node[~plain], strict=True):
                    kind = (int(cores[r]), _earlier(cells[r], int(n), blocks))
                    at, many, partners = blocks[int(n)][kind]
                    me = at + int(_mixed(ids[r : r + 1])[0] % np.uint64(many))
                    other = partners if (kind[0] < 0 and kind[1] < 0) else partners[(partners < at) | (partners >= at + many)]
                    rows.append(np.full(len(other), r)), nodes.append(np.full(len(other), n)), own.append(np.full(len(other), me))
                    first.append(np.minimum(other, me)), second.append(np.maximum(other, me))
                take = pa.array(np.concatenate(rows).astype(np.int64))
                of_row = pa.array(cells, pa.list_(pa.int64())).take(take)
                whole = [part.column(c).take(take) for c in ("cls", "label", "dim", "core", "m", "v")]
                yield pa.RecordBatch.from_arrays(
                    [*whole, of_row, *(pa.array(np.concatenate(c).astype(np.int64)) for c in (nodes, first, second, own))],
                    names=["cls", "label", "dim", "core", "m", "v", "cells", "node", "a", "b", "own"],
                )

    def compare(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("cls").to_numpy(), kind="stable")))
        u, v, ids, sums = compare_leaf(
            group.column("cls").to_numpy(), unit_rows(_matrix(group.column("v"))), group.column("m").to_numpy(), group.column("core").to_numpy(),
            group.column("cells").to_pylist(), int(group.column("node")[0].as_py()), group.column("own").to_numpy(), threshold,
        )
        none = pa.nulls(len(ids), pa.int64())
        return pa.table({"u": np.concatenate([u, ids]), "v": pa.concat_arrays([pa.array(v, pa.int64()), none]), "counted": pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(sums, pa.int64())])})

    dealt = classes.mapInArrow(deal, f"cls long, label {label_type}, dim int, core long, m long, v {v_type}, cells array<long>, node long, a long, b long, own long")
    found = dealt.groupBy("label", "dim", "node", "a", "b").applyInArrow(compare, "u long, v long, counted long")
    return cut(found.unionByName(core_rows))


def _routed(b: pa.RecordBatch, forest: Forest, threshold: float, known: dict) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with vectors of one length, and the (row, leaf) of those whose labels have trees."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = b.take(pa.array(np.flatnonzero(dims == dim)))
        yield part, *forest.route(unit_rows(_matrix(part.column("v"))), part.column("key").to_numpy(), threshold, known)


def _lists(row: np.ndarray, node: np.ndarray, n: int) -> list[list[int]]:
    """The leaves of each of n rows, ascending."""
    ends = np.searchsorted(row, np.arange(n + 1))
    return [node[lo:hi].tolist() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _earlier(cells: list[int], node: int, blocks: dict) -> int:
    """The least leaf of a row that is compared in blocks and lies before `node`, or -1."""
    return next((c for c in cells if c < node and c in blocks), -1)


def _with_cores(classes: DataFrame, large: dict[int, int], threshold: float) -> tuple[DataFrame, DataFrame]:
    """classes with core (a number, FAR from all cores, or -1), and the edges and counts of what is joined by sharing a core."""
    spark = classes.sparkSession
    none = spark.createDataFrame([], "u long, v long, counted long")
    if not large:
        return classes.withColumn("core", F.lit(-1).cast("long")), none

    def fit(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("cls").to_numpy(), kind="stable")))
        x = unit_rows(_matrix(group.column("v")))
        chosen = fit_cores(x, threshold)
        near = (x[chosen] @ x.T >= _core_cosine(threshold)).sum(1) if len(chosen) else np.zeros(0, int)
        return pa.table({"key": group.column("key").take(pa.array(chosen)), "dim": group.column("dim").take(pa.array(chosen)), "share": near / len(x), "rep": pa.array(list(x[chosen]), pa.list_(pa.float64()))})

    sample = _sample(classes, large, 2048)
    found = sample.groupBy("key", "dim").applyInArrow(fit, "key long, dim int, share double, rep array<double>").collect()
    found = sorted(found, key=lambda r: (-r.share * large[r.key], r.key, r.rep))[:ALL_CORES]
    reps = defaultdict(list)
    for k, r in enumerate(found):
        reps[r.key, r.dim].append((k, np.array(r.rep)))
    if not reps:
        return classes.withColumn("core", F.lit(-1).cast("long")), none
    shared = spark.sparkContext.broadcast({key: (np.array([k for k, _ in rs]), np.stack([v for _, v in rs])) for key, rs in reps.items()})  # ALL_CORES vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims, core = b.column("key").to_numpy(), b.column("dim").to_numpy(), np.full(b.num_rows, -1)
            for key, dim in set(zip(keys.tolist(), dims.tolist(), strict=True)) & shared.value.keys():
                ids, of = shared.value[key, dim]
                here = np.flatnonzero((keys == key) & (dims == dim))
                cosines = unit_rows(_matrix(b.column("v").take(pa.array(here)))) @ of.T
                k = cosines.argmax(1)
                best = cosines[np.arange(len(here)), k]
                core[here] = np.where(best >= _core_cosine(threshold), ids[k], np.where(best < _far_cosine(threshold), FAR, -1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(core)], names=[*b.schema.names, "core"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    classes = cut(classes.mapInArrow(assign, f"{schema}, core long"))
    wholes = classes.where("core >= 0").groupBy("core").agg(F.min("cls").alias("v"), F.sum("m").alias("w"))
    of = classes.where("core >= 0").select("cls", "core", "m").join(F.broadcast(wholes), "core")  # ALL_CORES rows at most
    edges = of.where("cls <> v").select(F.col("cls").alias("u"), "v", F.lit(None).cast("long").alias("counted"))
    return classes, edges.union(of.select("cls", F.lit(None).cast("long"), F.col("w") - F.col("m")))


def _sample(classes: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """About `most` rows of each key in sizes, by a hash of the class, so the same ones on any rerun."""
    spark = classes.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, most / n)) for k, n in sorted(sizes.items())], "key long, share double")
    place = F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return classes.withColumn("h", F.xxhash64("label", "v")).join(F.broadcast(shares), "key").where(place < F.col("share")).drop("h", "share")  # classes / leaf rows at most


def _grow(classes: DataFrame, large: dict[int, int], threshold: float, trees: int, leaf: int) -> tuple[Forest, dict[int, int]]:
    """The forest, and its leaves' counts of classes if over `leaf`. Each round splits every leaf that is too large and
    may be split, on a sample of its own, and counts anew."""
    forest, spark = Forest(), classes.sparkSession
    pending: dict[int, int] = {}
    for key in sorted(large):
        forest.roots[key] = []
    leaf_of = lambda mark: tuple(np.array([x]) for x in (0, 0.0, mark, mark))
    for key, root in zip([k for k in forest.roots for _ in range(trees)], forest.add([(leaf_of(-1), None)] * (trees * len(forest.roots))), strict=True):
        forest.roots[key].append(root)
        pending[root] = large[key]
    counts: dict[int, int] = {}
    while pending:
        shared = spark.sparkContext.broadcast((forest.state(), pending))

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, pending = Forest.of(shared.value[0]), shared.value[1]
            known: dict = {}
            for b in batches:
                for part, row, node in _routed(b, forest, threshold, known):
                    place = part.column("place").to_numpy()
                    share = np.array([min(1.0, SAMPLE / pending[n]) if n in pending else 0.0 for n in node.tolist()])
                    hit = place[row] < share
                    yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(row[hit])), pa.array(node[hit]), part.column("v").take(pa.array(row[hit]))], names=["cls", "node", "v"])

        def fit(group: pa.Table) -> pa.Table:
            node = int(group.column("node")[0].as_py())
            group = group.take(pa.array(np.argsort(group.column("cls").to_numpy(), kind="stable")))
            nodes = fit_subtree(unit_rows(_matrix(group.column("v"))), shared.value[1][node], node + 17, leaf, threshold)
            seed, at, low, high = map(list, zip(*nodes, strict=True))
            return pa.table({"node": [node] * len(nodes), "k": list(range(len(nodes))), "seed": seed, "at": at, "low": low, "high": high})

        place = F.pmod(F.xxhash64("label", "v", F.lit("place")), F.lit(1 << 30)) / float(1 << 30)
        v_type = classes.schema["v"].dataType.simpleString()
        some = classes.select("cls", "dim", "key", "v", place.alias("place")).mapInArrow(sampled, f"cls long, node long, v {v_type}")
        grown = some.groupBy("node").applyInArrow(fit, "node long, k long, seed long, at double, low long, high long").toArrow()
        columns = [grown.column(c).to_numpy() for c in ("node", "k", "seed", "at", "low", "high")]
        columns = [c[np.lexsort([columns[1], columns[0]])] for c in columns]
        names, starts = np.unique(columns[0], return_index=True)
        found = {int(n): tuple(c[lo:hi] for c in columns[2:]) for n, lo, hi in zip(names, starts, np.append(starts[1:], len(columns[0])), strict=True)}
        before = len(forest.seed)
        forest.add([(found[node] if node in found and len(found[node][0]) > 1 else leaf_of(-2), node) for node in sorted(pending)])
        counts |= {n: c for n, c in pending.items() if forest.low[n] < 0}
        counts = {n: c for n, c in counts.items() if forest.low[n] < 0} | _leaf_counts(classes, forest, before, threshold, leaf)
        pending = {n: c for n, c in counts.items() if forest.low[n] == -1 and c > 2 * leaf}
    return forest, counts


def _leaf_counts(classes: DataFrame, forest: Forest, since: int, threshold: float, leaf: int) -> dict[int, int]:
    """Classes of the leaves from number `since` on that have over `leaf`."""
    shared = classes.sparkSession.sparkContext.broadcast(forest.state())

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, known = Forest.of(shared.value), {}
        for b in batches:
            for _, _, node in _routed(b, forest, threshold, known):
                nodes, n = np.unique(node[node >= since], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    found = classes.select("dim", "key", "v").mapInArrow(routed, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {r.node: r.n for r in found.where(F.col("n") > leaf).collect()}


def _plan_blocks(classes: DataFrame, forest: Forest, large: dict[int, int], threshold: float, size: int) -> dict[int, dict]:
    """For each leaf that is too large: kind (core, earlier such leaf) -> (its first block, its blocks, blocks that its
    rows are compared with; its own are left out when they link by their core or met in the earlier leaf)."""
    if not large:
        return {}
    shared = classes.sparkSession.sparkContext.broadcast((forest.state(), large))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, large = Forest.of(shared.value[0]), shared.value[1]
        known: dict = {}
        for b in batches:
            out: dict[tuple, int] = defaultdict(int)
            for part, row, node in _routed(b, forest, threshold, known):
                cells, cores = _lists(row, node, part.num_rows), part.column("core").to_numpy()
                for r, n in zip(row.tolist(), node.tolist(), strict=True):
                    if n in large:
                        out[n, int(cores[r]), _earlier(cells[r], n, large)] += 1
            columns = list(zip(*((*k, n) for k, n in out.items()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "core", "earlier", "n"])

    counted = classes.select("dim", "key", "v", "core").mapInArrow(kinds, "node long, core long, earlier long, n long").groupBy("node", "core", "earlier").agg(F.sum("n").alias("n"))
    by_node = defaultdict(list)
    for r in sorted(counted.collect()):
        by_node[r.node].append(((r.core, r.earlier), -(-r.n // size)))
    plan = {}
    for node, found in by_node.items():
        starts = np.concatenate([[0], np.cumsum([many for _, many in found])])
        plan[node] = {}
        for (kind, many), at in zip(found, starts[:-1], strict=True):
            apart = [not _settled(kind, other) for other, _ in found]
            partners = np.concatenate([np.arange(s, s + m) for (_, m), s, ok in zip(found, starts[:-1], apart, strict=True) if ok or s == at])
            plan[node][kind] = (int(at), int(many), partners.astype(np.int64))
    return plan


def _settled(one: tuple[int, int], other: tuple[int, int]) -> bool:
    """Whether rows of two kinds link by their core, can't link, or met in an earlier leaf."""
    return (one[0] >= 0 and one[0] == other[0]) or (min(one[0], other[0]) == FAR and max(one[0], other[0]) >= 0) or (one[1] >= 0 and one[1] == other[1])


def compare_leaf(ids: np.ndarray, x: np.ndarray, m: np.ndarray, core: np.ndarray, cells: list[list[int]], node: int, own: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Edges (u, v) that join what links in a leaf, or between its two blocks, and each class's sum of links. Left out are
    pairs of one core, which are counted elsewhere, and pairs that share a leaf of a lesser number."""
    two = own.min() != own.max()
    left, right = (np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())) if two else (np.arange(len(ids)), np.arange(len(ids)))
    row = np.repeat(np.arange(len(ids)), [len(of) for of in cells])
    earlier = np.concatenate([np.array(of, np.int64) for of in cells])
    row, earlier = row[earlier < node], earlier[earlier < node]
    before, at, members = np.unique(earlier, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members > 1)  # only these are worth a column
    sharing, pairs = np.zeros((len(ids), len(shared)), np.float32), []
    several = members[at] > 1
    sharing[row[several], np.searchsorted(shared, at[several])] = 1
    sums = np.zeros(len(ids), np.int64)
    for at in range(0, len(left), BLOCK):
        part = left[at : at + BLOCK]
        hit = x[part] @ x[right].T >= threshold
        hit &= (core[part][:, None] != core[right][None, :]) | (core[part][:, None] < 0)
        if sharing.shape[1] and hit.any():
            hit &= sharing[part] @ sharing[right].T == 0
        if not two:
            hit[np.arange(len(part)), part] = False
        sums[part] += hit @ m[right]
        if two:
            sums[right] += m[part] @ hit
        pairs.append(hit)
    root = _roots(np.concatenate(pairs), left, right, len(ids))
    moved, counted = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(sums)
    return ids[moved], ids[root[moved]], ids[counted], sums[counted]


def _roots(hit: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least row of its component, by breadth first search; hit[i, j] links left[i] with right[j]."""
    root, back = np.arange(n), np.ascontiguousarray(hit.T)
    open_left, open_right = hit.any(1), hit.any(0)
    for first in np.flatnonzero(open_left):
        if not open_left[first]:
            continue
        new, members = np.array([first]), []
        open_left[first] = False
        while len(new):
            reached = np.flatnonzero(hit[new].any(0) & open_right)
            open_right[reached] = False
            members += [left[new], right[reached]]
            new = np.flatnonzero(back[reached].any(0) & open_left)
            open_left[new] = False
        members = np.concatenate(members)
        root[members] = members.min()
    return root
