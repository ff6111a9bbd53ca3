"""SimHash near-duplicates: fingerprints, and a binary trie self-join under a Hamming budget.

Equal fingerprints are one node each, so copies cost nothing beyond an aggregate. The distinct fingerprints form a binary
trie. Its upper levels are dealt out: prefixes are deepened where many fingerprints share one, until each has few enough,
and there is one group per pair of prefixes that differ in few enough bits. In a group two subtrees are traversed together, a level at a time: each pair of nodes carries the bits in which it differs so far, goes
on to its pairs of children, and is dropped when the budget is exceeded. What a group links it joins in a union-find,
and it gives out one edge per fingerprint at most, never all pairs; a pair of nodes whose leaves are joined already is
dropped as well. Edges of all groups meet in distributed components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, text_or_empty
from .components import components

BITS, SHINGLE, BUDGET, SEED = 64, 3, 3, 42

#: Bits of the prefixes that are dealt out at first, bits that a full prefix gets besides, fingerprints from which on one is
#: full, and prefixes, about, at most: with more fingerprints prefixes hold more.
DEPTH, DEEPER, BUCKET, MOST_PREFIXES = 4, 2, 1 << 18, 1 << 11
#: Node pairs that are expanded at once.
BLOCK = 1 << 20
#: Pairs of leaves below a node pair that are compared one by one instead of splitting further.
LEAVES = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: a bit is 1 if it is in over half the hashes of word shingles, repeats included."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, runs)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """`keep` and fp (a signed long with the fingerprint's bits). Null texts count as empty: fingerprint zero."""
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, text_or_empty(text_col).cast("binary"))
    names = source.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(len(names)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*names, "fp"])

    return source.mapInArrow(run, f"{schema}, fp long")


class _Union:
    """Union-find over array positions; every parent is a root after each call."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_links(left: np.ndarray, right: np.ndarray | None, level: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what differs in at most budget bits between two subtrees, or within one if right is None.

    left, right: sorted distinct uint64; each shares its upper `level` bits. Returns (u, v) of a spanning forest.
    """
    same = right is None
    fps = left if same else np.concatenate([left, right])
    n = len(fps)
    union = _Union(n)
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(BITS - 1 - bit)) & np.uint64(1))]).astype(np.int64)
        return hi - (ones[bit][hi] - ones[bit][lo])

    a0, b0 = (0, len(left)), (0, n) if same else (len(left), n)
    start = 0 if same or not n else int(bin(int(left[0] ^ right[0]) >> (BITS - level)).count("1")) if level else 0
    for most in sorted({min(1, budget), budget}):
        if start > most:
            continue
        change = np.concatenate([[0], np.cumsum(union.root[1:] != union.root[:-1])]).astype(np.int64)
        stack = [(level, *(np.array([x], np.int64) for x in (*a0, *b0, start)))]
        while stack:
            bit, al, ah, bl, bh, diff = stack.pop()
            ends = ((ah - al) * (bh - bl) <= LEAVES) | (bit == BITS)
            if ends.any():
                _compare(fps, union, al[ends], ah[ends], bl[ends], bh[ends], most)
                al, ah, bl, bh, diff = (x[~ends] for x in (al, ah, bl, bh, diff))
            if not len(al):
                continue
            am, bm = split(al, ah, bit), split(bl, bh, bit)
            itself = (al == bl) & (ah == bh)
            near, far, once = diff <= most, diff < most, (diff < most) & ~itself
            parts = [(al, am, bl, bm, diff, near), (am, ah, bm, bh, diff, near), (al, am, bm, bh, diff + 1, far), (am, ah, bl, bm, diff + 1, once)]
            kids = [np.concatenate([p[k][p[5]] for p in parts]) for k in range(5)]
            full = (kids[1] > kids[0]) & (kids[3] > kids[2])
            kids = [x[full] for x in kids]
            if most > 1 and len(kids[0]):
                al, ah, bl, bh = kids[:4]
                joined = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (union.root[al] == union.root[bl])
                kids = [x[~joined] for x in kids]
            for at in range(0, len(kids[0]), BLOCK):
                stack.append((bit + 1, *(x[at : at + BLOCK] for x in kids)))
    moved = np.flatnonzero(union.root != np.arange(n))
    return fps[moved], fps[union.root[moved]]


def _compare(fps: np.ndarray, union: _Union, al, ah, bl, bh, most: int) -> None:
    """Compare all leaves of node pairs that have few, a block at a time."""
    sizes = (ah - al) * (bh - bl)
    for at in range(0, len(al), BLOCK // LEAVES):
        s = slice(at, at + BLOCK // LEAVES)
        of = np.repeat(np.arange(len(al[s])), sizes[s])
        k = np.arange(len(of)) - np.repeat(np.cumsum(sizes[s]) - sizes[s], sizes[s])
        width = (bh[s] - bl[s])[of]
        i, j = al[s][of] + k // width, bl[s][of] + k % width
        hit = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= most)
        union.link(i[hit], j[hit])


def prefixes(distinct: DataFrame, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Depths and values (bits from the top) of prefixes that cover all fingerprints, none with over about `bucket` of
    them: the full ones are counted anew with more bits, round by round."""
    depth, full, out = DEPTH, None, []
    while True:
        value = F.shiftrightunsigned("fp", BITS - depth)
        some = distinct if full is None else distinct.where(F.shiftrightunsigned("fp", BITS - depth + DEEPER).isin(full))
        counts = {r[0]: r[1] for r in some.groupBy(value).count().collect()}
        if full is None:
            bucket = max(bucket, sum(counts.values()) // MOST_PREFIXES)
        full = [p for p, n in counts.items() if n > bucket and depth < BITS - DEEPER]
        out += [(depth, p) for p in counts if p not in set(full)]
        if not full:
            break
        depth += DEEPER
    out.sort()
    return np.array([d for d, _ in out], np.int64), np.array([p for _, p in out], np.uint64)


def prefix_pairs(depths: np.ndarray, values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i <= j, of prefixes whose common length differs in at most budget bits; the others are pruned here."""
    first, second = [], []
    for i, (d, p) in enumerate(zip(depths, values, strict=True)):
        common = np.minimum(d, depths[i:])
        apart = (p >> (d - common).astype(np.uint64)) ^ (values[i:] >> (depths[i:] - common).astype(np.uint64))
        j = i + np.flatnonzero(np.bitwise_count(apart) <= budget)
        first.append(np.full(len(j), i))
        second.append(j)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, int), np.zeros(0, int))


def links(distinct: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that join all within the budget and nothing else."""
    depths, values = prefixes(distinct, bucket)
    first, second = prefix_pairs(depths, values, budget)
    order = np.argsort(np.concatenate([first, second]), kind="stable")
    keep = order[(order < len(first)) | (first[order - len(first)] != second[order - len(first)])]  # a pair of one with itself once
    of, pair, side = np.concatenate([first, second])[keep], keep % max(1, len(first)), keep // max(1, len(first))
    starts = np.searchsorted(of, np.arange(len(depths) + 1))
    shared = distinct.sparkSession.sparkContext.broadcast((depths, values, first, second, pair, side, starts))  # MOST_PREFIXES prefixes, some hundred pairs each

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths, values, _, _, pair, side, starts = shared.value
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            at = np.full(len(fps), -1)
            for depth in np.unique(depths):
                here = np.flatnonzero(depths == depth)
                top = fps >> np.uint64(BITS - depth)
                k = np.minimum(np.searchsorted(values[here], top), len(here) - 1)
                at = np.where(values[here][k] == top, here[k], at)
            many = starts[at + 1] - starts[at]
            for lo in range(0, len(fps), 4096):  # what is handed on at once stays small
                n = many[lo : lo + 4096]
                row = np.repeat(np.arange(lo, lo + len(n)), n)
                k = starts[at[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(fps[row].view(np.int64)), pa.array(pair[k]), pa.array(side[k])], names=["fp", "pair", "side"])

    def join(group: pa.Table) -> pa.Table:
        depths, _, first, second, *_ = shared.value
        key = int(group.column("pair")[0].as_py())
        fps, right = group.column("fp").to_numpy().view(np.uint64), group.column("side").to_numpy() == 1
        level = int(min(depths[first[key]], depths[second[key]]))
        if first[key] == second[key]:
            u, v = trie_links(np.sort(fps), None, level, budget)
        else:
            u, v = trie_links(np.sort(fps[~right]), np.sort(fps[right]), level, budget) if right.any() and not right.all() else (fps[:0], fps[:0])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "fp long, pair long, side long").groupBy("pair").applyInArrow(join, "u long, v long")


def _classes(fps: DataFrame, budget: int) -> DataFrame:
    """(fp, ...) -> (fp, root), one row for each distinct fingerprint."""
    distinct = cut(fps.select("fp").distinct())
    found = components(links(distinct, budget)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links), one row per row of docs.

    Null and empty texts have fingerprint zero, linked like any other. A null id is never the least; a component of
    null ids alone has a null component_id. Repeated rows are rows of their own; an empty table gives an empty result;
    other columns are ignored.
    """
    fps = cut(fingerprints(docs, [F.col(doc_col).alias("doc_id")], text_col))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = cut(_classes(firsts, budget).join(firsts, "fp"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(roots.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One document of each component, the one with the least id (null last, then by its text's hash); docs' columns.

    Of rows that repeat an id and a text one stays. Whole rows are shuffled once, by 128 bits of hashes of id and text.
    Columns of any names are carried along as they are.
    """
    identity = [F.xxhash64(doc_col, text_or_empty(text_col)).alias("h1"), F.xxhash64(F.lit(1), F.col(doc_col), text_or_empty(text_col)).alias("h2")]
    fps = cut(fingerprints(docs, [F.col(doc_col).alias("id"), *identity], text_col))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2"))
    firsts = fps.groupBy("fp").agg(best.alias("first"))
    kept = cut(_classes(firsts, budget).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *identity)
    return rows.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")
