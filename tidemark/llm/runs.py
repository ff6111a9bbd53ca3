"""Periodic runs in the words of a text, by branching tandem repeats in its suffix tree.

The suffix tree of a block of texts is built as a suffix array by prefix doubling, whose intervals of equal prefixes are
the tree's inner nodes. Every text has codes of its own for its words, so suffixes of different texts share nothing and
a text's suffixes end at its last word by themselves. For each node of depth D the leaf-lists of all children but the largest are traversed:
a leaf i with another leaf i + D of the node starts a tandem repeat, which is branching if the word after it differs
from the word D before. A run of exponent 4 or more shows as the branching repeat at its end whose two rotations by whole
periods before are leaves of the node as well; it is rotated to the left as far as it goes, and repeats of multiples of
a period are merged into the run of the smallest one.

Words that occur less than `exponent` times in a text, and nodes with fewer leaves than that, hold no run and are not
refined: a run holds each of its words that often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches, text_or_empty

#: A run has at least this many periods and words.
EXPONENT, LENGTH = 4, 6
#: Words whose suffix tree is built at once; a longer text is a block of its own.
BLOCK = 1 << 18

RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _doubled(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order (those that start with a word of at least `least` places) and, for each neighbouring pair, how
    many words both begin with. Groups of under `least` suffixes stay in any order, as if they had all words in common."""
    n = len(codes)
    at = np.flatnonzero(np.bincount(codes)[codes] >= least)
    order = at[np.argsort(codes[at], kind="stable")]
    m = len(order)
    rank = codes + m  # of a rare word: its code, apart from all slots
    groups = np.flatnonzero(np.concatenate([[True], codes[order[1:]] != codes[order[:-1]]])) if m else np.zeros(0, np.int64)
    sizes = np.diff(np.append(groups, m))
    rank[order] = np.repeat(groups, sizes)
    levels, step, slots = [rank], 1, np.arange(m)
    top = int(rank.max(initial=0)) + 2
    while len(slots):
        places = order[slots]
        ahead = places + step
        key = rank[places] * top + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[slots] = places
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        rank = rank.copy()
        rank[places] = np.repeat(slots[first], sizes)
        levels.append(rank)
        slots = slots[np.repeat(sizes >= least, sizes)]
        step *= 2
    left, right = order[:-1], order[1:]
    common = np.zeros(max(0, m - 1), np.int64)
    apart = np.flatnonzero((rank[left] != rank[right]) & (codes[left] == codes[right])) if m else np.zeros(0, np.int64)
    a, b, length = left[apart], right[apart], np.zeros(len(apart), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        length += (inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])).astype(np.int64) << k
    common[apart] = length
    if m:
        common[rank[left] == rank[right]] = n
    return order, common


def _nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes (first slot, last slot, depth) and the node that each boundary between slots divides (-1: the root)."""
    lows, highs, depths, owner = [], [], [], []
    open_depth, open_node = [0], [-1]
    for b, d in enumerate(common.tolist()):
        low = b
        while d < open_depth[-1]:
            open_depth.pop()
            node = open_node.pop()
            highs[node] = b
            low = lows[node]
        if d > open_depth[-1]:
            open_depth.append(d)
            open_node.append(len(lows))
            lows.append(low)
            highs.append(0)
            depths.append(d)
        owner.append(open_node[-1])
    for node in open_node[1:]:
        highs[node] = len(common)
    return tuple(np.array(x, np.int64) for x in (lows, highs, depths, owner))


def _branching(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of the branching tandem repeats that `least - 2` rotations by a period lead up to."""
    n = len(codes)
    order, common = _doubled(codes, least)
    low, high, depth, owner = _nodes(common)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = high - low + 1 >= least
    cuts = np.flatnonzero((owner >= 0) & wide[owner])
    of = owner[cuts]
    by = np.argsort(of, kind="stable")
    cuts, of = cuts[by] + 1, of[by]  # a boundary's right slot starts a child
    nodes, firsts = np.unique(of, return_index=True)
    starts, parent = np.insert(cuts, firsts, low[nodes]), np.insert(of, firsts, nodes)
    last = np.append(parent[1:] != parent[:-1], True)
    ends = np.where(last, high[parent], np.append(starts[1:], 0) - 1)
    sizes = ends - starts + 1
    heads = firsts + np.arange(len(firsts))
    largest = np.maximum.reduceat(sizes, heads) if len(heads) else sizes
    is_largest = np.flatnonzero(sizes == np.repeat(largest, np.diff(np.append(heads, len(sizes)))))
    _, one = np.unique(parent[is_largest], return_index=True)
    smaller = np.ones(len(sizes), bool)
    smaller[is_largest[one]] = False
    starts, sizes, parent = starts[smaller], sizes[smaller], parent[smaller]
    slot = np.full(n, -1, np.int64)
    slot[order] = np.arange(len(order))

    def leaf(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        s = np.where((place >= 0) & (place < n), slot[np.clip(place, 0, n - 1)], -1)
        return (s >= lo) & (s <= hi)

    found_at, found_by = [], []
    step = 1 << 20
    upto = np.cumsum(sizes)
    for k in range(0, int(upto[-1]) if len(upto) else 0, step):  # leaves in blocks
        lo, hi = np.searchsorted(upto, k, "right"), np.searchsorted(upto, k + step, "left") + 1
        kid = np.repeat(np.arange(lo, min(hi, len(sizes))), sizes[lo:hi])
        base = int(upto[lo - 1]) if lo else 0
        number = np.arange(len(kid)) + base
        chosen = (number >= k) & (number < k + step)
        kid, number = kid[chosen], number[chosen]
        place = order[starts[kid] + number - (upto[kid] - sizes[kid])]
        node = parent[kid]
        d, a, b = depth[node], low[node], high[node]
        for i, other in ((place, place + d), (place - d, place - d)):
            ok = np.flatnonzero(leaf(other, a, b))
            at, by = i[ok], d[ok]
            after = at + 2 * by
            ends_here = (after >= n) | (codes[np.minimum(after, n - 1)] != codes[at + by])
            for back in range(1, least - 1):
                ends_here &= leaf(at - back * by, a[ok], b[ok])
            found_at.append(at[ends_here])
            found_by.append(by[ends_here])
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, by = np.concatenate(found_at), np.concatenate(found_by)
    pairs = np.unique(np.stack([at + 2 * by, by], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _first_of_run(codes: np.ndarray, start: int, period: int) -> int:
    """Rotate a stretch of that period to the left as long as the words agree."""
    width = 64
    while start:
        low = max(0, start - width)
        agree = codes[low:start] == codes[low + period : start + period]
        if not agree.all():
            return start - int(np.argmin(agree[::-1]))
        start, width = low, 2 * width
    return 0


def maximal_runs(codes: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> np.ndarray:
    """(start, length, period) of all maximal runs with at least that many periods (2 or more) and words, by start, then period.

    codes are whole numbers from 0; several texts may stand one after another if they share no code."""
    codes = np.asarray(codes, np.int64)
    end, period = _branching(codes, exponent) if len(codes) else (np.zeros(0, np.int64),) * 2
    heads = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else []
    out = []
    for lo, hi in zip(heads, np.append(heads[1:], len(end)) if len(end) else []):
        stop, left = int(end[lo]), period[lo:hi]  # repeats with one end, by period
        while len(left):
            q = int(left[0])
            start = _first_of_run(codes, stop - exponent * q, q)
            if stop - start >= max(length, exponent * q):
                out.append((start, stop - start, q))
            left = left[1:]
            left = left[(left % q != 0) | (stop - exponent * left < start)]
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _of_block(texts: list[list[bytes]], exponent: int, length: int) -> tuple[list, list]:
    """Runs and collapsed text of each of a block of texts, given as words."""
    coded, first = [], 0
    for words in texts:
        codes: dict[bytes, int] = {}
        coded.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)) + first)
        first += len(codes)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    found = maximal_runs(np.concatenate(coded), exponent, length) if coded else np.zeros((0, 3), np.int64)
    of = np.searchsorted(offsets, found[:, 0], "right") - 1
    runs: list[list] = [[] for _ in texts]
    for k, (start, size, period) in zip(of.tolist(), found.tolist()):
        runs[k].append((start - int(offsets[k]), size, period))
    return runs, [_collapsed(w, r) for w, r in zip(texts, runs)]


def periodic_runs(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed (the words that no run
    repeats, joined by one space), one row per row of docs.

    A run is a stretch of words (runs of anything but ASCII white space) with smallest period q that no neighbour
    extends, of at least `exponent` periods and `length` words; a word is dropped from collapsed if a run holds it after
    its first q words. Null and empty texts have no words, no runs and an empty collapsed text. Ids may be null or
    repeated; an empty table gives an empty result; other columns are ignored. A text is one task's work, in memory that
    grows with its words; texts are taken in blocks of about `block` words. No shuffle.
    """
    bound_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at = 0
            while at < len(batch):
                group, size, start = [], 0, at
                while at < len(batch) and (not group or size < block):
                    group.append(texts[at].as_py().split())
                    size += len(group[-1])
                    at += 1
                runs, left = _of_block(group, exponent, length)
                flat = [r for one in runs for r in one]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
                columns = [ids.slice(start, at - start), pa.array([len(g) for g in group], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.select(F.col(doc_col)).schema[0].dataType.simpleString()  # of an id: a plain type
    return docs.select(F.col(doc_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(find, f"doc_id {kind}, {RUNS}")


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from some word on, for about a tenth of the ids; the others' texts as they are.

    With h the crc32 of the decimal id and g = h // 10: if 10 divides h and the text has n > 0 words, word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). Null ids and texts are left alone.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    facts = F.struct(words.alias("words"), n.alias("n"), a.alias("a"), p.alias("p"))
    # one struct in a one-element array, so that each fact is worked out once
    repeat = F.transform(F.array(facts), lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s.n - 1), lambda i: F.get(s.words, F.when(i < s.a, i).otherwise(s.a + (i - s.a) % s.p).cast("int"))), " "))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(repeat, F.lit(0))).otherwise(text)


def digests(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """periodic_runs of the planted texts as doc_id, n_words, n_runs, the longest run (ties: least start, then period; no
    run: nulls) as start, length, period and exponent_milli, and sha256 of all runs and of the collapsed text."""
    found = periodic_runs(docs.select(F.col(doc_col).alias("doc_id"), planted(F.col(doc_col), F.col(text_col)).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
