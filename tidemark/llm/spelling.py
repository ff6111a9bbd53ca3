"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word padded by two marks on both sides has its length + 2 positional trigrams. One edit destroys three of them at
most, so near words share all but three, at positions that differ by the shift of the edit (0 or 1). Grams are put in
one order for all words, rare ones first. Then the first two grams that a near pair shares are among the first
five of both, the first of them among the first four.

Words are dealt by each of their first four grams and by length (a word of length L meets L - 1, L and L + 1), so the
postings of one gram and one pair of lengths are one group. In a group the postings of a second gram are merged, sorted
by gram and position; what meets in both lists passes the count filter (shared positional grams at least those that an
edit leaves) and is verified letter by letter. A pair is counted where its first two shared grams meet, so once. A
group gives a count and the best neighbour for each word, never pairs. Postings lists of over HOT words are cut into
blocks, each pair of blocks a group of its own.

Merging is done on sorted arrays, a block of postings at a time, and not with a heap item by item: the same lists
in the same order, without a Python step for each posting.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, stored, text_or_empty

#: Letters of a word: ASCII and U+00C0 to U+00FF; only A-Z are lower-cased.
LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
#: One in so many pairs of id and word loses a letter.
TYPO = 97
LEAST_LENGTH, LEAST_COUNT, LEADS = 5, 3, 2

Q, EDITS = 3, 1
FIRST = Q * EDITS + 1  # of these grams one at least is shared
#: Codes of letters: 0 is the padding, then a-z and U+00C0 to U+00FF.
ALPHABET = 91
#: Words of one postings list from which on it is cut into blocks, and dealt rows that one task holds, about.
HOT, ROWS = 1 << 16, 1 << 18
#: Candidates and letters that are looked at together.
CANDIDATES, CELLS = 1 << 18, 1 << 22

_CODE = np.zeros(256, np.int32)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[0xC0:] = np.arange(27, 91)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _typo(doc: str, word: str) -> str:
    h = zlib.crc32(f"{doc}:{word}".encode())
    return word if h % TYPO else word[: h % len(word)] + word[h % len(word) + 1 :]


def vocabulary(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", typos: bool = False, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with at least that many letters and occurrences.

    Words are maximal runs of Latin letters, A-Z lower-cased. With typos, a word whose crc32 of `<id>:<word>` is divisible
    by 97 lacks the letter crc32 % length wherever that document has it (null ids: none). Counts are summed in each
    batch before they are shuffled.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                of_doc: Counter = Counter()
                for word, n in Counter(LETTERS.findall(text.as_py())).items():
                    of_doc[word.lower() if word.isascii() else word.translate(_LOWER)] += n
                for word, n in of_doc.items():
                    total[_typo(doc, word) if typos and doc is not None else word] += n
            words = [w for w in total if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(doc_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letters(words: list[str], length: int) -> np.ndarray:
    """Codes of words of one length, a row each."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(-1, length)


def _grams(letters: np.ndarray) -> np.ndarray:
    padded = np.pad(letters, ((0, 0), (Q - 1, Q - 1)))
    return (padded[:, :-2] * ALPHABET + padded[:, 1:-1]) * ALPHABET + padded[:, 2:]


def _of_one_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and the indices of words that have them, in pieces of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, CELLS // (length + 2))
        for lo in range(0, len(at), step):
            yield length, at[lo : lo + step]


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each gram in the order, rare ones first. There are 91 ** 3 of them at most, so they are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, texts = np.zeros(ALPHABET**3, np.int64), batch.column(0).to_pylist()
            for length, at in _of_one_length(texts):
                total += np.bincount(_grams(_letters([texts[i] for i in at], length)).ravel(), minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    counts = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(ALPHABET**3, np.int64)
    total[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    ranks = np.empty(len(total), np.int32)
    ranks[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.int32)
    return ranks


def _first_grams(letters: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order and positions of the first five grams of each word."""
    of = ranks[_grams(letters)]
    at = np.argsort(of, axis=1, kind="stable")[:, : FIRST + 1]
    return np.take_along_axis(of, at, 1), at


def _meet(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of equal keys of a and b, some at a time."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    upto = np.cumsum(hi - lo)
    at = 0
    while at < len(a):
        base = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, base + CANDIDATES, "right")))
        many = (hi - lo)[at:end]
        i = np.repeat(np.arange(at, end), many)
        k = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        yield i, order[lo[i] + k]
        at = end


def _near_in(short: tuple, long: tuple, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of postings of one gram's list: words of one length (shift 0), or with a letter more on the long side
    (shift 1). Each side is (letters, gram places, positions, index of the gram that the row was dealt by, list)."""
    if not len(short[0]) or not len(long[0]):
        return
    length = short[0].shape[1]
    grams = length + Q - 1

    def postings(side: tuple) -> tuple[np.ndarray, ...]:
        """One row for each posting of a second gram: row, first gram's index, second's, and both with list and position."""
        letters, of, at, k, group = side
        rows, first, second = [], [], []
        for x in range(FIRST):
            for y in range(x + 1, FIRST + 1):
                here = np.flatnonzero(k == x)
                rows.append(here), first.append(np.full(len(here), x)), second.append(np.full(len(here), y))
        rows, first, second = map(np.concatenate, (rows, first, second))
        return rows, first, second, group[rows], of[rows, second].astype(np.int64), at[rows, first], at[rows, second]

    left, right = postings(short), postings(long)
    for d1, d2 in ((0, 0),) if not shift else ((0, 0), (1, 1), (0, 1), (1, 0)):
        lists, seconds = np.unique(np.concatenate([left[3], right[3]]), return_inverse=True)[1], np.concatenate([left[4], right[4]])
        firsts, places = np.concatenate([left[5] + d1, right[5]]), np.concatenate([left[6] + d2, right[6]])
        a = np.unique(lists.astype(np.int64) * (grams + 2) + firsts, return_inverse=True)[1]
        b = np.unique(seconds * (grams + 2) + places, return_inverse=True)[1]
        key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
        for p, r in _meet(key[: len(left[0])], key[len(left[0]) :]):
            i, j = left[0][p], right[0][r]
            step = max(1, CELLS // (length + 2))
            for lo in range(0, len(i), step):
                s = slice(lo, lo + step)
                x, y, f, g = i[s], j[s], left[1][p[s]], left[2][p[s]]
                u, v = short[0][x], long[0][y]
                same = u == v[:, :length]
                if shift:
                    moved = u == v[:, 1:]
                    shared = _runs_of(same) | _runs_of(moved, back=True)
                    # grams left of the edit at their place, grams right of it one further on
                    e = np.where(same.all(1), length, np.argmin(same, axis=1))
                    tail = np.arange(length)[None, :] >= e[:, None]
                    near = (moved | ~tail).all(1) & (shared.sum(1) >= grams + 1 - Q)
                    gone = 2
                else:
                    shared = _runs_of(same)
                    near = ((~same).sum(1) == 1) & (shared.sum(1) >= grams - Q)
                    e, gone = np.argmin(same, axis=1), 3
                hit = np.flatnonzero(near)
                x, y, f, g, e = x[hit], y[hit], f[hit], g[hit], e[hit]
                at = short[2][x]
                kept = (at < e[:, None]) | (at >= e[:, None] + gone)
                number = np.cumsum(kept, axis=1)
                row = np.arange(len(x))
                here = kept[row, f] & kept[row, g] & (number[row, f] == 1) & (number[row, g] == 2)
                here &= ((at[row, f] >= e) == d1) & ((at[row, g] >= e) == d2) if shift else True
                yield x[here], y[here]


def _runs_of(same: np.ndarray, back: bool = False) -> np.ndarray:
    """Which grams of the padded words agree, given which letters do; with back, grams right of an edit only need the
    right padding, else both."""
    padded = np.pad(same, ((0, 0), (Q - 1, Q - 1)), constant_values=True)
    if back:
        padded[:, : Q - 1] = False
    return padded[:, :-2] & padded[:, 1:-1] & padded[:, 2:]


def _best(best: dict, word: int, other: int, words: list[str], n: np.ndarray) -> None:
    old = best.get(word)
    if old is None or (n[other], words[old]) > (n[old], words[other]):
        best[word] = other


def near_words(words: DataFrame, *, hot: int = HOT, rows: int = ROWS) -> DataFrame:
    """Distinct words (word, n) -> word, n_near, near, near_n: for each word with a near one how many there are, and the
    one of largest n (ties: smallest in code-point order). words are read several times: give a stored table.

    Words are of Latin letters and at least three letters long, two near if one inserted, deleted or replaced letter
    makes one of the other.
    """
    ranks = words.sparkSession.sparkContext.broadcast(gram_ranks(words))

    def keys(texts: list[str]) -> tuple[np.ndarray, ...]:
        """Row of the word, window of lengths (the lower), gram and its index, for each place a word is dealt to."""
        out = []
        for length, at in _of_one_length(texts):
            of, _ = _first_grams(_letters([texts[i] for i in at], length), ranks.value)
            for k in range(FIRST):
                for window in (length - 1, length):
                    out.append((at, np.full(len(at), window), of[:, k], np.full(len(at), k)))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(4))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, window, gram, _ = keys(batch.column(0).to_pylist())
            both, n = np.unique(window.astype(np.int64) * ALPHABET**3 + gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], names=["list", "n"])

    sizes = cut(words.select("word").mapInArrow(lists, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # cut lists: total / hot of them at most, so their table stays small
    long = {r["list"]: -(-r["n"] // hot) for r in sizes.where(F.col("n") > max(hot, total >> 20)).collect()}
    slots, blocks = max(1, total // rows), words.sparkSession.sparkContext.broadcast(long)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            row, window, gram, k = keys(texts)
            both = window.astype(np.int64) * ALPHABET**3 + gram
            slot, side, part = (both * 2654435761 % (1 << 31)) % slots, np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
            if blocks.value and len(both):
                cut_up = np.isin(both, np.fromiter(blocks.value, np.int64))
                extra = []
                for x in np.flatnonzero(cut_up).tolist():
                    many = blocks.value[int(both[x])]
                    mine = zlib.crc32(texts[row[x]].encode()) % many
                    for other in range(many):
                        a, b = min(mine, other), max(mine, other)
                        extra.append((x, -1 - (a * many + b), mine))
                x = np.array(extra, np.int64).reshape(-1, 3)
                take = np.concatenate([np.flatnonzero(~cut_up), x[:, 0]])
                slot, side = np.concatenate([slot[~cut_up], both[x[:, 0]]]), np.concatenate([side[~cut_up], x[:, 1]])
                part = np.concatenate([part[~cut_up], x[:, 2]])
                row, window, both, k = row[take], window[take], both[take], k[take]
            step = 1 << 16
            for lo in range(0, len(row), step):
                s = slice(lo, lo + step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window[s]), pa.array(slot[s]), pa.array(side[s]), pa.array(part[s]), pa.array(both[s]), pa.array(k[s]), pa.array([texts[i] for i in row[s]], pa.string()), pa.array(n[row[s]])],
                    names=["window", "slot", "side", "part", "list", "k", "word", "n"],
                )

    def join(group: pa.Table) -> pa.Table:
        texts, n = group.column("word").to_pylist(), group.column("n").to_numpy()
        part, of_list, k = (group.column(c).to_numpy() for c in ("part", "list", "k"))
        window, crossing = int(group.column("window")[0].as_py()), group.column("side")[0].as_py() < 0 and len(np.unique(part)) > 1
        sides = []
        for length in (window, window + 1):
            at = np.array([i for i, w in enumerate(texts) if len(w) == length], np.int64)
            letters = _letters([texts[i] for i in at], length)
            sides.append((at, letters, *(_first_grams(letters, ranks.value) if len(at) else (np.zeros((0, 5), int),) * 2), k[at], of_list[at]))
        count: Counter = Counter()
        best: dict = {}
        # pairs of one length belong to the window that starts with it
        for a, b, shift in ((sides[0], sides[0], 0), (sides[0], sides[1], 1)):
            for x, y in _near_in(a[1:], b[1:], shift):
                i, j = a[0][x], b[0][y]
                if crossing:
                    apart = part[i] != part[j]
                    i, j = i[apart], j[apart]
                for p, q in zip(i.tolist(), j.tolist()):
                    count[texts[p]] += 1
                    _best(best, texts[p], q, texts, n)
                    if shift:  # both directions of one length are found as pairs of their own
                        count[texts[q]] += 1
                        _best(best, texts[q], p, texts, n)
        found = list(count)
        near = [best[w] for w in found]
        return pa.table({"word": pa.array(found, pa.string()), "n_near": pa.array([count[w] for w in found], pa.int64()), "near": pa.array([texts[i] for i in near], pa.string()), "near_n": pa.array(n[near] if near else [], pa.int64())})

    parts = words.select("word", "n").mapInArrow(deal, "window long, slot long, side long, part long, list long, k long, word string, n long")
    parts = parts.groupBy("window", "slot", "side").applyInArrow(join, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the end of the chain of forms. Counts double with each step of a chain, so chains are
    short; each round of joins halves what is left of them."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            return at
        at = moved.select("word", "root")


def variants(words: DataFrame, *, leads: int = LEADS) -> DataFrame:
    """word, n -> word, form, root, n, n_near, form_n: a word's form is its near word of largest n if that is at least
    `leads` (over 1) times the word's own n, else null; root is where forms lead to in the end.

    Words are distinct and not null. An empty table gives an empty result.
    """
    words = stored(words)
    near = near_words(words)
    led = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("near_n") >= leads * F.col("n"), F.struct("near", "near_n")).alias("f")))
    led = led.select("word", F.col("f.near").alias("form"), "n", "n_near", F.col("f.near_n").alias("form_n"))
    roots = _roots(led.where("form is not null"))
    return led.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
