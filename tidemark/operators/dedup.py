"""Duplicates of adverts: exact by URL, near by a range join, greedy elimination by rounds; the guarded insert."""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..sources.shared import cut
from ..sources.tables import small_side

KM, PRICE = 1000, 0.05
_WIDTH = log((1 + PRICE / 2) / (1 - PRICE / 2))
BLOCK = ("brand_norm", "model_norm", "year")
PLACE = (*BLOCK, "mileage_km", "price")
#: Sources in order of preference; unknown ones come last.
SOURCES = ("src0", "src1", "src2", "src3")


def near(a: str, b: str) -> Column:
    """Whether two adverts of a block are the same car: mileage within KM, prices within PRICE of their mean."""
    p, q = F.col(f"{a}.price"), F.col(f"{b}.price")
    return (F.abs(F.col(f"{a}.mileage_km") - F.col(f"{b}.mileage_km")) <= KM) & (F.abs(p - q) / F.greatest((p + q) / 2, F.lit(1.0)) <= PRICE)


#: Cells around one that have not looked at it themselves: with its own, half of its neighbourhood.
FORWARD = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def close_pairs(cars: DataFrame, key: str, *more: str) -> DataFrame:
    """Each near pair of cars once, as a.* and b.* with key, BLOCK, mileage_km, price and more, in no certain order.

    Mileage and price are cut into cells as wide as the tolerance. One side looks into its own cell and into four of the
    eight around it, so a popular model is many small equi-joins and a pair meets in one cell only."""
    cells = _cells(cars, key, *more)
    looks = cells.withColumn("_look", F.explode(F.array(*[F.struct(F.lit(k).alias("km"), F.lit(p).alias("price")) for k, p in FORWARD])))
    looks = looks.withColumns({"own": (F.col("_look.km") == 0) & (F.col("_look.price") == 0), "km_cell": F.col("km_cell") + F.col("_look.km"), "price_cell": F.col("price_cell") + F.col("_look.price")})
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*BLOCK, "km_cell", "price_cell")]
    once = ~F.col("a.own") | (F.col(f"a.{key}") < F.col(f"b.{key}"))
    return looks.drop("_look").alias("a").join(cells.alias("b"), [*on, once, near("a", "b")])


def near_pairs(listings: DataFrame) -> DataFrame:
    """(a_id, b_id) with a_id < b_id of near duplicates."""
    a, b = F.col("a.portal_id"), F.col("b.portal_id")
    return close_pairs(listings, "portal_id").where(a != b).select(F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id"))


def near_sources(cars: DataFrame, listings: DataFrame) -> DataFrame:
    """portal_id, n_portals for those of cars that have near duplicates: how many other sources they are from."""
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*BLOCK, "km_cell", "price_cell")]
    met = _probe(cars, "source_portal").join(_cells(listings, "portal_id", "source_portal").alias("b"), [*on, F.col("a.source_portal") != F.col("b.source_portal"), near("a", "b")])
    return met.groupBy(F.col("a.portal_id").alias("portal_id")).agg(F.count_distinct("b.source_portal").alias("n_portals"))


def _cells(listings: DataFrame, *more: str) -> DataFrame:
    slim = listings.select(*BLOCK, "mileage_km", "price", *more)
    return slim.withColumns({"km_cell": F.floor(F.col("mileage_km") / KM), "price_cell": _price_cell(F.col("price"))})


def _price_cell(price: Column) -> Column:
    """Cells by the logarithm from 1 on and by the difference below, a hair wider than the tolerance: near prices are in the same
    or in adjacent ones, and prices of one cell are near but for that hair."""
    return F.when(price >= 1, F.floor(F.log(price) / (_WIDTH * (1 + 1e-9)))).otherwise(F.floor((price - 1) / (PRICE * (1 + 1e-9))))


def _probe(listings: DataFrame, *more: str) -> DataFrame:
    """Each advert in its own and the neighbouring cells."""
    cells = _cells(listings, "portal_id", *more)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        cells.withColumn("km_cell", F.explode(F.transform(around, lambda d: F.col("km_cell") + d)))
        .withColumn("price_cell", F.explode(F.transform(around, lambda d: F.col("price_cell") + d)))
        .alias("a")
    )


#: Distinct adverts, about, that a task of near counts takes at once.
COUNTED = 100_000


def _below(level: np.ndarray, weight: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (left, right, bound): the weight of positions left .. right - 1 whose level is less than bound. A wavelet
    matrix: one stable partition of the positions for each bit of the levels."""
    ends, sums = [tuple(e) for e in ends], [np.zeros(len(e[0]), np.int64) for e in ends]
    most = max(int(level.max(initial=0)), *(int(e[2].max(initial=0)) for e in ends))
    for b in reversed(range(most.bit_length())):
        low = (level >> b & 1) == 0
        zeros, weights = np.concatenate([[0], np.cumsum(low)]), np.concatenate([[0], np.cumsum(np.where(low, weight, 0))])
        for k, (left, right, bound) in enumerate(ends):
            up, l0, r0 = bound >> b & 1 == 1, zeros[left], zeros[right]
            sums[k] += np.where(up, weights[right] - weights[left], 0)
            ends[k] = (np.where(up, zeros[-1] + left - l0, l0), np.where(up, zeros[-1] + right - r0, r0), bound)
        order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        level, weight = level[order], weight[order]
    return sums


def _near_price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.abs(p - q) / np.maximum((p + q) / 2, 1.0) <= PRICE


def _reach(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending prices q the first that is near each p, and the first behind those; found about and then moved by the very
    test of near."""
    share, n = (1 - PRICE / 2) / (1 + PRICE / 2), len(q)
    left = np.searchsorted(q, np.minimum(p * share, p - PRICE))
    right = np.maximum(np.searchsorted(q, np.maximum(p / share, p + PRICE)), left)
    padded = np.append(q, np.nan)  # near nothing
    for at, step, moves in ((left, -1, lambda i: (i > 0) & _near_price(p, padded[i - 1])), (left, 1, lambda i: (i < n) & (padded[np.minimum(i, n)] <= p) & ~_near_price(p, padded[np.minimum(i, n)])),
                            (right, 1, lambda i: (i < n) & _near_price(p, padded[np.minimum(i, n)])), (right, -1, lambda i: (i > 0) & (padded[i - 1] > p) & ~_near_price(p, padded[i - 1]))):
        while (move := moves(at)).any():
            at[move] += step
    return left, np.maximum(right, left)


def _count_near(rows: pa.Table) -> pa.Table:
    """A bucket's distinct adverts (mine and those just beyond its ends), each n times -> for mine how many adverts are near,
    itself included, and how many sources they are from."""
    block, km, price, n, mine = (rows[c].to_numpy() for c in ("block", "mileage_km", "price", "n", "mine"))
    named = rows["source_portal"].combine_chunks().dictionary_encode()
    source = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    near, sources = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    order = np.lexsort((price, block))
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        ask = part[mine[part]]
        if not len(ask):
            continue
        levels = np.unique(km[part])
        low, high = np.searchsorted(levels, km[ask] - KM), np.searchsorted(levels, km[ask] + KM, "right")
        for s in np.unique(source[part]):
            of = part[source[part] == s]
            left, right = _reach(price[ask], price[of])
            less, more = _below(np.searchsorted(levels, km[of]), n[of], [(left, right, low), (left, right, high)])
            near[ask] += more - less
            if s >= 0:
                sources[ask] += more - less > (source[ask] == s)  # an advert is no near one of itself
    out = rows.select([*PLACE, "source_portal"]).append_column("near", pa.array(near)).append_column("n_portals", pa.array(sources))
    return out.filter(pa.array(mine))


def _in_tiles(cells: DataFrame, counted: int) -> DataFrame:
    """cells (block, km_cell, price_cell) with _tiles: first the one of a row, which holds about `counted` rows, whole blocks or a
    part of one as wide as a cell at least, then those whose ends the row is within a cell of."""
    sizes = cells.groupBy(F.col("block").alias("_b")).agg(F.count("*").alias("_n"), F.min("km_cell").alias("_k0"), F.min("price_cell").alias("_p0"), (F.max("km_cell") - F.min("km_cell") + 1).alias("_k"), (F.max("price_cell") - F.min("price_cell") + 1).alias("_p"))
    tiles = F.ceil(F.col("_n") / counted)
    by_price = F.least(tiles, F.col("_p"))
    large = sizes.where(F.col("_n") > counted).select("_b", "_k0", "_p0", F.ceil(F.col("_p") / by_price).alias("_pw"), F.ceil(F.col("_k") / F.least(F.ceil(tiles / by_price), F.col("_k"))).alias("_kw"))
    at = cells.join(cut(large), F.col("block") == F.col("_b"), "left")

    def tile(k: int, p: int) -> Column:
        return F.xxhash64("block", F.floor((F.col("km_cell") + k - F.col("_k0")) / F.col("_kw")), F.floor((F.col("price_cell") + p - F.col("_p0")) / F.col("_pw")))

    buckets = max(1, cells.count() // counted)
    whole = F.array(F.pmod(F.col("block"), F.lit(buckets)))
    found = F.when(F.col("_b").isNull(), whole).otherwise(F.array_distinct(F.array(*[tile(k, p) for k, p in [(0, 0), *((k, p) for k in (-1, 0, 1) for p in (-1, 0, 1) if k or p)]])))
    return at.withColumn("_tiles", found).drop("_b", "_k0", "_p0", "_pw", "_kw")


def _near_counts(points: DataFrame, counted: int = COUNTED) -> DataFrame:
    """points (PLACE, source_portal, n): adverts of one place and source as one row -> PLACE, source_portal, near, n_portals.

    No pair is written down: a task takes whole blocks, about `counted` points, sorts each by price and counts ranges of
    price and mileage. A block with more points is cut into tiles of cells, and a point is copied to the tiles whose ends
    it is within a cell of.
    """
    cells = cut(points.withColumns({"block": F.xxhash64(*BLOCK), "km_cell": F.floor(F.col("mileage_km") / KM), "price_cell": _price_cell(F.col("price"))}))
    at = _in_tiles(cells, counted)
    spread = at.select(*PLACE, "source_portal", "n", "block", F.posexplode("_tiles").alias("_at", "tile")).select("*", (F.col("_at") == 0).alias("mine"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*PLACE, "source_portal").schema) + ", near long, n_portals long"
    return spread.groupBy("tile").applyInArrow(_count_near, schema)


def _places(listings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adverts with a place, its price as double; the distinct (PLACE, source_portal, n) among them; ids that are repeated."""
    rows = listings.select("portal_id", *BLOCK, "mileage_km", F.col("price").cast("double").alias("price"), "source_portal")
    rows = rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in PLACE]) & (F.abs("price") < float("inf")))
    repeated = cut(rows.groupBy("portal_id").agg(F.count("*").alias("n")).where("n > 1").select("portal_id"))
    return rows, rows.groupBy(*PLACE, "source_portal").agg(F.count("*").alias("n")), repeated


def near_portals(listings: DataFrame) -> DataFrame:
    """portal_id, n_near, n_portals: near duplicates of each advert that has any, and the sources they are from."""
    rows, points, repeated = _places(listings)
    counts = cut(_near_counts(points)).where("near > 1").withColumnsRenamed({c: f"_{c}" for c in (*PLACE, "source_portal")})
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in PLACE]) & F.col("source_portal").eqNullSafe(F.col("_source_portal"))
    once = rows if repeated.isEmpty() else rows.join(repeated, "portal_id", "left_anti")
    found = once.join(counts, same).select("portal_id", (F.col("near") - 1).alias("n_near"), "n_portals")
    if repeated.isEmpty():
        return found
    # rows of one id are not near ones of each other, so the few that are repeated are met one by one
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*BLOCK, "km_cell", "price_cell")]
    met = _probe(rows.join(repeated, "portal_id", "left_semi")).join(_cells(rows, "portal_id", "source_portal").alias("b"), [*on, F.col("a.portal_id") != F.col("b.portal_id"), near("a", "b")])
    return found.unionByName(met.groupBy(F.col("a.portal_id").alias("portal_id")).agg(F.count("*").alias("n_near"), F.count_distinct("b.source_portal").alias("n_portals")))


def near_links(listings: DataFrame) -> DataFrame:
    """portal_id, class_id, n_near, a row per advert: the least id of those of the same place (block, mileage and price), itself
    included, and how many adverts of other ids are near. One without a place is a class of its own."""
    rows, _, repeated = _places(listings)
    points = cut(rows.groupBy(*PLACE).agg(F.count("*").alias("n"), F.min("portal_id").alias("class_id")))
    counts = _near_counts(points.select(*PLACE, F.lit(None).cast("string").alias("source_portal"), "n"))
    facts = cut(points.join(counts.select(*PLACE, "near"), [*PLACE])).select(*[F.col(c).alias(f"_{c}") for c in PLACE], "class_id", "near")
    met = listings.select("portal_id", *BLOCK, "mileage_km", F.col("price").cast("double").alias("price")).join(facts, reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in PLACE]), "left")
    same = F.lit(1)
    if not repeated.isEmpty():  # rows of one id are not near ones of each other
        twice = rows.join(repeated, "portal_id", "left_semi").groupBy("portal_id", *PLACE).agg(F.count("*").alias("m"))
        on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("portal_id", *BLOCK)]
        own = twice.alias("a").join(twice.alias("b"), [*on, near("a", "b")]).groupBy("a.portal_id", *[f"a.{c}" for c in PLACE]).agg(F.sum("b.m").alias("own"))
        met, same = met.join(own, ["portal_id", *PLACE], "left"), F.coalesce("own", F.lit(1))
    return met.select("portal_id", F.coalesce("class_id", "portal_id").alias("class_id"), F.coalesce(F.col("near") - same, F.lit(0)).alias("n_near"))


def source_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), c), F.lit(0)) + F.when(c.isin(*SOURCES), 0).otherwise(len(SOURCES) + 1)


def preference() -> list[Column]:
    """Better source, known power, cheaper, newer, then the id."""
    return [source_rank(F.col("source_portal")), F.desc(F.coalesce(F.col("power_hp") > 0, F.lit(False))), F.col("price"), F.desc("updated_at"), F.col("portal_id")]


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def _order() -> Column:
    return F.struct(source_rank(F.col("source_portal")).alias("s"), (~F.coalesce(F.col("power_hp") > 0, F.lit(False))).alias("p"), F.col("price").alias("c"), (-F.unix_micros("updated_at")).alias("t"), F.col("portal_id").alias("id"))


def first_independent(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges (first, then): two nodes that exclude each other, the better one as first -> the nodes (then) that are dropped
    when, in order, each node is kept unless one kept before it excludes it; and the rounds that it took.

    This is the lexicographically first maximal independent set. In a round each node without a better undecided neighbour
    is kept, and its neighbours are dropped; the rest goes on. Rounds grow with the longest chain of nodes that wait for
    each other, which for orders unrelated to the edges is about the logarithm of the nodes; each is cut from its lineage.
    """
    left, dropped, rounds = cut(edges.select("first", "then").distinct()), [], 0
    while not left.isEmpty():
        free = left.select("first").distinct().join(left.select(F.col("then").alias("first")).distinct(), "first", "left_anti")
        gone = cut(left.join(free, "first", "left_semi").select("then").distinct())
        left = left.join(gone, "then", "left_anti").join(gone.select(F.col("then").alias("first")), "first", "left_anti")
        left = cut(left.join(free, "first", "left_anti"))
        dropped.append(gone)
        rounds += 1
    none = edges.select("then").limit(0)
    return reduce(DataFrame.unionByName, dropped, none), rounds


def _around(cells: DataFrame, own: bool = True) -> DataFrame:
    """Rows with km_cell and price_cell, once for each of the cells around (and, with own, their own)."""
    offsets = [F.struct(F.lit(k).alias("km"), F.lit(p).alias("price")) for k in (-1, 0, 1) for p in (-1, 0, 1) if own or k or p]
    looks = cells.withColumn("_look", F.explode(F.array(*offsets)))
    return looks.withColumns({"km_cell": F.col("km_cell") + F.col("_look.km"), "price_cell": F.col("price_cell") + F.col("_look.price")}).drop("_look")


_CELL = (*BLOCK, "km_cell", "price_cell")


#: Adverts, about, that a task of greedy decides at once, and those of a block up to which one task decides all of it.
DECIDED, WHOLE = 50_000, 400_000


def _steps(cells: np.ndarray) -> np.ndarray:
    """Cells numbered anew from 1 on: adjacent ones stay adjacent, and no others become so."""
    values, at = np.unique(cells, return_inverse=True)
    return np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(values), 2).astype(np.int64))])[at]


def _cell_numbers(block: np.ndarray, km: np.ndarray, price: np.ndarray) -> tuple[list[int], list[int]]:
    """A number for each advert's cell (as _cells), and what is to be added to it for the nine cells around and itself."""
    with np.errstate(all="ignore"):
        of_price = np.where(price >= 1, np.floor(np.log(price) / (_WIDTH * (1 + 1e-9))), np.floor((price - 1) / (PRICE * (1 + 1e-9))))
    by_km, by_price = _steps(np.floor_divide(km, KM)), _steps(of_price)
    rows, columns = int(by_km.max(initial=0)) + 2, int(by_price.max(initial=0)) + 2
    cell = (np.unique(block, return_inverse=True)[1].astype(np.int64) * rows + by_km) * columns + by_price
    return cell.tolist(), [k * columns + p for k in (-1, 0, 1) for p in (-1, 0, 1)]


def _go_through(block: np.ndarray, km: np.ndarray, price: np.ndarray, known: list[bool], mine: list[bool]) -> list[int]:
    """Places in order -> for each the first kept one that is near (itself if it is kept), or -1 if that is still open: one that
    is not mine may have better ones elsewhere, and one may wait for such. known: those kept for certain."""
    (cell, around), kept, waiting, out = _cell_numbers(block, km, price), {}, {}, []
    kms, prices = km.tolist(), price.tolist()
    for i, (c, k, p) in enumerate(zip(cell, kms, prices, strict=True)):
        by = -1
        if known[i]:
            by = i
        else:
            for j in kept.get(c, ()):
                if abs(kms[j] - k) <= KM and abs(prices[j] - p) / max((prices[j] + p) / 2, 1.0) <= PRICE:
                    by = j
                    break
            else:
                if mine[i] and not any(abs(kms[j] - k) <= KM and abs(prices[j] - p) / max((prices[j] + p) / 2, 1.0) <= PRICE for j in waiting.get(c, ())):
                    by = i
        if by == i or by < 0:
            among = waiting if by < 0 else kept
            for d in around:
                among.setdefault(c + d, []).append(i)
        out.append(by)
    return out


_IN_ORDER = [(c, "ascending") for c in ("s", "p", "price", "t", "portal_id")]


def _decide_blocks(rows: pa.Table) -> pa.Table:
    """Whole blocks: (portal_id, kept_id) of each advert. Those of one place share the fate of the best of them."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=_IN_ORDER, null_placement="at_start"))
    block, km, price = (rows[c].to_numpy() for c in ("block", "mileage_km", "price"))
    by_place = np.lexsort((price, km, block))
    new = np.concatenate([[True], (np.diff(block[by_place]) != 0) | (np.diff(km[by_place]) != 0) | (np.diff(price[by_place]) != 0)])
    best = np.empty(len(block), np.int64)
    best[by_place] = by_place[new][np.cumsum(new) - 1]
    first = np.unique(best)
    kept = np.array(_go_through(block[first], km[first], price[first], [False] * len(first), [True] * len(first)))
    by = first[kept][np.searchsorted(first, best)]
    return pa.table({"portal_id": rows["portal_id"], "kept_id": rows["portal_id"].take(pa.array(by))})


def _decide_tile(rows: pa.Table) -> pa.Table:
    """A tile's places, and those just beyond its ends -> which of mine are kept, and which are still open."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=_IN_ORDER, null_placement="at_start"))
    known, mine = rows["known"].to_pylist(), rows["mine"].to_pylist()
    by = np.array(_go_through(*(rows[c].to_numpy() for c in ("block", "mileage_km", "price")), known, mine))
    out = rows.append_column("kept", pa.array(by == np.arange(len(by)))).filter(pa.array(np.array(mine) & ~np.array(known) & ((by < 0) | (by == np.arange(len(by))))))
    return out.select(["portal_id", "kept"])


def _kept_of_tiles(points: DataFrame, size: int) -> DataFrame:
    """points (_CELL, mileage_km, price, o) of large blocks, of which no two share a place -> those that are kept when, in the order of
    o, each is unless one kept before it is near.

    A block is cut into tiles of about `size` points, each a task's work, with what is within a cell of its ends. What waits for
    an undecided place of another tile waits for the next round, which has what is open and what was kept last. The best one that is
    open is decided in any round, so this ends; rounds grow with the tiles of a block, not with its places.
    """
    cells, kept = cut(points.withColumn("block", F.xxhash64(*BLOCK))), []
    at = cut(_in_tiles(cells, size).withColumn("known", F.lit(False)))
    kind = dict(points.select("o.id").dtypes)["id"]
    while not at.isEmpty():
        spread = at.select("block", "mileage_km", "price", "o.s", F.col("o.p").cast("int").alias("p"), "o.t", F.col("o.id").alias("portal_id"), "known", F.posexplode("_tiles").alias("_at", "tile"))
        found = spread.withColumn("mine", F.col("_at") == 0).drop("_at").repartition("tile").groupBy("tile").applyInArrow(_decide_tile, f"portal_id {kind}, kept boolean")
        at = cut(at.drop("known").join(found.withColumnRenamed("kept", "known"), F.col("o.id") == F.col("portal_id")).drop("portal_id"))
        kept.append(at.where("known").select(*points.columns))
        if at.where("not known").isEmpty():
            break
    return reduce(DataFrame.unionByName, kept, points.limit(0))


def greedy(listings: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(portal_id, kept_id): in order of preference an advert is kept unless one kept before it is near; kept_id is the first
    kept one that is near, or itself. A portal_id that is repeated counts once, as its best row.

    Adverts of equal block, mileage and price share their fate, so the best of them stands for all; one that lacks any of
    these is near nothing and kept. Who waits for whom goes through a whole block, from the cheapest advert on, so a task goes through
    blocks in order, about DECIDED adverts at once. Blocks of more than `whole` adverts are cut into tiles (_kept_of_tiles).
    """
    return _greedy(listings.select("portal_id", *PLACE, _order().alias("o")), whole)


def _greedy(rows: DataFrame, whole: int = WHOLE) -> DataFrame:
    """greedy of rows (portal_id, PLACE, o)."""
    # ids that are repeated have equal hashes, so numbers are shuffled and not all ids
    alike = cut(rows.groupBy(F.xxhash64("portal_id").alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h"))
    if not alike.isEmpty():
        repeated = cut(rows.join(small_side(alike), F.xxhash64("portal_id") == F.col("_h"), "left_semi").groupBy("portal_id").agg(F.count("*").alias("n")).where("n > 1").select("portal_id"))
        best = rows.join(repeated, "portal_id", "left_semi").groupBy("portal_id").agg(F.min_by(F.struct(*PLACE, "o"), "o").alias("r")).select("portal_id", "r.*")
        rows = rows.join(repeated, "portal_id", "left_anti").unionByName(best)
    placed = reduce(Column.__and__, [F.col(c).isNotNull() for c in PLACE]) & (F.abs("price") < float("inf"))
    alone, rows = rows.where(~placed).select("portal_id", F.col("portal_id").alias("kept_id")), rows.where(placed).withColumns({"block": F.xxhash64(*BLOCK), "price": F.col("price").cast("double")})
    sizes = cut(rows.groupBy("block").agg(F.count("*").alias("n")))
    large, n = cut(sizes.where(F.col("n") > whole).select(F.col("block").alias("_b"))), sizes.agg(F.sum("n")).first()[0] or 0
    small, out = rows if large.isEmpty() else rows.join(small_side(large), F.col("block") == F.col("_b"), "left_anti"), alone
    buckets = max(1, n // DECIDED)
    slim = small.select("block", "mileage_km", "price", "o.s", F.col("o.p").cast("int").alias("p"), "o.t", "portal_id", F.pmod("block", F.lit(buckets)).alias("bucket"))
    kind = dict(rows.dtypes)["portal_id"]
    # the number is given, or adaptive execution would join buckets that are small in bytes into a few tasks
    out = out.unionByName(slim.repartition(min(2 * buckets, 10_000), "bucket").groupBy("bucket").applyInArrow(_decide_blocks, f"portal_id {kind}, kept_id {kind}"))
    if large.isEmpty():
        return out
    rows = rows.join(small_side(large), F.col("block") == F.col("_b"), "left_semi")
    points = cut(_cells(rows.groupBy(*PLACE).agg(F.min("o").alias("o")), "o"))
    kept = _around(_kept_of_tiles(points, whole)).groupBy(*_CELL).agg(F.collect_list(F.struct("o", "mileage_km", "price")).alias("_kept"))
    p, q = F.col("price"), lambda k: k["price"]
    close = F.filter("_kept", lambda k: (F.abs(F.col("mileage_km") - k["mileage_km"]) <= KM) & (F.abs(p - q(k)) / F.greatest((p + q(k)) / 2, F.lit(1.0)) <= PRICE))
    of_place = points.join(kept, [*_CELL]).select(*PLACE, F.array_min(F.transform(close, lambda k: k["o"]))["id"].alias("kept_id"))
    same = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in PLACE]
    return out.unionByName(rows.alias("r").join(cut(of_place).alias("p"), reduce(Column.__and__, same)).select("r.portal_id", "p.kept_id"))


def clean_up(listings: DataFrame) -> DataFrame:
    """What the clean-up of a stock does with each advert (portal_id): copy_of_url (another row with its canonical URL is
    preferred), near_duplicate (greedy, over what is left), or keep, with the advert that is kept in its stead (kept_id).

    listings need a column url; null and empty URLs are copies of nothing.
    """
    # one shuffle by URL of what the order and greedy need; a row without a URL goes anywhere
    url = normalize_url(F.col("url"))
    rows = listings.select(*BLOCK, "mileage_km", _order().alias("o"), F.when(url != "", url).alias("_url"))
    best = F.min("o").over(Window.partitionBy("_url", F.when(F.col("_url").isNull(), F.xxhash64("o"))))["id"]
    other = F.when(F.col("_url").isNotNull() & (best != F.col("o.id")), best)
    rows = cut(rows.select(*BLOCK, "mileage_km", "o", other.alias("_best")))
    decided = _greedy(rows.where("_best is null").select(F.col("o.id").alias("portal_id"), *BLOCK, "mileage_km", F.col("o.c").alias("price"), "o"))
    copies = rows.where("_best is not null").select(F.col("o.id").alias("portal_id"), F.lit("copy_of_url").alias("action"), F.col("_best").alias("kept_id"))
    left = decided.select("portal_id", F.when(F.col("portal_id") == F.col("kept_id"), "keep").otherwise("near_duplicate").alias("action"), "kept_id")
    return copies.unionByName(left)


#: Rows, about, that a task of batch folds at once; a block of up to WHOLE is folded by one.
FOLD = 20_000
_AROUND = [(k, p) for k in (-1, 0, 1) for p in (-1, 0, 1)]
_FATE = "key string, bucket long, entered boolean, slot string, gone string, took string"


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Adverts of one bucket in their order, with what is known so far of adverts elsewhere that could meet them.

    A slot is a place among the kept; slot is the key of the advert that opened it, gone the key of the advert that took
    an advert's place, took the key of the advert whose place it took. held_id and held_url are the stretches of keys
    during which a kept advert of another bucket has the same id or URL.
    """
    rows = rows.sort_values("key", kind="stable")
    slots: dict[str, tuple] = {}
    place: dict[str, str] = {}
    cells: dict[tuple, set] = {}
    ids, urls, fates = set(), set(), {}

    def leave(slot: str) -> tuple:
        old = slots.pop(slot)
        place.pop(old[0], None)
        cells[old[8]].remove(slot)
        if old[6]:
            ids.discard(old[4])
            urls.discard(old[5])
        return old

    def enter(slot: str, car: tuple) -> None:
        slots[slot] = car
        place[car[0]] = slot
        cells.setdefault(car[8], []).append(slot)
        if car[6]:
            ids.add(car[4])
            urls.add(car[5])

    for key, block, km, price, pid, url, own, held_id, held_url, entered, slot, gone, took in rows[["key", "block", "mileage_km", "price", "portal_id", "url", "own", "held_id", "held_url", "entered", "slot", "gone", "took"]].itertuples(index=False):
        known = km is not None and price is not None and km == km and price - price == 0
        cell = (block, int(km // KM), int(log(max(price, 20.0)) / _WIDTH)) if known else None
        if not own:
            if entered and known:
                if took in place:
                    old = leave(place[took])
                    if old[6]:
                        fates[took][2] = key
                if slot in slots and slots[slot][7] is not None and slots[slot][7] <= key:
                    leave(slot)
                if slot not in slots:
                    enter(slot, (key, block, km, price, pid, url, False, gone, cell))
            continue
        fate = fates[key] = [False, None, None, None]
        held = [h for x in (held_id, held_url) if x is not None for h in x]
        if pid and pid in ids or url and url in urls or any(h["since"] < key and (h["until"] is None or key <= h["until"]) for h in held):
            continue
        near_by = []
        if known:
            for around in _AROUND:
                for s in tuple(cells.get((block, cell[1] + around[0], cell[2] + around[1]), ())):
                    other = slots[s]
                    if other[7] is not None and other[7] < key:
                        leave(s)
                    elif abs(other[2] - km) <= KM and abs(other[3] - price) / max((other[3] + price) / 2, 1) <= PRICE:
                        near_by.append(s)
        if near_by:
            at = min(near_by)
            if not price < slots[at][3]:
                continue
            old = leave(at)
            if old[6]:
                fates[old[0]][2] = key
            fate[3] = old[0]
        else:
            at = key
        fate[0], fate[1] = True, at
        if known:
            enter(at, (key, block, km, price, pid, url, True, None, cell))
        else:
            ids.add(pid)
            urls.add(url)
    bucket = rows["bucket"].iloc[0]
    return pd.DataFrame([(k, bucket, *f) for k, f in fates.items()], columns=["key", "bucket", "entered", "slot", "gone", "took"])


def _shared(cars: DataFrame, column: str) -> DataFrame:
    """key, bucket and column of adverts whose id or URL occurs in several buckets."""
    buckets = cars.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    return cut(cars.join(buckets.where("a <> b").select(column), column, "left_semi").select("key", "bucket", column))


def _held(shared: DataFrame, fates: DataFrame, column: str) -> DataFrame:
    """key, held_<column>: when kept adverts of other buckets have an advert's id or URL. Nothing after the first that stays
    for good matters, so there is little of it however often a value occurs."""
    kept = shared.join(fates.where("entered").select("key", "gone"), "key")
    stays = kept.where("gone is null").groupBy(column, "bucket").agg(F.min("key").alias("stays"))
    # one bucket's own stay says nothing to itself, so the first of another bucket bounds what is needed
    second = stays.groupBy(column).agg(F.get(F.array_sort(F.collect_list("stays")), F.lit(1)).alias("second"))
    spans = kept.join(second, column, "left").where(F.col("second").isNull() | (F.col("key") <= F.col("second")))
    spans = spans.groupBy(column).agg(F.collect_list(F.struct(F.col("key").alias("since"), F.col("gone").alias("until"), "bucket")).alias("spans"))
    return shared.join(spans, column).select("key", F.filter("spans", lambda s: s["bucket"] != F.col("bucket")).alias(f"held_{column}"))


def _fold_blocks(rows: pa.Table) -> pa.Table:
    """Whole blocks, whose ids and URLs occur nowhere else, in their order: the adverts that are left."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_key", "ascending")]))
    km, price = (rows[c].cast(pa.float64()).fill_null(np.nan).to_numpy() for c in ("mileage_km", "price"))
    known = np.isfinite(km) & np.isfinite(price)
    cell, around = _cell_numbers(rows["_block"].to_numpy(), np.where(known, km, 0), np.where(known, price, 0))
    kms, prices, pids, urls, before = km.tolist(), price.tolist(), rows["portal_id"].to_pylist(), rows["_url"].to_pylist(), None
    left, held, cells, ids, seen = [False] * len(cell), {}, {}, set(), set()  # held: the advert in each slot, known by the one that opened it
    for i, (key, pid, url, c, k, p, placed) in enumerate(zip(rows["_key"].to_pylist(), pids, urls, cell, kms, prices, known.tolist(), strict=True)):
        if key == before or pid and pid in ids or url and url in seen:
            continue
        before, at = key, i
        if placed:
            for d in around:
                for s in cells.get(c + d, ()):
                    j = held[s]
                    if s < at and abs(kms[j] - k) <= KM and abs(prices[j] - p) / max((prices[j] + p) / 2, 1.0) <= PRICE:
                        at = s
            if at < i:
                j = held[at]
                if not p < prices[j]:
                    continue
                left[j] = False
                cells[cell[j]].remove(at)
                ids.discard(pids[j])
                seen.discard(urls[j])
            held[at] = i
            cells.setdefault(c, []).append(at)
        left[i] = True
        ids.add(pid)
        seen.add(url)
    return rows.filter(pa.array(left)).drop_columns(["_key", "_block", "_bucket", "_url"])


def _batch_key(url: Column) -> Column:
    """Newest first, then by id, price, mileage, and a hash of the rest that matters."""
    return F.concat_ws("\x01", F.lpad(F.lit(1 << 62) - F.unix_micros(F.coalesce("updated_at", F.lit("1970-01-01").cast("timestamp"))), 20, "0"), F.coalesce("portal_id", F.lit("")), F.format_string("%024.6f", F.coalesce("price", F.lit(0.0))), F.lpad(F.coalesce("mileage_km", F.lit(0)).cast("string"), 12, "0"), F.hex(F.xxhash64(*BLOCK, url)))


def batch(listings: DataFrame, fold: int = WHOLE) -> DataFrame:
    """The adverts of a batch that are left when, newest first (then by id, price, mileage), one that is near a kept one is
    dropped, or takes its place if it is cheaper; so is one whose portal_id (or url, if there is such a column) is that
    of a kept one at the time, and dropped.

    Of several near ones the first counts, and the place of a replaced advert stays its own. The order matters, so tasks fold
    whole (brand, model, year) blocks in it, about FOLD adverts at once, and hand the rows on. Only blocks that share an id or a URL
    with another, and those of more than `fold` adverts, take the longer way of _batch_linked. Null and empty ids and URLs are equal to
    nothing, null mileages and prices near nothing.
    """
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in listings.columns else F.lit("")
    block = F.xxhash64(*BLOCK)
    sizes = cut(listings.groupBy(block.alias("_block")).agg(F.count("*").alias("n")))
    linked, n = sizes.where(F.col("n") > fold).select("_block"), sizes.agg(F.sum("n")).first()[0] or 0
    for value in (F.col("portal_id"), url)[: 2 if "url" in listings.columns else 1]:
        # values that are equal have equal hashes, so numbers are shuffled; a hash that two values share makes a block go the longer way
        known = listings.where(value != "").select(F.xxhash64(value).alias("_h"), block.alias("_block"))
        crossing = small_side(cut(known.groupBy("_h").agg(F.min("_block").alias("a"), F.max("_block").alias("b")).where("a <> b").select("_h")))
        linked = linked.unionByName(known.join(crossing, "_h", "left_semi").select("_block"))
    linked = cut(linked.distinct())
    buckets = max(1, n // min(fold, FOLD))
    rows = listings.withColumns({"_key": _batch_key(url), "_url": url, "_block": block})
    alone = rows if linked.isEmpty() else rows.join(small_side(linked), "_block", "left_anti")
    alone = alone.select(*rows.columns).withColumn("_bucket", F.pmod("_block", F.lit(buckets))).repartition(min(2 * buckets, 10_000), "_bucket")
    out = alone.groupBy("_bucket").applyInArrow(_fold_blocks, listings.schema)
    if linked.isEmpty():
        return out
    return out.unionByName(_batch_linked(rows.join(small_side(linked), "_block", "left_semi").select(*listings.columns), fold))


def _batch_linked(listings: DataFrame, fold: int) -> DataFrame:
    """batch of blocks that depend on each other, or are large.

    Buckets are whole blocks, or stretches of mileage of a block that has more than `fold` adverts. What adverts of other buckets
    do (the same id or URL in another block, or a neighbour across the end of a stretch) is put in from the round before, until
    nothing changes: who depends on whom follows the order, so this ends in the one right result, after a round or two unless
    long chains cross buckets.
    """
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in listings.columns else F.lit("")
    key = _batch_key(url)
    keyed = listings.withColumn("_key", key)
    slim = cut(keyed.select(F.col("_key").alias("key"), F.xxhash64(*BLOCK).alias("block"), "mileage_km", "price", "portal_id", url.alias("url")).groupBy("key").agg(*[F.first(c).alias(c) for c in ("block", "mileage_km", "price", "portal_id", "url")], F.count("*").alias("copies")))
    repeated = slim.agg(F.max("copies")).first()[0] or 0
    large = slim.groupBy("block").count().where(F.col("count") > fold).select(F.col("block").alias("_b"), F.ceil(F.col("count") / fold).alias("_n"))
    buckets = max(1, slim.count() // min(fold, FOLD))
    ends = cut(slim.join(large, F.col("block") == F.col("_b")).groupBy("block", "_n").agg(F.min("mileage_km").alias("_low"), F.max("mileage_km").alias("_high"))).withColumnRenamed("block", "_b")
    width = F.greatest(F.lit(2 * KM), F.ceil((F.col("_high") - F.col("_low") + 1) / F.col("_n")))
    stretch = F.floor((F.col("mileage_km") - F.col("_low")) / width)
    cars = slim.join(ends, F.col("block") == F.col("_b"), "left").withColumn("_at", F.coalesce(stretch, F.lit(0)))
    cars = cut(cars.withColumn("bucket", F.when(F.col("_b").isNull(), F.pmod("block", F.lit(buckets))).otherwise(-1 - F.pmod(F.xxhash64("block", "_at"), F.lit(1 << 40)))).withColumn("_width", width))
    beyond = [(cars["_at"] + d, cars["mileage_km"] - (cars["_low"] + (cars["_at"] + (1 if d > 0 else 0)) * cars["_width"])) for d in (-1, 1)]
    across = reduce(DataFrame.unionByName, [cars.where(cars["_b"].isNotNull() & (F.abs(gap) <= KM)).withColumn("bucket", -1 - F.pmod(F.xxhash64("block", at), F.lit(1 << 40))) for at, gap in beyond])
    across = across.select("key", "block", "mileage_km", "price", "portal_id", "url", F.col("bucket").alias("to"))
    cars = cars.select("key", "bucket", "block", "mileage_km", "price", "portal_id", "url")
    span = "array<struct<since:string,until:string,bucket:bigint>>"
    blank = {"held_portal_id": span, "held_url": span, "entered": "boolean", "slot": "string", "gone": "string", "took": "string"}
    start = cars.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}).withColumn("own", F.lit(True))

    def folded(rows: DataFrame) -> DataFrame:
        # the number is given, or adaptive execution would join buckets that are small in bytes into a few tasks
        return cut(rows.withColumnsRenamed({"held_portal_id": "held_id"}).repartition(min(2 * buckets, 10_000), "bucket").groupBy("bucket").applyInPandas(_fold, _FATE))

    fates = folded(start)
    shared = {c: _shared(cars, c) for c in ("portal_id", "url")}
    linked = cut(reduce(DataFrame.unionByName, [x.select("bucket") for x in shared.values()], across.select(F.col("to").alias("bucket"))).distinct())
    while not linked.isEmpty():
        held = reduce(DataFrame.unionByName, [_held(x, fates, c).withColumn(o, F.lit(None).cast(span)).select("key", *map("held_{}".format, shared)) for (c, x), o in zip(shared.items(), ("held_url", "held_portal_id"), strict=True)])
        held = held.groupBy("key").agg(*[F.first(f"held_{c}", ignorenulls=True).alias(f"held_{c}") for c in shared])
        beside = across.join(fates.where("entered").drop("bucket"), "key").withColumnRenamed("to", "bucket")
        beside = beside.withColumns({"own": F.lit(False), **{f"held_{c}": F.lit(None).cast(span) for c in shared}})
        own = start.drop("held_portal_id", "held_url").join(linked, "bucket", "left_semi").join(held, "key", "left")
        renewed = cut(fates.join(linked, "bucket", "left_anti").unionByName(folded(own.unionByName(beside))))
        done, fates = renewed.select(*fates.columns).exceptAll(fates).isEmpty(), renewed
        if done:
            break
    left = fates.where("entered and gone is null").select(F.col("key").alias("_key"))
    kept = keyed.join(left, "_key", "left_semi")
    return (kept.dropDuplicates(["_key"]) if repeated > 1 else kept).drop("_key")


def write_actions(new: DataFrame, target: DataFrame) -> DataFrame:
    """What the guarded insert does with each new advert: skipped_url without a URL, updated where its id is known,
    skipped_url where its URL is, skipped_near where the same car is, else created. Set-based: three joins."""
    by_id = target.select(F.col("portal_id").alias("known_id")).distinct()
    by_url = target.select(F.col("url").alias("known_url")).where("known_url <> ''").distinct()
    cells = target.select(*[F.col(c).alias(f"t_{c}") for c in BLOCK], F.col("mileage_km").alias("t_km"), F.col("price").alias("t_price"), F.floor(F.col("mileage_km") / KM).alias("t_cell"))
    probe = new.select("portal_id", *BLOCK, "mileage_km", "price").withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("mileage_km") / KM) + d)))
    same = [F.col(c) == F.col(f"t_{c}") for c in BLOCK] + [F.col("cell") == F.col("t_cell")]
    close = (F.abs(F.col("mileage_km") - F.col("t_km")) <= KM) & (F.abs(F.col("price") - F.col("t_price")) / F.greatest((F.col("price") + F.col("t_price")) / 2, F.lit(1.0)) <= PRICE)
    nears = probe.join(cells, [*same, close], "left_semi").select(F.col("portal_id").alias("near_id")).distinct()
    return (
        new.join(by_id, new.portal_id == F.col("known_id"), "left")
        .join(by_url, new.url == F.col("known_url"), "left")
        .join(nears, new.portal_id == F.col("near_id"), "left")
        .select(
            "portal_id",
            F.when(F.coalesce("url", F.lit("")) == "", "skipped_url")
            .when(F.col("known_id").isNotNull(), "updated")
            .when(F.col("known_url").isNotNull(), "skipped_url")
            .when(F.col("near_id").isNotNull(), "skipped_near")
            .otherwise("created")
            .alias("action"),
        )
    )


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with rows of changes put in by key: a snapshot to be written anew."""
    changed = changes.select(*target.columns)
    return target.join(changed, key, "left_anti").unionByName(changed)
