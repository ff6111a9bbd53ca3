"""Merges that change a snapshot: the guarded insert of a batch, the verification cycle of URLs, updates by predicate.

A merge gives a log of what it did and the snapshot to be written anew; neither holds a block or a table in one task.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..sources.shared import cut
from ..sources.tables import small_side
from .dedup import BLOCK, _near_counts as near_counts, close_pairs

PLACE = (*BLOCK, "mileage_km", "price")
#: What an update takes over as it is, and what it takes over if the batch knows it.
REFRESHED, FILLED = ("price", "mileage_km"), ("fuel_type", "transmission", "power_hp")


class Merged(NamedTuple):
    actions: DataFrame
    snapshot: DataFrame


def _place() -> Column:
    """Brand, model, year, mileage and price as one key; a place of its own for an advert that lacks one of them."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in PLACE])
    return F.when(whole, F.concat_ws("\x01", *[F.col(c).cast("string") for c in PLACE])).otherwise(F.concat(F.lit("\x02"), F.col("portal_id")))


def _refused(moves: DataFrame, target: DataFrame) -> DataFrame:
    """portal_id of those moves (portal_id, stored, url, at) that can't have the URL they want.

    A URL is its holder's as long as that doesn't move, else goes to the first that wants it. A row that is refused stays
    where it is, which may refuse another in the next round; without such chains one round does.
    """
    moves = cut(moves)
    staying = target.join(moves, "portal_id", "left_anti").select("url")
    refused = cut(moves.join(staying, "url", "left_semi").select("portal_id"))
    while True:
        open_ = moves.join(refused, "portal_id", "left_anti")
        first = open_.groupBy("url").agg(F.min(F.struct("at", "portal_id")).alias("w")).select("w.portal_id")
        late = open_.join(first, "portal_id", "left_anti").select("portal_id")
        kept_back = moves.join(refused, "portal_id", "left_semi").select(F.col("stored").alias("url"))
        blocked = open_.join(kept_back, "url", "left_semi").select("portal_id")
        more = cut(late.union(blocked).distinct())
        if more.isEmpty():
            return refused
        refused = cut(refused.union(more))


def _winners(left: DataFrame) -> DataFrame:
    """left (portal_id, url, place, at, PLACE) -> (portal_id, url, at) of those that get in when, in order, each does unless
    one before it has its URL or is near.

    Rounds: adverts of one place or one URL exclude each other, so only the first of each can be next, and neither has its
    pairs written down; places that are near are. The first of a place gets in if it is the first of its URL and no near
    place has an earlier one; then its URL, its place and the near places are closed.
    """
    places = left.where(~F.col("place").startswith("\x02")).select("place", *PLACE).distinct()
    pairs = cut(close_pairs(places, "place").select(F.col("a.place").alias("here"), F.col("b.place").alias("there")))
    pairs = cut(pairs.union(pairs.select("there", "here")))
    left = cut(left.select("url", "place", F.struct("at", "portal_id").alias("o")))
    won = [left.limit(0)]
    while not left.isEmpty():
        first = cut(left.groupBy("place").agg(F.min("o").alias("o")))
        here, there = first.select(F.col("place").alias("here"), F.col("o").alias("o1")), first.select(F.col("place").alias("there"), F.col("o").alias("o2"))
        waiting = pairs.join(here, "here").join(there, "there").where("o2 < o1").select(F.col("here").alias("place")).distinct()
        of_url = left.groupBy("url").agg(F.min(F.struct("o", "place")).alias("f")).select("url", "f.o", "f.place")
        nexts = first.select("place", F.col("o.portal_id").alias("portal_id")).join(waiting, "place", "left_anti")
        free = cut(of_url.withColumn("portal_id", F.col("o.portal_id")).join(nexts, ["place", "portal_id"], "left_semi").select("url", "place", "o"))
        closed = free.select("place").union(pairs.join(free.select(F.col("place").alias("here")), "here").select("there")).distinct()
        left = cut(left.join(closed, "place", "left_anti").join(free.select("url"), "url", "left_anti"))
        won.append(free)
    return reduce(DataFrame.unionByName, won).select("url", "o.portal_id", "o.at")


def _held(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The places of fresh (as _<column>) that a stored advert is near. Both are counted in sorted blocks, so no place is copied to the
    cells around."""
    places = [F.col(c).cast("double").alias(c) if c == "price" else F.col(c) for c in PLACE]
    points = stored.select(*places, F.lit("stored").alias("source_portal")).unionByName(fresh.select(*places, F.lit(None).cast("string").alias("source_portal")))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in PLACE]) & (F.abs("price") < float("inf"))
    counts = near_counts(points.where(whole).groupBy(*PLACE, "source_portal").agg(F.count("*").alias("n")))
    return counts.where("source_portal is null and n_portals > 0").select(*[F.col(c).alias(f"_{c}") for c in PLACE])


def guarded_merge(target: DataFrame, new: DataFrame, order: str) -> Merged:
    """A batch put into a snapshot of adverts -> what was done with each id of the batch (portal_id, n_rows, action), and the
    new snapshot. The same batch once more changes nothing.

    The row of an id that comes last by `order` and has a URL stands for the others. Ids that the snapshot knows are
    updated first: price and mileage, fuel, gearbox and power where given, the URL, whose stamp of verification goes when
    it changes; if the URL is another advert's, nothing is (skipped_url). Then the others come in order: skipped_url
    if an advert has their URL, skipped_near if one is near (dedup.near), else created. Adverts of the batch that are
    created count for those after them. No URL is skipped_url, no id skipped_id; nulls in brand, model, year, mileage
    or price are near nothing. Of equal order, the smaller id goes first, and of one id the larger hash of the row.

    target has one row per portal_id. Its columns stay; what new lacks of them is null in created rows.
    """
    # read for ids, URLs and places in turn, so it is worked out once
    target = cut(target.withColumn("url", normalize_url(F.col("url"))))
    columns = [c for c in target.columns if c in new.columns and c not in ("portal_id", "url")]
    needed = list(dict.fromkeys([*PLACE, *columns]))
    batch = new.select("portal_id", normalize_url(F.col("url")).alias("url"), F.col(order).alias("at"), *needed)
    last = F.struct((F.col("url") != "").alias("u"), "at", F.xxhash64("url", *needed).alias("h"))
    rows = batch.groupBy(F.when(F.col("portal_id") != "", F.col("portal_id")).alias("portal_id")).agg(F.max_by(F.struct("url", "at", *needed), last).alias("r"), F.count("*").alias("n_rows"))
    rows = rows.select("portal_id", "n_rows", "r.*")
    rows = cut(rows.join(target.select("portal_id", F.col("url").alias("stored"), F.lit(True).alias("known")), "portal_id", "left"))
    lost, rows = rows.where("portal_id is null").select("n_rows"), rows.where("portal_id is not null")
    given = rows.where("url <> ''")

    known = given.where("known")
    refused = _refused(known.where("not stored <=> url").select("portal_id", "stored", "url", "at"), target.select("portal_id", "url").where("url <> ''"))
    updates = cut(known.join(refused, "portal_id", "left_anti").select("portal_id", F.struct("url", *needed).alias("_u")))
    hit = F.col("_u").isNotNull()
    put = {c: F.when(hit, F.col(f"_u.{c}")).otherwise(F.col(c)) for c in REFRESHED}
    put |= {c: F.coalesce(f"_u.{c}", c) for c in FILLED if c in columns}
    if "url_verified_at" in target.columns:
        stamp = F.col("_u.url_verified_at") if "url_verified_at" in columns else F.lit(None).cast("timestamp")
        put["url_verified_at"] = F.coalesce(stamp, F.when(~hit | (F.col("url") == F.col("_u.url")), F.col("url_verified_at")))
    put["url"] = F.when(hit, F.col("_u.url")).otherwise(F.col("url"))
    after = target.join(updates, "portal_id", "left").withColumns(put).select(*target.columns)

    fresh = given.where("known is null").withColumn("place", _place())
    fresh = cut(fresh.select("portal_id", "url", "at", "place", *PLACE))
    stored = after.join(fresh.select("url"), "url", "left_semi").select("url").distinct()
    held = cut(_held(after, fresh))
    same = [F.col(c) == F.col(f"_{c}") for c in PLACE]
    won = cut(_winners(fresh.join(stored, "url", "left_anti").join(held, same, "left_anti")))

    owners = won.select("url", F.col("portal_id").alias("w_id"), F.col("at").alias("w_at")).unionByName(stored.withColumns({"w_id": F.lit(None).cast("string"), "w_at": F.lit(None).cast(fresh.schema["at"].dataType)}))
    earlier = F.col("w_id").isNull() | (F.struct("w_at", "w_id") < F.struct("at", "portal_id"))
    judged = fresh.select("portal_id", "url", "at").join(owners.withColumn("owned", F.lit(True)), "url", "left")
    verdict = F.when(F.col("w_id") == F.col("portal_id"), "created").when(F.col("owned") & earlier, "skipped_url").otherwise("skipped_near")
    judged = judged.select("portal_id", verdict.alias("action"))
    rest = known.join(refused.withColumn("no", F.lit(True)), "portal_id", "left").select("portal_id", F.when(F.col("no"), "skipped_url").otherwise("updated").alias("action"))
    actions = rows.select("portal_id", "n_rows").join(judged.unionByName(rest), "portal_id", "left").withColumn("action", F.coalesce("action", F.lit("skipped_url")))
    actions = actions.unionByName(lost.select(F.lit(None).cast("string").alias("portal_id"), "n_rows", F.lit("skipped_id").alias("action")))
    created = rows.join(won.select("portal_id"), "portal_id", "left_semi").select("portal_id", "url", *columns)
    return Merged(actions, after.unionByName(created, allowMissingColumns=True).select(*target.columns))


def verification(target: DataFrame, probes: DataFrame, now: datetime) -> Merged:
    """One cycle over adverts that wait for verification (url_verified_at null, a URL) -> (portal_id, action) of each that was
    probed, and the snapshot after it.

    probes: portal_id, verdict (ok, dead or soft; anything else is soft), seller_url and seller_verdict of the advert's own
    page where the portal only refers to it. verified: the stamp is set. A seller's page that is ok stands in for an
    advert that isn't: repaired, URL and stamp are set; unless another advert had that URL before the cycle, or one with
    a smaller id is repaired to it, then deleted. dead is deleted; soft stays as it is and is tried again (soft_at = now).
    Of several probes of an advert the best counts. Adverts that don't wait, or were not probed, stay.

    Rows that share an id are one advert: it waits if one of them does, and all of them change or go.

    Adverts meet their probes in one join by id and are written with them; only URLs that a repair wants are looked for among
    all, and what is free goes back to its advert. Both are small as a rule and broadcast then, so the snapshot takes no
    other shuffle of the table.
    """
    ok, usable = F.col("verdict") == "ok", F.col("seller_verdict") == "ok"
    rank = F.when(F.col("ok"), 0).when(F.col("seller") != "", 1).when(F.col("verdict") == "dead", 3).otherwise(2)
    best = probes.select("portal_id", "verdict", ok.alias("ok"), F.when(usable & ~F.coalesce(ok, F.lit(False)), normalize_url(F.col("seller_url"))).alias("seller"))
    best = best.select("portal_id", F.struct(rank.alias("rank"), F.when(rank == 1, F.col("seller")).alias("to")).alias("_p"))
    # dealt by id before they are grouped: one sort serves groups and join, and there is none before the shuffle
    best = best.repartition("portal_id").groupBy("portal_id").agg(F.min("_p").alias("_p"))
    waiting = F.col("url_verified_at").isNull() & (F.coalesce("url", F.lit("")) != "")
    waits = F.max(waiting).over(Window.partitionBy("portal_id"))  # rows stand by id already
    met = cut(target.join(best, "portal_id", "left").withColumn("_p", F.when(waits, F.col("_p"))))
    repairs = met.where("_p.rank = 1").select("portal_id", F.col("_p.to").alias("to"))
    wanted = small_side(cut(repairs.select("to").distinct()))
    owner = met.select(F.col("portal_id").alias("o_id"), normalize_url(F.col("url")).alias("to")).join(wanted, "to", "left_semi")
    owner = small_side(cut(owner.groupBy("to").agg(F.min("o_id").alias("first"), F.max("o_id").alias("last"))))
    own = F.col("first").isNull() | ((F.col("first") == F.col("portal_id")) & (F.col("last") == F.col("portal_id")))
    free = repairs.join(owner, "to", "left").where(own).groupBy("to").agg(F.min("portal_id").alias("portal_id"))
    free = small_side(cut(free.select("portal_id", F.lit(True).alias("_free"))))
    action = F.when(F.col("_p.rank") == 0, "verified").when(F.col("_free"), "repaired").when(F.col("_p.rank") == 2, "soft").otherwise("deleted")
    done = met.join(free, "portal_id", "left").withColumn("_action", F.when(F.col("_p").isNotNull(), action))
    stamp = F.lit(now).cast("timestamp")
    soft_at = F.col("soft_at") if "soft_at" in target.columns else F.lit(None).cast("timestamp")
    after = done.where("_action is null or _action <> 'deleted'").withColumns(
        {
            "url": F.when(F.col("_action") == "repaired", F.col("_p.to")).otherwise(F.col("url")),
            "url_verified_at": F.when(F.col("_action").isin("verified", "repaired"), stamp).otherwise(F.col("url_verified_at")),
            "soft_at": F.when(F.col("_action") == "soft", stamp).when(F.col("_action").isNull(), soft_at),
        }
    )
    return Merged(done.where("_action is not null").select("portal_id", F.col("_action").alias("action")).dropDuplicates(["portal_id"]), after.drop("_p", "_free", "_action"))


def updated_where(rows: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """rows with values put in where the test holds; a test that is null doesn't."""
    holds = F.coalesce(test, F.lit(False))
    return rows.withColumns({c: F.when(holds, v).otherwise(F.col(c)) for c, v in values.items()})
