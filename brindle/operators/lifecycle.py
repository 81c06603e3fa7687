"""Listings over time: what is new, what was seen, what is gone.

Tables are immutable files, so inserts and updates are DataFrames to append or to write instead of the old ones.  Where the
reading and writing of several processes would need locks, one writer is assumed; uniqueness comes from anti-joins and from
grouping the new rows by their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPIRY_DAYS = 3


def unseen(found: DataFrame, stored: DataFrame, key: Sequence[str], null_safe: Sequence[str] = ()) -> DataFrame:
    """Rows of `found` without a stored row of equal key; columns in `null_safe` treat null as equal to null."""
    kept = stored.select(*[F.col(c).alias(f"_s_{c}") for c in (*key, *null_safe)]).distinct()
    match = [F.col(c) == F.col(f"_s_{c}") for c in key] + [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in null_safe]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return found.join(kept, condition, "left_anti")


def insert_new(rows: DataFrame, stored: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[str]) -> DataFrame:
    """Rows to append so that every one of `keys` stays unique: conflicts with stored rows and later doubles are dropped."""
    out = rows
    for key in keys:
        out = out.join(stored.select(*key).distinct(), list(key), "left_anti")
    for key in keys:
        names = out.columns
        first = out.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
        out = first.select(*[F.col(f"_r.{c}").alias(c) for c in names])
    return out


def expiry(last_seen: Column, checked: Column) -> Column:
    """Status after a failed check: exactly three days of silence are not yet too many."""
    return F.when(last_seen < checked - F.expr(f"INTERVAL {EXPIRY_DAYS} DAYS"), "expired").otherwise("unreachable")


def refresh(listings: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """Listings after a run: `seen` (source, external_id, seen_at) makes them active, `failed` (…, checked_at) does not.

    A sighting updates every row of its identity; a listing both seen and failed counts as seen.
    """
    key = ["source", "external_id"]
    latest = seen.groupBy(*key).agg(F.max("seen_at").alias("_seen"))
    checks = failed.groupBy(*key).agg(F.max("checked_at").alias("_checked"))
    joined = listings.join(latest, key, "left").join(checks, key, "left")
    status = F.when(F.col("_seen").isNotNull(), "active").when(F.col("_checked").isNotNull(), expiry(F.col("last_seen_at"), F.col("_checked"))).otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at")).select(*listings.columns)


def in_scope(area_slug: Column, rooms: Column, areas: Sequence[str], room_numbers: Sequence[int]) -> Column:
    """An empty filter allows all; a null never matches a filter that is set."""
    area = F.lit(True) if not areas else F.coalesce(area_slug.isin(*areas), F.lit(False))
    room = F.lit(True) if not room_numbers else F.coalesce(rooms.isin(*room_numbers), F.lit(False))
    return area & room


def recheck(listings: DataFrame, found: DataFrame, source: str, scope: Column) -> DataFrame:
    """Listings of a source inside the search's scope that the search did not return."""
    return listings.where((F.col("source") == source) & scope).join(found.select("source", "external_id").distinct(), ["source", "external_id"], "left_anti")


def scrape_step(listings: DataFrame, found: DataFrame, outcomes: DataFrame, scope: Column, source: str, now: Column) -> dict[str, DataFrame]:
    """One run as tables: what to fetch, what to insert, the listings after it, and the counters.

    `found`: source, external_id, url, price_amount; `outcomes`: url, outcome (ok, unavailable, transient) and, where ok,
    the parsed listing's columns.
    """
    new = unseen(found, listings, ["source", "external_id"], ["price_amount"])
    absent = recheck(listings, found, source, scope)
    fetch = new.select("url").unionByName(absent.select("url")).distinct()
    ok = outcomes.where("outcome = 'ok'").join(new.select("url").distinct(), "url", "left_semi").select(*listings.columns)
    inserts = insert_new(ok, listings, [["source", "external_id"]], ["url"])
    seen = found.select("source", "external_id", now.alias("seen_at")).unionByName(outcomes.where("outcome = 'ok'").join(absent.select("url", "source", "external_id"), "url").select(absent["source"], absent["external_id"], now.alias("seen_at")))
    failed = outcomes.where("outcome = 'unavailable'").join(absent.select("url", "source", "external_id"), "url").select(absent["source"], absent["external_id"], now.alias("checked_at"))
    counts = outcomes.agg(F.count_if(F.expr("outcome = 'ok'")).alias("fetched"), F.count_if(F.expr("outcome = 'unavailable'")).alias("unavailable"), F.count_if(F.expr("outcome = 'transient'")).alias("failed"))
    summary = found.agg(F.count("*").alias("found")).crossJoin(new.agg(F.count("*").alias("new"))).crossJoin(counts)
    return {"fetch": fetch, "inserts": inserts, "listings": refresh(listings, seen, failed), "summary": summary}


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key by `order`; a grouped maximum, combined before the shuffle, so no key is too large."""
    pick = F.max_by if last else F.min_by
    whole = rows.groupBy(*key).agg(pick(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return whole.select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns])


def last_before(rows: DataFrame, key: str, at: str, tie: str, value: Column, name: str) -> DataFrame:
    """`rows` with the greatest non-null `value` among the key's earlier rows (by `at`, then `tie`).

    A key of any size is split by day: maxima of days are carried forward in a table with one row a key and day, and only
    the rows of one day are ordered together.
    """
    day = F.to_date(at)
    tagged = rows.withColumn("_day", day).withColumn("_value", value)
    days = tagged.groupBy(key, "_day").agg(F.max("_value").alias("_most"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col(key), F.col("_day"), F.max("_most").over(before).alias("_carried"))
    inside = Window.partitionBy(key, "_day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = tagged.withColumn("_inside", F.max("_value").over(inside)).join(carried, [key, "_day"])
    return joined.withColumn(name, F.greatest("_carried", "_inside")).select(*rows.columns, name)


def streaks(rows: DataFrame, key: str, order: Sequence[str], flag: Column, least: int) -> DataFrame:
    """Maximal runs of at least `least` consecutive rows with the flag: key, length, first and last position.

    The first column of `order` is a time.  A key of any size is split by day: counts of days are carried forward in a table
    with one row a key and day, and only the rows of one day are ordered together.  Rows of one run have the same number of
    rows without the flag before them.
    """
    tagged = rows.select(F.col(key), F.to_date(order[0]).alias("_day"), F.coalesce(flag, F.lit(False)).alias("_on"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = tagged.groupBy(key, "_day").agg(F.count("*").alias("_n"), F.count_if(~F.col("_on")).alias("_off"))
    carried = days.select(F.col(key), F.col("_day"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_off")])
    inside = Window.partitionBy(key, "_day").orderBy(*[f"_o{i}" for i in range(len(order))])
    placed = tagged.withColumn("_at", F.row_number().over(inside)).withColumn("_gone", F.count_if(~F.col("_on")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = placed.where("_on").join(carried, [key, "_day"]).select(F.col(key), (F.col("_at") + F.col("_n_before")).alias("_at"), (F.col("_gone") + F.col("_off_before")).alias("_run"))
    return runs.groupBy(key, "_run").agg(F.count("*").alias("length"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at")).where(F.col("length") >= least).drop("_run")


def swap_pointer(current: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """A pointer table after an upsert: updated keys take the new row."""
    return current.join(update.select(key), key, "left_anti").unionByName(update)


def update_if_unchanged(rows: DataFrame, updates: DataFrame, key: str, guard: str) -> tuple[DataFrame, DataFrame]:
    """(rows with updates applied where the guard column is still what the update saw, stale updates)."""
    new = [c for c in updates.columns if c not in (key, guard)]
    renamed = updates.select(F.col(key), F.col(guard).alias("_guard"), *[F.col(c).alias(f"_n_{c}") for c in new], F.lit(True).alias("_sent"))
    joined = rows.join(renamed, key, "left").withColumn("_hit", F.coalesce(F.col("_sent") & F.col(guard).eqNullSafe(F.col("_guard")), F.lit(False)))
    applied = joined.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])
    stale = updates.join(rows.select(key, guard), [key, guard], "left_anti")
    return applied, stale


def price_per_area(amount: Column, area: Column) -> Column:
    return F.when(area > 0, amount / area)


def run_id(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))
