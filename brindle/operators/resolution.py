"""From listings to evidence, from evidence to ranked areas: the resolver as one flow of tables.

Listings: listing_id, description, city, area, street, pois (name, category, start, end, confidence),
poi_description_sha256, snapshot_hash.  Places and aliases are those of `location.places_of`; `points` are the places'
coordinates (dataset, external_id, x, y); `seen` are verified coordinates as `location.observations` reads them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import location as G
from brindle.operators.graph import discard, written
from brindle.operators.spatial import support

# Radius and weight of a property's own address, of an address nearby, of a street; weight of a reviewed area.
OWN_ADDRESS, NEARBY_ADDRESS, STREET, AREA_WEIGHT = (30.0, 4.0), (500.0, 1.0), (100.0, 1.0), 0.3
GROUP = "listing_id", "group_key", "kind", "text", "radius_m", "weight", "quality", "n_places"


def asked_places(listings: DataFrame, spans: DataFrame) -> DataFrame:
    """Everything a listing names: its own street first, then the usable spans of its description, in order."""
    street = listings.where(T.squeezed(F.col("street")) != "").select(
        "listing_id", F.concat(F.col("listing_id").cast("string"), F.lit(":street")).alias("mention_id"), F.lit(-1).alias("position"), F.col("street").alias("name"), F.lit("street").alias("category"), "city",
        F.concat(F.lit("Listing street: "), "street").alias("text"), F.lit(STREET[0]).alias("radius_m"), F.lit(1.0).alias("quality"), F.lit(True).alias("own"),
    )
    named = spans.where("kept").select("listing_id", "mention_id", "position", "name", "category", "city", F.col("name").alias("text"), "radius_m", "quality", F.lit(False).alias("own"))
    return street.unionByName(named)


def evidence(listings: DataFrame, places: DataFrame, aliases: DataFrame, seen: DataFrame | None = None, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(groups, notes): evidence groups with their `places`, and what was left out, (listing_id, position, note).

    A name that ends in a house number is an address if the stated town has it (the property's own if it is the listing's
    street, else one nearby), and a street otherwise.  Mentions of the same places are one group: of addresses the last one
    stands, of other names the heaviest, then first, with the largest radius.  A street that shares its name with an address
    of the property says nothing new and goes.
    """
    spans = written(G.usable_mentions(listings), "spans")
    asked = written(asked_places(listings, spans), "asked")
    housed = written(G.addresses(asked.where("category = 'street'"), places, aliases, fold), "housed")
    others = asked.join(housed.select("mention_id").distinct(), "mention_id", "left_anti")
    matches = written(G.match_names(others, places, aliases, fold).withColumn("housed", F.lit(False)).unionByName(housed.withColumn("quality", F.lit(1.0)).withColumn("housed", F.lit(True))), "matches")

    found = matches.groupBy("mention_id").agg(F.array_sort(F.collect_set(F.struct("dataset", "external_id"))).alias("places"), F.max("quality").alias("_q"), F.first("housed").alias("housed"))
    at_home, housed_ = F.col("housed") & F.col("own"), F.col("housed")
    pick = lambda own, near, other: F.when(at_home, own).when(housed_, near).otherwise(other)
    each = asked.join(found, "mention_id").select(
        "listing_id", "position", "housed", "places", "text", F.sha2(F.to_json("places"), 256).alias("group_key"), pick(F.lit("address"), F.lit("nearby_address"), F.col("category")).alias("kind"),
        pick(F.lit(OWN_ADDRESS[0]), F.lit(NEARBY_ADDRESS[0]), F.col("radius_m")).alias("radius_m"), pick(F.lit(OWN_ADDRESS[1]), F.lit(NEARBY_ADDRESS[1]), F.lit(1.0)).alias("weight"), F.when(housed_, 1.0).otherwise(F.col("quality") * F.col("_q")).alias("quality"),
    )
    order = F.when(housed_, F.struct(F.lit(0.0).alias("a"), F.col("position").alias("b"))).otherwise(F.struct(F.col("weight").alias("a"), (-F.col("position")).alias("b")))
    merged = each.groupBy("listing_id", "group_key").agg(F.max_by(F.struct("kind", "text", "radius_m", "weight", "quality", "places", "housed"), order).alias("g"), F.max("radius_m").alias("_r"))
    groups = merged.select("listing_id", "group_key", "g.kind", "g.text", F.when(F.col("g.housed"), F.col("g.radius_m")).otherwise(F.col("_r")).alias("radius_m"), "g.weight", "g.quality", F.size("g.places").alias("n_places"), "g.places", *[F.lit(None).cast("double").alias(c) for c in ("x", "y")])
    if seen is not None:
        spot = G.observations(listings, seen)
        groups = groups.unionByName(spot.select(*GROUP, F.expr("CAST(array() AS array<struct<dataset:string,external_id:string>>)").alias("places"), "x", "y"))
    groups = written(groups, "groups")

    names = groups.select("listing_id", "group_key", F.inline("places")).join(places.select("dataset", "external_id", T.name_key(F.col("name"), fold).alias("name_key")), ["dataset", "external_id"]).select("listing_id", "group_key", "name_key").distinct()
    kept = written(G.without_addressed_streets(groups, names), "evidence")

    stale = listings.where(~F.col("poi_description_sha256").eqNullSafe(T.exact_hash(F.col("description"))))
    unresolved = asked.join(matches.select("mention_id").distinct(), "mention_id", "left_anti")
    notes = (
        stale.select("listing_id", F.lit(-2).alias("position"), F.lit("predictions missing or stale; structured location only").alias("note"))
        .unionByName(spans.where("note IS NOT NULL").select("listing_id", "position", "note"))
        .unionByName(unresolved.select("listing_id", "position", F.concat(F.lit("unresolved "), "category", F.lit(": "), "name").alias("note")))
    )
    notes = written(notes, "notes")
    discard(spans, asked, housed, matches, groups)
    return kept, notes


def supported(groups: DataFrame, points: DataFrame, units: DataFrame) -> DataFrame:
    """(listing_id, group_key, unit, mass): where the disks around each group's places lie.

    Regions depend on places and radius only, so equal ones of many listings are measured once.
    """
    region = F.sha2(F.concat_ws(":", F.coalesce(F.col("x").cast("string"), F.lit("")), F.coalesce(F.col("y").cast("string"), F.lit("")), "group_key", F.col("radius_m").cast("string")), 256)
    keyed = groups.withColumn("region", region)
    placed = keyed.select("region", "radius_m", F.inline("places")).distinct().join(points, ["dataset", "external_id"]).select("region", "x", "y", "radius_m")
    spots = keyed.where("x IS NOT NULL").select("region", "x", "y", "radius_m").distinct()
    masses = written(support(placed.unionByName(spots).withColumnRenamed("region", "group_key"), units), "masses")
    return keyed.select("listing_id", F.col("group_key").alias("_g"), "region").join(masses.withColumnRenamed("group_key", "region"), "region").select("listing_id", F.col("_g").alias("group_key"), "unit", "mass")


def input_fingerprint(snapshot: Column, context: dict, version: str | None) -> Column:
    """SHA-256 of the canonical JSON of a listing's snapshot, the pinned context and the model's version."""
    canonical = lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False, allow_nan=False)
    return F.sha2(F.concat(F.lit(f'{{"context": {canonical(context)}, "listing": "'), snapshot, F.lit(f'", "model": {canonical(version)}}}')), 256)


def resolve(
    listings: DataFrame, places: DataFrame, aliases: DataFrame, points: DataFrame, units: DataFrame, stored: DataFrame, context: dict, limit: int | None = 100,
    model: dict | None = None, crosswalk: DataFrame | None = None, seen: DataFrame | None = None, fold: bool = True,
) -> dict[str, DataFrame]:
    """Resolve up to `limit` listings that are new or changed since `stored` (listing_id, input_fingerprint); all of them if it is None.

    Returns tables: `results` (listing_id, id, input_fingerprint, status, unit, probability, runner_up, conflict), where status
    is accepted, ambiguous (candidates, but none accepted) or unmatched; `candidates` (ranked units); `notes`; `counts`, one row.
    One listing_id with several snapshots is as many inputs, each resolved by its own evidence; the last column of candidates
    and notes, `id`, tells them apart.
    A model is {"version", "weights", "temperature", "ready"}; without a ready one nothing is accepted.
    """
    if limit is not None and not 1 <= limit <= 10_000:
        raise ValueError("the limit must be between 1 and 10,000")
    version = model["version"] if model else None
    name = F.sha2(F.concat(F.lit('["'), F.col("listing_id").cast("string"), F.lit('", "'), "input_fingerprint", F.lit('"]')), 256)
    keyed = written(listings.withColumn("input_fingerprint", input_fingerprint(F.col("snapshot_hash"), context, version)).withColumn("id", name), "inputs")
    changed = keyed.join(stored.select("listing_id", "input_fingerprint").distinct(), ["listing_id", "input_fingerprint"], "left_anti")
    todo = written(changed if limit is None else changed.orderBy("listing_id", "input_fingerprint").limit(limit), "todo")

    # Up to the results, an input goes by its id (without a snapshot by its listing's) in the place of the listing_id.
    own = F.coalesce(F.col("id"), F.col("listing_id").cast("string"))
    inputs = todo.withColumn("listing_id", own)
    names = todo.select(own.alias("_input"), F.col("listing_id").alias("_listing"), "id").distinct()
    if seen is not None:
        seen = seen.join(names.drop("id"), F.col("listing_id") == F.col("_listing")).withColumn("listing_id", F.col("_input")).drop("_input", "_listing")
    named = lambda df: df.withColumnRenamed("listing_id", "_input").join(names, "_input", "left").select(F.col("_listing").alias("listing_id"), *[c for c in df.columns if c != "listing_id"], "id")
    groups, notes = evidence(inputs, places, aliases, seen, fold)
    masses = supported(groups, points, units)
    plain = groups.select(*GROUP)
    if crosswalk is not None:
        area = written(G.crosswalk_support(inputs, crosswalk, fold), "areas")
        each = area.groupBy("listing_id", "group_key").agg(F.count("*").cast("int").alias("n_places"))
        told = each.select("listing_id", "group_key", F.lit("neighbourhood").alias("kind"), F.concat(F.lit("Reviewed area "), "group_key").alias("text"), F.lit(0.0).alias("radius_m"), F.lit(AREA_WEIGHT).alias("weight"), F.lit(1.0).alias("quality"), "n_places")
        plain, masses = plain.unionByName(told), masses.unionByName(area.select("listing_id", "group_key", "unit", "mass"))
    ranked = written(G.rank_units(G.independent(plain, masses)), "ranked")
    best = ranked.groupBy("listing_id").agg(F.lit(True).alias("_any"), F.max("conflict").alias("conflict"))
    out = todo.select("listing_id", "id", "input_fingerprint", own.alias("_input")).join(best.withColumnRenamed("listing_id", "_input"), "_input", "left")
    if model:
        verdict = G.accepted(G.probabilities(ranked, model["weights"], model["temperature"])).drop("conflict").withColumn("accepted", F.col("accepted") & F.lit(bool(model["ready"])))
        out = out.join(verdict.withColumnRenamed("listing_id", "_input"), "_input", "left")
    else:
        out = out.withColumn("unit", F.lit(None).cast("string")).withColumn("probability", F.lit(None).cast("double")).withColumn("runner_up", F.lit(None).cast("double")).withColumn("accepted", F.lit(False))
    taken = F.coalesce("accepted", F.lit(False))
    status = F.when(taken, "accepted").when(F.col("_any"), "ambiguous").otherwise("unmatched")
    results = written(out.select("listing_id", "id", "input_fingerprint", status.alias("status"), F.when(taken, F.col("unit")).alias("unit"), "probability", "runner_up", F.coalesce("conflict", F.lit(False)).alias("conflict")), "results")
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = results.agg(F.count("*").alias("saved"), one("accepted"), one("ambiguous"), one("unmatched")).crossJoin(F.broadcast(keyed.join(stored.select("listing_id", "input_fingerprint").distinct(), ["listing_id", "input_fingerprint"], "left_semi").agg(F.count("*").alias("unchanged"))))
    return {"results": results, "candidates": named(ranked), "notes": named(notes), "counts": counts}
