"""From mentions to small areas: name matching, evidence, ranking, calibrated acceptance, map feed.

Tables: places (dataset, external_id, name, category, settlement, number), aliases (old_name, new_name), mentions
(listing_id, name, category, …).  All branches of a name are kept; nothing is decided by which one is nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions import text as T
from brindle.operators.graph import written
from brindle.operators.labeling import fingerprint

# Features of a candidate and their default weights; temperatures tried; thresholds of acceptance.
FEATURES = ("support", "address", "street", "poi", "independent", "conflict", "ambiguity", "quality", "unknown")
WEIGHTS = (3.0, 2.0, 0.8, 0.8, 0.5, -3.0, -1.0, 0.5, 0.0)
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
LEAST_PROBABILITY, LEAST_MARGIN = 0.9, 0.15
SCHOOLS = ("school", "kindergarten")
SCHOOL_NUMBER = r"(?U)^\d+\s+(?:су|оу|соу|ну|дг|одз)(?:\s+.*)?$"
FUZZY_LENGTH, FUZZY_RATIO, FUZZY_TIE, TOKEN_LENGTH = 8, 0.94, 0.02, 3


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two keys."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def place_keys(places: DataFrame, fold: bool = True) -> DataFrame:
    """Places with their key; places without a name are dropped."""
    return places.withColumn("key", T.name_key(F.col("name"), fold)).where("key <> ''")


def _several(rows: DataFrame, *key: str) -> DataFrame:
    """Distinct rows, with `several`: does the key have more than one of them?"""
    return rows.distinct().withColumn("several", F.count("*").over(Window.partitionBy(*key)) > 1)


def match_names(mentions: DataFrame, places: DataFrame, aliases: DataFrame, fold: bool = True) -> DataFrame:
    """(mention_id, dataset, external_id, quality) for mentions (mention_id, name, category).

    Exact key and category first (streets also under their new names), then schools by number, then keys of at least eight
    letters that share a token and have a ratio of at least 0.94, with all near ties.  Addresses are matched by `addresses`.

    Names with many copies on both sides make far more pairs than there are rows.  So the pairs are not staged, and made
    distinct only where a pair could come twice: where a mention or a place has several keys.
    """
    keyed = written(_several(place_keys(places.where("category <> 'address'"), fold).select("dataset", "external_id", "category", "key"), "dataset", "external_id"), "places")
    asked = mentions.select("mention_id", "category", T.name_key(F.col("name"), fold).alias("key")).where("key <> ''")
    asked = written(_several(asked, "mention_id"), "mentions")
    renamed = aliases.select(T.name_key(F.col("old_name"), fold).alias("key"), T.name_key(F.col("new_name"), fold).alias("other")).distinct()
    new = asked.where("category = 'street'").join(renamed, "key").select("mention_id", "category", F.col("other").alias("key"))
    own = written(_several(asked.drop("several").unionByName(new), "mention_id"), "own")
    pair = ["mention_id", "dataset", "external_id"]
    at = ["category", "key"]
    # A pair comes twice only if two keys are common to its mention and its place.
    once = lambda df: df.where("NOT several").drop("several")
    more = lambda df: df.where("several").drop("several")
    exact = once(own).join(keyed.drop("several"), at).select(*pair).unionByName(more(own).join(once(keyed), at).select(*pair)).unionByName(more(own).join(more(keyed), at).select(*pair).distinct())

    matched = own.join(keyed.select(*at).distinct(), at, "left_semi").select("mention_id").distinct()
    rest = written(asked.join(matched, "mention_id", "left_anti"), "rest")
    number = F.regexp_extract("key", r"^(\d+)\b", 1)
    numbered = keyed.where(F.col("category").isin(*SCHOOLS) & (number != "")).select("category", number.alias("number"), "dataset", "external_id")
    schools = rest.where(F.col("category").isin(*SCHOOLS) & F.col("key").rlike(SCHOOL_NUMBER)).withColumn("number", number).select("mention_id", "category", "number")
    by_number = schools.join(numbered, ["category", "number"]).select(*pair).distinct()

    counted = schools.join(numbered.select("category", "number").distinct(), ["category", "number"], "left_semi").select("mention_id").distinct()
    open_ = written(rest.join(counted, "mention_id", "left_anti").where(F.length("key") >= FUZZY_LENGTH), "open")
    tokens = lambda df: df.withColumn("token", F.explode(F.array_distinct(F.split("key", " ")))).where(F.length("token") >= TOKEN_LENGTH)
    names = tokens(keyed.select("category", F.col("key").alias("other")).distinct().withColumn("key", F.col("other"))).select("category", "token", "other")
    # A ratio of 0.94 bounds the lengths: 2 * shorter / (shorter + longer) must reach it.  Each different key is compared once.
    near = F.least(F.length("key"), F.length("other")) * 2 >= (F.length("key") + F.length("other")) * FUZZY_RATIO
    pairs = tokens(open_.select("category", "key").distinct()).join(names, ["category", "token"]).where(near).select("category", "key", "other").distinct()
    scored = written(pairs.withColumn("ratio", similarity("key", "other")).where(F.col("ratio") >= FUZZY_RATIO), "scored")
    tops = scored.groupBy("category", "key").agg(F.max("ratio").alias("best"))
    best = scored.join(tops, ["category", "key"]).where(F.col("ratio") >= F.col("best") - FUZZY_TIE).select("category", "key", "other", "best")
    found = written(open_.join(best, ["category", "key"]).select("mention_id", "category", "other", "best", "several"), "found")
    stock = keyed.withColumnRenamed("key", "other")
    # Here it also does if one of them has two keys that are near to the other's.
    fuzzy = lambda a, b: a.join(b, ["category", "other"]).select(*pair, F.col("best").alias("quality"))
    fuzzy = fuzzy(once(found), once(stock)).unionByName(fuzzy(once(found), more(stock)).unionByName(fuzzy(more(found), stock.drop("several"))).distinct())
    return exact.withColumn("quality", F.lit(1.0)).unionByName(by_number.withColumn("quality", F.lit(1.0))).unionByName(fuzzy)


def addresses(mentions: DataFrame, places: DataFrame, aliases: DataFrame, fold: bool = True) -> DataFrame:
    """(mention_id, dataset, external_id) of addresses: street (or its new name), number and settlement all equal."""
    key = lambda c: T.name_key(F.coalesce(F.col(c), F.lit("")), fold)
    stock = places.where("category = 'address'").select("dataset", "external_id", key("name").alias("street_key"), key("number").alias("number_key"), key("settlement").alias("town_key"))
    split = T.street_address(F.col("name"))
    asked = mentions.withColumn("_a", split).where("_a IS NOT NULL").select("mention_id", key("_a.street").alias("street_key"), key("_a.number").alias("number_key"), key("city").alias("town_key"))
    renamed = aliases.select(key("old_name").alias("street_key"), key("new_name").alias("_new")).distinct()
    both = asked.unionByName(asked.join(renamed, "street_key").select("mention_id", F.col("_new").alias("street_key"), "number_key", "town_key"))
    return both.join(stock, ["street_key", "number_key", "town_key"]).select("mention_id", "dataset", "external_id").distinct()


def usable_mentions(listings: DataFrame) -> DataFrame:
    """(listing_id, mention_id, name, category, city, radius_m, quality, note) from listings with predicted places.

    Predictions must be fresh (hash of the exact text), in range, equal to the text they name and confident; negations,
    transit stops and broad distances are left out with a note.
    """
    each = listings.where(F.col("poi_description_sha256").eqNullSafe(T.exact_hash(F.col("description")))).select("listing_id", "description", "city", F.posexplode("pois").alias("pos", "p"))
    start, end = F.col("p.start"), F.col("p.end")
    text = F.col("description")
    sound = (F.trim("p.name") != "") & (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == F.col("p.name")) & F.col("p.confidence").between(0.8, 1.0)
    sound = F.coalesce(sound & ~F.isnan("p.confidence"), F.lit(False))
    distance = T.attached_radius(text, start, end)
    road = F.col("p.category").isin("street", "boulevard", "ring_road")
    house = F.regexp_extract(F.substring(text, end + 1, 12), r"(?iU)^\s*(?:№|номер)\s*(\d+[а-яa-z]?)\b", 1)
    note = (
        F.when(~sound, "invalid or low-confidence span")
        .when(T.excluded_context(text, start, end), "negative, comparative or agency context")
        .when(F.col("p.category").isin("bus_stop", "tram_stop", "metro_station"), "transit needs its own references")
        .when(~road & distance["radius"].isNull(), "invalid or broad distance")
        .when(~road & (distance["note"] == "ambiguous"), "ambiguous distance; broad support kept")
    )
    kept = sound & ~F.coalesce(note.isin("negative, comparative or agency context", "transit needs its own references", "invalid or broad distance"), F.lit(False))
    return each.select(
        "listing_id", F.concat_ws(":", F.col("listing_id").cast("string"), F.col("pos").cast("string")).alias("mention_id"), F.col("pos").alias("position"),
        F.when(road & (house != ""), F.concat(F.col("p.name"), F.lit(" № "), house)).otherwise(F.col("p.name")).alias("name"),
        F.when(road, "street").otherwise(F.col("p.category")).alias("category"), "city",
        F.when(road, 100.0).otherwise(distance["radius"]).alias("radius_m"), F.when(road, 1.0).otherwise(F.col("p.confidence")).alias("quality"), kept.alias("kept"), note.alias("note"),
    )


def evidence_groups(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    """(listing_id, group_key, kind, text, radius_m, weight, quality, n_places): mentions of the same places are one group.

    The group has the largest radius that was stated, and the rest from its heaviest, then first mention.  Rows of `mentions`:
    listing_id, mention_id, position, kind, text, radius_m, weight, quality; of `matches`: mention_id, dataset, external_id, quality.
    """
    places = matches.groupBy("mention_id").agg(F.array_sort(F.collect_set(F.struct("dataset", "external_id"))).alias("places"), F.max("quality").alias("_q"))
    joined = mentions.join(places, "mention_id").withColumn("group_key", F.sha2(F.to_json("places"), 256)).withColumn("quality", F.col("quality") * F.col("_q"))
    return joined.groupBy("listing_id", "group_key").agg(
        F.max_by(F.struct("kind", "text", "weight", "quality", "places"), F.struct("weight", -F.col("position"))).alias("g"), F.max("radius_m").alias("radius_m")
    ).select("listing_id", "group_key", "g.kind", "g.text", "radius_m", "g.weight", "g.quality", F.size("g.places").alias("n_places"))


def without_addressed_streets(groups: DataFrame, names: DataFrame) -> DataFrame:
    """A street whose name an address group of the same listing has is the same observation: it goes.

    `names`: listing_id, group_key, name_key of the places of all groups.
    """
    named = groups.select("listing_id", "group_key", "kind").join(names, ["listing_id", "group_key"])
    address = named.where("kind = 'address'").select("listing_id", "name_key").distinct()
    doubled = named.where("kind = 'street'").join(address, ["listing_id", "name_key"], "left_semi").select("listing_id", "group_key").distinct()
    return groups.join(doubled, ["listing_id", "group_key"], "left_anti")


def independent(groups: DataFrame, masses: DataFrame) -> DataFrame:
    """Groups with `support` map<unit, mass>, correlated ones collapsed: same units and L1 distance below 0.05.

    The collapse is greedy in group order and replaces a kept group by a heavier one, so it is a fold over the few groups of
    one listing.
    """
    cells = masses.groupBy("listing_id", "group_key").agg(F.array_sort(F.collect_list(F.struct("unit", "mass"))).alias("cells"))
    none = F.expr("CAST(array() AS array<struct<unit:string,mass:double>>)")
    full = groups.join(cells, ["listing_id", "group_key"], "left").withColumn("cells", F.coalesce("cells", none))
    fields = [c for c in full.columns if c != "listing_id"]
    lists = full.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct(F.col("group_key").alias("_o"), *fields))).alias("groups"))

    def fold(acc: Column, g: Column) -> Column:
        units = lambda x: F.transform(x["cells"], lambda c: c["unit"])
        apart = lambda k: F.aggregate(F.zip_with(k["cells"], g["cells"], lambda a, b: F.abs(a["mass"] - b["mass"])), F.lit(0.0), lambda s, x: s + x)
        alike = lambda k: (units(k) == units(g)) & (apart(k) < 0.05)
        at = F.array_position(F.transform(acc, lambda k: F.coalesce(alike(k), F.lit(False))), True)
        heavier = g["weight"] > F.element_at(acc, F.greatest(at, F.lit(1)).cast("int"))["weight"]
        replaced = F.transform(acc, lambda k, i: F.when((i + 1 == at) & heavier, g).otherwise(k))
        return F.when(at == 0, F.concat(acc, F.array(g))).otherwise(replaced)

    kept = lists.select("listing_id", F.aggregate("groups", F.filter("groups", lambda g: F.lit(False)), fold).alias("g"))
    return kept.select("listing_id", F.inline("g")).withColumn("support", F.map_from_entries("cells")).drop("_o", "cells")


def rank_units(groups: DataFrame) -> DataFrame:
    """(listing_id, unit, features, score, conflict, position) from independent groups with their support.

    Scores are not probabilities.  A conflict is two strong groups or more (quality 0.9, some unit with mass 0.1) without a
    unit that all of them allow.
    """
    whole = groups.groupBy("listing_id").agg(
        F.sum(F.col("weight") * F.col("quality")).alias("total"),
        F.count_if((F.col("quality") >= 0.9) & (F.size("support") > 0)).alias("n_strong"),
    )
    cells = groups.select("listing_id", "group_key", "kind", "weight", "quality", "n_places", F.explode("support").alias("unit", "mass"))
    strong = cells.where("quality >= 0.9 AND mass >= 0.1").groupBy("listing_id", "unit").agg(F.countDistinct("group_key").alias("n"))
    shared = strong.groupBy("listing_id").agg(F.max("n").alias("most"))
    context = whole.join(shared, "listing_id", "left").select("listing_id", F.when(F.col("total") != 0, F.col("total")).otherwise(1.0).alias("total"), ((F.col("n_strong") >= 2) & (F.coalesce("most", F.lit(0)) < F.col("n_strong"))).alias("conflict"))
    on = F.col("mass") > 0.1
    strength = F.col("mass") * F.col("quality")
    peak = lambda test: F.coalesce(F.max(F.when(test, strength)), F.lit(0.0))
    votes = F.count_if(on)
    per_unit = cells.groupBy("listing_id", "unit").agg(
        F.sum(F.col("weight") * F.col("quality") * F.col("mass")).alias("mass"), peak(F.col("kind") == "address").alias("address"), peak(F.col("kind") == "street").alias("street"),
        peak(~F.col("kind").isin("address", "street")).alias("poi"), votes.alias("votes"),
        F.coalesce(F.sum(F.when(on, 1 / F.greatest(F.lit(1), F.col("n_places")))), F.lit(0.0)).alias("branches"), F.coalesce(F.max(F.when(on, F.col("quality"))), F.lit(0.0)).alias("quality"),
    )
    joined = per_unit.join(context, "listing_id")
    features = F.array(
        F.col("mass") / F.col("total"), "address", "street", "poi", F.least(F.col("votes") / 3, F.lit(1.0)), F.col("conflict").cast("double"),
        1 - F.col("branches") / F.greatest(F.col("votes"), F.lit(1)), F.col("quality").cast("double"), F.lit(0.0),
    )
    scored = joined.withColumn("features", features).withColumn("score", dot(F.col("features"), WEIGHTS))
    order = Window.partitionBy("listing_id").orderBy(F.desc("score"), "unit")
    return scored.select("listing_id", "unit", "features", "score", "conflict", F.row_number().over(order).alias("position"))


def dot(features: Column, weights) -> Column:
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)


def softmax(logits: Column) -> Column:
    """Structs of term (relative to the greatest, which is 1) and probability."""
    peak = F.array_max(logits)
    terms = F.transform(logits, lambda v: F.exp(v - peak))
    return F.transform(F.array(terms), lambda t: F.transform(t, lambda x: F.struct(x.alias("term"), (x / F.aggregate(t, F.lit(0.0), lambda a, b: a + b)).alias("probability"))))[0]


def probabilities(ranked: DataFrame, weights, temperature: float) -> DataFrame:
    """(listing_id, unit, probability, place) over candidates and an explicit unknown (null unit).

    Places go by the terms: division may round different ones to one probability.
    """
    unknown = [0.0] * (len(FEATURES) - 1) + [1.0]
    lists = ranked.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("position", "unit", "features"))).alias("c"), F.first("conflict").alias("conflict"))
    logits = F.transform(F.concat(F.transform("c", lambda c: c["features"]), F.array(F.array(*map(F.lit, unknown)))), lambda v: dot(v, weights) / temperature)
    units = F.concat(F.transform("c", lambda c: c["unit"]), F.array(F.lit(None).cast("string")))
    each = lists.select("listing_id", "conflict", F.posexplode(F.arrays_zip(units.alias("unit"), softmax(logits).alias("p"))).alias("pos", "x")).select("listing_id", "conflict", "pos", "x.unit", "x.p.probability", "x.p.term")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("listing_id").orderBy(F.desc("term"), "pos"))).drop("pos", "term")


def accepted(probable: DataFrame) -> DataFrame:
    """(listing_id, unit, probability, runner_up, accepted)."""
    top = probable.groupBy("listing_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("unit"))).alias("unit"), F.max(F.when(F.col("place") == 1, F.col("probability"))).alias("probability"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("probability"))), F.lit(0.0)).alias("runner_up"), F.max("conflict").alias("conflict"),
    )
    gate = F.col("unit").isNotNull() & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("probability") - F.col("runner_up") >= LEAST_MARGIN) & ~F.col("conflict")
    return top.select("listing_id", "unit", "probability", "runner_up", gate.alias("accepted"))


def assignment_faults(assignments: DataFrame) -> DataFrame:
    """(listing_id, faults): what an assignment of a listing to a unit must not be."""
    hexes = r"^[0-9a-f]{64}$"
    machine = F.col("basis") == "calibrated"
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    gap = F.col("confidence") - F.col("runner_up_confidence")
    rules = {
        "unit": blank("planning_unit_id") | (F.length("planning_unit_id") > 100),
        "release": ~F.coalesce(F.col("release_id").rlike(hexes), F.lit(False)),
        "description": ~F.coalesce(F.col("description_sha256").rlike(hexes), F.lit(False)),
        "resolver": blank("resolver_version") | (F.length("resolver_version") > 200),
        "basis": ~F.coalesce(F.col("basis").isin("calibrated", "human_reviewed"), F.lit(False)),
        "evidence": ~F.coalesce(F.size("evidence").between(1, 30) & F.forall("evidence", lambda e: (F.trim(e) != "") & (F.length(e) <= 2000)), F.lit(False)),
        "calibrator": machine & blank("calibrator_version"),
        "probabilities": machine & (F.col("confidence").isNull() | F.col("runner_up_confidence").isNull()),
        "sum": machine & (F.col("confidence") + F.col("runner_up_confidence") > 1.000001),
        "gates": machine & ((F.col("confidence") < LEAST_PROBABILITY) | (gap < LEAST_MARGIN)),
        "reviewer": (F.col("basis") == "human_reviewed") & blank("reviewed_by"),
        "claim": (F.col("basis") == "human_reviewed") & (F.col("confidence").isNotNull() | F.col("runner_up_confidence").isNotNull()),
    }
    faults = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return assignments.select("listing_id", faults.alias("faults")).where(F.size("faults") > 0)


def map_feed(assignments: DataFrame, listings: DataFrame, units: DataFrame, release: str) -> DataFrame:
    """Ads for the map: of the active release, of active listings whose text is unchanged, in known units; unsafe links go."""
    now = assignments.where(F.col("release_id") == release).join(units.select(F.col("unit").alias("planning_unit_id")).distinct(), "planning_unit_id")
    live = listings.where("status = 'active'").select("listing_id", "title", "url", "price_amount", "price_currency", T.exact_hash(F.coalesce("description", F.lit(""))).alias("_hash"))
    fresh = now.join(live, "listing_id").where(F.col("_hash") == F.col("description_sha256"))
    return fresh.select("listing_id", "title", T.safe_link(F.col("url")).alias("url"), "planning_unit_id", "confidence", "basis", "evidence", "resolver_version", F.lit("unit_only").alias("location_precision"), F.col("price_amount").cast("string").alias("price"), F.col("price_currency").alias("currency"))


def map_counts(assignments: DataFrame, feed: DataFrame) -> DataFrame:
    """One row: ads on the map, and assignments that are not shown."""
    return feed.agg(F.count("*").alias("ads")).crossJoin(F.broadcast(assignments.agg(F.count("*").alias("n")))).select("ads", (F.col("n") - F.col("ads")).alias("excluded"))


def current_resolutions(resolutions: DataFrame, snapshots: DataFrame, reviews: DataFrame) -> DataFrame:
    """The newest resolution per listing whose snapshot is still current, with its last review.

    Stale ones are dropped before the choice, so an older matching resolution can win; a review that names no unit hides
    the listing.
    """
    fresh = resolutions.join(snapshots.select("listing_id", "snapshot_hash"), ["listing_id", "snapshot_hash"])
    newest = fresh.groupBy("listing_id").agg(F.max_by(F.struct(*fresh.columns), F.struct("created_at", "resolution_id")).alias("r")).select("r.*")
    last = reviews.groupBy("resolution_id").agg(F.max_by(F.struct("planning_unit_id", "reviewer"), "review_id").alias("v"))
    joined = newest.join(last, "resolution_id", "left").where("v IS NULL OR v.planning_unit_id IS NOT NULL")
    return joined.withColumn("basis", F.when(F.col("v").isNotNull(), "human_reviewed").otherwise("calibrated")).withColumn("unit", F.coalesce("v.planning_unit_id", "unit")).drop("v")


def preview(ranked: DataFrame, markers: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Unreviewed best candidates; listings abstain whose winner lies outside the box, that conflict or have little support."""
    west, south, east, north = box
    best = ranked.where("position = 1").join(markers, "unit", "left")
    ok = F.col("x").between(west, east) & F.col("y").between(south, north) & ~F.col("conflict") & (F.col("features")[0] >= 0.25)
    return best.where(ok).select("listing_id", "unit", F.lit("candidate_preview").alias("basis"))


# Model of the ranker: a few hundred reviewed examples, fitted on the driver


def example_faults(examples: DataFrame) -> DataFrame:
    """(fault, value): why examples must not be learned from.

    Examples: group_id, geography_group, listing_id, split, description_sha256, planning_unit_id, observed_at (ISO text),
    candidates.  Groups, texts, areas and units must not be in two splits, a listing not twice; times need a zone, and the
    splits must follow each other in time.
    """
    rows = examples.withColumn("group_id", F.trim("group_id")).withColumn("geography_group", F.trim("geography_group"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    one = lambda test, fault: rows.where(test).select(F.lit(fault).alias("fault"), F.col("listing_id").cast("string").alias("value"))
    found = one(blank("group_id") | blank("geography_group") | ~F.coalesce(F.col("split").isin("train", "calibration", "test"), F.lit(False)), "split and groups are required")
    found = found.unionByName(one(~F.coalesce(F.col("observed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False)), "time without a zone"))
    found = found.unionByName(feature_faults(rows).select(F.lit("features").alias("fault"), F.col("listing_id").cast("string").alias("value")))
    found = found.unionByName(rows.groupBy("listing_id").count().where("count > 1").select(F.lit("listing twice").alias("fault"), F.col("listing_id").cast("string").alias("value")))
    leaks = {"group_id": "group in two splits", "description_sha256": "text in two splits", "geography_group": "area in two splits", "planning_unit_id": "unit in two splits"}
    for column, fault in leaks.items():
        spread = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.min("split").alias("a"), F.max("split").alias("b"))
        found = found.unionByName(spread.where("a <> b").select(F.lit(fault).alias("fault"), "value"))
    single = rows.groupBy("split", "group_id").agg(F.min_by("observed_at", "listing_id").alias("at"))
    ends = single.withColumn("t", F.try_to_timestamp("at")).groupBy().pivot("split", ["train", "calibration", "test"]).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    late = ends.where("NOT (train_b < calibration_a AND calibration_b < test_a)").select(F.lit("splits out of order").alias("fault"), F.lit("observed_at").alias("value"))
    return found.unionByName(late)


def train_checked(examples: DataFrame, context: dict, **settings) -> dict:
    """`train_ranker` on a table of reviewed examples, refused if any rule of `example_faults` is broken."""
    faults = example_faults(examples).limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{r['fault']}: {r['value']}" for r in faults))
    columns = ("group_id", "listing_id", "split", F.col("planning_unit_id").alias("unit"), "candidates", "conflict")
    return train_ranker([r.asDict(recursive=True) for r in examples.select(*columns).collect()], context, **settings)


def train_ranker(examples: list[dict], context: dict, steps: int = 600, rate: float = 0.15, penalty: float = 0.002) -> dict:
    """Listwise logistic ranker on `train`, temperature on `calibration`, metrics on `test`.

    Examples: group_id, listing_id, split, unit (or None), candidates [{unit, features}], conflict.  One example a group is
    used, the least listing_id; `train_checked` refuses examples that leak between splits or are out of order.
    """
    parts: dict[str, dict[str, dict]] = {"train": {}, "calibration": {}, "test": {}}
    for e in sorted(examples, key=lambda e: e["listing_id"]):
        parts[e["split"]].setdefault(e["group_id"], e)
    need = {"train": 40, "calibration": 20, "test": 40}
    for name, rows in parts.items():
        unknown = sum(e["unit"] is None for e in rows.values())
        if len(rows) < need[name] or unknown < 5 or len(rows) - unknown < 5:
            raise ValueError(f"{name}: too few groups")
    none = np.eye(len(FEATURES))[-1]

    def arrays(e: dict) -> tuple[np.ndarray, int]:
        units = [c["unit"] for c in e["candidates"]]
        goal = units.index(e["unit"]) if e["unit"] in units else len(units)
        return np.vstack([*[c["features"] for c in e["candidates"]], none]), goal

    def soft(v: np.ndarray) -> np.ndarray:
        v = np.exp(v - v.max())
        return v / v.sum()

    train = [arrays(e) for e in parts["train"].values()]
    weights = np.zeros(len(FEATURES))
    for _ in range(steps):
        slope = sum(x.T @ (soft(x @ weights) - np.eye(len(x))[goal]) for x, goal in train)
        weights -= rate * (slope / len(train) + penalty * weights)
    calibration = [arrays(e) for e in parts["calibration"].values()]
    loss = lambda t: -sum(math.log(max(1e-12, soft(x @ weights / t)[goal])) for x, goal in calibration)
    temperature = min(TEMPERATURES, key=loss)
    counts = {"examples": 0, "accepted": 0, "correct": 0}
    brier = 0.0
    for e in parts["test"].values():
        x, _ = arrays(e)
        p = soft(x @ weights / temperature)
        order = np.argsort(-p, kind="stable")
        units = [*[c["unit"] for c in e["candidates"]], None]
        top, runner = units[order[0]], p[order[1]] if len(p) > 1 else 0.0
        right = top == e["unit"]
        brier += (p[order[0]] - right) ** 2
        counts["examples"] += 1
        if top is not None and p[order[0]] >= LEAST_PROBABILITY and p[order[0]] - runner >= LEAST_MARGIN and not e["conflict"]:
            counts["accepted"] += 1
            counts["correct"] += right
    model = {"feature_names": list(FEATURES), "weights": weights.tolist(), "temperature": temperature, "context": context, "split_counts": {k: len(v) for k, v in parts.items()}, "test_metrics": counts | {"brier": brier / counts["examples"]}}
    return model | {"version": fingerprint(model)}


def wilson(correct: int, count: int, z: float = 1.96) -> float:
    if not count:
        return 0.0
    p = correct / count
    return (p + z * z / (2 * count) - z * math.sqrt(p * (1 - p) / count + z * z / (4 * count * count))) / (1 + z * z / count)


def model_ready(model: dict) -> bool:
    """Enough independent groups, and a lower bound of accepted precision of at least 0.9."""
    m, n = model["test_metrics"], model["split_counts"]
    return n["train"] >= 40 and n["calibration"] >= 20 and m["examples"] >= 40 and m["accepted"] >= 35 and wilson(m["correct"], m["accepted"]) >= 0.9


def model_faults(model: dict, context: dict) -> list[str]:
    """Why a stored model must not be used."""
    faults = []
    if model.get("feature_names") != list(FEATURES) or model.get("context") != context:
        faults.append("context")
    w, t = model.get("weights"), model.get("temperature")
    if not isinstance(w, list) or len(w) != len(FEATURES) or not all(type(x) in (int, float) and math.isfinite(x) for x in w) or type(t) not in (int, float) or not 0.1 <= t <= 10:
        faults.append("coefficients")
    if model.get("version") != fingerprint({k: v for k, v in model.items() if k != "version"}):
        faults.append("fingerprint")
    m = model.get("test_metrics", {})
    if not all(type(m.get(k)) is int for k in ("examples", "accepted", "correct")) or not 0 <= m["correct"] <= m["accepted"] <= m["examples"]:
        faults.append("metrics")
    return faults


def crosswalk_support(listings: DataFrame, crosswalk: DataFrame, fold: bool = True) -> DataFrame:
    """(listing_id, group_key, unit, mass): equal shares of the units that reviewers list for an area."""
    n = crosswalk.groupBy("area_key").agg(F.count("*").alias("n"))
    return listings.select("listing_id", T.name_key(F.col("area"), fold).alias("area_key")).join(crosswalk.join(n, "area_key"), "area_key").select("listing_id", F.concat(F.lit("neighbourhood:"), "area_key").alias("group_key"), "unit", (1 / F.col("n")).alias("mass"))


def crosswalk_faults(crosswalk: DataFrame, units: DataFrame, fold: bool = True) -> DataFrame:
    """(area_key, fault): keys not normalized, unknown units, repeated units, over 564 units of one area."""
    known = units.select(F.col("unit")).distinct().withColumn("known", F.lit(True))
    each = crosswalk.join(known, "unit", "left")
    counts = each.groupBy("area_key").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("d"), F.count_if(F.col("known").isNull()).alias("unknown"))
    fault = F.when(F.col("unknown") > 0, "unknown unit").when(F.col("n") != F.col("d"), "repeated unit").when(F.col("n") > 564, "too many units").when(T.name_key(F.col("area_key"), fold) != F.col("area_key"), "key not normalized")
    return counts.select("area_key", fault.alias("fault")).where("fault IS NOT NULL")


def review_faults(reviews: DataFrame, resolutions: DataFrame, units: DataFrame) -> DataFrame:
    """(review_id, fault): blank reviewer or group, unknown split, unknown resolution, unit that is not in its release."""
    known = resolutions.select("resolution_id", "release_id").distinct()
    there = units.select("release_id", F.col("unit").alias("planning_unit_id"), F.lit(True).alias("_unit")).distinct()
    joined = reviews.join(known, "resolution_id", "left").join(there, ["release_id", "planning_unit_id"], "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    fault = (
        F.when(blank("reviewer") | blank("group_id") | blank("geography_group") | ~F.coalesce(F.col("split").isin("train", "calibration", "test"), F.lit(False)), "reviewer, groups and split are required")
        .when(F.col("release_id").isNull(), "unknown resolution")
        .when(F.col("planning_unit_id").isNotNull() & F.col("_unit").isNull(), "unit is not in that release")
    )
    return joined.select("review_id", fault.alias("fault")).where("fault IS NOT NULL")


def reviewed_examples(resolutions: DataFrame, reviews: DataFrame, context: str) -> DataFrame:
    """The last review of each listing, kept if its resolution has the wanted context."""
    joined = resolutions.select("resolution_id", "listing_id", "context", "description_sha256", "observed_at", "candidates").join(reviews, "resolution_id")
    last = joined.groupBy("listing_id").agg(F.max_by(F.struct(*joined.columns), "review_id").alias("r")).select("r.*")
    return last.where(F.col("context") == context)


def split_counts(examples: DataFrame) -> DataFrame:
    """(split, groups, known, unknown, enough): one example a property group, the least listing."""
    single = examples.groupBy("split", "group_id").agg(F.min_by("planning_unit_id", "listing_id").alias("unit"))
    counts = single.groupBy("split").agg(F.count("*").alias("groups"), F.count("unit").alias("known"))
    need = F.when(F.col("split") == "calibration", 20).otherwise(40)
    return counts.withColumn("unknown", F.col("groups") - F.col("known")).withColumn("enough", (F.col("groups") >= need) & (F.col("known") >= 5) & (F.col("unknown") >= 5))


def feature_faults(examples: DataFrame) -> DataFrame:
    """Examples with a candidate whose features are not nine finite numbers from 0 to 1."""
    fine = lambda v: (F.size(v) == len(FEATURES)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0))
    return examples.where(F.exists("candidates", lambda c: ~F.coalesce(fine(c["features"]), F.lit(False)))).select("listing_id")


def map_selection(ads: DataFrame, least: float, query: str = "") -> DataFrame:
    """Ads a map shows: reviewed ones and previews always, others from a confidence on; a query looks in titles and units."""
    shown = ads.where(F.col("basis").isin("human_reviewed", "candidate_preview") | (F.col("confidence") >= least))
    text = F.lower(F.concat_ws(" ", "title", "unit_name", "planning_unit_id"))
    return shown if not query.strip() else shown.where(F.contains(text, F.lit(query.strip().lower())))


def ads_per_unit(ads: DataFrame) -> DataFrame:
    return ads.groupBy("planning_unit_id").agg(F.count("*").alias("ads")).orderBy(F.desc("ads"), "planning_unit_id")


def places_of(features: DataFrame, addresses_: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, aliases) of a release: named features (surfaces as streets), addresses, and renamings."""
    named = features.where("name IS NOT NULL AND kind <> 'boundary'").select("dataset", "external_id", "name", F.when(F.col("kind") == "surface", "street").otherwise(F.col("category")).alias("category"), F.lit("").alias("settlement"), F.lit("").alias("number"))
    houses = addresses_.select(F.lit("official_addresses").alias("dataset"), "external_id", F.col("street").alias("name"), F.lit("address").alias("category"), "settlement", "number")
    return named.where("category IS NOT NULL").unionByName(houses), aliases.select("old_name", "new_name")


def observations(listings: DataFrame, seen: DataFrame) -> DataFrame:
    """Groups from verified coordinates: the newest observation of a listing, its uncertainty as radius, weight five."""
    last = seen.where(F.col("uncertainty_m").between(1, 2000)).groupBy("listing_id").agg(F.max_by(F.struct("observation_id", "source", "uncertainty_m", "x", "y"), F.struct("created_at", "observation_id")).alias("o"))
    return listings.select("listing_id").join(last, "listing_id").select("listing_id", F.lit("verified-coordinate").alias("group_key"), F.lit("address").alias("kind"), F.concat(F.lit("Verified coordinate: "), "o.source").alias("text"), F.col("o.uncertainty_m").cast("double").alias("radius_m"), F.lit(5.0).alias("weight"), F.lit(1.0).alias("quality"), F.lit(1).alias("n_places"), F.col("o.x").alias("x"), F.col("o.y").alias("y"))
