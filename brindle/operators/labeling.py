"""Human labelling: candidates, batches, teacher results, regions, reconciliation, approval.

Annotation regions and teacher predictions are arrays of structs; checks give arrays of messages, never exceptions, so that
one bad row does not fail a job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions import text as T
from brindle.operators.graph import written

MIN_CHARS = 80
TEACHER = ("teacher_status", "teacher_result", "teacher_problems")

# Categories of places, units of distance, metres per minute.
CATEGORIES = (
    "metro_station", "bus_stop", "tram_stop", "school", "kindergarten", "university", "park", "shopping_mall", "supermarket", "hospital", "medical_center",
    "pharmacy", "gym", "sports_facility", "restaurant", "bank", "boulevard", "ring_road", "street", "market", "airport", "other",
)
UNITS = ("m", "km", "min_walk", "min_drive", "min_transit", "min_unspecified", "nearby")
METRES_PER_MINUTE = {"min_walk": 80, "min_unspecified": 80, "min_transit": 250, "min_drive": 400}

POI = "struct<category:string,name:string,distance:struct<value:double,unit:string>,evidence:string>"
REGION = "struct<id:string,from_name:string,value:struct<start:int,end:int,text:array<string>,labels:array<string>,choices:array<string>,number:double>>"


# Candidates and batches


def reserve(listings: DataFrame, tasks: DataFrame, limit: int, group: str, newest: str, key: str, text: str) -> DataFrame:
    """Up to `limit` listings without a task, long enough, spread over groups: newest of every group first, then seconds, …

    Of listings with the same squeezed text only the newest is offered, and none whose text has a task already.  Ranks over
    `limit` cannot be chosen, so Spark prunes each group to `limit` rows before the shuffle.
    """
    open_ = listings.join(tasks.select(key).distinct(), key, "left_anti").withColumn("content_hash", T.spaced_hash(F.col(text)))
    open_ = open_.where(F.length(T.squeezed(F.col(text))) >= MIN_CHARS).join(tasks.select("content_hash").distinct(), "content_hash", "left_anti")
    names = open_.columns
    single = open_.groupBy("content_hash").agg(F.max_by(F.struct(*names), F.struct(F.col(newest), -F.col(key))).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in names])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(newest), key))
    return single.withColumn("area_rank", rank).where(F.col("area_rank") <= limit).orderBy("area_rank", F.desc(newest), key).limit(limit)


def unselected(listings: DataFrame, ledger: DataFrame, dataset: str, key: str) -> DataFrame:
    """Listings never selected for this dataset."""
    return listings.join(ledger.where(F.col("dataset") == dataset).select(key).distinct(), key, "left_anti")


def seeded_sample(candidates: DataFrame, key: str, seed: str, rate: float, limit: int) -> DataFrame:
    """min(limit, max(1, round half even (n * rate))) rows in the order of sha256(seed:key): the same whatever the partitions."""
    n = candidates.count()
    if not n:
        return candidates
    target = min(limit, max(1, round(n * rate)))
    return candidates.orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256), key).limit(target)


def claimable(tasks: DataFrame) -> DataFrame:
    return tasks.where("selection_batch_id IS NULL AND export_status = 'not_exported' AND status = 'pending'")


def claim(tasks: DataFrame, batch: str, limit: int) -> DataFrame:
    """Tasks with the oldest claimable ones in the batch; unchanged if the batch exists already."""
    if tasks.where(F.col("selection_batch_id") == batch).limit(1).count():
        return tasks
    chosen = claimable(tasks).orderBy("created_at", "id").limit(limit).select("id", F.lit(batch).alias("_batch"))
    return tasks.join(chosen, "id", "left").withColumn("selection_batch_id", F.coalesce("_batch", "selection_batch_id")).drop("_batch").select(*tasks.columns)


# Places in texts


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named there."""
    return F.transform(F.array(value), use)[0]


def find_evidence(quote: Column, text: Column) -> Column:
    """Struct<start, end> in code points of the first place where the quote's words stand, whatever the case and white space.

    Positions come from the lengths of what precedes and follows the match, so they count code points, not UTF-16 units.
    """
    # Every piece is quoted literally; \E inside a piece would end the quotation early.
    literal = lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = lambda pieces: F.concat(F.lit("(?isU)"), F.array_join(F.transform(pieces, literal), r"\s+"))
    around = _bound(F.filter(F.split(quote, r"(?U)\s+", -1), lambda p: p != ""), lambda pieces: F.when(F.size(pieces) > 0, F.split(text, pattern(pieces), 2)))
    return _bound(around, lambda s: F.when(F.size(s) == 2, F.struct(F.length(s[0]).alias("start"), (F.length(text) - F.length(s[1])).alias("end"))))


def is_identifier(name: Column) -> Column:
    return name.rlike(r"[\p{Nd}\p{Lu}]")


def problems(pois: Column, text: Column) -> Column:
    """Messages on extractions that cannot be trusted as they are; empty if none.  The wording is fixed: reviewers search for it."""

    def checks(p: Column, i: Column) -> Column:
        at = lambda message: F.concat(F.lit("pois["), i.cast("string"), F.lit("]: "), message)
        value, unit = p["distance"]["value"], p["distance"]["unit"]
        name = F.when(F.trim(p["name"]) == "", at(F.lit("needs a name or number that identifies the place"))).when(~is_identifier(p["name"]), at(F.concat(F.lit("name '"), p["name"], F.lit("' is generic, not a name or number"))))
        name = F.coalesce(name, F.when(find_evidence(p["name"], p["evidence"]).isNull(), at(F.concat(F.lit("name '"), p["name"], F.lit("' does not appear in its evidence")))))
        return F.array_compact(
            F.array(
                F.when(find_evidence(p["evidence"], text).isNull(), at(F.concat(F.lit("evidence not found in text: '"), p["evidence"], F.lit("'")))),
                name,
                F.when((unit == "nearby") & value.isNotNull(), at(F.lit("unit 'nearby' must have value null"))),
                F.when((unit != "nearby") & value.isNull(), at(F.concat(F.lit("unit '"), unit, F.lit("' needs a value")))),
                F.when(value <= 0, at(F.lit("distance value must be positive"))),
            )
        )

    return F.flatten(F.transform(pois, checks))


def schema_problems(pois: Column) -> Column:
    """Categories and units outside the contract."""

    def checks(p: Column, i: Column) -> Column:
        unknown = lambda value, known, what: F.when(~F.coalesce(value.isin(*known), F.lit(False)), F.concat(F.lit("pois["), i.cast("string"), F.lit(f"]: unknown {what}")))
        return F.array_compact(F.array(unknown(p["category"], CATEGORIES, "category"), unknown(p["distance"]["unit"], UNITS, "unit")))

    return F.flatten(F.transform(pois, checks))


def estimated_metres(value: Column, unit: Column) -> Column:
    out = F.when(unit == "m", value).when(unit == "km", value * 1000)
    for name, speed in METRES_PER_MINUTE.items():
        out = out.when(unit == name, value * speed)
    return out


def name_spans(pois: Column, text: Column) -> Column:
    """Spans (start, end, category) of names inside their evidence, first come first kept where they overlap, in order."""

    def span(p: Column) -> Column:
        placed = lambda quote, inner: F.when(inner.isNotNull(), F.struct((quote["start"] + inner["start"]).alias("start"), (quote["start"] + inner["end"]).alias("end"), p["category"].alias("category")))
        named = lambda quote: find_evidence(p["name"], F.substring(text, quote["start"] + 1, quote["end"] - quote["start"]))
        return _bound(find_evidence(p["evidence"], text), lambda quote: _bound(named(quote), lambda inner: placed(quote, inner)))

    from brindle.operators.evaluation import disjoint

    return F.array_sort(_bound(F.array_compact(F.transform(pois, span)), disjoint))


# Regions of the labelling tool


def regions_of(pois: Column, text: Column) -> Column:
    """Struct<regions, notes>: what a teacher's places look like as regions, and notes on those that cannot be drawn."""
    none = F.lit(None)

    def value(start, end, texts=none, labels=none, choices=none, number=none):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), texts.cast("array<string>").alias("text"), labels.cast("array<string>").alias("labels"), choices.cast("array<string>").alias("choices"), number.cast("double").alias("number"))

    def draw(p: Column, i: Column) -> Column:
        at = find_evidence(p["evidence"], text)
        one = lambda field, v: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("id"), F.lit(field).alias("from_name"), v.alias("value"))
        quote = F.array(F.substring(text, at["start"] + 1, at["end"] - at["start"]))
        parts = F.array(
            one("category", value(at["start"], at["end"], quote, F.array(p["category"]))),
            one("unit", value(at["start"], at["end"], quote, choices=F.array(p["distance"]["unit"]))),
            F.when(p["name"] != "", one("name", value(at["start"], at["end"], F.array(p["name"])))),
            F.when(p["distance"]["value"].isNotNull(), one("value", value(at["start"], at["end"], quote, number=p["distance"]["value"]))),
        )
        return F.when(at.isNotNull(), F.array_compact(parts))

    drawn = F.flatten(F.array_compact(F.transform(pois, draw)))
    lost = F.filter(pois, lambda p: find_evidence(p["evidence"], text).isNull())
    return F.struct(drawn.alias("regions"), F.transform(lost, lambda p: F.concat(F.lit("Teacher POI not drawn (evidence not in text): "), F.to_json(p))).alias("notes"))


def pois_of(annotations: DataFrame, key: str, text: str, regions: str) -> DataFrame:
    """(key, pois) from arrays of regions: fields grouped by region id, places in text order."""
    each = annotations.select(key, text, F.posexplode(regions).alias("_pos", "_r")).select(key, text, "_pos", F.col("_r.id").alias("_id"), F.col("_r.from_name").alias("_field"), F.col("_r.value").alias("_v"))
    pick = lambda field: F.max_by(F.when(F.col("_field") == field, F.col("_v")), F.when(F.col("_field") == field, F.col("_pos")))
    merged = each.groupBy(key, "_id").agg(F.first(text).alias("_text"), *[pick(f).alias(f"_{f}") for f in ("category", "unit", "name", "value")]).where("_category IS NOT NULL")
    quote = F.expr("substring(_text, _category.start + 1, _category.end - _category.start)")
    name = F.coalesce(F.trim(F.get(F.col("_name.text"), F.lit(0))), F.lit(""))
    poi = F.struct(F.get(F.col("_category.labels"), F.lit(0)).alias("category"), name.alias("name"), F.struct(F.col("_value.number").alias("value"), F.get(F.col("_unit.choices"), F.lit(0)).alias("unit")).alias("distance"), quote.alias("evidence"))
    order = F.struct(F.col("_category.start").alias("start"), F.coalesce(find_evidence(name, quote)["start"], F.lit(0)).alias("at"), poi["category"].alias("category"), poi.alias("poi"))
    return merged.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["poi"]).alias("pois"))


def checked_annotations(annotations: DataFrame, key: str, text: str, regions: str) -> DataFrame:
    """(key, pois, problems): problems is empty where the annotation is valid, pois is empty where it is not."""
    found = pois_of(annotations, key, text, regions)
    joined = annotations.select(key, text).join(found, key, "left").withColumn("pois", F.coalesce("pois", F.array().cast(f"array<{POI}>")))
    checked = joined.withColumn("problems", F.concat(schema_problems(F.col("pois")), problems(F.col("pois"), F.col(text))))
    return checked.select(key, F.when(F.size("problems") == 0, F.col("pois")).otherwise(F.array().cast(f"array<{POI}>")).alias("pois"), "problems")


def latest_annotation(annotations: Column, deleted_too: bool = True) -> Column:
    """The last saved annotation by (updated_at, id); cancelled ones never count, nor deleted ones by default.

    `deleted_too=False` follows files exported by hand, where the first of equal times wins.
    """
    live = F.filter(annotations, lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)) & (~F.coalesce(a["deleted"], F.lit(False)) if deleted_too else F.lit(True)))
    tie = (lambda a, i: F.coalesce(a["id"], F.lit(0))) if deleted_too else (lambda a, i: -i)
    return F.array_max(F.transform(live, lambda a, i: F.struct(F.coalesce(a["updated_at"], F.lit("")).alias("t"), tie(a, i).cast("long").alias("n"), a.alias("annotation"))))["annotation"]


def annotation_revision(annotation_id: Column, updated_at: Column) -> Column:
    """48 bits of sha256(id:updated_at)."""
    seed = F.concat(F.coalesce(annotation_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(updated_at, F.lit("")))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long")


def in_gold(content_hash: Column, percent: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit("gold:"), content_hash), 256), 1, 8), 16, 10).cast("long") % 100 < percent


def task_payload(tasks: DataFrame) -> DataFrame:
    """(id, payload JSON): what is sent to the labelling tool, with the teacher's regions and notes."""
    drawn = F.when(F.col("teacher_result").isNotNull() & F.col("teacher_status").isin("ok", "invalid"), regions_of(F.col("teacher_result"), F.col("description_snapshot")))
    trouble = F.coalesce(F.col("teacher_problems"), F.array().cast("array<string>"))
    status = F.when(F.size(trouble) > 0, trouble).otherwise(F.array(F.concat(F.lit("Teacher status: "), F.col("teacher_status"))))
    notes = F.when(drawn.isNotNull(), F.concat(drawn["notes"], trouble)).when(F.col("teacher_status") != "missing", status).otherwise(F.array(F.lit("No teacher label available; annotate from scratch.")))
    model = F.concat_ws("/", F.coalesce("teacher_provider", F.lit("unknown-provider")), F.coalesce("teacher_model", F.lit("unknown-model")), F.coalesce("teacher_prompt_version", F.lit("unknown-prompt")))
    empty = F.lit("")
    data = F.struct(
        F.col("description_snapshot").alias("text"), F.concat(F.lit("Listing "), F.col("listing_id")).alias("title"),
        F.concat(F.lit("Listing: "), F.col("listing_id"), F.lit(" | Task: "), F.col("id"), F.lit(" | Batch: "), F.coalesce("selection_batch_id", F.lit("unassigned"))).alias("meta"),
        F.array_join(notes, "\n").alias("review_notes"), F.col("id").alias("labeling_task_id"), "listing_id", "content_hash", F.coalesce("selection_batch_id", empty).alias("selection_batch_id"),
        F.coalesce("teacher_provider", empty).alias("teacher_provider"), F.coalesce("teacher_model", empty).alias("teacher_model"), F.coalesce("teacher_prompt_version", empty).alias("teacher_prompt_version"),
    )
    predictions = F.when(drawn.isNotNull(), F.array(F.struct(model.alias("model_version"), drawn["regions"].alias("result"))))
    return tasks.select("id", F.to_json(F.struct(data.alias("data"), predictions.alias("predictions"))).alias("payload"))


def labeling_config() -> str:
    """The labelling interface: one label a category, a name, a unit and a value for each region."""
    from xml.sax.saxutils import quoteattr

    labels = "".join(f"<Label value={quoteattr(c)}/>" for c in CATEGORIES)
    units = "".join(f"<Choice value={quoteattr(u)}/>" for u in UNITS)
    per = 'toName="text" perRegion="true"'
    return f'<View><Header value="$title"/><Text name="meta" value="$meta"/><Labels name="category" toName="text">{labels}</Labels><Text name="text" value="$text"/><TextArea name="name" {per} maxSubmissions="1"/><Choices name="unit" {per} required="true" choice="single-radio">{units}</Choices><Number name="value" {per} min="0" step="0.1"/><Text name="review_notes" value="$review_notes"/></View>'


# Reconciliation and approval


def listing_faults(pages: DataFrame) -> DataFrame:
    """Faults that forbid importing from a paged task listing (page, has_tasks, total, has_next, ids): one row a fault.

    A listing must be recognised, must not repeat ids, and must be complete by its own total.
    """
    ids = pages.select("page", "total", F.explode_outer("ids").alias("id"))
    repeated = ids.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.lit("pagination repeated ids").alias("fault")).distinct()
    shape = pages.where("NOT has_tasks").select(F.lit("unrecognised task listing").alias("fault")).distinct()
    blind = pages.where("has_tasks AND total IS NULL AND has_next IS NULL").select(F.lit("no pagination metadata").alias("fault")).distinct()
    counts = ids.agg(F.max("total").alias("total"), F.countDistinct("id").alias("n"))
    short = counts.where("total IS NOT NULL AND total <> n").select(F.lit("incomplete task listing").alias("fault"))
    return repeated.unionByName(shape).unionByName(blind).unionByName(short)


def reconcile(tasks: DataFrame) -> DataFrame:
    """One copy per labeling_task_id of (task_id, labeling_task_id, data, n_annotations): the annotated one, else the oldest.

    `fault` names what must be settled by hand: copies with different data, or two annotated copies.
    """
    grouped = tasks.where("labeling_task_id IS NOT NULL").groupBy("labeling_task_id").agg(
        F.min_by("task_id", F.struct((F.col("n_annotations") == 0).alias("blank"), "task_id")).alias("task_id"),
        F.countDistinct("data").alias("variants"), F.count_if(F.col("n_annotations") > 0).alias("annotated"),
    )
    fault = F.when(F.col("variants") > 1, "conflicting duplicates").when(F.col("annotated") > 1, "several annotated duplicates")
    return grouped.select("labeling_task_id", "task_id", fault.alias("fault"))


def missing_tasks(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("labeling_task_id").distinct(), "labeling_task_id", "left_anti")


def export_batch(tasks: DataFrame, batch: str, limit: int, imported: Callable[[DataFrame], DataFrame], teacher: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Tasks after a batch was claimed, labelled by a teacher where it has no result yet, and sent to the labelling tool.

    `imported` gets (id, payload) and returns (id, label_studio_task_id) of what arrived; `teacher` gets tasks and returns
    (id, teacher_status, teacher_result, teacher_problems).  A batch that was exported is sent again only where it failed.
    """
    claimed = written(claim(tasks, batch, limit), "claimed")
    own = claimed.where((F.col("selection_batch_id") == batch) & (F.col("export_status") != "exported"))
    if teacher is not None:
        told = teacher(own.where("teacher_status = 'missing'")).select("id", *[F.col(c).alias(f"_{c}") for c in TEACHER])
        joined = own.join(told, "id", "left")
        own = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in TEACHER else c for c in own.columns])
    own = written(own.select(*tasks.columns), "batch")
    sent = export_outcome(own, written(imported(task_payload(own)), "imported"))
    rest = claimed.join(own.select("id"), "id", "left_anti")
    return rest.select(*tasks.columns).unionByName(sent.select(*tasks.columns))


def export_outcome(tasks: DataFrame, imported: DataFrame) -> DataFrame:
    """Tasks after an import: those in the result are exported, others carry an error."""
    joined = tasks.join(imported.select(F.col("id"), F.col("label_studio_task_id").alias("_ls")), "id", "left")
    ok = F.col("_ls").isNotNull()
    return joined.withColumn("export_status", F.when(ok, "exported").otherwise("failed")).withColumn("export_error", F.when(~ok, "not in import result")).withColumn("label_studio_task_id", F.coalesce("_ls", "label_studio_task_id")).drop("_ls")


def sync(tasks: DataFrame, annotations: DataFrame) -> DataFrame:
    """Tasks with the newest human revision; an approval of another revision, or of a deleted annotation, is invalidated."""
    joined = tasks.join(annotations.select("id", F.col("revision").alias("_rev"), F.col("result").alias("_res"), F.col("deleted").alias("_gone")), "id", "left")
    touched = F.col("_rev").isNotNull() | F.coalesce("_gone", F.lit(False))
    changed = F.col("approved_revision").isNotNull() & touched & (F.coalesce("_gone", F.lit(False)) | (F.col("_rev") != F.col("approved_revision")))
    gone = F.coalesce(F.col("_gone"), F.lit(False))
    return (
        joined.withColumn("approval_invalidated", F.col("approval_invalidated") | changed)
        .withColumn("human_revision", F.when(gone, F.lit(None)).otherwise(F.coalesce("_rev", "human_revision")))
        .withColumn("human_result", F.when(gone, F.lit(None)).otherwise(F.coalesce("_res", "human_result")))
        .select(*tasks.columns)
    )


def approvable(tasks: DataFrame) -> DataFrame:
    """(selection_batch_id, tasks, ready, approved): a batch is approved as a whole or not at all."""
    ready = (F.col("sync_status") == "synced") & F.col("human_result").isNotNull()
    return tasks.where("selection_batch_id IS NOT NULL").groupBy("selection_batch_id").agg(F.count("*").alias("tasks"), F.count_if(ready).alias("ready"), F.every(ready).alias("approved"))


def approved_current(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'approved' AND NOT approval_invalidated AND approved_revision = human_revision AND approved_result IS NOT NULL")


def best_labels(rows: DataFrame) -> DataFrame:
    """One row per content_hash: human over teacher, newer over older, first in `position` on ties."""
    return rows.groupBy("content_hash").agg(F.max_by(F.struct(*rows.columns), F.struct(F.col("label_source") == "human", F.coalesce("annotated_at", F.lit("")), -F.col("position"))).alias("_r")).select("_r.*")


# Teacher


def teacher_status(outcome: Column, pois: Column, text: Column) -> Column:
    """ok, invalid, refused or error from a provider outcome (text, refused, error) and the parsed places."""
    return F.when(outcome == "error", "error").when(outcome == "refused", "refused").when(pois.isNull(), "error").when(F.size(F.concat(schema_problems(pois), problems(pois, text))) > 0, "invalid").otherwise("ok")


def teacher_pending(rows: DataFrame, done: DataFrame, in_flight: DataFrame, provider: str, model: str, limit: int | None = None) -> DataFrame:
    """Rows without a result of this provider and model that are not in flight."""
    finished = done.where((F.col("provider") == provider) & (F.col("model") == model)).select("content_hash").distinct()
    out = rows.join(finished, "content_hash", "left_anti").join(in_flight.select("content_hash").distinct(), "content_hash", "left_anti")
    return out if limit is None else out.limit(limit)


def batch_results(sent: DataFrame, lines: DataFrame) -> DataFrame:
    """Outcome per content hash from result and error lines (custom_id, body JSON, error JSON); absent ones failed."""
    parsed = lines.select(F.col("custom_id").alias("content_hash"), F.get_json_object("body", "$.choices[0].message.content").alias("content"), F.get_json_object("body", "$.choices[0].message.refusal").alias("refusal"), F.get_json_object("error", "$.message").alias("message"))
    outcome = F.when(F.col("message").isNotNull(), "error").when(F.col("refusal").isNotNull(), "refused").when(F.col("content").isNotNull(), "text").otherwise("error")
    return sent.join(parsed.withColumn("outcome", outcome), "content_hash", "left").withColumn("outcome", F.coalesce("outcome", F.lit("error")))


def pending_predictions(listings: DataFrame, model_version: str) -> DataFrame:
    """Listings with text whose places are missing, from another model, or from another text."""
    stale = F.col("pois").isNull() | ~F.col("poi_model_version").eqNullSafe(F.lit(model_version)) | ~F.col("poi_description_sha256").eqNullSafe(T.exact_hash(F.col("description")))
    return listings.where((T.squeezed(F.col("description")) != "") & stale)


def save_predictions(listings: DataFrame, predictions: DataFrame, model_version: str) -> DataFrame:
    """Listings with new places (listing_id, description, pois) where the text is still the one that was read."""
    sent = predictions.select("listing_id", F.col("description").alias("_text"), F.col("pois").alias("_pois"))
    joined = listings.join(sent, "listing_id", "left")
    hit = F.coalesce(F.col("_text") == F.col("description"), F.lit(False))
    pick = {"pois": F.col("_pois"), "poi_model_version": F.lit(model_version), "poi_description_sha256": T.exact_hash(F.col("description"))}
    return joined.select(*[F.when(hit, pick[c]).otherwise(F.col(c)).alias(c) if c in pick else F.col(c) for c in listings.columns])


def export_faults(tasks: DataFrame) -> DataFrame:
    """(task, fault) of an exported task file (task, data map): tasks without the fields that the import wrote."""
    required = ("id", "content_hash", "text", "split")
    lacking = F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.map_keys("data"), F.array().cast("array<string>")))
    return tasks.select("task", F.when(F.col("data").isNull(), "missing data object").when(F.size(lacking) > 0, F.concat(F.lit("missing data fields: "), F.array_join(lacking, ", "))).alias("fault")).where("fault IS NOT NULL")


def fingerprint(value: object) -> str:
    """SHA-256 of canonical JSON (sorted keys, no NaN), for driver-side values."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False).encode()).hexdigest()


@F.pandas_udf(StringType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """The same for JSON texts of a column: canonical form needs sorted keys, which to_json does not give."""
    return texts.map(lambda t: None if t is None else fingerprint(json.loads(t)))
