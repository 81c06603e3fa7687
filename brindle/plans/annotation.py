"""Places in texts, regions of the labelling tool, task states and teacher results, over parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import dataset as D
from brindle.operators import evaluation as E
from brindle.operators import labeling as L
from brindle.plans.advertisements import _text, key
from brindle.plans.tables import read

def _title():
    return F.concat(F.lit("Парк "), F.initcap("p_name"))


def _ads(spark, d):
    """Texts that name a numbered park and a street, with what a teacher says about them: the third place is not in the text."""
    text = _text("До ", _title(), "  ", key(), " има тролей. На ", key() % 9 + 1, " минути е ул. Бор ", key() % 50, ".")
    poi = lambda category, name, value, unit, evidence: F.struct(F.lit(category).alias("category"), name.alias("name"), F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit")).alias("distance"), evidence.alias("evidence"))
    street = poi("street", _text("Бор ", key() % 50), key() % 9 + 1, "min_walk", _text("НА ", key() % 9 + 1, "  минути Е  ул. бор ", key() % 50))
    park = poi("park", _text(_title(), " ", key()), F.lit(None), "nearby", _text("до ", F.upper(_title()), " ", key()))
    lost = poi("school", _text("7 СУ"), F.lit(-1), "m", _text("до 7 СУ"))
    return read(spark, d, "part").select("p_partkey", text.alias("text"), F.when(key() % 3 == 0, F.array(street, park, lost)).otherwise(F.array(street, park)).alias("pois"))


def find_evidence(spark, d):
    """The last two words of each text, in lower case and far apart, at the first place where they stand in this order."""
    docs = read(spark, d, "documents").where(r"regexp_like(text, '\\S\\s+\\S')")
    last, before = F.regexp_extract("text", r"(\S+)\s*$", 1), F.regexp_extract("text", r"(\S+)\s+\S+\s*$", 1)
    at = L.find_evidence(F.concat(F.lower(before), F.lit(" \t "), last), F.col("text"))
    return docs.select("doc_id", at["start"].cast("long").alias("start"), at["end"].cast("long").alias("end"))


def identifiers(spark, d):
    first = F.regexp_extract("text", r"\S+", 0)
    return read(spark, d, "conversations").select("conv_id", "turn", L.is_identifier(F.when(F.col("turn") % 2 == 0, F.lower(first)).otherwise(first)).alias("named"))


def name_spans(spark, d):
    each = _ads(spark, d).select("p_partkey", F.inline(L.name_spans(F.col("pois"), F.col("text"))))
    return each.select("p_partkey", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "category")


def all_problems(spark, d):
    return _ads(spark, d).select("p_partkey", F.posexplode(F.concat(L.problems(F.col("pois"), F.col("text")), L.schema_problems(F.col("pois"))))).select("p_partkey", F.col("pos").cast("long").alias("pos"), F.col("col").alias("message"))


def schema_problems(spark, d):
    """Categories and units from columns that mostly do not belong to the contract."""
    category = F.element_at(F.array(F.lit("park"), F.lit("Park"), F.lit("street"), F.lit(None).cast("string")), (key() % 4 + 1).cast("int"))
    unit = F.element_at(F.array(F.lit("m"), F.lit("metres"), F.lit("nearby")), (key() % 3 + 1).cast("int"))
    poi = F.struct(category.alias("category"), F.col("p_name").alias("name"), F.struct(F.lit(1.0).alias("value"), unit.alias("unit")).alias("distance"), F.col("p_name").alias("evidence"))
    return read(spark, d, "part").select("p_partkey", F.array_join(L.schema_problems(F.array(poi)), "; ").alias("problems"))


def regions(spark, d):
    """Regions drawn for a teacher's places, and notes on those that are not in the text."""
    drawn = _ads(spark, d).select("p_partkey", L.regions_of(F.col("pois"), F.col("text")).alias("r"))
    each = drawn.select("p_partkey", F.size("r.notes").cast("long").alias("notes"), F.explode("r.regions").alias("g"))
    value = F.coalesce(F.get(F.col("g.value.labels"), F.lit(0)), F.get(F.col("g.value.choices"), F.lit(0)), F.col("g.value.number").cast("string"), F.get(F.col("g.value.text"), F.lit(0)))
    return each.select("p_partkey", "notes", F.col("g.id").alias("id"), F.col("g.from_name").alias("field"), F.col("g.value.start").cast("long").alias("start"), value.alias("value"))


def _annotations(spark, d):
    return _ads(spark, d).select("p_partkey", "text", F.shuffle(L.regions_of(F.col("pois"), F.col("text"))["regions"]).alias("regions"))


def places_from_regions(spark, d):
    """Regions in any order come back as places in text order."""
    found = L.pois_of(_annotations(spark, d), "p_partkey", "text", "regions")
    each = found.select("p_partkey", F.posexplode("pois").alias("pos", "p"))
    return each.select("p_partkey", F.col("pos").cast("long").alias("pos"), "p.category", "p.name", F.col("p.distance.value").alias("value"), F.col("p.distance.unit").alias("unit"), "p.evidence")


def checked_annotations(spark, d):
    """Annotations whose first region of every seventh text lost its unit: they are problems, not places."""
    rows = _annotations(spark, d).withColumn("regions", F.when(key() % 7 == 0, F.filter("regions", lambda r: ~((r["id"] == "t0") & (r["from_name"] == "unit")))).otherwise(F.col("regions")))
    return L.checked_annotations(rows, "p_partkey", "text", "regions").select("p_partkey", F.size("pois").cast("long").alias("places"), F.size("problems").cast("long").alias("problems"))


def latest_annotation(spark, d):
    """The turns of a conversation as annotations of a task; some are cancelled, some deleted."""
    each = F.struct(F.col("turn").alias("id"), F.when(F.col("turn") % 3 != 1, F.concat(F.lit("t"), (F.col("turn") % 2).cast("string"))).alias("updated_at"), (F.col("role") == "system").alias("was_cancelled"), (F.col("turn") % 5 == 4).alias("deleted"))
    lists = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(each).alias("a"))
    return lists.select("conv_id", L.latest_annotation(F.col("a"))["id"].alias("live"), F.size("a").cast("long").alias("n"))


def task_payloads(spark, d):
    """Fields of the documents that are sent to the labelling tool."""
    status = F.element_at(F.array(F.lit("ok"), F.lit("missing"), F.lit("refused"), F.lit("invalid")), (key() % 4 + 1).cast("int"))
    rows = _ads(spark, d).select(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("l"), key().cast("string")).alias("listing_id"), F.col("text").alias("description_snapshot"), F.lit("h").alias("content_hash"), F.when(key() % 2 == 0, F.lit("b1")).alias("selection_batch_id"),
        status.alias("teacher_status"), F.when(status.isin("ok", "invalid"), F.col("pois")).alias("teacher_result"), F.when(status == "invalid", F.array(F.lit("check it"))).alias("teacher_problems"),
        F.when(key() % 3 == 0, F.lit("p")).alias("teacher_provider"), F.lit("m").alias("teacher_model"), F.lit(None).cast("string").alias("teacher_prompt_version"),
    )
    sent = L.task_payload(rows)
    at = lambda path: F.get_json_object("payload", path)
    return sent.select("id", at("$.data.title").alias("title"), at("$.data.meta").alias("meta"), at("$.data.selection_batch_id").alias("batch"), F.regexp_replace(at("$.data.review_notes"), r"\(evidence not in text\): .*", "lost").alias("notes"), at("$.predictions[0].model_version").alias("model"))


def _tasks(spark, d):
    """Turns as labelling tasks in all their states."""
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn") % len(values) + 1).cast("int"))
    return read(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("b"), (F.col("conv_id") % 3).cast("string"))).alias("selection_batch_id"), pick("not_exported", "exported").alias("export_status"),
        pick("pending", "approved", "approved", "done").alias("status"), F.col("conv_id").alias("created_at"), F.lit(None).cast("string").alias("export_error"), F.lit(None).cast("long").alias("label_studio_task_id"),
        (F.col("turn") % 7 == 6).alias("approval_invalidated"), F.when(F.col("turn") % 4 != 0, F.col("turn")).alias("approved_revision"), F.when(F.col("turn") % 5 != 0, F.col("turn")).alias("human_revision"), F.when(F.col("role") == "user", F.lit("[1]")).alias("human_result"), F.when(F.col("role") != "system", F.lit("[1]")).alias("approved_result"),
    )


def claims(spark, d):
    """The batch `new` gets the 25 oldest claimable tasks."""
    return L.claim(_tasks(spark, d), "new", 25).where("selection_batch_id = 'new'").select("id", "created_at")


def claims_again(spark, d):
    """A batch that exists is not claimed again."""
    return L.claim(_tasks(spark, d), "b1", 25).groupBy("selection_batch_id").agg(F.count("*").alias("n"))


def export_outcomes(spark, d):
    imported = _tasks(spark, d).where("id % 4 <> 1").select("id", (F.col("id") + 7).alias("label_studio_task_id"))
    return L.export_outcome(_tasks(spark, d), imported).select("id", "export_status", "export_error", "label_studio_task_id")


def synced(spark, d):
    """New revisions for some tasks, deleted annotations for others; approvals of what changed are void."""
    seen = _tasks(spark, d).where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("human_revision") + 1).otherwise(F.col("approved_revision")).alias("revision"), F.lit("[2]").alias("result"), (F.col("id") % 10 == 4).alias("deleted"))
    return L.sync(_tasks(spark, d), seen).select("id", "approval_invalidated", "human_revision", "human_result")


def approved_current(spark, d):
    return L.approved_current(_tasks(spark, d)).select("id")


def teacher_results(spark, d):
    """Status of teacher outcomes: refused, failed, unreadable, with problems, or good."""
    outcome = F.element_at(F.array(F.lit("text"), F.lit("refused"), F.lit("error"), F.lit("text")), (key() % 4 + 1).cast("int"))
    pois = F.when(key() % 8 != 3, F.col("pois"))
    return _ads(spark, d).select("p_partkey", L.teacher_status(outcome, pois, F.col("text")).alias("status"))


def teacher_pending(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("content_hash"))
    done = read(spark, d, "labels").select(F.col("doc_id").alias("content_hash"), F.when(F.col("quality") == 1, "p1").otherwise("p2").alias("provider"), F.when(F.col("toxic") == 0, "m1").otherwise("m2").alias("model"))
    return L.teacher_pending(rows, done, rows.where("content_hash % 10 = 0"), "p1", "m1")


def batch_results(spark, d):
    """Result and error lines of a provider's batch; what was sent and did not come back is an error."""
    sent = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("content_hash"))
    body = F.when(key() % 5 == 1, _text('{"choices":[{"message":{"content":"c', key(), '"}}]}')).when(key() % 5 == 2, F.lit('{"choices":[{"message":{"refusal":"no"}}]}')).when(key() % 5 == 3, F.lit("{broken"))
    lines = read(spark, d, "part").where("p_partkey % 5 <> 0").select(key().cast("string").alias("custom_id"), body.alias("body"), F.when(key() % 5 == 4, F.lit('{"message":"late"}')).alias("error"))
    return L.batch_results(sent, lines).select("content_hash", "outcome", "content")


def _described(spark, d):
    """Documents as listings with places from some model and some text."""
    text = F.when(F.col("doc_id") % 11 == 0, F.lit(" \n")).otherwise(F.col("text"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("listing_id"), text.alias("description"), F.when(F.col("doc_id") % 3 != 0, F.lit("[]")).alias("pois"), F.when(F.col("doc_id") % 4 != 0, F.lit("v2")).otherwise("v1").alias("poi_model_version"), F.sha2(F.when(F.col("doc_id") % 5 != 0, text).otherwise(F.lit("old")), 256).alias("poi_description_sha256"))


def pending_predictions(spark, d):
    return L.pending_predictions(_described(spark, d), "v2").select("listing_id")


def oldest_pending(spark, d):
    """The first forty listings without current places, by id."""
    return L.pending_predictions(_described(spark, d), "v2").select("listing_id").orderBy("listing_id").limit(40)


def saved_predictions(spark, d):
    """New places are saved where the text is still the one that was read."""
    rows = _described(spark, d)
    new = rows.where("listing_id % 2 = 0").select("listing_id", F.when(F.col("listing_id") % 6 == 0, F.lit("other")).otherwise(F.col("description")).alias("description"), F.lit("[9]").alias("pois"))
    return L.save_predictions(rows, new, "v3").select("listing_id", "pois", "poi_model_version", "poi_description_sha256")


def export_faults(spark, d):
    """Tasks of an exported file without the fields that the import wrote."""
    data = F.when(key() % 6 != 0, F.map_filter(F.create_map(*[x for c in ("id", "content_hash", "text", "split") for x in (F.lit(c), F.lit("v"))]), lambda k, v: ~((k == "split") & (key() % 3 == 1)) & ~((k == "text") & (key() % 4 == 1))))
    return L.export_faults(read(spark, d, "part").select(key().alias("task"), data.alias("data")))


def fingerprints(spark, d):
    """SHA-256 of canonical JSON, whatever the order of the keys in the text."""
    value = _text('{"size":', F.col("p_size"), ',"name":"', F.col("p_name"), '","also":[1,', key(), ',null]}')
    return read(spark, d, "part").select("p_partkey", L.fingerprints(value).alias("fingerprint"))


def task_pages(spark, d):
    """Pages of a task listing, one conversation each: what forbids importing them."""
    pages = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("ids"), F.count("*").alias("n"))
    rows = pages.select(F.col("conv_id").cast("int").alias("page"), F.lit(True).alias("has_tasks"), F.col("n").alias("total"), F.lit(False).alias("has_next"), F.transform("ids", lambda t: (F.col("conv_id") % 90 * 100 + t).cast("int")).alias("ids"))
    return L.listing_faults(rows)


# Tokens


def _tagged(spark, d):
    """Six words of a text as tokens: names of two words begin at places that vary."""
    offsets = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 0), (0, 2), (3, 7), (8, 12), (13, 17), (18, 20), (0, 0))])
    kind = F.element_at(F.array(F.lit("park"), F.lit("school"), F.lit("bank")), (key() % 3 + 1).cast("int"))
    begin = F.element_at(F.array(F.lit(3), F.lit(8), F.lit(4)), (key() % 3 + 1).cast("int"))
    spans = F.array(F.struct(begin.alias("start"), (begin + F.when(key() % 2 == 0, 9).otherwise(4)).alias("end"), kind.alias("category")))
    return read(spark, d, "part").select("p_partkey", F.lit("до Парк Юлии леля тя").alias("text"), offsets.alias("offsets"), spans.alias("spans"))


def bio_labels(spark, d):
    """Labels of tokens: null for specials and for tokens that reach beyond their name."""
    tags = D.bio_labels(F.col("offsets"), F.col("spans"), F.col("text"))
    return _tagged(spark, d).select("p_partkey", F.array_join(tags, " ", "?").alias("labels"))


def _tags(spark, d):
    """The turns of a conversation as tags of tokens."""
    tag = F.element_at(F.array(F.lit("O"), F.lit("B-park"), F.lit("I-park"), F.lit("I-bank"), F.lit(None).cast("string")), ((F.col("turn") * 7 + F.col("conv_id")) % 5 + 1).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", tag.alias("tag"))


def chunks(spark, d):
    """Pieces of at most three content tokens that do not cut a name."""
    word = F.element_at(F.array(F.lit("O"), F.lit("B-park"), F.lit("I-park"), F.lit("B-bank"), F.lit("O"), F.lit(None).cast("string")), ((F.col("p_size") + F.col("k")) % 6 + 1).cast("int"))
    each = read(spark, d, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).select("p_partkey", "k", word.alias("w"))
    rows = each.groupBy("p_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("w", F.lit("?")).alias("w")))), lambda x: F.nullif(x["w"], F.lit("?"))).alias("tags"))
    found = D.chunk_rows(rows.select("p_partkey", F.concat(F.array(F.lit(None).cast("string")), "tags", F.array(F.lit(None).cast("string"))).alias("tags")), "p_partkey", "tags", 5)
    return found.select("p_partkey", *[F.col(c).cast("long").alias(c) for c in ("chunk", "start", "end")], "error")


def inference_windows(spark, d):
    found = read(spark, d, "documents").select("doc_id", F.posexplode(D.windows(F.col("n_chars").cast("int"), 1, 1, 512)).alias("pos", "w"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


def decoded_spans(spark, d):
    """Spans of characters from tags of tokens; confidence is the least score of a span's tokens."""
    offsets = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 0), (0, 2), (2, 7), (7, 12), (13, 17), (0, 0))])
    tags = F.array(F.lit("O"), F.lit("O"), F.lit("B-park"), F.when(key() % 2 == 0, "I-park").otherwise("O"), F.when(key() % 3 == 0, "I-bank").otherwise("O"), F.lit("O"))
    scores = F.array(F.lit(0.0), F.lit(0.5), F.col("p_size") / 50, F.lit(0.40625), F.lit(0.123456), F.lit(0.0))
    found = read(spark, d, "part").select("p_partkey", F.inline(D.decode_spans(F.lit("до Парк Юлии леля"), offsets, tags, scores)))
    return found.select("p_partkey", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name", "category", "confidence")


def token_scores(spark, d):
    """Micro scores of tags against tags that are shifted by the parity of the part; ignored positions do not count."""
    gold = F.array(F.lit("O"), F.lit("B-park"), F.when(key() % 2 == 0, "I-park").otherwise("O"), F.lit(None).cast("string"), F.lit("B-bank"))
    found = F.array(F.lit("O"), F.lit("B-park"), F.lit("I-park"), F.lit("B-park"), F.when(key() % 5 == 0, "B-bank").otherwise("O"))
    return E.token_scores(read(spark, d, "part").select(gold.alias("g"), found.alias("f")), "g", "f").select("tp", "fp", "fn", F.round("f1", 9).alias("f1"))


def greedy_overlap(spark, d):
    """Spans in list order; one that overlaps a kept one goes."""
    a, b = key() % 10, key() % 7
    span = lambda s, e, c: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(c).alias("category"))
    kept = E.disjoint(F.array(span(a, a + 4, "x"), span(b, b + 3, "y"), span(F.lit(13), F.lit(15), "z")))
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(kept, lambda s: s["category"]), "").alias("kept"))


def outcome_filters(spark, d):
    """Records that a reviewer of missed spans, of false ones, of any error or of none would see."""
    span = lambda s: F.struct(s.cast("int").alias("start"), (s + 3).cast("int").alias("end"), F.lit("park").alias("category"))
    scored = E.confusion(read(spark, d, "part").select("p_partkey", F.array(span(key() % 3), span(F.lit(9))).alias("ground_truth"), F.array(span(key() % 2), span(F.lit(9))).alias("predictions")))
    counts = [E.outcome_filter(scored, c).agg(F.lit(c).alias("choice"), F.count("*").alias("n")) for c in ("errors", "missed", "false", "correct", "all")]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


QUERIES = {
    "q_find_evidence": find_evidence, "q_identifiers": identifiers, "q_name_spans": name_spans, "q_place_problems": all_problems, "q_schema_problems": schema_problems, "q_regions": regions, "q_places_from_regions": places_from_regions,
    "q_checked_annotations": checked_annotations, "q_latest_annotation": latest_annotation, "q_task_payloads": task_payloads, "q_claim": claims, "q_claim_again": claims_again, "q_export_outcomes": export_outcomes, "q_sync_tasks": synced,
    "q_approved_current": approved_current, "q_teacher_status": teacher_results, "q_teacher_pending": teacher_pending, "q_batch_results": batch_results, "q_pending_predictions": pending_predictions, "q_oldest_pending": oldest_pending,
    "q_saved_predictions": saved_predictions, "q_export_faults": export_faults, "q_fingerprints": fingerprints, "q_task_pages": task_pages, "q_bio_labels": bio_labels, "q_chunks": chunks, "q_inference_windows": inference_windows,
    "q_decoded_spans": decoded_spans, "q_token_scores": token_scores, "q_greedy_overlap": greedy_overlap, "q_outcome_filters": outcome_filters,
}

_AD = """a AS (SELECT p_partkey, p_name, 'Парк ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, p_partkey % 9 + 1 AS m, p_partkey % 50 AS s FROM part),
ad AS (SELECT *, 'До ' || title || '  ' || p_partkey || ' има тролей. На ' || m || ' минути е ул. Бор ' || s || '.' AS text, 3 AS park, length(title || '  ' || p_partkey) AS park_length FROM a),
placed AS (SELECT *, strpos(text, 'На ' || m || ' минути') - 1 AS quote, strpos(text, 'Бор ' || s) - 1 AS street FROM ad)"""
_TASK = """t AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'b' || conv_id % 3 END AS batch, CASE turn % 2 WHEN 0 THEN 'not_exported' ELSE 'exported' END AS export_status,
['pending', 'approved', 'approved', 'done'][turn % 4 + 1] AS status, turn % 7 = 6 AS void, CASE WHEN turn % 4 <> 0 THEN turn END AS approved, CASE WHEN turn % 5 <> 0 THEN turn END AS human, role FROM conversations)"""
_LISTED = """l AS (SELECT doc_id AS listing_id, CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS description FROM documents),
p AS (SELECT * FROM l WHERE listing_id % 11 <> 0 AND trim(coalesce(description, '')) <> '' AND (listing_id % 3 = 0 OR listing_id % 4 = 0 OR listing_id % 5 = 0))"""

ORACLE_SQL = {
    "q_find_evidence": r"""WITH w AS (SELECT doc_id, text, regexp_extract(text, '(\S+)\s+(\S+)\s*$', 1) AS x, regexp_extract(text, '(\S+)\s+(\S+)\s*$', 2) AS y FROM documents WHERE regexp_matches(text, '\S\s+\S')),
h AS (SELECT doc_id, regexp_extract(text, '(?is)^(.*?)(' || regexp_escape(x) || '\s+' || regexp_escape(y) || ')', 1) AS before, regexp_extract(text, '(?is)^(.*?)(' || regexp_escape(x) || '\s+' || regexp_escape(y) || ')', 2) AS hit FROM w)
SELECT doc_id, length(before) AS start, length(before) + length(hit) AS "end" FROM h""",
    "q_identifiers": r"SELECT conv_id, turn, regexp_matches(CASE WHEN turn % 2 = 0 THEN lower(regexp_extract(text, '\S+')) ELSE regexp_extract(text, '\S+') END, '[\p{Nd}\p{Lu}]') AS named FROM conversations",
    "q_name_spans": f"""WITH {_AD} SELECT p_partkey, street AS start, street + length('Бор ' || s) AS "end", 'street' AS category FROM placed UNION ALL SELECT p_partkey, park, park + park_length, 'park' FROM placed""",
    "q_place_problems": """WITH k AS (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) SELECT p_partkey, 0::BIGINT AS pos, 'pois[2]: evidence not found in text: ''до 7 СУ''' AS message FROM k UNION ALL SELECT p_partkey, 1, 'pois[2]: distance value must be positive' FROM k""",
    "q_schema_problems": "SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 4 IN (1, 3) THEN 'pois[0]: unknown category' END, CASE WHEN p_partkey % 3 = 1 THEN 'pois[0]: unknown unit' END) AS problems FROM part",
    "q_regions": f"""WITH {_AD}, r AS (SELECT *, (p_partkey % 3 = 0)::BIGINT AS notes FROM placed)
SELECT p_partkey, notes, 't0' AS id, 'category' AS field, quote AS start, 'street' AS value FROM r UNION ALL SELECT p_partkey, notes, 't0', 'unit', quote, 'min_walk' FROM r UNION ALL SELECT p_partkey, notes, 't0', 'name', quote, 'Бор ' || s FROM r
UNION ALL SELECT p_partkey, notes, 't0', 'value', quote, m || '.0' FROM r UNION ALL SELECT p_partkey, notes, 't1', 'category', 0, 'park' FROM r UNION ALL SELECT p_partkey, notes, 't1', 'unit', 0, 'nearby' FROM r UNION ALL SELECT p_partkey, notes, 't1', 'name', 0, title || ' ' || p_partkey FROM r""",
    "q_places_from_regions": f"""WITH {_AD} SELECT p_partkey, 0::BIGINT AS pos, 'park' AS category, title || ' ' || p_partkey AS name, NULL::DOUBLE AS value, 'nearby' AS unit, 'До ' || title || '  ' || p_partkey AS evidence FROM placed
UNION ALL SELECT p_partkey, 1, 'street', 'Бор ' || s, m::DOUBLE, 'min_walk', 'На ' || m || ' минути е ул. Бор ' || s FROM placed""",
    "q_checked_annotations": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END::BIGINT AS places, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS problems FROM part",
    "q_latest_annotation": """SELECT conv_id, arg_max(turn, (CASE WHEN turn % 3 <> 1 THEN (turn % 2 + 1) * 1000000 ELSE 0 END) + turn) FILTER (role <> 'system' AND turn % 5 <> 4) AS live, count(*) AS n FROM conversations GROUP BY conv_id""",
    "q_task_payloads": """WITH s AS (SELECT *, ['ok', 'missing', 'refused', 'invalid'][p_partkey % 4 + 1] AS status FROM part)
SELECT p_partkey::VARCHAR AS id, 'Listing l' || p_partkey AS title, 'Listing: l' || p_partkey || ' | Task: ' || p_partkey || ' | Batch: ' || CASE WHEN p_partkey % 2 = 0 THEN 'b1' ELSE 'unassigned' END AS meta, CASE WHEN p_partkey % 2 = 0 THEN 'b1' ELSE '' END AS batch,
CASE status WHEN 'missing' THEN 'No teacher label available; annotate from scratch.' WHEN 'refused' THEN 'Teacher status: refused' ELSE concat_ws(chr(10), CASE WHEN p_partkey % 3 = 0 THEN 'Teacher POI not drawn lost' END, CASE WHEN status = 'invalid' THEN 'check it' END) END AS notes,
CASE WHEN status IN ('ok', 'invalid') THEN CASE WHEN p_partkey % 3 = 0 THEN 'p' ELSE 'unknown-provider' END || '/m/unknown-prompt' END AS model FROM s""",
    "q_claim": f"WITH {_TASK} SELECT id, conv_id AS created_at FROM t WHERE batch IS NULL AND export_status = 'not_exported' AND status = 'pending' ORDER BY conv_id, id LIMIT 25",
    "q_claim_again": f"WITH {_TASK} SELECT batch AS selection_batch_id, count(*) AS n FROM t GROUP BY 1",
    "q_export_outcomes": f"WITH {_TASK} SELECT id, CASE WHEN id % 4 <> 1 THEN 'exported' ELSE 'failed' END AS export_status, CASE WHEN id % 4 = 1 THEN 'not in import result' END AS export_error, CASE WHEN id % 4 <> 1 THEN id + 7 END AS label_studio_task_id FROM t",
    "q_sync_tasks": f"""WITH {_TASK}, n AS (SELECT *, id % 2 = 0 AS sent, CASE WHEN id % 3 = 0 THEN human + 1 ELSE approved END AS rev, id % 2 = 0 AND id % 10 = 4 AS gone FROM t)
SELECT id, void OR (approved IS NOT NULL AND sent AND (gone OR coalesce(rev <> approved, false))) AS approval_invalidated, CASE WHEN gone THEN NULL WHEN sent THEN coalesce(rev, human) ELSE human END AS human_revision,
CASE WHEN gone THEN NULL WHEN sent THEN '[2]' WHEN role = 'user' THEN '[1]' END AS human_result FROM n""",
    "q_approved_current": f"WITH {_TASK} SELECT id FROM t WHERE status = 'approved' AND NOT void AND approved = human AND role <> 'system'",
    "q_teacher_status": "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'refused' WHEN 2 THEN 'error' ELSE CASE WHEN p_partkey % 8 = 3 THEN 'error' WHEN p_partkey % 3 = 0 THEN 'invalid' ELSE 'ok' END END AS status FROM part",
    "q_teacher_pending": "SELECT doc_id AS content_hash FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
    "q_batch_results": "SELECT p_partkey::VARCHAR AS content_hash, CASE p_partkey % 5 WHEN 1 THEN 'text' WHEN 2 THEN 'refused' ELSE 'error' END AS outcome, CASE WHEN p_partkey % 5 = 1 THEN 'c' || p_partkey END AS content FROM part",
    "q_pending_predictions": f"WITH {_LISTED} SELECT listing_id FROM p",
    "q_oldest_pending": f"WITH {_LISTED} SELECT listing_id FROM p ORDER BY listing_id LIMIT 40",
    "q_saved_predictions": f"""WITH {_LISTED}, h AS (SELECT *, listing_id % 2 = 0 AND listing_id % 6 <> 0 AND description IS NOT NULL AS hit FROM l)
SELECT listing_id, CASE WHEN hit THEN '[9]' WHEN listing_id % 3 <> 0 THEN '[]' END AS pois, CASE WHEN hit THEN 'v3' WHEN listing_id % 4 <> 0 THEN 'v2' ELSE 'v1' END AS poi_model_version, sha256(CASE WHEN hit OR listing_id % 5 <> 0 THEN description ELSE 'old' END) AS poi_description_sha256 FROM h""",
    "q_export_faults": """SELECT p_partkey AS task, CASE WHEN p_partkey % 6 = 0 THEN 'missing data object' ELSE 'missing data fields: ' || concat_ws(', ', CASE WHEN p_partkey % 4 = 1 THEN 'text' END, CASE WHEN p_partkey % 3 = 1 THEN 'split' END) END AS fault
FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 4 = 1 OR p_partkey % 3 = 1""",
    "q_fingerprints": """SELECT p_partkey, sha256('{"also": [1, ' || p_partkey || ', null], "name": "' || p_name || '", "size": ' || p_size || '}') AS fingerprint FROM part""",
    "q_task_pages": """WITH i AS (SELECT conv_id % 90 * 100 + turn AS id FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'pagination repeated ids' AS fault WHERE (SELECT count(*) > count(DISTINCT id) FROM i) UNION ALL SELECT 'incomplete task listing' WHERE (SELECT max(n) FROM n) <> (SELECT count(DISTINCT id) FROM i)""",
    "q_bio_labels": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '? O B-park I-park O O ?' WHEN 3 THEN '? O B-park O O O ?' WHEN 4 THEN '? O O B-school I-school O ?' WHEN 1 THEN '? O O B-school O O ?' WHEN 2 THEN '? O ? B-bank O O ?' ELSE '? O ? O O O ?' END AS labels FROM part""",
    "q_chunks": """WITH RECURSIVE w AS (SELECT p_partkey, list_transform(range(12), lambda k: ['O', 'B-park', 'I-park', 'B-bank', 'O', NULL][(p_size + k) % 6 + 1]) AS tags FROM part),
cut(p_partkey, tags, chunk, a, b) AS (SELECT p_partkey, tags, 0::BIGINT, 0::BIGINT, CASE WHEN tags[4] = 'I-park' THEN 2 ELSE 3 END::BIGINT FROM w
UNION ALL SELECT p_partkey, tags, chunk + 1, b, CASE WHEN b + 3 >= 12 THEN 12 WHEN tags[b + 4] = 'I-park' THEN b + 2 ELSE b + 3 END FROM cut WHERE b < 12)
SELECT p_partkey, chunk, a + 1 AS start, b + 1 AS "end", NULL::VARCHAR AS error FROM cut""",
    "q_inference_windows": """SELECT doc_id, k AS pos, 1 + k * 510 AS start, least(1 + (k + 1) * 510, n_chars - 1) AS "end" FROM (SELECT doc_id, n_chars, unnest(range(0, CASE WHEN n_chars > 2 THEN (n_chars - 3) // 510 + 1 ELSE 0 END)) AS k FROM documents)""",
    "q_decoded_spans": """SELECT p_partkey, 3::BIGINT AS start, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 7 END::BIGINT AS "end", CASE WHEN p_partkey % 2 = 0 THEN 'Парк Юлии' ELSE 'Парк' END AS name, 'park' AS category, round(CASE WHEN p_partkey % 2 = 0 THEN least(p_size / 50, 0.40625) ELSE p_size / 50 END, 5) AS confidence FROM part
UNION ALL SELECT p_partkey, 13, 17, 'леля', 'bank', 0.12346 FROM part WHERE p_partkey % 3 = 0""",
    "q_token_scores": """WITH c AS (SELECT sum((p_partkey % 2 = 0)::INT + (p_partkey % 5 = 0)::INT) AS tp, sum((p_partkey % 2 <> 0)::INT) AS fp, sum((p_partkey % 2 <> 0)::INT + (p_partkey % 5 <> 0)::INT) AS fn FROM part)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
    "q_greedy_overlap": """WITH s AS (SELECT p_partkey, p_partkey % 10 AS a, p_partkey % 7 AS b FROM part), k AS (SELECT *, NOT (a < b + 3 AND a + 4 > b) AS y FROM s)
SELECT p_partkey, 'x' || CASE WHEN y THEN 'y' ELSE '' END || CASE WHEN a + 4 <= 13 OR a >= 15 THEN 'z' ELSE '' END AS kept FROM k""",
    "q_outcome_filters": """WITH e AS (SELECT p_partkey % 3 <> p_partkey % 2 AS wrong FROM part) SELECT 'errors' AS choice, count(*) FILTER (wrong) AS n FROM e UNION ALL SELECT 'missed', count(*) FILTER (wrong) FROM e UNION ALL SELECT 'false', count(*) FILTER (wrong) FROM e
UNION ALL SELECT 'correct', count(*) FILTER (NOT wrong) FROM e UNION ALL SELECT 'all', count(*) FROM e""",
}
