"""Files written and read back, published versions, whole runs of a scraper, plug-ins and small batches.

Each query writes a table of its own in the shared folder and reads it with the operator under test; the SQL states what must
come back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.functions import settings
from brindle.functions import text as T
from brindle.operators import dataset as D
from brindle.operators import labeling as L
from brindle.operators import lifecycle as C
from brindle.operators import location as G
from brindle.operators.graph import shared_dir, written
from brindle.plans.advertisements import _text, key
from brindle.plans.tables import read
from brindle.sources import files, paged, registry, samples
from brindle.sources.tables import Store
from brindle.streaming import sightings as S


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def json_lines(spark, d):
    """Conversations as JSON lines, in two batches; letters, nulls and line breaks survive."""
    path = _folder(spark, "lines")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.concat(F.lit("Ж\n"), "text")).alias("text"))
    files.write_json_lines(rows.where("conv_id % 2 = 0"), path)
    files.write_json_lines(rows.where("conv_id % 2 = 1"), path, append=True)
    return files.read_json_lines(spark, path, "conv_id long, turn long, text string").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("none")), 256).alias("hash"))


def missing_lines(spark, d):
    """A file that is not there is empty."""
    return files.read_json_lines(spark, _folder(spark, "nothing"), "a long").agg(F.count("*").alias("n"))


def _features(spark, d, path):
    """One feature collection for all parts; every ninth name is a placeholder."""
    p = read(spark, d, "part")
    name = F.when(key() % 9 == 0, "---").when(key() % 9 == 1, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    one = F.struct(F.lit("Feature").alias("type"), F.struct(_text("id", key()).alias("code"), name.alias("label"), F.col("p_size").alias("size")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(23 + key() % 100 / 1000, F.lit(42.6)).alias("coordinates")).alias("geometry"))
    whole = p.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.count("*").alias("numberMatched"), F.collect_list(one).alias("features"))).alias("value"))
    whole.coalesce(1).write.text(path)


def features(spark, d):
    path = _folder(spark, "features")
    _features(spark, d, path)
    found = files.read_features(spark, path, "code", "label", "parts", "poi")
    return found.select("dataset", "external_id", "kind", "name", F.round(F.get_json_object("geometry", "$.coordinates[0]").cast("double"), 6).alias("x"), F.get_json_object("attributes", "$.size").cast("long").alias("size"))


def feature_faults(spark, d):
    """What forbids publishing: the same collection as boundaries, which need names, and as places, which do not."""
    path = _folder(spark, "features")
    _features(spark, d, path)
    rows = []
    for kind in ("poi", "boundary"):
        rows += [(kind, fault) for fault in files.feature_faults(spark, path, files.read_features(spark, path, "code", "label", "parts", kind))] or [(kind, "none")]
    return spark.createDataFrame(rows, "kind string, fault string")


def category_rules(spark, d):
    rules = {(1, "10", "ring"): "park", (1, "11", "box"): "bank", (2, "10", "ring"): "school"}
    found = files.category_of(key() % 3, (key() % 12).cast("string"), F.substring_index("p_name", " ", -1), F.when(key() % 5 != 0, F.col("p_name")), rules)
    return read(spark, d, "part").select("p_partkey", found.alias("category"))


def batch_faults(spark, d):
    """Ids of a layer asked for in batches of a hundred, and what came back."""
    asked = read(spark, d, "part").select(F.floor(key() / 100).alias("batch"), key().alias("id"))
    got = asked.where("id % 13 <> 0").unionByName(asked.where("id % 50 = 0").withColumn("batch", F.col("batch") + 1))
    return files.batch_faults(asked, got)


def snapshots(spark, d):
    """Files named by their digest; two were damaged after they were stored."""
    from pyspark.sql.types import BinaryType

    root = _folder(spark, "store")
    rows = read(spark, d, "region").select("r_regionkey", F.col("r_name").cast(BinaryType()).alias("content"))
    files.store_snapshots(rows.withColumn("digest", F.sha2("content", 256)).withColumn("content", F.when(F.col("r_regionkey") < 2, F.lit(b"damaged")).otherwise(F.col("content"))).select("digest", "content"), root)
    return files.read_snapshots(spark, root).select("digest", F.decode("content", "UTF-8").alias("content"), "ok")


def handoff(spark, d):
    """A small file of assignments."""
    path = _folder(spark, "handoff")
    rows = read(spark, d, "nation").select(F.struct("n_nationkey", "n_name").alias("r"))
    rows.agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(path)
    return files.read_handoff(spark, path, "n_nationkey long, n_name string")


def published(spark, d):
    """Two versions are published; readers see the second, whole."""
    root = _folder(spark, "release")
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name")
    files.publish(rows.where("s_suppkey % 2 = 0"), root, "catalogue", "v1")
    files.publish(rows.where("s_suppkey % 3 = 0"), root, "catalogue", "v2")
    return files.published(spark, root, "catalogue")


def release(spark, d):
    """A release of features: repeated ids are refused, the version follows from content, not from order or time."""
    rows = read(spark, d, "part").select(F.lit("parts").alias("dataset"), key().cast("string").alias("external_id"), "p_name")
    good = files.publish_release(rows, _folder(spark, "release"), "catalogue", "m1", "g1")
    again = files.publish_release(rows.orderBy(F.desc("external_id")), _folder(spark, "release"), "catalogue", "m1", "g1")
    other = files.publish_release(rows.where("p_name <> 'small ring'"), _folder(spark, "release"), "catalogue", "m1", "g1")
    try:
        files.publish_release(rows.unionByName(rows.limit(1)), _folder(spark, "release"), "catalogue", "m1", "g1")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(good == again, good == other, refused)], "same boolean, changed_same boolean, refused boolean")


def reports(spark, d):
    """A report and a table of errors as files."""
    report, table = _folder(spark, "report"), _folder(spark, "errors")
    files.write_report(read(spark, d, "orders").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers")), report)
    files.write_csv(read(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n_name")), table)
    rows = spark.read.csv(table, header=True, schema="n_nationkey long, n_name string", escape='"')
    return spark.read.json(report).crossJoin(rows.agg(F.count("*").alias("nations"), F.max("n_name").alias("last")))


def task_array(spark, d):
    """Task payloads as one JSON array, read back as an array."""
    path = _folder(spark, "tasks")
    payload = F.to_json(F.struct(key().alias("id"), F.col("p_name").alias("text")))
    files.label_studio_array(read(spark, d, "part").select(key().alias("id"), payload.alias("payload")), path, "id")
    return spark.read.schema("id long, text string").json(path, multiLine=True)


def batch_files(spark, d):
    """Result lines of a provider's batch, good ones and errors in two files."""
    good, bad = _folder(spark, "good"), _folder(spark, "bad")
    parts = read(spark, d, "part")
    files.write_json_lines(parts.where("p_partkey % 7 <> 0").select(key().cast("string").alias("custom_id"), F.struct(F.to_json(F.struct(F.col("p_size").alias("n"))).alias("body")).alias("response"), F.lit(None).cast("string").alias("error")), good)
    files.write_json_lines(parts.where("p_partkey % 7 = 0").select(key().cast("string").alias("custom_id"), F.lit(None).cast("struct<body:string>").alias("response"), F.lit("late").alias("error")), bad)
    return files.read_batch_results(spark, good, bad).select("custom_id", F.get_json_object("body", "$.n").cast("long").alias("n"), "error")


def recorded_pages(spark, d):
    """Pages of a task listing, recorded as files: one a conversation, one that cannot be read."""
    root = _folder(spark, "pages")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list(F.struct("turn")).alias("tasks"))).alias("value"))
    files.write_texts(rows.select(F.format_string("p%06d.json", "conv_id").alias("name"), F.when(F.col("conv_id") % 10 == 7, "{broken").otherwise(F.col("value")).alias("value")), root)
    spark.dataSource.register(paged.RecordedPages)
    found = spark.read.format("brindle_pages").load(root)
    return found.select(F.col("page").cast("long").alias("page"), "has_tasks", "total", F.size("items").cast("long").alias("n"), F.col("error").isNotNull().alias("broken"))


def fetched(spark, d):
    """Outcomes of a scraper plug-in: pages, pages that are gone, and failures as data."""
    urls = read(spark, d, "part").select(_text("https://x.bg/", key()).alias("url"))
    return paged.fetch(urls, samples.scraper, "title string").select("url", "outcome", "title", "error")


def predicted(spark, d):
    """Spans of a model plug-in; texts that are too long, and spans that do not fit, are errors of their row."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = paged.predict(docs, "doc_id", "text", samples.model, limit=5000)
    return found.select("doc_id", F.get("pois", F.lit(0))["name"].alias("name"), F.substring_index("error", ":", 1).alias("error"))


def _runs(spark, d):
    """Customers as stored listings, orders as what a search found."""
    c = F.col("c_custkey")
    at = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    stored = read(spark, d, "customer").select(F.when(c % 5 != 0, "imot").otherwise("other").alias("source"), c.cast("string").alias("external_id"), _text("u/", c).alias("url"), F.floor("c_acctbal").cast("double").alias("price_amount"), F.lit("active").alias("status"), (at - F.make_interval(days=F.col("c_nationkey") % 7)).alias("last_seen_at"), F.col("c_mktsegment").alias("area_slug"))
    o = read(spark, d, "customer").where("c_custkey % 2 = 0")
    again = o.select(F.when(c % 5 != 0, "imot").otherwise("other").alias("source"), c.cast("string").alias("external_id"), _text("u/", c).alias("url"), F.floor(F.col("c_acctbal") + F.when(c % 6 == 0, 1).otherwise(0)).cast("double").alias("price_amount"))
    fresh = read(spark, d, "supplier").select(F.lit("imot").alias("source"), _text("n", F.col("s_suppkey")).alias("external_id"), _text("u/n", F.col("s_suppkey")).alias("url"), F.lit(1.0).alias("price_amount"))
    found = again.where("source = 'imot'").unionByName(fresh)
    return stored, found, at


def _outcomes(spark, d, fetch):
    n = F.regexp_extract("url", r"(\d+)$", 1).cast("int")
    return fetch.select("url", F.when(n % 7 == 0, "transient").when(n % 7 < 3, "unavailable").otherwise("ok").alias("outcome"), F.lit("imot").alias("source"), F.regexp_extract("url", "u/(.*)", 1).alias("external_id"), F.lit(5.0).alias("price_amount"), F.lit("active").alias("status"), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")).alias("last_seen_at"), F.lit("new").alias("area_slug"))


def _step(spark, d):
    stored, found, at = _runs(spark, d)
    empty = spark.createDataFrame([], "url string, outcome string, source string, external_id string, price_amount double, status string, last_seen_at timestamp_ntz, area_slug string")
    scope = C.in_scope(F.col("area_slug"), F.lit(1), ["BUILDING", "MACHINERY"], [])
    plan = C.scrape_step(stored, found, empty, scope, "imot", at)
    return stored, C.scrape_step(stored, found, _outcomes(spark, d, written(plan["fetch"], "fetch")), scope, "imot", at)


def fetch_list(spark, d):
    """What a run has to fetch: new listings and prices, and known ones in scope that the search did not return."""
    return _step(spark, d)[1]["fetch"]


def run_inserts(spark, d):
    return _step(spark, d)[1]["inserts"].select("source", "external_id")


def run_listings(spark, d):
    """Stored listings after the run."""
    return _step(spark, d)[1]["listings"].select("source", "external_id", "status", "last_seen_at")


def run_summary(spark, d):
    return _step(spark, d)[1]["summary"]


def appended_log(spark, d):
    """Batches that repeat and overlap append each key once; of repeated lines of a log the last stands."""
    path = _folder(spark, "log")
    rows = read(spark, d, "conversations").select("conv_id", "turn")
    step = S.append_new(path, ["conv_id", "turn"], "conv_id long, turn long")
    for k, batch in enumerate((rows.where("turn % 2 = 0"), rows.where("turn % 2 = 0"), rows)):
        step(batch, k)
    return spark.read.schema("conv_id long, turn long").parquet(path)


def last_lines(spark, d):
    """Raw ads with the last line that a teacher's log has of them."""
    log = read(spark, d, "conversations").select(F.col("conv_id").alias("content_hash"), F.col("turn").alias("position"), "role")
    last = C.latest(log, ["content_hash"], ["position"])
    ads = read(spark, d, "documents").select(F.col("doc_id").alias("content_hash"))
    return ads.join(last, "content_hash", "left").select("content_hash", "position", "role")


def fresh_inputs(spark, d):
    """Inputs of a stream, each (listing, fingerprint) once."""
    stream = S.event_stream(spark, d, "events.parquet").select("ts", F.col("user_id").alias("listing_id"), F.col("event_type").alias("fingerprint"))
    return S.run_to_end(S.fresh_inputs(stream, "1000 days"), f"fresh-{uuid.uuid4().hex[:8]}").select("listing_id", "fingerprint")


def enrichment_queue(spark, d):
    """Listings whose texts arrive in a stream and have no current places yet."""
    stream = S.event_stream(spark, d, "events.parquet").select("event_id", F.col("user_id").alias("listing_id"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("description"))
    stored = read(spark, d, "customer").select(F.col("c_custkey").alias("listing_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("[]")).alias("pois"), F.lit("v1").alias("poi_model_version"), F.sha2(F.lit("t1"), 256).alias("poi_description_sha256"))
    return S.run_to_end(L.pending_predictions(stream.join(stored, "listing_id"), "v1").select("event_id", "listing_id"), f"queue-{uuid.uuid4().hex[:8]}")


def single_sync(spark, d):
    """One task's annotation through the step that also serves whole batches, after a first attempt that fails."""
    tasks = read(spark, d, "part").select(key().alias("id"), F.lit(1).alias("approved_revision"), F.lit(1).alias("human_revision"), F.lit("[1]").alias("human_result"), F.lit(False).alias("approval_invalidated"))
    tries = []

    def step(one):
        tries.append(1)
        if len(tries) == 1:
            raise ConnectionError("first attempt")
        return L.sync(tasks.join(one.select("id"), "id", "left_semi"), one)

    hook = spark.createDataFrame([(7, 2, "[2]", False)], "id long, revision int, result string, deleted boolean")
    return S.single(hook, step).select("id", "approval_invalidated", "human_revision")


def reserved_slots(spark, d):
    """Times of requests at least 400 seconds apart, in the order of asking."""
    seconds = F.date_diff(F.to_date("ts"), F.lit("1970-01-01")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    asked = read(spark, d, "events").select(F.col("event_id").alias("request"), seconds.cast("double").alias("at"))
    return S.slots(asked, 400.0).select("request", "slot")


def dataset_snapshot(spark, d):
    """Counts of a dataset version's manifest, and of its rows as written."""
    path = _folder(spark, "dataset")
    rows = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("content_hash"), F.when(F.col("toxic") == 1, "gold").otherwise("train").alias("part"), F.array(F.when(F.col("quality") == 1, "category:street").otherwise("no_pois")).alias("tags"))
    manifest = D.write_snapshot(rows, path, "part", "tags", 42)
    told = spark.createDataFrame(sorted(manifest["splits"].items()), "part string, told long")
    return spark.read.json(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n")).join(told, "part")


def coverage_warnings(spark, d):
    """Tags that the dataset or its gold part lacks."""
    rows = read(spark, d, "labels").select(F.when(F.col("toxic") == 1, "gold").otherwise("train").alias("part"), F.array(F.when(F.col("toxic") == 1, "category:street").otherwise("category:market"), F.lit("no_pois")).alias("tags"))
    return D.coverage_warnings(rows, "tags", "part")


def frozen_gold(spark, d):
    """Members of a frozen gold set that are gone, or whose labels changed."""
    members = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), F.lit("1").alias("label_fingerprint"))
    rows = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("content_hash"), F.col("quality").cast("string").alias("label_fingerprint"))
    return D.frozen_gold_faults(members, rows)


def chronology(spark, d):
    """Are splits by time in order?  By year they are, by month they are not."""
    rows = read(spark, d, "orders").select("o_orderdate", F.when(F.year("o_orderdate") < 1997, "train").when(F.year("o_orderdate") < 1999, "calibration").otherwise("test").alias("by_year"), F.when(F.month("o_orderdate") < 5, "train").when(F.month("o_orderdate") < 9, "calibration").otherwise("test").alias("by_month"))
    order = ("train", "calibration", "test")
    return spark.createDataFrame([(c, D.chronological(rows, order, "o_orderdate", c)) for c in ("by_year", "by_month")], "split string, ordered boolean")


def driver_checks(spark, d):
    """Requests, settings, schemas, releases and drift: small documents that never leave the driver."""
    schema = {"$defs": {"u": {"type": "string"}}, "properties": {"a": {"$ref": "#/$defs/u", "title": "A"}}}
    rows = [
        ("good request", str(settings.request_faults("https://x.bg/a", {"pages": 1.0}))),
        ("bad request", str(settings.request_faults("ftp://x", {"pages": 0.0}, float("inf")))),
        ("selection", str(settings.selection_faults("a", " ", "r", 0, 2.0))),
        ("flag", str(settings.setting("f", {"K": "e"}, "K", True, "x"))),
        ("environment", str(settings.setting(None, {"K": "e"}, "K", True, "x"))),
        ("foreign environment", str(settings.setting(None, {"K": "e"}, "K", False, "x"))),
        ("schema", str(settings.without_references(schema))),
        ("release", str(settings.release_id("m", "g", [("a", "1", "x"), ("a", "0", "y")]) == settings.release_id("m", "g", [("a", "0", "y"), ("a", "1", "x")]))),
        ("drift", str(settings.drift({"a": 1, "b": 2}, {"b": 3, "c": 1}))),
        ("times", str([settings.instant(x) for x in ("2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00")])),
        ("naive", str(settings.instant("2024-01-02T03:04:05", required=False))),
        ("ready", str(G.model_ready({"test_metrics": {"examples": 50, "accepted": 40, "correct": 40}, "split_counts": {"train": 40, "calibration": 20}}))),
        ("not ready", str(G.model_ready({"test_metrics": {"examples": 50, "accepted": 40, "correct": 36}, "split_counts": {"train": 40, "calibration": 20}}))),
        ("model", str(G.model_faults({"feature_names": [], "weights": [1.0], "temperature": 11, "version": "x", "test_metrics": {}}, {}))),
    ]
    return spark.createDataFrame(rows, "what string, found string")


def export_batch(spark, d):
    """A batch of sixty tasks: claimed, labelled by a teacher where needed, sent; the labelling tool takes four of five."""
    tasks = read(spark, d, "part").select(
        key().alias("id"), F.concat(F.lit("l"), key().cast("string")).alias("listing_id"), F.col("p_name").alias("description_snapshot"), F.lit("h").alias("content_hash"), F.when(key() % 4 == 0, F.lit("old")).alias("selection_batch_id"), F.lit("not_exported").alias("export_status"),
        F.lit(None).cast("string").alias("export_error"), F.lit(None).cast("long").alias("label_studio_task_id"), F.when(key() % 3 == 0, "done").otherwise("pending").alias("status"), (-key()).alias("created_at"), F.when(key() % 2 == 0, "ok").otherwise("missing").alias("teacher_status"),
        F.lit(None).cast(f"array<{L.POI}>").alias("teacher_result"), F.lit(None).cast("array<string>").alias("teacher_problems"), F.lit("p").alias("teacher_provider"), F.lit("m").alias("teacher_model"), F.lit("v").alias("teacher_prompt_version"),
    )
    teacher = lambda rows: rows.select("id", F.lit("refused").alias("teacher_status"), F.lit(None).cast(f"array<{L.POI}>").alias("teacher_result"), F.array(F.lit("x")).alias("teacher_problems"))
    tool = lambda sent: sent.where(F.get_json_object("payload", "$.data.labeling_task_id").cast("long") % 5 != 0).select("id", (F.col("id") + 1000).alias("label_studio_task_id"))
    out = L.export_batch(tasks, "new", 60, tool, teacher)
    return out.where("selection_batch_id = 'new'").select("id", "export_status", "export_error", "label_studio_task_id", "teacher_status")


def store(spark, d):
    """A table after a first version, two appends of which the second repeats keys, and an upsert."""
    table = Store(spark, _folder(spark, "store"))
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(0).alias("v"))
    table.replace("orders", rows.where("o_orderkey % 3 = 0"))
    table.append("orders", rows.where("o_orderkey % 3 = 1"), [["o_orderkey"]], ["o_custkey"])
    table.append("orders", rows.where("o_orderkey % 2 = 0").withColumn("v", F.lit(1)), [["o_orderkey"]], ["o_custkey"])
    table.upsert("orders", rows.where("o_orderkey % 10 = 0").withColumn("v", F.lit(2)), "o_orderkey")
    schema = "o_orderkey long, o_custkey long, v int"
    return table.read("orders", schema).unionByName(table.read("orders", schema, 2).where("o_orderkey < 100").withColumn("v", F.lit(-1))).unionByName(table.read("never", schema))


def providers(spark, d):
    """A plug-in found by name, imported only when it is asked for."""
    registry.register("numbers", "brindle.sources.samples:scraper")
    urls = read(spark, d, "supplier").select(_text("https://x.bg/", F.col("s_suppkey")).alias("url"))
    return paged.fetch(urls, registry.provider("numbers"), "title string").select("url", "outcome")


def newest_descriptions(spark, d):
    """The scan for the export: described listings, newest first."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(" ").alias("description"))
    return rows.where(T.squeezed(F.col("description")) != "").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(60).select("o_orderkey", "o_orderdate")


def batch_tasks(spark, d):
    """Tasks of a batch with their listings, oldest first."""
    tasks = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    listings = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return tasks.join(listings, "o_custkey").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "c_name")


def pinned_units(spark, d):
    """Distinct units of the release that the pointer names."""
    pointer = read(spark, d, "region").where("r_regionkey = 2").select(F.col("r_regionkey").alias("n_regionkey"))
    return read(spark, d, "nation").join(F.broadcast(pointer), "n_regionkey").select("n_name").distinct()


def pairs_in_list(spark, d):
    """Rows whose (dataset, id) is in two lists of equal length."""
    lists = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.collect_list("l_orderkey").alias("a"), F.collect_list(F.col("l_linenumber") % 3).alias("b"))
    wanted = lists.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select(F.col("x.a").alias("o_orderkey"), F.col("x.b").alias("k")).distinct()
    return read(spark, d, "orders").withColumn("k", (F.col("o_orderkey") % 3).cast("int")).join(wanted, ["o_orderkey", "k"], "left_semi").select("o_orderkey")


QUERIES = {
    "q_json_lines": json_lines, "q_missing_lines": missing_lines, "q_features": features, "q_feature_collection_faults": feature_faults, "q_category_rules": category_rules, "q_layer_batches": batch_faults, "q_snapshots": snapshots, "q_handoff": handoff,
    "q_published": published, "q_release": release, "q_reports": reports, "q_task_array": task_array, "q_batch_files": batch_files, "q_recorded_pages": recorded_pages, "q_fetched": fetched, "q_predicted": predicted, "q_fetch_list": fetch_list,
    "q_run_inserts": run_inserts, "q_run_listings": run_listings, "q_run_summary": run_summary, "q_appended_log": appended_log, "q_last_lines": last_lines, "q_fresh_inputs": fresh_inputs, "q_enrichment_queue": enrichment_queue,
    "q_single_sync": single_sync, "q_reserved_slots": reserved_slots, "q_dataset_snapshot": dataset_snapshot, "q_coverage_warnings": coverage_warnings, "q_frozen_gold": frozen_gold, "q_chronology": chronology, "q_driver_checks": driver_checks,
    "q_newest_descriptions": newest_descriptions, "q_batch_tasks": batch_tasks, "q_pinned_units": pinned_units, "q_pairs_in_list": pairs_in_list, "q_export_batch": export_batch, "q_store": store, "q_providers": providers,
}

_RUN = """s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN 'imot' ELSE 'other' END AS source, c_custkey::VARCHAR AS external_id, floor(c_acctbal) AS price, TIMESTAMP '2024-01-10 00:00:00' - to_days((c_nationkey % 7)::INT) AS seen, c_mktsegment AS area FROM customer),
f AS (SELECT k, source, external_id, price + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS price FROM s WHERE k % 2 = 0 AND source = 'imot'),
todo AS (SELECT 'u/' || f.k AS url, f.k AS n, false AS absent FROM f WHERE f.k % 6 = 0 UNION ALL SELECT 'u/n' || s_suppkey, s_suppkey, false FROM supplier UNION ALL SELECT 'u/' || k, k, true FROM s WHERE source = 'imot' AND area IN ('BUILDING', 'MACHINERY') AND k % 2 = 1),
done AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'transient' WHEN n % 7 < 3 THEN 'unavailable' ELSE 'ok' END AS outcome FROM todo)"""
_GUARD = """LEFT JOIN done o ON o.url = 'u/' || s.k AND o.absent"""

ORACLE_SQL = {
    "q_json_lines": "SELECT conv_id, turn, sha256(CASE WHEN turn % 4 <> 3 THEN 'Ж' || chr(10) || text ELSE 'none' END) AS hash FROM conversations",
    "q_missing_lines": "SELECT 0::BIGINT AS n",
    "q_features": "SELECT 'parts' AS dataset, 'id' || p_partkey AS external_id, 'poi' AS kind, CASE WHEN p_partkey % 9 > 1 THEN p_name END AS name, round(23 + p_partkey % 100 / 1000, 6)::DOUBLE AS x, p_size::BIGINT AS size FROM part",
    "q_feature_collection_faults": "SELECT 'poi' AS kind, 'none' AS fault UNION ALL SELECT 'boundary', 'boundary without a name'",
    "q_category_rules": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 1 AND p_partkey % 12 = 10 AND string_split(p_name, ' ')[-1] = 'ring' THEN 'park'
WHEN p_partkey % 3 = 1 AND p_partkey % 12 = 11 AND string_split(p_name, ' ')[-1] = 'box' THEN 'bank' WHEN p_partkey % 3 = 2 AND p_partkey % 12 = 10 AND string_split(p_name, ' ')[-1] = 'ring' THEN 'school' END AS category FROM part""",
    "q_layer_batches": "SELECT p_partkey // 100 AS batch, p_partkey AS id, 'missing' AS fault FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT p_partkey // 100 + 1, p_partkey, 'unexpected' FROM part WHERE p_partkey % 50 = 0",
    "q_snapshots": "SELECT sha256(r_name) AS digest, CASE WHEN r_regionkey < 2 THEN 'damaged' ELSE r_name END AS content, r_regionkey >= 2 AS ok FROM region",
    "q_handoff": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "q_published": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0",
    "q_release": "SELECT true AS same, NOT EXISTS (SELECT 1 FROM part WHERE p_name = 'small ring') AS changed_same, true AS refused",
    "q_reports": """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, (SELECT count(*) FROM nation) AS nations, (SELECT max(n_name || ', "x"') FROM nation) AS last""",
    "q_task_array": "SELECT p_partkey AS id, p_name AS text FROM part",
    "q_batch_files": "SELECT p_partkey::VARCHAR AS custom_id, CASE WHEN p_partkey % 7 <> 0 THEN p_size END::BIGINT AS n, CASE WHEN p_partkey % 7 = 0 THEN 'late' END AS error FROM part",
    "q_recorded_pages": "SELECT conv_id AS page, conv_id % 10 <> 7 AS has_tasks, CASE WHEN conv_id % 10 <> 7 THEN count(*) END AS total, CASE WHEN conv_id % 10 <> 7 THEN count(*) ELSE 0 END AS n, conv_id % 10 = 7 AS broken FROM conversations GROUP BY conv_id",
    "q_fetched": "SELECT 'https://x.bg/' || p_partkey AS url, CASE p_partkey % 10 WHEN 3 THEN 'transient' WHEN 7 THEN 'unavailable' ELSE 'ok' END AS outcome, CASE WHEN p_partkey % 10 NOT IN (3, 7) THEN 't' || p_partkey END AS title, CASE WHEN p_partkey % 10 = 3 THEN 'TimeoutError: slow' END AS error FROM part",
    "q_predicted": r"SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 5000 AND length(text) % 7 <> 0 THEN regexp_extract(text, '\S+') END AS name, CASE WHEN coalesce(length(text), 0) = 0 OR length(text) > 5000 OR length(text) % 7 = 0 THEN 'ValueError' END AS error FROM documents",
    "q_fetch_list": f"WITH {_RUN} SELECT url FROM done",
    "q_run_inserts": f"WITH {_RUN} SELECT 'imot' AS source, substr(url, 3) AS external_id FROM done WHERE NOT absent AND outcome = 'ok' AND url LIKE 'u/n%'",
    "q_run_listings": f"""WITH {_RUN} SELECT s.source, s.external_id, CASE WHEN f.k IS NOT NULL OR o.outcome = 'ok' THEN 'active' WHEN o.outcome = 'unavailable' THEN CASE WHEN s.seen < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 3 DAYS THEN 'expired' ELSE 'unreachable' END ELSE 'active' END AS status,
CASE WHEN f.k IS NOT NULL OR o.outcome = 'ok' THEN TIMESTAMP '2024-01-10 00:00:00' ELSE s.seen END AS last_seen_at FROM s LEFT JOIN f ON f.k = s.k {_GUARD}""",
    "q_run_summary": f"""WITH {_RUN} SELECT (SELECT count(*) FROM f) + (SELECT count(*) FROM supplier) AS found, (SELECT count(*) FROM todo WHERE NOT absent) AS new, count(*) FILTER (outcome = 'ok') AS fetched, count(*) FILTER (outcome = 'unavailable') AS unavailable, count(*) FILTER (outcome = 'transient') AS failed FROM done""",
    "q_appended_log": "SELECT DISTINCT conv_id, turn FROM conversations",
    "q_last_lines": "SELECT doc_id AS content_hash, max(turn) AS position, arg_max(role, turn) AS role FROM documents LEFT JOIN conversations ON conv_id = doc_id GROUP BY doc_id",
    "q_fresh_inputs": "SELECT DISTINCT user_id AS listing_id, event_type AS fingerprint FROM events",
    "q_enrichment_queue": "SELECT event_id, user_id AS listing_id FROM events JOIN customer ON c_custkey = user_id WHERE c_custkey % 3 <> 0 OR event_id % 5 <> 1",
    "q_single_sync": "SELECT 7::BIGINT AS id, true AS approval_invalidated, 2 AS human_revision",
    "q_reserved_slots": """WITH e AS (SELECT event_id AS request, floor(epoch(ts))::DOUBLE AS s, row_number() OVER (ORDER BY floor(epoch(ts)), event_id) AS i FROM events)
SELECT request, max(s - i * 400.0) OVER (ORDER BY s, request ROWS UNBOUNDED PRECEDING) + i * 400.0 AS slot FROM e""",
    "q_dataset_snapshot": "SELECT CASE WHEN toxic = 1 THEN 'gold' ELSE 'train' END AS part, count(*) AS n, count(*) AS told FROM labels GROUP BY 1",
    "q_coverage_warnings": "SELECT 'category:market' AS feature, 'Gold has no examples of category:market' AS warning UNION ALL SELECT 'long_description', 'Dataset has no examples of long_description'",
    "q_frozen_gold": "SELECT d.doc_id::VARCHAR AS content_hash, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'changed' END AS fault FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR quality <> 1",
    "q_chronology": """WITH s AS (SELECT o_orderdate AS t, CASE WHEN year(o_orderdate) < 1997 THEN 0 WHEN year(o_orderdate) < 1999 THEN 1 ELSE 2 END AS y, CASE WHEN month(o_orderdate) < 5 THEN 0 WHEN month(o_orderdate) < 9 THEN 1 ELSE 2 END AS m FROM orders)
SELECT 'by_year' AS split, max(t) FILTER (y = 0) < min(t) FILTER (y = 1) AND max(t) FILTER (y = 1) < min(t) FILTER (y = 2) AS ordered FROM s UNION ALL SELECT 'by_month', max(t) FILTER (m = 0) < min(t) FILTER (m = 1) AND max(t) FILTER (m = 1) < min(t) FILTER (m = 2) FROM s""",
    "q_driver_checks": """SELECT * FROM (VALUES ('good request', '[]'), ('bad request', '[''address'', ''pages'', ''delay'']'), ('selection', '[''selection_run'', ''limit'', ''sample_rate'']'), ('flag', 'f'), ('environment', 'e'), ('foreign environment', 'x'),
('schema', '{''properties'': {''a'': {''type'': ''string'', ''title'': ''A''}}}'), ('release', 'True'), ('drift', '[''a'', ''b'', ''c'']'), ('times', '[1704164645.0, 1704164645.0]'), ('naive', 'None'), ('ready', 'True'), ('not ready', 'False'),
('model', '[''context'', ''coefficients'', ''fingerprint'', ''metrics'']')) t(what, found)""",
    "q_newest_descriptions": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 60",
    "q_batch_tasks": "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100",
    "q_pinned_units": "SELECT DISTINCT n_name FROM nation WHERE n_regionkey = 2",
    "q_pairs_in_list": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 3 = o_orderkey % 3)",
    "q_export_batch": """WITH c AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 ORDER BY -p_partkey, p_partkey LIMIT 60)
SELECT id, CASE WHEN id % 5 <> 0 THEN 'exported' ELSE 'failed' END AS export_status, CASE WHEN id % 5 = 0 THEN 'not in import result' END AS export_error, CASE WHEN id % 5 <> 0 THEN id + 1000 END AS label_studio_task_id, CASE WHEN id % 2 = 0 THEN 'ok' ELSE 'refused' END AS teacher_status FROM c""",
    "q_store": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 2 WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_custkey, -1 FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey < 100""",
    "q_providers": "SELECT 'https://x.bg/' || s_suppkey AS url, CASE s_suppkey % 10 WHEN 3 THEN 'transient' WHEN 7 THEN 'unavailable' ELSE 'ok' END AS outcome FROM supplier",
}
