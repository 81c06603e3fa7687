"""Exact-span evaluation of entity predictions, error analysis, run comparison and acceptance statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identities(spans: Column) -> Column:
    """Distinct (start, end, category) of an array of spans, in order."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category")))))


def confident(spans: Column, least: float) -> Column:
    """Spans at or above a confidence; a span without one counts as certain."""
    return F.filter(spans, lambda s: F.coalesce(s["confidence"], F.lit(1.0)) >= least)


def invalid_spans(spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (F.trim(s["category"]) == ""))


def confusion(records: DataFrame) -> DataFrame:
    """Records with tp, fp, fn and `errors`: missed spans, then false ones, each in order."""
    gold, found = identities(F.col("ground_truth")), identities(F.col("predictions"))
    kind = lambda name, spans: F.transform(spans, lambda s: F.struct(F.lit(name).alias("type"), s.alias("span")))
    missed, wrong = F.array_sort(F.array_except(gold, found)), F.array_sort(F.array_except(found, gold))
    return records.select("*", F.size(F.array_intersect(gold, found)).cast("long").alias("tp"), F.size(wrong).cast("long").alias("fp"), F.size(missed).cast("long").alias("fn"), F.concat(kind("FN", missed), kind("FP", wrong)).alias("errors"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def micro(scored: DataFrame) -> DataFrame:
    """One row: tp, fp, fn and micro-averaged precision, recall, F1 (0 where undefined)."""
    total = scored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def with_error(scored: DataFrame, kind: str) -> DataFrame:
    """Records with at least one error of a kind (FN or FP)."""
    return scored.where(F.exists("errors", lambda e: e["type"] == kind))


def outcome_filter(scored: DataFrame, choice: str) -> DataFrame:
    """errors, missed, false or correct records, as a reviewer picks them."""
    tests = {"errors": "fp + fn > 0", "missed": "fn > 0", "false": "fp > 0", "correct": "fp + fn = 0", "all": "true"}
    return scored.where(tests[choice])


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old_errors, new_errors, delta) in order of delta; records whose text or gold changed are flagged, not compared."""
    a = confusion(old).select("id", "text", identities(F.col("ground_truth")).alias("gold"), (F.col("fp") + F.col("fn")).alias("old_errors"))
    b = confusion(new).select("id", F.col("text").alias("new_text"), identities(F.col("ground_truth")).alias("new_gold"), (F.col("fp") + F.col("fn")).alias("new_errors"))
    joined = a.join(b, "id")
    same = F.col("text").eqNullSafe(F.col("new_text")) & F.col("gold").eqNullSafe(F.col("new_gold"))
    return joined.select("id", "old_errors", "new_errors", (F.col("new_errors") - F.col("old_errors")).alias("delta"), same.alias("comparable")).orderBy("delta", "id")


def wilson_lower(correct: Column, count: Column, z: float = 1.96) -> Column:
    """Lower bound of the 95 % interval of a proportion; 0 without trials."""
    n = count.cast("double")
    p = correct / n
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(count > 0, bound).otherwise(0.0)


def acceptance(scored: DataFrame) -> DataFrame:
    """One row from (probability, runner_up, known, conflict, right): accepted, correct, coverage, bound and Brier score."""
    accepted = F.col("known") & (F.col("probability") >= 0.9) & (F.col("probability") - F.col("runner_up") >= 0.15) & ~F.col("conflict")
    miss = F.pow(F.col("probability") - F.col("right").cast("double"), 2)
    total = scored.agg(F.count("*").alias("examples"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & F.col("right")).alias("correct"), F.avg(miss).alias("brier"))
    return total.select("*", F.when(F.col("accepted") > 0, F.col("correct") / F.col("accepted")).alias("precision"), ratio(F.col("accepted"), F.col("examples")).alias("coverage"), wilson_lower(F.col("correct"), F.col("accepted")).alias("precision_lower"))


def bio_spans(tags: DataFrame, key: str, position: str, tag: str, piece: int = 4096) -> DataFrame:
    """Entities (key, start, end, category) from one tag a row; end is exclusive, an orphan I opens an entity.

    A run ends where the next tag is O, a B, or an I of another category.  A key of any length is cut into pieces of
    positions; what a piece needs of those before it (their rows, their last tag, the entities they open) is carried forward
    in a table with one row a piece.
    """
    prefix, category = F.substring_index(tag, "-", 1), F.when(F.contains(F.col(tag), F.lit("-")), F.expr(f"substring({tag}, instr({tag}, '-') + 1)")).otherwise("")
    placed = tags.select(key, F.col(position).alias("_p"), F.floor(F.col(position) / piece).alias("_piece"), F.struct(prefix.alias("prefix"), category.alias("category")).alias("_t"))
    inside = Window.partitionBy(key, "_piece").orderBy("_p")
    earlier = Window.partitionBy(key).orderBy("_piece")
    pieces = placed.groupBy(key, "_piece").agg(F.count("*").alias("_n"), F.max_by("_t", "_p").alias("_end"))
    heads = pieces.select(key, "_piece", F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"), F.lag("_end").over(earlier).alias("_before"))
    each = placed.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_own", F.lag("_t").over(inside)).join(heads, [key, "_piece"])
    last = F.when(F.col("_i") == 0, F.col("_before")).otherwise(F.col("_own"))
    within = F.col("_t.prefix").isin("B", "I")
    goes_on = (F.col("_t.prefix") == "I") & (last["category"] == F.col("_t.category")) & last["prefix"].isin("B", "I")
    opened = each.select(key, "_piece", "_p", (F.col("_i") + F.col("_skip")).alias("_at"), F.col("_t.category").alias("category"), within.alias("_inside"), (within & ~F.coalesce(goes_on, F.lit(False))).cast("int").alias("_opens"))
    counts = opened.groupBy(key, "_piece").agg(F.sum("_opens").alias("_c")).select(key, "_piece", F.coalesce(F.sum("_c").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_opened"))
    numbered = opened.withColumn("_r", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(counts, [key, "_piece"]).where("_inside")
    return numbered.groupBy(key, (F.col("_r") + F.col("_opened")).alias("_run")).agg(F.min("_at").cast("long").alias("start"), (F.max("_at") + 1).cast("long").alias("end"), F.min("category").alias("category")).drop("_run")


def bio_spans_of(tags: Column) -> Column:
    """The same for an array of tags in one row: a fold that carries the open entity."""
    prefix = lambda t: F.substring_index(t, "-", 1)
    rest = lambda t: F.when(F.contains(t, F.lit("-")), F.substring(t, F.instr(t, "-") + 1, F.length(t))).otherwise("")
    kind = "struct<done:array<struct<start:int,end:int,category:string>>,start:int,category:string>"
    none = F.lit(None)
    entity = lambda s, e, c: F.array(F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), c.alias("category")))

    def step(acc: Column, x: Column) -> Column:
        tag, at = x["tag"], x["at"]
        closes = acc["start"].isNotNull() & ((prefix(tag) != "I") | (rest(tag) != acc["category"]))
        opens = prefix(tag).isin("B", "I") & (acc["start"].isNull() | closes)
        done = F.when(closes, F.concat(acc["done"], entity(acc["start"], at, acc["category"]))).otherwise(acc["done"])
        start = F.when(opens, at).when(closes, none).otherwise(acc["start"])
        category = F.when(opens, rest(tag)).when(closes, none).otherwise(acc["category"])
        return F.struct(done.alias("done"), start.cast("int").alias("start"), category.cast("string").alias("category"))

    numbered = F.transform(F.concat(tags, F.array(F.lit("O"))), lambda t, i: F.struct(t.alias("tag"), i.alias("at")))
    first = F.struct(F.array().cast("array<struct<start:int,end:int,category:string>>").alias("done"), none.cast("int").alias("start"), none.cast("string").alias("category")).cast(kind)
    return F.aggregate(numbered, first, step, lambda acc: acc["done"])


def token_scores(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """Micro scores of two arrays of tags a row; positions whose gold is null (padding, specials) are left out."""
    pairs = F.filter(F.arrays_zip(F.col(gold).alias("g"), F.col(found).alias("f")), lambda p: p["g"].isNotNull())
    one = rows.select(F.transform(pairs, lambda p: p["g"]).alias("g"), F.transform(pairs, lambda p: p["f"]).alias("f"))
    spans = one.select(bio_spans_of(F.col("g")).alias("ground_truth"), bio_spans_of(F.col("f")).alias("predictions"))
    return micro(confusion(spans))


def disjoint(spans: Column) -> Column:
    """Spans kept greedily in list order: one that overlaps a kept one goes."""
    empty = F.filter(spans, lambda s: F.lit(False))
    return F.aggregate(spans, empty, lambda kept, s: F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(s))))
