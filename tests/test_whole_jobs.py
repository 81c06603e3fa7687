"""Queries over whole tables against brute force on small fixtures."""

from difflib import SequenceMatcher
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import dedup
from brindle.operators import spatial
from brindle.plans import catalogue, corpus, labeling, location
from tests.oracle import differences


def test_export_matches_brute_force(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    near = [" ".join([*words[:40], f"changed{k}"]) for k in range(5)]
    texts = [*near, near[1].upper() + "!", " ".join(words[20:]) + " на 5 минути до парк", "short", None, "x" * 70 + " https://example.org/a/very/long/address", " ".join(words[30:50]), near[0] + "\n\n***\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean = {r[0]: r for r in docs.select("doc_id", T.clean_description(F.col("text")).alias("c")).select("doc_id", "c", T.place_hint(F.col("c")), T.word_hash(F.col("c")), T.shingles(F.col("c"))).collect()}
    long_enough = [i for i in sorted(clean) if len(clean[i][1]) >= 80]
    first: dict = {}
    for i in long_enough:
        first.setdefault(clean[i][3], i)
    root = {i: i for i in first.values()}
    for a, b in combinations(sorted(root), 2):
        x, y = set(clean[a][4]), set(clean[b][4])
        if len(x & y) / len(x | y) >= 0.8:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    kept = sorted(set(root.values()))
    sizes = sorted(len(clean[i][1]) for i in kept)
    got = corpus.export_counters(spark, str(tmp_path)).collect()[0].asDict() | corpus.percentiles(spark, str(tmp_path)).collect()[0].asDict()
    assert got == {
        "listings_read": len(texts), "dropped_too_short": len(texts) - len(long_enough), "dropped_exact_duplicate": len(long_enough) - len(root), "dropped_near_duplicate": len(root) - len(kept),
        "rows_written": len(kept), "rows_with_poi_hint": sum(clean[i][2] for i in kept), "p50": sizes[len(sizes) // 2], "p95": sizes[int(len(sizes) * 0.95)], "longest": sizes[-1],
    }
    assert got["dropped_near_duplicate"] == 4 and got["dropped_exact_duplicate"] == 2 and got["rows_with_poi_hint"] == 1
    fates = {r["doc_id"]: r["fate"] for r in dedup.export(docs, "doc_id", "text").collect()}
    assert {i for i in fates if fates[i] == "written"} == set(kept)


def test_support_mass_of_all_suppliers_matches_brute_force(spark, tmp_path):
    keys = [1, 2, 3, 39, 40, 41, 77, 500, 501, 999]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["group_key"], r["unit"]): r["mass"] for r in location.support_mass(spark, str(tmp_path)).collect()}
    want = {}
    for group in {k // 2 for k in keys}:
        members = [(23.05 + k % 5 * 0.1, 42.52 + k % 4 * 0.05, 300.0 + k * 10) for k in keys if k // 2 == group]
        sides = [np.linspace(min(m[i] - m[2] / 60_000 for m in members), max(m[i] + m[2] / 60_000 for m in members), 1500) for i in (0, 1)]
        x, y = (v.ravel() for v in np.meshgrid(*sides))
        east, north = spatial.project(x, y)
        held = np.zeros(len(x), bool)
        for cx, cy, r in members:
            px, py = spatial.project(np.array([cx]), np.array([cy]))
            held |= (east - px) ** 2 + (north - py) ** 2 <= r * r
        x, y = x[held], y[held]
        for i in range(6):
            for j in range(6):
                here = (x >= 23.0 + 0.1 * i) & (x < 23.1 + 0.1 * i) & (y >= 42.5 + 0.05 * j) & (y < 42.55 + 0.05 * j)
                if (mass := float(here.mean())) > 0.02:
                    want[f"g{group}", f"u{i}{j}"] = mass
    assert {g for g, _ in got} == {f"g{k // 2}" for k in keys}
    assert all(abs(got.get(k, 0.0) - want[k]) < 0.02 for k in want) and all(k in want for k, m in got.items() if m > 0.05)


def test_every_line_is_evidence(spark, tmp_path):
    """One order of seven lines: the support of its units is a plain sum over all of them."""
    lines = [(1, n, 10 + n, n, float(5 * n), 0.08, "N") for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want: dict = {}
    for _, n, part, supplier, quantity, *_ in lines:
        for unit, mass in ((str(supplier % 7), quantity / 50), (str(7 + part % 5), 1 - quantity / 50)):
            want[unit] = want.get(unit, 0.0) + (1 + n % 3) * mass
    total = sum(1 + n % 3 for n in range(1, 8))
    got = {r["unit"]: r["support"] for r in location.weighted_support(spark, str(tmp_path)).collect()}
    assert {u: round(s / total, 6) for u, s in want.items()} == {u: round(s, 6) for u, s in got.items()}
    assert location.top_vs_runner(spark, str(tmp_path)).count() == 1


def test_every_part_name_is_asked_for(spark, tmp_path):
    names = ["almond antique", "almond  antique", "azure lavender", "azure lavendel", "beige", "cornflower chocolate", "cornflowers chocolate", "dim"]
    parts = [(k + 1, names[k % len(names)], f"Brand#{k // 9 % 2}") for k in range(30)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    key = lambda name: " ".join(name.lower().split())
    exact = {(str(a), str(b)) for a, x, i in parts for b, y, j in parts if i == j and key(x) == key(y)}
    assert {tuple(r) for r in location.name_match(spark, str(tmp_path)).collect()} == exact
    want = {}
    for a, x, i in parts:
        asked = key(x + x[-1])
        near = {}
        for b, y, j in parts:
            if i == j and len(asked) >= 8 and any(len(t) >= 3 for t in set(asked.split()) & set(key(y).split())):
                near[b] = SequenceMatcher(None, asked, key(y)).ratio()
        best = max(near.values(), default=0.0)
        want |= {(str(a), str(b)): round(best, 6) for b, r in near.items() if r >= 0.94 and r >= best - 0.02}
    got = {(r["mention_id"], r["external_id"]): r["quality"] for r in location.name_match_fuzzy(spark, str(tmp_path)).collect()}
    assert got == want and {a for a, _ in got} > {"1", "2", "3"}


def test_tokens_and_spans_reach_the_end_of_long_documents(spark, tmp_path):
    sizes = {1: 0, 2: 4, 3: 199, 4: 1234}
    docs = spark.createDataFrame(list(sizes.items()), "doc_id long, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r[0], r[1]) for r in labeling._tokens(docs).select("doc_id", "start").collect()} == {(k, s) for k, n in sizes.items() for s in range(0, n + 1, 5)}
    want = {}
    for k, n in sizes.items():
        spans = [x for x in range(3, max(n, 3) + 1, 47)]
        spans += [x + 2 for x in spans if x % 3 == 0]
        for start in range(0, n + 1, 5):
            if own := [x for x in spans if start < x + 9 and start + 5 > x]:
                want[k, start // 5] = (len(own), min(own))
    assert {(r[0], r[1]): (r[2], r[3]) for r in labeling.token_overlap(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("name", ["q_resolution_counts", "q_ranked_candidates", "q_resolutions"])
def test_resolver_queries_have_no_limit(spark, tmp_path, name):
    """Over 10,000 listings, the most that one batch of the resolver takes, all are resolved."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS s_suppkey FROM range(12000)) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    assert differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path)) == ""


def test_an_unknown_that_rounding_alone_puts_first(spark, tmp_path):
    """Two orders whose best unit scores about 0, as the unknown does: sums in the order of the SQL decide alike."""
    rows = [
        (45447, 1, 1, 2, 50.0, 0.05, "A"),
        (45447, 7, 0, 4, 19.0, 0.01, "N"),
        (45447, 9, 3, 3, 26.0, 0.03, "N"),
        (38083, 11, 2, 2, 22.0, 0.04, "A"),
        (45447, 4, 2, 2, 50.0, 0.03, "R"),
        (45447, 11, 3, 3, 4.0, 0.06, "N"),
        (38083, 7, 5, 1, 46.0, 0.02, "N"),
        (38083, 6, 1, 1, 30.0, 0.02, "R"),
        (45447, 2, 3, 7, 47.0, 0.0, "N"),
        (38083, 4, 2, 6, 33.0, 0.05, "A"),
        (38083, 1, 3, 2, 50.0, 0.06, "A"),
        (38083, 14, 1, 6, 4.0, 0.03, "R"),
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("q_top_vs_runner", "q_weighted_support"):
        assert differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], str(tmp_path)) == ""


def test_listings_of_one_id_are_resolved_apart(spark, tmp_path):
    """Ids are cut to nine digits, so long keys share them: each has a result by its own evidence, and a row without a key none."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range + 1000000000 * (range // 500) AS s_suppkey FROM range(1000) UNION ALL SELECT NULL) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    assert differences(spark, con, catalogue.QUERIES["q_resolutions"], catalogue.ORACLE_SQL["q_resolutions"], str(tmp_path)) == ""
