import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentrank.functions.hashing import below, draw, with_rank
from latentrank.functions.scalars import agresti_coull, interpolate, prompt_hash, prompt_hash_column
from latentrank.operators import layout
from latentrank.sources.datasets import prepare, read_checkpoint


def test_runs_and_density(spark):
    v = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([0, 9, 9, 0, 9, 0, 9, 9, 9])], "page int, i int, value double")
    assert sorted((r.start, r.stop) for r in layout.value_runs(v, 5, 2).collect()) == [(1, 3), (6, 9)]
    raster = [[1, 0, 0], [1, 1, 0]]
    cells = spark.createDataFrame([(1, y, x, bool(c)) for y, row in enumerate(raster) for x, c in enumerate(row)], "page int, y int, x int, dark boolean")
    assert sorted((r.i, round(r.value, 3)) for r in layout.densities(cells, "x").collect()) == [(0, 1.0), (1, 0.5), (2, 0.0)]


def test_wrapped_names_and_styles(spark):
    lines = spark.createDataFrame([(1, 0, "F. James Sensen,", 10.0, 0.0, 10.0), (1, 1, "Jr.", 12.0, 12.0, 22.0), (1, 2, "Other", 10.0, 60.0, 70.0)], "page int, line_id int, text string, x0 double, y0 double, y1 double")
    assert sorted((r.text, r.n_lines) for r in layout.merge_wrapped(lines).collect()) == [("F. James Sensen, Jr.", 2), ("Other", 1)]
    spans = spark.createDataFrame([(1, 0, 0, "Bold ", True, 0.0, 1.0), (1, 0, 1, " ", False, 1.0, 2.0), (1, 0, 2, "more", True, 2.0, 3.0), (1, 0, 3, "plain", False, 3.0, 4.0)], "page int, line_id int, i int, text string, bold boolean, x0 double, x1 double")
    assert [(r.text, r.bold, r.x1) for r in layout.style_runs(spans).orderBy("run").collect()] == [("Bold  more", True, 3.0), ("plain", False, 4.0)]


def test_parsing(spark):
    d = spark.createDataFrame([("Sen. Ann Lee", "o/ Utica, N.Y. (at large)", "Rep. — 3rd term"), ("Bo", "Nowhere", "Ind.")], "n string, c string, p string")
    (chamber, name), (city, district), (party, term) = layout.chamber_and_name(F.col("n")), layout.home_and_district(F.col("c")), layout.party_and_term(F.col("p"))
    got = d.select(chamber, name, city, district, party, term).collect()
    assert [tuple(r) for r in got] == [("Senate", "Ann Lee", "Utica, N.Y.", "at large", "Rep.", "3rd term"), ("House", "Bo", "Nowhere", "", "Ind.", "")]
    assert d.select(layout.file_stem(F.lit(" J. R.  Smith, Jr.! ")).alias("s")).first().s == "J_R_Smith_Jr"


def test_columns_and_gaps(spark):
    v = spark.createDataFrame([(1, 0.0), (1, 3.0), (1, 50.0), (2, 1.0), (3, 1.0), (3, 4.0)], "page int, x double")
    assert {r.page: r.threshold for r in layout.column_split(v).collect()} == {1: 26.5, 2: None, 3: None}


def test_rank_equals_row_number(spark):
    d = spark.range(3000).withColumn("g", F.col("id") % 3).withColumn("h", draw(1, "x", "id"))
    got = {r.id: r.rank for r in with_rank(d, ["g"], "h", ["id"]).collect()}
    rows = d.collect()
    for g in range(3):
        for k, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: (r.h, r.id)), 1):
            assert got[r.id] == k
    counts = np.bincount([r.b for r in d.select(below(F.col("h"), F.lit(5)).alias("b")).collect()], minlength=5)
    assert counts.min() > 500


def test_scalars(spark):
    d = spark.createDataFrame([("a {{y}}", "b", 0, 0, 8, 10)], "x string, y string, k int, n int, k2 int, n2 int")
    assert d.select(interpolate("{{ x }}-{{y}}!", d.columns).alias("t")).first().t == "a {{y}}-b!"
    with pytest.raises(ValueError, match="lack"):
        interpolate("{{z}}", d.columns)
    assert d.select(prompt_hash_column(F.col("x"), F.col("y")).alias("h")).first().h == prompt_hash("a {{y}}", "b")
    low, high = agresti_coull(F.col("k"), F.col("n"))
    assert tuple(d.select(low, high).first()) == (None, None)
    low, high = agresti_coull(F.col("k2"), F.col("n2"))
    assert np.allclose(tuple(d.select(low, high).first()), (0.4794, 0.9541), atol=1e-3)


def test_dataset_and_checkpoint(spark, tmp_path):
    d = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 5.0)], "text string, tone double")
    assert [(r.tone_label, r.tone_level) for r in prepare(d, ["text"]).collect()] == [("Promoting", 1), (None, None), ("Attacking", 5)]
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"version": 1, "stage": "waiting", "batch": {"id": "b", "status": "done", "request_counts": {"total": 3, "completed": 2, "failed": 1}}, "results": None, "started_at": 5}, indent=1))
    r = read_checkpoint(spark, str(p)).first()
    assert r.batch.request_counts.completed == 2 and r.stage == "waiting"


def test_boxes_below_an_entry_are_skipped(spark):
    e = spark.createDataFrame([(1, 1, "L", 100.0)], "page int, entry_id int, col string, y0 double")
    b = spark.createDataFrame([(1, 7, "L", 108.0), (1, 8, "L", 80.0)], "page int, box_id int, col string, y1 double")
    assert [tuple(r) for r in layout.nearest_above(e, b).collect()] == [(1, 1, 8, 20.0)]


def test_wrapped_lines_are_held_to_the_first(spark):
    lines = [(1, i, t, x, 12.0 * i, 12.0 * i + 10) for i, (t, x) in enumerate([("a", 0.0), ("b", 20.0), ("c", 40.0), ("d", 15.0)])]
    got = layout.merge_wrapped(spark.createDataFrame(lines, "page int, line_id int, text string, x0 double, y0 double, y1 double")).collect()
    assert sorted((r.text, r.x0, r.y1, r.n_lines) for r in got) == [("a b", 0.0, 22.0, 2), ("c d", 40.0, 46.0, 2)]


def test_titles(spark):
    d = spark.createDataFrame([("O'BRIEN county-WEST 2nd",)], "s string")
    assert d.select(layout.title_case(F.col("s")).alias("t")).first().t == "O'Brien County-West 2Nd"


def test_matches_equal_a_loop_over_all_pairs(spark):
    """Crowded pages, equal heights, negative places, null columns, places on the rims of bands and cells."""
    import random

    from pyspark.sql import functions as F

    draw = random.Random(8)
    spot = lambda: float(draw.choice([draw.randrange(-300, 900), draw.randrange(-2, 5) * 255, draw.randrange(6) * 40]))
    entries = [(draw.choice([1, 2, 2, 2, None]), i, draw.choice(["L", "R", None]), spot()) for i in range(150)]
    boxes = [(draw.choice([1, 2, 2, 3, None]), i, draw.choice(["L", "R", None]), spot(), f"label {i % 40:02d}") for i in range(120)]
    e = spark.createDataFrame(entries, "page int, entry_id bigint, col string, y0 double")
    b = spark.createDataFrame(boxes, "page int, box_id bigint, col string, y1 double, label string")
    got = {(r.page, r.entry_id): (r.gap, r.box_id) for r in layout.nearest_above(e, b).collect()}
    want = {}
    for p, i, c, y in entries:
        near = [(y - z, k) for q, k, d, z, _ in boxes if p is not None and p == q and c is not None and c == d and -5 <= y - z <= 250]
        if near:
            want[p, i] = min(near)
    assert got == want and len(want) > 50
    got = {(r.page, r.entry_id): r.label for r in layout.label_above(e, b).collect()}
    want = {}
    for p, i, c, y in entries:
        above = [(c is not None and c == d, z, t) for q, _, d, z, t in boxes if p is not None and p == q and z <= y + 1]
        if above:
            want[p, i] = max(above)[2]
    assert got == want and len(want) > 50
    lines = [(draw.choice([1, 2, 2]), i, "t", float(draw.randrange(-90, 200)), y := spot(), y + draw.choice([8.0, 10.0, 95.0]), draw.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(lines, "page int, line_id bigint, text string, x0 double, y0 double, y1 double, bold boolean")
    got = {(r.page, r.line_id): r.next_id for r in layout.next_within(df).collect()}
    want = {}
    for p, i, _, x, y, z, _ in lines:
        near = [(v, k) for q, k, _, u, v, _, bold in lines if p == q and k != i and not bold and v > y - 1 and v - z <= 20 and abs(u - x) <= 30]
        if near:
            want[p, i] = min(near)[1]
    assert got == want and len(want) > 30


def test_a_crowded_page_makes_no_pairs(spark):
    """Rows of the match stay in proportion to a page's: all pairs would be 10 ** 10."""
    n = 100_000
    e = spark.range(n).selectExpr("1 AS page", "id AS entry_id", "'L' AS col", "CAST(id % 5000 AS double) AS y0")
    b = spark.range(n).selectExpr("1 AS page", "id AS box_id", "'L' AS col", "CAST(id % 5000 AS double) AS y1")
    assert layout.nearest_above(e, b).count() == n
    assert layout.label_above(e, b.selectExpr("*", "CAST(box_id AS string) AS label")).count() == n


def test_pages_without_a_gap_are_split_in_the_middle(spark):
    rows = [(1, 10.0, 600.0), (1, 300.0, 600.0), (2, 10.0, 500.0), (2, 14.0, 500.0), (3, 7.0, 90.0)]
    df = spark.createDataFrame(rows, "page int, x double, w double")
    assert {r.page: r.threshold for r in layout.column_split(df, width="w").collect()} == {1: 155.0, 2: 250.0, 3: 45.0}
    assert {r.page: r.threshold for r in layout.column_split(df).collect()} == {1: 155.0, 2: None, 3: None}
