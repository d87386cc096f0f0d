"""The page operators: every query against its SQL in DuckDB, the PDF reader case by case, grouped rules by brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import grouped
from pagewright.plans import catalogue
from pagewright.sources import pdf
from pagewright.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con

def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(x if x is None or isinstance(x, (str, bool)) else float(x) for x in (r[k] for k in order)) for r in rows), key=repr)

@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA), duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)

def test_entry_names_every_query():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

def page(content, extra="", objects="", media="[0 0 600 800]"):
    return (
        "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]>>endobj 3 0 obj<</Type/Page/MediaBox" + media + "/Contents 6 0 R/Resources<</XObject<</A 4 0 R/Fm 9 0 R>>"
        "/ColorSpace<</I[/ICCBased 7 0 R]>>/Font<</F1<</BaseFont/Courier>>>>>>" + extra + ">>endobj 4 0 obj<</Subtype/Image/Width 8/Height 4/Length 1>>stream\nx\nendstream endobj "
        "7 0 obj<</N 3/Length 0>>stream\n\nendstream endobj " + objects + " 6 0 obj<<>>stream\n" + content + "\nendstream endobj"
    ).encode()

def rows(content, **more):
    status, pages = pdf.extract(page(content, **more))
    assert status == "ok" and len(pages) == 1
    return pages[0]

def box(r):
    return tuple(round(r[c], 6) for c in ("x0", "y0", "x1", "y1"))

@pytest.mark.parametrize(
    "content, want",
    [
        ("50 700 100 50 re f", (50, 50, 150, 100)), ("q 2 0 0 2 0 0 cm 50 350 50 25 re f Q", (100, 50, 200, 100)), ("4 w 100 400 m 300 400 l S", (100, 398, 300, 402)),
        ("4 w 2 J 100 400 m 300 400 l S", (98, 398, 302, 402)), ("100 400 m 100 500 300 500 300 400 c f", (100, 325, 300, 400)), ("q 72 0 0 36 100 700 cm /A Do Q", (100, 64, 172, 100)),
        ("100 100 200 200 re W n 0 0 600 800 re f", (100, 500, 300, 700)), ("100 100 200 200 re W n /S sh", (100, 500, 300, 700)), ("/S sh", (0, 0, 600, 800)),
    ],
)
def test_boxes(content, want):
    assert box(rows(content)[0]) == want

def test_white_clip_order_and_inline():
    got = rows("1 g 0 0 9 9 re f 1 1 1 RG 0 0 9 9 re S 1 g 0 G 0 0 9 9 re B 0 0 0 0 k 0 0 9 9 re f /I cs 1 1 1 sc 0 0 9 9 re f")
    assert [r["white"] for r in got] == [True, True, False, True, True] and [r["ord"] for r in got] == list(range(5))
    got = rows("q 0 0 50 50 re W n q 99 0 0 99 0 0 cm /A Do Q Q q 300 300 9 9 re W n 9 0 0 9 0 0 cm /A Do Q")
    assert got[0]["clipped"] and not got[0]["hidden"] and got[1]["hidden"]
    got = rows("q 9 0 0 9 0 0 cm BI /W 6 /H 3 /F /A85 ID abc EI( ~> EI Q 0 0 9 9 re f")
    assert [r["kind"] for r in got] == ["image", "path"] and (got[0]["px_w"], got[0]["px_h"]) == (6, 3)
    got = rows("q 1 0 0 1 200 0 cm /Fm Do Q", objects="9 0 obj<</Subtype/Form/Matrix[1 0 0 1 20 0]/BBox[0 0 9 9]>>stream\n0 0 40 40 re f\nendstream endobj")
    assert (got[0]["x0"], got[0]["x1"]) == (220, 260)
    assert [r["offpage"] for r in rows("700 0 9 9 re f 0 0 9 9 re f")] == [True, False]
    shapes = rows("0 0 9 9 re f 0 0 m 9 0 l 9 9 l h f 0 0 m 1 9 8 9 9 0 c S")
    assert [(r["n_lines"], r["n_curves"], r["rect"], r["closed"]) for r in shapes] == [(4, 0, True, True), (3, 0, False, True), (0, 1, False, False)]

def test_crop_and_damage():
    r = rows("q 50 0 0 50 110 110 cm /A Do Q", extra="/CropBox[100 100 500 700]")[0]
    assert (r["x0"], r["y1"]) == (10, 590)
    assert pdf.extract(None) == ("not_pdf", []) and pdf.extract(b"x") == ("not_pdf", [])
    assert pdf.extract(b"%PDF-1.4 /Encrypt")[0] == "encrypted" and pdf.extract(b"%PDF-1.4 << ( [")[0] == "ok"
    assert rows("( [ << 1 2 re f Q Q /X Tf ET 5 5 5 5 re f")[0:1] is not None

def test_filters_and_predictors():
    import base64
    import zlib

    raw = bytes(range(200)) * 3
    for name, coded in (("FlateDecode", zlib.compress(raw)), ("ASCIIHexDecode", raw.hex().encode() + b">"), ("ASCII85Decode", base64.a85encode(raw) + b"~>"), ("RunLengthDecode", b"".join(bytes([0, b]) for b in raw) + b"\x80")):
        assert pdf.FILTERS[name](coded) == raw
    assert pdf.predicted(bytes([1, 10, 10, 2, 0, 0]), {"Predictor": 15, "Columns": 2}) == bytes([10, 20, 10, 20])
    assert pdf.cubic_range(0, 1, 1, 0) == (0, 0.75) and pdf.cubic_range(0, 1, 2, 3) == (0, 3)

def test_clusters_and_runs_by_brute_force():
    rng = np.random.default_rng(1)
    x0, y0 = rng.integers(0, 3000, 150), rng.integers(0, 3000, 150)
    x1, y1 = x0 + rng.integers(1, 500, 150), y0 + rng.integers(1, 500, 150)
    touch = [[k for k in range(150) if x0[a] <= x1[k] + 10 and x0[k] <= x1[a] + 10 and y0[a] <= y1[k] + 10 and y0[k] <= y1[a] + 10] for a in range(150)]
    root, before = list(range(150)), None
    while root != before:
        before, root = root, [min(root[k] for k in near) for near in touch]
    got = grouped.touching_roots(x0, y0, x1, y1, np.zeros(150, bool))
    assert got.tolist() == root
    assert grouped.chains(np.array([0, 12, 24, 300]), np.array([0, 0, 0, 0]), np.array([10, 22, 34, 310]), np.array([10, 10, 10, 10])).tolist() == [3, 3, 3, 1]

def test_strips():
    s = [{"image_idx": k, "x0": 0, "y0": 100 * k, "x1": 500, "y1": 100 * (k + 1), "px_w": 8, "px_h": 4, "mask": False, "parts": 1} for k in range(3)]
    (m,) = grouped.merged_strips(s)
    assert m["parts"] == 3 and m["px_h"] == 12 and m["y1"] == 300
    assert len(grouped.merged_strips([s[0], s[1] | {"mask": True}])) == 2 and len(grouped.merged_strips([s[0], s[1] | {"y0": 150, "y1": 250}])) == 2

def test_geometry(spark):
    r = spark.sql("SELECT 90 AS rot, 10.0D AS a, 20.0D AS b, 30.0D AS c, 60.0D AS d").select(geometry.on_page(*map(F.col, "abcd"), F.col("rot"), 600, 800).alias("p"), geometry.r1(F.lit(-0.25)).alias("r"), geometry.ramp(F.lit(5.0), 10, 0).alias("s")).first()
    assert tuple(r.p) == (20, 10, 60, 30) and r.r == -0.3 and r.s == 0.5

def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(page("50 700 100 50 re f 1 1 2 2 re f"))
    ingest.append(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in" / "b.pdf").write_bytes(b"no")
    ingest.append(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.status for r in got if r.kind in (None, "path")) == ["not_pdf", "ok", "ok"]
    assert spark.createDataFrame(got, pdf.SCHEMA).count() == ingest.primitives(spark, str(tmp_path / "in")).count()
