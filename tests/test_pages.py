"""Documents from bytes to regions: fonts, hardening, tight type, strips, vector and image kinds, pixels, fax, JSON."""

import json
import time
import zlib

import numpy as np
import pytest
from pagewright.functions import geometry
from pagewright.operators import document, images, layout, scoring, vectors
from pagewright.sinks import json_lines
from pagewright.sources import fax, fonts, jpeg, pdf, pixels
from pyspark.sql import functions as F


def page(content, extra="", objects="", fonts="/F1<</BaseFont/Courier>>", media="[0 0 600 800]"):
    return (
        f"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]>>endobj 3 0 obj<</Type/Page/MediaBox{media}/Contents 6 0 R/Resources<</XObject<</A 4 0 R/M 5 0 R/Fm 9 0 R>>"
        f"/Font<<{fonts}>>>>{extra}>>endobj 4 0 obj<</Subtype/Image/Width 8/Height 4/BitsPerComponent 8/ColorSpace/DeviceGray/Filter/ASCIIHexDecode/Length 1>>stream\n{'00ff' * 16}>\nendstream endobj "
        f"5 0 obj<</Subtype/Image/Width 8/Height 1/ImageMask true/Length 1>>stream\n\x0f\nendstream endobj {objects} 6 0 obj<<>>stream\n{content}\nendstream endobj"
    ).encode("latin-1")


def rows(content, **more):
    status, pages, _ = pdf.read(page(content, **more))
    assert status == "ok" and len(pages) == 1
    return pages[0]


def kind(content, k, **more):
    return [r for r in rows(content, **more) if r["kind"] == k]


@pytest.mark.parametrize(
    "data",
    [page("", extra="/Annots[<</Rect[0 0 9 9]/AP[1]>> 7 <</Rect 5>>]"), page("/Fm Do", objects="9 0 obj<</Subtype/Form/Resources<</XObject<</Fm 9 0 R>>>>>>stream\n0 0 40 40 re f " + "/Fm Do " * 9 + "\nendstream endobj"),
     b"%PDF-1.4 1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[2 0 R 2 0 R]>>endobj", b"%PDF-1.4 trailer<</Root 1 0 R>> 1 0 obj 1 0 R endobj", page("[" * 5000)],
)
def test_odd_files_end_soon(data):
    start = time.time()
    status, _, _ = pdf.read(data)
    assert time.time() - start < 1 and (status in ("ok",) or status.startswith("damaged"))


def test_a_page_has_a_budget(monkeypatch):
    monkeypatch.setattr(pdf, "OPERATORS", 50)
    status, pages, _ = pdf.read(page("0 0 9 9 re f " * 100))
    assert status == "over_budget" and 20 <= len([r for r in pages[0] if r["kind"] == "path"]) < 30


def test_fonts_text_and_widths():
    cmap = "/CIDInit begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <00480069> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange"
    f = (
        "/F1<</Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</DW 500/W[65[250] 80 82 750]/FontDescriptor<</Ascent 800/Descent 200>>>>]/ToUnicode 10 0 R>>"
        "/F2<</Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/nothing]>>/FirstChar 65/Widths[400 600]/FontDescriptor<</MissingWidth 300>>>>"
        "/F3<</Subtype/Type3/FontMatrix[0.01 0 0 0.01 0 0]/FirstChar 97/Widths[50]/Encoding<</Differences[97/a]>>/CharProcs<</a 11 0 R>>>>"
    )
    got = kind(
        "BT /F1 10 Tf 1 Tr 100 100 Td <0041005000510099> Tj /F2 10 Tf (ABC) Tj /F3 10 Tf (a) Tj /Nope 10 Tf (xy) Tj ET", "glyph", fonts=f,
        objects=f"10 0 obj<<>>stream\n{cmap}\nendstream endobj 11 0 obj<<>>stream\n50 0 -10 -20 60 90 d1 0 0 9 9 re f\nendstream endobj",
    )
    assert [(r["text"], r["mapped"], round(r["ex"] - r["ux"], 6)) for r in got] == [
        ("Hi", True, 2.5), ("a", True, 7.5), ("b", True, 7.5), ("", False, 5.0), ("é", True, 4.0), ("", False, 6.0), ("C", True, 3.0), ("a", True, 5.0), ("", False, 0.0), ("", False, 0.0),
    ]
    assert (round(got[0]["y0"], 6), round(got[0]["y1"], 6)) == (692.0, 702.0)  # a descent above zero is read as below
    d1 = got[7]
    assert [round(v, 6) for v in (d1["x0"] - d1["ux"], d1["x1"] - d1["ux"], d1["y0"], d1["y1"])] == [-1.0, 6.0, 691.0, 702.07]  # advance box and d1 box
    assert got[8]["font"] is None and got[8]["x0"] == got[8]["x1"]
    assert fonts.text_of_glyph("fi.alt") == "ﬁ" and fonts.text_of_glyph("Aring") == "Å" and fonts.text_of_glyph("g12") is None


def test_dots_and_empty_paths():
    got = kind("1 J 5 5 m h B* 0 J 5 5 m h S 1 J 5 5 m 5 5 l S 0 J 5 5 m h B*", "path")
    assert [(r["dot"], r["empty"]) for r in got] == [(True, False), (False, True), (True, False), (False, False)]


def test_rules_and_grid():
    got = kind("50 700 200 2 re f 100 100 m 100 300 l S 10 10 m 12 10 l S 0 0 300 200 re S 0 100 m 300 100 l S", "rule")
    assert [tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in got] == [(50, 99, 250, 99), (100, 500, 100, 700), (0, 800, 300, 800), (300, 600, 300, 800), (0, 600, 300, 600), (0, 600, 0, 800), (0, 700, 300, 700)]
    table = kind("0 0 100 100 re 0 50 m 100 50 l 30 0 m 30 100 l 60 0 m 60 100 l S", "path")[0]
    assert (table["seg_rows"], table["seg_cols"]) == (3, 4)


def test_glyph_clip_decides_alone():
    got = kind("0 0 300 800 re W n BT /F1 10 Tf -3 700 Td (a) Tj 302 0 Td (b) Tj 300 0 Td (c) Tj ET", "glyph")
    assert [(r["offpage"], r["hidden"], r["clipped"]) for r in got] == [(False, False, False), (False, False, True), (False, True, False)]


def scan(spark, *docs):
    return pdf.scan(spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, content binary"))


def test_regions_of_a_document(spark):
    text = "BT /F1 10 Tf 50 700 Td (one two) Tj 150 0 Td (far) Tj -150 -20 Td (next) Tj 3 Tr 0 -20 Td (ghost) Tj ET"
    strips = " ".join(f"q 80 0 0 10 300 {400 - 10 * k} cm /A Do Q" for k in range(3))
    data = page(f"{text} {strips} 50 50 100 100 re S", extra="/Annots[<</Subtype/Widget/Rect[10 10 60 30]/Parent<</FT/Tx>>>>]")
    r = document.Regions(scan(spark, data, b"no", page("")))
    assert [(x.text, x.line) for x in layout.word_lines(r.words).orderBy("first_ord").collect()] == [("one", 1), ("two", 1), ("far", 1), ("next", 2), ("ghost", 3)]
    assert [x.text for x in r.lines.orderBy("ord").collect()] == ["one two", "far", "next", "ghost"]
    m = r.map.orderBy("id").collect()
    assert [(x.what, list(x.flags)) for x in m] == [("text", [])] * 3 + [("text", ["invisible"]), ("image", ["strips"]), ("vector", ["stroke"]), ("annot", ["no_appearance"])]
    image = r.images.first()
    assert (image.parts, image.px_w, image.px_h, list(image.pieces)) == (3, 8, 12, [4, 4, 4]) and (image.y0, image.y1) == (390, 420)
    assert r.annots.first().field == "Tx" and {(x.doc_id, x.verdict) for x in r.verdicts.collect()} == {(0, "text"), (2, "none")}
    assert r.vector_kinds.first().kind == "border" and r.ocr_regions.first().confidence < 0.4
    lines = {x.doc_id: json.loads(x.line) for x in json_lines.documents_json(r, glyphs=True).collect()}
    assert lines[1] == {"doc_id": 1, "status": "not_pdf", "pages": [], "fonts": []} and len(lines[0]["pages"]) == 1
    p = lines[0]["pages"][0]
    assert [x["text"] for x in p["words"]] == ["one", "two", "far", "next", "ghost"] and p["glyph_count"] == 19 and len(p["map"]) == 7 and p["words"][4]["invisible"] and lines[0]["fonts"][0]["base"] == "Courier"
    assert len(p["glyphs"]) == 19 and p["images"][0]["parts"] == 3 and p["rotate"] == 0
    assert json.loads(json_lines.vector_kinds_json(r).first().line)["page"] == 0
    assert json.loads(next(x.line for x in json_lines.text_json(r).collect() if x.doc_id == 2)) == {"doc_id": 2, "pages": [{"n": 1, "glyphs": 0, "unmapped": 0, "invisible": 0, "text": ""}]}


def test_tight_type_splits_but_not_single_letters_or_figures(spark):
    def glyphs(text, gaps):
        x, out = 0.0, []
        for k, c in enumerate(text):
            x += gaps.get(k, -0.1) * 10
            out.append((0, 1, k, c, True, False, 0, False, False, False, False, False, x, 0.0, x + 6, 10.0, x, 8.0, x + 6, 8.0, 1.0, 0.0, 10.0))
            x += 6
        return out

    cols = "doc_id long, page_n long, ord long, text string, mapped boolean, is_space boolean, font int, invisible boolean, white boolean, annot boolean, offpage boolean, hidden boolean, x0 double, y0 double, x1 double, y1 double, ux double, uy double, ex double, ey double, dx double, dy double, size double"
    split = lambda text, gaps: [r.text for r in layout.words(spark.createDataFrame(glyphs(text, gaps), cols), tight=True).orderBy("first_ord").collect()]
    assert split("lettersoverlap", {7: 0.14}) == ["letters", "overlap"]
    assert split("lettersoverlap", {1: 0.14, 13: 0.14}) == ["lettersoverlap"]  # never a single glyph
    assert split("letters12345", {9: 0.14}) == ["letters12345"]  # never between digits
    assert split("letters", {3: 0.14}) == ["let", "ters"] and split("short", {3: 0.14}) == ["short"]  # too few gaps to measure


def test_vector_kinds_by_case(spark):
    names = "doc_id page_n ord x0 y0 x1 y1 fill stroke shading white annot empty offpage hidden clipped rect closed".split()
    base = {"doc_id": 0, "fill": False, "stroke": False, "rect": False, "closed": False} | dict.fromkeys(("shading", "white", "annot", "empty", "offpage", "hidden", "clipped"), False)

    def p(x0, y0, x1, y1, lines=1, curves=0, **more):
        return base | {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), "n_lines": lines, "n_curves": curves, "seg_rows": 0, "seg_cols": 0} | more

    box = {"rect": True, "closed": True, "lines": 4}
    cases = {
        "rule": [p(10, 10, 200, 11, stroke=True)], "border": [p(10, 10, 200, 200, stroke=True, **box)], "fill": [p(10, 10, 200, 200, fill=True, **box)],
        "table_grid": [p(0, 40 * k, 120, 40 * k + 0.5, stroke=True) for k in range(4)] + [p(40 * k, 0, 40 * k + 0.5, 120, stroke=True) for k in range(4)],
        "outlined_text": [p(10 + 7 * k, 10, 15 + 7 * k, 20, fill=True, curves=3) for k in range(5)],
        "chart_or_diagram": [p(10, 10 * k, 60 + 9 * k, 10 * k + 30, stroke=True, curves=2) for k in range(6)],
    }
    data = [r | {"page_n": n, "ord": k} for n, rs in enumerate(cases.values()) for k, r in enumerate(rs)]
    kinds = {"doc_id": "long", "page_n": "long", "ord": "long"} | dict.fromkeys(("x0", "y0", "x1", "y1"), "double") | dict.fromkeys(("n_lines", "n_curves", "seg_rows", "seg_cols"), "int")
    cols = [*names, "n_lines", "n_curves", "seg_rows", "seg_cols"]
    paths = spark.createDataFrame([tuple(r[c] for c in cols) for r in data], ", ".join(f"{c} {kinds.get(c, 'boolean')}" for c in cols))
    k = vectors.kinds(vectors.features(paths, vectors.clusters(paths, 480_000.0), vectors.letter_runs(paths))).collect()
    got = {}
    for r in k:
        got.setdefault(list(cases)[r.page_n], set()).add(r.kind)
    assert {c: got[c] for c in cases if c != "outlined_text"} == {c: {c} for c in cases if c != "outlined_text"}
    assert got["outlined_text"] == {"outlined_text"} and all(r.has_text > 0.8 for r in k if r.kind == "outlined_text")


def text_like(w=300, h=120):
    g = np.full((h, w), 255, np.uint8)
    for y in range(10, h - 12, 20):
        for x in range(10, w - 12, 8):
            g[y : y + 10, x : x + 5] = 0
    return g


def test_image_kinds_by_case(spark):
    ramp = np.tile(np.arange(256, dtype=np.uint8), (200, 1))
    one = np.full((100, 100), 255, np.uint8)
    one[20:80, 20:80] = 0
    cases = {"blank": np.full((50, 50), 200, np.uint8), "text": text_like(), "photo": ramp, "graphic": one}
    table = spark.createDataFrame([(k, g.shape[1], g.shape[0], g.tobytes()) for k, g in enumerate(cases.values())] + [(9, 5, 5, None)], "i long, w int, h int, grey binary")
    got = {r.i: r for r in images.image_kinds(images.with_features(table, "i")).collect()}
    assert [got[k].kind for k in range(4)] == list(cases) and got[9].kind == "blank"
    assert got[1].has_text > 0.9 and got[0].has_text == 0 and got[3].has_text < 0.1
    marks = np.array([[10 * k, 0, 10 * k + 6, 9] for k in range(5)] + [[300, 0, 306, 9]])
    assert images.word_runs(marks) == (1, 5) and images.run_lengths(marks).tolist() == [5] * 5 + [1]


def test_word_runs_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 200, 40), rng.integers(0, 30, 40)
        b = np.stack([x, y, x + rng.integers(1, 12, 40), y + rng.integers(1, 12, 40)], 1)
        nxt, taken = {}, set()
        for i, (x0, y0, x1, y1) in enumerate(b.tolist()):
            h, best = y1 - y0 + 1, None
            tol = max(1, h // 6)
            for bottom in range(max(0, y1 - tol), y1 + tol + 1):
                row = sorted((b[j, 0], j) for j in range(40) if b[j, 3] == bottom and b[j, 0] > x0)[:4]
                for c, j in row:
                    hj = b[j, 3] - b[j, 1] + 1
                    if c > x1 + h + 1:
                        break
                    if 2 * hj >= h and hj <= 2 * h and c + 1 >= x1 and (best is None or c < best[0]):
                        best = (c, j)
            if best and best[1] not in taken:
                nxt[i] = best[1]
                taken.add(best[1])
        want = [1] * 40
        for s in set(range(40)) - taken:
            run = [s]
            while run[-1] in nxt:
                run.append(nxt[run[-1]])
            for k in run:
                want[k] = len(run)
        assert images.run_lengths(b).tolist() == want


def test_ink_parts_by_flood():
    from pagewright.operators.grouped import ink_boxes

    rng = np.random.default_rng(2)
    for _ in range(15):
        ink = rng.random((17, 23)) < 0.35
        left, want = set(zip(*(a.tolist() for a in np.nonzero(ink)))), []
        for y, x in sorted(left):
            if (y, x) in left:
                todo, part = [(y, x)], []
                left.discard((y, x))
                while todo:
                    a, b = todo.pop()
                    part.append((a, b))
                    near = {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                    left -= near
                    todo += near
                ys, xs = zip(*part)
                want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
        assert ink_boxes(ink) == want


def test_pixels():
    data = page("q 80 0 0 40 10 700 cm /A Do Q q 0 80 -40 0 300 300 cm /M Do Q q 9 0 0 9 0 0 cm BI /W 2 /H 1 /BPC 8 /CS /RGB ID \xff\x00\x00\x00\x00\x00 EI Q")
    got = pixels.thumbs_of(data)
    assert [(r["obj"], r["error"], r["w"], r["h"]) for r in got] == [(4, None, 8, 4), (5, None, 1, 8), (-1, None, 2, 1)]
    assert got[0]["grey"] == b"\x00\xff" * 16 and sorted(got[1]["grey"]) == [0] * 4 + [255] * 4 and got[2]["grey"] == bytes([76, 0])
    doc = pdf.Document(b"")
    grey = lambda info, raw: pixels.samples(doc, {"Width": 2, "Height": 1, "BitsPerComponent": 8} | info, raw).ravel().tolist()
    assert grey({"ColorSpace": "DeviceGray", "Decode": [1, 0]}, b"\x00\xff") == [255, 0]
    assert grey({"ColorSpace": ["Indexed", "DeviceGray", 1, b"\x00\xff"], "BitsPerComponent": 1}, b"\x40") == [0, 255]
    assert grey({"ColorSpace": "DeviceCMYK"}, bytes([0, 0, 0, 0, 0, 0, 0, 255])) == [255, 0] and grey({"ColorSpace": ["Separation", "X", "DeviceCMYK", 1]}, b"\x00\xff") == [255, 0]
    assert grey({"ColorSpace": "DeviceGray", "BitsPerComponent": 16}, b"\x10\x99\x20\x99") == [16, 32]
    for info, raw, error in (({"Filter": "DCTDecode"}, b"", "jpeg"), ({"Filter": "JPXDecode"}, b"", "jpx"), ({"ColorSpace": "DeviceGray"}, b"a", "short"), ({}, b"ab", "no_colour_space"), ({"ColorSpace": "Lab"}, b"ab", "colour_space"), ({"BitsPerComponent": 3}, b"", "bits"), ({"Width": 0}, b"", "no_size")):
        with pytest.raises(pixels.Failed, match=error):
            grey(info, raw)
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (600, 900), dtype=np.uint8)
    small = pixels.averaged(g, 64)
    assert max(small.shape) == 64 and small[0, 0] == (int(g[:14, :14].sum()) + 98) // 196
    turns = {(False, False, False): g[:3, :4], (True, False, False): g[:3, :4].T}
    assert all((pixels.turned(g[:3, :4], t) == w).all() for t, w in turns.items())
    assert [pixels.turn_of(c) for c in ([(0, 0), (9, 0), (0, 9)], [(9, 0), (9, 9), (0, 0)], [(9, 9), (0, 9), (9, 0)], [(0, 9), (0, 0), (9, 9)])] == [(False, False, False), (True, True, False), (False, True, True), (True, False, True)]
    canvas = pixels.merged((0, 0, 8, 8), [((0, 0, 8, 4), np.zeros((4, 8), np.uint8)), ((0, 4, 8, 8), None)], 64)
    assert canvas.shape == (8, 8) and canvas[:4].max() == 0 and canvas[4:].min() == 255


def _fax_line(bits, above):
    """A line in Group 4 code."""
    change = lambda row: [k for k in range(len(row)) if row[k] != (row[k - 1] if k else 0)]
    n, a, colour, out = len(bits), -1, 0, ""
    mine, up = change(bits), change(above)
    modes = {v: k for k, v in fax.MODES.items()}
    codes = [{v: k for k, v in t.items()} for t in fax.RUNS]
    run = lambda m, c: codes[c][m // 64 * 64] + codes[c][m % 64] if m >= 64 else codes[c][m]
    while a < n:
        b1 = next((k for k in up if k > a and above[k] != colour), n)
        b2 = next((k for k in up if k > b1), n)
        a1 = next((k for k in mine if k > a and (a >= 0 or k >= 0) and bits[k] != colour), n)
        if b2 < a1:
            out, a = out + modes["pass"], b2
        elif abs(a1 - b1) <= 3:
            out, a, colour = out + modes[a1 - b1], a1, 1 - colour
        else:
            a2 = next((k for k in mine if k > a1), n)
            out, a = out + modes["level"] + run(a1 - max(a, 0), colour) + run(a2 - a1, 1 - colour), a2
    return out


def test_fax():
    for table in fax.RUNS:  # no code starts another one
        codes = sorted(table)
        assert len(codes) == 104 and not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert fax.decode(b"\x2e\xe0", 8, 1, -1) == (bytes([0b11000011]), True)
    rng = np.random.default_rng(7)
    image = np.repeat(rng.integers(0, 2, (40, 60)), 5, axis=1)
    image[5] = 0
    image[9:12] = image[8]
    coded, above = "", [0] * 300
    for row in image.tolist():
        coded += _fax_line(row, above)
        above = row
    coded += "0" * (-len(coded) % 8)
    raw, whole = fax.decode(int(coded, 2).to_bytes(len(coded) // 8, "big"), 300, 40, -1, black_is_1=True)
    assert whole and (np.unpackbits(np.frombuffer(raw, np.uint8).reshape(40, -1), axis=1)[:, :300] == image).all()
    raw, whole = fax.decode(b"\x00\x00\x00\x01", 16, 4, -1)
    assert not whole and raw == b"\xff" * 8


def test_thumbs_table(spark):
    got = pixels.thumbs(spark.createDataFrame([(1, page("q 80 0 0 40 10 700 cm /A Do Q")), (2, b"x"), (3, None)], "doc_id long, content binary")).collect()
    assert [(r.doc_id, r.page_n, r.obj, r.w, r.h) for r in got] == [(1, 1, 4, 8, 4)] and pixels.pgm(2, 1, b"ab").startswith(b"P5\n2 1\n")


def test_scoring(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    marks = spark.createDataFrame([(1, 1, 0, "text", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "text", 0.5, 0.0, 10.0, 10.0), (1, 1, 2, "image", 0.0, 0.0, 10.0, 10.0)], f"doc_id long, page_n long, mark long, what string, {box}")
    found = spark.createDataFrame([(1, 1, 7, "text", 0.4, 0.0, 10.0, 10.0), (1, 1, 8, "text", 0.0, 0.2, 10.0, 10.0), (1, 1, 9, "vector", 0.0, 0.0, 10.0, 10.0)], f"doc_id long, page_n long, region long, what string, {box}")
    keys = ["doc_id", "page_n"]
    pairs = scoring.one_to_one(marks, found, keys, 1.0)
    assert sorted((r.mark, r.region) for r in pairs.collect()) == [(0, 8), (1, 7)]
    assert scoring.edge_errors(pairs.withColumn("what", F.lit("t")), ["what"]).first()[1:] == (2, pytest.approx(0.2), pytest.approx(0.2))
    assert scoring.contained(marks.where("mark < 2"), found.select(*keys, "region", "x0", "y0", "x1", "y1"), keys, 0.1).count() == 3
    votes = spark.createDataFrame([(1, "a", 0, 0.1), (1, "b", 1, 0.9), (1, "b", 2, 0.3), (1, "a", 3, 0.8), (2, "c", 0, 0.5)], "g long, kind string, ord long, conf double")
    assert sorted(tuple(r) for r in scoring.majority(votes, ["g"], "kind", "ord", "conf").collect()) == [(1, "a", 0.8), (2, "c", 0.5)]
    frozen, now = (spark.createDataFrame(x, "name string, digest string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert sorted(tuple(r) for r in scoring.frozen_diff(frozen, now).collect()) == [("b", "CHANGED"), ("c", "MISSING"), ("d", "NEW")]
    assert scoring.largest(marks.withColumn("k", F.col("mark")), ["doc_id"], "mark").first().k == 0
    regions = spark.createDataFrame([(0.9, True), (0.5, False), (0.3, True)], "confidence double, expected boolean")
    assert sorted(tuple(r) for r in scoring.cut_sweep(regions, [0.4, 0.6]).collect()) == [(0.4, 2, 1, 1), (0.6, 1, 1, 1)]
    flags = spark.createDataFrame([(["a"], ["a", "b"]), (["c"], ["a"])], "expected array<string>, flags array<string>")
    assert scoring.flags_missing(flags).count() == 1
    words = spark.createDataFrame([("abc", 70.0), ("ab1", 70.0), ("12", 60.0), ("abcd", 50.0)], "t string, c double")
    assert [r[0] for r in words.select(scoring.counting_word(F.col("t"), F.col("c"))).collect()] == [True, False, True, False]
    some = spark.range(200).selectExpr("id", "id % 3 AS s")
    assert scoring.stratified(some, "s", "id", 25).groupBy("s").count().where("count = 25").count() == 3
    assert scoring.placed_once(found.where("region = 7"), marks.where("mark = 0").select(*keys, "x0", "y0", "x1", "y1"), keys).first().right
    assert scoring.page_max(regions.selectExpr("1L AS doc_id", "confidence"), spark.createDataFrame([(1, "y"), (2, "n")], "doc_id long, label string"), ["doc_id"], "confidence").orderBy("doc_id").collect()[1].confidence == 0


def test_small_columns(spark):
    one = spark.range(1)
    get = lambda *c: tuple(one.select(*c).first())
    assert get(images.long_side(F.lit(1000), F.lit(100), 256), images.rgb_grey(F.lit(255), F.lit(0), F.lit(0)), images.cmyk_grey(*map(F.lit, (0, 0, 0, 255)))) == (1280, 76, 0)
    assert get(*(images.unpacked(F.lit(0b11100100), F.lit(k), 2) for k in range(4))) == (255, 170, 85, 0)
    assert tuple(get(images.turn_of(*map(F.lit, (0.0, 9.0, -9.0, 0.0))))[0]) == (True, True, False)
    lo, hi = geometry.cubic_range(*(F.lit(float(v)) for v in (0, 1, 1, 0)))
    assert get(lo, hi, geometry.dist(*map(F.lit, (0, 0, 3, 4)))) == (0, 0.75, 5)
    assert pdf.predicted(zlib.decompress(zlib.compress(bytes([1, 10, 10, 2, 0, 0]))), {"Predictor": 15, "Columns": 2}) == bytes([10, 20, 10, 20])


def test_lists_of_files_and_thumbnail_files(spark, tmp_path):
    from pagewright.sinks import thumbnails
    from pagewright.streaming import ingest

    (tmp_path / "a.pdf").write_bytes(page("q 80 0 0 40 10 700 cm /A Do Q"))
    (tmp_path / "list.txt").write_text(f"  {tmp_path}/a.pdf \n\n{tmp_path}/none.pdf\n")
    got = ingest.listed(spark, str(tmp_path / "list.txt"))
    assert sorted((r.path.rsplit("/", 1)[1], r.error, r.content is None) for r in got.collect()) == [("a.pdf", None, False), ("none.pdf", "missing", True)]
    assert sorted(r.status for r in pdf.scan(got).where("kind = 'page' OR kind IS NULL").collect()) == ["not_pdf", "ok"]
    assert thumbnails.write_pgm(pixels.thumbs(got), str(tmp_path / "out")) == 1
    (name,) = (tmp_path / "out").iterdir()
    assert name.name.endswith("_4.pgm") and name.read_bytes() == b"P5\n8 4\n255\n" + b"\x00\xff" * 16


def _jpeg(planes, factors, restart=0, adobe=None):
    """A plain coder: quantisers of 1, codes of nine bits; planes are of the size of whole units."""
    zig, out = jpeg.zigzag(), bytearray(b"\xff\xd8")
    part = lambda mark, body: out.extend(bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body)
    part(0xDB, b"\0" + b"\1" * 64)
    for k in (0, 16):
        part(0xC4, bytes([k, 0, 0, 0, 0, 0, 0, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(255)))
    top_h, top_v = max(f[0] for f in factors), max(f[1] for f in factors)
    h, w = planes[0].shape[0] * top_v // factors[0][1], planes[0].shape[1] * top_h // factors[0][0]
    part(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([k + 1, f[0] << 4 | f[1], 0]) for k, f in enumerate(factors)))
    if restart:
        part(0xDD, restart.to_bytes(2, "big"))
    if adobe is not None:
        part(0xEE, b"Adobe" + bytes(6) + bytes([adobe]))
    part(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0")
    cos = jpeg._COS
    bits, last, n = "", [0] * len(planes), 0

    def value(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    units = [(y, x) for y in range(h // (8 * top_v)) for x in range(w // (8 * top_h))]
    for y, x in units:
        if restart and n and n % restart == 0:
            bits += "1" * (-len(bits) % 8)
            out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            bits, last = "", [0] * len(planes)
        n += 1
        for k, (p, (fh, fv)) in enumerate(zip(planes, factors)):
            for v in range(fv):
                for u in range(fh):
                    b = p[8 * (y * fv + v) :][:8, 8 * (x * fh + u) :][:, :8].astype(float) - 128
                    c = np.rint(cos.T @ b @ cos).astype(int).ravel()[zig].tolist()
                    size, code = value(c[0] - last[k])
                    last[k] = c[0]
                    bits += f"{size:09b}{code}"
                    run = 0
                    for a in c[1:]:
                        if not a:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + f"{0xF0:09b}", run - 16
                        size, code = value(a)
                        bits += f"{run << 4 | size:09b}{code}"
                        run = 0
                    if run:
                        bits += f"{0:09b}"
    bits += "1" * (-len(bits) % 8)
    return bytes(out) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_jpeg():
    assert jpeg.zigzag().tolist()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag().tolist()) == list(range(64))
    rng = np.random.default_rng(4)
    smooth = lambda h, w: np.clip(128 + 90 * np.sin(np.add.outer(np.arange(h) / 5, np.arange(w) / 7)) + rng.normal(0, 3, (h, w)), 0, 255).astype(np.uint8)
    g = smooth(32, 48)
    for restart in (0, 5):
        got = jpeg.decode(_jpeg([g], [(1, 1)], restart))
        assert got.shape == (32, 48, 1) and np.abs(got[..., 0].astype(int) - g).max() <= 2
    y, b, r = smooth(32, 32), smooth(16, 16), smooth(16, 16)
    got = jpeg.decode(_jpeg([y, b, r], [(2, 2), (1, 1), (1, 1)]))
    up = lambda p: p.repeat(2, 0).repeat(2, 1)
    assert np.abs(got.astype(int) - jpeg.rgb_of(np.stack([y, up(b), up(r)], 2))).max() <= 6
    assert jpeg.rgb_of(np.array([[[76, 85, 255], [255, 128, 128]]], np.uint8)).tolist() == [[[254, 0, 0], [255, 255, 255]]]
    four = jpeg.decode(_jpeg([y] * 4, [(1, 1)] * 4, adobe=0))
    assert four.shape == (32, 32, 4) and np.abs(four.astype(int) - y[..., None]).max() <= 2
    data = _jpeg([g], [(1, 1)])
    assert jpeg.decode(data[:-200]).shape == (32, 48, 1)  # cut short: the rest is grey
    for bad in (b"", data[:40], data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(Exception):
            jpeg.decode(bad)
    doc = pdf.Document(b"")
    grey = pixels.samples(doc, {"Width": 48, "Height": 32, "Filter": "DCTDecode", "Decode": [1, 0]}, data)
    assert np.abs(255 - grey.astype(int) - g).max() <= 2
