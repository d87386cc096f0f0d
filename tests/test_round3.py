"""What round 3's findings were about, on small inputs."""

import re

import numpy as np
import pyarrow as pa
from pagewright.operators import boxes, grouped, layout, runs
from pagewright.sources import fixtures, pdf
from pyspark.sql import functions as F


def test_sides_of_rectangles_are_placed_whole(spark):
    rows = [(0, 1, 0, 5000, 100, 6004, 200, False, True, False, True), (0, 1, 1, 5000, 300, 6004, 305, True, False, False, True)]
    paths = spark.createDataFrame(rows, "doc_id long, page_n long, ord long, x0 long, y0 long, x1 long, y1 long, fill boolean, stroke boolean, white boolean, is_rect boolean")
    got = layout.rules_placed(layout.box_segments(paths, 10), 6000, 8000, 10)
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got.collect()) == [(5000, 100, 5000, 200), (5000, 100, 6004, 100), (5000, 200, 6004, 200), (5000, 302, 6000, 302), (6004, 100, 6004, 200)]


def _near(page, x0, y0, x1, y1, i):
    """The nearest fit letter by looking at all, as the SQL has it."""
    h, best = y1[i] - y0[i], None
    for j in range(len(x0)):
        hj = y1[j] - y0[j]
        if page[i] == page[j] and x0[j] > x0[i] and x1[i] - 0.25 * h <= x0[j] <= x1[i] + h and 0.4 * h <= hj <= 2.5 * h and min(y1[i], y1[j]) - max(y0[i], y0[j]) >= 0.5 * min(h, hj):
            best = min(best or (x0[j], j), (x0[j], j))
    return best and best[1]


def test_runs_look_past_four_hundred_letters():
    # 600 letters above each other start between a letter and the one that follows it
    n = 602
    x0, y0 = np.full(n, 12.0), np.arange(n) * 20.0 + 100
    x0[0], y0[0], x0[1], y0[1] = 0, 0, 13, 0
    got = grouped.chains(x0, y0, x0 + 10, y0 + 12)
    assert got[:2].tolist() == [2, 2] and set(got[2:].tolist()) == {1}


def test_pages_together_as_one_by_one():
    rng = np.random.default_rng(5)
    for unit in (1, 0.37):
        page = np.sort(rng.integers(0, 6, 300))
        x0, y0 = rng.integers(0, 400, 300) * unit, rng.integers(0, 300, 300) * unit
        x1, y1 = x0 + rng.integers(1, 30, 300) * unit, y0 + rng.integers(1, 30, 300) * unit
        alone = rng.random(300) < 0.1
        runs, roots = boxes.run_lengths(page, x0, y0, x1, y1), boxes.touching(page, x0, y0, x1, y1, alone, 2 * unit)
        nxt, taken = {}, set()
        for i in range(300):
            if (j := _near(page, x0, y0, x1, y1, i)) is not None and j not in taken:
                nxt[i] = j
                taken.add(j)
        for s in set(range(300)) - taken:
            run = [s]
            while run[-1] in nxt:
                run.append(nxt[run[-1]])
            assert {int(runs[k]) for k in run} == {len(run)}
        s = 2 * unit
        want = list(range(300))
        for _ in range(300):
            was = list(want)
            for a in range(300):
                near = (page == page[a]) & ~alone & ~alone[a] & (x0 <= x1[a] + s) & (x0[a] <= x1 + s) & (y0 <= y1[a] + s) & (y0[a] <= y1 + s)
                want[a] = min([want[a], *(want[b] for b in np.flatnonzero(near))])
            if was == want:
                break
        assert roots.tolist() == want


def test_pages_come_whole():
    pages = [0, 0, 1, 1, 1, 1, 1, 2, 3, 3]
    for size in range(1, 11):
        batches = [pa.RecordBatch.from_pydict({"p": pages[k : k + size]}) for k in range(0, 10, size)]
        got = [t["p"].to_pylist() for t in boxes.whole_pages(iter(batches), "p")]
        assert sum(got, []) == pages and all(not set(a) & set(b) for k, a in enumerate(got) for b in got[k + 1 :]) and all(got)


def test_strips_of_many_pages_in_one_call(spark):
    rows = [(p, k, 100, 100 + 50 * k, 200, 150 + 50 * k, 8, 4, False) for p in range(300) for k in range(1 + p % 3)]
    images = spark.createDataFrame(rows, "page_n long, image_idx long, x0 long, y0 long, x1 long, y1 long, px_w long, px_h long, mask boolean")
    merged = grouped.strip_merge(images)
    assert "FlatMapGroups" not in merged._jdf.queryExecution().toString()  # a page isn't a call of its own
    assert sorted((r.page_n, r.parts, r.y1) for r in merged.collect()) == [(p, 1 + p % 3, 150 + 50 * (p % 3)) for p in range(300)]


def test_documents_go_to_all_cores_and_are_read_once(spark, monkeypatch):
    from pagewright.plans import pdf_pages
    from pagewright.plans.grouped import documents_of

    docs = documents_of(spark, "/root/testdata/sf0.001", "'0 0 9 9 re f'")
    assert docs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    for query in (pdf_pages.pdf_words, pdf_pages.pdf_map, pdf_pages.pdf_text_json, pdf_pages.pdf_ocr_regions):
        below = re.findall(r"REPARTITION_BY_COL[^\n]*\n([^\n]*)", query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
        assert len(below) > 1 and len({re.sub(r"#\d+L?", "", x).lstrip(" :+-|") for x in below}) == 1  # the same, so Spark makes it once


def test_rows_of_a_page_come_back_from_their_packs(spark, monkeypatch):
    from pagewright.plans.grouped import documents_of

    docs = documents_of(spark, "/root/testdata/sf0.001", "concat('BT /F1 10 Tf 10 10 Td (abc) Tj ET 0 0 ', w, ' 9 re f')").union(spark.createDataFrame([(-1, b"no")], "doc_id long, content binary"))
    names = pdf.SCHEMA.names
    one, two = (sorted(map(repr, df.select(*names).collect())) for df in (pdf.scan(docs).fillna(0, ["page_n"]).withColumn("page_n", F.col("page_n").cast("long")), pdf.paged(docs)))
    assert one == two and len(pdf.scan(docs, "path").collect()) == docs.count() - 1


def test_texts_go_without_a_row_for_each_glyph(spark):
    from pagewright.plans import pages

    d = "/root/testdata/sf0.001"
    for name in ("words", "word_lines", "text_lines", "page_text", "ocr_features", "ocr_regions", "ocr_reasons", "page_map", "map_flag_counts", "unseen_counts"):
        assert "posexplode" not in getattr(pages, name)(spark, d)._jdf.queryExecution().toString(), name
    by_rows = layout.text_lines(layout.words(fixtures.primitives(spark, d, "glyphs").where("page_n < 40"))).select(*pages._LINE)
    assert sorted(map(repr, by_rows.collect())) == sorted(map(repr, pages.text_lines(spark, d).where("page_n < 40").collect()))


def test_words_of_slices(monkeypatch):
    monkeypatch.setattr(runs, "SLICE", 4)
    b = pa.RecordBatch.from_pydict({"page_n": [1, 2, 3, 4], "text": ["a bé", None, "😀x y", "z"]})
    got = []
    for part, codes, sizes in runs._slices(b):
        g = fixtures.glyph_arrays(np.asarray(part.column("page_n")), codes, sizes)
        w = runs.words(g)
        line, region, heads = runs.lines(w)
        got += zip(part.column("page_n").take(pa.array(w["page"])).to_pylist(), w["word"].tolist(), runs.strings(runs.shown(g)[w["ink"]], w["at"]).to_pylist(), line.tolist())
        got += runs.line_texts(runs.shown(g), w, heads).to_pylist()
    assert [x[:3] for x in got if isinstance(x, tuple)] == [(1, 1, "a"), (1, 2, "bé"), (3, 1, "😀x"), (3, 2, "y"), (4, 1, "z")]
    assert [x for x in got if isinstance(x, str)] == ["a bé", "😀x y", "z"]
