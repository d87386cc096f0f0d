"""Pages that a host repeats."""

from pagewright.llm import html


def test_repeated_pages_keep_their_main_box(spark):
    page = "<body><div class=menu1><a>Home</a></div><div class=note>Same box</div><div class=post><div class=head>T{0}</div>Some words of the text number {0}</div></body>"
    main = "<article><section>Part of the text number {0}</section><p>End {0}</p></article>"
    rows = [(k, "https://a.example/", page.format(k % 3)) for k in range(60)]
    rows += [(100 + k, "https://b.example/", f"<body class=x{k}>{main.format(k % 2)}</body>") for k in range(60)]  # distinct pages of two articles
    rows += [(200 + k, "https://c.example/", f"<body class=x{k}>{page.format(0)}</body>") for k in range(60)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"T{k % 3}\n\nSome words of the text number {k % 3}" in got[k] for k in range(60))
    assert all(got[100 + k] == f"Part of the text number {k % 2}\n\nEnd {k % 2}" for k in range(60))
    assert all("Some words of the text number 0" in got[200 + k] and "Same box" not in got[200 + k] for k in range(60))
