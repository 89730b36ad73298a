from colloquy.llm.fingerprints import edited_neighbours
from colloquy.llm.html_text import main_text
from colloquy.llm.line_dedup import drop_boilerplate
from colloquy.llm.mixing import mix


def docs(spark, extra):
    rows = [(i, f"own line {i}\nshared line\nlast {i}", f"s{i % 2}") for i in range(30)] + [(None, None, None), (31, "", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in extra])


def test_line_dedup(spark):
    extra = ["_drop", "_host", "_lines", "_clean", "__DROP"]
    got = drop_boilerplate(docs(spark, extra))
    assert got.columns == ["doc_id", "text", "source", *extra, "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == 32 and rows[3]["text"] == "own line 3\nlast 3" and rows[3]["n_dropped"] == 1 and all(rows[3][c] == f"{c}3" for c in extra)
    assert rows[None]["text"] is None and rows[None]["n_lines"] == 0 and drop_boilerplate(docs(spark, extra).limit(0)).count() == 0


def test_line_dedup_by_host_of_pages(spark):
    rows = [(i, f"story {i}\nAll rights reserved", "a.org") for i in range(20)] + [(20 + i, f"note {i}\nAll rights reserved", f"h{i}.org") for i in range(20)]
    got = drop_boilerplate(spark.createDataFrame(rows, "page_id long, body string, site string"), text="body", host="site").collect()
    assert all((r["n_dropped"] == 1) == (r["site"] == "a.org") for r in got)


def test_a_very_long_text_of_lines(spark):
    long = "\n".join(f"line {i % 5000}" for i in range(200_000))
    rows = [(i, f"x{i}\nfoot", "s") for i in range(10)] + [(99, long + "\nfoot", "s")]
    got = {r["doc_id"]: r for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[99]["text"] == long and got[99]["n_lines"] == 200_001


def test_mixing(spark):
    extra = ["_key", "_epochs", "_bucket", "_source", "_last_key", "_b", "__key"]
    got = mix(docs(spark, extra))
    assert got.columns == ["doc_id", "text", "source", *extra, "size", "source_size", "target", "copies", "taken"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == 32 and all(rows[7][c] == f"{c}7" for c in extra)
    plain = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in mix(docs(spark, [])).collect()}
    assert {i: (r["size"], r["target"], r["taken"]) for i, r in rows.items()} == plain


def test_main_text(spark):
    extra = ["_h", "_boxes", "_running", "_host", "_html", "_key"]
    table = spark.createDataFrame([(i, f"http://a.b/{i}", f"<article><p>Body {i}</p></article>") for i in range(8)], "page_id long, url string, html string")
    got = main_text(table.selectExpr("*", *[f"concat('{c}', page_id) AS {c}" for c in extra])).collect()
    assert all(r["text"] == f"Body {r['page_id']}" and all(r[c] == f"{c}{r['page_id']}" for c in extra) for r in got)


def test_fingerprints_of_named_documents(spark):
    rows = [(f"doc-{i:04d}", f"text number {i} " * (5 + i % 30)) for i in range(300)] + [(None, "no name"), ("doc-0007", "again")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    for per_bucket in (10, 1000):
        got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in edited_neighbours(table, rows_per_bucket=per_bucket).collect()}
        assert len(got) == 302
        by_number = edited_neighbours(spark.createDataFrame([(None if d is None else int(d[4:]), t) for d, t in rows], "doc_id long, text string")).collect()
        assert {(None if d is None else int(d[4:]), n): h for (d, n), h in got.items()} == {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in by_number}
