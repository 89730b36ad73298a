from colloquy.llm.html_text import Page, main_text

NONE = frozenset()


def text(html):
    return Page(html).text(NONE, NONE)


def test_article_without_what_names_itself():
    html = """<html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header>Site</header><nav><a>m</a></nav>
    <div class="content"><article><header><h1>Big &amp; small</h1><span>by x</span></header><p>A&nbsp; b<br>c<p>D <b>e<p>f</p>g
    <div class="ad">buy</div><form><p>q</p></form><ul><li>one<li>two</ul><section id="comments"><p>no</p></section><script>var a="</p>";</script></article></div>
    <aside>s</aside><div role="complementary">r</div><footer>Foot</footer></body></html>"""
    assert text(html) == "Big & small\nA b c\nD e\nf\ng\none\ntwo"


def test_broken_markup():
    assert text("") == ""
    assert text("plain &lt;b&gt; text < 3 &copy; &am") == "plain <b> text < 3 © &am"
    assert text("<p>a<!-- <p>x --><p>b<p class='x") == "a\nb"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert text("</div></p><div>x</span></div>y") == "x\ny"
    assert text("<article><p>in</p>") == "in"
    assert text('<p title="a>b">x</p>') == "x"


def test_white_space_and_blocks():
    assert text("<p>  a \n\t b </p>\n\n<p> </p><div>c<div>d</div>e</div>") == "a b\nc\nd\ne"


def test_deep_nesting_does_not_fail():
    assert text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_goes_paragraphs_stay(spark):
    rows = []
    for i in range(12):
        body = f"<div id=top>Welcome to our site</div><article><div>Follow us today</div><p>Same opening line</p><p>Story {i}</p></article><div>All rights of the house</div>"
        rows.append((i, f"https://User@News.Example.com:80/{i}", body))
    for i in range(12, 20):
        rows.append((i, f"http://plain.example.org/{i}", f"<div>Home Contact</div><div>Own text {i} <p>more {i}</p></div>"))
    rows += [(20, None, None), (21, "junk", ""), (22, "https://news.example.com/0", rows[0][2]), (22, "https://news.example.com/0", rows[0][2])]
    table = pages(spark, rows).selectExpr("*", "'clash' AS text", "7 AS host")
    got = main_text(table).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[3] == "Same opening line\nStory 3" and by_id[22] == "Same opening line\nStory 0"
    assert by_id[15] == "Own text 15\nmore 15"
    assert by_id[20] == by_id[21] == ""
    shuffled = {r["page_id"]: r["text"] for r in main_text(table, broadcast_subtrees=0).collect()}
    assert shuffled == by_id
    assert main_text(table.limit(0)).count() == 0


def test_copies_of_one_page_make_no_template(spark):
    one = "<div><div>Lead</div><p>Only story</p></div>"
    got = main_text(pages(spark, [(i, f"http://a.b/{i}", one) for i in range(30)])).collect()
    assert {r["text"] for r in got} == {"Lead\nOnly story"}


def test_text_that_only_sounds_like_template_stays():
    html = """<article><h1>T</h1><section id="related-work"><p>Others did</p></section><p class="social">On networks</p><div class="search-results">Found</div>
    <table class="comments-table"><tr><td>1</td></tr></table><div class="menu-item-desc"><p>Soup</p></div><div class="share">Tweet</div><section class="comments"><p>first!</p></section></article>"""
    assert text(html) == "T\nOthers did\nOn networks\nFound\n1\nSoup"


def test_subtrees_without_telling_names_go_by_their_hash(spark):
    """Generated sites: each has boxes of its own on all its pages, none of which bears a name."""
    rows, want, key = [], {}, 0
    for site in range(3):
        top, box = f"<div><span>Site {site} home</span><a>one</a></div>", f"<div><p>Read more on {site}</p></div>"
        for i in range(15):
            lines = [f"Story {site} {i}", *[f"Line {j} of {site} {i}" for j in range(4)]]
            body = "".join(f"<p>{x}</p>" for x in lines)
            rows.append((key, f"http://site{site}.org/{i}", f"<body>{top}<main>{body}{box}</main><div>(c) {site}</div></body>"))
            want[key], key = "\n".join(lines), key + 1
    got = {r["page_id"]: r["text"] for r in main_text(pages(spark, rows)).collect()}
    assert got == want and all(text(h) != want[i] for i, _, h in rows)


def test_subtree_counts_against_counting(spark):
    from colloquy.llm.html_text import template_subtrees

    parts = [f"<div>{c}</div>" for c in "abcdefg"]
    rows = [(i, f"http://h{i % 2}.org/{i}", "<body>" + "".join(p for j, p in enumerate(parts) if (i * 7 + j * j) % (j + 2) == 0) + f"<p>own {i}</p></body>") for i in range(60)]
    seen, total = {}, {}
    for _, url, html in rows:
        page, host = Page(html), url.split("/")[2]
        total.setdefault(host, set()).add(page.root.hash)
        for h, running, once in page.found():
            seen.setdefault((host, h, running), set()).add(once)
    want = {(k[0], k[1], k[2], len(v)) for k, v in seen.items() if len(v) >= 4 and len(v) > len(total[k[0]]) * (0.3 if k[2] else 0.005)}
    got = {(r["host"], r["hash"], r["running"], r["n"]) for r in template_subtrees(pages(spark, rows)).collect()}
    assert got == want and got
