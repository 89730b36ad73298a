from colloquy.llm.html_text import main_text


def texts(spark, rows):
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in main_text(table).collect()}


def test_body_beside_cards_stays_and_recurring_cards_go(spark):
    cards = "<article><h3>Teaser one</h3></article><article><h3>Teaser two</h3></article>"
    rows = [(f"http://a.example/{i}", f"<body><div>Top of house</div>Loose line<div id=body><p>Story {i}</p><p>goes on {i}</p></div>{cards}<div>All rights</div></body>") for i in range(12)]
    assert texts(spark, rows) == {i: f"Story {i}\ngoes on {i}" for i in range(12)}


def test_text_beside_an_article_stays_unless_it_recurs(spark):
    rows = [(f"http://b.example/{i}", f"<div>Top of house</div><p>Lead {i}</p><article><div>Follow us</div><p>Same line</p><p>Story {i}</p></article><p>After {i}</p><nav>m{i}</nav>") for i in range(12)]
    assert texts(spark, rows) == {i: f"Lead {i}\nSame line\nStory {i}\nAfter {i}" for i in range(12)}


def test_one_article_with_many_surroundings_keeps_its_boxes(spark):
    rows = [(f"http://c.example/{i}", f"<div>Top</div><article><div>Box of the story</div><p>Story</p></article><p>Note {i}</p>") for i in range(12)]
    assert texts(spark, rows) == {i: f"Box of the story\nStory\nNote {i}" for i in range(12)}
