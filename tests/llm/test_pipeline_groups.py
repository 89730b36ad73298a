import pytest

import corpus_pipeline

A = "one two three four five six seven eight nine ten eleven twelve"
B = "lo mira tesu noka rami sulo kate nomi peru dali vota genu"
C = "und der die das ein eine mit von zu auf bei nach"
NEAR = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_rows_go_by_id_and_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", broadcast)
    rows = [
        (5, A), (5, B), (3, B),  # (5, A) is in no group
        (None, NEAR + " x"), (None, NEAR + " y"), (None, NEAR + " z"),  # a group of null ids alone
        (None, C), (7, C + "."), (7, C), (8, C.upper()),  # a group with null and repeated ids
        (9, B + " " + A), (9, B + " " + A), (9, ""), (9, ""), (None, None), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    found = corpus_pipeline.ngram_dedup(spark, docs, "")
    assert found.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
    near = [t for i, t in got if i is None and t and t.startswith(NEAR)]
    assert len(near) == 1
    rest = [x for x in got if x[1] not in near]
    assert rest == sorted([(5, A), (3, B), (7, C), (9, B + " " + A), (9, ""), (9, ""), (None, None), (None, None), (7, C + ".")], key=str)
