import random

import corpus_pipeline
from colloquy.llm.toxicity import crc_held_out


def tables(spark, path):
    rng = random.Random(3)
    words = ["lo", "mira", "tesu", "noka", "rami", "sulo", "kate", "nomi"]
    make = lambda n: " ".join(rng.choices(words, k=n)) + f" {rng.random()}"
    docs = [(i, make(rng.randint(5, 60)) + "\nsite footer line", "en", f"s{i % 2}") for i in range(200)]
    docs += [(200 + i, make(30) + " stupid moron\nmore", "en", "s0") for i in range(80)]
    long = make(120)
    docs += [(300 + i, long + f"\nsite footer line\nend{i}", "en", "s1") for i in range(4)]
    docs += [(400, None, None, None), (401, "", "en", "s0"), (402, docs[0][1], "en", "s0"), (402, docs[0][1], "en", "s0")]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 300)) for i in range(280)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return frame


def test_stages_in_order(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    mild = stage["toxicity"](spark, docs, str(tmp_path)).cache()
    kept = {r["doc_id"] for r in mild.collect()}
    assert mild.columns == columns and kept >= {400, 401, 402} and len(kept & set(range(200))) >= 195
    assert len([i for i in range(200, 280) if i in kept]) <= 4 and any(crc_held_out(i) for i in range(200, 280))
    clean = stage["line_dedup"](spark, mild, str(tmp_path)).cache()
    assert clean.columns == columns and clean.count() == mild.count()
    assert clean.filter("text LIKE '%site footer%'").count() == 0 and clean.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    single = stage["ngram_jaccard"](spark, clean, str(tmp_path)).cache()
    ids = [r["doc_id"] for r in single.select("doc_id").collect()]
    assert [i for i in ids if 300 <= i < 304] == [300] and len(ids) == len(set(ids)) and {400, 401} <= set(ids) and 402 not in ids
    mixed = stage["mixing"](spark, single, str(tmp_path)).cache()
    assert mixed.columns == columns and 0 < mixed.count()
    packed = stage["packing"](spark, mixed, str(tmp_path)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) == mixed.count()


def test_run(spark, tmp_path):
    """All stages together give what they give one by one, with no document lost or doubled between them."""
    docs = tables(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    want = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_columns_of_clashing_names_come_back(spark, tmp_path):
    tables(spark, str(tmp_path))
    taken = ["score", "size", "target", "copies", "taken", "source_size", "n_lines", "n_dropped", "_gone", "_again", "_row", "_copy", "_n_chars", "_drop", "_key", "_epochs", "_host", "node", "label"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in taken])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in taken)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_very_long_text_passes_every_stage(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    long = " ".join(f"lo{i % 977} mira{i % 1009}" for i in range(120_000))
    docs = docs.union(spark.createDataFrame([(900, long, "en", "s9", len(long))], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.filter(f"doc_id = 900 AND length(text) = {len(long)}").count() >= 1
