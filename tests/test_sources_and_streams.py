import pytest
from pyspark.sql import functions as F

from colloquy.operators import memory
from colloquy.sources import files
from colloquy.streaming.memory import promote_stream


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n[1]\n{broken\n{"a": 2, "b": "é"}\n', encoding="utf-8")
    got = files.read_json_lenient(spark, str(path), "a int, b string", numbered=True).orderBy("source_line").collect()
    assert [(r["source_line"], r["a"], r["b"]) for r in got] == [(1, 1, "x"), (5, 2, "é")]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_json_strict(spark, str(path), "a int, b string").collect()
    assert files.count_lines(spark, str(path)) == 4
    files.write_json(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "out"))
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*")) == '{"t":"é"}\n'


def test_csv_and_listing(spark, tmp_path):
    (tmp_path / "m.csv").write_text("text,utt_id,style_id\nhi,u1,3\n")
    assert files.read_csv_required(spark, str(tmp_path / "m.csv"), "utt_id string, style_id int").first()["style_id"] == 3
    with pytest.raises(ValueError, match="speaker_id"):
        files.read_csv_required(spark, str(tmp_path / "m.csv"), "speaker_id int")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.WAV").write_bytes(b"x")
    (tmp_path / "d" / "two.txt").write_bytes(b"x")
    assert [r["stem"] for r in files.list_files(spark, str(tmp_path / "d"), [".wav"]).collect()] == ["one"]


def test_stream_promotes_as_the_batch_does(spark, tmp_path):
    rows = [(s, f"k{i % 3}", i, ("fact", "promise", "other")[i % 3], str(i // 4 % 2), (i % 5) / 4, (i % 7) / 6, (i % 3) / 2) for s in (1, 2) for i in range(24)]
    kind = "session_id long, key string, seq long, kind string, value string, confidence double, impact double, emotion double"
    frame = spark.createDataFrame(rows, kind)
    for part in range(3):  # three batches in order
        frame.filter(F.floor(F.col("seq") / 8) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = promote_stream(stream).writeStream.format("memory").queryName("promoted").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
    try:
        query.processAllAvailable()
        got = {(r["session_id"], r["seq"]): (round(r["score"], 9), r["promoted"], r["novelty"]) for r in spark.sql("SELECT * FROM promoted").collect()}
    finally:
        query.stop()
    want = {(r["session_id"], r["seq"]): (round(r["score"], 9), r["promoted"], r["novelty"]) for r in memory.promote(frame).collect()}
    assert got == want and len(got) == 48
