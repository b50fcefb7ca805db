from pyspark.sql import functions as F

from lectern.streaming.chunks import chunk_plan, emit_stream, emitted_words, real_time_factor

WORDS = [("a", 0.0, 0.5), ("b", 0.49, 0.9), ("c", 0.7, 1.2), ("d", 0.9, 1.1), ("e", 1.15, 1.3)]


def test_chunk_plan(spark):
    df = spark.createDataFrame([(700, 320, 100)], "n long, c long, l long")
    assert [(r.chunk, r.start_ms, r.end_ms) for r in chunk_plan(df, "n", "c", "l").orderBy("chunk").collect()] == [(0, 0, 320), (1, 220, 640), (2, 280, 700)]


def test_emission_of_a_batch(spark):
    df = spark.createDataFrame([(WORDS[::-1],)], "w array<struct<w:string,start:double,end:double>>")
    assert [x.w for x in df.select(emitted_words(F.col("w"))).first()[0]] == ["a", "b", "d", "e"]


def test_emission_by_chunks(spark):
    """A word comes with the first chunk that ends no earlier than the word; one that ends after the recording never comes."""
    words = [("late", 0.1, 0.9), ("a", 0.0, 0.2), ("b", 0.3, 0.5), ("beyond", 1.4, 1.7)]
    df = spark.createDataFrame([(words,)], "w array<struct<w:string,start:double,end:double>>")
    assert [x.w for x in df.select(emitted_words(F.col("w"), F.lit(320), F.lit(1500))).first()[0]] == ["a", "b"]
    assert [x.w for x in df.select(emitted_words(F.col("w"), F.lit(2000), F.lit(1500))).first()[0]] == ["a", "b"]
    assert [x.w for x in df.select(emitted_words(F.col("w"))).first()[0]] == ["a", "b", "beyond"]


def test_emission_of_a_stream_equals_that_of_a_batch(spark, tmp_path):
    schema = "utt_id string, win_end double, start double, end double, w string"
    for i, part in enumerate((WORDS[:2], WORDS[2:])):
        spark.createDataFrame([("u", 9.0, s, e, w) for w, s, e in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = emit_stream(stream, timeout_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert sorted(r.w for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "d", "e"]


def test_real_time_factor(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0)], "p double, d double")
    assert [r[0] for r in df.select(real_time_factor(F.col("p"), F.col("d"))).collect()] == [0.25, 0.0]
