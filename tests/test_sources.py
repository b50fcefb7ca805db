import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, textgrid

LONG = 'File type = "ooTextFile"\nObject class = "TextGrid"\nitem []:\n item [1]:\n class = "IntervalTier"\n name = "phones"\n xmin = 0\n xmax = 1\n intervals: size = 2\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "AA1"\n intervals [2]:\n xmin = 0.5\n xmax = 1\n text = "IH,say ""x"",S"\n'
SHORT = 'File type = "ooTextFile short"\n"TextGrid"\n0\n1\n<exists>\n1\n"IntervalTier"\n"phones"\n0\n1\n3\n0\n0.5\n"AA1"\n0.5\n1\n"IH,EH,s"\n'


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"utt_id": "a", "text": "café", "extra": {"k": "1"}}\n\n{"utt_id": "b", "odd": 1}\n', encoding="utf-8")
    got = files.read_manifest(spark, str(path), strict=False).collect()
    assert [(r.utt_id, r.text, r.extra) for r in got] == [("a", "café", {"k": "1"}), ("b", None, None)]
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(path))


def test_nbest_cache(spark, tmp_path):
    path = str(tmp_path / "nbest")
    rows = spark.createDataFrame([("u", 1, 2, "b", -2.0), ("u", 0, 1, 'a "q"', -1.5), ("v", 0, 3, "c", -0.5)], "utt_id string, pos int, hyp_id long, text string, acoustic double")
    files.write_nbest_cache(rows, path)
    files.write_nbest_cache(rows.withColumn("text", F.lit("new")), path, mode="append")  # both are there already
    got = {r.utt_id: [(h.pos, h.text, h.acoustic) for h in r.hyps] for r in files.read_nbest_cache(spark, path).collect()}
    assert got == {"u": [(0, 'a "q"', -1.5), (1, "b", -2.0)], "v": [(0, "c", -0.5)]}
    line = tmp_path / "one.jsonl"
    line.write_text("\n".join(json.dumps({"utt_id": "u", "hyps": [[t, -1.0]]}) for t in ("old", "last")))
    assert files.read_nbest_cache(spark, str(line)).first().hyps[0].text == "last"


def test_csv_keeps_words_and_nulls(spark, tmp_path):
    rows = [(1, "null", "nan"), (2, None, ""), (3, 'a "b", c', " x ")]
    files.write_csv(spark.createDataFrame(rows, "error_id long, ref_word string, hyp_word string"), str(tmp_path / "e"), one_file=True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "e"), "error_id long, ref_word string, hyp_word string").collect())) == rows


def test_sidecars_prompts_lines_summary(spark, tmp_path):
    df = spark.createDataFrame([("u", None, [("a", 0.0, 0.5, None)], "offline")], "utt_id string, hyp_text string, words array<struct<w:string,start:double,end:double,prob:double>>, condition string")
    files.write_sidecars(df, str(tmp_path / "s"))
    assert os.path.isdir(tmp_path / "s" / "condition=offline")
    r = files.read_sidecars(spark, str(tmp_path / "s")).first()
    assert r.hyp_text == "" and r.words[0].prob == 0.0
    (tmp_path / "p.txt").write_text('( x_1 "Author of it." )\nplain line\n\n')
    assert [r.sentence for r in files.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == ["Author of it.", "plain line"]
    assert files.read_text_lines(spark, str(tmp_path / "p.txt")).count() == 2
    files.write_summary(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert files.read_summary(spark, str(tmp_path / "j")).first().a == 1
    assert files.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |\n"
    assert files.first_present(["x", "text"], ["id", "text"]) == "text" and files.first_present(["x"], []) is None


def test_speaker_files(spark, tmp_path):
    (tmp_path / "ABA" / "transcript").mkdir(parents=True)
    (tmp_path / "ABA" / "transcript" / "a1.txt").write_text("Hello.\nThere.")
    assert [tuple(r) for r in files.speaker_files(spark, str(tmp_path), "transcript", "txt").collect()] == [("ABA", "a1", "Hello.\nThere.")]


def test_textgrids(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_bytes(LONG.encode("utf-16"))
    (tmp_path / "b.TextGrid").write_text(SHORT)
    (tmp_path / "c.TextGrid").write_bytes(LONG.replace("AA1", "é").encode("latin-1"))
    got = {os.path.basename(r.path): r.phones for r in textgrid.phone_annotations(textgrid.read_textgrids(spark, str(tmp_path))).collect()}
    assert [tuple(p) for p in got["a.TextGrid"]] == [(0.0, 0.5, "AA1", "AA1", ""), (0.5, 1.0, "IH", 'say "x"', "s")]
    assert [p.err_type for p in got["b.TextGrid"]] == ["", "s"]
    assert got["c.TextGrid"][0].canonical == "é"
    assert textgrid.parse('"IntervalTier"\n"x"\n0\n1\nmany\n') == [] and textgrid.parse("") == []


def test_results_archives_probing_and_heavy_columns(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([("u", 1.5, list(range(40)), {"a": "b"}, bytearray(b"x")), ("v", None, [1], None, None)], "utt_id string, wer double, many array<int>, few map<string,string>, raw binary")
    files.write_results(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet")).count() == 2
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out/csv"), "utt_id string, wer double").collect())) == [("u", 1.5), ("v", None)]
    light = {r.utt_id: r for r in files.without_heavy(rows).collect()}
    assert light["u"].many is None and light["u"].few == {"a": "b"} and light["v"].many == [1] and "raw" not in light["u"]
    got = files.probed(rows, {"id": ["id", "utt_id"], "text": ["sentence", "text"]})
    assert got.columns == ["id", "text"] and {r.id for r in got.collect()} == {"u", "v"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ABC/transcript/one.txt", "hello")
        z.writestr("ABC/wav/one.wav", "no")
    assert [(r.name, bytes(r.content)) for r in files.archive_files(spark, str(tmp_path), "txt").collect()] == [("ABC/transcript/one.txt", b"hello")]


def test_append_new(spark, tmp_path):
    from lectern.operators.results import append_new, of_speakers

    path = str(tmp_path / "r")
    a = spark.createDataFrame([("u", "x", 1), ("v", "x", 2)], "utt_id string, condition string, n int")
    append_new(a.limit(1), path, ["utt_id", "condition"])
    append_new(a, path, ["utt_id", "condition"])
    append_new(a, path, ["utt_id", "condition"])
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2]
    assert of_speakers(a, "utt_id", first=1).count() == 1 == of_speakers(a, "utt_id", ["v"]).count() and of_speakers(a, "utt_id", first=None).count() == 2
