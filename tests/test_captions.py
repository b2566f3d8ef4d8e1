from pyspark.sql import functions as F

from millrace.functions import captions
from millrace.operators import layout, windows


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_templates_and_speech(spark):
    assert one(spark, "a {{X}} {{Y}} {{X}}!", lambda v: captions.substitute(v, {"X": "1"})) == "a 1 {{Y}} 1!"
    assert one(spark, "GPU and GPUs, A-GPU", lambda v: captions.spoken(v, {"GPU": "gee $1", "GPUs": "gees"})) == "gee $1 and gees, A-GPU"


def test_sentences_and_cues(spark):
    assert one(spark, " One. Two? three! [Four] 5.5 is. x ", captions.sentences) == ["One.", "Two? three!", "[Four] 5.5 is. x"]
    text = "aaaa bbbb cccc dddd eeee ffff gggg hhhh"
    assert one(spark, text, lambda v: windows.caption_chunks(v, captions.cue_width(v, 20, 0))) == ["aaaa bbbb cccc dddd", "eeee ffff gggg hhhh"]
    assert spark.range(1).select(captions.cuts(F.array(F.lit("aa"), F.lit("b"), F.lit("c")), F.lit(10))).first()[0] == [5, 8, 10]


def test_times_and_lines(spark):
    assert spark.range(1).select(captions.srt_time(F.lit(3661.0425))).first()[0] == "01:01:01,042"
    assert one(spark, "abcdefg", lambda v: captions.columns_of(v, 3)) == ["abc", "def", "g"] and one(spark, "", lambda v: captions.columns_of(v, 3)) == [""]
    assert one(spark, "Long sentence here. Rest", captions.tidy) == "Long sentence here." and one(spark, "A. much longer rest\n\n\nof it ", captions.tidy) == "A. much longer rest\nof it ..."


def test_random_windows(spark):
    entries = spark.createDataFrame([("a", i, f"p{i}", 100) for i in range(4)] + [("b", 0, "q", 5)], "source string, ord int, path string, n_tokens long")
    rows = layout.random_windows(entries, 10, 1).collect()
    assert len(rows) == 6 and all(0 <= r.start < (90 if r.source == "a" else 1) for r in rows) and sorted(rows) == sorted(layout.random_windows(entries, 10, 1).collect())
