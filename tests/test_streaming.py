from millrace.streaming import ingest

SCHEMA = "doc_id long, text string"
GRAM = "a b c d e f g h i j k l m"


def test_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    known = spark.createDataFrame([(GRAM,)], "gram string")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    read = lambda: sorted(r.doc_id for r in spark.read.parquet(out).collect())
    put([(1, "x"), (2, ""), (3, f"so {GRAM} it is"), (4, None)])
    ingest.run(spark, src, out, mark, SCHEMA, known)
    assert read() == [1]
    ingest.run(spark, src, out, mark, SCHEMA, known)
    assert read() == [1]
    put([(5, "a b c d e f g h i j k l")])
    ingest.run(spark, src, out, mark, SCHEMA, known)
    assert read() == [1, 5]
