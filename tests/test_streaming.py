import datetime

from findara.operators.lexical import LexicalIndex
from findara.streaming.incremental import score_new, score_stream
from findara.streaming.queries import windowed


def test_new_documents_are_scored_by_the_old_index(spark, tmp_path):
    old = spark.createDataFrame([(1, "gato perro"), (2, "perro casa")], "id long, text string")
    index = LexicalIndex.fit(old, "id", "text")
    queries = spark.createDataFrame([(9, "gato")], "query long, text string")
    new = spark.createDataFrame([(3, "gato gato"), (4, "nuevo")], "id long, text string")
    want = {(r["query"], r["id"]): r["similarity"] for r in score_new(new, index, queries, "id", "text").collect()}
    assert set(want) == {(9, 3)}
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, index, queries, "id", "text", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert {(r["query"], r["id"]): r["similarity"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_windows_on_a_table_and_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=m), "a", 1.5) for m in (0, 59, 60, 300)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    assert sorted(r["n"] for r in windowed(df).collect()) == [1, 1, 2]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed(stream).writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 2]  # the last window is still open
