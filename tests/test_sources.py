import gzip
import json

from pyspark.sql import functions as F

from qirtas.sources import readers, sinks
from qirtas.streaming import ingest
from qirtas.operators import makers


def test_readers(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 0 d1 1\n1\t0  d2 0\nbad line\n2 0 d3 x\n")
    assert sorted(map(tuple, readers.qrels(spark, str(tmp_path / "q.txt")).collect())) == [("1", "0", "d1", 1), ("1", "0", "d2", 0)]
    (tmp_path / "t.tsv").write_text("a\tone\tmore\nnotab\na\ttwo\nb\t\n")
    assert dict(map(tuple, readers.topics(spark, str(tmp_path / "t.tsv")).coalesce(1).collect())) == {"a": "two", "b": ""}
    (tmp_path / "c.tsv").write_text("1\tx\tt\nz\ty\n22\tw\n")
    keep = spark.createDataFrame([(22,)], "id long")
    assert sorted(r.id for r in readers.collection(spark, str(tmp_path / "c.tsv")).collect()) == [1, 22]
    assert [r.text for r in readers.collection(spark, str(tmp_path / "c.tsv"), keep).collect()] == ["w"]
    with gzip.open(tmp_path / "j.jsonl.gz", "wt") as f:
        f.write('{"docid": "a#1", "text": "x"}\n{"docid": "b#2", "text": "y"}\n')
    d = readers.keyed_json_lines(spark, str(tmp_path / "j.jsonl.gz"), "docid string, text string", "docid", spark.createDataFrame([("b#2",)], "docid string"))
    assert [tuple(r) for r in readers.article_of(d).collect()] == [("b#2", "y", "b")]
    (tmp_path / "s.tsv").write_text("query-id\tcorpus-id\tscore\nq\tp\t1\nq\tr\t0\n")
    assert [tuple(r) for r in readers.scored_pairs(spark, str(tmp_path / "s.tsv")).collect()] == [("q", "p", 1.0)]
    squad = {"data": [{"title": "T", "paragraphs": [{"context": "c d", "qas": [{"id": "1", "question": "q", "answers": [{"text": "d", "answer_start": 2}]}, {"id": "2", "question": "r", "answers": []}]}]}]}
    (tmp_path / "squad.json").write_text(json.dumps(squad))
    assert [tuple(r) for r in makers.squad_rows(readers.nested_articles(spark, str(tmp_path / "squad.json"))).collect()] == [("1", "T", "c d", "q", "d", 2)]


def test_parquet_round_trip(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("text"))
    sinks.parquet(df, str(tmp_path / "p"))
    assert readers.parquet_texts(spark, str(tmp_path / "p"), "text", "id").where("text = ''").count() == 5
    files = readers.parquet_files(spark, str(tmp_path / "p")).collect()
    assert sum(f.rows for f in files) == 10
    local = [str(p) for p in (tmp_path / "p").glob("*.parquet")]
    assert sum(f["rows"] for f in readers.footers(local)) == 10
    assert readers.files_for(readers.parquet_files(spark, str(tmp_path / "p")), 1).count() == 1
    sinks.split_by_source(spark.createDataFrame([("train", "a", 1), ("validation", "b", 2)], "split string, source string, x int"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train' and source = 'a'").count() == 1
    sinks.shards(spark.range(6).select(F.col("id").alias("pair_id"), (F.col("id") / 3).cast("int").alias("shard")), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).where("shard = 1").count() == 3
    sinks.json_lines(df, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "id long, text string").count() == 10
    sinks.write_small(str(tmp_path / "m.json"), {"n": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 1}


def test_streaming_deduplication(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "a", "s", "2024-01-01 00:00:00"), (2, "b", "s", "2024-01-01 01:00:00"), (3, "a", "s", "2024-01-02 00:00:00"), (4, None, "s", "2024-01-02 00:00:00")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "doc_id long, text string, source string, loaded_at string").withColumn("loaded_at", F.to_timestamp("loaded_at")).coalesce(1).write.mode("append").parquet(str(src))
    q = ingest.deduplicated(ingest.document_stream(spark, str(src))).writeStream.format("memory").queryName("dedup_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.text for r in spark.table("dedup_out").collect()]
    assert sorted(map(str, got)) == ["None", "a", "b"]
