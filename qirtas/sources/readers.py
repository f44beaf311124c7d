"""Readers of the formats that corpora and judgements come in. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qirtas.functions import ordering as O

BLANKS = r"(?U)\s+"


def parquet_texts(spark: SparkSession, path: str, text: str = "text", *others: str) -> DataFrame:
    """The text column (null as empty) and ``others``: only these are read."""
    return spark.read.parquet(path).select(*others, F.coalesce(text, F.lit("")).alias(text))


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes, rows``: the Parquet files below a folder; rows are counted from the footers."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    return d.select("_metadata.file_path", "_metadata.file_size").groupBy(F.col("file_path").alias("path"), F.col("file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))


def footers(paths: list[str]) -> list[dict]:
    """Rows, row groups and uncompressed bytes of local Parquet files, from their footers alone."""
    import pyarrow.parquet as pq

    out = []
    for p in paths:
        m = pq.ParquetFile(p).metadata
        out.append({"path": p, "rows": m.num_rows, "row_groups": m.num_row_groups, "bytes": sum(m.row_group(i).total_byte_size for i in range(m.num_row_groups))})
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzipped text, the codec by the file's suffix."""
    return spark.read.text(path)


def keyed_json_lines(spark: SparkSession, path: str, schema: str, key: str, keep: DataFrame | None = None) -> DataFrame:
    """JSON lines that begin with their key; with ``keep(key)`` the others are dropped before they are parsed."""
    d = lines(spark, path)
    if keep is not None:
        d = d.withColumn(key, F.regexp_extract("value", rf'^\{{\s*"{key}"\s*:\s*"([^"]*)"', 1)).join(keep.select(key), key, "left_semi")
    return d.select(F.from_json("value", schema).alias("j")).select("j.*")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid, q0, docid, rel`` separated by blanks, without a header: the first four fields of a line; lines of
    fewer fields or without a number in the fourth are dropped."""
    p = F.split(F.trim("value"), BLANKS)
    return lines(spark, path).where(F.size(p) >= 4).select(p[0].alias("qid"), p[1].alias("q0"), p[2].alias("docid"), p[3].try_cast("int").alias("rel")).where("rel is not null")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """``qid, query``: split at the first tab; lines without a tab are dropped, of one key the last line holds: the one
    that begins furthest on in the last file by name, however the files are split."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    d = lines(spark, path).select("value", at.alias("at")).where(F.col("value").contains("\t"))
    d = d.select(F.substring_index("value", "\t", 1).alias("qid"), F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1).alias("query"), "at")
    return d.groupBy("qid").agg(F.max_by("query", "at").alias("query"))


def collection(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """``id bigint, text`` of a tab-separated collection; only numeric ids, with ``keep(id)`` only these."""
    d = lines(spark, path).select(F.substring_index("value", "\t", 1).alias("k"), F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1).alias("text")).where(F.col("k").rlike(r"^\d{1,18}$"))
    d = d.select(F.col("k").cast("long").alias("id"), "text")
    return d if keep is None else d.join(keep.select("id"), "id", "left_semi")


def scored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``qid, pid, score`` of a tab-separated file with a header, whatever its column names; positive scores only."""
    d = spark.read.csv(path, sep="\t", header=True, schema="qid string, pid string, score double")
    return d.where("score > 0")


ARTICLES = "title string, paragraphs array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string, answer_start: int>>>>>>"


def nested_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a question-answering file: ``{"data": [{"title", "paragraphs": [...]}]}``."""
    return spark.read.json(path, schema=f"data array<struct<{ARTICLES.replace('title string', 'title: string').replace('paragraphs array', 'paragraphs: array')}>>", multiLine=True).select(F.explode("data").alias("a")).select("a.*")


def article_of(docs: DataFrame, docid: str = "docid") -> DataFrame:
    """``article``: the document id before its ``#``."""
    return docs.withColumn("article", F.substring_index(docid, "#", 1))


def files_for(files: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """Files in drawn order until they hold at least ``n`` rows."""
    d = files.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "path")))
    return O.global_sum(d, ["_h", "path"], F.col("rows").cast("long"), "before", 16).where(F.col("before") < n).drop("before", "_h")
