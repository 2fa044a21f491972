"""Inputs beside Parquet tables: sheets as CSV, JSON configuration, callback records, raw page bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet's rows with the names of its first line; missing cells are ''. [SC-08, SC-09]"""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as one row. [SC-11]"""
    return spark.read.json(path, multiLine=True)


#: The file that names a control table's version.
_POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(conf)


def write_control(df: DataFrame, path: str) -> None:
    """A control table replaced as a whole: a new version is written beside the old, then a pointer file is renamed onto the old one. [SK-08, DM-08, DM-09]

    A reader sees the old version or the new one. Old versions stay until `drop_versions`.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, at, fs = _files(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(at, f"_{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    onto = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    onto[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fresh, jvm.org.apache.hadoop.fs.Path(at, _POINTER), onto)


def _current(spark: SparkSession, path: str) -> str:
    jvm, at, fs = _files(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(at, _POINTER))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_control(spark: SparkSession, path: str) -> DataFrame:
    """The version of a control table that its pointer names. [SK-08]"""
    return spark.read.parquet(f"{path}/{_current(spark, path)}")


def drop_versions(spark: SparkSession, path: str) -> None:
    """Remove the versions of a control table that its pointer doesn't name."""
    _, at, fs = _files(spark, path)
    now = _current(spark, path)
    for s in fs.listStatus(at):
        if s.getPath().getName() not in (_POINTER, now):
            fs.delete(s.getPath(), True)


def parsed_records(df: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """The valid records of JSON bodies: well-formed, with a name or an address. [SC-23, FL-12, PR-11]

    A body is an array of records; a malformed body has none.
    """
    items = F.from_json(F.col(body), T.ArrayType(schema), {"mode": "PERMISSIVE"})
    rows = df.select(*(c for c in df.columns if c != body), F.explode(items).alias("r")).select(*(c for c in df.columns if c != body), "r.*")
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return rows.where(given("name") | given("hp_url"))


def finished_items(jobs: DataFrame) -> DataFrame:
    """A job's rows once it is done, none before. [SC-24, SK-09]"""
    return jobs.select("id", "status", F.when(F.col("status") == "done", F.col("result_items")).alias("items"))


# Labels of character sets in documents.
CHARSETS = {"cp932": r"shift.?jis|sjis|cp932|windows-31j|ms_kanji", "euc_jp": r"euc.?jp|x-euc", "iso2022_jp": r"iso.?2022.?jp"}


def decode_bytes(raw: bytes | None, content_type: str | None) -> str:
    """A page's text by the character set its header or its first 2 KB name, else UTF-8; broken bytes become U+FFFD. [TX-05]"""
    import re

    raw = raw or b""
    head = re.search(r"charset=[\"']?([\w\-]+)", content_type or "", re.I)
    seen = head or re.search(r"charset=[\"']?([\w\-]+)", raw[:2000].decode("latin-1"), re.I)
    label = seen[1] if seen else ""
    codec = next((name for name, p in CHARSETS.items() if re.search(p, label, re.I)), "utf-8")
    return raw.decode(codec, "replace")


def decoded_pages(df: DataFrame, key: str, raw: str = "raw", content_type: str = "content_type", most_bytes: int | None = None) -> DataFrame:
    """(key, html) of raw page bytes; of longer pages the first `most_bytes` (the form reader takes 200,000, the plain one 500,000). [TX-05, SC-16, SC-17]"""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_bytes(r, c) for r, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=[key, "html"])

    body = F.col(raw) if most_bytes is None else F.substring(F.col(raw), 1, most_bytes)
    return df.select(key, body.alias("raw"), content_type).mapInArrow(run, f"`{key}` {kind}, html string")


def followed(hops: DataFrame, most: int = 5) -> DataFrame:
    """(url, final_url, hops, error): where each address leads by redirects and page refreshes. [SC-16, TX-11]

    hops: url (once) and location, null where a page is the end. After more than `most` hops, also round a circle, the error
    is 'too_many_redirects'; a location that wasn't fetched is the end. One join a hop, over the addresses still moving.
    """
    step = hops.where(F.col("location").isNotNull() & (F.col("location") != F.col("url"))).select(F.col("url").alias("_at"), F.col("location").alias("_next"))
    moving, done = hops.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops")), None
    for _ in range(most + 1):
        gone = moving.join(step, F.col("final_url") == F.col("_at"), "left")
        ended = gone.where("_next IS NULL").select("url", "final_url", "hops", F.lit(None).cast("string").alias("error"))
        done = ended if done is None else done.unionAll(ended)
        moving = gone.where("_next IS NOT NULL").select("url", F.col("_next").alias("final_url"), (F.col("hops") + 1).alias("hops"))
    return done.unionAll(moving.select("url", "final_url", "hops", F.lit("too_many_redirects").alias("error")))
