"""Files in and out: raw documents, texts, JSON artifacts, bundles, and appends that never write a key twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import unknown_rows


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of raw files; content is only read where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_texts(spark: SparkSession, path: str, max_bytes: int = 20 << 20) -> DataFrame:
    """(path, text) of UTF-8 files; a larger file or one that isn't UTF-8 fails the read, nothing is left out."""
    files = read_documents(spark, path)
    large = F.raise_error(F.concat(F.lit("too large: "), "path")).cast("string")
    return files.select("path", F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8")).otherwise(large).alias("text"))


def read_json(spark: SparkSession, path: str, schema: str, max_bytes: int = 512 << 20) -> DataFrame:
    """Strictly typed JSON lines; a malformed record or a file that is too large fails the read."""
    if read_documents(spark, path).filter(F.col("length") > max_bytes).select("path").limit(1).count():
        raise ValueError(f"a file in {path} has more than {max_bytes} bytes")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_new(rows: DataFrame, path: str, key: str, content: str | None = None, buckets: int = 64) -> None:
    """Appends the rows whose key isn't stored yet, spread over a hash prefix of the key; safe to repeat.

    Only stored buckets that new keys fall in are read. ``content``: a column, such as a fingerprint, that rows of one key
    must agree in; ValueError where they don't, and nothing is written.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if content and rows.groupBy(key).agg(F.count_distinct(content).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"rows of one {key} contradict one another")
    new = rows.dropDuplicates([key])
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        stored = stored.filter(F.col("bucket").isin(touched))
        if content:
            theirs = stored.select(key, F.col(content).alias("_theirs"))
            if new.join(theirs, key).filter(~F.col(content).eqNullSafe(F.col("_theirs"))).limit(1).count():
                raise ValueError(f"a stored {key} has another {content}")
        new = unknown_rows(new, stored, key)
    new.write.mode("append").partitionBy("bucket").parquet(path)


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of a table that doesn't depend on their order or partitions."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    # equal rows count, so sums of two parts of the hash, in decimals that don't overflow
    parts = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{at}") for at in (1, 16, 31, 46)]
    r = df.agg(F.count("*").alias("n"), *parts).first()
    return r["n"], "-".join(str(r[f"p{at}"] or 0) for at in (1, 16, 31, 46))


def write_bundle(frames: dict[str, DataFrame], path: str) -> None:
    """Writes tables to a new folder, each in its own, and last ``manifest`` with the rows and digest of each.

    An existing folder is an error; a bundle without manifest isn't complete. Equal tables give equal manifests.
    """
    spark = next(iter(frames.values())).sparkSession
    rows = []
    for name, df in sorted(frames.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows.append((name, *digest(spark.read.parquet(f"{path}/{name}"))))
    spark.createDataFrame(rows, "name STRING, rows LONG, digest STRING").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(name, same): whether each table of a bundle is the one its manifest names."""
    wanted = spark.read.schema("name STRING, rows LONG, digest STRING").json(f"{path}/manifest").collect()
    return spark.createDataFrame([(r.name, digest(spark.read.parquet(f"{path}/{r.name}")) == (r.rows, r.digest)) for r in wanted], "name STRING, same BOOLEAN")
