"""Reading raw files, and what decides which of them are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What may be uploaded.
EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "bmp", "tiff"]
MIME_TYPES = ["application/pdf", "image/png", "image/jpeg", "image/jpg"]
LARGEST = 20 * 1024 * 1024


def may_be_read(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of files with an allowed extension below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(may_be_read(F.col("path")))


def upload_filter(files: DataFrame) -> DataFrame:
    """(doc_id, accepted, reason): type first, then size."""
    reason = F.when(~F.col("mime").isin(MIME_TYPES), "type").when(F.col("size") > LARGEST, "size")
    return files.select("doc_id", reason.isNull().alias("accepted"), reason.alias("reason"))


def safe_name(path: Column) -> Column:
    """The last part of a path without parent marks and separators."""
    return F.replace(F.replace(F.try_element_at(F.split(path, "/"), F.lit(-1)), F.lit(".."), F.lit("")), F.lit("\\"), F.lit(""))


def is_word_file(path: Column, content: Column) -> Column:
    """By extension, the OLE signature, or a ZIP that names word/document.xml."""
    zipped = (F.substring(content, 1, 4) == F.lit(bytes.fromhex("504B0304"))) & F.decode(content, "ISO-8859-1").contains("word/document.xml")
    return F.lower(path).rlike(r"\.docx?$") | (F.substring(content, 1, 8) == F.lit(bytes.fromhex("D0CF11E0A1B11AE1"))) | zipped


def content_key(content: Column, filename: Column) -> Column:
    return F.sha2(F.concat(content.cast("binary"), filename.cast("binary")), 256)


def first_by_content(files: DataFrame) -> DataFrame:
    """(doc_id, content_key): one document of each content and name."""
    return files.withColumn("content_key", content_key(F.col("text"), F.col("filename"))).groupBy("content_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_key")


def not_processed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose content key is not in the processed table."""
    return files.join(processed.select("content_key"), "content_key", "left_anti")


def flush_processed(spark: SparkSession, path: str) -> int:
    """Empty the processed table in one step; returns how many keys it held."""
    table = spark.read.parquet(path)
    n = table.count()
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
    return n
