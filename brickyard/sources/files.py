"""File and job sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.sources import commits

TEXT_TYPES = ("txt", "md", "markdown", "html")
JOB_SCHEMA = "job_id string, kb_id string, user_id string, filename string, content_b64 string, mode string, config map<string,string>"
REGIONS, MAX_BYTES = ("HN", "DN", "HCM"), 50 * 1024 * 1024
#: A part file and, as first group, the folder of its extension that is the document.
PART = r"(?i)(/[^/]+\.([^./]+))/part-[^/]*\.\2$"


def decode_text(content: Column) -> Column:
    """UTF-8 with replacement marks for bad bytes."""
    return F.make_valid_utf8(content.cast("string"))


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): files of a known extension and size decoded, the others with a reason.

    A folder that has an extension and ``part-`` files of the same one, as Spark writes it, is one
    document: its size is that of all parts, and it gives a row a part, named in ``part``. Parts
    follow each other by name and are decoded one by one, so they have to end between characters.

    Lengths and names come from the file listing, so what is too long or unknown is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed, whole = F.col("_metadata.file_path"), lambda name: F.regexp_replace(name, PART, "$1")
    ext = lambda name: F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    last = lambda name: F.element_at(F.split(name, "/"), -1)
    known, fits = ext("document").isin(*TEXT_TYPES), F.col("n_bytes") <= max_bytes
    sizes = files.groupBy(whole("path").alias("document"), whole(listed).alias("listed")).agg(F.sum("length").alias("n_bytes"), F.count(F.lit(1)).alias("n_parts"))
    # parts that fit by themselves are left out by their folder; its name is of the listing that the driver holds
    too_long = [r.listed for r in sizes.filter(known & ~fits & (F.col("n_parts") > 1)).select("listed").collect()]
    read = files.filter(F.col("length") <= max_bytes).filter(ext(listed).isin(*TEXT_TYPES))
    if too_long:
        read = read.filter(~whole(listed).isin(too_long))
    named = read.withColumn("document", whole("path")).withColumn("part", F.when(F.col("document") != F.col("path"), last("path")))
    docs = named.select(F.md5(F.col("document").cast("binary")).alias("doc_id"), last("document").alias("filename"), ext("document").alias("ext"), "part", decode_text(F.col("content")).alias("text"))
    reason = F.when(~known, F.concat(F.lit("unsupported extension: "), ext("document"))).when(~fits, F.lit(f"file over {max_bytes} bytes"))
    return docs, sizes.withColumn("reason", reason).filter("reason IS NOT NULL").select(last("document").alias("filename"), ext("document").alias("ext"), "reason")


def rename_files(spark: SparkSession, path: str, ext: str) -> None:
    """Gives the part files of a folder another extension."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [s.getPath().getName() for s in fs.listStatus(folder)]:
        to = f"{name.split('.')[0]}.{ext}"
        if name.startswith("part-") and name != to:
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(folder, name), spark._jvm.org.apache.hadoop.fs.Path(folder, to))


def read_jobs(spark: SparkSession, path: str, stream: bool = True, per_trigger: int = 4) -> DataFrame:
    """Job envelopes with their decoded content."""
    reader = (spark.readStream.option("maxFilesPerTrigger", per_trigger) if stream else spark.read).schema(JOB_SCHEMA)
    return reader.json(path).withColumn("content", F.try_to_binary("content_b64", F.lit("base64")))


def route_jobs(jobs: DataFrame, kbs: DataFrame) -> DataFrame:
    """Adds route (standard, price, rejected) and reason. kbs: kb_id, price_extraction."""
    joined = jobs.join(kbs.select("kb_id", "price_extraction"), "kb_id", "left")
    price = F.coalesce("price_extraction", F.lit(False)) | F.col("mode").isin("price", "price_extraction")
    region = F.try_element_at("config", F.lit("region"))
    reason = F.when(F.col("price_extraction").isNull(), "unknown knowledge base").when(F.col("content").isNull(), "content is not base64").when(F.octet_length("content") > MAX_BYTES, "file over 50 MB").when(price & ~F.coalesce(region.isin(*REGIONS), F.lit(False)), "price job needs a region")
    return joined.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNotNull(), "rejected").when(price, "price").otherwise("standard"))


def write_chunks(chunks: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Appends by knowledge base; with ``documents``, replaces all rows of these keys, for ``commits.read``."""
    if documents is not None:
        commits.write(chunks.sparkSession, path, {"chunks": chunks}, documents)
    else:
        chunks.write.mode("append").partitionBy("kb_id").parquet(path)


def read_chunk_dump(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A dump as one JSON array a file, or, without ``multi_line``, as a row a line, which can be split."""
    return spark.read.option("multiLine", multi_line).schema("type string, content string, above string, below string").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
