"""Books from a folder that files arrive in, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.conversion import Options, convert, of_books, parsed_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def books(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """BOOK rows of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(path)
    return parsed_files(files.where(of_books(F.col("path"))))


def conversions(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options, dictionaries: dict | None = None) -> StreamingQuery:
    """Converts what arrives; each file once, also after a restart from the checkpoint."""
    made = convert(books(spark, path), options, dictionaries)
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
