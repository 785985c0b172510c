"""Hits of newly landed files, stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatelens.operators.io_regex import java_io, js_io, yaml_cron
from estatelens.operators.services import url_hits
from estatelens.schemas import FILES
from estatelens.sources.admission import service_scannable
from pyspark.sql import functions as F


def landing_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed Parquet files of source rows, as a stream; the batch size changes no result."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_service_hits(landed: DataFrame) -> DataFrame:
    """URL hits: the line form needs neither window nor state."""
    return url_hits(landed.filter(service_scannable(F.col("path"))))


def stream_io_hits(landed: DataFrame) -> DataFrame:
    """Input/output hits of the pattern families."""
    return js_io(landed).unionByName(java_io(landed)).unionByName(yaml_cron(landed))
