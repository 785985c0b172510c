"""Streaming operators run to completion over the given tables.

There is no SQL twin of a stream as such; the results are those of the batch
operators, whose SQL is used where the rows are the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.source_code import IO_COLS, JAVA_SQL, JS_SQL, ORACLE as SOURCE, SERVICE_COLS, YAML_SQL, landed
from bindings.sql_hits import with_corpus
from bindings.text import URL_RE2
from estatelens.plans.corpus import corpus_projects, table
from estatelens.session import scratch_folder
from estatelens.operators.services import url_hits
from estatelens.operators.snapshots import SnapshotStore
from estatelens.streaming.hits import landing_stream, stream_io_hits
from estatelens.streaming.refresh import stream_refresh, trigger


def _landing_path(spark, sf) -> str:
    """Folder of the landed corpus."""
    return landed(spark, sf).inputFiles()[0].rsplit("/", 1)[0]


def _drain(spark, hits, columns, interval=None):
    """The stream's output as a Parquet table, after one pass over all that has landed; with an interval, after its first trigger."""
    out = scratch_folder(spark)
    found = hits.select(*columns)
    query = (
        found.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_folder(spark))
        .trigger(**trigger(interval))
        .start()
    )
    while not query.awaitTermination(1):
        # No batch is cut: without a limit per trigger the first one reads all that has landed, which may be nothing.
        if query.recentProgress or query.status["message"] == "Waiting for next trigger":
            query.stop()
    return spark.read.schema(found.schema).parquet(out)


def streamed_io(spark, sf):
    """Pattern families over the landing as a stream."""
    return _drain(spark, stream_io_hits(landing_stream(spark, _landing_path(spark, sf))), IO_COLS)


def streamed_page_urls(spark, sf, interval=None):
    """URL hits of pages read as a stream; R3: in batches of an interval."""
    schema = table(spark, sf, "pages").schema
    # As a pattern, the path may be a file as well as a folder of files.
    pages = spark.readStream.schema(schema).parquet(f"{sf}/[p]ages.parquet")
    files = pages.select(
        F.col("page_id").alias("project_id"), F.lit("pages/url.txt").alias("path"), F.concat(F.lit("see\n"), "url").alias("content")
    )
    return _drain(spark, url_hits(files), SERVICE_COLS, interval)


def streamed_refresh(spark, sf):
    """R2: the landing consumed by micro-batches; the snapshot they publish."""
    store = SnapshotStore(spark, scratch_folder(spark))
    landing = landing_stream(spark, _landing_path(spark, sf))
    query = stream_refresh(
        landing, lambda: corpus_projects(spark, sf), lambda: landed(spark, sf), store, scratch_folder(spark)
    )
    query.awaitTermination()
    return store.current("profiles").select(
        "project_id", "full_path", "commit_sha", F.size("abstract_inputs").cast("long").alias("n_inputs"),
        F.size("tables").cast("long").alias("n_tables"),
    )


QUERIES = {
    "stream_io_hits": streamed_io,
    "stream_page_urls": streamed_page_urls,
    "stream_page_urls_by_interval": lambda spark, sf: streamed_page_urls(spark, sf, "5m"),
    "stream_refresh_profiles": streamed_refresh,
}
_PAGE_URLS_SQL = f"""
SELECT page_id AS project_id, lower(regexp_extract(url, '{URL_RE2}', 2)) AS name, 'http_api' AS kind, 'pages/url.txt' AS path, 2 AS line FROM pages
WHERE regexp_matches(url, '{URL_RE2}')"""
ORACLE = {
    # The stream reads the landing before admission; the families' own paths are the same rules.
    "stream_io_hits": with_corpus(
        *[c.replace("FROM adm WHERE", "FROM files WHERE") for c in (JS_SQL, JAVA_SQL, YAML_SQL)]
    )
    + " SELECT * FROM js_rows UNION ALL SELECT * FROM java_rows UNION ALL SELECT * FROM yaml_rows",
    "stream_page_urls": _PAGE_URLS_SQL,
    "stream_page_urls_by_interval": _PAGE_URLS_SQL,
    "stream_refresh_profiles": SOURCE["profiles"].replace(
        """ SELECT p.project_id, p.full_path, p.branch, p.commit_sha, picked.purpose_summary, picked.purpose_summary_reason,
  coalesce(ins.n, 0) AS n_inputs, coalesce(outs.n, 0) AS n_outputs, coalesce(svc.n, 0) AS n_services, coalesce(tbl.n, 0) AS n_tables,
  coalesce(deg.n, 0) AS n_degraded, coalesce(ins.h, sha256('')) AS inputs_hash, coalesce(tbl.h, sha256('')) AS tables_hash""",
        " SELECT p.project_id, p.full_path, p.commit_sha, coalesce(ins.n, 0) AS n_inputs, coalesce(tbl.n, 0) AS n_tables",
    ),
}
