"""Incremental extraction: new page files in, manifest rows and bodies out.

Every micro-batch replaces its own part of the manifest and its own segment of the bodies, so a batch that is replayed after
a failure leaves the same rows. Before it begins, finished batches may be compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsatlas.operators.ingest import body_rows, fetch_articles, manifest_rows
from newsatlas.session import cut, prepare
from newsatlas.sources import body_store, html
from newsatlas.streaming import manifest_store


def read_manifest_log(spark: SparkSession, path: str) -> DataFrame:
    """Current manifest: the latest row of each link."""
    return manifest_store.read(spark, path)


def sync_stream(
    spark: SparkSession, pages: DataFrame, manifest_path: str, bodies_path: str, state_path: str, folder: str = "bodies",
    rules: html.ArticleRules = html.ArticleRules(),
):
    """Start a stream that extracts every page not yet extracted, works off what is there, and stops.

    ``pages`` is a streaming DataFrame with ``url`` and ``html``.
    """
    prepare(spark)

    def commit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch.where("url IS NOT NULL").dropDuplicates(["url"])
        links = cut(fresh.select(F.col("url").alias("link")))
        manifest_store.compact(session, manifest_path, batch_id)
        wanted = links.join(manifest_store.finished(session, manifest_path, links, batch_id), "link", "left_anti")
        articles = cut(fetch_articles(wanted, fresh, rules))
        body_store.append(body_rows(articles, folder), bodies_path, batch_id)
        manifest_store.append(manifest_rows(articles, folder), manifest_path, batch_id)

    return (
        pages.writeStream.foreachBatch(commit).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )
