"""Audits over a stream: threat scores row by row, rates by window, and whole audits per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapwing.operators.threat import threat_report
from lapwing.params import Params
from lapwing.plans.audit import audit
from lapwing.session import scope


def threat_stream(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """Threat columns of streaming docs; no state is kept."""
    return threat_report(docs, p)


def abort_rates(docs: DataFrame, window: str = "1 hour", late: str = "1 day", time: str = "submitted_at", p: Params | None = None) -> DataFrame:
    """Documents and aborted ones by window of event time; rows later than the watermark are left out."""
    scored = threat_report(docs.withWatermark(time, late), p)
    return scored.groupBy(F.window(time, window)).agg(F.count("*").alias("docs"), F.count_if("aborted").alias("aborted")).select(F.col("window.start").alias("window_start"), "docs", "aborted")


def audit_stream(docs: DataFrame, registry: DataFrame, sink: Callable[[dict[str, DataFrame], int], None], checkpoint: str, p: Params | None = None, once: bool = True) -> StreamingQuery:
    """A whole audit of every micro-batch; a document's first delivery in the batch counts."""

    def run(batch: DataFrame, epoch: int) -> None:
        with scope(batch.sparkSession):
            sink(audit(batch.dropDuplicates(["doc_id"]), registry, None, p), epoch)

    writer = docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
