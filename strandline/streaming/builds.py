"""The watch cycle: new builds come as files, are captured, compared with their neighbours and committed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import history
from ..operators.commits import Store


def follow(found: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Add what a stream of functions brings to the store's history, batch by batch.

    found: a stream of rows with product, build, at, part, entry and the features of match.py. A batch has all
    functions of its builds (a file, a build). A batch that is delivered again is already committed, so that
    nothing is added twice; a build that comes late takes its place by its time, and only its product is
    folded anew. trigger: by default all that there is, then the end.
    """

    def capture(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            builds = rows.select("product", "build", "at").distinct()
            if not builds.isEmpty():
                history.add(store, f"{checkpoint} {number}", builds, rows.drop("at"))
        finally:
            rows.unpersist()

    return found.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
