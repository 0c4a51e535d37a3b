"""Content by its digest: put once, verified by hashing again, damaged copies set aside, all by whole commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commits import Store, Version

BLOBS, ASIDE = "blobs", "quarantine"


def put(store: Store, batch: str, files: DataFrame) -> Version:
    """Store the content of files (content) that the store does not have, each once; what it has is not written again.

    Content that was set aside as damaged is put anew when it comes again.
    """
    own = files.where("content IS NOT NULL").select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    if BLOBS in store.tables():
        own = own.join(store.read(BLOBS).select("sha256"), "sha256", "left_anti")
    return store.commit(batch, append={BLOBS: own.select("sha256", F.length("content").cast("long").alias("bytes"), "content")})


def verified(store: Store) -> DataFrame:
    """sha256, state of every blob: OK, or CORRUPTED where its content has another digest or size."""
    same = (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("bytes"))
    return store.read(BLOBS).select("sha256", F.when(F.coalesce(same, F.lit(False)), "OK").otherwise("CORRUPTED").alias("state"))


def set_aside(store: Store, batch: str) -> Version | None:
    """Move damaged blobs out of the store, in one commit; null if there are none. Nobody reads them afterwards."""
    found = store.find(batch)
    if found is not None:
        return found
    bad = verified(store).where("state = 'CORRUPTED'").select("sha256")
    if bad.isEmpty():
        return None
    base = store.version()
    rows = store.read(BLOBS, base.number)
    return store.commit(batch, replace={BLOBS: rows.join(bad, "sha256", "left_anti")}, append={ASIDE: rows.join(bad, "sha256", "left_semi")}, after=base.number)


def open_blob(store: Store, digests: DataFrame) -> DataFrame:
    """sha256, content for digests (sha256): null where the store has none, an error where it is damaged."""
    held = store.read(BLOBS)
    whole = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged: "), F.col("sha256"))).cast("binary"))
    return digests.select("sha256").distinct().join(held.select("sha256", whole.alias("content")), "sha256", "left")
