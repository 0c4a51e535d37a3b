"""The content store: once each, verified, damage set aside."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.operators import blobs
from strandline.operators.commits import Store


def test_blobs_are_put_once_and_damage_is_set_aside(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    files = lambda *data: spark.createDataFrame([(d,) for d in data], "content binary")
    sha = lambda d: hashlib.sha256(d).hexdigest()
    blobs.put(store, "a", files(b"one", b"two", b"one", None, b""))
    blobs.put(store, "b", files(b"two", b"three"))
    blobs.put(store, "b", files(b"never"))
    assert sorted(r["sha256"] for r in store.read("blobs").collect()) == sorted(map(sha, (b"one", b"two", b"three", b"")))
    assert {r["state"] for r in blobs.verified(store).collect()} == {"OK"} and blobs.set_aside(store, "none") is None
    # a part is written over with other bytes under the old digest
    part = store.version().tables["blobs"]["parts"][1]
    bad = store.read("blobs").where(F.col("sha256") == sha(b"three")).withColumn("content", F.lit(b"thrEE")).collect()
    spark.createDataFrame(bad, "sha256 string, bytes long, content binary").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/s/{part['folder']}")
    assert {r["sha256"]: r["state"] for r in blobs.verified(store).collect()}[sha(b"three")] == "CORRUPTED"
    asked = spark.createDataFrame([(sha(b"one"),), (sha(b"three"),)], "sha256 string")
    with pytest.raises(Exception, match="damaged"):
        blobs.open_blob(store, asked).collect()
    for _ in range(2):
        blobs.set_aside(store, "aside")
        assert [r["sha256"] for r in store.read("quarantine").collect()] == [sha(b"three")]
    assert {r["sha256"]: r["content"] and bytes(r["content"]) for r in blobs.open_blob(store, asked).collect()} == {sha(b"one"): b"one", sha(b"three"): None}
    blobs.put(store, "again", files(b"three"))
    assert {r["sha256"]: bytes(r["content"]) for r in blobs.open_blob(store, asked).collect()} == {sha(b"one"): b"one", sha(b"three"): b"three"}
