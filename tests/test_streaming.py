from maskwright.config import MaskingConfig
from maskwright.streaming import detect as streaming

from .conftest import SF


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(i, f"user card 4929963689861572 and row {i}" if i % 3 else "nothing") for i in range(30)]
    spark.createDataFrame(rows, "id long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    for name, made in (("masked", streaming.mask_stream(stream)), ("found", streaming.detect_stream(stream, config=MaskingConfig()))):
        query = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    masked = {r["id"]: r["text"] for r in spark.table("masked").collect()}
    assert masked == {i: t.replace("4929963689861572", "**** **** **** 1572") for i, t in rows}
    assert sorted(r["id"] for r in spark.table("found").collect()) == [i for i, _ in rows if i % 3]


def test_windowed_counts(spark):
    """What the batch detects, counted by hour, up to the watermark."""
    import datetime
    from collections import Counter

    from maskwright.operators import detect

    got = {(r["window_start"], r["type"]): r["n"] for r in streaming.counts_of_documents(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    start = datetime.datetime(2024, 1, 1)
    closed = start + datetime.timedelta(minutes=7 * docs.agg({"doc_id": "max"}).first()[0]) - datetime.timedelta(hours=2)
    want = Counter()
    for r in detect.detect(docs, "text", streaming.STREAM_CONFIG).collect():
        hour = (start + datetime.timedelta(minutes=7 * r["doc_id"])).replace(minute=0)
        if hour + datetime.timedelta(hours=1) <= closed:
            want[hour, r["type"]] += 1
    assert got == want and got
