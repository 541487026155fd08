"""What the operators of this subpackage share: tables, folds, samples; stored tables are the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lines import spread
from ..storage import discard, shared_dir, stored

__all__ = ["HELD_OUT", "SAMPLE_BYTES", "bounded_sample", "discard", "fold", "labelled_sample", "sampled_texts", "shared_dir", "shuffle_partitions", "stored", "table"]
SAMPLE_BYTES = 48 << 20  # text that a classifier's sample may bring to the driver


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over at least as many partitions as there are cores; one of many splits is left as it is."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is the held-out fold. Null ids: fold 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


HELD_OUT = 2


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` different ids of df, the ones of smallest hash: a bounded, repeatable sample.

    Ids whose hash is above a share of the hash range are left out before the
    distinct, so that it doesn't shuffle every id; the share grows until it
    holds enough different ids or everything.
    """
    ids = df.select(F.col(id_col).alias("_sample_id")).where(F.col("_sample_id").isNotNull())
    hashed = ids.withColumn("_sample_hash", F.xxhash64("_sample_id"))
    share = min(1.0, 3 * rows / max(1, ids.count()))
    while True:
        near = hashed if share >= 1 else hashed.where(F.col("_sample_hash") <= -(1 << 63) + int(share * ((1 << 64) - 1)))
        found = near.distinct().orderBy("_sample_hash", "_sample_id").limit(rows).select("_sample_id").collect()
        if len(found) >= rows or share >= 1:
            return df.sparkSession.createDataFrame([(r[0],) for r in found], ids.schema)
        share = min(1.0, share * 8)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(_sample_id, _label) of at most sample_rows labelled documents outside the held-out fold.

    Repeated labels of a document count as their maximum; null labels and ids don't count.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = bounded_sample(known, "_id", sample_rows)
    return known.join(F.broadcast(chosen), F.col("_id") == F.col("_sample_id")).groupBy("_sample_id").agg(F.max("_label").alias("_label"))


def sampled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """[(id, label, text)] in the order of the id's hash, of the chosen (_sample_id, _label) with a text.

    A document counts once: of rows that share an id, the smallest text. Texts
    are taken whole, in that order, while all so far hold at most most_bytes;
    a text that doesn't fit is left out.
    """
    import xxhash

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    one = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_sample_id")).groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    kept = stored(one.withColumn("_size", F.octet_length("_text")), "sample")
    order = sorted(kept.select("_id", "_size").collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r["_id"])), str(r["_id"])))
    fits, total = [], 0
    for r in order:
        if total + r["_size"] <= most_bytes:
            total += r["_size"]
            fits.append((r["_id"],))
    wanted = docs.sparkSession.createDataFrame(fits, kept.select(F.col("_id").alias("_fits")).schema)
    texts = {r["_id"]: r for r in kept.join(F.broadcast(wanted), F.col("_id") == F.col("_fits")).collect()}
    discard(kept)
    return [(i, texts[i]["_label"], texts[i]["_text"]) for (i,) in fits]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
