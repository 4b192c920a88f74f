"""Small tables kept between the rounds of an iteration, in the folder that the cluster shares, and brought to rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series whose fits are broadcast; fits of more go to rows by a join that spreads each series over tasks.
BROADCAST_FITS = 10_000


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back, without its lineage.

    A plain local session without that setting gets a new folder; on a cluster it is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_fits(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``fits``, a kept table of one row a series; no task gets all rows of one."""
    fits = fits.withColumnRenamed("series_id", "_fit_of")
    mine = F.col("series_id").eqNullSafe(F.col("_fit_of"))
    if fits.count() <= BROADCAST_FITS:
        return rows.join(F.broadcast(fits), mine).drop("_fit_of")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_lot", F.pmod(F.monotonically_increasing_id(), F.lit(spread)))
    fits = fits.withColumn("_fit_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    return rows.join(fits, mine & (F.col("_lot") == F.col("_fit_lot"))).drop("_fit_of", "_lot", "_fit_lot")
