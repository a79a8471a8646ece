"""Rolling statistics and anomaly flags on a stream.

A row window cannot run on a stream, and one state per city would put a city with most readings into
one task. So each micro-batch is joined to the rows its windows reach back to and goes through the
batch operator, which cuts long series into blocks. What is carried on is a table in buckets of
cities: the last rows of every city, and the rows that may still be preceded by late ones. A
micro-batch reads and rewrites only the buckets that have news: readings that arrived, or waiting rows
that no late one can precede any more.
"""

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiles import last_rows
from ..operators.rolling import rolling_anomalies
from ..plans.sizing import LONG_SERIES, discard, paths_in, read_text, write_text
from ..schema import CITY, READINGS, TIMESTAMP

BUCKETS = 64

_COLUMNS = READINGS.fieldNames()
_CARRIED = (
    "city string, timestamp timestamp_ntz, temperature double, season string, seq bigint, done boolean"
)
_ROLLED = (
    "city string, timestamp timestamp_ntz, temperature double, season string, seq bigint,"
    " rolling_mean double, rolling_std double, is_anomaly boolean"
)


def _ntz(moment) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


class RollingStream:
    """Rolling statistics of a stream of readings, kept under one shared `folder`.

    Readings are finished in the order of (timestamp, seq) once the newest timestamp is more than
    `delay` ahead of them. A reading that comes later than that, or without a timestamp, has no place
    any more; it is kept under `late`. A manifest per micro-batch names the folder of each bucket, its
    oldest waiting row and the newest timestamp. It is written last, and a repeated micro-batch starts
    from the manifest before its own and overwrites its own output.
    """

    def __init__(
        self,
        folder: str,
        delay: timedelta = timedelta(0),
        mean_rows: int = 30,
        std_rows: int = 7,
        k: float = 2,
        series_rows: int = LONG_SERIES,
        buckets: int = BUCKETS,
    ):
        self.folder = folder
        self.delay = delay
        self.reach = max(mean_rows, std_rows) - 1
        self.buckets = buckets
        # Micro-batches follow each other, so each may write over the scratch of the one before.
        self.options = dict(
            mean_rows=mean_rows,
            std_rows=std_rows,
            k=k,
            series_rows=series_rows,
            folder=f"{folder}/scratch",
        )

    def start(self, readings: DataFrame, **trigger):
        """Start the stream; returns the running query."""
        return (
            readings.select(*_COLUMNS)
            .writeStream.option("checkpointLocation", f"{self.folder}/checkpoint")
            .foreachBatch(self._step)
            .trigger(**trigger)
            .start()
        )

    def finish(self, spark: SparkSession) -> None:
        """After the end of the stream: finish the rows that were still waiting for late ones."""
        newest = self._committed(spark)
        if newest is not None:
            manifest = self._manifest(spark, newest)
            waiting = [b for b, own in manifest["buckets"].items() if own["oldest"]]
            self._write_rolled(self._carried(spark, manifest, waiting), f"last-{newest}")

    def rolled(self, spark: SparkSession) -> DataFrame:
        """Readings finished so far, with rolling statistics and flags.

        What `finish` wrote counts until the stream goes on: a later batch finishes those rows anew.
        """
        rolled = f"{self.folder}/rolled/{{[0-9]*,last-{self._committed(spark)}}}"
        return spark.read.schema(_ROLLED).parquet(rolled)

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(READINGS).parquet(f"{self.folder}/late/*")

    def _write_rolled(self, ready: DataFrame, name: str) -> None:
        rolled = rolling_anomalies(ready, **self.options).where(~F.col("done")).drop("done")
        rolled.write.mode("overwrite").parquet(f"{self.folder}/rolled/{name}")

    # --- manifests: the newest timestamp, and per bucket its folder and oldest waiting row

    def _committed(self, spark: SparkSession, before: int | None = None) -> int | None:
        found = paths_in(spark, f"{self.folder}/manifest/*.json")
        numbers = [int(path.split("/")[-1].removesuffix(".json")) for path in found]
        return max((n for n in numbers if before is None or n < before), default=None)

    def _manifest(self, spark: SparkSession, batch_id: int | None) -> dict:
        if batch_id is None:
            return {"newest": None, "buckets": {}}
        return json.loads(read_text(spark, f"{self.folder}/manifest/{batch_id}.json"))

    def _commit(self, spark: SparkSession, batch_id: int, manifest: dict) -> None:
        write_text(spark, f"{self.folder}/manifest/{batch_id}.json", json.dumps(manifest))

    def _carried(self, spark: SparkSession, manifest: dict, buckets) -> DataFrame:
        """Carried rows of some buckets."""
        known = [b for b in buckets if b in manifest["buckets"]]
        if not known:
            return spark.createDataFrame([], _CARRIED)
        paths = [f"{self._place(manifest['buckets'][b]['batch'])}/bucket={b}" for b in known]
        return spark.read.schema(_CARRIED).parquet(*paths)

    def _place(self, batch_id: int) -> str:
        return f"{self.folder}/carried/{batch_id}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(CITY), F.lit(self.buckets)).cast("int")

    def _step(self, arrived: DataFrame, batch_id: int) -> None:
        spark = arrived.sparkSession
        before = self._committed(spark, batch_id)
        manifest = self._manifest(spark, before)
        known = manifest["newest"] and datetime.fromisoformat(manifest["newest"])
        arrived = arrived.persist()
        try:
            time = F.col(TIMESTAMP)
            in_time = time.isNotNull()
            if known is not None:
                in_time = in_time & (time >= _ntz(known - self.delay))
            seen, late, touched = arrived.agg(
                F.max(TIMESTAMP),
                F.count_if(~in_time),
                F.collect_set(F.when(in_time, self._bucket())),
            ).first()
            newest = max((t for t in (known, seen) if t is not None), default=None)
            if late or before is None:
                arrived.where(~in_time).write.mode("overwrite").parquet(
                    f"{self.folder}/late/{batch_id}"
                )
            # Some buckets at most: their number is a parameter.
            touched = {str(b) for b in touched}
            for bucket, own in manifest["buckets"].items():
                oldest = own["oldest"] and datetime.fromisoformat(own["oldest"])
                if oldest is not None and oldest < newest - self.delay:
                    touched.add(bucket)
            self._advance(arrived.where(in_time), batch_id, manifest, sorted(touched), newest)
        finally:
            arrived.unpersist()
        self._discard_older(spark, before)

    def _advance(self, arrived: DataFrame, batch_id: int, manifest: dict, touched, newest) -> None:
        """Roll what is ready in the touched buckets, and carry their rows on."""
        spark = arrived.sparkSession
        time = F.col(TIMESTAMP)
        carried = self._carried(spark, manifest, touched)
        rows = carried.unionByName(arrived.withColumn("done", F.lit(False)))
        ended = F.lit(False) if newest is None else time < _ntz(newest - self.delay)
        ready = rows.where(F.col("done") | ended)
        self._write_rolled(ready, str(batch_id))
        tail = last_rows(ready, self.reach).withColumn("done", F.lit(True))
        waiting = rows.where(~F.col("done") & ~ended)
        place = self._place(batch_id)
        tail.unionByName(waiting).withColumn("bucket", self._bucket()).write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(place)
        rewritten = spark.read.schema(f"{_CARRIED}, bucket int").parquet(place)
        oldest = F.min(F.when(~F.col("done"), time)).cast("string").alias("oldest")
        buckets = dict(manifest["buckets"])
        for bucket in touched:
            buckets.pop(bucket, None)
        for row in rewritten.groupBy("bucket").agg(oldest).collect():
            buckets[str(row.bucket)] = {"batch": batch_id, "oldest": row.oldest}
        text = None if newest is None else newest.isoformat(sep=" ")
        self._commit(spark, batch_id, {"newest": text, "buckets": buckets})

    def _discard_older(self, spark: SparkSession, before: int | None) -> None:
        """Drop folders and manifests that a repeat of the last micro-batch would not read."""
        if before is None:
            return
        older = self._committed(spark, before)
        if older is None:
            return
        kept = {own["batch"] for own in self._manifest(spark, before)["buckets"].values()}
        old = {own["batch"] for own in self._manifest(spark, older)["buckets"].values()}
        now = self._manifest(spark, self._committed(spark))["buckets"].values()
        kept |= {own["batch"] for own in now}
        discard(spark, *[self._place(b) for b in old - kept], f"{self.folder}/manifest/{older}.json")
