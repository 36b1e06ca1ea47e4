"""Open-lot state that grows with appended lines instead of being replayed.

    <root>/lines/generation=<n>/      the lines of an append, as they came
    <root>/lots/generation=<n>/       what became of their units (and of open units they touched)
    <root>/touched/generation=<n>/    groups (customer, item) whose earlier rows no longer hold
    <root>/done/                      one row per finished append, with the last date so far

First-in-first-out netting needs of the past only the units still open: they go before the new lines
as if they were sales. So an append reads the open rows of the groups with new cancellations, and
nothing of the others; new sales without cancellations open lots of their own. Groups that get a line
older than one they hold already are netted again from all their lines. An append writes new files only;
a row holds until a later generation touches its group, an open one by any touch, a closed one by a late line.

Rows and lines lie in PARTS folders by customer, so an append opens the folders of its customers.
Generations without their row in `done` are never read, and a repeated append replaces what a failed one left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsewise.functions.checks import require_columns
from lapsewise.operators.netting import KEYS, ORDER, lot_lifetimes
from lapsewise.session import delete_folder, materialise, part_of, replace_folder, scratch, shuffles_deleted, written

PARTS = 64
COLUMNS = ("customer_id", "stock_code", "invoice", "quantity", "price", "invoice_date", "row_seq")
KEPT = ("invoice_date", "row_seq")


def _part():
    return F.pmod(F.xxhash64("customer_id"), F.lit(PARTS)).cast("int")


class LotStore:
    """`append` lines as they arrive, in any order; read `lifetimes`, `open_lots` or `as_of` a day."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _done(self) -> list:
        if not self._exists("done"):
            return []
        return self.spark.read.parquet(f"{self.root}/done").orderBy("generation").collect()

    def _write(self, df: DataFrame, name: str, generation: int, by_part: bool = True) -> None:
        writer = df.withColumn("part", _part()).repartition("part").write if by_part else df.write
        writer = (writer.partitionBy("part") if by_part else writer).mode("overwrite").option("compression", "zstd")
        with shuffles_deleted(self.spark):
            writer.parquet(f"{self.root}/{name}/generation={generation}")

    def _read(self, name: str, generations: list[int], schema) -> DataFrame:
        found = None
        for g in generations:
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/generation={g}").withColumn("generation", F.lit(g))
            found = part if found is None else found.unionByName(part)
        return found

    def append(self, lines: DataFrame) -> int:
        """Net new lines against the open units; returns the number of the generation. Its own tables go when it is done."""
        require_columns(lines, COLUMNS, "lines")
        with scratch(self.spark):
            return self._append(lines)

    def _append(self, lines: DataFrame) -> int:
        done = self._done()
        generation = 1 + max((r.generation for r in done), default=0)
        for name in ("lines", "lots", "touched"):
            if self._exists(f"{name}/generation={generation}"):
                delete_folder(self.spark, f"{self.root}/{name}/generation={generation}")
        fresh = written(part_of(lines, lines.select(*COLUMNS).filter("quantity <> 0")))
        self._write(fresh, "lines", generation)
        parts = [r[0] for r in fresh.select(_part().alias("p")).distinct().collect()]
        before = [r.generation for r in done if r.rows]
        high = max((r.last_at for r in done if r.last_at), default=None)
        touched, netted = None, fresh
        if before:
            history = self._read("lines", before, self._schema(fresh)).filter(F.col("part").isin(parts)).select(*COLUMNS)
            late = materialise(self._late_groups(fresh, history, high))
            again = history.join(late, list(KEYS), "left_semi").unionByName(fresh.join(late, list(KEYS), "left_semi"))
            timely = fresh.join(late, list(KEYS), "left_anti")
            cancelled = materialise(timely.filter("quantity < 0").select(*KEYS).distinct())
            still = self.lifetimes(parts).filter("close_day is null").join(cancelled, list(KEYS), "left_semi")
            reopened = still.select(*KEYS, "invoice", F.col("units").alias("quantity"), "price", *KEPT)
            netted = again.unionByName(timely).unionByName(reopened)
            touched = cancelled.withColumn("whole", F.lit(False)).unionByName(late.withColumn("whole", F.lit(True)))
        # Written in between, so that the lines' shuffle is gone before the lots are dealt by part.
        self._write(materialise(lot_lifetimes(netted, keep=KEPT)), "lots", generation)
        if touched is not None:
            self._write(touched, "touched", generation)
        rows, last = fresh.agg(F.count(F.lit(1)), F.max("invoice_date")).first()
        last = max((x for x in (high, last) if x is not None), default=None)
        event = self.spark.createDataFrame([(generation, rows, last, touched is not None)], "generation bigint, rows bigint, last_at timestamp, touches boolean")
        event.coalesce(1).write.mode("append").parquet(f"{self.root}/done")
        return generation

    @staticmethod
    def _schema(fresh: DataFrame):
        return fresh.withColumn("part", F.lit(0)).schema

    @staticmethod
    def _late_groups(fresh: DataFrame, history: DataFrame, high) -> DataFrame:
        """Groups with a new line that is not behind all lines the group holds.

        Only lines up to the last date of all can be late, so the history is read for their groups alone.
        """
        at = F.struct(*ORDER)
        suspects = fresh.filter(F.col("invoice_date") <= F.lit(high)).groupBy(*KEYS).agg(F.min(at).alias("first"))
        last = history.join(suspects, list(KEYS), "left_semi").groupBy(*KEYS).agg(F.max(at).alias("last"))
        return suspects.join(last, list(KEYS)).filter("first < last").select(*KEYS)

    def lifetimes(self, parts: list[int] | None = None) -> DataFrame:
        """`lot_lifetimes` of all lines so far, with the sale's date and order."""
        done = [r for r in self._done() if r.rows]
        if not done:
            raise ValueError("no lines were appended yet")
        line = self.spark.read.parquet(f"{self.root}/lines/generation={done[0].generation}")
        lots = self.spark.createDataFrame([], "invoice string, open_day date, price double").schema
        keys = line.select(*KEYS).schema.fields
        schema = type(line.schema)([*keys, *lots.fields, *line.select(*KEPT).schema.fields])
        schema = schema.add("close_day", "date").add("units", "double").add("part", "integer")
        rows = self._read("lots", [r.generation for r in done], schema)
        marks = [r.generation for r in done if r.touches]
        if parts is not None:
            rows = rows.filter(F.col("part").isin(parts))
        if marks:
            touch = type(line.schema)(keys).add("whole", "boolean").add("part", "integer")
            touched = self._read("touched", marks, touch)
            if parts is not None:
                touched = touched.filter(F.col("part").isin(parts))
            latest = touched.groupBy(*KEYS).agg(F.max("generation").alias("_any"), F.max(F.when(F.col("whole"), F.col("generation"))).alias("_whole"))
            holds = F.col("generation") >= F.coalesce(F.when(F.col("close_day").isNull(), F.col("_any")).otherwise(F.col("_whole")), F.lit(0))
            rows = rows.join(latest, list(KEYS), "left").filter(holds).drop("_any", "_whole")
        return rows.drop("part", "generation")

    def as_of(self, day) -> DataFrame:
        """Units open before a day, from lines before it."""
        rows = self.lifetimes().filter((F.col("open_day") < F.lit(day)) & (F.col("close_day").isNull() | (F.col("close_day") >= F.lit(day))))
        return rows.groupBy(*KEYS, "invoice", "open_day", "price").agg(F.sum("units").alias("remaining_quantity"))

    def compact(self) -> None:
        """Write what holds as one generation behind the others, which are not read afterwards."""
        done = self._done()
        if len(done) < 2:
            return
        now = materialise(self.lifetimes())
        generation = max(r.generation for r in done) + 1
        schema = self._schema(self.spark.read.parquet(f"{self.root}/lines/generation={done[0].generation}").select(*COLUMNS))
        lines = materialise(self._read("lines", [r.generation for r in done if r.rows], schema).select(*COLUMNS))
        self._write(lines, "lines", generation)
        self._write(now, "lots", generation)
        last = max((r.last_at for r in done if r.last_at), default=None)
        event = self.spark.createDataFrame([(generation, lines.count(), last, False)], "generation bigint, rows bigint, last_at timestamp, touches boolean")
        fresh = f"{self.root}/done-{generation}"
        event.coalesce(1).write.mode("overwrite").parquet(fresh)
        replace_folder(self.spark, fresh, f"{self.root}/done")
        for r in done:
            for name in ("lines", "lots", "touched"):
                delete_folder(self.spark, f"{self.root}/{name}/generation={r.generation}")
