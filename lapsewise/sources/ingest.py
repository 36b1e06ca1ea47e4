"""Sales lines gathered from files, each file exactly once.

    <root>/lines/batch=.../    the lines of one ingest
    <root>/files/batch=.../    its files: path, length, modification time
    <root>/log/                one commit per ingest (`commits`)

Running an ingest again adds only files that are not listed yet. Lines and list become visible with the commit, so an
ingest that fails, or is run twice at the same time, leaves nothing behind that is read: the later one sees the
commit of the other and starts again from the list. A listed file that changed since is refused, as its
earlier lines are in the table; the same lines under another name count as another file.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lapsewise.session import delete_folder
from lapsewise.sources.commits import CommitLog, Superseded
from lapsewise.sources.tables import load_sales_lines

FILE_SCHEMA = "source string, path string, length bigint, modified timestamp"
LINE_SCHEMA = (
    "invoice string, stock_code string, description string, quantity double, invoice_date timestamp, price double, "
    "customer_id double, country string, source_sheet string, "
    "row_seq struct<source: string, file: string, block: bigint, row: bigint>"
)


class File(NamedTuple):
    source: str
    path: str
    length: int
    modified: datetime


class LineTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{what}/batch={e['batch']}" for e in self.log.entries()]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lines(self) -> DataFrame:
        return self._read("lines", LINE_SCHEMA)

    def files(self) -> DataFrame:
        return self._read("files", FILE_SCHEMA)

    def ingest(self, sources: Mapping[str, str], fmt: str = "parquet") -> int:
        """Add the new files below each source's folder; returns their number."""
        while True:
            base, batch = self.log.last(), str(uuid4())
            fresh = self._new_files(sources)
            if not fresh:
                return 0
            lines = None
            for source in sorted({f.source for f in fresh}):
                part = load_sales_lines(self.spark, {source: [f.path for f in fresh if f.source == source]}, fmt)
                lines = part if lines is None else lines.unionByName(part)
            places = [f"{self.root}/{what}/batch={batch}" for what in ("lines", "files")]
            try:
                lines.to(StructType.fromDDL(LINE_SCHEMA)).write.parquet(places[0])
                self.spark.createDataFrame(fresh, FILE_SCHEMA).coalesce(1).write.parquet(places[1])
                self.log.append({"batch": batch, "files": len(fresh)}, expected=base)
                return len(fresh)
            except Superseded:
                self._discard(places)
            except Exception:
                self._discard(places)
                raise

    def _discard(self, places: list[str]) -> None:
        for place in places:
            delete_folder(self.spark, place)

    def _new_files(self, sources: Mapping[str, str]) -> list:
        """Listed by Spark without their contents; a path list is what any reader holds in the driver."""
        found = None
        for source, folder in sources.items():
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
                F.lit(source).alias("source"), "path", "length", F.col("modificationTime").alias("modified")
            ).filter(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]") & (F.col("length") > 0))
            found = listed if found is None else found.unionByName(listed)
        if found is None:
            return []
        known = self.files().select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
        compared = found.join(known, "path", "left")
        same = (F.col("_length") == F.col("length")) & (F.col("_modified") == F.col("modified"))
        open_ = compared.filter(F.col("_length").isNull() | ~same).select("source", "path", "length", "modified", F.col("_length").isNotNull().alias("changed"))
        rows = open_.orderBy("source", "path").collect()
        changed = [r.path for r in rows if r.changed]
        if changed:
            raise ValueError(f"{len(changed)} ingested files have changed, first: {changed[:3]}")
        return [File(r.source, r.path, r.length, r.modified) for r in rows]
