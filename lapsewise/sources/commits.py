"""A numbered list of commits in a folder that several writers share.

    <root>/00000000000000000001.json     one JSON object per commit, written whole

A commit is written under another name and renamed to the next free number; the rename refuses a name that is
taken, so of two writers one gets the number and the other sees the new commit before it tries again. Readers
see whole commits only, ordered by number and not by clocks.

The refusal is as strong as the store's rename: atomic on HDFS; a local folder looks for the name first and then renames, and
object stores without an atomic rename give no such promise.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Superseded(RuntimeError):
    """Another writer committed after the state that this commit builds upon."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self):
        return self._path().getFileSystem(self._conf)

    def entries(self, after: int = 0) -> list[dict]:
        """The commits numbered above `after`, in order, each with its number as `sequence`.

        A commit is one publication or ingest, so the list is as long as the folder's listing.
        """
        files, found = self._files(), []
        if not files.exists(self._path()):
            return found
        for status in files.listStatus(self._path()):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) > after:
                stream = files.open(status.getPath())
                try:
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found.append({**json.loads(text), "sequence": int(name[:-5])})
        return sorted(found, key=lambda e: e["sequence"])

    def last(self) -> int:
        """The number of the newest commit, 0 without any."""
        files = self._files()
        if not files.exists(self._path()):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(self._path())]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def append(self, entry: Mapping, expected: int | None = None) -> int:
        """Add a commit and return its number; with `expected` only directly after that number, else `Superseded`."""
        files, draft = self._files(), self._path(f"_draft-{uuid4()}")
        files.mkdirs(self._path())
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(dict(entry), default=str), "utf-8"))
        finally:
            out.close()
        try:
            while True:
                number = (self.last() if expected is None else expected) + 1
                if self._renamed(draft, self._path(f"{number:020d}.json")):
                    return number
                if expected is not None:
                    raise Superseded(f"commit {number} was made by another writer")
        finally:
            files.delete(draft, False)

    def _renamed(self, source, target) -> bool:
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        refuse = self.spark.sparkContext._gateway.new_array(options, 1)
        refuse[0] = options.NONE
        files = self._files()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        try:
            context.rename(files.makeQualified(source), files.makeQualified(target), refuse)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
