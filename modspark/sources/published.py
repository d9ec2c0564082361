"""Append-only tables whose batches appear whole and once.

A batch is written under a folder of its own attempt, then published by one
rename: a manifest naming the batch and the attempt's folder takes its final
name, which only the first writer of a batch gets.  Readers list manifests and
read the folders they name, so they never see rows of a write that died, is
still going on, or lost to another writer of the same batch.

    <path>/data/batch=<batch>/attempt=<id>/...   files of one write
    <path>/_published/<batch>.json               {"batch", "folder", "rows", "replaces"}

``compact`` rewrites small batches into one and publishes it with the list of
those it replaces: one rename again, so a reader sees either the small batches
or the large one.  The replaced batches stay known, and appending one of them
again does nothing.  ``vacuum`` removes folders no manifest names.

The rename must not overwrite.  On HDFS that is one step of the name node; on
local files (tests) Hadoop looks first and renames then.  The driver sees
manifests only, one a batch, which compaction folds together.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T

MANIFESTS, DATA = "_published", "data"
# Where a line of a file stands: when the file was written, its path, the split.
PLACE = ["_metadata.file_modification_time AS _written", "_metadata.file_path AS _file", "_metadata.file_block_start AS _block"]
_PLACE_TYPES = {"_written": "TIMESTAMP", "_file": "STRING", "_block": "BIGINT"}
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=-]{0,180}")


@dataclass(frozen=True)
class Batch:
    """A published batch: its name, the folder of its files, its rows (None
    where the writer did not count) and the batches it stands for."""

    name: str
    folder: str
    rows: int | None = None
    replaces: tuple[str, ...] = ()


class Published:
    """The table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path, self._jvm = jvm.org.apache.hadoop.fs.Path, jvm
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # files -----------------------------------------------------------------

    def _at(self, *parts: str):
        return self._path("/".join([self.path, *parts]))

    def _list(self, *parts: str) -> list:
        at = self._at(*parts)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, at) -> str:
        stream = self._fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _rename(self, source, target) -> bool:
        """Give ``source`` its final name unless it is taken."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 0)
        try:
            context.rename(source, target, options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    # reading ---------------------------------------------------------------

    def exists(self) -> bool:
        return self._fs.exists(self._at(MANIFESTS))

    def manifests(self) -> list[Batch]:
        """All manifests, in the order of their names."""
        out = []
        for status in self._list(MANIFESTS):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith((".", "_")):
                m = json.loads(self._read(status.getPath()))
                out.append(Batch(m["batch"], m["folder"], m["rows"], tuple(m["replaces"])))
        return sorted(out, key=lambda b: b.name)

    def batches(self) -> list[Batch]:
        """The batches a reader sees: those no other one replaces."""
        found = self.manifests()
        gone = {r for b in found for r in b.replaces}
        return [b for b in found if b.name not in gone]

    def has(self, batch: str) -> bool:
        """Whether ``batch`` is published, itself or within a larger one."""
        return self._fs.exists(self._at(MANIFESTS, f"{batch}.json")) or any(batch in b.replaces for b in self.manifests())

    def _load(self, reader: DataFrameReader, batches: list[Batch] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/{b.folder}" for b in (self.batches() if batches is None else batches)]
        if not folders:
            return None
        return reader.option("basePath", f"{self.path}/{DATA}").load(folders).drop("batch", "attempt")

    def read(self, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
        """The rows of all published batches, with the columns of their
        partition folders (no batches: no rows)."""
        found = self._load(self.spark.read.schema(schema).format(fmt))
        return self.spark.createDataFrame([], schema) if found is None else found

    def lines(self, place: bool = False) -> DataFrame:
        """The published files as text lines (``value``), with the columns of
        their partition folders and, if asked, the ``PLACE`` of their lines."""
        found = self._load(self.spark.read.format("text"))
        if found is None:
            found = self.spark.createDataFrame([], "value string")
            return found.selectExpr("*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in _PLACE_TYPES.items())) if place else found
        return found.selectExpr("*", *PLACE) if place else found

    # writing ---------------------------------------------------------------

    def append(
        self, df: DataFrame, batch: str, fmt: str = "json", partition_by: list[str] | None = None,
        replaces: tuple[str, ...] = (), rows: int | None = None,
    ) -> bool:
        """Write ``df`` as ``batch`` and publish it.  False, and no change to
        what readers see, if the batch is already there."""
        if not _NAME.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.has(batch):
            return False
        folder = self.stage(df, batch, fmt, partition_by)
        if self.publish(Batch(batch, folder, rows, tuple(replaces))):
            return True
        self._fs.delete(self._at(folder), True)
        return False

    def stage(self, df: DataFrame, batch: str, fmt: str = "json", partition_by: list[str] | None = None) -> str:
        """Write the files of an attempt; no reader sees them yet."""
        folder = f"{DATA}/batch={batch}/attempt={uuid.uuid4().hex}"
        w = df.write.mode("errorifexists").format(fmt)
        (w.partitionBy(*partition_by) if partition_by else w).save(f"{self.path}/{folder}")
        return folder

    def publish(self, batch: Batch) -> bool:
        """Make a staged batch visible; False if its name is taken."""
        self._fs.mkdirs(self._at(MANIFESTS))
        draft = self._at(MANIFESTS, f".{batch.name}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        text = {"batch": batch.name, "folder": batch.folder, "rows": batch.rows, "replaces": list(batch.replaces)}
        out.write(bytearray(json.dumps(text).encode()))
        out.close()
        won = self._rename(draft, self._at(MANIFESTS, f"{batch.name}.json"))
        if not won:
            self._fs.delete(draft, False)
        return won

    def compact(
        self, schema: T.StructType | str, fmt: str = "json", partition_by: list[str] | None = None, least: int = 2,
        change: Callable[[DataFrame], DataFrame] | None = None,
    ) -> str | None:
        """Rewrite the visible batches as one (their rows through ``change``,
        e.g. to add up partial counts); its name, or None if there are fewer
        than ``least``.  Two compactions at a time are settled by the
        rename: both derive the same name from what they replace, and one wins."""
        seen = self.batches()
        if len(seen) < least:
            return None
        names = tuple(sorted({n for b in seen for n in (b.name, *b.replaces)}))
        name = "compact-" + uuid.uuid5(uuid.NAMESPACE_OID, "\n".join(names)).hex
        df = self._load(self.spark.read.schema(schema).format(fmt), seen)
        if change is not None:
            df = change(df)
        if partition_by:
            df = df.hint("rebalance", *partition_by)
        total = None if change is not None or any(b.rows is None for b in seen) else sum(b.rows for b in seen)
        return name if self.append(df, name, fmt, partition_by, names, total) else None

    def vacuum(self, older_than_s: float = 7 * 24 * 3600) -> int:
        """Delete attempts that no visible batch reads and that are older than
        any write or read still going on; the number of folders removed."""
        used = {b.folder for b in self.batches()}
        limit, gone = (time.time() - older_than_s) * 1000, 0
        for batch in self._list(DATA):
            name = batch.getPath().getName()
            for attempt in self._list(DATA, name):
                folder = f"{DATA}/{name}/{attempt.getPath().getName()}"
                if folder not in used and attempt.getModificationTime() <= limit:
                    self._fs.delete(attempt.getPath(), True)
                    gone += 1
        return gone


def is_published(spark: SparkSession, path: str) -> bool:
    return Published(spark, path).exists()
