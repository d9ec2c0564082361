"""U2 with a memory: responses are kept as they come, and a run goes on where
the last one stopped.

The log is a folder of small Parquet files, one for every few responses of a
task, each written under a hidden name and moved to its final one.  A run
leaves out what the log answers already (an anti-join on content and prompt),
deals the rest over ``partitions`` tasks and calls the reviewer prompt by
prompt, with retries that back off exponentially and, if a rate is given, a
share of it as tokens a task.  When a prompt fails for good its task writes
what it has and asks no more; the run raises when all tasks are done, so none
is still asking when the next run begins.  A task that is run again (a lost
executor) reads its files first, so no answered prompt is paid for twice.
(With speculative execution two copies of a task may ask at the same time;
turn it off here.)

Defined cases: a prompt that changed is asked again, and the newest response of
a content counts; rows without an id or prompt are not asked; an empty answer
is an answer.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.session import path_exists

DDL = "content_id string, prompt_key string, raw string, attempts int, answered_at timestamp"
_SCHEMA = pa.schema([
    ("content_id", pa.string()), ("prompt_key", pa.string()), ("raw", pa.string()), ("attempts", pa.int32()),
    ("answered_at", pa.timestamp("us", "UTC")),
])


class ReviewError(RuntimeError):
    """A prompt failed for good; what was answered is in the log."""


class Tokens:
    """At most ``rate`` calls a second, up to a second's worth at once."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.free, self.at = max(1.0, rate or 0.0), clock()

    def take(self) -> None:
        if self.rate is None:
            return
        now = self.clock()
        self.free = min(max(1.0, self.rate), self.free + (now - self.at) * self.rate)
        self.at = now
        if self.free < 1.0:
            wait = (1.0 - self.free) / self.rate
            self.sleep(wait)
            self.free, self.at = self.free + wait * self.rate, self.at + wait
        self.free -= 1.0


def ask(call: Callable[[str], str], prompt: str, tokens: Tokens, retries: int, backoff: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """(response, attempts); the last error if all attempts fail."""
    for attempt in range(1, retries + 2):
        tokens.take()
        try:
            return call(prompt), attempt
        except Exception:
            if attempt > retries:
                raise
            sleep(backoff * 2 ** (attempt - 1))
    raise AssertionError


class ReviewLog:
    """The responses under ``path``, a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def all(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], DDL)
        return self.spark.read.schema(DDL).option("pathGlobFilter", "r-*.parquet").parquet(self.path)

    def responses(self) -> DataFrame:
        """The newest response of every content (``content_id, raw, answered_at``)."""
        newest = self.all().groupBy("content_id").agg(F.max(F.struct("answered_at", "raw")).alias("r"))
        return newest.select("content_id", "r.raw", "r.answered_at")

    def pending(self, queue: DataFrame) -> DataFrame:
        """Prompts without a response yet, each once."""
        keyed = queue.select("content_id", "prompt").dropna().withColumn("prompt_key", F.sha2("prompt", 256)).dropDuplicates(["content_id", "prompt_key"])
        return keyed.join(self.all().select("content_id", "prompt_key"), ["content_id", "prompt_key"], "left_anti")

    def run(
        self, queue: DataFrame, call: Callable[[str], str], partitions: int = 8, rate: float | None = None, retries: int = 3,
        backoff: float = 1.0, chunk: int = 20, keep_going: bool = False,
    ) -> int:
        """Ask for all pending prompts; the number of answers gained.  With
        ``keep_going`` a prompt that fails for good stays pending instead of
        failing the run."""
        path, run = self.path, uuid.uuid4().hex
        share = None if rate is None else rate / partitions

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
            fs.create_dir(root, recursive=True)
            prefix = f"r-{run}-{TaskContext.get().partitionId():05d}-"
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith(prefix)]
            done = {tuple(r) for f in files for r in zip(*pq.read_table(f, columns=["content_id", "prompt_key"], filesystem=fs).to_pydict().values())}
            tokens, held, gained, error = Tokens(share), [], len(done), None

            def flush() -> None:
                if held:
                    draft = f"{root}/.{uuid.uuid4().hex}"
                    cols = [pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)]
                    pq.write_table(pa.Table.from_arrays(cols, schema=_SCHEMA), draft, filesystem=fs)
                    fs.move(draft, f"{root}/{prefix}{uuid.uuid4().hex}.parquet")
                    held.clear()

            for content, key, prompt in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
                if (content, key) in done:
                    continue
                try:
                    raw, attempts = ask(call, prompt, tokens, retries, backoff)
                except Exception as e:
                    if keep_going:
                        continue
                    error = f"{type(e).__name__}: {e}"
                    break
                held.append((content, key, raw, attempts, datetime.now(timezone.utc)))
                gained += 1
                if len(held) >= chunk:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([gained], pa.int64()), pa.array([error], pa.string())], names=["n", "error"])

        rows = self.pending(queue).select("content_id", "prompt_key", "prompt").repartition(partitions, "content_id")
        total, error = rows.mapInArrow(work, "n long, error string").agg(F.sum("n"), F.max("error")).first()
        if error is not None:
            raise ReviewError(f"{total} prompts were answered before a reviewer failed: {error}")
        return total or 0
