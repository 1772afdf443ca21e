"""Atomic batches over several tables (SNK6).

A batch writes its rows of each table into a folder of its own attempt,
``<table>/batch_id=<batch>/attempt=<attempt>``, and is committed by one small file,
``commits/<batch>``, that names the attempt and is put in place by a rename. Readers take the
attempts that are committed, so that

* a batch that is killed between two tables is invisible in all of them, and its retry, a new
  attempt, makes it whole;
* a batch that is run again replaces its rows in all tables at one moment.

What a batch may see of the others is fixed when it begins for the first time:
``snapshots/<batch>`` lists the attempts that were committed then. A retry reads the same list,
whatever other sources have written meanwhile, and gives the same rows.

The files hold names only, one line for each batch. Attempts that no commit and no snapshot names
any more are left for a clean-up (``unused``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """The batches under one root folder, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- small files ------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        if not fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if not n.startswith((".", "_")))

    def _lines(self, folder: str, name: str) -> list[str] | None:
        fs, path = self._fs(), self._path(folder, name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [x for x in text.split("\n") if x]

    def _put(self, folder: str, name: str, lines: list[str]) -> None:
        """Replace a small file by a rename: readers see the old one or the new one."""
        fs, path, tmp = self._fs(), self._path(folder, name), self._path(folder, f".{name}.{uuid.uuid4().hex[:8]}")
        out = fs.create(tmp, True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        if not fs.rename(tmp, path):                    # file systems that do not rename onto a file
            fs.delete(path, False)
            if not fs.rename(tmp, path):
                raise OSError(f"{folder}/{name} could not be put in place")

    # -- batches ----------------------------------------------------------------------

    def committed(self) -> dict[str, str]:
        """The attempt of each committed batch."""
        found = {b: self._lines("commits", b) for b in self._names("commits")}
        return {b: lines[0] for b, lines in found.items() if lines}

    def begin(self, batch: str) -> tuple[str, dict[str, str]]:
        """A new attempt of a batch, and the attempts by batch that it may see: those that were
        committed when the batch began for the first time, without its own."""
        lines = self._lines("snapshots", batch)
        if lines is None:
            seen = {b: a for b, a in self.committed().items() if b != batch}
            self._put("snapshots", batch, [f"{b} {a}" for b, a in sorted(seen.items())])
        else:
            seen = dict(x.split(" ") for x in lines)
        return f"a{uuid.uuid4().hex[:12]}", seen

    def write(self, df: DataFrame, table: str, batch: str, attempt: str, fmt: str = "parquet") -> None:
        df.write.mode("overwrite").format(fmt).save(f"{self.root}/{table}/batch_id={batch}/attempt={attempt}")

    def commit(self, batch: str, attempt: str) -> None:
        self._put("commits", batch, [attempt])

    def read(self, table: str, attempts: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a table's committed batches, or of the given attempts, with ``batch_id``. A table
        that no batch has written is empty and needs ``schema``."""
        attempts = self.committed() if attempts is None else attempts
        path = self._path(table)
        if not attempts or not self._fs().exists(path):
            if schema is None:
                if self._fs().exists(path):
                    return self.spark.read.parquet(f"{self.root}/{table}").drop("attempt").limit(0)
                raise FileNotFoundError(f"no batch has written {table}")
            return self.spark.createDataFrame([], f"{schema}, batch_id string")
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        # both are partition columns: other folders are not read
        rows = rows.where(F.col("batch_id").isin(list(attempts)) & F.col("attempt").isin(list(attempts.values())))
        return rows.drop("attempt")

    def unused(self, table: str) -> list[str]:
        """Folders of attempts that no commit and no snapshot names."""
        named = set(self.committed().values())
        for b in self._names("snapshots"):
            named |= {x.split(" ")[1] for x in self._lines("snapshots", b) or []}
        fs, out = self._fs(), []
        if fs.exists(self._path(table)):
            for b in fs.listStatus(self._path(table)):
                if b.isDirectory():
                    out += [a.getPath().toString() for a in fs.listStatus(b.getPath())
                            if a.isDirectory() and a.getPath().getName().removeprefix("attempt=") not in named]
        return sorted(out)
