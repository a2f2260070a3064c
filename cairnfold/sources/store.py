"""Tables of a store as Parquet folders under one commit log.

A commit writes its folders first and then one small file with the next number that names, for each table, the
folders that make it up. Readers see the commit before or the one after it, never a part. The file gets its name by
a step that fails where the name is taken, so that of two writers one fails and nothing is lost. Appending adds
folders; a rewrite of some partitions replaces theirs and leaves all others alone; ``compact`` joins folders again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from cairnfold.schemas import PARTITIONS, SCHEMAS


#: Commit files that stay, for readers that are at work.
KEPT_COMMITS = 100


class ConflictError(RuntimeError):
    """Another writer has committed meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._jvm = jvm

    # the pointer

    def _read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        p = self._path(f"{self.root}/_commits")
        if not self._fs.exists(p):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in self._fs.listStatus(p) if x.getPath().getName().endswith(".json"))

    def state(self) -> dict:
        numbers = self._numbers()
        return json.loads(self._read(self._commit_file(numbers[-1]))) if numbers else {"commit": 0, "tables": {}}

    def _commit_file(self, n: int) -> str:
        return f"{self.root}/_commits/{n:012d}.json"

    def _publish(self, state: dict) -> None:
        """Names the commit's file; fails if another writer has published this number. Local disks link the whole file
        to its name, others rename it without overwriting, which file systems with a name node do in one step."""
        temp, final = self._path(f"{self.root}/_commits/_{uuid.uuid4().hex}"), self._path(self._commit_file(state["commit"]))
        out = self._fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(temp.toUri().getPath(), final.toUri().getPath())
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(temp, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, FileExistsError) or "AlreadyExists" in str(e):
                raise ConflictError(f"another writer has made commit {state['commit']}") from None
            raise
        finally:
            self._fs.delete(temp, False)
        self._fs.delete(self._path(self._commit_file(state["commit"] - KEPT_COMMITS)), False)

    # tables

    def read(self, name: str, where: Iterable[str] | None = None) -> DataFrame:
        """The table as of the last commit; ``where``: only these of its folders."""
        folders = list(self.state()["tables"].get(name, [])) if where is None else list(where)
        schema = SCHEMAS[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/{f}" for f in folders])
        return df.select(*[c.split()[0] for c in schema.split(", ")])

    def _leaves(self, folder: str, depth: int) -> list[str]:
        found = [folder]
        for _ in range(depth):
            found = [
                f"{f}/{s.getPath().getName()}" for f in found for s in self._fs.listStatus(self._path(f)) if s.isDirectory()
            ]
        return found

    def folders_of(self, name: str, values: Iterable[tuple]) -> list[str]:
        """The table's folders of some partitions, given by the values of its partition columns."""
        cols = PARTITIONS[name]
        ends = {"/".join(f"{c}={v}" for c, v in zip(cols, vs, strict=True)) for vs in values}
        return [f for f in self.state()["tables"].get(name, []) if f.split("/", 1)[1] in ends]

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, instead: dict[str, list[str]] | None = None) -> int:
        """Adds rows, or replaces tables, or (``instead``) some folders of a replaced table, in one step.

        Of two writers at once the later one to publish fails with ``ConflictError`` and may try again.
        """
        state = self.state()
        n = state["commit"] + 1
        tables = {k: list(v) for k, v in state["tables"].items()}
        for mode, group in (("append", append or {}), ("replace", replace or {})):
            for name, df in group.items():
                parts = PARTITIONS.get(name, [])
                tag = f"commit={n}-{uuid.uuid4().hex[:8]}"
                writer = df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.option("compression", "zstd")
                (writer.partitionBy(*parts) if parts else writer).parquet(f"{self.root}/{name}/{tag}")
                base = len(f"{self.root}/{name}/")
                leaves = [x[base:] for x in self._leaves(f"{self.root}/{name}/{tag}", len(parts))]
                old = tables.get(name, [])
                if mode == "replace":
                    gone = set((instead or {}).get(name, old))
                    old = [f for f in old if f not in gone]
                tables[name] = old + leaves
        self._publish({"commit": n, "tables": tables})
        return n

    def compact(self, name: str, least: int = 8) -> int:
        """Joins the folders of each partition that has at least ``least`` of them; returns how many folders went."""
        folders: dict[str, list[str]] = {}
        for f in self.state()["tables"].get(name, []):
            folders.setdefault(f.partition("/")[2], []).append(f)
        many = [f for own in folders.values() if len(own) >= least for f in own]
        if not many:
            return 0
        parts = PARTITIONS.get(name, [])
        df = self.read(name, many)
        self.commit(replace={name: df.repartition(*parts) if parts else df}, instead={name: many})
        return len(many)

    def vacuum(self) -> int:
        """Deletes folders of tables that the last commit does not name; to be called when no one reads an older one and
        no one writes. Returns their number."""
        tables, gone = self.state()["tables"], 0
        for name in SCHEMAS:
            base = self._path(f"{self.root}/{name}")
            if not self._fs.exists(base):
                continue
            live = {f.split("/")[0] for f in tables.get(name, [])}
            for x in self._fs.listStatus(base):
                if x.isDirectory() and x.getPath().getName() not in live:
                    self._fs.delete(x.getPath(), True)
                    gone += 1
        return gone
