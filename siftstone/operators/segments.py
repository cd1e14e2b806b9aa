"""Tables of committed segments: the store under the vector and postings indexes.

A change writes its files to folders of its own, then commits by adding one small
entry to the log.  Readers open only the folders that the log names, so a change that
fails, or is still being written, is not seen, and its folders are removed by
``vacuum``.  An entry's number is taken once: a writer that finds it taken fails
and starts again.  Any file system that Spark can write serves.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{where}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def log(self) -> list[dict]:
        """All entries, oldest first.  One is a few numbers, so the log stays small."""
        system, path = self._at("log")
        if not system.exists(path):
            return []
        out = []
        for status in system.listStatus(path):
            if status.getPath().getName().endswith(".json"):
                stream = system.open(status.getPath())
                try:
                    out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return sorted(out, key=lambda e: e["seq"])

    def live(self) -> list[dict]:
        """The last base and what was committed after it."""
        entries = self.log()
        base = max((i for i, e in enumerate(entries) if e["kind"] == "base"), default=None)
        if base is None:
            raise ValueError(f"no index at {self.path}")
        return entries[base:]

    def begin(self, kind: str) -> dict:
        seq = max((e["seq"] for e in self.log()), default=0) + 1
        return {"seq": seq, "kind": kind, "folder": f"{seq:08d}-{uuid.uuid4().hex[:8]}", "tables": []}

    def write(self, entry: dict, name: str, df: DataFrame, *by: str) -> None:
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/{name}/segment={entry['folder']}")
        entry["tables"].append(name)

    def commit(self, entry: dict) -> None:
        system, draft = self._at(f"log/.{entry['folder']}")
        _, final = self._at(f"log/{entry['seq']:08d}.json")
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise RuntimeError(f"another writer committed {entry['seq']} at {self.path}; start the change again")

    def read(self, name: str, schema: str, entries: list[dict] | None = None) -> DataFrame:
        """The committed rows of a table, with the column ``segment``; partition columns prune."""
        entries = self.live() if entries is None else entries
        folders = [f"{self.path}/{name}/segment={e['folder']}" for e in entries if name in e["tables"]]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.path}/{name}").parquet(*folders)

    def vacuum(self) -> None:
        """Remove the folders that no live entry names, and the entries before the base.
        Nothing may be reading or writing them."""
        live = self.live()
        named, base = {e["folder"] for e in live}, live[0]["seq"]
        system, root = self._at("")
        for table in system.listStatus(root):
            if table.getPath().getName() != "log":
                for folder in system.listStatus(table.getPath()):
                    if folder.getPath().getName().removeprefix("segment=") not in named:
                        system.delete(folder.getPath(), True)
        for e in self.log():
            if e["seq"] < base:
                system.delete(self._at(f"log/{e['seq']:08d}.json")[1], False)
