"""A sink that delivers whole batches.

``register`` names it ``committed``: a Python data source whose tasks write files of
their own and whose driver makes a batch count by one small manifest, moved into place whole.
Readers (``delivered``) open only files that a manifest names, so a batch of which a
task fails, or whose driver dies before the manifest, is not seen at all; a batch that comes
again after a restart finds its manifest and leaves its files out.  The folder must be one
that all executors see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if out is None:
                system.create_dir(f"{root}/files")
                out = pq.ParquetWriter(f"{root}/files/{name}", batch.schema, filesystem=system)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, root = _open(self.path)
        final = f"{root}/batches/{batchId}.json"
        if system.get_file_info(final).type != fs.FileType.NotFound:  # delivered before a restart
            return self.abort(messages, batchId)
        system.create_dir(f"{root}/batches")
        draft = f"{root}/batches/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"batch": batchId, "files": [m.name for m in messages if m and m.name], "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(draft, final)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        """Files of the tasks that had ended; those of a task that died stay unnamed."""
        system, root = _open(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/files/{m.name}")


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def batches(path: str) -> list[dict]:
    """The manifests, in order of the batches."""
    system, root = _open(path)
    if system.get_file_info(f"{root}/batches").type == fs.FileType.NotFound:
        return []
    found = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/batches")) if f.path.endswith(".json")]
    return sorted((json.loads(system.open_input_stream(f).read()) for f in found), key=lambda b: b["batch"])


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were delivered."""
    files = [f"{path}/files/{name}" for b in batches(path) for name in b["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def orphans(path: str) -> list[str]:
    """Files that no manifest names: of running batches, or of tasks that died."""
    system, root = _open(path)
    if system.get_file_info(f"{root}/files").type == fs.FileType.NotFound:
        return []
    named = {name for b in batches(path) for name in b["files"]}
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/files")) if f.base_name not in named)
