"""Texts, source trees, archives, images and page files."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = ("__pycache__", "node_modules", ".git", "venv", "dist", "build")


def read_texts(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """(path, text) of all matching files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_sources(spark: SparkSession, path: str, suffixes: Sequence[str] = (".py",), excluded: Sequence[str] = EXCLUDED, globs: Sequence[str] = ()) -> DataFrame:
    """(path, source) of a source tree, without excluded folders, and without
    files whose path or name matches one of the shell patterns ``globs``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    inside = F.lit(False)
    for s in suffixes:
        inside = inside | F.col("path").endswith(s)
    for e in excluded:
        inside = inside & ~F.col("path").contains(f"/{e}/")
    for g in globs:
        pattern = fnmatch.translate(g).replace("\\z", "\\Z").replace("\\Z", "$")
        inside = inside & ~F.regexp_like("path", F.lit(f"^{pattern}")) & ~F.regexp_like(F.substring_index("path", "/", -1), F.lit(f"^{pattern}"))
    return files.where(inside).select("path", F.decode("content", "UTF-8").alias("source"))


def read_archives(spark: SparkSession, path: str, suffixes: Sequence[str] = (".py",)) -> DataFrame:
    """(path, source) of the members of zip files, unpacked by the executors."""
    wanted = tuple(suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.endswith(wanted)]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{where}!{n}" for n in names], pa.string()), pa.array([z.read(n).decode("utf-8", "replace") for n in names], pa.string())], ["path", "source"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, source string")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, media_type, width, height); sizes come from the files'
    headers, and are null where these cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
    media = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[suffix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s and s[i] for s in sizes], pa.int32()) for i in (0, 1))], [*batch.schema.names, "width", "height"])

    found = files.withColumn("media_type", media).where("media_type is not null")
    return found.mapInArrow(run, "path string, content binary, media_type string, width int, height int")


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, GIF, JPEG or WebP file."""
    big, little = (lambda at, n, order=order: int.from_bytes(content[at : at + n], order) for order in ("big", "little"))
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return big(16, 4), big(20, 4)
    if content[:4] == b"GIF8" and len(content) >= 10:
        return little(6, 2), little(8, 2)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP" and len(content) >= 30:
        if content[12:16] == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if content[12:16] == b"VP8L":
            bits = little(21, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a start of frame
            return big(at + 7, 2), big(at + 5, 2)
        at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD8 else 2 + big(at + 2, 2)
    return None


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) by pdfplumber or PyMuPDF, whichever is installed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import pdfplumber

            pages = lambda b: [p.extract_text() or "" for p in pdfplumber.open(io.BytesIO(b)).pages]
        except ImportError:
            try:
                import fitz

                pages = lambda b: [p.get_text() for p in fitz.open(stream=b, filetype="pdf")]
            except ImportError as e:
                raise RuntimeError("page files need pdfplumber or PyMuPDF") from e
        for batch in batches:
            rows = [(w, n + 1, t) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, t in enumerate(pages(c))]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page int, text string")
