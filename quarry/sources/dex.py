"""Scans: DEX files and packages from paths or binary columns, one pass over the bytes for all tables.

A file is read by one task; its bytes stay there. A damaged file is one row with parse_error and no tables. Packages
(zip archives) give a row for each entry whose name ends in .dex and whose bytes start with the DEX magic, by name.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry import schemas
from quarry.format import image
from quarry.format.errors import DexError

GLOB = "*.{dex,apk,zip,jar}"


def identity(path: str, entry: str | None) -> int:
    """A file's dex_id: a hash of where it is."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{entry or ''}".encode(), digest_size=8).digest(), "big") >> 1


def entries(data: bytes) -> Iterator[tuple[str | None, bytes, str | None]]:
    """(entry name, bytes, error) of each image in a file's bytes. An entry name is None for a file that is an image."""
    if not data.startswith(b"PK"):
        yield None, data, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(n for n in z.namelist() if n.endswith(".dex")):
                content = z.read(name)
                if content.startswith(b"dex\n"):
                    yield name, content, None
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
        yield None, b"", f"zip error: {e}"


def image_rows(path: str, data: bytes, compat: bool = False) -> Iterator[dict]:
    """Rows of schemas.IMAGES for a file."""
    for ord_, (entry, content, error) in enumerate(entries(data)):
        row = {"dex_id": identity(path, entry), "path": path, "entry_name": entry, "dex_ord": ord_, "size": len(content), "parse_error": error}
        if error is None:
            try:
                row |= image.read(content, compat)
            except DexError as e:
                row["parse_error"] = str(e)
        yield row


def images_from(files: DataFrame, content: str = "content", path: str = "path", compat: bool = False) -> DataFrame:
    """Images of a DataFrame with a binary column. Rows with null content are skipped."""
    schema = to_arrow_schema(schemas.IMAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: the rows of a large one fill a batch
                data = batch.column(1)[i].as_py()
                if data is not None:
                    for row in image_rows(batch.column(0)[i].as_py(), data, compat):
                        yield pa.RecordBatch.from_pylist([row], schema)

    return files.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(content).alias("content")).mapInArrow(run, schemas.IMAGES)


def images(spark: SparkSession, path: str | list[str], compat: bool = False, glob: str | None = None) -> DataFrame:
    """Images of the files at path (folders, patterns, or files)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return images_from(reader.option("pathGlobFilter", glob or GLOB).load(path), compat=compat)


class DexDataSource(DataSource):
    """spark.read.format("dex").option("table", name).load(folder): one table of all images in a folder.

    Reads through pyarrow's file systems, a partition a file; `images` is the way for stores that only Spark opens.
    """

    @classmethod
    def name(cls) -> str:
        return "dex"

    def _table(self) -> str:
        table = self.options.get("table", "strings")
        if table not in schemas.TABLES:
            raise ValueError(f"unknown table {table!r}; there are {', '.join(schemas.TABLES)}")
        return table

    def schema(self) -> StructType:
        out = schemas.struct("dex_id BIGINT, path STRING, entry_name STRING")
        for f in schemas.TABLES[self._table()]:
            out.add(f)
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return DexReader(self.options["path"], self._table(), schema, self.options.get("compat", "false") == "true")


class DexReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, compat: bool) -> None:
        self.path, self.table, self.columns, self.compat = path, table, schema.names, compat

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, at = self._files()
        info = where.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
        return [InputPartition(x.path) for x in found if x.path.endswith((".dex", ".apk", ".zip", ".jar"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, _ = self._files()
        with where.open_input_stream(partition.value) as f:
            data = f.read()
        for row in image_rows(partition.value, data, self.compat):
            for values in row.get(self.table, ()):
                yield tuple((row | values).get(c) for c in self.columns)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DexDataSource)
