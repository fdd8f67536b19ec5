"""The tables of a set of images as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarry import schemas
from quarry.format import decoder
from quarry.format.errors import DexError
from quarry.sources import dex


def decoded(code_items: DataFrame, keys: tuple[str, ...] = ("dex_id", "method_idx")) -> DataFrame:
    """Instructions of code items (keys, insns, insns_size), and for a method that can't be decoded one row with error."""
    schema = to_arrow_schema(schemas.DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for dex_id, method, code, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {"dex_id": dex_id, "method_idx": method}
                try:
                    rows += [own | r for r in decoder.decode(code, size)]
                except DexError as e:
                    rows.append(own | {"error": str(e)})
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return code_items.select(*keys, "insns", "insns_size").mapInArrow(run, schemas.DECODED)


class DexTables:
    """Tables by name (schemas.TABLES), and instructions. Images are parsed once and methods decoded once: both are
    persisted, spilling to disk, and recomputed from the files if an executor is lost. release() frees them."""

    def __init__(self, images: DataFrame, persist: bool = True) -> None:
        self.images = images.persist(StorageLevel.MEMORY_AND_DISK) if persist else images
        self._persist = persist

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], compat: bool = False, persist: bool = True) -> DexTables:
        return cls(dex.images(spark, path, compat), persist)

    @classmethod
    def from_column(cls, files: DataFrame, content: str = "content", path: str = "path", compat: bool = False, persist: bool = True) -> DexTables:
        return cls(dex.images_from(files, content, path, compat), persist)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schemas.TABLES:
            raise AttributeError(name)
        return self.images.select("dex_id", F.explode(name).alias("__r")).select("dex_id", "__r.*")

    @cached_property
    def files(self) -> DataFrame:
        return self.images.select("dex_id", "path", "entry_name", "dex_ord", "size", "header", "link_data", "parse_error")

    @cached_property
    def _decoded(self) -> DataFrame:
        out = decoded(self.code_items)
        return out.persist(StorageLevel.MEMORY_AND_DISK) if self._persist else out

    @cached_property
    def instructions(self) -> DataFrame:
        return self._decoded.where("error IS NULL").drop("error")

    @cached_property
    def decode_errors(self) -> DataFrame:
        return self._decoded.where("error IS NOT NULL").select("dex_id", "method_idx", "error")

    def section_bytes(self, files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
        """(dex_id, type_code, bytes): each section's bytes, from its lowest offset to the next larger one in the map, else the data's end.

        files holds the images' bytes by path; only files that are images themselves have sections here."""
        items = self.map_items
        starts = items.where("offset <> 0").groupBy("dex_id", "type_code").agg(F.min("offset").alias("start"))
        after = F.min(F.when(F.col("offset") > F.col("start"), F.col("offset"))).alias("next")
        ends = starts.join(items.select("dex_id", "offset"), "dex_id").groupBy("dex_id", "type_code", "start").agg(after)
        own = self.files.select("dex_id", "path", (F.col("header.data_off") + F.col("header.data_size")).alias("data_end"))
        both = ends.join(own, "dex_id").withColumn("end", F.coalesce("next", "data_end"))
        both = both.join(files.select(F.col(path).alias("path"), F.col(content).alias("content")), "path")
        both = both.where((F.col("end") > F.col("start")) & (F.col("end") <= F.length("content")))
        return both.select("dex_id", "type_code", F.substring(F.col("content"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("bytes"))

    def create_views(self, prefix: str = "") -> None:
        for name in [*schemas.TABLES, "files", "instructions", "decode_errors"]:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def release(self) -> None:
        self.images.unpersist()
        if "_decoded" in self.__dict__:
            self._decoded.unpersist()
