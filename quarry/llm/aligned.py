"""Second passes over a table without shuffling its texts.

A first pass finds, by small keys, what matters in each row; the findings go back to the rows' own blocks: they are
written to the shared folder in a bounded number of parts, sorted by block and row, and a later scan reads of its part
the row groups that hold the rows of each batch it meets. A row's key is its file and its index in that file, so it does
not depend on how a scan is split, on retries or on lost executors. A batch's findings are bounded by its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

BLOCK = 1 << 14
#: Most parts of a table of findings, and bytes of a row group in it.
PARTS, GROUP = 4096, 1 << 20
#: Plans whose rows are those of a file, each once.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def is_scan(df: DataFrame) -> bool:
    """Whether each row of df is one row of a Parquet file, which gives it a key."""
    plan = df._jdf.queryExecution().analyzed()
    found = plan.metadataOutput()
    fields = [found.apply(i).dataType() for i in range(found.size()) if found.apply(i).name() == "_metadata"]
    if len(fields) != 1 or "row_index" not in list(fields[0].fieldNames()):
        return False
    while True:
        if plan.nodeName().split(" ")[0] not in _PLAIN:
            return False
        if not plan.children().size():
            return True
        plan = plan.children().apply(0)


def keyed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """(block long, row long, columns): a row's stable key and the columns. df is a file scan; else it is written first."""
    common.bound_batches(df.sparkSession)
    at = df if is_scan(df) else common.written(df, "input")
    return at.select(
        F.xxhash64(F.col("_metadata.file_path"), F.shiftright(F.col("_metadata.row_index"), BLOCK.bit_length() - 1)).alias("block"),
        F.col("_metadata.row_index").alias("row"),
        *columns,
    )


def by_block(findings: DataFrame, name: str) -> str:
    """Writes findings, which have the columns block and row, in parts by block, sorted; gives the path."""
    spark = findings.sparkSession
    parts = min(PARTS, common.shuffle_partitions(spark))
    path = f"{common.new_path(spark, name)}.{parts}"
    dealt = findings.withColumn("part", F.pmod("block", F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part", "block", "row")
    dealt.write.partitionBy("part").option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
    return path


def file_system(uri: str):
    """(pyarrow file system, path in it) of a qualified uri; s3a is what Hadoop calls s3."""
    from pyarrow import fs

    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a://", "s3n://")) else uri)


class Findings:
    """Reads a table of findings, by block and rows. Keeps the open files of one part and the row group read last."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.parts = int(path.rpartition(".")[2])
        self.where, self.at = file_system(path)
        if self.where.get_file_info(self.at).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{path} is missing: findings are read from the shared folder")
        self.part, self.files = None, []
        self.last: tuple = (None, None)

    def _open(self, part: int) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.part, self.files = part, []
        for x in self.where.get_file_info(fs.FileSelector(f"{self.at}/part={part}", allow_not_found=True)):  # no findings, no folder
            if x.path.endswith(".parquet"):
                f = pq.ParquetFile(self.where.open_input_file(x.path))
                names = f.schema_arrow.names
                column = names.index("block"), names.index("row")
                stats = [[f.metadata.row_group(g).column(c).statistics for c in column] for g in range(f.metadata.num_row_groups)]
                self.files.append((f, [((b.min, r.min), (b.max, r.max), b.min == b.max) for b, r in stats]))

    def rows(self, block: int, first: int, last: int) -> pa.Table | None:
        """The findings of the block's rows first to last, sorted by row."""
        if block % self.parts != self.part:
            self._open(block % self.parts)
        out = []
        for i, (f, groups) in enumerate(self.files):
            for g, (low, high, one) in enumerate(groups):
                if not low[0] <= block <= high[0] or one and (low[1] > last or high[1] < first):
                    continue
                if self.last[0] != (self.part, i, g):
                    self.last = (self.part, i, g), f.read_row_group(g)
                table = self.last[1]
                b, r = (table.column(c).to_numpy() for c in ("block", "row"))
                keep = np.flatnonzero((b == block) & (r >= first) & (r <= last))
                if len(keep):
                    out.append(table.slice(keep[0], keep[-1] - keep[0] + 1))
        return pa.concat_tables(out) if out else None


def located(batches: Iterator[pa.RecordBatch], path: str, grain: int = 1) -> Iterator[tuple[pa.RecordBatch, pa.Table | None]]:
    """Batches of keyed rows (block and row first), each of one block, with the findings of its rows. Where findings are
    about `grain` rows, from a multiple of it on, their row is the first of these. Without a path, batches are cut alone."""
    findings = Findings(path) if path else None
    for batch in batches:
        blocks, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edge = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))).tolist() if len(blocks) else []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            yield batch.slice(i, j - i), findings and findings.rows(int(blocks[i]), int(rows[i:j].min()) // grain * grain, int(rows[i:j].max()))


def with_findings(batches: Iterator[pa.RecordBatch], path: str, index: Callable[[pa.Table], dict]) -> Iterator[tuple]:
    """(block, row values without block, the row's entry in its findings' index or None) for each row of keyed batches."""
    for batch, table in located(batches, path):
        entries = {} if table is None else index(table)
        for b, *values in common.record_batches(batch):
            yield b, values, entries.get(values[0])
