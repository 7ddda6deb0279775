"""Result records and where they go."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import Cell, grid_density, grid_stats
from ..operators.schemes import get_scheme

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def evaluate(seqs: DataFrame, schemes: Iterable[tuple[str, dict[str, Any]]], ws: Iterable[int], ks: Iterable[int], sigma: int = 256, full: bool = False) -> DataFrame:
    """A record for each scheme, w and k: sigma, w, k, l, tp, density (null without windows), and with full positions, dists and transfer. The sequences are read once for all records."""
    grid = [(name, params, w, k) for name, params in schemes for w in ws for k in ks]
    stats = grid_stats(seqs, [Cell(name, get_scheme(name, **params), w, k) for name, params, w, k in grid], sigma, full)
    known = [(i, sigma, w, k, w + k - 1, (name, {p: str(v) for p, v in sorted(params.items())})) for i, (name, params, w, k) in enumerate(grid)]
    records = seqs.sparkSession.createDataFrame(known, "cell int, sigma int, w int, k int, l int, tp struct<minimizer_type: string, params: map<string,string>>")
    one = lambda stat: F.sum(F.when(F.col("stat") == stat, F.col("n")))
    some = lambda stat, *names: F.sort_array(F.collect_list(F.when(F.col("stat") == stat, F.struct(*[F.col(c).alias(n) for c, n in zip("ab", names, strict=False)], "n"))))
    columns = [(one("changes") / one("windows")).alias("density")]
    if full:  # w numbers, some w, and w times w
        columns += [some("place", "place").alias("positions"), some("jump", "jump").alias("dists"), some("transfer", "place_from", "place_to").alias("transfer")]
    return records.join(stats.groupBy("cell").agg(*columns), "cell", "left").drop("cell")


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; on a local master without that setting, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/siftwave/{uuid.uuid4().hex}"


def _fasta_records(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (x.decode() for x in b.column(1).to_pylist())
            records = ["\n".join([f">{name}", *(text[i : i + width] for i in range(0, len(text), width))]) for name, text in zip(b.column(0).to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    return of


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """Sequences (seq_id, bytes) of printable letters as FASTA, a folder of files; lines of width letters."""
    rows = seqs.select(F.coalesce(F.col("seq_id").cast("string"), F.lit("")).alias("seq_id"), F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    rows.mapInArrow(_fasta_records(width), "value string").write.mode("overwrite").text(path)


def write_results(df: DataFrame, path: str) -> None:
    """A record a line, as JSON."""
    df.write.mode("overwrite").json(path)


def remembered(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written there on first use."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


MEMO = "scheme string, w int, k int, sigma int, version string, n_windows long, n_changes long, pos_sum long"


def remembered_grid(spark: SparkSession, path: str, seqs: DataFrame, cells: Iterable[Cell], version: str, sigma: int = 256) -> DataFrame:
    """The densities of cells from a table at path that grows with what is asked for: only cells that it doesn't have are sampled, from one reading, and added.

    A cell's name, w, k, sigma and the input's version are its key, so names must tell parameters apart. One writer at a time. The table is in partitions by scheme, and
    what is asked for comes back, whatever else it has.
    """
    cells, keys = list(cells), ["scheme", "w", "k", "sigma", "version"]
    wanted = spark.createDataFrame([(c.name, c.w, c.k, sigma, version) for c in cells], "scheme string, w int, k int, sigma int, version string").distinct()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    known = spark.read.schema(MEMO).parquet(path).join(F.broadcast(wanted), keys) if there else spark.createDataFrame([], MEMO)
    missing = {(r.scheme, r.w, r.k) for r in wanted.join(known, keys, "left_anti").collect()}  # at most as many as cells
    if missing:
        first = {(c.name, c.w, c.k): c for c in cells}
        found = grid_density(seqs, [c for key, c in first.items() if key in missing], sigma)
        found.withColumns({"sigma": F.lit(sigma), "version": F.lit(version)}).write.mode("append").partitionBy("scheme").parquet(path)
    return spark.read.schema(MEMO).parquet(path).join(F.broadcast(wanted), keys)
