"""Helpers shared by the training-data operators: written tables, text batches, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text, as every contract of this subpackage counts them.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a kernel turns into numpy arrays at a time.
SLICE_BYTES = 2_000_000
#: Spark's setting that deletes the shuffle files of a query at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Local folders of this process, where no shared one is named; deleted at its end.
_OWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the write go with its end, since no later plan reads them; else they stay until the driver collects.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is dealt out, as small files would keep all but a few idle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def hashed_share(*cols: str) -> Column:
    """Share of 1 that the columns' hash is at: a row of a repeatable sample has a small one."""
    return F.xxhash64(*cols).bitwiseAND((1 << 30) - 1) / (1 << 30)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as remainder null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, at least one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = batch.column(text).cast(pa.binary())
    ends = np.cumsum(np.fromiter((len(b.as_buffer()) if b.is_valid else 0 for b in sizes), np.int64, n))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Regroup batches sorted by ``key`` so that no run of equal keys is cut; keeps one open run in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield _joined(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(held).combine_chunks()


def unite(label: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Give ``nodes`` one label; returns the first node of each class they had, or none if they had one already."""
    classes, first = np.unique(label[nodes], return_index=True)
    if len(classes) < 2:
        return nodes[:0]
    label[np.isin(label, classes[1:])] = classes[0]
    return nodes[first]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst long) by alternating large and small stars.

    Returns (node, root): the smallest node reachable. Nodes without an edge are not listed; self loops and
    repeated edges are harmless; no edges give no rows. Every round is a written table, so a lost executor
    costs one round. All steps are aggregates and joins: no neighbour list is ever gathered.
    """
    pair = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))
    clean = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = written(clean, "edges")
    seen = None
    for _ in range(rounds):
        both = now.select(F.inline(pair))
        # written tables on both sides of a join, so that a node with very many neighbours can be split as skew
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.inline(F.expr("array(struct(u as src, m as dst), struct(v as src, m as dst))"))).where("src <> dst").distinct()
        after = written(small, "edges")
        for done in (now, least, large, low):
            discard(done)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return low.unionByName(low.select(F.col("root").alias("node"), "root")).distinct()


#: Rows of a bucket that one kernel compares with each other; larger buckets are split into pairs of blocks.
BUCKET_ROWS = 20_000
UNIT_BITS = 20


def dealt(rows: DataFrame, counted: DataFrame, ident: str, most: int = BUCKET_ROWS) -> DataFrame:
    """Deal ``rows`` so that equal ``key`` (below 2**43) meet, in units of bounded size: adds ``run`` and ``block``.

    ``counted`` has the keys (one row each time) whose number decides. A bucket of more than ``most`` is cut into
    blocks by the hash of ``ident``; each pair of blocks is a unit of its own, so every two rows of a bucket meet in
    some unit, and in exactly one if their blocks differ. Returns rows dealt and sorted by ``run``, then ``ident``.
    """
    hot = written(counted.groupBy("key").count().where(F.col("count") > most).select("key", F.least(F.ceil(F.col("count") / most), F.lit(1 << UNIT_BITS // 2)).cast("int").alias("blocks")), "hot")
    n = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64(ident), n).cast("int")
    with_ = F.sequence(F.lit(0), n - 1)
    units = F.transform(with_, lambda c: F.least(c, F.col("block")) * n + F.greatest(c, F.col("block")))
    split = rows.join(hot, "key", "left").withColumn("block", block).withColumn("unit", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(units)))
    split = split.withColumn("run", F.shiftleft("key", UNIT_BITS).bitwiseOR(F.col("unit").cast("long")))
    # within a unit of two blocks only rows of different blocks are new to each other
    split = split.withColumn("block", F.when(F.expr("unit % coalesce(blocks, 1) = unit div coalesce(blocks, 1)"), F.lit(-1)).otherwise(F.col("block")))
    return split.drop("key", "blocks", "unit").repartition("run").sortWithinPartitions("run", ident)
