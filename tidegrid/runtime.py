"""Session-level services: the shared work folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import os
import secrets
import socket
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from multiprocessing.connection import Client, Connection, Listener

from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count has shown it to hold no more rows than this.
BROADCAST_ROWS = 200_000

_LOCAL_FALLBACK = os.path.join(tempfile.gettempdir(), "tidegrid-work")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, the context's checkpoint folder is used, and only a
    session in local mode (one machine, as in tests) falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    try:
        existing = context.getCheckpointDir()
    except AttributeError:
        existing = None
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(_LOCAL_FALLBACK)
    return _LOCAL_FALLBACK


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to recompute: a lost executor costs a re-read of files. The files
    are deleted when the session's JVM ends, as lazy results may read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the session's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows, else ``df`` as it is.

    With ``weight``, the sum of the weights is bounded instead, as for rows that hold arrays.
    Pass narrow frames only: a row or unit of weight should be a few dozen bytes.
    """
    if weight is None:
        return F.broadcast(df) if fits(df, rows) else df
    held = df.agg(F.coalesce(F.sum(weight), F.lit(0)) + F.count("*")).first()[0]
    return F.broadcast(df) if held <= rows else df


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` holds at most ``rows`` rows, found by counting no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def possibly_in(df: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose long ``column`` may be among ``keys``, a column of ``n`` longs: all that are, few others.

    The keys become a bit map of eight bits each, at most 2**26, that is broadcast as words of 64 bits;
    ``df`` isn't shuffled, so that a shuffle that follows carries what the map lets through.
    """
    bits = min(max((8 * n).bit_length(), 16), 26)
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_place").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("_place", 6).alias("_word")
    words = keys.toDF(column).select(place(F.col(column)).alias("_place")).groupBy(word).agg(F.bit_or(bit).alias("_mask"))
    marked = df.withColumn("_place", place(F.col(column))).withColumn("_word", word)
    met = marked.join(F.broadcast(words), "_word").where(F.col("_mask").bitwiseAND(bit) != 0)
    return met.drop("_place", "_word", "_mask")


def tasks_at_once(spark: SparkSession) -> int:
    """How many tasks the session's executors run at the same time, or 0 where a stage may not ask for all of them at once."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


@contextmanager
def gathering(context: BarrierTaskContext) -> Iterator[Callable[[bytes], list[bytes]]]:
    """A function by which the tasks of a barrier stage, all calling it alike, give each other bytes, in the order of partitions.

    They meet at the first one over a connection with a key of its own: a barrier of Spark takes a second each time.
    """
    rank, infos = context.partitionId(), context.getTaskInfos()
    ends: list[Connection] = []
    if rank == 0:
        key = secrets.token_bytes(32)
        with Listener(("", 0), "AF_INET", backlog=len(infos), authkey=key) as listener:
            context.allGather(f"{infos[0].address.partition(':')[0]} {listener.address[1]} {key.hex()}")
            met = [listener.accept() for _ in infos[1:]]
        ends = [end for _, end in sorted(((int(end.recv_bytes()), end) for end in met), key=lambda x: x[0])]
    else:
        host, port, key = context.allGather("")[0].split()
        ends = [Client((host, int(port)), "AF_INET", authkey=bytes.fromhex(key))]
        ends[0].send_bytes(str(rank).encode())
    for end in ends:
        with socket.socket(fileno=os.dup(end.fileno())) as same:
            same.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def gather(own: bytes) -> list[bytes]:
        if rank:
            ends[0].send_bytes(own)
            return [ends[0].recv_bytes() for _ in infos]
        parts = [own, *(end.recv_bytes() for end in ends)]
        for end in ends:
            for part in parts:
                end.send_bytes(part)
        return parts

    try:
        yield gather
    finally:
        for end in ends:
            end.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_if_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)
