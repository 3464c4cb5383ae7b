"""Intermediate tables in the folder that the whole cluster shares, and operators on them."""

from __future__ import annotations

import atexit
import functools
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Bytes of a written table up to which it is broadcast; a larger one is joined by a shuffle.
SMALL_BYTES = 16 << 20
#: Rows of a key beyond which they are spread over tasks instead of dealt by the key.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only where none is named and the master is local.

    A cluster without a named folder is an error: executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="ostinato-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the time of a block; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_ROOTS: set[str] = set()


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process, when their results have been read; at its end this is done anyway."""
    for root in sorted(_ROOTS):
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _ROOTS.clear()


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            clean(spark)
        except Exception:  # noqa: BLE001  the session may be gone before the process
            pass


atexit.register(_at_exit)


def fresh(name: str, taken: list[str]) -> str:
    """The name, or with underscores after it where it is taken."""
    while name in taken:
        name += "_"
    return name


class Scratch:
    """Written tables that cut lineage: a lost executor costs a task of the step that runs, not the steps before.

    Shuffle files of a step go as soon as its table is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = itertools.count()
        _ROOTS.add(self.root)
        self.parts: int | None = None

    def size(self, df: DataFrame) -> int:
        """Bytes of a written table's files."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def scale(self, df: DataFrame, part: int = 8 << 20) -> None:
        """From now on tables are written in as many parts as this table has of ``part`` bytes (at least one for each core):
        steps on far smaller tables don't pay for a full shuffle's number of tasks. No fewer parts than that, no more than a shuffle's."""
        self.parts = max(self.spark.sparkContext.defaultParallelism, -(-self.size(df) // part))

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self.n):03d}-{name}"

    def save(self, df: DataFrame, name: str, rows_per_batch: int | None = None, codec: str | None = None) -> DataFrame:
        path = self.path(name)
        conf = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
        if rows_per_batch:
            conf["spark__sql__execution__arrow__maxRecordsPerBatch"] = str(rows_per_batch)
        if codec:  # for tables that stay
            conf["spark__sql__parquet__compression__codec"] = codec
        few = self.parts is not None and self.parts < int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with settings(self.spark, **conf):
            (df.coalesce(self.parts) if few else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def small(self, df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
        """The written table, marked for a broadcast if its files are within the limit."""
        return F.broadcast(df) if self.size(df) <= limit else df

    def spread_join(self, big: DataFrame, few: DataFrame, key: str, salt: Column) -> DataFrame:
        """big left join few, a written table of one row for each key, where a key may hold any share of big.

        few has a column n, the rows of big with the key. A table of few bytes is broadcast. Else the keys of more than HOT rows are
        (they are at most one in HOT of the rows), and their rows are dealt by salt; the others meet by their key.
        """
        rest = [c for c in few.columns if c not in (key, "n")]
        if self.size(few) <= SMALL_BYTES:
            return big.join(F.broadcast(few.drop("n")), key, "left")
        hot = self.save(few.where(F.col("n") > HOT).select(key, F.struct(*rest).alias("_hot")), "hot")
        cold = few.where(F.col("n") <= HOT).select(key, F.lit(0).cast("bigint").alias("_salt"), F.struct(*rest).alias("_cold"))
        big = big.join(self.small(hot), key, "left")
        big = big.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(salt) % 100_000 + 100_001))
        big = big.join(cold, [key, "_salt"], "left").withColumn("_v", F.coalesce("_hot", "_cold"))
        return big.select("*", "_v.*").drop("_v", "_hot", "_cold", "_salt")

    def numbered(self, df: DataFrame, name: str, *order: Column | str) -> DataFrame:
        """The written rows of df with ``place``: 0, 1, 2, ... in the order given.

        Rows are dealt in ranges of the order and numbered within them; a range's first place is the number of rows before it, one
        number for each task. So the order should tell all rows apart: what it holds equal meets in one task. df should be a written
        table or cheap to make: ranges are found by a pass over it.
        """
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        out = self.save(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
        block = F.shiftright("_at", 33)
        start, first = 0, []
        for r in sorted(out.groupBy(block.alias("b")).count().collect()):
            first.append((r[0], start - (r[0] << 33)))
            start += r[1]
        shift = F.broadcast(self.spark.createDataFrame(first, "_block bigint, _shift bigint"))
        return out.withColumn("_block", block).join(shift, "_block").withColumn("place", F.col("_at") + F.col("_shift")).drop("_block", "_shift", "_at")

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def row_key(df: DataFrame, doc_id: str, text: str) -> tuple[Column, str]:
    """A key of rows, in the order of their ids, and its type: the id as a long, or with a digest of the text where ids repeat.

    Rows equal in id and text share their key, and are in the same place; of rows that repeat an id with another text the one
    with the smaller digest comes first. Null ids have a null key.
    """
    own = F.col(doc_id).cast("long")
    if df.where(own.isNotNull()).groupBy(own.alias("k")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return own, "bigint"
    tag = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.when(own.isNotNull(), F.struct(own.alias("id"), tag.alias("tag"))), "struct<id:bigint,tag:binary>"


def tables() -> set[str]:
    """The folders of all intermediate tables so far."""
    return set(_ROOTS)


def spare(spark: SparkSession, before: set[str], *results: DataFrame) -> None:
    """Deletes the intermediate tables made since ``before`` that no result reads; a result may be unwritten."""
    read = {tuple(f.rsplit("/", 3)[1:3]) for df in results for f in df.inputFiles()}
    for root in sorted(_ROOTS - before):
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        left = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
        gone = [x for x in left if (p.getName(), x.getName()) not in read]
        for x in gone:
            fs.delete(x, True)
        if len(gone) == len(left):
            fs.delete(p, True)
            _ROOTS.discard(root)


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of (spark, ...) to an unwritten table, of whose intermediate tables those stay that the result reads."""

    @functools.wraps(stage)
    def run(spark: SparkSession, *args, **kw) -> DataFrame:
        before = tables()
        out = stage(spark, *args, **kw)
        spare(spark, before, out)
        return out

    return run


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) long pairs to (id, component_id): the smallest id of each component, for every id in a pair.

    Contraction in rounds: every node points to its least neighbour, the pointers' targets become the
    nodes of a smaller graph. Rounds alternate between the order of ids, with which a star or a clique
    goes in one round, and a hashed order, with which a chain loses a constant share of its nodes whatever
    its ids are; so rounds grow with the logarithm of the input. A hub's rows are pre-aggregated for the
    minimum and meet one row each in the joins, where adaptive execution splits a hot key.
    Null ids and self links are ignored; an empty input gives an empty table.
    """
    u, v = F.col("u"), F.col("v")
    link = lambda df: df.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    e = scratch.save(link(edges.select(u.cast("long"), v.cast("long"))), "links")
    maps: list[DataFrame] = []
    for r in itertools.count():
        if e.isEmpty():
            break
        order = (lambda c: c) if r % 2 == 0 else (lambda c, r=r: F.xxhash64(c, F.lit(r)))
        both = e.select("u", "v").unionByName(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(order(v).alias("o"), v.alias("v"))).alias("w"))
        m = least.select("u", F.when(F.col("w.o") < order(u), F.col("w.v")).otherwise(u).alias("root"))
        if r % 2 == 0:
            up = m.select(F.col("u").alias("root"), F.col("root").alias("up"))
            m = m.join(up, "root").select("u", F.col("up").alias("root"))
        m = scratch.save(m, "pointers")
        at = lambda c: m.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
        e2 = scratch.save(link(e.join(at("u"), "u").join(at("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))), "links")
        scratch.drop(e)
        e = e2
        maps.append(m)
    if not maps:
        return e.select(u.alias("id"), v.alias("component_id"))
    out = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("u").alias("root"), F.col("root").alias("up"))
        out = out.join(up, "root", "left").select("u", F.coalesce("up", "root").alias("root"))
    if len(maps) > 1:  # hashed rounds don't end at the least id
        low = out.groupBy("root").agg(F.min("u").alias("low"))
        out = out.join(low, "root").select("u", F.col("low").alias("root"))
    out = scratch.save(out.select(u.alias("id"), F.col("root").alias("component_id")), "components")
    scratch.drop(e, *maps)
    return out
