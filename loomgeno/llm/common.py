"""What several operators share: written intermediate tables, skew-safe joins, ranks and components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is heavy if more than one left row in HEAVY_SHARE has it, so there are fewer than HEAVY_SHARE such keys.
HEAVY_SHARE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="loomgeno-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: one computation, no lineage to repeat."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgeno-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loom_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Deletes a table that materialize() wrote."""
    if df is not None and (path := getattr(df, "loom_path", None)):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Lets Arrow send Python at most this much text at once, so a worker's memory doesn't depend on text lengths. It holds
    for the session, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def n_words(text: Column | str) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join with a right side that is unique by keys and says in `count` how many left rows have each key.
    The few heavy keys (under HEAVY_SHARE by their definition) are broadcast; the rest is a shuffle join in which
    no key holds more than one row in HEAVY_SHARE. Null keys match nulls. `count` isn't kept."""
    heavy = right.where(F.col(count) * HEAVY_SHARE > total)
    light = right.where(F.col(count) * HEAVY_SHARE <= total).drop(count)

    def on(r: DataFrame) -> tuple[DataFrame, Column]:
        r = r.withColumnsRenamed({k: f"__{k}" for k in keys})
        cond = F.lit(True)
        for k in keys:
            cond = cond & left[k].eqNullSafe(r[f"__{k}"])
        return r, cond

    mark = heavy.drop(count).withColumn("__heavy", F.lit(True))
    r, cond = on(mark)
    first = left.join(F.broadcast(r), cond, "left").drop(*[f"__{k}" for k in keys])
    done = first.where("__heavy").drop("__heavy")
    h, condh = on(mark.select(*keys))
    rest = left.join(F.broadcast(h), condh, "left_anti")
    r, _ = on(light)
    cond = F.lit(True)
    for k in keys:
        cond = cond & rest[k].eqNullSafe(r[f"__{k}"])
    return done.unionByName(rest.join(r, cond, "left").drop(*[f"__{k}" for k in keys]))


def join_small(left: DataFrame, right: DataFrame, key: str, rows: int, bound: int = 100_000, salts: int = 32) -> DataFrame:
    """Left join on one key with a right side, unique by it, of `rows` counted rows: broadcast up to `bound` rows, else
    a shuffle join salted `salts` times. Null keys match nulls."""
    r = right.withColumnRenamed(key, "__key")
    if rows <= bound:
        return left.join(F.broadcast(r), left[key].eqNullSafe(r["__key"]), "left").drop("__key")
    r = r.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # A row's salt is its hash, so a task that runs again deals its rows out as before.
    plain = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), *plain), F.lit(salts)).cast("int"))
    return salted.join(r, salted[key].eqNullSafe(r["__key"]) & (F.col("__salt") == F.col("__s")), "left").drop("__key", "__s", "__salt")


def ordinals(rows: DataFrame, keys: list[str], name: str = "ordinal", uid: str = "__uid") -> DataFrame:
    """Adds a 0-based number among the rows with equal keys (null equals null). rows is a written table with `uid`, the
    monotonically increasing ids of its tasks: rows are numbered within a task's share of a key, then shares are added up, so no
    key's rows meet in one task. Rows of equal keys are numbered in no order that matters."""
    rows = rows.withColumn("__p", F.shiftright(uid, 33))
    share = [*keys, "__p"]
    sizes = rows.groupBy(*share).agg(F.count("*").alias("__n"))
    # At most one row a task for each key.
    sizes = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("__o > 0").drop("__n")
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*share).orderBy(uid)).cast("long") - 1)
    r = sizes.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(share)})
    same = F.lit(True)
    for i, k in enumerate(share):
        same = same & numbered[k].eqNullSafe(r[f"__r{i}"])
    out = numbered.join(r, same, "left").withColumn(name, F.col(name) + F.coalesce("__o", F.lit(0)))
    return out.drop("__p", "__o", *[f"__r{i}" for i in range(len(share))])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds a gapless 0-based rank in the given order without a one-task window: range partitions, then offsets."""
    part = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "rank")
    part = part.withColumn("__p", F.shiftright("__m", 33))
    # One row for each partition, so this window is bounded by the number of tasks.
    offs = part.groupBy("__p").agg(F.count("*").alias("__n"))
    offs = offs.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return part.join(F.broadcast(offs), "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__o")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of edges(a, b), longs: (id, root), root the least id, for each id that has an edge.
    Alternating large and small stars; every round is written to the shared folder, nothing is collected but a
    count and a checksum."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = least(large)
        joined = large.join(m, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "edges")
        drop_table(now)
        now = new
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum((F.col("u") % 1000003) * 31 + F.col("v") % 1000003)).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no convergence in {most} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
