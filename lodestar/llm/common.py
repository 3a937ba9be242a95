"""What the operators share: words, table access, shared-folder tables, Arrow row mapping, running totals, names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.sources.shipping import ship

#: A word is a run of characters other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
#: Rows of one slice of a stored partition, see ``sliced``.
SLICE_BITS = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- names ---------------------------------------------------------------------------------


def col(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of ``df`` but those with a name of ``made``, in any case."""
    low = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in low]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind where ``df`` has such a column already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- tables in the shared folder -----------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, sizes are known.

    The files go when the driver's JVM ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folder(spark, path)[0].deleteOnExit(_folder(spark, path)[1])
    back = spark.read.schema(df.schema).parquet(path)
    back._lodestar_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` gave and that no later plan reads."""
    if path := getattr(df, "_lodestar_path", None):
        files, where = _folder(df.sparkSession, path)
        files.delete(where, True)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


# --- Arrow ---------------------------------------------------------------------------------


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], made: str, keep: list[str] | None = None, chunk: int = 500) -> DataFrame:
    """``mapInArrow`` in slices of at most ``chunk`` rows.

    ``make()`` runs once in each task and returns a function from the columns that are not in
    ``keep`` (as lists) to the columns of ``made`` (a DDL). Those in ``keep`` go through as they
    are; without any, a slice may give another number of rows than it has.
    """
    keep = keep or []
    read = [c for c in df.columns if c not in keep]
    new = T.StructType.fromDDL(made)
    numbered = [T.StructField(f"c{i}", df.schema[c].dataType, True) for i, c in enumerate(keep)]  # names of any characters
    schema = T.StructType([*numbered, *(T.StructField(f"r{i}", f.dataType, True) for i, f in enumerate(new.fields))])
    plain = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate([*keep, *read])])
    ship(df.sparkSession)
    arrow, n = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = step({k: c.to_pylist() for k, c in zip(read, part.columns[n:], strict=True)})
                passed = [c if c.type == f.type else c.cast(f.type) for c, f in zip(part.columns[:n], list(arrow)[:n], strict=True)]
                yield pa.RecordBatch.from_arrays(passed + [pa.array(out[k], type=f.type) for k, f in zip(new.names, list(arrow)[n:], strict=True)], schema=arrow)

    return plain.mapInArrow(run, schema).toDF(*keep, *new.names)


# --- keys, sizes, running totals -------------------------------------------------------------


def md5_bits(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the joined columns, as a bigint; DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(F.concat(*columns)), 1, 15), 16, 10).cast("bigint")


def same_rows(df: DataFrame, *columns: str) -> Column:
    """128 bits (a struct of two bigints) that rows share if they are equal in ``columns`` (default: all); null is a value."""
    kinds = {f.name: f.dataType for f in df.schema}
    plain = [F.to_json(F.struct(col(c))) if "map<" in kinds[c].simpleString() else col(c) for c in columns or df.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")) for c in plain])
    return F.struct(F.xxhash64(nulls, *plain).alias("x"), F.xxhash64(F.lit("second"), *reversed(plain), nulls).alias("y"))


def unique_keys(docs: DataFrame, *columns: str) -> Column:
    """A bigint that stands for a row's values in ``columns``: equal values share it, unlike ones never do (up to 128 bits).

    64 bits alone would meet by chance among 10^10 documents. So the keys that two different
    rows share are looked for, in one pass over the hashes, and all but one get another key:
    n ** 2 / 2 ** 65 of them are to be expected, a few hundred among 10^11 documents.
    """
    k = same_rows(docs, *columns)
    pairs = docs.select(k.alias("k")).select("k.x", "k.y")
    shared = pairs.groupBy("x").agg(F.min("y").alias("least"), F.max("y").alias("most")).filter("least <> most")
    shared = materialize(shared.select(F.col("x").alias("shared_x"), "least"), "shared-keys")
    if shared.isEmpty():
        return k["x"]
    met = pairs.join(F.broadcast(shared), F.col("x") == F.col("shared_x")).filter("y <> least").select("x", "y").distinct().collect()
    # some new keys for each, of which those that a row has already are left out, all in one pass
    tried = {xxhash.xxh64_intdigest(f"{r['x']} {r['y']} {salt}".encode()) - (1 << 63): None for r in met for salt in range(8)}
    taken = {r["x"] for r in pairs.join(F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in tried], "tried bigint")), F.col("x") == F.col("tried"), "left_semi").distinct().collect()}
    key, given = k["x"], {}
    for r in sorted(met):
        new = next(t for salt in range(1 << 20) if (t := xxhash.xxh64_intdigest(f"{r['x']} {r['y']} {salt}".encode()) - (1 << 63)) not in given and t not in taken and (salt < 8 or t in tried or pairs.filter(F.col("x") == t).isEmpty()))
        given[new] = r
    # looked up in a map by both halves, whatever their number
    renamed = F.create_map(*[c for new, r in given.items() for c in (F.lit(f"{r['x']} {r['y']}"), F.lit(new))])
    return F.coalesce(F.try_element_at(renamed, F.concat_ws(" ", k["x"].cast("string"), k["y"].cast("string"))), key)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sliced() -> Column:
    """Number of the slice of 8,192 rows that a row is in, for a table about to be written.

    Rows that are equal in all else can be told apart by slices once the table stands, so that
    no key, however hot, is numbered in one task.
    """
    return F.shiftright(F.monotonically_increasing_id(), SLICE_BITS)


def running_totals(rows: DataFrame, bucket: list[str], part: str, order: list[str], measure: Column) -> DataFrame:
    """Add ``ahead``: the sum of ``measure`` over the rows before a row in its ``bucket``, by ``order``.

    ``rows`` is a stored table with a column ``slice`` (see ``sliced``). ``part`` is a coarse range
    of the first column of ``order``; rows equal in ``order`` have equal measures and are
    numbered in any way. Rows of one bucket, part and order are summed by slices first: the
    windows see one row for each, and number at most a slice's rows.
    """
    cell = [*bucket, part, *order, "slice"]
    same = rows.withColumn("__m", measure)
    cells = same.groupBy(*cell).agg(F.sum("__m").alias("__s"))
    within = Window.partitionBy(*bucket, part).orderBy(*order, "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__in", F.coalesce(F.sum("__s").over(within), F.lit(0)))
    earlier = Window.partitionBy(*bucket).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = same.groupBy(*bucket, part).agg(F.sum("__m").alias("__s")).select(*bucket, part, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))
    cells = cells.join(parts, [*bucket, part]).select(*[F.col(c).alias(f"__{c}") for c in cell], (F.col("__in") + F.col("__before")).alias("__ahead"))
    meet = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell]
    number = F.row_number().over(Window.partitionBy(*cell).orderBy(F.lit(1))) - 1
    joined = same.join(cells, meet)
    return joined.withColumn("ahead", F.col("__ahead") + number * F.col("__m")).select(*rows.columns, "ahead")
