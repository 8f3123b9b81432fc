"""Helpers of the operators in this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this run below the one that the cluster names in
    `spark.checkpoint.dir`. Where none is named, as in tests on one machine, a
    temporary folder serves; a cluster without one is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="cartwise-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`df` written to `folder` and read back: later steps start from files
    that outlive every executor, and not from the plan of `df`."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a settled table of this run that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sliced(ids: DataFrame, key: str, rows: int = 4096, cuts: int = 255) -> tuple[Column, int]:
    """Slice number of a numeric key: slices follow the order of the key and
    hold about `rows` rows each. Only the key column is read here.

    The key range is cut at up to `cuts` quantiles, and every part is cut into
    equal widths, so that the expression stays small however many slices there
    are. Cut points are fixed values once this returns: a recomputed stage
    deals its rows out as before. A null key falls into slice -1.
    """
    seen = ids.agg(F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if not seen["n"]:
        return F.lit(-1).cast("long"), 0
    wanted = min(65_536, -(-seen["n"] // rows))
    parts = min(cuts + 1, wanted)
    share = [i / parts for i in range(1, parts)]
    inner = sorted({int(x) for x in (ids.agg(F.percentile_approx(key, share, 10_000)).first()[0] if share else [])} - {seen["low"]})
    edges = [int(seen["low"]), *inner, int(seen["high"]) + 1]
    each = -(-wanted // (len(edges) - 1))
    low, high = F.array(*[F.lit(x).cast("long") for x in edges[:-1]]), F.array(*[F.lit(x).cast("long") for x in edges[1:]])
    part = F.size(F.filter(low, lambda x: x <= F.col(key)))
    start, stop = F.element_at(low, part), F.element_at(high, part)
    inside = F.floor((F.col(key) - start).cast("double") * each / (stop - start)).cast("long")
    number = (part - 1) * each + F.least(F.greatest(inside, F.lit(0)), F.lit(each - 1))
    return F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(number.cast("long")), (len(edges) - 1) * each
