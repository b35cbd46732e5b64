"""Tables that change by whole versions: a version is there for readers once its commit is.

``path/data/<name>`` holds a version's rows, ``path/commits/version=<n>`` one row that names them.  Data are written first and
the commit last, as one file that appears by a rename.  A job that ends between the two leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "name string, committed timestamp, version int"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """A row for each version: its number, its folder's name, when it was committed."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException:  # nothing committed yet
        return spark.createDataFrame([], COMMIT)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of the given one; they stay what they are while later versions come."""
    found = commits(spark, path)
    found = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if found is None:
        raise FileNotFoundError(f"{path} has no version" + ("" if version is None else f" {version}"))
    return spark.read.parquet(f"{path}/data/{found['name']}")


def commit(df: DataFrame, path: str) -> int:
    """Writes ``df`` as the next version and gives its number.  Of two writers of one version, the later one's commit fails."""
    spark = df.sparkSession
    version = (commits(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    spark.range(1, numPartitions=1).select(F.lit(name).alias("name"), F.current_timestamp().alias("committed")).write.mode("errorifexists").parquet(f"{path}/commits/version={version}")
    return version


def expired(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """The folders of all but the last ``keep`` versions, for whoever clears up; a row for each version is read."""
    return [f"{path}/data/{r['name']}" for r in commits(spark, path).orderBy(F.desc("version")).offset(keep).collect()]


def upserted(old: DataFrame, new: DataFrame, keys: list[str], created: str | None = None) -> DataFrame:
    """New rows over old ones of the same key; ``created`` keeps the old row's value.  Of new rows with one key any one counts, so dedupe first."""
    if created:
        kept = old.select(*keys, F.col(created).alias("__created"))
        new = new.join(kept, keys, "left").withColumn(created, F.coalesce("__created", created)).select(*new.columns)
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(new: DataFrame, path: str, keys: list[str], created: str | None = None) -> int:
    """The next version of the table at ``path``, with ``new`` over it; the first one, if there is none."""
    spark = new.sparkSession
    if commits(spark, path).isEmpty():
        return commit(new, path)
    return commit(upserted(current(spark, path), new, keys, created), path)


def update(spark: SparkSession, path: str, where: Column, **values: object) -> int:
    """The next version, in which the rows that ``where`` holds for have ``values`` (a null sets null); other rows and columns stay."""
    old = current(spark, path)
    kinds = dict(old.dtypes)
    return commit(old.withColumns({c: F.when(where, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}), path)
