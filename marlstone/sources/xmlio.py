"""Where documents come from and where they go: text, XML and Parquet files, binary columns, no sink at all; streams, too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.operators.decode import OPTIONS, Decoder, decode
from marlstone.operators.encode import encoded, utf8
from marlstone.plans import wire
from marlstone.plans.model import Model

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true"}


def session(spark: SparkSession) -> SparkSession:
    """A session beside the given one in which element names are compared by case and times are UTC."""
    out = spark.newSession()
    for k, v in SETTINGS.items():
        out.conf.set(k, v)
    return out


def read_documents(spark: SparkSession, path: str, column: str = "xml", whole: bool = True) -> DataFrame:
    """A document in each file, or in each line."""
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", column)


def read_records(spark: SparkSession, path: str, model: Model, root: str, paths: list[str] | None = None, depth: int = wire.DEPTH) -> DataFrame:
    """Elements named as the root out of XML files of any size, with all leaves as strings; files are split by Spark."""
    model.check().root(root)
    want = wire.known(model, root, wire.tree(paths))
    return spark.read.format("xml").options(**OPTIONS).option("rowTag", root).schema(wire.struct(model, root, want, depth=depth, split=True)).load(path)


def decode_records(spark: SparkSession, path: str, model: Model, root: str, paths: list[str] | None = None, into: str = "decoded", depth: int = wire.DEPTH) -> DataFrame:
    """The same elements, typed: guards, readers and derived types as in ``decode``.

    Files are read as they stand, so XML's own five references are all that may be named, an element without a body is an
    empty one, and items under a derived tag come after those under their base's.
    """
    raw = read_records(spark, path, model, root, paths, depth)
    d = Decoder(model, depth=depth, split=True)
    c = F.struct(*(F.col(x) for x in raw.columns))
    if model.subjects[root].derived:
        c = c.withField(wire.TYPE, F.coalesce(c[wire.TYPE], F.lit(root)))
    return raw.select(d.subject(root, c, wire.tree(paths), (), False).alias(into))


def read_stream(spark: SparkSession, path: str, model: Model, root: str, column: str = "xml", paths: list[str] | None = None) -> DataFrame:
    """Documents, one in each line of the files that arrive in a folder, decoded as they come."""
    lines = spark.readStream.schema("value string").text(path).withColumnRenamed("value", column)
    return decode(lines, column, model, root, paths=paths)


def as_documents(df: DataFrame, column: str, model: Model, root: str, prolog: bool = False) -> DataFrame:
    return df.select(encoded(F.col(column), model, root, prolog).alias("value"))


def write_documents(df: DataFrame, column: str, model: Model, root: str, path: str, prolog: bool = False, mode: str = "errorifexists") -> None:
    """A document in each line of text files."""
    as_documents(df, column, model, root, prolog).write.mode(mode).text(path)


def write_binary(df: DataFrame, column: str, model: Model, root: str, path: str, prolog: bool = False, mode: str = "errorifexists") -> None:
    """UTF-8 bytes in Parquet, beside the other columns."""
    df.withColumn(column, utf8(F.col(column), model, root, prolog)).write.mode(mode).parquet(path)


def write_nowhere(df: DataFrame, column: str, model: Model, root: str) -> None:
    """All the work of writing bytes and none of the storage."""
    df.select(utf8(F.col(column), model, root).alias("value")).write.format("noop").mode("overwrite").save()


def write_stream(df: DataFrame, column: str, model: Model, root: str, path: str, checkpoint: str):
    """A running query that writes documents, one in each line."""
    return as_documents(df, column, model, root).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).start()


def size_in_bytes(c: Column) -> Column:
    return F.octet_length(c)
