"""Helpers shared by the operators: words, scratch tables, ranks over a global order."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.session import cut_lineage, ranked  # noqa: F401 (the operators take ranked from here)

#: White space that separates words, as a regular-expression class and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shipped(spark: SparkSession) -> SparkSession:
    """Let Spark carry this package to the Python workers, once for each application, so that functions
    in it can be loaded there whether or not the package is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lakescope_shipped", False):
        return spark
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="lakescope-py-"), "lakescope.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    sc.addPyFile(at)
    sc._lakescope_shipped = True
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the snapshot, by Spark's own reader (the folder may be in any store)."""
    shipped(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(text_or_empty(text), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without keeping them: pieces of the split less the empty ones at both ends."""
    t = text_or_empty(text)
    pieces = F.size(F.split(t, f"[{SPACE_CLASS}]+"))
    edge = lambda c: F.when((c == "") | F.lit(SPACE_CHARS).contains(c), 1).otherwise(0)
    return F.when(t == "", F.lit(0)).otherwise(
        F.greatest(F.lit(0), pieces - edge(F.substring(t, 1, 1)) - edge(F.substring(t, -1, 1)))).cast("long")


def frozen(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    return cut_lineage(df)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)
