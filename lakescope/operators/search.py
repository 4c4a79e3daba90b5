"""Search and summary operators: name search, definition search with matching line, object card,
dashboard counts, objects per database, missing-key banner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_search(objects: DataFrame, term: str, name_col: str = "object_name", key_cols: list[str] | None = None,
                limit: int | None = None) -> DataFrame:
    """H1: objects whose name contains the term (case-insensitive), by name; the first ``limit`` if given."""
    hits = objects.filter(F.lower(F.col(name_col)).contains(term.lower()))
    order = [F.col(name_col)] + [F.col(c) for c in (key_cols or [])]
    hits = hits.orderBy(*order)
    return hits if limit is None else hits.limit(limit)


def first_matching_line(text, term: str):
    """X11: the first line of a text that contains the term (case-insensitive)."""
    return F.filter(F.split(text, "\n"), lambda line: F.lower(line).contains(term.lower()))[0]


def line_count(text):
    """X11: number of lines of a text."""
    return F.size(F.split(text, "\n"))


def definition_search(defs: DataFrame, term: str, text_col: str, key_cols: list[str], limit: int | None = None) -> DataFrame:
    """H2: definitions containing the term with their first matching line and line count; the first ``limit`` if given."""
    hits = defs.filter(F.lower(F.col(text_col)).contains(term.lower()))
    hits = hits.select(*key_cols, first_matching_line(F.col(text_col), term).alias("matching_line"),
                       line_count(F.col(text_col)).alias("n_lines")).orderBy(*key_cols)
    return hits if limit is None else hits.limit(limit)


def object_card(key: DataFrame, columns: DataFrame, profiles: DataFrame | None = None,
                usage: DataFrame | None = None) -> DataFrame:
    """For the requested objects (database_name, schema_name, table_name): their columns with
    profile figures, and their usage level."""
    k = ["database_name", "schema_name", "table_name"]
    c = columns.join(key.select(*k), k, "left_semi")
    if profiles is not None:
        c = c.join(profiles, k + ["column_name"], "left")
    if usage is not None:
        c = c.join(usage.select(*k, "score", "usage_level"), k, "left")
    return c


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """Row counts per value of the given columns."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def missing_key_banner(implicit: DataFrame) -> DataFrame:
    """H5: suggested keys split at 0.8 confidence, with bands 0.8 / 0.7."""
    conf = F.col("confidence")
    return implicit.select("*", F.when(conf >= 0.8, "high").when(conf >= 0.7, "medium").otherwise("low").alias("band"))
