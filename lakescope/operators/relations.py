"""Relationship discovery: explicit keys, implicit foreign keys by naming rules, checks on the data.

Naming rules are applied as a join, not a loop: every table with a primary key is exploded into the
column names that would point at it (with pattern and confidence), and catalog columns are joined
to those names on ``lower(name)``. The first-ranked name match per column wins; its type is then
checked (a mismatch drops the column, it does not fall through to a later pattern).
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescope.functions.types import type_family, type_match
from lakescope.session import ranked

# Prefixes stripped before the "{T}Id" rule, in the order they are tried.
STRIP_PREFIXES = ["Ref", "Fk", "Source", "Target", "Parent", "Child"]
# Suffixes of the "{T}No/Number/Code" rule.
CODE_SUFFIXES = ["No", "Number", "Code", "_No", "_Number", "_Code"]

# Base confidence (in hundredths) of each naming pattern.
PATTERN_CONFIDENCE = {1: 90, 2: 80, 3: 70, 5: 75, 6: 70, 7: 65}


def primary_key_lookup(columns: DataFrame) -> DataFrame:
    """Per table, the first primary-key column by ordinal, with its type."""
    pk = columns.filter(F.col("is_primary_key"))
    return pk.groupBy("database_name", "schema_name", "table_name").agg(
        F.min_by("column_name", "ordinal_position").alias("pk_column"),
        F.min_by("data_type", "ordinal_position").alias("pk_type"),
    )


def _name_struct(name, pattern, group, k1, k2):
    return F.struct(name.alias("cand_name"), F.lit(pattern).alias("pattern"), F.lit(group).alias("grp"),
                    k1.alias("k1"), F.lit(k2).alias("k2"))


def key_name_candidates(pk_tables: DataFrame) -> DataFrame:
    """Explode each keyed table into every column name that would reference it.

    Output: database_name, to_schema, to_table, to_column, to_type, cand_name (lower), pattern, grp, k1, k2.
    (grp, k1, k2) orders competing matches like the reference's rule order.
    """
    t = F.lower(F.col("table_name"))
    ends_s = t.endswith("s")
    single = F.when(ends_s, F.expr("substring(lower(table_name), 1, length(table_name) - 1)"))
    ends_us = t.endswith("_")
    single_ends_us = single.endswith("_")
    structs = [
        # pattern 1 / 2: {T}Id, {T}_Id, and the same with one trailing 's' dropped
        _name_struct(F.concat(t, F.lit("id")), 1, 1, t, 0),
        _name_struct(F.concat(t, F.lit("_id")), 1, 1, t, 0),
        _name_struct(F.concat(single, F.lit("id")), 2, 1, t, 1),
        _name_struct(F.concat(single, F.lit("_id")), 2, 1, t, 1),
        # pattern 3: FK_{T}
        _name_struct(F.concat(F.lit("fk_"), t), 3, 2, F.lit(""), 0),
    ]
    for i, p in enumerate(STRIP_PREFIXES):
        pl = F.lit(p.lower())
        k1 = F.lit(f"{i:02d}")
        structs += [
            # pattern 5: {prefix}{T}Id / {prefix}{T}_Id, or the plural table of {prefix}{T}Id
            _name_struct(F.when(~ends_us, F.concat(pl, t, F.lit("id"))), 5, 3, k1, 0),
            _name_struct(F.concat(pl, t, F.lit("_id")), 5, 3, k1, 0),
            _name_struct(F.when(~single_ends_us, F.concat(pl, single, F.lit("id"))), 5, 3, k1, 1),
            _name_struct(F.concat(pl, single, F.lit("_id")), 5, 3, k1, 1),
        ]
    structs += [
        # pattern 6: {T}Key / {T}_Key, or singular
        _name_struct(F.concat(t, F.lit("key")), 6, 4, t, 0),
        _name_struct(F.concat(t, F.lit("_key")), 6, 4, t, 0),
        _name_struct(F.concat(single, F.lit("key")), 6, 4, t, 1),
        _name_struct(F.concat(single, F.lit("_key")), 6, 4, t, 1),
    ]
    for j, suf in enumerate(CODE_SUFFIXES):
        # pattern 7: {T}No / Number / Code (with or without '_'), or singular
        structs.append(_name_struct(F.concat(t, F.lit(suf.lower())), 7, 5, t, 0))
        structs.append(_name_struct(F.concat(single, F.lit(suf.lower())), 7, 5, t, 1))
    out = pk_tables.select(
        "database_name",
        F.col("schema_name").alias("to_schema"), F.col("table_name").alias("to_table"),
        F.col("pk_column").alias("to_column"), F.col("pk_type").alias("to_type"),
        F.inline(F.array(*structs)),
    )
    return out.filter(F.col("cand_name").isNotNull())


def implicit_fks(columns: DataFrame, indexes: DataFrame | None = None,
                 foreign_keys: DataFrame | None = None) -> DataFrame:
    """Foreign keys suggested by column naming, with confidence in decimal(4,2).

    Output: database_name, from_schema, from_table, from_column, from_type, to_schema, to_table,
    to_column, to_type, pattern, type_match, leads_index, is_nullable, confidence, reason.
    """
    base = columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE")
    pk_tables = primary_key_lookup(base)
    cands = key_name_candidates(pk_tables)
    cols = base.filter(~F.coalesce(F.col("is_primary_key"), F.lit(False))).select(
        "database_name", F.col("schema_name").alias("from_schema"), F.col("table_name").alias("from_table"),
        F.col("column_name").alias("from_column"), F.col("data_type").alias("from_type"),
        F.coalesce(F.col("is_nullable"), F.lit(True)).alias("is_nullable"),
        F.lower(F.col("column_name")).alias("cand_name"),
    )
    matched = cols.join(cands, ["database_name", "cand_name"], "inner")
    same_schema = (F.lower(F.col("from_schema")) == F.lower(F.col("to_schema"))).cast("int")
    w = Window.partitionBy("database_name", "from_schema", "from_table", "from_column").orderBy(
        "grp", "k1", "k2", same_schema.desc(), F.lower(F.col("to_schema")), F.lower(F.col("to_table")))
    first = matched.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    typed = first.withColumn("type_match", type_match(F.col("from_type"), F.col("to_type"))).filter(
        F.col("type_match") != "mismatch")
    # No self reference through the key column itself
    typed = typed.filter(~((F.lower(F.col("from_table")) == F.lower(F.col("to_table")))
                           & (F.lower(F.col("from_column")) == F.lower(F.col("to_column")))))
    if indexes is not None:
        leads = indexes.filter(F.size("columns") > 0).select(
            "database_name", F.lower(F.col("schema_name")).alias("_ls"), F.lower(F.col("table_name")).alias("_lt"),
            F.lower(F.col("columns")[0]).alias("_lc")).distinct().withColumn("leads_index", F.lit(True))
        typed = typed.join(
            leads,
            (typed.database_name == leads.database_name) & (F.lower(typed.from_schema) == leads._ls)
            & (F.lower(typed.from_table) == leads._lt) & (F.lower(typed.from_column) == leads._lc),
            "left").drop(leads.database_name).drop("_ls", "_lt", "_lc")
        typed = typed.withColumn("leads_index", F.coalesce(F.col("leads_index"), F.lit(False)))
    else:
        typed = typed.withColumn("leads_index", F.lit(False))
    base_conf = F.element_at(F.create_map(*[x for kv in PATTERN_CONFIDENCE.items() for x in (F.lit(kv[0]),
                                                                                            F.lit(kv[1]))]),
                             F.col("pattern"))
    hundredths = (base_conf
                  - F.when(F.col("type_match") == "compatible", 10).otherwise(0)
                  + F.when(F.col("leads_index"), 5).otherwise(0)
                  + F.when(F.col("is_nullable"), -5).otherwise(5))
    conf = (F.least(hundredths, F.lit(95)).cast("decimal(6,0)") / F.lit(100)).cast("decimal(4,2)")
    out = typed.withColumn("confidence", conf)
    if foreign_keys is not None:
        fk = foreign_keys.select(
            "database_name",
            *[F.lower(F.col(c)).alias(f"_{c}") for c in
              ["from_schema", "from_table", "from_column", "to_schema", "to_table", "to_column"]]).distinct()
        cond = [out.database_name == fk.database_name] + [
            F.lower(out[c]) == fk[f"_{c}"]
            for c in ["from_schema", "from_table", "from_column", "to_schema", "to_table", "to_column"]]
        out = out.join(fk, reduce(lambda a, b: a & b, cond), "left_anti")
    reason = (F.when(F.col("pattern") == 1, F.format_string("name '%s' is table '%s' + Id", "from_column", "to_table"))
              .when(F.col("pattern") == 2, F.format_string("name '%s' is singular of table '%s' + Id",
                                                           "from_column", "to_table"))
              .when(F.col("pattern") == 3, F.format_string("name '%s' is FK_ + table '%s'", "from_column", "to_table"))
              .when(F.col("pattern") == 5, F.format_string("name '%s' is a role prefix + table '%s' + Id",
                                                           "from_column", "to_table"))
              .when(F.col("pattern") == 6, F.format_string("name '%s' is table '%s' + Key", "from_column", "to_table"))
              .otherwise(F.format_string("name '%s' is table '%s' + No/Number/Code", "from_column", "to_table")))
    return out.select(
        "database_name", "from_schema", "from_table", "from_column", "from_type", "to_schema", "to_table",
        "to_column", "to_type", F.col("pattern").cast("int").alias("pattern"), "type_match", "leads_index",
        "is_nullable", "confidence", reason.alias("reason"))


def fk_statement(rel: DataFrame) -> DataFrame:
    """The statement that would declare a suggested key."""
    name = F.format_string("FK_%s_%s_%s", "from_table", "to_table", "from_column")
    return rel.withColumn("statement", F.format_string(
        "ALTER TABLE [%s].[%s] ADD CONSTRAINT [%s] FOREIGN KEY ([%s]) REFERENCES [%s].[%s] ([%s]);",
        F.col("from_schema"), F.col("from_table"), name, F.col("from_column"), F.col("to_schema"),
        F.col("to_table"), F.col("to_column")))


def value_key(col: F.Column, dt: T.DataType) -> F.Column:
    """A text that is equal for two values exactly when they are equal, whatever numeric types hold them.

    Whole numbers, decimals and floating values become sign, whole digits and fraction without closing zeros.
    A whole floating value gives all its digits (up to 10^38); one with a fraction stands for the decimal number that
    it prints as. Other types keep their text; binary values are written in hexadecimal. Null stays null.
    """
    if isinstance(dt, T.IntegralType):
        return col.cast("string")
    if isinstance(dt, T.DecimalType):
        whole = F.floor(F.abs(col)).cast("decimal(38,0)").cast("string")
        if not dt.scale:
            return F.concat(F.when(col < 0, "-").otherwise(""), whole)
        # one is added so that the text never takes an exponent
        rest = F.substring((F.abs(col % F.lit(1).cast("decimal(1,0)")) + 1).cast(f"decimal({min(38, dt.scale + 2)},{min(36, dt.scale)})").cast("string"), 2, 40)
        return _signed(col < 0, whole, rest)
    if isinstance(dt, T.FractionalType):
        return _floating_key(col)
    return F.hex(col) if isinstance(dt, T.BinaryType) else col.cast("string")


def _signed(negative: F.Column, whole: F.Column, rest: F.Column) -> F.Column:
    return F.concat(F.when(negative, "-").otherwise(""), whole, F.rtrim(F.rtrim(rest, F.lit("0")), F.lit(".")))


def _floating_key(col: F.Column) -> F.Column:
    x, two = F.abs(col.cast("double")), float(1 << 64)
    long = F.floor(x / F.lit(two))
    below = x - long * F.lit(two)  # both parts are exact: they are scaled by a power of two
    half = F.floor(below / F.lit(float(1 << 32)))
    part = lambda c: c.cast("long").cast("decimal(38,0)")
    digits = (part(half) * F.lit(1 << 32).cast("decimal(10,0)")).cast("decimal(38,0)") + part(below - half * F.lit(float(1 << 32)))
    whole = F.when(x < F.lit(float(1 << 53)), x.cast("long").cast("string")).when(
        x < F.lit(1e38), ((part(long) * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") + digits).cast("decimal(38,0)").cast("string"))
    text = F.regexp_replace(F.abs(col).cast("string"), "E.*", "")  # of the value's own type
    point = F.coalesce(F.regexp_extract(F.abs(col).cast("string"), "E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    ahead, behind = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    every = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), -point)), ahead, behind)
    at = F.length(ahead) + F.greatest(F.lit(0), point)
    split = _signed(col < 0, F.regexp_replace(F.substring(every, F.lit(1), at), "^0+(?=[0-9])", ""), F.concat(F.lit("."), F.substring(every, at + 1, F.length(every))))
    return F.when(F.isnan(col) | (x == F.lit(float("inf"))) | (x >= F.lit(1e38)), col.cast("string")).when(
        x % F.lit(1.0) == 0, F.concat(F.when(col < 0, "-").otherwise(""), whole)).otherwise(split)


def orphan_check(candidates: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Check candidate keys on the data: child rows, nulls, orphan rows and values, match rate.

    ``candidates`` has from_table, from_column, to_table, to_column. ``tables`` is keyed by table name, or by
    (database, schema, table): then ``candidates`` also has database_name, from_schema and to_schema, and so
    has the result, and tables of one name in two schemas or databases stay apart. The candidate
    list is catalog metadata and is read on the driver to build the plan; the data is not. Every child table
    is read once with all its candidate columns stacked into (candidate, value) and pre-aggregated per value,
    so hot values cost one row per task; parents are stacked and deduplicated the same way, and one join on
    (candidate, value) finds the orphans of all candidates together.
    """
    full = any(isinstance(k, tuple) for k in tables)
    names = (["database_name", "from_schema", "to_schema"] if full else []) + ["from_table", "from_column", "to_table", "to_column"]
    at = (lambda r, side: (r.database_name, r[f"{side}_schema"], r[f"{side}_table"])) if full else (lambda r, side: r[f"{side}_table"])
    cand_rows = candidates.select(*names).distinct().orderBy(*names).collect()
    if not cand_rows:  # nothing suggested or declared: an empty result
        return candidates.sparkSession.createDataFrame(
            [], ", ".join(f"{c} string" for c in names) + ", child_rows long, "
                "null_rows long, orphan_rows long, orphan_values long, match_rate double")
    by_child, by_parent = defaultdict(list), defaultdict(list)
    for cid, r in enumerate(cand_rows):
        c, p = tables[at(r, "from")], tables[at(r, "to")]
        child_text = value_key(F.col(f"`{r.from_column}`"), c.schema[r.from_column].dataType)
        parent_text = value_key(F.col(f"`{r.to_column}`"), p.schema[r.to_column].dataType)
        by_child[at(r, "from")].append((cid, child_text))
        by_parent[at(r, "to")].append((cid, parent_text))

    def stacked(table, items):
        return tables[table].select(F.inline(F.array(*[
            F.struct(F.lit(cid).alias("cand_id"), text.alias("v")) for cid, text in items])))

    child = reduce(DataFrame.unionByName, [stacked(t, it) for t, it in by_child.items()])
    child = child.groupBy("cand_id", "v").agg(F.count(F.lit(1)).alias("n"))
    parent = reduce(DataFrame.unionByName, [stacked(t, it) for t, it in by_parent.items()])
    parent = parent.filter(F.col("v").isNotNull()).distinct().withColumn("found", F.lit(True))
    joined = child.join(parent, ["cand_id", "v"], "left")
    orphan = F.col("v").isNotNull() & F.col("found").isNull()
    stats = joined.groupBy("cand_id").agg(
        F.sum("n").alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_values"),
    )
    listed = candidates.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(cand_rows)],
                                                     "cand_id int, " + ", ".join(f"{c} string" for c in names))
    out = listed.join(stats, "cand_id", "left")
    nn = F.col("child_rows") - F.col("null_rows")
    return out.select(
        *names,
        F.coalesce(F.col("child_rows"), F.lit(0)).cast("long").alias("child_rows"),
        F.coalesce(F.col("null_rows"), F.lit(0)).cast("long").alias("null_rows"),
        F.coalesce(F.col("orphan_rows"), F.lit(0)).cast("long").alias("orphan_rows"),
        F.coalesce(F.col("orphan_values"), F.lit(0)).cast("long").alias("orphan_values"),
        F.when(F.coalesce(nn, F.lit(0)) == 0, F.lit(None).cast("double"))
        .otherwise((nn - F.col("orphan_rows")).cast("double") / nn).alias("match_rate"),
    )


def ordered_suggestions(implicit: DataFrame) -> DataFrame:
    """Suggested keys from the surest to the least sure, then by name, with their place (from 1)."""
    order = [F.col("confidence").desc(), F.col("from_table"), F.col("from_column"), F.col("to_table")]
    return ranked(implicit, order, "_rank0").withColumn("rank", F.col("_rank0") + 1).drop("_rank0")


__all__ = ["ordered_suggestions", "value_key", "primary_key_lookup", "key_name_candidates", "implicit_fks", "fk_statement", "orphan_check",
           "type_family"]
