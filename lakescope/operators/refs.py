"""Object dependencies from SQL text: FROM/JOIN and EXEC references, dynamic SQL in literals,
trigger parents, job steps, synonyms; resolved against the known-object catalog and merged.

Extraction is a column expression (``regexp_extract_all`` + ``explode``) over a definitions table;
resolution is an equi-join of the cleaned reference on ``lower(name)`` against an alias table of
known objects (bare and schema-qualified names). Nothing is looped on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescope.functions.names import strip_brackets
from lakescope.session import cut_lineage

# The reference-extraction patterns. Word and space classes are spelled out as Unicode
# classes so that Java's and RE2's ASCII defaults do not change what a "word" is.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
#: A character that continues a name in a log text: letter, digit or '_'.
NAME_CHARACTER = r"[\p{L}\p{Nd}_]"
SPACE = r"[\t\n\x{0B}\f\r\x{85}\p{Z}]"
FROM_JOIN_PATTERN = (r"(?i)(?:FROM|JOIN)" + SPACE + r"+((?:\[?" + WORD + r"+\]?\.)?(?:\[?" + WORD
                     + r"+\]?\.)?(?:\[?" + WORD + r"+\]?\.)?(?:\[?" + WORD + r"+\]?))")
EXEC_PATTERN = (r"(?i)(?:EXEC|EXECUTE)" + SPACE + r"+((?:\[?" + WORD + r"+\]?\.)?(?:\[?" + WORD
                + r"+\]?\.)?(?:\[?" + WORD + r"+\]?))")
LITERAL_PATTERN = r"N?'((?:[^']|'')*)'"
# Fixed value: literals no longer than this are not scanned as dynamic SQL.
MIN_LITERAL_LENGTH = 10

# Order in which the reference fills its name dictionary (a later kind wins a name clash).
KNOWN_KIND_ORDER = {"Table": 0, "View": 1, "Procedure": 2, "Function": 3, "Synonym": 4}
DEFINITION_KIND_ORDER = {"View": 0, "Procedure": 1, "Function": 2, "Trigger": 3, "Job": 4}

EDGE_COLUMNS = ["database_name", "from_schema", "from_name", "from_type", "to_schema", "to_name", "to_type",
                "to_database", "detected_via"]


def definitions(views: DataFrame | None = None, procedures: DataFrame | None = None,
                functions: DataFrame | None = None, triggers: DataFrame | None = None,
                job_steps: DataFrame | None = None) -> DataFrame:
    """One row per object body: database_name, from_schema, from_name, from_type, text, step."""
    parts = []
    if views is not None:
        parts.append(views.select("database_name", F.col("schema_name").alias("from_schema"),
                                  F.col("view_name").alias("from_name"), F.lit("View").alias("from_type"),
                                  F.col("definition").alias("text"), F.lit(0).alias("step")))
    if procedures is not None:
        parts.append(procedures.select("database_name", F.col("schema_name").alias("from_schema"),
                                       F.col("procedure_name").alias("from_name"), F.lit("Procedure").alias("from_type"),
                                       F.col("definition").alias("text"), F.lit(0).alias("step")))
    if functions is not None:
        parts.append(functions.select("database_name", F.col("schema_name").alias("from_schema"),
                                      F.col("function_name").alias("from_name"), F.lit("Function").alias("from_type"),
                                      F.col("definition").alias("text"), F.lit(0).alias("step")))
    if triggers is not None:
        parts.append(triggers.select("database_name", F.col("schema_name").alias("from_schema"),
                                     F.col("trigger_name").alias("from_name"), F.lit("Trigger").alias("from_type"),
                                     F.col("definition").alias("text"), F.lit(0).alias("step")))
    if job_steps is not None:
        parts.append(job_steps.select("database_name", F.lit("job").alias("from_schema"),
                                      F.col("job_name").alias("from_name"), F.lit("Job").alias("from_type"),
                                      F.col("command").alias("text"), F.col("step_id").alias("step")))
    out = reduce(DataFrame.unionByName, parts)
    return out.filter(F.col("text").isNotNull() & (F.trim(F.col("text")) != ""))


def string_literals(text) -> F.Column:
    """Contents of the quoted literals of a text, '' unescaped, longer than MIN_LITERAL_LENGTH."""
    lits = F.regexp_extract_all(text, F.lit(LITERAL_PATTERN), 1)
    lits = F.transform(lits, lambda s: F.replace(s, F.lit("''"), F.lit("'")))
    return F.filter(lits, lambda s: F.length(s) > MIN_LITERAL_LENGTH)


def extract_refs(defs: DataFrame, text_col: str = "text", id_cols: list[str] | None = None,
                 dynamic: bool = True) -> DataFrame:
    """Every FROM/JOIN and EXEC reference in each text and in its literals.

    Output: the id columns, kind ('from_join' | 'exec'), is_dynamic, via, reference (as written),
    clean (brackets removed), parts (array), n_parts, pos (order of appearance within the source).
    """
    ids = id_cols or ["database_name", "from_schema", "from_name", "from_type", "step"]
    base = defs.select(*ids, F.col(text_col).alias("_text"))
    if dynamic:
        srcs = F.concat(F.array(F.struct(F.lit(False).alias("is_dynamic"), F.col("_text").alias("src"))),
                        F.transform(string_literals(F.col("_text")),
                                    lambda s: F.struct(F.lit(True).alias("is_dynamic"), s.alias("src"))))
    else:
        srcs = F.array(F.struct(F.lit(False).alias("is_dynamic"), F.col("_text").alias("src")))
    per_src = base.select(*ids, F.posexplode(srcs).alias("src_pos", "s")).select(
        *ids, "src_pos", F.col("s.is_dynamic").alias("is_dynamic"), F.col("s.src").alias("src"))
    found = lambda kind, pattern: F.transform(F.regexp_extract_all("src", F.lit(pattern), 1),
                                              lambda ref, pos: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), ref.alias("ref")))
    # both patterns in one reading of the text
    refs = per_src.select(*ids, "src_pos", "is_dynamic", F.explode(F.concat(
        found("from_join", FROM_JOIN_PATTERN), found("exec", EXEC_PATTERN))).alias("r")).select(*ids, "src_pos", "is_dynamic", "r.*")
    reference = F.trim(F.col("ref"))
    clean = F.trim(strip_brackets(reference))
    via = F.concat(F.when(F.col("kind") == "from_join", F.lit("SQL: FROM/JOIN")).otherwise(F.lit("SQL: EXEC")),
                   F.when(F.col("is_dynamic"), F.lit(" (dynamic)")).otherwise(F.lit("")))
    return refs.select(*ids, "kind", "is_dynamic", via.alias("via"), reference.alias("reference"),
                       clean.alias("clean"), F.split(clean, r"\.").alias("parts"),
                       F.size(F.split(clean, r"\.")).alias("n_parts"), "src_pos", "pos")


def known_objects(columns: DataFrame | None = None, views: DataFrame | None = None,
                  procedures: DataFrame | None = None, functions: DataFrame | None = None,
                  synonyms: DataFrame | None = None) -> DataFrame:
    """Known objects (database_name, schema_name, object_name, object_type)."""
    parts = []
    if columns is not None:
        parts.append(columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE").select(
            "database_name", "schema_name", F.col("table_name").alias("object_name"),
            F.lit("Table").alias("object_type")).distinct())
    for df, name_col, kind in [(views, "view_name", "View"), (procedures, "procedure_name", "Procedure"),
                               (functions, "function_name", "Function"), (synonyms, "synonym_name", "Synonym")]:
        if df is not None:
            parts.append(df.select("database_name", "schema_name", F.col(name_col).alias("object_name"),
                                   F.lit(kind).alias("object_type")))
    return reduce(DataFrame.unionByName, parts).distinct()


def name_aliases(known: DataFrame) -> DataFrame:
    """Alias table: every known object under its bare and schema-qualified name (lower-cased key).

    A name shared by several objects resolves to one: the kind filled last in the reference's
    dictionary wins, then the greater schema name (its catalog order is by schema).
    """
    kind_rank = F.element_at(F.create_map(*[x for k, v in KNOWN_KIND_ORDER.items() for x in (F.lit(k), F.lit(v))]),
                             F.col("object_type"))
    a = known.select("*", F.lower("object_name").alias("alias_key")).unionByName(
        known.select("*", F.lower(F.concat_ws(".", "schema_name", "object_name")).alias("alias_key")))
    w = Window.partitionBy("database_name", "alias_key").orderBy(kind_rank.desc(), F.col("schema_name").desc(),
                                                                 F.col("object_name").desc())
    return a.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def resolve_refs(refs: DataFrame, aliases: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """Name resolution.

    FROM/JOIN: 4+ parts -> External (database = third from last); 3 parts -> local if the first part is
    the current database and ``schema.name`` is known, else External; 1-2 parts -> local if known, else
    dropped. EXEC: known objects only. Output: ids, to_schema, to_name, to_type, to_database, via, rank keys.
    """
    ids = id_cols or ["database_name", "from_schema", "from_name", "from_type", "step"]
    p = F.col("parts")
    n = F.col("n_parts")
    is_fj = F.col("kind") == "from_join"
    local_key = (F.when(is_fj & (n == 3) & (F.lower(p[0]) == F.lower(F.col("database_name"))),
                        F.lower(F.concat_ws(".", p[1], p[2])))
                 .when(n <= 2, F.lower(F.col("clean"))))
    r = refs.withColumn("alias_key", local_key)
    al = aliases.select(F.col("database_name").alias("_db"), "alias_key",
                        F.col("schema_name").alias("k_schema"), F.col("object_name").alias("k_name"),
                        F.col("object_type").alias("k_type"))
    r = r.join(al, (r.database_name == al._db) & (r.alias_key == al.alias_key), "left").drop("_db").drop(
        al.alias_key)
    external4 = is_fj & (n >= 4)
    external3 = is_fj & (n == 3) & F.col("k_name").isNull()
    local = F.col("k_name").isNotNull()
    out = r.select(
        *ids, "via", "kind", "is_dynamic", "src_pos", "pos",
        F.when(local, F.col("k_schema")).when(external4, F.element_at(p, -2)).when(external3, p[1])
        .alias("to_schema"),
        F.when(local, F.col("k_name")).when(external4, F.element_at(p, -1)).when(external3, p[2]).alias("to_name"),
        F.when(local, F.col("k_type")).when(external4 | external3, F.lit("External")).alias("to_type"),
        F.when(local, F.lit(None).cast("string")).when(external4, F.element_at(p, -3)).when(external3, p[0])
        .alias("to_database"),
    )
    out = out.filter(F.col("to_name").isNotNull())
    # An object does not depend on itself
    self_ref = (F.col("to_database").isNull() & (F.lower("to_name") == F.lower("from_name"))
                & (F.lower("to_schema") == F.lower("from_schema")))
    return out.filter(~self_ref)


def trigger_parent_edges(triggers: DataFrame) -> DataFrame:
    """A trigger depends on its parent table."""
    return triggers.select(
        "database_name", F.col("schema_name").alias("from_schema"), F.col("trigger_name").alias("from_name"),
        F.lit("Trigger").alias("from_type"), F.col("schema_name").alias("to_schema"),
        F.col("parent_table").alias("to_name"), F.lit("Table").alias("to_type"),
        F.lit(None).cast("string").alias("to_database"), F.lit("Trigger parent").alias("detected_via"))


def parse_base_object(c) -> list[F.Column]:
    """C4: (database, schema, name) of a synonym target with 1-4 parts; default schema 'dbo'."""
    parts = F.split(F.translate(c, "[]", ""), r"\.")
    n = F.size(parts)
    db = F.when(n >= 4, F.element_at(parts, -3)).when(n == 3, parts[0])
    schema = F.when(n >= 3, F.element_at(parts, -2)).when(n == 2, parts[0]).otherwise(F.lit("dbo"))
    name = F.element_at(parts, -1)
    return [db, schema, name]


def synonym_edges(synonyms: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A synonym depends on its base object; External when in another database.

    The type of a local target is looked up among known objects (Table when unknown).
    """
    db, schema, name = parse_base_object(F.col("base_object_name"))
    s = synonyms.select("database_name", "schema_name", "synonym_name", db.alias("_tdb"), schema.alias("to_schema"),
                        name.alias("to_name"))
    s = s.withColumn("to_database", F.when(F.lower("_tdb") == F.lower("database_name"), F.lit(None))
                     .otherwise(F.col("_tdb")).cast("string"))
    if aliases is not None:
        al = aliases.select(F.col("database_name").alias("_db"), "alias_key", F.col("object_type").alias("k_type"))
        s = s.join(al, (s.database_name == al._db)
                   & (F.lower(F.concat_ws(".", "to_schema", "to_name")) == al.alias_key), "left").drop("_db",
                                                                                                 "alias_key")
    else:
        s = s.withColumn("k_type", F.lit(None).cast("string"))
    return s.select(
        "database_name", F.col("schema_name").alias("from_schema"), F.col("synonym_name").alias("from_name"),
        F.lit("Synonym").alias("from_type"), "to_schema", "to_name",
        F.when(F.col("to_database").isNotNull(), F.lit("External"))
        .otherwise(F.coalesce(F.col("k_type"), F.lit("Table"))).alias("to_type"),
        "to_database", F.lit("Synonym base object").alias("detected_via"))


def to_full_name():
    return F.when(F.col("to_database").isNotNull(),
                  F.concat_ws(".", "to_database", "to_schema", "to_name")).otherwise(
        F.concat_ws(".", "to_schema", "to_name"))


def scan_order(step, kind, source, place) -> F.Column:
    """A sort key for references: step, kind, which text or literal, place in it."""
    parts = {"step": step, "kind": kind, "source": source, "place": place}
    return F.struct(*[c.cast("long").alias(n) for n, c in parts.items()])


def merge_edges(recorded: DataFrame | None, parsed: DataFrame | None, synonyms: DataFrame | None) -> DataFrame:
    """Union the three sources; the first edge per from -> to (case-insensitive) wins,
    in source order recorded, parsed, synonym (and within parsed: the order of the scan)."""
    parts = []
    none = scan_order(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    if recorded is not None:
        parts.append(recorded.select(*[c for c in EDGE_COLUMNS if c != "detected_via"],
                                     F.lit("recorded dependency").alias("detected_via"),
                                     F.lit(0).alias("_s"), F.lit(0).alias("_k"), none.alias("_o")))
    if parsed is not None:
        parts.append(parsed.select(*EDGE_COLUMNS, F.lit(1).alias("_s"), F.col("_k"), F.col("_o")))
    if synonyms is not None:
        parts.append(synonyms.select(*EDGE_COLUMNS, F.lit(2).alias("_s"), F.lit(0).alias("_k"), none.alias("_o")))
    u = reduce(DataFrame.unionByName, parts)
    key = F.lower(F.concat(F.concat_ws(".", "from_schema", "from_name"), F.lit("->"), to_full_name()))
    w = Window.partitionBy("database_name", key).orderBy("_s", "_k", "_o")
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*EDGE_COLUMNS)


def parsed_edges(defs: DataFrame, aliases: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """Edges parsed from bodies (plus trigger parents), with scan-order keys for the merge."""
    refs = extract_refs(defs)
    res = resolve_refs(refs, aliases)
    kind_rank = F.element_at(F.create_map(*[x for k, v in DEFINITION_KIND_ORDER.items()
                                            for x in (F.lit(k), F.lit(v))]), F.col("from_type"))
    # scan order inside one body: FROM/JOIN refs (direct text, then literals) before EXEC refs
    order = scan_order(F.col("step"), F.when(F.col("kind") == "from_join", 0).otherwise(1), F.col("src_pos"), F.col("pos"))
    res = res.select(*[c for c in EDGE_COLUMNS if c != "detected_via"], F.col("via").alias("detected_via"),
                     kind_rank.alias("_k"), order.alias("_o"))
    if triggers is not None:
        tp = trigger_parent_edges(triggers).select("*", F.lit(DEFINITION_KIND_ORDER["Trigger"]).alias("_k"),
                                                   scan_order(F.lit(-1), F.lit(0), F.lit(0), F.lit(0)).alias("_o"))
        res = res.unionByName(tp)
    return res


def object_dependencies(aliases: DataFrame, defs: DataFrame, triggers: DataFrame | None = None,
                        synonyms: DataFrame | None = None, recorded: DataFrame | None = None) -> DataFrame:
    """The merged object-dependency edge table."""
    parsed = parsed_edges(defs, aliases, triggers)
    syn = synonym_edges(synonyms, aliases) if synonyms is not None else None
    return merge_edges(recorded, parsed, syn)


def word_tokens(text, max_parts: int = 2) -> F.Column:
    """Dotted word runs of a text: their contiguous sub-sequences of up to ``max_parts`` parts, lower-cased.

    A name of so many parts (bare or schema-qualified: two) occurs in a text with word boundaries
    (neighbours not letter, digit or '_') exactly when it equals one of these tokens. The number of
    tokens is linear in the text.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD + r"+(?:\." + WORD + r"+)*"), 0)
    def subseqs(run):
        parts = F.split(run, r"\.")
        n = F.size(parts)
        starts = F.sequence(F.lit(1), n)
        return F.flatten(F.transform(starts, lambda i: F.transform(
            F.sequence(i, F.least(n, i + (max_parts - 1))), lambda j: F.array_join(F.slice(parts, i, j - i + 1), ".")))
        )
    return F.array_distinct(F.flatten(F.transform(runs, subseqs)))


def name_words(name) -> F.Column:
    """The word runs of a lower-cased name, without repeats."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(NAME_CHARACTER + "+"), 0))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Which texts hold which names, as substrings with word boundaries (neighbours not letter, digit or '_').

    ``texts``: database_name, text_id, text (lower-case); ``names``: database_name, name (lower-case, of any
    characters). A name of words occurs only where all its words stand as whole words, so it is indexed under the
    rarest of them (by the number of texts); texts meet names on that word. A name that is one word is found
    then. Others are verified in place, in the texts that hold their rarest word; a text is read again only with
    such names. Names without a word are looked for in all texts of their database. Output: database_name,
    text_id, name; distinct.
    """
    listed = names.select("database_name", "name").distinct().withColumn("_words", name_words(F.col("name")))
    words = listed.select("database_name", "name", F.explode("_words").alias("word"))
    held = texts.select("database_name", "text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME_CHARACTER + "+"), 0))).alias("word"))
    held = cut_lineage(held.join(words.select("database_name", "word").distinct(), ["database_name", "word"], "left_semi"))
    counts = held.groupBy("database_name", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(counts, ["database_name", "word"], "left").groupBy("database_name", "name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w")).select("database_name", "name", F.col("w.word").alias("word"))
    met = held.join(rarest, ["database_name", "word"])
    single = met.filter(F.col("name") == F.col("word")).select("database_name", "text_id", "name")
    longer = met.filter(F.col("name") != F.col("word")).groupBy("database_name", "text_id").agg(F.collect_set("name").alias("names"))
    wordless = listed.filter(F.size("_words") == 0).groupBy("database_name").agg(F.collect_set("name").alias("names"))
    pattern = lambda n: F.concat(F.lit(rf"(?<!{NAME_CHARACTER})\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?!{NAME_CHARACTER})"))
    in_text = F.explode(F.filter("names", lambda n: F.contains(F.col("text"), n) & F.rlike(F.col("text"), pattern(n)))).alias("name")
    verified = texts.join(longer, ["database_name", "text_id"]).select("database_name", "text_id", in_text)
    others = texts.join(wordless, "database_name").select("database_name", "text_id", in_text)
    return single.unionByName(verified).unionByName(others)


def table_mentions(log_texts: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table, the executions of the log texts that mention it (bare or schema-qualified,
    word boundaries, case-insensitive), each text counted once per table; and the latest execution.

    Names may hold any characters (``mentions``), so the cost is linear in text size plus the texts in which
    a name's rarest word occurs.
    """
    tables = columns.filter(F.coalesce(F.col("table_type"), F.lit("BASE TABLE")) == "BASE TABLE").select(
        "database_name", "schema_name", "table_name").distinct()
    named = tables.select("*", F.lower("table_name").alias("name")).unionByName(
        tables.select("*", F.lower(F.concat_ws(".", "schema_name", "table_name")).alias("name")))
    # one row per distinct text (deterministic under retries; identical texts are read once)
    t = log_texts.withColumn("text_id", F.sha2("query_text", 256)).groupBy("database_name", "text_id").agg(
        F.lower(F.first("query_text")).alias("text"), F.sum("total_executions").alias("total_executions"), F.max("last_execution").alias("last_execution"))
    t = cut_lineage(t)
    found = mentions(t.select("database_name", "text_id", "text"), named)
    hits = found.join(named, ["database_name", "name"]).select("database_name", "schema_name", "table_name", "text_id").distinct()
    return hits.join(t.drop("text"), ["database_name", "text_id"]).groupBy("database_name", "schema_name", "table_name").agg(
        F.sum("total_executions").alias("executions"), F.max("last_execution").alias("last_execution"),
        F.count(F.lit(1)).alias("n_texts"))
