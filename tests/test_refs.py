"""Dependency extraction from SQL text on the shop catalog."""

from pyspark.sql import functions as F

from lakescope.operators import estate as ES
from lakescope.operators import graph as G
from lakescope.operators import refs as E
from tests import shop
from tests.conftest import rows

EXPECTED = sorted([
    ("sales.vClientInvoices", "sales.Clients", "Table", None, "recorded dependency"),
    ("sales.vClientInvoices", "sales.Invoices", "Table", None, "SQL: FROM/JOIN"),
    ("sales.vTop", "sales.vClientInvoices", "View", None, "SQL: FROM/JOIN"),
    ("sales.usp_Archive", "sales.Audit_Log", "Table", None, "recorded dependency"),
    ("sales.usp_Archive", "sales.Invoices", "Table", None, "SQL: FROM/JOIN"),
    ("sales.usp_Archive", "sales.usp_Log", "Procedure", None, "SQL: EXEC"),
    ("sales.usp_Archive", "stock.Product", "Table", None, "SQL: FROM/JOIN"),
    ("sales.usp_Remote", "dbo.Customers", "External", "OtherDb", "SQL: FROM/JOIN"),
    ("sales.usp_Remote", "dbo.Orders", "External", "OtherDb", "SQL: FROM/JOIN"),
    ("sales.usp_Remote", "sales.Regions", "Table", None, "SQL: FROM/JOIN"),
    ("sales.usp_Dynamic", "stock.Nodes", "Table", None, "SQL: FROM/JOIN"),
    ("sales.fn_Total", "sales.Invoices", "Table", None, "SQL: FROM/JOIN"),
    ("sales.trg_Clients_Upd", "sales.Clients", "Table", None, "Trigger parent"),
    ("job.Nightly", "sales.usp_Archive", "Procedure", None, "SQL: EXEC"),
    ("job.Nightly", "sales.Temp_Import", "Table", None, "SQL: FROM/JOIN"),
    ("sales.syn_Prod", "stock.Product", "Table", None, "Synonym base object"),
    ("sales.syn_Ext", "dbo.Customers", "External", "OtherDb", "Synonym base object"),
    ("sales.syn_Self", "sales.vTop", "View", None, "Synonym base object"),
])


def _edges(spark):
    f = shop.frames(spark)
    known = E.known_objects(f["columns"], f["views"], f["procedures"], f["functions"], f["synonyms"])
    aliases = E.name_aliases(known)
    defs = E.definitions(f["views"], f["procedures"], f["functions"], f["triggers"], f["job_steps"])
    return E.object_dependencies(aliases, defs, f["triggers"], f["synonyms"], f["object_dependencies"])


def test_object_dependencies(spark):
    e = _edges(spark)
    got = rows(e.select(F.concat_ws(".", "from_schema", "from_name"), F.concat_ws(".", "to_schema", "to_name"),
                        "to_type", "to_database", "detected_via"))
    assert set(got) == set(EXPECTED) and len(got) == len(EXPECTED)


def test_dynamic_literal_is_scanned(spark):
    """A reference that exists only inside a literal is found with the dynamic label."""
    from lakescope.sources import catalog as C
    f = shop.frames(spark)
    procs = C.frame(spark, "procedures", [
        (shop.DB, "sales", "usp_Q", "DECLARE @s nvarchar(100) = 'SELECT * FROM ' + 'stock.Warehouse w';"
                                    " EXEC(N'SELECT 1 FROM [stock].[Product] p WHERE p.Id = 1')", None)])
    aliases = E.name_aliases(E.known_objects(f["columns"]))
    res = E.resolve_refs(E.extract_refs(E.definitions(procedures=procs)), aliases)
    got = rows(res, "to_name", "via")
    assert ("Product", "SQL: FROM/JOIN") in got
    assert all(v in ("SQL: FROM/JOIN", "SQL: FROM/JOIN (dynamic)") for _, v in got)


def test_unicode_word_class(spark):
    """Accented identifiers are whole words (the .NET word class is Unicode)."""
    df = spark.createDataFrame([("x", "SELECT * FROM dbo.Émissions e JOIN Ñame n ON 1=1")], "id string, text string")
    got = rows(E.extract_refs(df, id_cols=["id"]), "clean")
    assert set(got) == {("Ñame",), ("dbo.Émissions",)}


def test_graph_with_external_placeholders(spark):
    """D-2 / D-3: FK and object edges together; external targets become nodes; impact follows edges back."""
    f = shop.frames(spark)
    e = _edges(spark)
    fk = f["foreign_keys"].select(F.concat_ws(".", "from_schema", "from_table").alias("src"),
                                  F.concat_ws(".", "to_schema", "to_table").alias("dst"))
    obj = e.select(F.concat_ws(".", "from_schema", "from_name").alias("src"), E.to_full_name().alias("dst"))
    edges = fk.unionByName(obj).distinct()
    closure = G.reachable(edges)
    imp = {r.node: r for r in G.importance(edges, closure).collect()}
    # Clients: referenced by Invoices (FK), vClientInvoices, trg_Clients_Upd; vTop and syn_Self above the view
    assert imp["sales.Clients"].referenced_by == 3
    # impact: Invoices, vClientInvoices, trigger, then usp_Archive, fn_Total, vTop, syn_Self, job.Nightly
    assert imp["sales.Clients"].impact == 8
    assert "OtherDb.dbo.Customers" in imp and imp["OtherDb.dbo.Customers"].referenced_by == 2


def test_table_mentions(spark):
    """Word-bounded, case-insensitive mentions; a text counts once per table."""
    f = shop.frames(spark)
    logs = spark.createDataFrame([
        (shop.DB, "select * from SALES.clients c join clients d", 5, None),
        (shop.DB, "select * from clientsx", 7, None),
        (shop.DB, "update dbo.Regions_old set x=1", 11, None),
        (shop.DB, "select 1 from x.regions", 13, None),
    ], "database_name string, query_text string, total_executions long, last_execution timestamp")
    got = rows(E.table_mentions(logs, f["columns"]), "table_name", "executions", "n_texts")
    assert got == [("Clients", 5, 1), ("Regions", 13, 1)]


def test_mentions_of_names_of_any_characters(spark):
    """Names with blanks, hyphens, points, brackets and quotes; word boundaries; names without a word."""
    import re
    names = ["order details", "order-lines", "details", "x", "a.b.c", "[odd] name", "it's", "\\e end", "--", "élan vital", "c++", "order"]
    texts = ["select * from [order details] d", "order  details", "reorder details", "order-lines2 order-lines", "a.b.cd a.b.c", "the [odd] name", "odd name",
             "it's x", "x_y", "go \\e end", "a -- b", "élan vitale", "élan vital", "c++11 c++ d", "order", "", "details,order details"]
    t = spark.createDataFrame([("d", f"t{i}", x) for i, x in enumerate(texts)] + [("other", "t0", "order details")], "database_name string, text_id string, text string")
    n = spark.createDataFrame([("d", x) for x in names], "database_name string, name string")
    word = r"[^\W]"
    expected = sorted(("d", f"t{i}", x) for i, text in enumerate(texts) for x in names if re.search(rf"(?<!{word}){re.escape(x)}(?!{word})", text))
    assert rows(E.mentions(t, n)) == expected and len(expected) > 14


def test_stamp_and_qualify(spark):
    """B1 / B2: stamped names; names with fewer than two dots get the database prefix."""
    df = spark.createDataFrame([("dbo.Customers", ["App.dbo.LineItems", "dbo.Invoices"])],
                               "depends_on string, impact array<string>")
    out = ES.qualify_columns(ES.stamp(df, "App"), ["depends_on", "impact"]).collect()[0]
    assert out.depends_on == "App.dbo.Customers"
    assert out.impact == ["App.dbo.LineItems", "App.dbo.Invoices"]


def test_resolve_external_when_analysed(spark):
    """An external target whose database was analysed becomes local (keeps its own database)."""
    e = spark.createDataFrame([("Shared", "External"), ("Other", "External")], "to_database string, to_type string")
    analysed = spark.createDataFrame([("Shop",), ("Shared",)], "database_name string")
    got = rows(ES.resolve_external(e, analysed), "to_database", "to_type")
    assert got == [("Other", "External"), ("Shared", "Table")]


def test_long_bodies_keep_the_scan_order(spark):
    """A body with thousands of literals: every reference is found, and the first place wins the merge."""
    from lakescope.operators import refs as X
    text = "EXEC dbo.t1 " + " ".join(f"'SELECT 1 FROM dbo.t{i % 3} WHERE a = {i}'" for i in range(3000))
    defs = spark.createDataFrame([("d", "dbo", "p", "Procedure", text, 0)],
                                 "database_name string, from_schema string, from_name string, from_type string, text string, step int")
    known = spark.createDataFrame([("d", "dbo", f"t{i}", "Table") for i in range(3)], "database_name string, schema_name string, object_name string, object_type string")
    edges = X.object_dependencies(X.name_aliases(known), defs).collect()
    assert {(e.to_name, e.detected_via) for e in edges} == {(f"t{i}", "SQL: FROM/JOIN") for i in range(3)}  # the whole text, literals included, is scanned first
    assert X.extract_refs(defs).count() == 6001


def test_tokens_of_a_long_run_are_few(spark):
    from lakescope.operators import refs as X
    run = ".".join(f"p{i}" for i in range(800))
    n = spark.createDataFrame([(run,)], "t string").select(F.size(X.word_tokens(F.col("t"))).alias("n")).first().n
    assert n == 1599
