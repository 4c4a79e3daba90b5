"""Catalog assembly, diagram tables, graph filters, counters and the session-catalog reader."""

from pyspark.sql import functions as F

from lakescope.operators import access as A
from lakescope.operators import catalog_ops as CO
from lakescope.operators import diagram as V
from lakescope.operators import refs as E
from lakescope.operators import relations as R
from lakescope.operators import usage as U
from lakescope.sources import catalog as C
from tests import shop
from tests.conftest import rows


def test_assemble_and_overview(spark):
    f = shop.frames(spark)
    t = {r.table_name: r for r in CO.assemble_tables(f["columns"], f["indexes"], f["foreign_keys"]).collect()}
    assert [c.column_name for c in t["Clients"].columns] == ["Id", "FullName", "RegionId", "Status", "Notes"]
    assert len(t["InvoiceLines"].indexes) == 3 and len(t["Invoices"].foreign_keys) == 1
    assert "vClientInvoices" not in t
    ov = {r.table_name: r for r in CO.table_overview(f["columns"], f["indexes"], f["foreign_keys"]).collect()}
    assert (ov["InvoiceLines"].n_columns, ov["InvoiceLines"].n_indexes, ov["InvoiceLines"].primary_key) == (4, 3, "Id")
    assert ov["Temp_Import"].primary_key == ""
    v = CO.views_with_columns(f["columns"], f["views"]).filter("table_name = 'vClientInvoices'").first()
    assert [c.column_name for c in v.columns] == ["FullName", "Total"]


def test_object_inventory_and_ddl(spark):
    f = shop.frames(spark)
    inv = CO.object_inventory(f["columns"], f["views"], f["procedures"], f["functions"], f["triggers"], f["synonyms"])
    kinds = dict(rows(inv.groupBy("object_type").count()))
    assert kinds == {"Table": 10, "View": 2, "Procedure": 4, "Function": 2, "Trigger": 1, "Synonym": 3}
    ddl = CO.ddl_text(f["columns"]).filter("table_name = 'Clients'").first().ddl
    assert "[Notes] nvarchar(MAX) NULL" in ddl and "[RegionId] int NOT NULL" in ddl
    assert ddl.endswith("PRIMARY KEY ([Id])\n);")


def test_jobs(spark):
    jobs = C.frame(spark, "jobs", [(shop.DB, "Nightly", "", True, None, None), (shop.DB, "Other", "", True, None, None)])
    steps = C.frame(spark, "job_steps", shop.JOB_STEPS)
    inv = {r.job_name: r for r in CO.job_inventory(jobs, steps).collect()}
    assert [s.step_id for s in inv["Nightly"].steps] == [1, 2] and inv["Other"].steps == []
    assert rows(CO.jobs_touching(jobs, steps, "shopdb"), "job_name") == [("Nightly",)]


def test_diagram_tables(spark):
    f = shop.frames(spark)
    rel = R.implicit_fks(f["columns"], f["indexes"], f["foreign_keys"])
    flags = {(r.table, r.column_name): (r.pk, r.fk, r.sfk) for r in
             V.column_flags(f["columns"], f["foreign_keys"], rel).collect()}
    assert flags[("sales.Invoices", "ClientId")] == (False, True, False)
    assert flags[("sales.Clients", "RegionId")] == (False, False, True)
    assert flags[("sales.Clients", "Id")] == (True, False, False)
    known = E.known_objects(f["columns"], f["views"], f["procedures"], f["functions"], f["synonyms"])
    obj = E.object_dependencies(E.name_aliases(known), E.definitions(f["views"], f["procedures"], f["functions"],
                                                                     f["triggers"], f["job_steps"]),
                                f["triggers"], f["synonyms"])
    edges = V.diagram_edges(f["foreign_keys"], obj, rel)
    by = {(r.src, r.dst): (r.edge_type, r.label) for r in edges.collect()}
    assert by[("sales.Invoices", "sales.Clients")] == ("fk", "FK: FK_Invoices_Clients")
    assert by[("sales.vTop", "sales.vClientInvoices")] == ("view", "reads from")
    assert by[("sales.usp_Remote", "OtherDb.dbo.Customers")][0] == "external"
    assert by[("sales.Clients", "sales.Regions")][0] == "implicit"
    assert ("stock.InvoiceLines", "stock.Product") not in by
    # 0.65 suggestions are not drawn
    assert ("sales.InvoiceLines", "stock.Product") not in by
    nodes = V.graph_nodes(known, obj)
    ext = rows(nodes.filter("node_type = 'External'"), "node", "external_database")
    assert ext == [("OtherDb.dbo.Customers", "OtherDb"), ("OtherDb.dbo.Orders", "OtherDb")]
    n2, e2 = V.filter_graph(nodes, edges, node_types=["Table", "View"])
    assert e2.filter(F.col("edge_type").isin("procedure", "external")).count() == 0
    assert e2.count() > 0 and n2.filter("node_type = 'Procedure'").count() == 0


def test_counters(spark):
    idx = C.frame(spark, "indexes", shop.INDEXES)
    cnt = spark.createDataFrame([(shop.DB, "sales", "Clients", "IX_Clients_Name_A", 3, 0, 0, 5),
                                 (shop.DB, "sales", "Clients", "IX_Clients_Name_A", 1, 0, 0, 0)],
                                "database_name string, schema_name string, table_name string, index_name string, "
                                "user_seeks long, user_scans long, user_lookups long, user_updates long")
    inv = {r.index_name: r for r in A.usage_inventory(idx, cnt).collect()}
    assert (inv["IX_Clients_Name_A"].user_seeks, inv["IX_Clients_Name_A"].user_updates) == (4, 5)
    assert inv["IX_Lines_Invoice"].user_seeks == 0
    procs = C.frame(spark, "procedures", shop.PROCEDURES).select(
        "database_name", "schema_name", F.col("procedure_name").alias("name"))
    stats = spark.createDataFrame([(shop.DB, "sales", "usp_Log", 7, None)], "database_name string, schema_name string,"
                                  " name string, execution_count long, last_execution timestamp")
    ex = dict(rows(U.execution_counters(procs, stats, ["database_name", "schema_name", "name"]), "name",
                   "execution_count"))
    assert ex == {"usp_Archive": 0, "usp_Log": 7, "usp_Remote": 0, "usp_Dynamic": 0}


def test_session_catalog_reader(spark):
    from lakescope.sources.spark_catalog import read_session_catalog
    spark.range(3).selectExpr("id AS Id", "'x' AS Name").createOrReplaceTempView("tmp_people")
    cat = read_session_catalog(spark, ["default"], include_temporary=True)
    got = rows(cat["columns"].filter("table_name = 'tmp_people'"), "column_name", "data_type", "ordinal_position")
    assert got == [("Id", "bigint", 1), ("Name", "string", 2)]


def test_view_texts_and_dependencies_of_the_session_catalog(spark, tmp_path):
    """Texts of several lines, and edges between the views and tables of two namespaces."""
    from lakescope.sources.spark_catalog import read_session_catalog, view_dependencies
    try:
        for db in ("cat_a", "cat_b"):
            spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path}/{db}'")
        spark.sql("CREATE TABLE cat_a.people (id int, name string) USING parquet")
        spark.sql("CREATE VIEW cat_a.named AS SELECT id,\n 'View Original Text' AS note\nFROM cat_a.people")
        spark.sql("CREATE VIEW cat_b.both AS SELECT * FROM cat_a.named JOIN cat_a.people USING (id)")
        cat = read_session_catalog(spark, ["cat_a", "cat_b"])
        assert rows(cat["views"], "schema_name", "view_name", "definition") == [
            ("cat_a", "named", "SELECT id,\n 'View Original Text' AS note\nFROM cat_a.people"), ("cat_b", "both", "SELECT * FROM cat_a.named JOIN cat_a.people USING (id)")]
        got = rows(view_dependencies(spark, ["cat_a", "cat_b"]), "from_schema", "from_name", "to_schema", "to_name", "to_type")
        assert got == [("cat_a", "named", "cat_a", "people", "Table"), ("cat_b", "both", "cat_a", "named", "View"), ("cat_b", "both", "cat_a", "people", "Table")]
    finally:
        for db in ("cat_a", "cat_b"):
            spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_index_trigger_type_job_assembly(spark):
    ic = spark.createDataFrame([
        ("d", "s", "T", "IX_a", "NONCLUSTERED", False, False, "B", 2, False),
        ("d", "s", "T", "IX_a", "NONCLUSTERED", False, False, "A", 1, False),
        ("d", "s", "T", "IX_a", "NONCLUSTERED", False, False, "C", 0, True)],
        "database_name string, schema_name string, table_name string, index_name string, index_type string, "
        "is_unique boolean, is_clustered boolean, column_name string, key_ordinal int, is_included boolean")
    assert CO.assemble_indexes(ic).first().columns == ["A", "B"]
    cols = spark.createDataFrame([("d", "s", "T", 1, "x"), ("d", "s", "T", 2, "y"), ("d", "s", "T", 3, "z")],
                                 "database_name string, schema_name string, table_name string, ordinal_position int, "
                                 "column_name string")
    ix = spark.createDataFrame([("d", "s", "T", "IX", "btree", True, False, [3, 1])],
                               "database_name string, schema_name string, table_name string, index_name string, "
                               "index_type string, is_unique boolean, is_clustered boolean, key_positions array<int>")
    assert CO.indexes_from_positions(ix, cols).first().columns == ["z", "x"]
    te = spark.createDataFrame([("d", "s", "tr", "T", "AFTER", "delete", True, "x"),
                                ("d", "s", "tr", "T", "AFTER", "insert", True, "x")],
                               "database_name string, schema_name string, trigger_name string, parent_table string, "
                               "trigger_type string, event string, is_enabled boolean, definition string")
    assert CO.assemble_triggers(te).first().trigger_events == "INSERT, DELETE"
    ut = spark.createDataFrame([("d", "s", "money_t"), ("d", "s", "row_t")],
                               "database_name string, schema_name string, type_name string")
    assert rows(CO.standalone_types(ut, ut.filter("type_name = 'row_t'")), "type_name") == [("money_t",)]
    jh = spark.createDataFrame([("d", "J", 20240105), ("d", "J", 20240301)],
                               "database_name string, job_name string, run_date int")
    assert str(CO.job_last_run(jh).first().last_run_date) == "2024-03-01"


def test_shipped_objects_are_left_out(spark):
    """flagged objects and system schemas go; an unset flag or schema stays."""
    from lakescope.operators import catalog_ops as CO
    df = spark.createDataFrame([("dbo", "a", True), ("dbo", "b", False), ("dbo", "c", None), ("SYS", "d", False), (None, "e", None), ("pg_catalog", "f", None)],
                               "schema_name string, object_name string, is_shipped boolean")
    assert rows(CO.user_objects(df), "object_name") == [("b",), ("c",), ("e",)]
    assert rows(CO.user_objects(df.drop("is_shipped")), "object_name") == [("a",), ("b",), ("c",), ("e",)]


def test_edge_table(spark):
    """D-2: foreign keys stand before object edges, names compare without case, external targets are nodes, unknown ends are told."""
    from lakescope.operators import diagram as V
    fks = spark.createDataFrame([("d", "dbo", "Orders", "dbo", "Clients"), ("d", "dbo", "Orders", "dbo", "Clients"), ("d", "dbo", "gone", "dbo", "lost")],
                                "database_name string, from_schema string, from_table string, to_schema string, to_table string")
    refs = spark.createDataFrame([("d", "DBO", "orders", "dbo", "CLIENTS", None), ("d", "dbo", "v", "dbo", "Orders", None), ("d", "dbo", "v", "s", "x", "Other"), ("d", "dbo", "v", "dbo", "lost", None)],
                                 "database_name string, from_schema string, from_name string, to_schema string, to_name string, to_database string")
    objects = spark.createDataFrame([("d", "dbo", n) for n in ("Orders", "Clients", "v")], "database_name string, schema_name string, object_name string")
    assert rows(V.edge_table(fks, refs, objects), "src", "dst", "kind", "src_known", "dst_known") == [
        ("dbo.Orders", "dbo.Clients", "foreign key", True, True), ("dbo.v", "Other.s.x", "object", True, True),
        ("dbo.v", "dbo.Orders", "object", True, True), ("dbo.v", "dbo.lost", "object", True, False)]
