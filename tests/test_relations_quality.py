"""Naming rules, confidence, orphan checks and quality rules on the hand-made shop catalog."""

from pyspark.sql import functions as F

from lakescope.operators import access as A
from lakescope.operators import quality as Q
from lakescope.operators import relations as R
from tests import shop
from tests.conftest import rows


def test_implicit_foreign_keys(spark):
    f = shop.frames(spark)
    rel = R.implicit_fks(f["columns"], f["indexes"], f["foreign_keys"])
    got = rows(rel.withColumn("c", F.col("confidence").cast("string")),
               "from_table", "from_column", "to_table", "to_column", "pattern", "type_match", "leads_index", "c")
    assert got == sorted([
        ("Clients", "RegionId", "Regions", "Id", 2, "exact", False, "0.85"),
        ("InvoiceLines", "InvoiceID", "Invoices", "Id", 2, "compatible", True, "0.80"),
        ("InvoiceLines", "ProductKey", "Product", "Id", 6, "exact", False, "0.65"),
        ("Nodes", "ParentNodeId", "Nodes", "Id", 5, "exact", False, "0.70"),
        ("StockItems", "FK_Warehouse", "Warehouse", "Code", 3, "exact", False, "0.65"),
        ("StockItems", "ProductId", "Product", "Id", 1, "exact", False, "0.85"),
        ("StockItems", "SourceProductId", "Product", "Id", 5, "exact", False, "0.70"),
        ("StockItems", "WarehouseCode", "Warehouse", "Code", 7, "exact", False, "0.60"),
    ])
    # a type mismatch on the first name match drops the column; an explicit key is not suggested again
    names = {r.from_column for r in rel.collect()}
    assert "ClientNo" not in names and "ClientId" not in names


def test_id_upper_case_is_singular_pattern(spark):
    """'OrderID' on table 'Orders' scores as the singular pattern (the ID-variant rule never fires)."""
    from lakescope.sources import catalog as C
    cols = C.frame(spark, "columns", [
        shop.col("dbo", "Orders", "Id", "int", 1, pk=True, nullable=False),
        shop.col("dbo", "Invoices", "Id", "int", 1, pk=True, nullable=False),
        shop.col("dbo", "Invoices", "OrderID", "int", 2),
    ])
    rel = R.implicit_fks(cols).collect()
    assert [(r.from_column, r.pattern, str(r.confidence)) for r in rel] == [("OrderID", 2, "0.75")]


def test_dropping_one_s_only(spark):
    """Singular = drop one trailing 's': 'CategoryId' does not match 'Categories'."""
    from lakescope.sources import catalog as C
    cols = C.frame(spark, "columns", [
        shop.col("dbo", "Categories", "Id", "int", 1, pk=True, nullable=False),
        shop.col("dbo", "Items", "Id", "int", 1, pk=True, nullable=False),
        shop.col("dbo", "Items", "CategoryId", "int", 2),
        shop.col("dbo", "Items", "CategorieId", "int", 3),
    ])
    got = [r.from_column for r in R.implicit_fks(cols).collect()]
    assert got == ["CategorieId"]


def test_quality_issues(spark):
    f = shop.frames(spark)
    rel = R.implicit_fks(f["columns"], f["indexes"], f["foreign_keys"])
    iss = Q.quality_issues(f["columns"], f["indexes"], f["foreign_keys"], rel)
    by = {}
    for r in iss.collect():
        by.setdefault((r.category, r.severity), []).append(r.object_name)
    assert sorted(by[("Design", "Error")]) == ["sales.Temp_Import"]
    assert sorted(by[("Performance", "Warning")]) == ["sales.Invoices.ClientId"]
    assert sorted(by[("Naming", "Info")]) == ["sales.Audit_Log", "sales.Temp_Import"]
    assert sorted(by[("Naming", "Warning")]) == ["sales.Audit_Log.Action", "sales.Clients.Status",
                                                 "sales.Regions.Name"]
    assert len(by[("Design", "Info")]) == 1 + 8  # one unbounded text column, eight tables without keys
    assert sorted(by[("Referential Integrity", "Warning")]) == [
        "sales.Clients.RegionId", "sales.InvoiceLines.InvoiceID", "stock.StockItems.ProductId"]
    assert len(by[("Referential Integrity", "Info")]) == 5
    assert iss.count() == 24
    stmt = [r.recommendation for r in iss.collect() if r.object_name == "sales.Clients.RegionId"][0]
    assert stmt == ("ALTER TABLE [sales].[Clients] ADD CONSTRAINT [FK_Clients_Regions_RegionId] FOREIGN KEY "
                    "([RegionId]) REFERENCES [sales].[Regions] ([Id]);")


def test_orphan_check(spark):
    child = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None), (5, 99), (6, 99)], "id int, parent_id int")
    parent = spark.createDataFrame([(10,), (11,), (12,)], "id bigint")
    cands = spark.createDataFrame([("child", "parent_id", "parent", "id")],
                                  "from_table string, from_column string, to_table string, to_column string")
    r = R.orphan_check(cands, {"child": child, "parent": parent}).collect()[0]
    assert (r.child_rows, r.null_rows, r.orphan_rows, r.orphan_values) == (6, 1, 2, 1)
    assert abs(r.match_rate - 3 / 5) < 1e-12


def test_redundant_access_paths(spark):
    f = shop.frames(spark)
    got = rows(A.redundant_paths(f["indexes"]), "table_name", "index_name", "covering_index", "kind")
    assert got == [("Clients", "IX_Clients_Name_A", "IX_Clients_Name_B", "equal"),
                   ("InvoiceLines", "IX_Lines_Invoice", "IX_Lines_Invoice_Qty", "prefix")]


def test_redundant_paths_brute_force(spark):
    """Random key lists: the prefix-join result equals a brute-force pairwise check."""
    import random
    rnd = random.Random(7)
    data = []
    for t in range(6):
        for i in range(rnd.randint(1, 9)):
            n = rnd.randint(1, 3)
            data.append(("db", "s", f"t{t}", f"ix{i:02d}", [rnd.choice("abc") for _ in range(n)]))
    df = spark.createDataFrame(data, "database_name string, schema_name string, table_name string, "
                                     "index_name string, columns array<string>").withColumn(
        "is_clustered", F.lit(False))
    got = {(r.table_name, r.index_name): (r.covering_index, r.kind) for r in A.redundant_paths(df).collect()}
    exp = {}
    for (_, _, t, x, cx) in data:
        best = None
        for (_, _, t2, y, cy) in data:
            if t2 != t or y == x:
                continue
            if len(cy) > len(cx) and cy[:len(cx)] == cx:
                key = (1, len(cy), y)
            elif cy == cx and y > x:
                key = (0, 0, y)
            else:
                continue
            best = max(best, key) if best else key
        if best:
            exp[(t, x)] = (best[2], "prefix" if best[0] == 1 else "equal")
    assert got == exp


def test_missing_path_bands(spark):
    from lakescope.sources import catalog as C
    st = C.frame(spark, "missing_index_stats", [
        {"database_name": "d", "schema_name": "dbo", "table_name": "T", "impact_score": 20000.0,
         "equality_columns": "[a]", "inequality_columns": None, "include_columns": "[c]"},
        {"database_name": "d", "schema_name": "dbo", "table_name": "T", "impact_score": 5000.0,
         "equality_columns": "[a]", "inequality_columns": "[b]", "include_columns": ""},
        {"database_name": "d", "schema_name": "dbo", "table_name": "U", "impact_score": 1000.0,
         "equality_columns": "", "inequality_columns": "[b]", "include_columns": None},
    ])
    got = sorted((r.severity, r.recommendation.split("] ON ")[1]) for r in A.missing_paths(st).collect())
    assert got == [("error", "[dbo].[T] ([a]) INCLUDE ([c])"), ("info", "[dbo].[U] ([b])"),
                   ("warning", "[dbo].[T] ([a], [b])")]


def test_same_schema_target_preferred(spark):
    """With 'Orders' in two schemas, a column points at the one in its own schema."""
    from lakescope.sources import catalog as C
    cols = C.frame(spark, "columns", [
        shop.col("sales", "Orders", "Id", "int", 1, pk=True, nullable=False),
        shop.col("archive", "Orders", "Id", "int", 1, pk=True, nullable=False),
        shop.col("archive", "Lines", "Id", "int", 1, pk=True, nullable=False),
        shop.col("archive", "Lines", "OrderId", "int", 2),
        shop.col("sales", "Lines2", "Id", "int", 1, pk=True, nullable=False),
        shop.col("sales", "Lines2", "OrderId", "int", 2),
    ])
    got = rows(R.implicit_fks(cols), "from_schema", "from_table", "to_schema", "to_table")
    assert got == [("archive", "Lines", "archive", "Orders"), ("sales", "Lines2", "sales", "Orders")]


def test_name_clash_resolution(spark):
    """A bare name shared by a table and a synonym resolves to the synonym (filled later)."""
    from lakescope.operators import refs as E
    known = spark.createDataFrame([("d", "dbo", "Things", "Table"), ("d", "ext", "Things", "Synonym")],
                                  "database_name string, schema_name string, object_name string, object_type string")
    al = {r.alias_key: (r.schema_name, r.object_type) for r in E.name_aliases(known).collect()}
    assert al["things"] == ("ext", "Synonym")
    assert al["dbo.things"] == ("dbo", "Table") and al["ext.things"] == ("ext", "Synonym")


def test_orphan_check_without_candidates(spark):
    cands = spark.createDataFrame([], "from_table string, from_column string, to_table string, to_column string")
    out = R.orphan_check(cands, {})
    assert out.count() == 0 and "match_rate" in out.columns


def orphans(spark, child, child_type, parent, parent_type):
    cands = spark.createDataFrame([("child", "x", "parent", "y")], "from_table string, from_column string, to_table string, to_column string")
    tables = {"child": spark.createDataFrame([(v,) for v in child], f"x {child_type}"), "parent": spark.createDataFrame([(v,) for v in parent], f"y {parent_type}")}
    r = R.orphan_check(cands, tables).collect()[0]
    return r.orphan_rows, r.null_rows


def test_orphans_are_exact_across_types(spark):
    from decimal import Decimal as D
    assert orphans(spark, [D("123456789012345678.01"), D("123456789012345678.02"), None], "decimal(20,2)", [D("123456789012345678.03")], "decimal(20,2)") == (2, 1)
    assert orphans(spark, [5, 6], "int", [D("5.00")], "decimal(10,2)") == (1, 0)
    assert orphans(spark, [D("5.10"), D("0.00")], "decimal(10,2)", [D("5.1000"), D("0")], "decimal(38,4)") == (0, 0)
    assert orphans(spark, [1.5, 2.0], "double", [2], "bigint") == (1, 0)
    assert orphans(spark, ["a", "b"], "string", ["a"], "string") == (1, 0)
    # beyond what a common decimal or a double holds
    assert orphans(spark, [D(5), D(6)], "decimal(38,0)", [D("5.0")], "decimal(20,10)") == (1, 0)
    assert orphans(spark, [9007199254740993, 9007199254740992], "bigint", [9007199254740992.0], "double") == (1, 0)
    assert orphans(spark, [D("0.10000000000000001"), D("0.1")], "decimal(20,17)", [0.1], "double") == (1, 0)
    assert orphans(spark, [-0.0, 0.0, None], "double", [0.0], "double") == (0, 1)


def test_value_keys(spark):
    """One key for one number, whatever its type; keys of different numbers differ."""
    from decimal import Decimal as D
    from pyspark.sql import types as T

    def key(value, kind):
        df = spark.createDataFrame([(value,)], f"x {kind}")
        return df.select(R.value_key(F.col("x"), df.schema["x"].dataType)).first()[0]

    assert {key(5, "int"), key(5, "bigint"), key(D("5"), "decimal(38,0)"), key(D("5.000"), "decimal(20,10)"), key(5.0, "double"), key(5.0, "float")} == {"5"}
    assert key(D("0"), "decimal(20,10)") == key(-0.0, "double") == key(0, "tinyint") == "0"
    assert key(D("-0.00000012"), "decimal(20,10)") == key(-1.2e-7, "double") == "-0.00000012"
    assert key(D("1234567.875"), "decimal(38,18)") == key(1234567.875, "double") == "1234567.875"
    assert key(12345678.5, "double") == "12345678.5" and key(0.5, "float") == key(D("0.50"), "decimal(3,2)") == "0.5"
    assert key(-9223372036854775807, "bigint") == "-9223372036854775807"
    for n in (2**53, 2**62 + 2**11, 2**63, 2**64 + 2**13, 10**22, 2**100 + 2**50, 2**126):
        exact = int(float(n))
        assert key(float(n), "double") == str(exact) and key(-float(n), "double") == f"-{exact}"
        if exact < 10**38:
            assert key(D(exact), "decimal(38,0)") == str(exact)
    assert key(float("nan"), "double") == "NaN" and key(1e300, "double") == "1.0E300" and key(None, "double") is None
    assert key(b"ab", "binary") == "6162" and key("x", "string") == "x"
    assert isinstance(T.DecimalType(38, 37), T.DecimalType) and key(D("1.5"), "decimal(38,37)") == "1.5"


def test_orphans_of_tables_with_one_name(spark):
    cands = spark.createDataFrame([("d1", "s1", "c", "x", "s1", "p", "y"), ("d2", "s1", "c", "x", "s1", "p", "y")],
                                  "database_name string, from_schema string, from_table string, from_column string, to_schema string, to_table string, to_column string")
    one, two = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(1,)], "y int")
    tables = {("d1", "s1", "c"): one, ("d1", "s1", "p"): two, ("d2", "s1", "c"): two.toDF("x"), ("d2", "s1", "p"): one.toDF("y")}
    assert {r.database_name: r.orphan_rows for r in R.orphan_check(cands, tables).collect()} == {"d1": 1, "d2": 0}
