"""A small hand-made shop catalog (two schemas) used by the rule tests."""

from lakescope.sources import catalog as C

DB = "ShopDb"


def col(schema, table, name, dtype, pos, pk=False, nullable=True, max_length=None, table_type="BASE TABLE"):
    return {"database_name": DB, "schema_name": schema, "table_name": table, "table_type": table_type,
            "column_name": name, "data_type": dtype, "max_length": max_length, "is_nullable": nullable,
            "is_primary_key": pk, "is_identity": pk, "is_computed": False, "ordinal_position": pos}


COLUMNS = [
    col("sales", "Regions", "Id", "int", 1, pk=True, nullable=False),
    col("sales", "Regions", "Name", "nvarchar", 2, max_length=50),
    col("sales", "Clients", "Id", "int", 1, pk=True, nullable=False),
    col("sales", "Clients", "FullName", "nvarchar", 2, max_length=100),
    col("sales", "Clients", "RegionId", "int", 3, nullable=False),
    col("sales", "Clients", "Status", "nvarchar", 4, max_length=20),
    col("sales", "Clients", "Notes", "nvarchar", 5, max_length=-1),
    col("sales", "Invoices", "Id", "int", 1, pk=True, nullable=False),
    col("sales", "Invoices", "ClientId", "int", 2),
    col("sales", "Invoices", "Total", "decimal", 3),
    col("sales", "InvoiceLines", "Id", "int", 1, pk=True, nullable=False),
    col("sales", "InvoiceLines", "InvoiceID", "bigint", 2, nullable=False),
    col("sales", "InvoiceLines", "ProductKey", "int", 3),
    col("sales", "InvoiceLines", "Qty", "int", 4),
    col("stock", "Product", "Id", "int", 1, pk=True, nullable=False),
    col("stock", "Product", "Sku", "nvarchar", 2, max_length=20),
    col("stock", "Warehouse", "Code", "char", 1, pk=True, nullable=False, max_length=4),
    col("stock", "Warehouse", "City", "nvarchar", 2, max_length=50),
    col("stock", "StockItems", "Id", "int", 1, pk=True, nullable=False),
    col("stock", "StockItems", "ProductId", "int", 2),
    col("stock", "StockItems", "WarehouseCode", "char", 3, max_length=4),
    col("stock", "StockItems", "SourceProductId", "int", 4),
    col("stock", "StockItems", "FK_Warehouse", "char", 5, max_length=4),
    col("sales", "Audit_Log", "Id", "int", 1, pk=True, nullable=False),
    col("sales", "Audit_Log", "ClientNo", "nvarchar", 2, max_length=20),
    col("sales", "Audit_Log", "Action", "nvarchar", 3, max_length=20),
    col("sales", "Temp_Import", "Col1", "nvarchar", 1, max_length=10),
    col("stock", "Nodes", "Id", "int", 1, pk=True, nullable=False),
    col("stock", "Nodes", "ParentNodeId", "int", 2),
    col("sales", "vClientInvoices", "FullName", "nvarchar", 1, table_type="VIEW"),
    col("sales", "vClientInvoices", "Total", "decimal", 2, table_type="VIEW"),
]

INDEXES = [
    {"database_name": DB, "schema_name": "sales", "table_name": "InvoiceLines", "index_name": "IX_Lines_Invoice_Qty",
     "index_type": "NONCLUSTERED", "is_unique": False, "is_clustered": False, "columns": ["InvoiceID", "Qty"]},
    {"database_name": DB, "schema_name": "sales", "table_name": "InvoiceLines", "index_name": "IX_Lines_Invoice",
     "index_type": "NONCLUSTERED", "is_unique": False, "is_clustered": False, "columns": ["invoiceid"]},
    {"database_name": DB, "schema_name": "sales", "table_name": "InvoiceLines", "index_name": "PK_InvoiceLines",
     "index_type": "CLUSTERED", "is_unique": True, "is_clustered": True, "columns": ["Id"]},
    {"database_name": DB, "schema_name": "sales", "table_name": "Clients", "index_name": "IX_Clients_Name_A",
     "index_type": "NONCLUSTERED", "is_unique": False, "is_clustered": False, "columns": ["FullName"]},
    {"database_name": DB, "schema_name": "sales", "table_name": "Clients", "index_name": "IX_Clients_Name_B",
     "index_type": "NONCLUSTERED", "is_unique": False, "is_clustered": False, "columns": ["FullName"]},
]

FOREIGN_KEYS = [
    {"database_name": DB, "fk_name": "FK_Invoices_Clients", "from_schema": "sales", "from_table": "Invoices",
     "from_column": "ClientId", "to_schema": "sales", "to_table": "Clients", "to_column": "Id"},
]

VIEWS = [
    (DB, "sales", "vClientInvoices",
     "CREATE VIEW sales.vClientInvoices AS SELECT c.FullName, i.Total FROM sales.Clients c\n"
     "  JOIN [sales].[Invoices] i ON i.ClientId = c.Id"),
    (DB, "sales", "vTop", "CREATE VIEW sales.vTop AS SELECT TOP 5 * FROM vClientInvoices ORDER BY Total DESC"),
]

PROCEDURES = [
    (DB, "sales", "usp_Archive",
     "CREATE PROCEDURE sales.usp_Archive AS\nINSERT INTO sales.Audit_Log SELECT * FROM Invoices;\n"
     "EXEC sales.usp_Log 'x';\nEXEC('SELECT * FROM stock.Product WHERE 1=1')", None),
    (DB, "sales", "usp_Log", "CREATE PROCEDURE sales.usp_Log @m nvarchar(10) AS SELECT 1 FROM usp_Log", None),
    (DB, "sales", "usp_Remote",
     "CREATE PROCEDURE sales.usp_Remote AS SELECT * FROM OtherDb.dbo.Customers;\n"
     "SELECT * FROM Srv1.OtherDb.dbo.Orders; SELECT * FROM ShopDb.sales.Regions", None),
    (DB, "sales", "usp_Dynamic",
     "CREATE PROCEDURE sales.usp_Dynamic AS DECLARE @s nvarchar(max) = N'SELECT * FROM stock.Nodes n';\n"
     "EXEC sp_executesql @s", None),
]

FUNCTIONS = [
    (DB, "sales", "fn_Total", "Scalar", "RETURN (SELECT SUM(Total) FROM sales.Invoices WHERE ClientId = @id)", None),
    (DB, "stock", "fn_Unknown", "Inline Table", "RETURN SELECT * FROM NotATable", None),
]

TRIGGERS = [
    (DB, "sales", "trg_Clients_Upd", "Clients", "AFTER", "UPDATE", True,
     "CREATE TRIGGER trg_Clients_Upd ON sales.Clients AFTER UPDATE AS INSERT INTO sales.Audit_Log (Action) "
     "SELECT 'upd' FROM inserted"),
]

SYNONYMS = [
    (DB, "sales", "syn_Prod", "stock.Product"),
    (DB, "sales", "syn_Ext", "[OtherDb].[dbo].[Customers]"),
    (DB, "sales", "syn_Self", "ShopDb.sales.vTop"),
]

JOB_STEPS = [
    (DB, "Nightly", 1, "archive", "TSQL", "ShopDb", "EXEC sales.usp_Archive"),
    (DB, "Nightly", 2, "clean", "TSQL", "ShopDb", "DELETE FROM sales.Temp_Import"),
]

RECORDED = [
    (DB, "sales", "vClientInvoices", "View", "sales", "Clients", "Table", None),
    (DB, "sales", "usp_Archive", "Procedure", "sales", "Audit_Log", "Table", None),
]


def frames(spark):
    return {
        "columns": C.frame(spark, "columns", COLUMNS),
        "indexes": C.frame(spark, "indexes", INDEXES),
        "foreign_keys": C.frame(spark, "foreign_keys", FOREIGN_KEYS),
        "views": C.frame(spark, "views", VIEWS),
        "procedures": C.frame(spark, "procedures", PROCEDURES),
        "functions": C.frame(spark, "functions", FUNCTIONS),
        "triggers": C.frame(spark, "triggers", TRIGGERS),
        "synonyms": C.frame(spark, "synonyms", SYNONYMS),
        "job_steps": C.frame(spark, "job_steps", JOB_STEPS),
        "object_dependencies": C.frame(spark, "object_dependencies", RECORDED),
    }
