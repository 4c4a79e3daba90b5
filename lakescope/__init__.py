"""lakescope: catalog, profiling and lineage analysis of a data estate on Spark.

Everything is DataFrame in, DataFrame out, keyed by ``database_name``:

* ``sources``   - catalog frames (contract in ``sources.catalog``) from parquet snapshots, JDBC or the
                  Spark session catalog;
* ``operators`` - profile, relations, quality, refs, graph, diagram, usage, access, catalog_ops,
                  estate, search;
* ``streaming`` - continuous usage roll-up;
* ``plans``     - bindings of the operators to the test snapshot, with DuckDB oracle SQL.
"""
