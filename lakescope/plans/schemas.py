"""Column names and types of the driver's test tables (used to write oracle SQL)."""

from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()

TABLE_COLUMNS: dict[str, list[tuple[str, T.DataType]]] = {
    "region": [("r_regionkey", _I), ("r_name", _S)],
    "nation": [("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)],
    "customer": [("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S)],
    "supplier": [("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)],
    "part": [("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
             ("p_retailprice", _D)],
    "orders": [("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
               ("o_orderdate", _TS), ("o_orderpriority", _S)],
    "lineitem": [("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                 ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                 ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)],
    "events": [("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S)],
    "documents": [("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)],
    "labels": [("doc_id", _L), ("quality", _I), ("toxic", _I)],
    "pages": [("page_id", _L), ("url", _S), ("html", _S)],
    "conversations": [("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)],
    "benchmark": [("item_id", _L), ("text", _S)],
    "embeddings": [("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)],
}
