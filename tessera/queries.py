"""The registered table queries and their SQL, name by name."""

from __future__ import annotations

import decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import cells, fuzzy
from tessera.operators.mutation import count_rows, delete_rows, first_wins, new_rows, same_rows
from tessera.operators.ordered import OrderedView
from tessera.plans.compiler import compile_predicate
from tessera.plans.predicate import Predicate, col, col_at, from_json, from_lambda, lit, to_json
from tessera.plans.wire import from_bytes, to_bytes
from tessera.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _where(name: str, table: str, p: Predicate, sql: str, columns: str = "*") -> None:
    """A filter-and-fetch query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = files.table(spark, sf_dir, table)
        df = df.filter(compile_predicate(p, df.schema))
        return df if columns == "*" else df.select(*columns.split(", "))

    _add(name, run, f"SELECT {columns} FROM {table} WHERE {sql}")


def _derived(name: str, table: str, make: Callable[[DataFrame], DataFrame], p: Predicate, sql: str) -> None:
    """A filter over a derived column ``v`` whose type no test table has."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(files.table(spark, sf_dir, table))
        df = df.filter(compile_predicate(p, df.schema))
        return df.withColumn("v", F.hex("v")) if isinstance(df.schema["v"].dataType, T.BinaryType) else df

    _add(name, run, sql)


# --------------------------------------------------------------------- scans and layout

_add("scan_region", lambda s, d: files.table(s, d, "region"), "SELECT * FROM region")
_add("scan_orders", lambda s, d: files.table(s, d, "orders"), "SELECT * FROM orders")


def schema_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.registry import Registry
    from tessera.schema import with_roles

    df = files.table(spark, sf_dir, "part")
    return Registry(spark, with_roles(df.schema), df, dedup="none").output_layout()


_HEADER = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]
_add("schema_header", schema_header, "SELECT * FROM (VALUES " + ", ".join(f"({i}::INTEGER, '{n}', '{t}')" for i, (n, t) in enumerate(_HEADER)) + ") AS t(ordinal, name, type)")


def dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "dump")
    files.dump(files.table(spark, sf_dir, "supplier"), path)
    return files.load(spark, path)


_add("dump_roundtrip", dump_roundtrip, "SELECT * FROM supplier")

# --------------------------------------------------------------------------- leaves

_where("eq_int", "part", col("p_size").eq(15), "p_size = 15")
_where("eq_long", "orders", col("o_custkey").eq(89), "o_custkey = 89")
_where("eq_double", "lineitem", col("l_discount").eq(0.05), "l_discount = 0.05::DOUBLE")
_where("eq_string", "part", col("p_brand").eq("Brand#2"), "p_brand = 'Brand#2'")
_derived("eq_float", "lineitem", lambda t: t.select("l_orderkey", "l_linenumber", F.col("l_tax").cast("float").alias("v")), col("v").eq(0.03), "SELECT l_orderkey, l_linenumber, l_tax::FLOAT AS v FROM lineitem WHERE l_tax::FLOAT = 0.03::FLOAT")
_derived("ge_decimal", "orders", lambda t: t.select("o_orderkey", F.col("o_totalprice").cast("decimal(29,2)").alias("v")), col("v").ge(decimal.Decimal("400000.00")), "SELECT o_orderkey, o_totalprice::DECIMAL(29,2) AS v FROM orders WHERE o_totalprice::DECIMAL(29,2) >= 400000.00")
_derived("eq_decimal", "orders", lambda t: t.select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("decimal(29,2)").alias("v")), col("v").eq(decimal.Decimal("399")), "SELECT o_orderkey, floor(o_totalprice / 1000)::DECIMAL(29,2) AS v FROM orders WHERE floor(o_totalprice / 1000)::DECIMAL(29,2) = 399.00")
_derived("eq_bytes", "nation", lambda t: t.select("n_nationkey", F.col("n_name").cast("binary").alias("v")), col("v").eq(b"NATION_3"), "SELECT n_nationkey, hex(encode(n_name)) AS v FROM nation WHERE encode(n_name) = encode('NATION_3')")
_where("ne_int", "part", col("p_size").ne(15), "p_size <> 15")
_where("ne_string", "orders", col("o_orderstatus").ne("F"), "o_orderstatus <> 'F'")
for _op, _sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _where(f"{_op}_int", "part", getattr(col("p_size"), _op)(25), f"p_size {_sign} 25")
    _where(f"{_op}_double", "lineitem", getattr(col("l_quantity"), _op)(45.0), f"l_quantity {_sign} 45")
    _where(f"{_op}_long", "orders", getattr(col("o_custkey"), _op)(89), f"o_custkey {_sign} 89")
_where("between_closed", "part", col("p_size").between(5, 9), "p_size BETWEEN 5 AND 9")
_where("between_swapped", "part", col("p_size").between(9, 5), "p_size BETWEEN 5 AND 9")
_where("between_half_left", "part", col("p_size").between(5, 9, "left"), "p_size >= 5 AND p_size < 9")
_where("between_half_right", "part", col("p_size").between(5, 9, "right"), "p_size > 5 AND p_size <= 9")
_where("between_open", "part", col("p_size").between(5, 9, "neither"), "p_size > 5 AND p_size < 9")
_where("between_double", "lineitem", col("l_extendedprice").between(10000.0, 12000.0), "l_extendedprice BETWEEN 10000 AND 12000")
_where("outside_range", "part", col("p_size").outside(5, 45), "p_size NOT BETWEEN 5 AND 45")
_where("unindexed_filter", "part", col("p_retailprice").gt(950.0), "p_retailprice > 950")

# ---------------------------------------------------------------------- composition

_A, _B, _C, _D = col("p_size").eq(15), col("p_brand").eq("Brand#2"), col("p_type").eq("ECONOMY"), col("p_type").eq("SMALL")
_SQL_A, _SQL_B, _SQL_C, _SQL_D = "p_size = 15", "p_brand = 'Brand#2'", "p_type = 'ECONOMY'", "p_type = 'SMALL'"
_where("and_two", "part", col("p_size").between(5, 15) & _B, f"p_size BETWEEN 5 AND 15 AND {_SQL_B}")
_where("or_two", "part", _A | _B, f"{_SQL_A} OR {_SQL_B}")
_where("or_overlap", "part", col("p_size").le(30) | col("p_size").ge(20) | _B, f"p_size <= 30 OR p_size >= 20 OR {_SQL_B}")
_where("nested_left", "part", (col("p_size").ge(5) & col("p_size").le(25)) & _B, f"(p_size >= 5 AND p_size <= 25) AND {_SQL_B}")
_where("nested_right", "part", col("p_size").ge(10) & (_B | _C), f"p_size >= 10 AND ({_SQL_B} OR {_SQL_C})")
_where("nested_balanced", "part", (_A | _B) & (_C | _D), f"({_SQL_A} OR {_SQL_B}) AND ({_SQL_C} OR {_SQL_D})")
_where("nested_deep", "part", ((_A | (_B & _C)) & col("p_size").lt(40)) | (_D & ~_B), f"(({_SQL_A} OR ({_SQL_B} AND {_SQL_C})) AND p_size < 40) OR ({_SQL_D} AND NOT {_SQL_B})")
_where("and_missing_key", "part", col("p_size").eq(-1) & _B, f"p_size = -1 AND {_SQL_B}")
_where("range_fused", "part", (lit(5) <= col("p_size")) & (col("p_size") <= 9), "p_size >= 5 AND p_size <= 9")
_where("range_contradiction", "part", col("p_size").gt(9) & col("p_size").lt(5), "p_size > 9 AND p_size < 5")
_where("literal_left", "part", lit(45) < col("p_size"), "45 < p_size")
_where("by_position", "part", col_at(4).eq(15) & col_at(1).ne("red widget"), "p_size = 15 AND p_name <> 'red widget'")
_where("lambda_where", "part", from_lambda(lambda r: (r.p_size >= 40) & ((r.p_brand == "Brand#2") | (r["p_type"] == "SMALL"))), f"p_size >= 40 AND ({_SQL_B} OR {_SQL_D})")
_where("json_where", "part", from_json(to_json((_A | _B) & col("p_retailprice").between(920.0, 980.0))), f"({_SQL_A} OR {_SQL_B}) AND p_retailprice BETWEEN 920 AND 980")



def wire_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that went through its binary form."""
    part = files.table(spark, sf_dir, "part")
    p = (_A | col("p_name").fuzzy("red widgit", 12)) & col("p_retailprice").between(920.0, 980.0, "left") & col("p_partkey").ne(7)
    return part.filter(compile_predicate(from_bytes(to_bytes(p, part.schema)), part.schema))


# ---------------------------------------------------------------- counts and mutation


def _filtered(name: str, table: str, p: Predicate, act, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = files.table(spark, sf_dir, table)
        return act(df, compile_predicate(p, df.schema))

    _add(name, run, sql)


_add("count_all", lambda s, d: count_rows(files.table(s, d, "lineitem")), "SELECT count(*) AS n FROM lineitem")
_filtered("count_where", "lineitem", col("l_quantity").gt(45.0) & col("l_discount").eq(0.05), count_rows, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 45 AND l_discount = 0.05::DOUBLE")
_filtered("delete_where", "lineitem", col("l_quantity").between(10.0, 40.0), delete_rows, "SELECT * FROM lineitem WHERE NOT coalesce(l_quantity BETWEEN 10 AND 40, false)")
_filtered("delete_count", "lineitem", col("l_quantity").between(10.0, 40.0), count_rows, "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 40")


def clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.registry import Registry
    from tessera.schema import with_roles

    df = files.table(spark, sf_dir, "customer")
    registry = Registry(spark, with_roles(df.schema), df, dedup="none")
    n = registry.clear()
    return spark.createDataFrame([(n, registry.count())], "affected long, remaining long")


_add("clear", clear, "SELECT count(*) AS affected, 0::BIGINT AS remaining FROM customer")

_KEYS = ["o_custkey", "o_orderstatus"]


def insert_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(files.table(spark, sf_dir, "orders"), _KEYS, F.col("o_orderkey"))


_FIRST = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM {}) WHERE r = 1"
_add("insert_identity_dedup", insert_identity_dedup, _FIRST.format("orders"))


def insert_existing_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = files.table(spark, sf_dir, "orders")
    base = orders.filter(F.col("o_orderkey") % 2 == 0)
    return base.unionByName(new_rows(base, first_wins(orders, _KEYS, F.col("o_orderkey")), _KEYS))


_add(
    "insert_existing_ignored",
    insert_existing_ignored,
    "WITH base AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0) SELECT * FROM base UNION ALL "
    f"SELECT * FROM ({_FIRST.format('orders')}) f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.o_custkey = f.o_custkey AND b.o_orderstatus = f.o_orderstatus)",
)
_add("bag_insert", lambda s, d: files.table(s, d, "supplier").unionByName(files.table(s, d, "supplier")), "SELECT * FROM supplier UNION ALL SELECT * FROM supplier")


def registry_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, delete and rollback through a registry; its final rows."""
    from tessera.registry import Registry
    from tessera.schema import with_roles

    part = files.table(spark, sf_dir, "part")
    schema = with_roles(part.schema, {"p_brand": "generic", "p_type": "generic", "p_size": "btree"})
    registry = Registry(spark, schema)
    registry.bulk_insert(part, order_by="p_partkey")
    registry.delete(col("p_size").gt(25))
    registry.delete(col("p_size").le(25))
    registry.rollback()
    return registry.fetch(_B | _D)


_add("registry_lifecycle", registry_lifecycle, f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS r FROM part) WHERE r = 1 AND p_size <= 25 AND ({_SQL_B} OR {_SQL_D})")



def _parts(spark: SparkSession, sf_dir: str, most: int):
    """A registry over the parts up to a key, identified by it."""
    from tessera.registry import Registry
    from tessera.schema import with_roles

    part = files.table(spark, sf_dir, "part")
    schema = with_roles(part.schema, {"p_partkey": "btree"}, hashed=["p_partkey"])
    registry = Registry(spark, schema)
    registry.bulk_insert(part.filter(F.col("p_partkey") <= most))
    return registry


def insert_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new row goes in, one whose identity is there does not."""
    registry = _parts(spark, sf_dir, 20)
    new, old = (registry.insert((k, "blue thing", "Brand#9", "LARGE", 7, 1.5)) for k in (1000000, 3))
    return registry.fetch().select("p_partkey", "p_name", F.lit(new).alias("new"), F.lit(old).alias("old"))


def batch_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of commands in order: its counts, one per row."""
    from tessera.registry import Command

    out = _parts(spark, sf_dir, 50).execute([Command("count"), Command("conditional_count", col("p_size").le(25)), Command("conditional_delete", col("p_size").le(25)), Command("count"), Command("clear"), Command("count")], write=True)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(out)], "step int, n long")


def rows_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two tables hold the same rows equally often."""
    nation = files.table(spark, sf_dir, "nation")
    cases = [same_rows(nation, nation.orderBy(F.desc("n_nationkey"))), same_rows(nation, nation.filter("n_nationkey > 0")), same_rows(nation, nation.union(nation.limit(1)))]
    return spark.createDataFrame(list(enumerate(cases)), "step int, same boolean")


def to_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows decoded to objects of a class, and a table made of these again."""
    import dataclasses

    kind = dataclasses.make_dataclass("Part", [("p_partkey", int), ("p_name", str), ("p_brand", str), ("p_type", str), ("p_size", int), ("p_retailprice", float)])
    registry = _parts(spark, sf_dir, 30)
    return spark.createDataFrame([dataclasses.astuple(x) for x in registry.to_list(col("p_size").ge(20), kind)], registry.df.schema)


def insert_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts into a table that is laid out by its indexes at once: a table, one that overlaps it, and rows of the driver."""
    from tessera.registry import Registry
    from tessera.schema import with_roles

    orders = files.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    schema = with_roles(orders.schema, {"o_custkey": "generic", "o_totalprice": "btree"}, hashed=["o_orderkey"])
    registry = Registry(spark, schema, index_rows=1)
    registry.bulk_insert(orders.filter(F.col("o_orderkey") % 3 > 0))
    registry.bulk_insert(orders.withColumn("o_orderstatus", F.lit("again")))
    registry.bulk_insert([tuple(r) for r in orders.filter(F.col("o_orderkey") <= 40).collect()])
    return registry.fetch()


_add(
    "insert_indexed",
    insert_indexed,
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE 'again' END AS o_orderstatus, o_totalprice FROM orders",
)


def stream_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rows goes in, micro-batch by micro-batch; rows that are there stay as they are."""
    from tessera.streaming.ingest import insert_stream

    registry = _parts(spark, sf_dir, 100)
    # A stream of files wants a folder or a pattern: this one names the table's file alone.
    rows = spark.readStream.schema(registry.schema).parquet(f"{sf_dir.rstrip('/')}/part.parque[t]")
    insert_stream(registry, rows, files.scratch(spark, "stream")).awaitTermination()
    return registry.fetch()


_add("insert_one", insert_one, "SELECT p_partkey, p_name, true AS new, false AS old FROM part WHERE p_partkey <= 20 UNION ALL SELECT 1000000, 'blue thing', true, false")
_add(
    "batch_execute",
    batch_execute,
    "WITH p AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_size <= 25) AS small FROM part WHERE p_partkey <= 50) "
    "SELECT 0 AS step, n FROM p UNION ALL SELECT 1, small FROM p UNION ALL SELECT 2, small FROM p UNION ALL SELECT 3, n - small FROM p UNION ALL SELECT 4, n - small FROM p UNION ALL SELECT 5, 0 FROM p",
)
_add("rows_equal", rows_equal, "SELECT * FROM (VALUES (0, true), (1, false), (2, false)) AS t(step, same)")
_add("to_objects", to_objects, "SELECT * FROM part WHERE p_partkey <= 30 AND p_size >= 20")
_add("stream_insert", stream_insert, "SELECT * FROM part")

# --------------------------------------------------------------------- ordered access

_add("ordered_point", lambda s, d: OrderedView(files.table(s, d, "orders"), "o_orderkey").get(77), "SELECT * FROM orders WHERE o_orderkey = 77")
_add("ordered_between", lambda s, d: OrderedView(files.table(s, d, "orders"), "o_orderkey").collect_between(90, 40), "SELECT * FROM orders WHERE o_orderkey BETWEEN 40 AND 90")
_add("ordered_first", lambda s, d: OrderedView(files.table(s, d, "orders"), "o_orderkey").in_order(25), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")
_add("ordered_remove", lambda s, d: OrderedView(files.table(s, d, "part"), "p_size").remove(15).df, "SELECT * FROM part WHERE p_size <> 15")

# ---------------------------------------------------------------------------- fuzzy


def _fuzzy_sql(select: str, table: str, value: str, key: str | bytes, least: int, where: str = "") -> str:
    """The same scoring in SQL: grams of the value, the query's grams in order, total and last length."""
    binary = isinstance(key, bytes)
    pad = fuzzy.PAD_HEX if binary else fuzzy.PAD
    w = 2 if binary else 1
    text = f"hex({value})" if binary else value
    n = f"(length({text}) // {w})"
    unit = lambda i, k: f"substr({text}, ({i}) * {w} - {w - 1}, {k * w})"
    inner = f"list_transform(range(1, {n} - 1), lambda i: {unit('i', 3)})"
    ends = f"['{pad}' || {unit(1, 2)}, '{pad}{pad}' || {unit(1, 1)}, {unit(n + ' - 1', 2)} || '{pad}', {unit(n, 1)} || '{pad}{pad}']"
    two = f"[{unit(2, 1)} || '{pad}{pad}', {text} || '{pad}', '{pad}' || {text}, '{pad}{pad}' || {unit(1, 1)}]"
    one = f"[{text} || '{pad}{pad}', '{pad}' || {text} || '{pad}', '{pad}{pad}' || {text}]"
    g = f"CASE WHEN {n} >= 3 THEN list_concat({inner}, {ends}) WHEN {n} = 2 THEN {two} WHEN {n} = 1 THEN {one} ELSE [] END"
    wanted = "[" + ", ".join("{'g': '" + a.replace("'", "''") + f"', 'l': {b}}}" for a, b in fuzzy.key_grams(key)) + "]"
    return (
        f"SELECT {select} FROM (SELECT *, list_filter({wanted}, lambda x: list_contains(_g, x.g)) AS _m FROM (SELECT *, {g} AS _g FROM {table}{where})) "
        f"WHERE len(_m) > 0 AND list_sum(list_transform(_m, lambda x: x.l)) - _m[len(_m)].l >= {least}"
    )


def _fuzzy(name: str, table: str, value: str, key: str, least: int, columns: list[str], score: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = files.table(spark, sf_dir, table)
        df = df.filter(compile_predicate(col(value).fuzzy(key, least), df.schema))
        return df.select(*columns, *([fuzzy.fuzzy_score(F.col(value), key).cast("bigint").alias("matched_length")] if score else []))

    total = ", list_sum(list_transform(_m, lambda x: x.l))::BIGINT AS matched_length" if score else ""
    _add(name, run, _fuzzy_sql(", ".join(columns) + total, table, value, key, least))


_fuzzy("fuzzy_rows", "part", "p_name", "red widgit", 12, ["p_partkey", "p_name"], False)
_fuzzy("fuzzy_score", "part", "p_name", "red widgit", 12, ["p_partkey", "p_name"], True)
_fuzzy("fuzzy_any", "part", "p_name", "zzbl", -1, ["p_partkey", "p_name"], True)
_fuzzy("fuzzy_short1", "lineitem", "l_returnflag", "R", -1, ["l_orderkey", "l_linenumber", "l_returnflag"], True)


def fuzzy_short2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 2).alias("v"))
    df = df.filter(compile_predicate(col("v").fuzzy("AU", 2), df.schema))
    return df.select("c_custkey", "v", fuzzy.fuzzy_score(F.col("v"), "AU").cast("bigint").alias("matched_length"))


_add("fuzzy_short2", fuzzy_short2, _fuzzy_sql("c_custkey, v, list_sum(list_transform(_m, lambda x: x.l))::BIGINT AS matched_length", "(SELECT c_custkey, substr(c_mktsegment, 1, 2) AS v FROM customer)", "v", "AU", 2))


def fuzzy_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = files.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("v"))
    df = df.filter(compile_predicate(col("v").fuzzy(b"red widgit", 12), df.schema))
    # The score first: an alias v before it would be taken for the column inside the lambdas.
    scored = df.withColumn("matched_length", fuzzy.fuzzy_score(F.col("v"), b"red widgit").cast("bigint"))
    return scored.select("p_partkey", F.hex("v").alias("v"), "matched_length")


_add("fuzzy_bytes", fuzzy_bytes, _fuzzy_sql("p_partkey, hex(v) AS v, list_sum(list_transform(_m, lambda x: x.l))::BIGINT AS matched_length", "(SELECT p_partkey, encode(p_name) AS v FROM part)", "v", b"red widgit", 12))


_add("wire_where", wire_where, f"SELECT * FROM part WHERE p_retailprice >= 920 AND p_retailprice < 980 AND p_partkey <> 7 AND ({_SQL_A} OR p_partkey IN ({_fuzzy_sql('p_partkey', 'part', 'p_name', 'red widgit', 12)}))")


def fuzzy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fuzzy.gram_index(files.table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return fuzzy.search_index(index, "p_partkey", "red widgit", 12)


_add("fuzzy_index", fuzzy_index, _fuzzy_sql("p_partkey, list_sum(list_transform(_m, lambda x: x.l))::BIGINT AS matched_length", "part", "p_name", "red widgit", 12))


def fuzzy_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches of one stored index; their best score."""
    index = fuzzy.store_index(files.table(spark, sf_dir, "part"), "p_partkey", "p_name", files.scratch(spark, "grams"))
    found = fuzzy.search_index(index, "p_partkey", "red widgit", 12).unionByName(fuzzy.search_index(index, "p_partkey", "small gadgit", 14))
    return found.groupBy("p_partkey").agg(F.max("matched_length").alias("matched_length"))


_add(
    "fuzzy_stored_index",
    fuzzy_stored_index,
    "SELECT p_partkey, max(matched_length) AS matched_length FROM ("
    + " UNION ALL ".join(_fuzzy_sql("p_partkey, list_sum(list_transform(_m, lambda x: x.l))::BIGINT AS matched_length", "part", "p_name", key, least) for key, least in (("red widgit", 12), ("small gadgit", 14)))
    + ") GROUP BY p_partkey",
)

# ---------------------------------------------------------------------------- cells

_I, _L, _DBL = T.IntegerType(), T.LongType(), T.DoubleType()
_ID = ["l_orderkey", "l_linenumber", "l_partkey"]


def _cell(name: str, make: Callable[[], list], sql: str) -> None:
    _add(name, lambda s, d: files.table(s, d, "lineitem").select(*_ID, *make()), f"SELECT {', '.join(_ID)}, {sql} FROM lineitem")


_c = F.col
_cell("cell_add", lambda: [cells.add(_c("l_partkey"), _c("l_suppkey"), _L, _L).alias("whole"), cells.add(_c("l_linenumber"), _c("l_quantity"), _I, _DBL).alias("mixed"), cells.add(_c("l_returnflag"), _c("l_linenumber"), T.StringType(), _I).alias("text")], "l_partkey + l_suppkey AS whole, l_linenumber + l_quantity AS mixed, l_returnflag || l_linenumber::VARCHAR AS text")
_cell("cell_sub", lambda: [cells.sub(_c("l_partkey"), _c("l_suppkey"), _L, _L).alias("whole"), cells.sub(_c("l_linenumber"), _c("l_quantity"), _I, _DBL).alias("mixed")], "l_partkey - l_suppkey AS whole, l_linenumber - l_quantity AS mixed")
_cell("cell_mul", lambda: [cells.mul(_c("l_partkey"), _c("l_suppkey"), _L, _L).alias("whole"), cells.mul(_c("l_linenumber"), _c("l_quantity"), _I, _DBL).alias("mixed")], "l_partkey * l_suppkey AS whole, l_linenumber * l_quantity AS mixed")
_cell("cell_div", lambda: [cells.div(-_c("l_partkey"), _c("l_suppkey"), _L, _L).alias("whole"), cells.div(_c("l_linenumber"), _c("l_quantity"), _I, _DBL).alias("mixed")], "(-l_partkey) // nullif(l_suppkey, 0) AS whole, l_linenumber / l_quantity AS mixed")
_cell("cell_mod", lambda: [cells.mod(-_c("l_partkey"), F.lit(7), _L, _I).alias("whole")], "(-l_partkey) % 7 AS whole")
_cell("cell_steps", lambda: [cells.increment(_c("l_partkey"), _L).alias("up"), cells.decrement(_c("l_linenumber"), _I).alias("down"), cells.neg(_c("l_quantity"), _DBL).alias("minus"), cells.absolute(cells.sub(_c("l_partkey"), F.lit(500), _L, _I), _L).alias("size")], "l_partkey + 1 AS up, l_linenumber - 1 AS down, -l_quantity AS minus, abs(l_partkey - 500) AS size")
_cell("cell_compare", lambda: [cells.compare(_c("l_linenumber"), _c("l_quantity")).alias("three_way"), (_c("l_linenumber") <= _c("l_quantity")).alias("le")], "CASE WHEN l_linenumber < l_quantity THEN -1 WHEN l_linenumber > l_quantity THEN 1 ELSE 0 END AS three_way, l_linenumber <= l_quantity AS le")
_cell("cell_inspect", lambda: [cells.is_even_integer(_c("l_partkey"), _L).alias("even"), cells.is_odd_integer(_c("l_quantity"), _DBL).alias("odd"), cells.is_integer(_c("l_extendedprice"), _DBL).alias("whole"), cells.is_finite(_c("l_tax")).alias("finite"), cells.is_zero(_c("l_discount")).alias("zero")], "l_partkey % 2 = 0 AS even, l_quantity % 2 = 1 AS odd, l_extendedprice = floor(l_extendedprice) AS whole, isfinite(l_tax) AS finite, l_discount = 0 AS zero")
_cell("cell_magnitude", lambda: [cells.max_magnitude(_c("l_quantity"), -_c("l_linenumber").cast("double")).alias("most"), cells.min_magnitude(_c("l_quantity"), -_c("l_linenumber").cast("double")).alias("least")], "CASE WHEN l_quantity >= l_linenumber THEN l_quantity ELSE -l_linenumber::DOUBLE END AS most, CASE WHEN l_quantity < l_linenumber THEN l_quantity ELSE -l_linenumber::DOUBLE END AS least")
_cell("cell_parse", lambda: [cells.parse(F.concat(_c("l_linenumber").cast("string"), F.when(_c("l_linenumber") % 2 == 0, ".5").otherwise(""))).getField(n).alias(n) for n in ("as_long", "as_double")], "CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber::BIGINT END AS as_long, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 0.5::DOUBLE END AS as_double")
_cell("cell_digest", lambda: [cells.digest(_c("l_returnflag"), "md5").alias("md5"), cells.digest(_c("l_returnflag")).alias("sha256"), cells.to_text(_c("l_returnflag").cast("binary"), T.BinaryType()).alias("hex")], "md5(l_returnflag) AS md5, sha256(l_returnflag) AS sha256, hex(encode(l_returnflag)) AS hex")
_cell("cell_equal", lambda: [cells.equal(_c("l_linenumber"), _c("l_quantity"), _L, _DBL).alias("same"), cells.equal(_c("l_linenumber"), _c("l_linenumber").cast("double"), _L, _DBL).alias("own"), (cells.number_hash(_c("l_linenumber"), _L) == cells.number_hash(_c("l_linenumber").cast("double"), _DBL)).alias("alike")], "l_linenumber::DOUBLE = l_quantity AS same, true AS own, true AS alike")
