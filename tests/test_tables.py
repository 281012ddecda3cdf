"""Goldens of the table engine: predicates, registry, schemas, functions."""

import asyncio
import dataclasses
import decimal
import glob
import math
import os
import random
import sys
import threading

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tessera.errors as E
from tessera import queries
from tessera.functions import cells, fuzzy
from tessera.operators.mutation import first_wins, new_rows_bucketed, same_rows
from tessera.operators.ordered import OrderedView
from tessera.plans.binding import bind, normalise
from tessera.plans.compiler import compile_predicate
from tessera.plans.predicate import Always, And, Between, Compare, Or, col, col_at, from_json, from_lambda, lit, to_json
from tessera.plans.wire import from_bytes, to_bytes
from tessera.registry import Command, Registry
from tessera.schema import column, identity_columns, indexed, schema_from_class, schema_from_config, table_schema, to_config, with_roles
from tessera.sources import files
from tessera.streaming.ingest import insert_stream

CLEF, FLAG = "\U0001d11e", "\U0001f1f5\U0001f1f1"
NET = {
    "columns": [
        {"name": "col1", "type": "DWORD", "indexer": {"type": "btree", "degree": 100}},
        {"name": "col2", "type": "string"},
        {"name": "col3", "type": "string", "indexer": "generic"},
        {"name": "col4", "type": "bytes", "indexer": "generic"},
        {"name": "col5", "type": "single", "indexer": "btree"},
    ]
}
ROWS = [(1, "test1", CLEF), (1, "test1", FLAG), (2, CLEF, FLAG), (2, "test4", FLAG), (2, CLEF, "test4")]


def net(spark, dedup, rows=None):
    r = Registry(spark, schema_from_config(NET), dedup=dedup)
    r.bulk_insert([(a, b, c, b"\1\2\3\4", 0.0) for a, b, c in ROWS] if rows is None else rows)
    return r


@pytest.mark.parametrize(("dedup", "counts"), [("identity", (2, 1, 3)), ("none", (3, 2, 4))])
def test_fetch_goldens(spark, dedup, counts):
    r = net(spark, dedup)
    two, flag = col("col1").eq(2), col("col3").eq(FLAG)
    assert tuple(r.count(p) for p in (two, two & flag, two | flag)) == counts
    assert r.count(col("col4").eq(b"\1\2\3\4")) == r.count() and r.count(col("col4").ne(b"\1")) == r.count()
    assert sorted(r.fetch(two & flag).columns) == ["col1", "col2", "col3", "col4", "col5"]


@pytest.mark.parametrize("dedup", ["identity", "none"])
def test_range_goldens(spark, dedup):
    r = net(spark, dedup, [(i, "", "", b"", v) for i, v in enumerate((1.2, 1.4, 1.6, 1.8, -1.2), 1)])
    v = col("col5")
    assert [r.count(p) for p in (v.lt(0), v.between(1.1, 1.3), v.between(1.3, 1.5), v.between(1.5, 1.9), v.between(1.9, 1.5))] == [1, 1, 1, 2, 2]


@dataclasses.dataclass
class Embedded:
    Value1: int = indexed("generic")
    Value2: str = indexed("none")
    Value3: str = indexed("generic")


EMBEDDED = [Embedded(1, "test1", CLEF), Embedded(2, FLAG, "test4"), Embedded(2, "test6", "test4")]


def test_embedded_goldens_with_identity(spark):
    r = Registry(spark, schema_from_class(Embedded))
    assert r.bulk_insert(EMBEDDED) == 2
    got = r.to_list(lambda x: x.Value1 == 2, Embedded)
    assert got == [EMBEDDED[1]]  # the first row of an identity wins
    assert r.insert(Embedded(2, "later", "test4")) is False and r.insert(Embedded(3, "new", "")) is True
    assert r.delete(col("Value1").eq(2)) == 1 and r.count() == 2


def test_embedded_goldens_without_identity(spark):
    r = Registry(spark, schema_from_class(Embedded), dedup="none")
    assert r.bulk_insert(EMBEDDED) == 3
    assert r.count((col("Value1") > 1) & (col("Value1") < 3)) == 2
    assert r.delete(lambda x: x.Value1 == 2) == 2 and r.count() == 1


def test_sequential_inserts_and_clear(spark):
    r, n = net(spark, "identity", []), 0
    for step in range(3):
        rows = [(n + k, "a", "b", b"c", 1.0) for k in (1, 2, 2)]
        assert r.bulk_insert(rows) == 2 and r.count() == 2 * (step + 1)
        n += 2
    assert r.clear() == 6 and r.count() == 0


def test_volume_golden(spark):
    r = Registry(spark, schema_from_class(Embedded), dedup="none")
    made = spark.range(15000).select(F.when(F.col("id") < 10000, 1).otherwise(F.col("id") - 9998).alias("Value1"), F.lit("test").alias("Value2"), F.col("id").cast("string").alias("Value3"))
    assert r.bulk_insert(made) == 15000 and r.count(col_at(0).gt(0) & col_at(0).lt(2)) == 10000


def test_parallel_inserts(spark):
    r = net(spark, "identity", [])
    jobs = [threading.Thread(target=r.bulk_insert, args=([(i, "x", "y", b"", 0.0), (100, "x", "y", b"", 0.0)],)) for i in range(4)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert r.count() == 5


def test_batches_rollback_and_layout(spark):
    r = net(spark, "none")
    with pytest.raises(E.WriteOperationsNotAllowed):
        r.execute([Command("count"), Command("clear")])
    assert r.execute([Command("count"), Command("conditional_count", col("col1").eq(2))]) == [5, 3]
    assert r.execute([Command("conditional_delete", col("col1").eq(2)), Command("count")], write=True) == [3, 2]
    with pytest.raises(E.UnknownColumn):
        r.execute([Command("clear"), Command("conditional_delete", col("nope").eq(2))], write=True)
    assert r.count() == 2
    r.rollback()
    assert r.count() == 5 and r.indexed_column_count == 4
    assert [tuple(x) for x in r.output_layout().orderBy("ordinal").collect()][4] == (4, "col5", "float")
    r.commit()
    with pytest.raises(ValueError):
        r.rollback()


def test_snapshots_are_written_out(spark):
    r = net(spark, "identity", [])
    for i in range(10):
        r.insert((i, "", "", b"", 0.0))
    assert r.count() == 10 and r.version == 10


def test_bad_rows_and_schemas(spark):
    r = net(spark, "none", [])
    with pytest.raises(E.ConstraintCheckFailed):
        r.insert((1, None, "", b"", 0.0))
    with pytest.raises(E.MismatchedDataType):
        r.insert(("1", "", "", b"", 0.0))
    with pytest.raises(E.MismatchedDataType):
        r.insert((1 << 31, "", "", b"", 0.0))
    with pytest.raises(E.ConstraintCheckFailed):
        r.insert((1, "", ""))
    with pytest.raises(E.MismatchedDataType):
        r.bulk_insert(spark.range(3))
    with pytest.raises(E.ConstraintCheckFailed):
        r.to_list(cls=Embedded)
    with pytest.raises(E.SchemaError):
        column("a", T.StringType(), "btree")
    with pytest.raises(E.SchemaError):
        column("a", T.IntegerType(), "fuzzy")
    with pytest.raises(E.DuplicateColumn):
        table_schema([column("a", T.IntegerType()), column("a", T.LongType())])
    with pytest.raises(E.SchemaError):
        Registry(spark, table_schema([column("a", T.IntegerType())]))
    assert schema_from_config(to_config(r.schema)) == r.schema and identity_columns(r.schema) == ["col1", "col3", "col4", "col5"]


def test_predicate_checks(spark):
    s = schema_from_config(NET)
    for p, error in (
        (col("col1").eq("2"), E.MismatchedDataType), (col("col3").gt("a"), E.OperationNotSupported), (col("col4").between(b"a", b"b"), E.OperationNotSupported),
        (col("col1").eq(True), E.MismatchedDataType), (col_at(9).eq(1), E.UnknownColumn), (col("col1").fuzzy(3), E.OperationNotSupported),
    ):
        with pytest.raises(error):
            bind(p, s)
    with pytest.raises(E.OperationNotSupported):
        bind(col("col2").eq("a"), s, strict_index=True)
    with pytest.raises(TypeError):
        bool(col("col1").eq(2))
    bind(col("col3").eq("a") & col("col1").gt(1), s, strict_index=True)


def test_rewrites():
    x = col("x")
    assert normalise(x.between(9, 5)) == Between("x", 5, 9)
    assert normalise(x.between(9, 5, "left")) == Between("x", 5, 9, False, True)
    assert normalise((x >= 5) & (x <= 9)) == Between("x", 5, 9) == normalise((lit(5) <= x) & (lit(9) >= x))
    assert normalise((x > 9) & (x < 5)) == Always(False) == normalise((x > 5) & (x < 5)) == normalise(x.gt(math.nan))
    assert normalise((x > 1) & (x > 3)) == Compare("x", "gt", 3) and normalise((x >= 3) & (x > 3)) == Compare("x", "gt", 3)
    assert normalise((x > 9) & (x < 5) | col("y").eq(1)) == Compare("y", "eq", 1)
    assert (lit(5) < x) == Compare("x", "gt", 5)
    assert isinstance(normalise(x.gt(1) & col("y").gt(2)), And)


def test_wire_form_and_lambda():
    p = (col("a").eq(1) & col("b").between(decimal.Decimal("1.5"), 2, "left")) | ~col("c").fuzzy(b"xy", 3) & col_at(2).outside(1, 2) | col("d").ne(b"\0")
    assert from_json(to_json(p)) == p
    assert from_lambda(lambda r: (r.a == 1) | (r["b"] > 2)) == Or(Compare("a", "eq", 1), Compare("b", "gt", 2))
    assert from_json({"and": [{"op": "eq", "column": "a", "value": i} for i in range(3)]}) == And(And(col("a").eq(0), col("a").eq(1)), col("a").eq(2))
    with pytest.raises(TypeError):
        from_lambda(lambda r: r.a)


FRAME = bytes.fromhex("01000000" "03000000" "00000000" "01000000" "004000e0" "02000000" "03000000" "02000000" "01000000" "00000480" "01000000" "78")


def test_binary_form(spark):
    want = And(Compare(0, "eq", 2), Compare(2, "eq", "x"))
    s = schema_from_config(NET)
    assert from_bytes(FRAME) == want and to_bytes(want, s) == FRAME == to_bytes(col("col1").eq(2) & col("col3").eq("x"), s)
    kinds = table_schema([column(n, t) for n, t in zip("abcdefg", (T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.DecimalType(29, 4)))])
    d = decimal.Decimal
    at = [col_at(i) for i in range(7)]
    for p in (
        *(getattr(at[1], op)(-(1 << 63)) for op in ("eq", "ne", "gt", "ge", "lt", "le")), *(at[0].between(5, -9, c) for c in ("both", "left", "right", "neither")),
        at[2].ge(-0.5) | at[3].lt(math.inf) & at[4].fuzzy(CLEF + FLAG, 7), at[5].ne(b""), at[5].fuzzy(b"ab"), at[4].eq("x" * 500),
        at[6].between(d("-12345678901234567890123.4567"), d("0.0001")), at[6].eq(d("12E3")), at[6].eq(d(2**96 - 1)),
    ):
        assert from_bytes(to_bytes(p, kinds)) == p
    for cut in range(len(FRAME)):
        with pytest.raises(E.SchemaError):
            from_bytes(FRAME[:cut])
    for bad in (FRAME + b"\0", b"\4\0\0\0", FRAME[:16] + b"\1" + FRAME[17:], b"\1\0\0\0" * 100000):
        with pytest.raises(E.SchemaError):
            from_bytes(bad)
    for p in (~col("col1").eq(2), col("col1").outside(1, 2)):
        with pytest.raises(E.OperationNotSupported):
            to_bytes(p, s)
    with pytest.raises(E.UnknownColumn):
        to_bytes(col("nope").eq(2), s)
    assert net(spark, "none").count(to_bytes(col("col1").eq(2) & col("col3").eq(FLAG), s)) == 2


def test_nan_infinity_and_nulls(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (9.0,), (None,)], "x double")
    count = lambda p: df.filter(compile_predicate(p, df.schema)).count()
    assert [count(p) for p in (col("x").gt(5), col("x").lt(5), col("x").eq(math.nan), col("x").between(-math.inf, math.inf), col("x").outside(0.0, 5.0))] == [2, 1, 1, 3, 3]
    r = Registry(spark, with_roles(df.schema), df, dedup="none")
    assert r.delete(col("x").gt(5)) == 2 and r.count() == 3  # null rows stay


def test_literals_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = df.filter(compile_predicate(col("p_size").between(5, 9) & col("p_brand").eq("Brand#2"), df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,5)" in plan and "EqualTo(p_brand,Brand#2)" in plan and "Python" not in plan


def model_score(query, key):
    wanted, have, total, last, hit = fuzzy.key_grams(query), {g for g, _ in fuzzy.key_grams(key)}, 0, 0, False
    for g, n in wanted:
        if g in have:
            total, last, hit = total + n, n, True
    return hit, total, total - last


def test_fuzzy_equals_a_model(spark):
    r = random.Random(1)
    keys = ["", *{"".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(40)}]
    df = spark.createDataFrame([(k, k.encode()) for k in keys], "k string, b binary")
    for q in ("", "a", "ab", "aba", "bbbb", "abab" * 2):
        for least in (-1, 0, 2, 5):
            want = sorted((k, model_score(q, k)[1]) for k in keys if model_score(q, k)[0] and model_score(q, k)[2] >= least)
            got = df.filter(fuzzy.fuzzy_match(F.col("k"), q, least)).select("k", fuzzy.fuzzy_score(F.col("k"), q)).collect()
            assert sorted(map(tuple, got)) == want
        by = df.filter(fuzzy.fuzzy_match(F.col("b"), q.encode(), 2)).count()
        assert by == sum(model_score(q, k)[0] and model_score(q, k)[2] >= 2 for k in keys)


def test_ordered_view_equals_a_model(spark):
    r = random.Random(2)
    model = {r.randint(-128, 126): r.randint(-128, 126) for _ in range(120)}
    view = OrderedView(spark.createDataFrame(list(model.items()), "k int, v int"), "k")
    keys = lambda df: [x.k for x in df.collect()]
    for _ in range(4):
        a, b = r.randint(-128, 126), r.randint(-128, 126)
        low, high = sorted((a, b))
        assert sorted(keys(view.collect_between(a, b))) == sorted(k for k in model if low <= k <= high)
        assert sorted(keys(view.exclude_range(a, b))) == sorted(k for k in model if not low <= k <= high)
        assert sorted(keys(view.collect_from(a, False))) == sorted(k for k in model if k > a)
        assert sorted(keys(view.collect_to(a))) == sorted(k for k in model if k <= a)
    assert keys(view.in_order(10)) == sorted(model)[:10] and keys(view.in_order(3, True)) == sorted(model)[::-1][:3]
    gone = next(iter(model))
    assert keys(view.remove(gone).get(gone)) == [] and keys(view.get(gone)) == [gone]


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_cell_arithmetic(spark):
    i, l, f, d = T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
    n = lambda v, k: F.lit(v).cast(k)
    top, big, least = (1 << 31) - 1, (1 << 63) - 1, -(1 << 63)
    assert value(spark, cells.add(n(top, i), n(1, i), i, i)) == -(1 << 31) and value(spark, cells.add(n(big, l), n(1, i), l, i)) == least
    assert value(spark, cells.sub(n(least, l), n(1, l), l, l)) == big and value(spark, cells.neg(n(least, l), l)) == least
    for a, b in ((big, big), (least, -1), (1 << 40, 1 << 41), (-3, 5), (123456789012, -987654321)):
        assert value(spark, cells.mul(n(a, l), n(b, l), l, l)) == (a * b + (1 << 63)) % (1 << 64) - (1 << 63)
    assert value(spark, cells.mul(n(top, i), n(top, i), i, i)) == 1
    assert [value(spark, cells.div(n(a, i), n(b, i), i, i)) for a, b in ((7, 2), (-7, 2), (7, -2), (1, 0))] == [3, -3, -3, None]
    assert value(spark, cells.div(n(big, l), n(3, l), l, l)) == big // 3 and value(spark, cells.div(n(least, l), n(-1, l), l, l)) == least
    assert [value(spark, cells.div(n(a, d), n(0.0, d), d, d)) for a in (1.0, -1.0)] == [math.inf, -math.inf] and math.isnan(value(spark, cells.div(n(0.0, d), n(0.0, d), d, d)))
    assert [value(spark, cells.mod(n(a, i), n(2, i), i, i)) for a in (7, -7)] == [1, -1]
    assert dict(spark.range(1).select(cells.add(n(1, i), n(0.5, f), i, f).alias("x")).dtypes)["x"] == "float"
    assert value(spark, cells.add(F.lit("a"), n(1, i), T.StringType(), i)) == "a1" and value(spark, cells.absolute(n(-5, i), i)) == 5
    assert [value(spark, cells.compare(n(a, d), n(b, d))) for a, b in ((math.nan, 1.0), (math.nan, math.nan), (1.0, math.nan), (2.0, 1.0))] == [-1, 0, 1, 1]
    assert value(spark, cells.is_negative(n(-0.0, d))) and value(spark, cells.is_subnormal(n(1e-310, d), d)) and not value(spark, cells.is_normal(n(0.0, d), d))
    assert value(spark, cells.is_integer(n(1e300, d), d)) and not value(spark, cells.is_integer(n(1.5, d), d)) and value(spark, cells.is_odd_integer(n(-3.0, d), d))
    assert value(spark, cells.max_magnitude_number(n(math.nan, d), n(1.0, d))) == 1.0 and math.isnan(value(spark, cells.max_magnitude(n(math.nan, d), n(1.0, d))))
    assert [tuple(value(spark, cells.parse(F.lit(s)))) for s in ("12", "-1.5", "x", "1" * 30)] == [(12, None), (None, -1.5), (None, None), (None, float("1" * 30))]
    assert value(spark, cells.to_text(F.lit(b"\1\xff"), T.BinaryType())) == "01FF"


def test_dump_layouts_and_streams(spark, tmp_path):
    r = net(spark, "identity")
    r.dump(str(tmp_path / "dump"))
    again = Registry.load(spark, str(tmp_path / "dump"), r.schema)
    assert same_rows(again.df, r.df) and again.insert((1, "test1", CLEF, b"\1\2\3\4", 0.0)) is False
    files.write_ordered(spark.range(1000), str(tmp_path / "ordered"), "id", 4)
    assert len(glob.glob(str(tmp_path / "ordered/part-*"))) == 4
    os.makedirs(tmp_path / "in")
    r.df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    sink = Registry(spark, r.schema)
    stream = spark.readStream.schema(r.df.schema).parquet(str(tmp_path / "in"))
    for k in range(2):  # replayed input adds nothing
        insert_stream(sink, stream, str(tmp_path / f"check{k}")).awaitTermination()
    assert sink.count() == r.count()


def test_first_wins_keeps_whole_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "b", 2), (1, None, "a", 1), (2, None, None, 1)], "k int, n int, v string, o int")
    assert sorted((x.k, x.v) for x in first_wins(df, ["k", "n"], F.col("o")).collect()) == [(1, "a"), (2, None)]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})")
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11 and set(e.oracle_sql()) <= set(e.queries())


class Absent:
    """An import hook for which some modules do not exist."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if name in self.names:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "tessera.llm"])
def test_entry_without_the_corpus_operators(monkeypatch, gone):
    import __spark_entry__ as e

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Absent(gone), *sys.meta_path])
    assert set(e.queries()) == set(queries.QUERIES) and set(e.oracle_sql()) == set(queries.SQL)


def test_entry_reports_other_missing_modules(monkeypatch):
    import __spark_entry__ as e

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Absent("tessera.llm._util"), *sys.meta_path])
    root = os.path.dirname(e.__file__)
    if all(os.path.exists(os.path.join(root, x)) for x in ("corpus_pipeline.py", "tessera/llm/queries.py")):
        with pytest.raises(ModuleNotFoundError):
            e.queries()


@pytest.mark.parametrize("key", ["a", "ab", "abc", "abca", "aa", "aaaa", "éb", "widget", ""])
def test_compared_grams_match_like_arrays(spark, monkeypatch, key):
    values = [None, "", "a", "b", "ab", "ba", "aa", "abc", "cab", "aaa", "aaab", "éb", "aéb", "red widget", "widgets", "wid", "get"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    both = []
    for bound in (96, -1):
        monkeypatch.setattr(fuzzy, "COMPARED", bound)
        both.append(df.select(fuzzy.fuzzy_score(F.col("v"), key).alias("s"), *[fuzzy.fuzzy_match(F.col("v"), key, n).alias(f"m{n}") for n in (-1, 0, 1, 3)]).collect())
    assert both[0] == both[1]


def test_equality_over_mixed_numbers(spark):
    rows = [(1, 1.0), (1, 1.5), (2**53 + 1, float(2**53)), (2**53, float(2**53)), (0, -0.0), (5, float("nan")), (2**63 - 1, 2.0**63), (None, 1.0)]
    df = spark.createDataFrame(rows, "i long, d double")
    i, d, ti, td = F.col("i"), F.col("d"), T.LongType(), T.DoubleType()
    got = df.select(cells.equal(i, d, ti, td).alias("x"), cells.equal(d, i, td, ti).alias("y"), (cells.number_hash(i, ti) == cells.number_hash(d, td)).alias("h")).collect()
    want = [True, False, False, True, True, False, False, False]
    assert [r.x for r in got] == [r.y for r in got] == want and all(r.h for r, w in zip(got, want) if w)


def rows_read(df):
    """Rows that the scans of a collected DataFrame read."""
    rows = 0
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numOutputRows"):
            rows += metrics.apply("numOutputRows").value()
    return rows


@pytest.fixture
def plain_plans(spark):
    options = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def numbered_table(spark, **options):
    schema = table_schema([column("id", T.LongType(), "generic"), column("v", T.LongType(), "btree", hashed=False), column("g", T.StringType(), "generic", hashed=False)])
    return Registry(spark, schema, **options)


def numbers(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") * 7919 % 100003).alias("v"), F.concat(F.lit("g"), F.col("id") % 50).alias("g"))


def test_inserts_do_not_exchange_the_table(spark, plain_plans):
    r = numbered_table(spark, index_rows=1)
    assert r.bulk_insert(numbers(spark, 0, 5000)) == 5000
    assert [(p.rows, p.buckets) for p in r.parts] == [(5000, r.buckets)]
    batch = first_wins(numbers(spark, 4000, 6000), ["id"], F.lit(0))
    plan = new_rows_bucketed(r.parts[0].df, batch, ["id"], r.buckets)._jdf.queryExecution().executedPlan().toString()
    # The one exchange is the batch's own, in which the first row of each identity is found.
    assert "SortMergeJoin" in plan and sum("Exchange" in line for line in plan.splitlines()) == 1
    assert r.bulk_insert(numbers(spark, 4000, 6000)) == 1000 and r.count() == 6000
    assert r.bulk_insert([(1, 1, "x"), (7000, 1, "x"), (7000, 2, "x")]) == 1 and r.count() == 6001


def test_fetches_skip_buckets_and_row_groups(spark, plain_plans):
    spark.conf.set("parquet.block.size", 16384)
    r = numbered_table(spark, index_rows=1)
    try:
        r.bulk_insert(numbers(spark, 0, 40000))
    finally:
        spark.conf.unset("parquet.block.size")
    point = r.fetch(col("id").eq(123))
    assert len(point.collect()) == 1 and rows_read(point) < 40000 / r.buckets * 1.2
    span = r.fetch(col("v").between(100, 200))
    assert span.count() == numbers(spark, 0, 40000).filter("v between 100 and 200").count()
    span.collect()
    assert rows_read(span) < 20000


def test_parts_of_like_size_are_merged(spark):
    r, n = numbered_table(spark, index_rows=100, buckets=2), 0
    for k in range(12):
        n += r.bulk_insert(numbers(spark, k * 40, k * 40 + 60))
    assert n == r.count() == 500 and len(r.parts) <= 6
    big = [p.rows for p in r.parts if p.laid_out]
    assert all(a > 2 * b for a, b in zip(big, big[1:])) and sum(p.rows for p in r.parts) == 500
    for k in range(10):
        assert r.delete(col("id").eq(k)) == 1
    assert r.count() == 490 and max(p.deletions for p in r.parts) <= 8 and r.bulk_insert([(3, 3, "back"), (30, 3, "there")]) == 1
    r.rollback(11)
    assert r.count() == 500
    bag = numbered_table(spark, index_rows=100, dedup="none")
    assert bag.bulk_insert(numbers(spark, 0, 150)) == 150 and bag.bulk_insert(numbers(spark, 0, 150)) == 150 and bag.count(col("v").le(0)) == 2


def test_a_null_stops_an_insert(spark):
    r = numbered_table(spark)
    holed = numbers(spark, 0, 10).withColumn("g", F.when(F.col("id") != 7, F.col("g")))
    with pytest.raises(E.ConstraintCheckFailed):
        r.bulk_insert(holed)
    assert r.count() == 0 and r.version == 0 and r.bulk_insert([]) == 0


def test_laid_out_floats_decimals_and_bytes(spark):
    schema = table_schema([column("a", T.DoubleType(), "btree"), column("b", T.DecimalType(29, 2), "btree"), column("c", T.BinaryType(), "generic")])
    r = Registry(spark, schema, index_rows=1)
    rows = [(0.0, decimal.Decimal("1.00"), b"x"), (-0.0, decimal.Decimal("1"), b"x"), (math.nan, decimal.Decimal("2"), b""), (1.5, decimal.Decimal("2"), b"y")]
    assert r.bulk_insert(rows) == 3 and r.bulk_insert(rows) == 0
    assert r.bulk_insert(spark.createDataFrame(rows, schema)) == 0 and r.count() == 3


def test_stored_gram_index(spark, tmp_path):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["red widget", "bread", "", "a", "ab", "widgets red", "none of it"] * 30)], "id long, w string")
    index = fuzzy.store_index(words, "id", "w", str(tmp_path / "grams"), 4)
    for key, least in (("red widgit", 6), ("a", -1), ("ab", 2), ("", -1)):
        found = {tuple(x) for x in fuzzy.search_index(index, "id", key, least).collect()}
        wanted = {tuple(x) for x in fuzzy.search_index(fuzzy.gram_index(words, "id", "w"), "id", key, least).collect()}
        plain = {x.id for x in words.filter(fuzzy.fuzzy_match(F.col("w"), key, least)).collect()}
        assert found == wanted and {x for x, _ in found} == plain
    assert "PushedFilters: [Or(" in fuzzy.search_index(index, "id", "red", 1)._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        files.scratch(Elsewhere, "x")


def test_list_helpers(spark):
    r = numbered_table(spark)
    r.bulk_insert([(1, 2, "a")])
    assert asyncio.run(r.to_list_async()) == r.to_list() and asyncio.run(r.to_array_async(col("id").eq(1))) == r.to_array() == ((1, 2, "a"),)


def test_digests_beside_the_built_in_ones(spark):
    made = spark.createDataFrame([("",), ("abc",), (None,)], "s string").select("s", cells.digest(F.col("s"), "xxh128").alias("x"), cells.digest(F.col("s"), "blake2b").alias("b")).collect()
    # Published values of both functions for the empty text and blake2b's for abc.
    assert made[0].x == "99aa06d3014798d86001c324468d497f" and made[0].b.startswith("786a02f742015903c6c6fd852552d272")
    assert made[1].b.startswith("ba80a53f981c4d0d6a2797b69f12f6e9") and made[2].x is None and made[2].b is None


def test_wrapping_at_64_bits(spark):
    values = [0, 1, -1, 2, -2, 3, 1 << 31, (1 << 62) + 5, (1 << 63) - 1, -(1 << 63), None]
    rows = [(x, y) for x in values for y in values]
    kind = T.LongType()
    made = spark.createDataFrame(rows, "x long, y long").select("x", "y", *[f(F.col("x"), F.col("y"), kind, kind).alias(n) for n, f in (("a", cells.add), ("s", cells.sub), ("m", cells.mul))]).collect()
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    for r in made:
        want = [None] * 3 if r.x is None or r.y is None else [wrap(r.x + r.y), wrap(r.x - r.y), wrap(r.x * r.y)]
        assert [r.a, r.s, r.m] == want
    assert [value(spark, f(F.lit(1.5))) for f in (cells.is_canonical, cells.is_complex_number, cells.is_imaginary_number)] == [True, False, False]
