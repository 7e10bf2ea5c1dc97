import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import codecs, hashing, records, utils
from millrace.sources.envelope import HEADERS

EDGES = [0, 1, -1, -2, -4, 10, 255, 256, -256, 2**31, 2**63 - 1, -(2**63)]


def test_int_codec(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "x long").select("x", codecs.INT.encode(F.col("x")).alias("b"))
    for r in df.select("x", "b", codecs.INT.decode(F.col("b")).alias("y")).collect():
        assert bytes(r.b) == r.x.to_bytes(8, "little", signed=True) and r.y == r.x


def test_sortable_codec(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "x long").select("x", codecs.LEXO.encode(F.col("x")).alias("b"))
    rows = df.select("x", "b", codecs.LEXO.decode(F.col("b")).alias("y")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: bytes(r.b))] == sorted(EDGES)
    assert all(r.y == r.x and len(r.b) == 9 for r in rows)
    bad = spark.createDataFrame([(b"123",), (None,)], "b binary").select(codecs.LEXO.malformed(F.col("b")).alias("m")).collect()
    assert [r.m for r in bad] == [True, False]


def test_json_codec(spark):
    c = codecs.json_codec("id string, n struct<a:int>")
    df = spark.createDataFrame([('{"id":"x","n":{"a":1}}',), ("{bad",), (None,)], "v string")
    got = [r.e for r in df.select(c.decode(F.col("v")).alias("e")).collect()]
    assert got[0].id == "x" and got[0].n.a == 1 and got[1:] == [None, None]
    back = df.limit(1).select(F.decode(c.encode(c.decode(F.col("v"))), "UTF-8").alias("s")).first().s
    assert back == '{"id":"x","n":{"a":1}}'


@pytest.mark.parametrize("key,want", [("21", -973932308), ("foobar", -790332482), ("a-little-bit-long-string", -985981536), ("abc", 479470107)])
def test_murmur2_known_answers(key, want):
    assert hashing.murmur2([key.encode()])[0] == want


@settings(max_examples=40)
@given(st.lists(st.binary(max_size=12), max_size=20))
def test_murmur2_does_not_depend_on_neighbours(keys):
    assert hashing.murmur2(keys).tolist() == [int(hashing.murmur2([k])[0]) for k in keys]


def test_hashes_in_spark(spark):
    df = spark.createDataFrame([(b"21",), (b"",), (b"a",)], "k binary")
    rows = df.select("k", hashing.xxhash64_seed0("k").alias("h"), hashing.murmur2_partition(F.col("k"), 10).alias("p"), hashing.shard_of(F.col("k"), 4).alias("s")).collect()
    for r in rows:
        h = xxhash.xxh64_intdigest(bytes(r.k))
        assert np.uint64(r.h) == np.uint64(h) if r.h >= 0 else r.h + 2**64 == h
        assert r.s == h & 31 and 0 <= r.p < 10
    assert rows[0].p == (-973932308 & 0x7FFFFFFF) % 10


def test_records(spark):
    df = spark.sql(f"""SELECT CAST('k' AS BINARY) key, CAST('vv' AS BINARY) value, CAST(h AS {HEADERS}) headers FROM VALUES
      (array(struct('a', CAST('1' AS BINARY)), struct('__grt__', CAST('t1' AS BINARY)), struct('a', CAST('2' AS BINARY)), struct('__grt__', CAST('t2' AS BINARY)))),
      (array(struct('gkes__mark', CAST('x' AS BINARY)))), (array()) AS t(h)""")
    rows = df.select(
        records.record_type().alias("t"), F.decode(records.header_value("a"), "UTF-8").alias("a"), records.is_marker().alias("m"), records.record_size().alias("n"),
        F.size(records.stamp_type(F.lit("new"))).alias("stamped"), F.size(records.stamp_type(F.lit(""))).alias("plain"), records.serialised(F.lit(b"")).alias("none"),
    ).collect()
    assert [r.t for r in rows] == ["t2", "", ""]
    assert [r.a for r in rows] == ["1", None, None]
    assert [r.m for r in rows] == [False, True, False]
    assert [r.n for r in rows] == [3 + 2 + 2 * (7 + 2) + 2, 3 + 11, 3]
    assert [r.stamped for r in rows] == [4, 2, 1] and [r.plain for r in rows] == [4, 1, 0]
    assert all(r.none is None for r in rows)


def test_utils(spark):
    df = spark.sql("SELECT array(1, 9, 4, 10, -1, 25) a, CAST(array() AS array<int>) e")
    r = df.select(utils.min_n(F.col("a")).alias("lo"), utils.max_n(F.col("a")).alias("hi"), utils.min_n(F.col("e")).alias("zero")).first()
    assert (r.lo, r.hi, r.zero) == (-1, 25, 0)
