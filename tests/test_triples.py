"""Golden values, the ten-triple scans, histograms, the store and the commands."""

import bisect
import random
import shutil
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from triplane import catalogue
from triplane.functions import encoding as E
from triplane.functions import partitioning as P
from triplane.functions import transforms
from triplane.operators import histogram as H
from triplane.operators import reads, triples
from triplane.sources import commands, config, generate
from triplane.sources.store import TripleStore
from triplane.streaming.puts import put_stream

SF = "/root/testdata/sf0.001"


def test_golden_integers(spark):
    golden = {-1234567891: "---7898765432108", -10: "--789", -9: "-0", 0: "0", 10: "++210"}
    rows = spark.createDataFrame([(k,) for k in golden], "v long").select("v", E.encode_int(F.col("v"), "-", "+").alias("e"))
    rows = rows.withColumn("back", E.decode_int(F.col("e"), "-", "+").cast("long")).collect()
    assert {r.v: r.e for r in rows} == golden and all(r.v == r.back for r in rows)


@pytest.mark.parametrize(
    ("f", "value", "precision", "code"),
    [
        (E.encode_small, -0.0123, 4, "-9876+"), (E.encode_small, 0.999, 3, "+999-"), (E.encode_large, -100.5, 1, "--68994+"),
        (E.encode_large, 3.14, 2, "+314-"), (E.encode_float, -1.4, 2, "--885+"), (E.encode_float, 0.00123, 3, "+-7123-"), (E.encode_float, 1.0, 1, "++11-"),
    ],
)
def test_golden_decimals(spark, f, value, precision, code):
    assert spark.range(1).select(f(F.lit(value), precision, "-", "+")).first()[0] == code


def test_float_round_trip_and_order(spark):
    values = [-3e250, -98765.4321, -1.4, -5e-9, 0.0, 1e-200, 0.00123, 1.0, 7.5e11, 3e250]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", E.encode_float(F.col("v"), 12).alias("e"))
    rows = rows.withColumn("back", E.decode_float(F.col("e"))).collect()
    assert all(r.back == pytest.approx(r.v, rel=1e-9) for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.e.encode())] == values
    assert spark.range(1).select(E.decode_float(F.lit("::")), E.decode_int(F.lit("?1"))).first() == (None, None)


#: Texts and what they stand for, of values between -1 and 1, and of any.
SMALL = {"-0004+": -0.9995, "-000+": -0.999, "-9876+": -0.0123, "-999876+": -0.000123, "0": 0, "+000123-": 0.000123, "+0123-": 0.0123, "+9995-": 0.9995}
LARGE = {"--68994+": -100.5, "+314-": 3.14, "0": 0}
#: Texts that are no encodings.
BAD = ["", "1", "-+", "+-", "0+", "+0", "?9876+", "?0123-", "-9876?", "+0123?", "?0123?", "-98x6+"]


@pytest.mark.parametrize(("decode", "golden"), [(E.decode_small, SMALL), (E.decode_large, LARGE)])
def test_decoding_of_decimals(spark, decode, golden):
    rows = spark.createDataFrame([(k,) for k in [*golden, *BAD, None]], "e string").select("e", decode(F.col("e"), "-", "+").alias("v"), "e")
    got = {r[0]: r[1] for r in rows.collect()}
    assert {k: got[k] for k in golden} == pytest.approx(golden)
    assert [got[k] for k in [*BAD, None]] == [None] * (len(BAD) + 1) if decode is E.decode_small else all(got[k] is None for k in BAD if k not in ("0+",))
    strict = lambda e: spark.range(1).select(E.strict(decode, F.lit(e).cast("string"), "-", "+").alias("v")).first().v
    assert strict(None) is None and strict(next(iter(golden))) == pytest.approx(golden[next(iter(golden))])
    with pytest.raises(Exception, match="no such encoding"):
        strict("?9876+")


def test_large_decimals_round_trip_and_order(spark):
    values = [-123456.75, -1000.25, -99.5, -1.25, -0.5, 0.0, 0.5, 7.0, 12.125, 100.5, 99999.875, 12345678901.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", E.encode_large(F.col("v"), 3).alias("e"))
    assert [r.back for r in rows.select(E.decode_large(F.col("e")).alias("back")).collect()] == values


def test_own_transforms_stand_before_built_in_ones(spark):
    rows = spark.createDataFrame([(-5, 2.5, "ab"), (None, None, None)], "i long, d double, t string")
    types, own = {"i": "INT64", "d": "DOUBLE", "t": "BYTE"}, {"INT64": (lambda c: c + 1, lambda c: c - 1)}
    coded = transforms.encoded(rows, types, own)
    assert coded.first().i == -4 and transforms.encoded(rows, types).first().i == "/4"
    assert transforms.decoded(coded, types, own).collect() == rows.collect()
    with pytest.raises(ValueError, match="NOTHING"):
        transforms.encoded(rows, {"i": "NOTHING"})


def test_generated_triples(spark):
    assert generate.fixed(spark, 3, 7).collect()[2] == ("subject-7-2", "predicate-7-2", "object-7-2", 2)
    a = generate.scattered(spark, 50, seed=3)
    assert {(len(r.s), len(r.p), len(r.o)) for r in a.collect()} == {(8, 4, 24)} and a.select("s").distinct().count() == 50
    assert a.collect() == generate.scattered(spark, 50, seed=3).collect() != generate.scattered(spark, 50, seed=4).collect()
    assert all(4 <= len(r.s) <= 12 and r.s.isalpha() for r in generate.words(spark, 50).collect())


def test_key_bytes(spark):
    key = E.encode_key(F.lit("subject"), F.lit("predicate"))
    r = spark.range(1).select(F.hex(key).alias("k"), E.decode_key(key).alias("d")).first()
    assert bytes.fromhex(r.k) == b"subjectpredicate\xff" + (7).to_bytes(8, "little") + (9).to_bytes(8, "little") + b"\7\7"
    assert (bytes(r.d.s), bytes(r.d.p), r.d.s_type, r.d.p_type) == (b"subject", b"predicate", 7, 7)


def test_hashes(spark):
    r = spark.range(1).select(*(f(F.lit("sub0"), F.lit("pred0")).alias(n) for n, f in P.HASHES.items())).first()
    assert (r.UTHASH_SAX, r.UTHASH_FNV, r.UTHASH_BER, r.SUM_MOD_DATASTORES) == (623107899, 1605933724, 1038804149, 853)


def _jenkins_alone(key: bytes, h: int) -> int:
    """Bob Jenkins's hash of 1996, a key at a time."""
    w, a, b, at = 0xFFFFFFFF, 0x9E3779B9, 0x9E3779B9, 0

    def mix(a, b, c):
        for x, y, z in ((13, 8, 13), (12, 16, 5), (3, 10, 15)):
            a = (a - b - c ^ (c >> x)) & w
            b = (b - c - a ^ (a << y)) & w
            c = (c - a - b ^ (b >> z)) & w
        return a, b, c

    word = lambda i: int.from_bytes(key[at + 4 * i : at + 4 * i + 4], "little")
    while len(key) - at >= 12:
        a, b, h = mix((a + word(0)) & w, (b + word(1)) & w, (h + word(2)) & w)
        at += 12
    last = int.from_bytes(key[at + 8 :], "little") << 8
    return mix((a + word(0)) & w, (b + word(1)) & w, (h + len(key) + last) & w)[2]


def _hsieh_alone(key: bytes, h: int) -> int:
    """Paul Hsieh's hash, a key at a time."""
    w, half = 0xFFFFFFFF, lambda i: int.from_bytes(key[i : i + 2], "little")
    for i in range(0, len(key) - 3, 4):
        h = (h + half(i)) & w
        h = ((h << 16) ^ ((half(i + 2) << 11) ^ h)) & w
        h = (h + (h >> 11)) & w
    i = len(key) // 4 * 4
    if len(key) % 4 == 3:
        h = (h + half(i)) & w
        h = (h ^ (h << 16) ^ (key[i + 2] << 18)) & w
        h += h >> 11
    elif len(key) % 4 == 2:
        h = (h + half(i)) & w
        h = (h ^ (h << 11)) & w
        h += h >> 17
    elif len(key) % 4 == 1:
        h = (h + key[i]) & w
        h = (h ^ (h << 10)) & w
        h += h >> 1
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h &= w
        h = (h ^ (h << left)) & w
        h = (h + (h >> right)) & w
    return h


def test_hash_units_against_the_published_hashes():
    r = random.Random(3)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in range(40)]
    for f, alone, seed in ((P._jenkins, _jenkins_alone, 0xFEEDBEEF), (P._hsieh, _hsieh_alone, 0xCAFEBABE)):
        with np.errstate(over="ignore"):
            assert f(words, np.full(len(words), seed, np.uint32)).tolist() == [alone(x, seed) for x in words]


def test_numbers_hash_by_their_machine_words(spark):
    rows = spark.createDataFrame([(258, -1, 1.5), (None, None, None)], "a long, b int, c double")
    got = rows.select(P.machine_bytes(F.col("a"), "INT64"), P.machine_bytes(F.col("b"), "INT32"), P.machine_bytes(F.col("c"), "DOUBLE"), P.machine_bytes(F.col("c"), "FLOAT")).collect()
    assert [bytes(x) for x in got[0]] == [(258).to_bytes(8, "little"), b"\xff" * 4, struct.pack("<d", 1.5), struct.pack("<f", 1.5)] and list(got[1]) == [None] * 4


def test_hash_units_against_rows_alone():
    words = [b"", b"a", b"abcdefghijk", b"abcdefghijkl", b"abcdefghijklm" * 3, b"xyz"]
    for f in (P._jenkins, P._hsieh):
        with np.errstate(over="ignore"):
            together = f(words, np.full(len(words), 5, np.uint32))
            assert together.tolist() == [int(f([w], np.full(1, 5, np.uint32))[0]) for w in words]


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(0, float(i), -i, i) for i in range(10)], "s long, p double, o int, seq long").cache()


@pytest.mark.parametrize("i", [0, 4, 9])
def test_scans(ten, i):
    got = lambda op, n=10: [r.p for r in reads.getop(ten, op, 0, float(i), n).collect()]
    assert got("EQ") == [i] and got("NEXT") == list(range(i, 10)) and got("PREV") == list(range(i, -1, -1))
    assert got("FIRST") == list(range(10)) and got("LAST") == list(range(9, -1, -1))
    assert [r.p for r in reads.getop(ten, "LOWEST", 0, n=3).collect()] == [0, 1, 2]
    assert [r.p for r in reads.getop(ten, "HIGHEST", 0, n=3).collect()] == [9, 8, 7]
    bad = reads.getop(ten, "INVALID", 0, float(i)).collect()
    assert len(bad) == 1 and bad[0].status == "ERROR" and bad[0].o is None


def test_batch_scans(spark, ten):
    asked = spark.createDataFrame([(1, 0, 2.0, 3), (2, 0, 8.5, 5), (3, 0, 99.0, 2), (4, 7, 0.0, 2)], "rid long, s long, p double, n long")
    rows = lambda op: sorted((r.rid, r.rn, r.p) for r in reads.bgetop(ten, asked, op).collect())
    assert rows("NEXT") == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 9)]
    assert rows("PREV") == [(1, 1, 2), (1, 2, 1), (1, 3, 0), (2, 1, 9), (2, 2, 8), (2, 3, 7), (2, 4, 6), (2, 5, 5)]
    assert rows("HIGHEST")[:3] == [(1, 1, 9), (1, 2, 8), (1, 3, 7)] and not [r for r in rows("LOWEST") if r[0] == 4]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_batch_of_mixed_ops_and_prefixes(spark, kind):
    names = ["", "a", "a1", "a1x", "a2", "az", "aé", "a\U0010ffff", "a\U0010ffffz", "b", "é", "éz"]
    rows = spark.createDataFrame([(s, p, float(i), i) for i, (s, p) in enumerate((s, p) for s in (1, 2, 4) for p in names)], "s long, p string, o double, seq long")
    ops = [
        *[(op, s, p, n) for op in ("EQ", "NEXT", "PREV", "FIRST", "LAST", "LOWEST", "HIGHEST") for s, p, n in ((2, "a1", 3), (3, "x", 2), (9, "a", 2))], *[(op, 2, p, 50) for op in ("LOWEST", "HIGHEST") for p in ("a", "a1", "é", "a\U0010ffff", "q", None)],
        ("INVALID", 7, "q", 2), (None, 7, "q", 2), ("EQ", 1, "a2", 0), ("NEXT", 1, "a", 0), ("FIRST", 1, "", 1000), ("PREV", 4, "b", 10**12),
    ]
    asked = spark.createDataFrame([(i, *x) for i, x in enumerate(ops)], "rid long, op string, s long, p string, n long")
    if kind == "binary":
        rows, asked = (x.withColumn("p", F.col("p").cast("binary")) for x in (rows, asked))
    got = [[] for _ in ops]
    for r in sorted(reads.bgetop(rows, asked).collect(), key=lambda r: (r.rid, r.rn)):
        p = r.p.decode() if kind == "binary" else r.p
        got[r.rid].append((r.s, p, r.o, r.status))
        assert r.rn == len(got[r.rid])
    keys = sorted(((r.s, r.p if kind == "string" else r.p.decode(), r.o) for r in rows.collect()), key=lambda k: (k[0], k[1].encode()))
    for (op, s, p, n), found in zip(ops, got, strict=True):
        at = [k for k in keys if (k[0], k[1].encode()) >= (s, (p or "").encode())]
        back = [k for k in reversed(keys) if at and k[:2] <= at[0][:2]] if op == "PREV" else []
        inside = [k for k in keys if k[0] == s and k[1].startswith(p or "")]
        want = {"EQ": at[:1], "NEXT": at[:n], "PREV": back[:n], "FIRST": keys[:n], "LAST": keys[::-1][:n], "LOWEST": inside[:n], "HIGHEST": inside[::-1][:n]}.get(op)
        assert found == ([(*k, "SUCCESS") for k in want] if want is not None else [(s, p, None, "ERROR")]), (op, s, p, n)


def test_batch_of_one_op_takes_every_op(ten, spark):
    asked = spark.createDataFrame([(1, 0, 2.0, 3)], "rid long, s long, p double, n long")
    rows = lambda op: [(r.p, r.o, r.status) for r in reads.bgetop(ten, asked, op).orderBy("rn").collect()]
    assert [r[0] for r in rows("FIRST")] == [0, 1, 2] and [r[0] for r in rows("LAST")] == [9, 8, 7] and [r[0] for r in rows("EQ")] == [2]
    assert rows("INVALID") == [(2.0, None, "ERROR")]


def test_permutations_and_upsert(spark):
    rows = spark.createDataFrame([("a", "p", "x", 1), ("b", "p", "x", 2)], "s string, p string, o string, seq long")
    for mask in range(64):
        assert triples.permute(rows, mask).count() == 2 * bin(mask).count("1") or mask % 21
    pos = triples.latest(triples.permute(rows, 8), ["k1", "k2"]).collect()
    assert len(pos) == 1 and pos[0].v == "b"


def test_missing_key(spark, ten):
    r = reads.get(ten, 5, 1.0).collect()
    assert len(r) == 1 and r[0].status == "ERROR" and r[0].o is None


def test_histograms(spark):
    values = spark.createDataFrame([(float(i), i) for i in range(10)], "o double, seq long")
    count = lambda g, first=10, v=values: [r["count"] for r in H.histogram(v, [], first, g).orderBy("bucket").collect()]
    assert count(H.fixed([0, 5, 9])) == [5, 4, 1] and count(H.fixed([0, 2, 4, 6, 8])) == [2] * 5
    assert count("10_BUCKETS") == [1] * 10 and count("UNIFORM_LOG10") == [1] * 10
    assert [len(count(g)) for g in ("SQUARE_ROOT_CHOICE", "STURGES_FORMULA", "RICE_RULE", "UNIFORM_LOG2", "UNIFORM_LOG10")] == [3, 5, 4, 3, 10]
    assert count("10_BUCKETS", 11) == [] and H.status(values, [], 11).first().status == "ERROR"
    more = values.unionByName(spark.createDataFrame([(20.0, 10)], values.schema))
    assert count("UNIFORM_LOG10", 10, more) == [1] * 9 + [2]


def test_rank_tables(spark):
    for c, s in ((1, 1), (2, 1), (3, 2), (2, 3), (5, 2)):
        size = 12
        rows = spark.range(-1, 13).select(F.col("id").cast("int").alias("r")).select("r", P.is_server(F.col("r"), F.lit(size), c, s).alias("i"), P.server_id(F.col("r"), F.lit(size), c, s).alias("id"))
        for x in rows.collect():
            inside = 0 <= x.r < size
            assert x.i == (-1 if not inside else int(x.r % c < s))
            assert x.id == (-1 if not inside or (s < c and x.r % c >= s) else x.r if s >= c else x.r // c * s + x.r % c)


def test_store(spark, tmp_path):
    conf = config.Config(datastore_prefix=str(tmp_path), datastore_basename="old", datastores_per_server=3, histogram_first_n=2)
    rows = spark.createDataFrame([("s0", "p", 1.0, 1), ("s0", "p", 2.0, 2), ("s1", "p", 3.0, 3), (None, "p", 1.0, 4)], "s string, p string, o double, seq long")
    with TripleStore.open(spark, conf) as store:
        store.bput(rows)
        store.bget(rows.select("s", "p").filter("s = 's1'"))
        assert sorted((r.op, r.status) for r in store.flush().collect()) == [("GET", "SUCCESS"), ("PUT", "ERROR"), ("PUT", "SUCCESS"), ("PUT", "SUCCESS"), ("PUT", "SUCCESS")]
        assert store.get("s0", "p").first().o == 2.0
        assert sum(r["count"] for r in store.histogram().collect()) == 3
        assert store.sync().count() == 3
    again = TripleStore.open(spark, conf)
    assert again.get("s1", "p").first().status == "SUCCESS" and again.log.count() == 3
    again.change_datastore_name("new")
    assert again.get("s1", "p").first().status == "ERROR"


def test_a_failed_sync_loses_nothing_and_a_batch_counts_once(spark, tmp_path):
    conf = config.Config(datastore_prefix=str(tmp_path), histogram_first_n=1)
    row = lambda *x: spark.createDataFrame([x], "s string, p string, o double, seq long")
    store = TripleStore.open(spark, conf)
    for number, o in ((0, 1.0), (1, 2.0)):
        store.bput(row("a", "p", o, number))
        store.sync(("stream", number))
    (tmp_path / "datastore" / "state" / "v=9").mkdir()  # a manifest that was never written
    again = TripleStore.open(spark, conf)
    assert again.get("a", "p").first().o == 2.0 and again.log.count() == 2 and again.batches == {"stream": 1}
    again.bput(row("b", "p", 3.0, 2))
    assert TripleStore.open(spark, conf).get("b", "p").first().status == "ERROR"

    rows = spark.createDataFrame([("c", "p", 1.0, 1)], "s string, p string, o double, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    once = TripleStore.open(spark, config.Config(datastore_prefix=str(tmp_path), datastore_basename="streamed"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    put_stream(read(), once, str(tmp_path / "state")).awaitTermination()
    shutil.rmtree(tmp_path / "state" / "commits")  # as if the driver had died before it could commit the batch
    put_stream(read(), once, str(tmp_path / "state")).awaitTermination()
    assert once.log.count() == 1 and once.version == 1


def test_config_and_commands(spark, tmp_path):
    path = tmp_path / "conf"
    path.write_text("# comment\nHASH UTHASH_FNV\nHISTOGRAM_FIRST_N 7\n\nHASH UTHASH_OAT\n")
    c = config.load(spark, str(path), environment={"TRIPLANE_HISTOGRAM_FIRST_N": "9"})
    assert (c.hash, c.histogram_first_n) == ("UTHASH_OAT", 9)
    assert config.read_table(spark, str(path)).count() == 3
    lines = spark.createDataFrame([(1, "PUT BYTE s BYTE p DOUBLE 1.5"), (2, "BGET 2 BYTE a BYTE b DOUBLE BYTE c BYTE d INT32"), (3, "FLUSH"), (4, "GETOP BYTE s BYTE p DOUBLE 3 NEXT"), (5, "PUT x"), (6, "NO")], "line int, value string")
    got = [(r.line, r.i, r.verb, r.s, r.p, r.o, r.n, r.op) for r in commands.parse(lines).orderBy("line", "i").collect()]
    assert got == [
        (1, 0, "PUT", "s", "p", "1.5", None, None), (2, 0, "GET", "a", "b", None, None, None), (2, 1, "GET", "c", "d", None, None, None), (3, 0, "FLUSH", None, None, None, None, None),
        (4, 0, "GETOP", "s", "p", None, 3, "NEXT"), (5, 0, "ERROR", None, None, None, None, None), (6, 0, "ERROR", None, None, None, None, None),
    ]


@pytest.mark.parametrize("name", ["bgetop_prev", "hist_scott_fixed", "app_energy_band", "put_upsert_latest", "hash_oat", "stream_put_equals_batch", "hash_sax_long", "elen_small_roundtrip", "elen_large_roundtrip", "transform_own", "transform_roundtrip", "generated_triples", "store_reopen", "getop_prev", "hist_per_datastore"])
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events", "lineitem", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)
    assert got.sort_values(order).astype(object).values.tolist() == want.sort_values(order).astype(object).values.tolist()


@pytest.mark.parametrize("op", ["next", "prev", "lowest", "highest"])
def test_every_event_asks(spark, op):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    keys = sorted((e.event_type, e.event_id, e.value) for e in events)
    want = []
    for e in events:
        at, n = bisect.bisect_left(keys, (e.event_type, e.event_id + 1)), 1 + e.event_id % 5
        inside = [k for k in keys if k[0] == e.event_type] if op in ("lowest", "highest") else []
        back = keys[at::-1] if at < len(keys) else []
        found = {"next": keys[at:], "prev": back, "lowest": inside, "highest": inside[::-1]}[op][:n]
        want += [(e.event_id, i + 1, *k) for i, k in enumerate(found)]
    assert sorted(map(tuple, catalogue.queries()[f"bgetop_{op}_all"](spark, SF).collect())) == sorted(want)


def test_every_order_is_asked_for(spark):
    orders = {r.o_orderkey: r.o_totalprice for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    returned = {r.l_orderkey for r in spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_returnflag = 'R'").collect()}
    rows = lambda name: sorted(tuple(r.asDict().get(c) for c in ("s", "o", "status")) for r in catalogue.queries()[name](spark, SF).collect())
    pairs = lambda keys, miss="ERROR": sorted([*((k, "SUCCESS") for k in keys), *((-k - 1, miss) for k in keys)])
    for name in ("bget_hits_and_misses_all", "bget_typed_mismatch_all"):
        assert rows(name) == [(k, orders.get(k), x) for k, x in pairs(orders)]
    assert 0 < len(returned) < len(orders) and rows("bdelete_returned") == [(k, orders[k], None) for k in sorted(set(orders) - returned)]
    assert rows("bdelete_status_returned") == [(k, None, x) for k, x in pairs(returned)]
    assert rows("bdelete_status_lsm_returned") == [(k, None, x) for k, x in pairs(returned, "SUCCESS")]
