"""Bit extraction, sign extension and float bit-casts against a plain Python bit loop."""

import math
import random
import struct

from pyspark.sql import functions as F

from canlens.functions.bits import float32_from_bits, float64_from_bits, raw_bits, sign_extend


def _loop_le(payload: bytes, start: int, n: int) -> int:
    v = 0
    avail = len(payload) * 8
    for i in range(n):
        s = start + i
        if s >= avail:
            break
        v |= ((payload[s // 8] >> (s % 8)) & 1) << i
    return v


def _loop_be(payload: bytes, start: int, n: int) -> int:
    v = 0
    avail = len(payload) * 8
    for i in range(n):
        s = start + i
        if s >= avail:
            break
        v = (v << 1) | ((payload[s // 8] >> (7 - s % 8)) & 1)
    return v


def _to_signed64(v: int) -> int:
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >= (1 << 63) else v


def test_raw_bits_random(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(3000):
        nbytes = rnd.choice([0, 1, 2, 3, 8, 8, 8, 12, 16, 64])
        payload = bytes(rnd.randrange(256) for _ in range(nbytes))
        n = rnd.randint(0, 64)
        start = rnd.randint(0, max(0, nbytes * 8 + 8))
        le = rnd.random() < 0.5
        exp = _loop_le(payload, start, n) if le else _loop_be(payload, start, n)
        rows.append((payload, start, n, le, _to_signed64(exp)))
    schema = "payload binary, start int, n int, le boolean, exp bigint"
    df = spark.createDataFrame(rows, schema)
    got = df.select(
        raw_bits(F.col("payload"), F.col("start"), F.col("n"), F.col("le")).alias("got"), "exp"
    )
    bad = got.filter(~F.col("got").eqNullSafe(F.col("exp"))).count()
    assert bad == 0


def test_sign_extend(spark):
    cases = [(0xFE, 8, -2), (0x7F, 8, 127), (0x800, 12, -2048), (5, 0, 5), (-1, 64, -1), (1, 1, -1)]
    df = spark.createDataFrame(cases, "raw bigint, n int, exp bigint")
    assert df.filter(sign_extend(F.col("raw"), F.col("n")) != F.col("exp")).count() == 0


def test_float_bits(spark):
    rnd = random.Random(3)
    vals32 = [1.5, -0.0, 0.0, float("inf"), -float("inf"), 1e-45, 3.4e38, -2.5e-40]
    vals32 += [struct.unpack("<f", struct.pack("<I", rnd.getrandbits(32)))[0] for _ in range(500)]
    rows = []
    for v in vals32:
        bits = struct.unpack("<I", struct.pack("<f", v))[0]
        rows.append((bits, struct.unpack("<f", struct.pack("<I", bits))[0]))
    df = spark.createDataFrame(rows, "raw bigint, exp double")
    out = df.select(float32_from_bits(F.col("raw")).alias("got"), "exp").collect()
    for r in out:
        if math.isnan(r.exp):
            assert math.isnan(r.got)
        else:
            assert struct.pack("<d", r.got) == struct.pack("<d", r.exp)
    vals64 = [1.5, -0.0, 5e-324, 1.7976931348623157e308, float("-inf")]
    vals64 += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(500)]
    rows = [(_to_signed64(struct.unpack("<Q", struct.pack("<d", v))[0]), v) for v in vals64]
    df = spark.createDataFrame(rows, "raw bigint, exp double")
    for r in df.select(float64_from_bits(F.col("raw")).alias("got"), "exp").collect():
        if math.isnan(r.exp):
            assert math.isnan(r.got)
        else:
            assert struct.pack("<d", r.got) == struct.pack("<d", r.exp)
