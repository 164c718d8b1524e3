"""Decode goldens (P2-P13) for both the compiled and the join strategies."""

import struct

import pytest
from pyspark.sql import functions as F

from canlens.errors import DecodeError
from canlens.operators.decode import decode_long, decode_nested
from canlens.sources.dbc import load_dbc
from helpers import write

DBC = """BO_ 700 Tank: 4 N
 SG_ Fill : 3|13@1+ (0.25,-7) [0|0] "" N
 SG_ Drift : 20|10@1- (3,0) [0|0] "" N
BO_ 701 Horn: 3 N
 SG_ Pitch : 5|14@0+ (1,0) [0|0] "" N
BO_ 702 Page: 3 N
 SG_ Leaf M : 4|3@1+ (1,0) [0|7] "" N
 SG_ Ink m5 : 8|9@1+ (1,0) [0|0] "" N
 SG_ Ply m2 : 11|6@1+ (1,0) [0|0] "" N
BO_ 703 Door: 2 N
 SG_ State : 6|5@1+ (1,0) [0|31] "x" N
VAL_ 703 State 19 "ajar" 3 "shut" ;
BO_ 6 Short: 8 N
 SG_ Cut : 8|16@1+ (1,0) [0|0] "" N
 SG_ CutBe : 8|16@0+ (1,0) [0|0] "" N
"""


def _frames(spark, rows):
    data = [("t", i, i * 10, cid, len(p), 0, 0, bytes(p)) for i, (cid, p) in enumerate(rows)]
    return spark.createDataFrame(data, "trace_id string, ordinal bigint, timestamp_ns bigint, can_id bigint, "
                                       "dlc int, channel int, frame_type int, payload binary")


@pytest.fixture(scope="module")
def dbc(spark, tmp_path_factory):
    return load_dbc(spark, write(tmp_path_factory.mktemp("dbc"), "t.dbc", DBC))


@pytest.mark.parametrize("strategy", ["compiled", "join"])
def test_goldens(spark, dbc, strategy):
    little = lambda n, *parts: list(sum(v << at for v, at in parts).to_bytes(n, "little"))
    fr = _frames(spark, [(700, little(4, (4803, 3), (-211 & 0x3FF, 20))), (701, list((9177 << 5).to_bytes(3, "big"))),
                         (702, little(3, (5, 4), (391, 8))), (702, little(3, (2, 4), (45, 11))),
                         (703, little(2, (19, 6))), (6, [0x01, 0x02]), (99, [1])])
    got = {(r.ordinal, r.signal_name): (r.raw_value, r.value, r.value_description)
           for r in decode_long(fr, dbc, strategy=strategy).collect()}
    assert got[(0, "Fill")][1] == 4803 * 0.25 - 7
    assert got[(0, "Drift")][1] == -633.0
    assert got[(1, "Pitch")][0] == 9177
    assert got[(2, "Leaf")][0] == 5 and got[(2, "Ink")][1] == 391.0 and (2, "Ply") not in got
    assert got[(3, "Leaf")][0] == 2 and got[(3, "Ply")][1] == 45.0 and (3, "Ink") not in got
    assert got[(4, "State")] == (19, 19.0, "ajar")
    # a frame shorter than the signal: LE keeps the low bits present, BE the bits present, not shifted up
    assert got[(5, "Cut")][0] == 0x02 and got[(5, "CutBe")][0] == 0x02
    assert not any(o == 6 for o, _ in got)  # unknown id dropped


@pytest.mark.parametrize("strategy", ["compiled", "join"])
def test_nested_order_and_undecoded(spark, dbc, strategy):
    fr = _frames(spark, [(700, [0x9D, 0x31, 0xE6, 0x07]), (99, [1])])
    out = {r.ordinal: r for r in decode_nested(fr, dbc, keep_undecoded=True, strategy=strategy).collect()}
    assert [s.name for s in out[0].signals] == ["Fill", "Drift"]
    assert out[1].message_name is None and out[1].signals is None


def test_float_signals(spark):
    from canlens.operators.decode import decode_long
    from canlens.sources.dbc import Dbc

    sig = spark.createDataFrame(
        [(7, 0, 0, "F32", False, None, 0, 32, True, False, "float32", 2.0, 5.0, 0.0, 0.0, ""),
         (7, 0, 1, "F64", False, None, 32, 64, True, False, "float64", 1.0, 0.0, 0.0, 0.0, "")],
        "can_id bigint, def_index bigint, signal_index int, signal_name string, is_multiplexer boolean, "
        "multiplex_value bigint, start_bit int, bit_length int, little_endian boolean, is_signed boolean, "
        "value_type string, scale double, offset double, minimum double, maximum double, unit string")
    msgs = spark.createDataFrame([(7, "Fl", 12, 0)], "can_id bigint, message_name string, dlc int, def_index bigint")
    labels = spark.createDataFrame([], "can_id bigint, signal_name string, raw_value bigint, label string")
    d = Dbc(msgs, sig, labels, msgs, labels)
    payload = struct.pack("<f", 1.5) + struct.pack("<d", -2.25)
    fr = _frames(spark, [(7, list(payload))])
    for strategy in ("compiled", "join"):
        got = {r.signal_name: r.value for r in decode_long(fr, d, strategy=strategy).collect()}
        assert got == {"F32": 1.5, "F64": -2.25}  # scale/offset are not applied to floats


def test_no_dictionary():
    with pytest.raises(DecodeError):
        decode_long(None, None)


MOTO = """BO_ 9 Moto: 2 N
 SG_ W16 : 7|16@0+ (1,0) [0|0] "" N
 SG_ Nib : 3|4@0+ (1,0) [0|0] "" N
 SG_ Lo : 8|4@1+ (1,0) [0|0] "" N
"""


@pytest.mark.parametrize("strategy", ["compiled", "join"])
def test_motorola_numbering(spark, tmp_path, strategy):
    d = load_dbc(spark, write(tmp_path, "m.dbc", MOTO))
    fr = _frames(spark, [(9, [0xAB, 0xCD])])
    got = {r.signal_name: r.raw_value for r in decode_long(fr, d, strategy=strategy, motorola=True).collect()}
    # standard numbering: MSB at bit 7 of byte 0 → 0xABCD; bits 3..0 of byte 0 → 0xB; LE unaffected
    assert got == {"W16": 0xABCD, "Nib": 0xB, "Lo": 0xD}
    seq = {r.signal_name: r.raw_value for r in decode_long(fr, d, strategy=strategy).collect()}

    def sequential(payload, start, n):  # the reference's big-endian rule, bit by bit
        v = 0
        for i in range(n):
            b = start + i
            if b >= len(payload) * 8:
                break
            v = (v << 1) | ((payload[b // 8] >> (7 - b % 8)) & 1)
        return v

    assert seq["Nib"] == sequential([0xAB, 0xCD], 3, 4) == 5
    assert seq["W16"] == sequential([0xAB, 0xCD], 7, 16) == 0x1CD  # cut short: 9 bits, not shifted up


def test_salted_join_spreads_hot_ids(spark, dbc):
    """Ids with many frames get buckets by their counts; results are those of the broadcast join, nested and long."""
    from canlens.operators.decode import _hot_ids

    fr = _frames(spark, [(700 if k % 4 else 703, [k % 256, 3, 9, 1]) for k in range(400)] + [(701, [1, 2, 3]), (99, [0])] * 3)
    hot = {r._hot_id: r._buckets for r in _hot_ids(fr, 5).collect()}
    assert set(hot) == {700, 703} and hot[700] == 8 and hot[703] == 3
    for shape in (decode_long, decode_nested):
        want = shape(fr, dbc, strategy="join")
        got = shape(fr, dbc, strategy="join", max_broadcast_rows=0, salt_buckets=5)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
