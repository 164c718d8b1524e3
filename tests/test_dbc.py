"""Message dictionary loading."""

import pytest

from canlens.errors import DbcIoError, DbcParseError
from canlens.sources.dbc import load_dbc
from helpers import write

PUMP = """VERSION "4"
NS_ :
BO_ 1537 Pump: 5 Plant
 SG_ Flow : 4|21@1- (0.125,-40.5) [-90.25|300] "l/min" Panel,Log
 SG_ Valve : 30|10@0+ (2,3) [3|2049] "" Panel

BO_ 96 Lid: 1 Plant
"""


def test_messages_and_signals(spark, tmp_path):
    d = load_dbc(spark, write(tmp_path, "a.dbc", PUMP))
    assert sorted((r.can_id, r.message_name, r.dlc) for r in d.messages.collect()) == [(96, "Lid", 1), (1537, "Pump", 5)]
    got = [tuple(r) for r in d.signals.orderBy("signal_index").select(
        "can_id", "signal_name", "start_bit", "bit_length", "little_endian", "is_signed", "scale", "offset", "minimum", "maximum", "unit").collect()]
    assert got == [(1537, "Flow", 4, 21, True, True, 0.125, -40.5, -90.25, 300.0, "l/min"),
                   (1537, "Valve", 30, 10, False, False, 2.0, 3.0, 3.0, 2049.0, "")]


@pytest.mark.parametrize(("number", "value"), [("6e+2", 600.0), (".75", 0.75), ("-3.5E-4", -3.5e-4), ("+8", 8.0), ("2.e3", None), ("7.", None), ("1.2.3", None), ("e4", None)])
def test_numbers(spark, tmp_path, number, value):
    text = f'BO_ 40 M: 8 N\n SG_ S : 0|8@1+ ({number},0) [0|0] "" N\n'
    d = load_dbc(spark, write(tmp_path, "a.dbc", text), strict=False)
    assert [r.scale for r in d.signals.collect()] == ([] if value is None else [value])
    assert d.problems.count() == (value is None)


def test_signal_before_message(spark, tmp_path):
    with pytest.raises(DbcParseError) as e:
        load_dbc(spark, write(tmp_path, "a.dbc", ' SG_ X : 0|8@1+ (1,0) [0|1] "" N\nBO_ 1 M: 8 N\n'))
    assert e.value.line == 1


def test_bad_message_line(spark, tmp_path):
    with pytest.raises(DbcParseError) as e:
        load_dbc(spark, write(tmp_path, "a.dbc", "BO_ 1 M: 8 N\n\nBO_ x Y: 8 N\n"))
    assert e.value.line == 3


def test_keywords_with_same_prefixes(spark, tmp_path):
    text = "NS_ :\n  BO_TX_BU_\n  SG_MUL_VAL_\n  VAL_TABLE_\nBO_ 5 Only: 1 N\nBO_TX_BU_ 5 : A,B;\nVAL_TABLE_ T 1 \"a\" ;\n"
    d = load_dbc(spark, write(tmp_path, "a.dbc", text))
    assert d.messages.count() == 1


def test_wide_signals_and_long_ids(spark, tmp_path):
    """A signal over the whole payload of a long frame, in a message whose id has the top bit."""
    text = f'BO_ {(1 << 31) + 0x18DAF110} Diag: 48 N\n SG_ All : 0|384@0- (1,0) [-9.9E99|4.5e+115] "" N\n'
    d = load_dbc(spark, write(tmp_path, "a.dbc", text))
    (s,) = d.signals.collect()
    assert (s.can_id, s.bit_length, s.minimum, s.maximum) == ((1 << 31) + 0x18DAF110, 384, -9.9e99, 4.5e115)


def test_multiplex(spark, tmp_path):
    """Markers of a selector and of branches with more than one digit, beside signals without one."""
    text = "BO_ 611 Seat: 6 N\n" + "".join(f' SG_ {name} {mux}: {at}|6@1+ (1,0) [0|0] "" N\n' for name, mux, at in [("Always", "", 40), ("Zone", "M ", 2), ("Heat", "m17 ", 9), ("Tilt", "m4 ", 9)])
    got = {r.signal_name: (r.is_multiplexer, r.multiplex_value) for r in load_dbc(spark, write(tmp_path, "a.dbc", text)).signals.collect()}
    assert got == {"Always": (False, None), "Zone": (True, None), "Heat": (False, 17), "Tilt": (False, 4)}


def test_bare_m_is_an_error(spark, tmp_path):
    with pytest.raises(DbcParseError):
        load_dbc(spark, write(tmp_path, "a.dbc", 'BO_ 10 Mux: 8 N\n SG_ A m : 1|7@1+ (1,0) [0|1] "" N\n'))


def labels_of(d):
    return sorted((r.can_id, r.signal_name, r.raw_value, r.label) for r in d.labels.collect())


def test_labels(spark, tmp_path):
    """Blanks and tabs between numbers and texts, negative numbers, digits, blanks and semicolons in texts."""
    text = ('BO_ 350 Gear: 2 N\n SG_ Lever : 0|5@1- (1,0) [0|0] "" N\n SG_ Mode : 8|3@1+ (1,0) [0|0] "" N\n'
            'VAL_ 350 Lever -2 "rev 2"  -1\t"rev 1 " 0 \t "mid;"\t11 "top 4 " ;\n VAL_  350  Mode 6 "" 5   "x""y" 3 "z" 6 "again";  \n')
    d = load_dbc(spark, write(tmp_path, "a.dbc", text))
    assert labels_of(d) == [(350, "Lever", -2, "rev 2"), (350, "Lever", -1, "rev 1 "), (350, "Lever", 0, "mid;"), (350, "Lever", 11, "top 4 "),
                            (350, "Mode", 3, "z"), (350, "Mode", 5, "x"), (350, "Mode", 6, "again")]
    assert [(r.line_no, r.message) for r in d.problems.collect()] == [(5, "VAL_ line has a text without a number")]


def test_labels_without_number(spark, tmp_path):
    text = 'BO_ 351 Fan: 1 N\n SG_ Step : 0|8@1+ (1,0) [0|0] "" N\nVAL_ 351 Step "early" 3 "slow" x "odd" 9"near" 12 "open ;\n'
    d = load_dbc(spark, write(tmp_path, "a.dbc", text), strict=False)
    assert labels_of(d) == [(351, "Step", 3, "slow")]
    assert [r.line_no for r in d.problems.collect()] == [3]


def test_last_definition_wins(spark, tmp_path):
    def message(name, dlc, signal):
        return f'BO_ 88 {name}: {dlc} N\n SG_ {signal} : 1|4@1+ (1,0) [0|0] "" N\n'

    text = message("Rain", 3, "Old") + 'VAL_ 88 Old 4 "four" ;\nBO_ 90 Sun: 2 N\n' + message("Snow", 6, "New") + 'VAL_ 88 New 2 "two" ;\n'
    d = load_dbc(spark, write(tmp_path, "a.dbc", text))
    assert sorted((r.can_id, r.message_name, r.dlc) for r in d.messages.collect()) == [(88, "Snow", 6), (90, "Sun", 2)]
    assert [r.signal_name for r in d.signals.collect()] == ["New"]
    assert labels_of(d) == [(88, "New", 2, "two")]
    assert sorted(r.message_name for r in d.all_messages.collect()) == ["Rain", "Snow", "Sun"]
    assert d.message_by_name("Rain").first().can_id == 88 and d.message_by_name("rain").count() == 0


def test_release(spark, tmp_path):
    """Released tables aren't kept in memory, and can still be used."""
    d = load_dbc(spark, write(tmp_path, "a.dbc", PUMP))
    d.signals.count()
    assert d.signals.is_cached
    d.release()
    assert not d.signals.is_cached and not d.messages.is_cached and d.signals.count() == 2


def test_orphan_labels(spark, tmp_path):
    text = 'BO_ 7 First: 8 N\n SG_ S : 0|8@1+ (1,0) [0|255] "" N\nVAL_ 9 S 0 "x" ;\n'
    with pytest.raises(DbcParseError) as e:
        load_dbc(spark, write(tmp_path, "a.dbc", text))
    assert e.value.line == 3
    d = load_dbc(spark, write(tmp_path, "b.dbc", text), strict=False)
    assert d.labels.count() == 0 and d.problems.count() == 1


def test_missing_file(spark, tmp_path):
    with pytest.raises(DbcIoError):
        load_dbc(spark, str(tmp_path / "nope.dbc"))


def test_empty(spark, tmp_path):
    d = load_dbc(spark, write(tmp_path, "a.dbc", 'VERSION ""\n'))
    assert d.is_empty()
