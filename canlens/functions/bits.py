"""Bit-level signal extraction as plain column arithmetic.

A payload is turned once per frame into two short arrays of 64-bit words (MSB-first and
little-endian byte order, ``payload_words``).  A signal is then two array reads and a few
shifts and masks (``raw_from_words``) — cheap per signal, and inside generated code.

Bit numbering follows the reference decoder:

* little-endian: bit ``i`` of the value is payload bit ``start+i``, LSB-first in a byte;
* big-endian ("sequential"): bits are read at positions ``start, start+1, ...``, MSB-first
  within a byte, and a value cut by the end of the payload is not shifted up.

Bits past the frame's ``dlc`` read as zero (the payload is already cut to ``dlc``).
Widths above 64 are undefined in the reference and give null here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_


def _lit_long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _shl(a: Column, n) -> Column:
    return F.call_function("shiftleft", a, n if isinstance(n, Column) else F.lit(n))


def _shr(a: Column, n) -> Column:
    return F.call_function("shiftright", a, n if isinstance(n, Column) else F.lit(n))


def _ushr(a: Column, n) -> Column:
    return F.call_function("shiftrightunsigned", a, n if isinstance(n, Column) else F.lit(n))


def _conv_hex(c: Column) -> Column:
    return F.conv(c, 16, 10).cast("bigint")


def _byteswap64(w: Column) -> Column:
    out = None
    for i in range(8):
        part = _shl(_ushr(w, 8 * i).bitwiseAND(_lit_long(0xFF)), 8 * (7 - i))
        out = part if out is None else out.bitwiseOR(part)
    return out


MAX_WORDS = 9  # 64 payload bytes = 8 words, plus the trailing zero word


def payload_words(payload) -> tuple[Column, Column]:
    """The payload as 64-bit words, computed once per frame.

    Returns ``(be_words, le_words)``: ``be_words[i]`` holds bytes ``8i..8i+7`` with byte
    ``8i`` most significant (the MSB-first bit stream), ``le_words[i]`` the same bytes with
    byte ``8i`` least significant (the little-endian integer).  Words past the payload are
    zero, so a 64-bit window starting anywhere in the payload has a following word.

    A byte's value is read as the code point of the payload decoded as ISO-8859-1 (one
    character per byte), which is about twice as fast as ``conv(hex(...))``.  Built from
    fixed ``array(...)`` expressions (no lambda), so it stays in whole-stage codegen, and
    absent words are skipped (``CASE`` short-circuits)."""
    p = col_(payload)
    text = F.decode(p, "ISO-8859-1")
    n = F.length(p)

    def byte(i: int) -> Column:
        return F.when(n > i, F.ascii(F.substr(text, F.lit(i + 1), F.lit(1))).cast("bigint")).otherwise(_lit_long(0))

    be, le = [], []
    for w in range(MAX_WORDS):
        b = [byte(8 * w + k) for k in range(8)]
        be_w = reduce(lambda a, c: a.bitwiseOR(c), [_shl(b[k], 8 * (7 - k)) for k in range(8)])
        le_w = reduce(lambda a, c: a.bitwiseOR(c), [_shl(b[k], 8 * k) for k in range(8)])
        be.append(F.when(n > 8 * w, be_w).otherwise(_lit_long(0)))
        le.append(F.when(n > 8 * w, le_w).otherwise(_lit_long(0)))
    return F.array(*be), F.array(*le)


def _word(words: Column, idx: Column) -> Column:
    return F.coalesce(F.try_element_at(words, idx + 1), _lit_long(0))


def raw_from_words(be_words, le_words, nbytes, start_bit, bit_length, little_endian,
                   motorola: bool = False) -> Column:
    """Unsigned raw value (BIGINT bit pattern) of one signal from ``payload_words``.

    ``nbytes`` is the payload length (``dlc``); the other arguments may be columns or
    literals.  With ``motorola=True`` big-endian signals use the standard DBC start-bit
    numbering (start bit = MSB, counted LSB-first in its byte) instead of the sequential one.
    """
    bew, lew = col_(be_words), col_(le_words)
    start = F.lit(start_bit) if isinstance(start_bit, int) else col_(start_bit)
    n = F.lit(bit_length) if isinstance(bit_length, int) else col_(bit_length)
    le = F.lit(little_endian) if isinstance(little_endian, bool) else col_(little_endian)
    nb = F.lit(nbytes) if isinstance(nbytes, int) else col_(nbytes)
    if motorola:
        start = F.when(le, start).otherwise(_shl(_shr(start, 3), 3) + 7 - start.bitwiseAND(F.lit(7)))
    q = _shr(start, 6)
    r = start.bitwiseAND(F.lit(63))

    # little-endian: bits [start, start+n) of the little-endian integer of the payload
    lo, hi = _word(lew, q), _word(lew, q + 1)
    v_le = _ushr(lo, r).bitwiseOR(F.when(r == 0, _lit_long(0)).otherwise(_shl(hi, 64 - r)))
    mask = F.when(n <= 0, _lit_long(0)).otherwise(_ushr(_lit_long(-1), 64 - n))
    le_val = v_le.bitwiseAND(mask)

    # big-endian, sequential bit positions, MSB-first within a byte; a value cut by the end
    # of the payload keeps only the available bits (not shifted up)
    w0, w1 = _word(bew, q), _word(bew, q + 1)
    x = _shl(w0, r).bitwiseOR(F.when(r == 0, _lit_long(0)).otherwise(_ushr(w1, 64 - r)))
    avail = F.greatest(F.lit(0), F.least(n, nb * 8 - start))
    be_val = F.when(avail <= 0, _lit_long(0)).otherwise(_ushr(x, 64 - avail))

    return F.when((n < 0) | (n > 64) | start.isNull(), F.lit(None).cast("bigint")).when(le, le_val).otherwise(be_val)


def raw_bits(payload, start_bit, bit_length, little_endian, motorola: bool = False) -> Column:
    """``raw_from_words`` for a ``payload`` BINARY column (words computed inline)."""
    be, le = payload_words(payload)
    return raw_from_words(be, le, F.length(col_(payload)), start_bit, bit_length, little_endian, motorola)


def sign_extend(raw, bit_length) -> Column:
    """Two's complement at ``bit_length``; widths 0 and >= 64 unchanged."""
    raw = col_(raw)
    n = col_(bit_length) if not isinstance(bit_length, int) else F.lit(bit_length)
    return F.when((n <= 0) | (n >= 64), raw).otherwise(_shr(_shl(raw, 64 - n), 64 - n))


def unsigned_to_double(raw) -> Column:
    """A BIGINT bit pattern read as u64, converted to DOUBLE with one rounding (P5)."""
    raw = col_(raw)
    big = (raw.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("double")
    return F.when(raw < 0, big).otherwise(raw.cast("double"))


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def float32_from_bits(raw) -> Column:
    """IEEE-754 binary32 in the low 32 bits of ``raw``, widened exactly to DOUBLE."""
    bits = col_(raw).bitwiseAND(_lit_long(0xFFFFFFFF))
    sign = F.when(_ushr(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    e = _ushr(bits, 23).bitwiseAND(_lit_long(0xFF))
    m = bits.bitwiseAND(_lit_long(0x7FFFFF))
    return (
        F.when((e == 255) & (m == 0), sign * F.lit(float("inf")))
        .when(e == 255, F.lit(float("nan")))
        .when(e == 0, sign * m.cast("double") * F.lit(2.0 ** -149))
        .otherwise(sign * (F.lit(1.0) + m.cast("double") / F.lit(2.0 ** 23)) * _pow2(e - 127))
    )


def float64_from_bits(raw) -> Column:
    """IEEE-754 binary64 from a BIGINT bit pattern."""
    bits = col_(raw)
    sign = F.when(_ushr(bits, 63) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    e = _ushr(bits, 52).bitwiseAND(_lit_long(0x7FF))
    m = bits.bitwiseAND(_lit_long(0xFFFFFFFFFFFFF))
    return (
        F.when((e == 2047) & (m == 0), sign * F.lit(float("inf")))
        .when(e == 2047, F.lit(float("nan")))
        .when(e == 0, sign * m.cast("double") * F.lit(2.0 ** -1074))
        .otherwise(sign * (F.lit(1.0) + m.cast("double") / F.lit(2.0 ** 52)) * _pow2(e - 1023))
    )


def physical_value(raw, bit_length, is_signed, value_type, scale, offset) -> Column:
    """Decoded DOUBLE of one signal.

    float32/float64 bit-casts apply only at exactly 32/64 bits and ignore scale/offset;
    integer types give ``double(raw) * scale + offset`` with ``raw`` sign-extended for
    signed signals and read as u64 otherwise."""
    raw = col_(raw)
    n = col_(bit_length)
    vt = col_(value_type)
    signed_val = sign_extend(raw, n).cast("double") * col_(scale) + col_(offset)
    unsigned_val = unsigned_to_double(raw) * col_(scale) + col_(offset)
    return (
        F.when(raw.isNull(), F.lit(None).cast("double"))
        .when((vt == "float32") & (n == 32), float32_from_bits(raw))
        .when((vt == "float64") & (n == 64), float64_from_bits(raw))
        .when(col_(is_signed), signed_val)
        .otherwise(unsigned_val)
    )
