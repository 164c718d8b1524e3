"""Scalar column functions for text parsing and rendering.

Everything here returns a ``Column`` built from built-in Spark functions, so it stays
inside whole-stage code generation (no lambdas).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The id range.
_MAX_CAN_ID = 0x1FFFFFFF


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """Trim blanks, tabs, CR and LF at both ends."""
    return F.trim(col_(c), F.lit(" \t\r\n"))


def strip_leading_zeros(c) -> Column:
    return F.ltrim(col_(c), F.lit("0"))


def hex_to_long(c, max_digits: int = 8) -> Column:
    """Whole-string hex to BIGINT, null unless the text is only hex digits and the value
    has at most ``max_digits`` significant digits (X2: u32 by default)."""
    c = col_(c)
    ok = c.rlike("^[0-9A-Fa-f]+$") & (F.length(strip_leading_zeros(c)) <= max_digits)
    return F.when(ok, F.conv(c, 16, 10).cast("bigint"))


def dec_to_long(c) -> Column:
    """Whole-string unsigned decimal to BIGINT (X3); null if not digits or >= 2^63."""
    c = col_(c)
    ok = c.rlike("^[0-9]+$") & (F.length(strip_leading_zeros(c)) <= 19)
    return F.when(ok, c.try_cast("bigint"))


def dec_mod_256(c) -> Column:
    """Unsigned decimal text kept modulo 256 (channel fields, u8 truncation); u64 range.
    Up to 18 digits take a BIGINT fast path, longer values a DECIMAL(20,0) one."""
    c = col_(c)
    digits = c.rlike("^[0-9]+$")
    n = F.length(strip_leading_zeros(c))
    d = c.try_cast("decimal(20,0)")
    long_ok = (n <= 20) & d.isNotNull() & (d <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return (F.when(digits & (n <= 18), F.pmod(c.cast("bigint"), F.lit(256)).cast("int"))
            .when(digits & long_ok, F.pmod(d, F.lit(256)).cast("int")))


_FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def seconds_to_ns(c, exact: bool = False) -> Column:
    """Seconds text to integer nanoseconds.

    Default: ``(u64)(strtod(s) * 1e9)`` as the reference — the double product truncated
    toward zero, so epoch-size values lose their last digits.  ``exact=True`` parses the
    text as a decimal and keeps every nanosecond digit (digits past the 9th are cut).
    Negative or out-of-range values are rejected (null)."""
    c = col_(c)
    d = c.try_cast("double")
    if exact:
        dec = c.try_cast("decimal(38,9)")
        ns = (dec * F.lit(1000000000).cast("decimal(10,0)")).try_cast("bigint")
        return F.when(c.rlike(_FLOAT_TEXT) & (dec >= 0), ns)
    ns = (d * F.lit(1e9)).try_cast("bigint")
    return F.when(c.rlike(_FLOAT_TEXT) & (d >= 0), ns)


_HEX_TOKEN_RUN = r"^[0-9A-Fa-f]{2}( [0-9A-Fa-f]{2}){0,63}$"


def hex_tokens_to_hex(c) -> Column:
    """Single-blank-separated byte tokens → hex text (null if a token is not a byte or
    there are more than 64).  Empty tokens are zero bytes; leading zeros are allowed."""
    t = col_(c)
    canonical = t.rlike(_HEX_TOKEN_RUN)
    g = F.regexp_replace(t, "(?<=^| )(?= |$)", "00")  # empty token → 00
    g = F.regexp_replace(g, "(?<=^| )0+(?=[0-9A-Fa-f]{1,2}( |$))", "")  # leading zeros
    g = F.regexp_replace(g, "(?<=^| )([0-9A-Fa-f])(?= |$)", "0$1")  # pad one digit
    general_ok = g.rlike(_HEX_TOKEN_RUN)
    return F.when(canonical, F.regexp_replace(t, " ", "")).when(general_ok, F.regexp_replace(g, " ", ""))


def parse_payload(c):
    """Payload text to (payload BINARY, dlc INT) columns; both null when invalid.

    Blank-separated tokens: each token is empty (one zero byte) or 1+ hex digits <= 0xFF,
    at most 64 tokens.  Otherwise one even-length hex run of at most 64 bytes.  Empty
    text is a frame without payload.  Canonical text (two digits per token) takes one
    regex check; other spellings are normalised with regex replacements (tabs/CR/LF inside
    tokens dropped, empty tokens → ``00``, leading zeros stripped, one digit padded) — no
    per-token lambdas, so the parse stays in generated code."""
    t = ws_trim(col_(c))
    has_space = F.instr(t, " ") > 0
    spaced_hex = hex_tokens_to_hex(F.regexp_replace(t, "[\\t\\r\\n]", ""))
    run_ok = t.rlike("^([0-9A-Fa-f]{2}){0,64}$")
    hex_text = F.when(t == "", F.lit("")).when(has_space, spaced_hex).otherwise(F.when(run_ok, t))
    payload = F.unhex(hex_text)
    dlc = (F.length(hex_text) / 2).cast("int")
    return payload, dlc


def valid_can_id(c) -> Column:
    c = col_(c)
    return c.isNotNull() & (c >= 0) & (c <= F.lit(_MAX_CAN_ID))


def hex_upper(c) -> Column:
    """Id as upper-case hex without prefix (``%X``)."""
    return F.upper(F.hex(col_(c)))


def payload_spaced_hex(c) -> Column:
    """Payload bytes as upper-case hex pairs separated by one blank."""
    return F.regexp_replace(F.hex(col_(c)), "(..)(?!$)", "$1 ")


def format_g6(c) -> Column:
    """A double printed like a C++ stream with default precision and ``uppercase``:
    6 significant digits, no trailing zeros, upper-case exponent (recipe R4)."""
    v = col_(c)
    s = F.format_string("%.6G", v)
    s = F.regexp_replace(s, r"(\.\d*?)0+(E|$)", "$1$2")
    s = F.regexp_replace(s, r"\.(E|$)", "$1")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), F.lit("NAN"))
        .when(v == F.lit(float("inf")), F.lit("INF"))
        .when(v == F.lit(float("-inf")), F.lit("-INF"))
        .when(v == 0, F.lit("0"))
        .otherwise(s)
    )
