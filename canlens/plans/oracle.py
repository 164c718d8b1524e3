"""DuckDB SQL that recomputes the fixture frames and their decoded signals from ``events``.

The oracle never decodes bits: each payload byte is a function of the event columns, so
the expected signal values follow from those columns directly (see ``sources/fixtures.py``).
"""

# The fixture frames as SQL (same rules as sources/fixtures.py).
FRAMES_CTE = """
ev AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) AS raw FROM events
),
frames AS (
  SELECT 'events' AS trace_id,
         CAST(event_id AS BIGINT) AS ordinal,
         CAST(epoch_us(ts) * 1000 AS BIGINT) AS timestamp_ns,
         CAST(CASE event_type WHEN 'click' THEN 256 WHEN 'view' THEN 257 WHEN 'purchase' THEN 258
                   WHEN 'signup' THEN 259 WHEN 'error' THEN 260 ELSE 261 END AS BIGINT) AS can_id,
         CAST(CASE WHEN event_type = 'signup' THEN 2 ELSE 8 END AS BIGINT) AS dlc,
         CAST(user_id % 3 AS BIGINT) AS channel,
         CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS frame_type,
         CASE WHEN event_type = 'signup'
              THEN printf('%02X%02X', raw % 256, raw // 256)
              ELSE printf('%02X%02X%02X%02X%02X%02X%02X%02X', raw % 256, raw // 256, user_id % 256,
                          event_id % 2 + 2 * (user_id % 128), raw // 256, raw % 256, event_id % 256,
                          (event_id // 256) % 256)
         END AS payload_hex,
         raw, user_id, event_id, event_type
  FROM ev
)"""

_MSG = "CASE can_id WHEN 256 THEN 'Click' WHEN 257 THEN 'View' WHEN 258 THEN 'Purchase' WHEN 259 THEN 'Signup' END"
_D = "::DOUBLE"


def _sig(idx: int, name: str, raw: str, value: str, unit: str, label: str, where: str) -> str:
    return (
        f"SELECT trace_id, ordinal, timestamp_ns, can_id, dlc, channel, frame_type, payload_hex, "
        f"{_MSG} AS message_name, CAST({idx} AS BIGINT) AS signal_index, '{name}' AS signal_name, "
        f"CAST({raw} AS BIGINT) AS raw_value, {value} AS value, '{unit}' AS unit, "
        f"{label} AS value_description FROM frames WHERE {where}"
    )


_MAIN = "can_id IN (256, 257, 258)"
_UTAG = "(CASE WHEN user_id % 256 >= 128 THEN user_id % 256 - 256 ELSE user_id % 256 END)"

# One row per active signal, in the long shape of decode_long.
SIGNALS_CTE = "signals AS (\n  " + "\n  UNION ALL ".join([
    _sig(0, "EvtValue", "raw", f"raw{_D} * 0.01{_D} + 0.0{_D}", "u", "NULL::VARCHAR", _MAIN),
    _sig(1, "UserTag", "user_id % 256", f"{_UTAG}{_D} * 1.0{_D} + 0.0{_D}", "", "NULL::VARCHAR", _MAIN),
    _sig(2, "Sel", "event_id % 2", f"(event_id % 2){_D}", "",
         "CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END", _MAIN),
    _sig(3, "Even", "user_id % 128", f"(user_id % 128){_D}", "pct", "NULL::VARCHAR", _MAIN + " AND event_id % 2 = 0"),
    _sig(4, "Odd", "user_id % 128", f"(user_id % 128){_D} * 2.0{_D} + (-1.0){_D}", "pct", "NULL::VARCHAR",
         _MAIN + " AND event_id % 2 = 1"),
    _sig(5, "ValueBE", "raw", f"raw{_D}", "", "NULL::VARCHAR", _MAIN),
    _sig(6, "Seq", "event_id % 65536", f"(event_id % 65536){_D}", "", "NULL::VARCHAR", _MAIN),
    _sig(0, "EvtValue", "raw", f"raw{_D} * 0.01{_D} + 0.0{_D}", "u", "NULL::VARCHAR", "can_id = 259"),
    _sig(1, "Trunc", "raw // 256", f"(raw // 256){_D}", "", "NULL::VARCHAR", "can_id = 259"),
]) + "\n)"


def with_frames(body: str) -> str:
    return f"WITH {FRAMES_CTE}\n{body}"


def with_signals(body: str) -> str:
    return f"WITH {FRAMES_CTE},\n{SIGNALS_CTE}\n{body}"


RAW_COLS = "ordinal, timestamp_ns, can_id, dlc, channel, frame_type, payload_hex"
LONG_COLS = "ordinal, can_id, message_name, signal_index, signal_name, raw_value, value, unit, value_description"
