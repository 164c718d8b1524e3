"""Fixed table schemas."""

from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("trace_id", T.StringType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("timestamp_ns", T.LongType(), False),
    T.StructField("can_id", T.LongType(), False),
    T.StructField("dlc", T.IntegerType(), False),
    T.StructField("channel", T.IntegerType(), False),
    T.StructField("frame_type", T.IntegerType(), False),
    T.StructField("payload", T.BinaryType(), False),
])

FRAME_COLUMNS = [f.name for f in FRAMES.fields]

DBC_MESSAGES = T.StructType([
    T.StructField("can_id", T.LongType(), False),
    T.StructField("message_name", T.StringType(), False),
    T.StructField("dlc", T.IntegerType(), False),
    T.StructField("def_index", T.LongType(), False),
])

DBC_SIGNALS = T.StructType([
    T.StructField("can_id", T.LongType(), False),
    T.StructField("def_index", T.LongType(), False),
    T.StructField("signal_index", T.IntegerType(), False),
    T.StructField("signal_name", T.StringType(), False),
    T.StructField("is_multiplexer", T.BooleanType(), False),
    T.StructField("multiplex_value", T.LongType(), True),
    T.StructField("start_bit", T.IntegerType(), False),
    T.StructField("bit_length", T.IntegerType(), False),
    T.StructField("little_endian", T.BooleanType(), False),
    T.StructField("is_signed", T.BooleanType(), False),
    T.StructField("value_type", T.StringType(), False),
    T.StructField("scale", T.DoubleType(), False),
    T.StructField("offset", T.DoubleType(), False),
    T.StructField("minimum", T.DoubleType(), False),
    T.StructField("maximum", T.DoubleType(), False),
    T.StructField("unit", T.StringType(), False),
])

DBC_VALUE_LABELS = T.StructType([
    T.StructField("can_id", T.LongType(), False),
    T.StructField("signal_name", T.StringType(), False),
    T.StructField("raw_value", T.LongType(), False),
    T.StructField("label", T.StringType(), False),
])

DECODED_SIGNAL = T.StructType([
    T.StructField("signal_index", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("raw_value", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("value_description", T.StringType()),
])

# Frame kinds (fixed values).
FRAME_TYPE_CAN = 0
FRAME_TYPE_FD = 1
MAX_CAN_ID = 0x1FFFFFFF
MAX_PAYLOAD_BYTES = 64
