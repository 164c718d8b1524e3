"""Message dictionaries (DBC text) → three small tables.

The loader is a Spark job over ``spark.read.text``: each line is matched by one regular
expression per kind (``BO_ ``, ``SG_ ``, ``VAL_ ``; every other line is ignored), signals
are attached to the latest preceding ``BO_`` by a carry-forward window per file (a
dictionary file is small), and duplicate ids resolve to the *last* definition.

Strict mode (default, as the reference) raises ``DbcParseError`` for the first bad line:
a malformed ``BO_``/``SG_``/``VAL_`` line, a signal before any message, or a value label
for an unknown message or signal.  ``strict=False`` drops such lines and keeps them in
``Dbc.problems``.  A quoted text of a value line that has no number before it is left out and
reported there in either mode; the line's other labels are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DbcIoError, DbcParseError
from ..functions.scalars import ws_trim
from .lines import scan_lines, with_line_numbers

# A line is taken apart at its separators, as the format lays it out: words are parted by blanks,
# the name of a message or signal ends at the first colon, texts stand between double quotes.
_BLANKS = r"\s+"
# The mark of a 29-bit id, and the largest id.
EXTENDED, MAX_ID = 1 << 31, 0x1FFFFFFF
_NO_NUMBER = "VAL_ line has a text without a number"


def _word_list(c: Column) -> Column:
    return F.split(ws_trim(c), _BLANKS)


def _around_colon() -> tuple[Column, Column]:
    """Words before the first colon of the line, and the text after it."""
    at = F.locate(":", F.col("t"))
    return _word_list(F.expr("substring(t, 1, greatest(locate(':', t) - 1, 0))")), F.when(at > 0, ws_trim(F.expr("substring(t, locate(':', t) + 1)")))


def _digits(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def _identifier(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_]+$"), F.lit(False))


def _number(c: Column) -> Column:
    plain = F.coalesce(c.rlike("^[-+0-9.eE]+$") & ~c.rlike("[.]([eE]|$)"), F.lit(False))
    return F.when(plain, c.try_cast("double"))


def _inside(c: Column, opening: str, closing: str, separator: str) -> tuple[Column, Column]:
    """The two numbers of a bracketed pair; null where the brackets or a number are missing."""
    closed = c.startswith(opening) & c.endswith(closing)
    pair = F.split(F.translate(c, opening + closing, ""), separator)
    good = closed & (F.size(pair) == 2)
    return tuple(F.when(good, _number(F.get(pair, F.lit(k)))) for k in (0, 1))


def _message_fields() -> dict[str, Column]:
    head, tail = _around_colon()
    rest = _word_list(tail)
    ok = (F.size(head) == 3) & _digits(F.get(head, F.lit(1))) & _identifier(F.get(head, F.lit(2))) & _digits(F.get(rest, F.lit(0))) & (F.size(rest) >= 2)
    return {"ok": F.coalesce(ok, F.lit(False)), "id": F.get(head, F.lit(1)), "name": F.get(head, F.lit(2)), "dlc": F.get(rest, F.lit(0))}


def _signal_fields() -> dict[str, Column]:
    head, tail = _around_colon()
    parts = F.split(tail, _BLANKS, 4)
    layout, order = F.split(F.get(parts, F.lit(0)), "@"), F.get(F.split(F.get(parts, F.lit(0)), "@"), F.lit(1))
    bits = F.split(F.get(layout, F.lit(0)), r"\|")
    scale, offset = _inside(F.get(parts, F.lit(1)), "(", ")", ",")
    minimum, maximum = _inside(F.get(parts, F.lit(2)), "[", "]", r"\|")
    quoted = F.split(F.get(parts, F.lit(3)), '"')
    mux = F.coalesce(F.get(head, F.lit(2)), F.lit(""))
    ok = F.size(head).isin(2, 3) & _identifier(F.get(head, F.lit(1))) & ((mux == "") | (mux == "M") | mux.rlike("^[Mm][0-9]+$"))
    ok = ok & (F.size(layout) == 2) & (F.size(bits) == 2) & _digits(F.get(bits, F.lit(0))) & _digits(F.get(bits, F.lit(1)))
    ok = ok & order.isin("0+", "0-", "1+", "1-") & scale.isNotNull() & offset.isNotNull() & minimum.isNotNull() & maximum.isNotNull()
    ok = ok & (F.get(quoted, F.lit(0)) == "") & (F.size(quoted) >= 3)
    return {"ok": F.coalesce(ok, F.lit(False)), "name": F.get(head, F.lit(1)), "mux": mux, "start": F.get(bits, F.lit(0)), "length": F.get(bits, F.lit(1)),
            "little": order.startswith("1"), "signed": order.endswith("-"), "scale": scale, "offset": offset, "minimum": minimum, "maximum": maximum,
            "unit": F.get(quoted, F.lit(1))}


def _label_fields() -> dict[str, Column]:
    parts = F.split(F.col("t"), _BLANKS, 4)
    body = F.get(parts, F.lit(3))
    ok = (F.size(parts) == 4) & _digits(F.get(parts, F.lit(1))) & body.endswith(";") & (F.length(body) > 1)
    return {"ok": F.coalesce(ok, F.lit(False)), "id": F.get(parts, F.lit(1)), "name": F.get(parts, F.lit(2)), "body": body}


def _labelled() -> Column:
    """(raw, label) of every closed quoted text of a value line's body; raw is empty where no number
    with blanks after it stands before the text."""
    pieces = F.split("body", '"')
    before = F.transform(F.filter(pieces, lambda _, k: k % 2 == 0), lambda x: F.regexp_extract(x, r"(-?[0-9]+)\s+$", 1))
    texts = F.filter(pieces, lambda _, k: (k % 2 == 1) & (k < F.size(pieces) - 1))
    return F.transform(texts, lambda x, k: F.struct(F.get(before, k).alias("raw"), x.alias("label")))


@dataclass
class Dbc:
    messages: DataFrame  # active definition per can_id
    signals: DataFrame  # signals of active definitions
    labels: DataFrame  # value labels of active definitions
    all_messages: DataFrame  # every BO_ line, superseded ones included
    problems: DataFrame  # (file_path, line_no, message) of dropped lines and texts
    kept: list[DataFrame] = field(default_factory=list)  # cached tables

    def keep(self, table: DataFrame) -> DataFrame:
        """``table``, cached until ``release``."""
        self.kept.append(table.cache())
        return self.kept[-1]

    def release(self) -> None:
        """Give the cached tables back; later uses compute them again."""
        for table in self.kept:
            table.unpersist()
        self.kept.clear()

    def message_by_name(self, name: str) -> DataFrame:
        """Exact, case-sensitive lookup; the last definition of a name wins."""
        named = self.all_messages.filter(F.col("message_name") == name)
        return named.orderBy(F.col("def_file").desc(), F.col("def_index").desc()).limit(1)

    def is_empty(self) -> bool:
        return self.messages.isEmpty()


def _u32(digits) -> F.Column:
    return F.pmod(digits.try_cast("decimal(20,0)"), F.lit(4294967296)).cast("bigint")


def load_dbc(spark: SparkSession, paths, strict: bool = True, strip_extended_flag: bool = False, signed_labels: bool = False) -> Dbc:
    """Load one or more DBC files (a glob or list) into tables.

    The format marks 29-bit ids with bit 31, which no frame's id has: ``strip_extended_flag`` takes the bit
    away, so those messages decode.  Labels are looked up by the raw unsigned value: ``signed_labels`` stores those
    of negative values of signed signals under their two's complement at the signal's width, so they are found."""
    try:
        lines = with_line_numbers(scan_lines(spark, paths))
    except AnalysisException as e:
        raise DbcIoError(f"no dictionary can be read from {paths}") from e
    t = ws_trim(F.col("value"))
    lines = lines.select("file_path", "line_no", t.alias("t")).filter(F.col("t").rlike("^(BO_|SG_|VAL_) "))
    kind = F.when(F.col("t").startswith("BO_ "), "BO").when(F.col("t").startswith("SG_ "), "SG").otherwise("VAL")
    lines = lines.withColumn("kind", kind).cache()

    # BO_ ---------------------------------------------------------------------------
    bo = lines.filter(F.col("kind") == "BO")
    m = _message_fields()
    bo_ok = m["ok"]
    def frame_id(digits: Column) -> Column:
        number = _u32(digits)
        return F.when(number >= EXTENDED, number.bitwiseAND(F.lit(MAX_ID).cast("bigint"))).otherwise(number) if strip_extended_flag else number

    all_messages = bo.filter(bo_ok).select(
        frame_id(m["id"]).alias("can_id"),
        m["name"].alias("message_name"),
        F.pmod(m["dlc"].try_cast("decimal(20,0)"), F.lit(256)).cast("int").alias("dlc"),
        F.col("line_no").cast("bigint").alias("def_index"),
        F.col("file_path").alias("def_file"),
    )
    bad_bo = bo.filter(~bo_ok).select("file_path", "line_no", F.lit("BO_ line can't be read").alias("message"))

    # SG_ attaches to the latest BO_ line before it in the same file -----------------
    w = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    bs = lines.filter(F.col("kind").isin("BO", "SG")).withColumn(
        "owner", F.last(F.when(F.col("kind") == "BO", F.col("line_no")), ignorenulls=True).over(w)
    )
    sg = bs.filter(F.col("kind") == "SG")
    g = _signal_fields()
    sg_ok, mux = g["ok"], g["mux"]
    orphan_sg = sg.filter(F.col("owner").isNull()).select(
        "file_path", "line_no", F.lit("SG_ line without a BO_ line before it").alias("message"))
    bad_sg = sg.filter(F.col("owner").isNotNull() & ~sg_ok).select(
        "file_path", "line_no", F.lit("SG_ line can't be read").alias("message"))
    sig_rows = sg.filter(F.col("owner").isNotNull() & sg_ok).select(
        F.col("file_path").alias("def_file"),
        F.col("owner").cast("bigint").alias("def_index"),
        F.col("line_no").alias("sg_line"),
        g["name"].alias("signal_name"),
        (mux == "M").alias("is_multiplexer"),
        F.when(mux.startswith("m"), F.substring(mux, 2, 20).try_cast("bigint")).alias("multiplex_value"),
        g["start"].try_cast("int").alias("start_bit"),
        g["length"].try_cast("int").alias("bit_length"),
        g["little"].alias("little_endian"),
        g["signed"].alias("is_signed"),
        F.when(g["signed"], F.lit("signed")).otherwise(F.lit("unsigned")).alias("value_type"),
        *[g[c].alias(c) for c in ("scale", "offset", "minimum", "maximum", "unit")],
    )
    sw = Window.partitionBy("def_file", "def_index").orderBy("sg_line")
    sig_rows = sig_rows.withColumn("signal_index", (F.row_number().over(sw) - 1).cast("int"))
    sig_rows = sig_rows.join(all_messages.select("def_file", "def_index", "can_id"), ["def_file", "def_index"])

    # VAL_ attaches to the latest definition of its id before the line ----------------
    vl = lines.filter(F.col("kind") == "VAL")
    v = _label_fields()
    val_ok = v["ok"]
    bad_val_syntax = vl.filter(~val_ok).select(
        "file_path", "line_no", F.lit("VAL_ line can't be read or names no signal").alias("message"))
    vals = vl.filter(val_ok).select(
        F.col("file_path").alias("def_file"), F.col("line_no").alias("val_line"),
        frame_id(v["id"]).alias("can_id"),
        v["name"].alias("signal_name"),
        v["body"].alias("body"),
    )
    owners = (
        vals.join(all_messages.select("def_file", "can_id", "def_index"), ["def_file", "can_id"], "left")
        .filter(F.col("def_index").isNull() | (F.col("def_index") < F.col("val_line")))
        .groupBy("def_file", "val_line", "can_id", "signal_name", "body")
        .agg(F.max("def_index").alias("def_index"))
    )
    has_sig = sig_rows.select("def_file", "def_index", "signal_name").distinct().withColumn("sig_ok", F.lit(True))
    owners = owners.join(has_sig, ["def_file", "def_index", "signal_name"], "left")
    bad_val_ref = owners.filter(F.col("sig_ok").isNull()).select(
        F.col("def_file").alias("file_path"), F.col("val_line").alias("line_no"),
        F.lit("VAL_ line can't be read or names no signal").alias("message"))
    pairs = owners.filter(F.col("sig_ok")).select(
        "def_file", "def_index", "can_id", "signal_name", "val_line",
        F.posexplode(_labelled()).alias("pos", "p"),
    )
    no_number = pairs.filter(F.col("p.raw").try_cast("bigint").isNull()).select(
        F.col("def_file").alias("file_path"), F.col("val_line").alias("line_no"), F.lit(_NO_NUMBER).alias("message"))
    label_rows = pairs.filter(F.col("p.raw").try_cast("bigint").isNotNull()).groupBy("def_file", "def_index", "can_id", "signal_name",
                               F.col("p.raw").try_cast("bigint").alias("raw_value")).agg(
        F.max_by(F.col("p.label"), F.struct("val_line", "pos")).alias("label"))

    problems = bad_bo.unionByName(orphan_sg).unionByName(bad_sg).unionByName(bad_val_syntax).unionByName(bad_val_ref)
    reported = problems.unionByName(no_number.distinct())
    if strict:
        first = problems.orderBy("file_path", "line_no").limit(1).collect()
        if first:
            r = first[0]
            raise DbcParseError(r["file_path"], int(r["line_no"]), r["message"])

    # Last definition per id wins ------------------------------------------------------
    active = all_messages.groupBy("can_id").agg(
        F.max_by(F.struct("def_file", "def_index", "message_name", "dlc"), F.struct("def_file", "def_index")).alias("m")
    ).select("can_id", "m.message_name", "m.dlc", "m.def_index", "m.def_file")
    keys = active.select("def_file", "def_index")
    signals = sig_rows.join(keys, ["def_file", "def_index"], "left_semi").select(
        "can_id", "def_index", "signal_index", "signal_name", "is_multiplexer", "multiplex_value", "start_bit",
        "bit_length", "little_endian", "is_signed", "value_type", "scale", "offset", "minimum", "maximum", "unit",
    )
    labels = label_rows.join(keys, ["def_file", "def_index"], "left_semi").select(
        "can_id", "signal_name", "raw_value", "label")
    if signed_labels:
        widths = signals.filter(F.col("is_signed") & F.col("bit_length").between(1, 63)).groupBy("can_id", "signal_name").agg(F.min_by("bit_length", "signal_index").alias("n"))
        raw = F.when(F.col("raw_value") < 0, F.col("raw_value").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n")) - 1))
        labels = labels.join(widths, ["can_id", "signal_name"], "left").select("can_id", "signal_name", F.coalesce(raw, "raw_value").alias("raw_value"), "label")

    # Small tables, reused by every decode: cached; their sizes are checked where a plan
    # depends on them (broadcast or compile), not here.
    messages = active.select("can_id", "message_name", "dlc", "def_index")
    dbc = Dbc(messages, signals, labels, all_messages, reported, [lines])
    for table in (messages, signals, labels):
        dbc.keep(table)
    return dbc


def write_dbc_text(spark: SparkSession, text: str, folder: str) -> str:
    """Store DBC text as a file through Spark (one partition keeps the line order)."""
    import os

    rows = [(i, line) for i, line in enumerate(text.splitlines())]
    df = spark.createDataFrame(rows, "i bigint, value string").coalesce(1).orderBy("i").select("value")
    out = os.path.join(folder, "dbc")
    df.coalesce(1).write.mode("overwrite").text(out)
    return os.path.join(out, "part-*")
