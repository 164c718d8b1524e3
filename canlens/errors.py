"""Error types raised by the library (the reference's error codes as exceptions)."""


class CanLensError(Exception):
    """Base class."""


class UnsupportedFormat(CanLensError):
    """The path's extension names no readable trace format."""

    def __init__(self, path: str, format_name: str | None = None):
        self.path = path
        self.format_name = format_name
        what = f"{format_name} traces are not supported" if format_name else "unsupported trace format"
        super().__init__(f"{what}: {path}")


class TraceParseError(CanLensError):
    """Strict ingest met a line it cannot parse (1-based physical line number)."""

    def __init__(self, path: str, line: int, text: str | None = None):
        self.path = path
        self.line = line
        self.text = text
        super().__init__(f"{path}, line {line}: not a readable trace record: {text!r}")


class DbcParseError(CanLensError):
    """A message dictionary line is malformed (1-based line number)."""

    def __init__(self, path: str, line: int, message: str):
        self.path = path
        self.line = line
        super().__init__(f"{message} at line {line} of {path}")


class DbcIoError(CanLensError):
    """A message dictionary file does not exist or cannot be read."""


class DecodeError(CanLensError):
    """Decoding was requested without a message dictionary."""


class QueryError(CanLensError):
    """An invalid query argument (reversed ranges, misplaced fields, ...)."""
