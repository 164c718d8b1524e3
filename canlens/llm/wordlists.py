"""Words of whole texts as byte strings, a bounded slice of a text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text whose words are held at a time.
SLICE_BYTES = 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(raw: bytes, separator: re.Pattern[bytes], limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """``raw`` in pieces of about ``limit`` bytes, cut before a separator (a longer word stays whole)."""
    at = 0
    while len(raw) - at > limit:
        cut = separator.search(raw, at + limit)
        if cut is None:
            break
        yield raw[at: cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def raw_text(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""
