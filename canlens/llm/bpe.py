"""Whole texts to token ids or counts with a public tokenizer file, one pre-token at a time.

A pre-token's tokens don't depend on its neighbours, so each distinct pre-token is encoded
once by the ``tokenizers`` library and looked up afterwards.  Texts in which the pre-token
split could differ between regular-expression engines (characters outside ``_PLAIN``) and
texts with a special string go to the library whole.  The memo holds ``MEMO`` pre-tokens at
most, or what the operator asks for; when full, only those of the block at hand stay.  That changes speed only.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from .common import KEPT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pre-tokens kept per Python worker.
MEMO = 500_000
#: Unseen pre-tokens that are encoded at a time.
JOINED = 1024
#: Characters of text that are split at a time.
BLOCK_CHARS = 4 << 20

#: Characters whose classes are alike in every engine and that no normaliser changes, but for case.
_PLAIN = re.compile("[\x00-\x1b\x20-įı-ɏ‐-‧]*")
#: Letters and numbers among them, as ranges.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_OTHER = rf"[^\s{_LETTER}{_NUMBER}]"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
#: The pre-token patterns of the two files (fixed by their formats), in terms of ``re``; the
#: frequent alternative comes first, which is sound as each starts with characters of its own.
BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]++|{_SHORT}| ?[{_NUMBER}]++| ?{_OTHER}++|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"[{_LETTER}]++|{_SHORT}|[{_NUMBER}]|{_OTHER}++")
WORD_END = "</w>"


def read_tokenizer(path: str) -> str:
    """The tokenizer file as text (bounded: a vocabulary), for shipping to the workers."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_characters() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write for it."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Encoder:
    """Base: the library's tokenizer, the pattern and the memo of one worker."""

    def __init__(self, source: str, limit: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.special = [x["content"] for x in json.loads(source).get("added_tokens") or ()]
        self.limit = MEMO if limit is None else limit
        self.memo: dict = {}
        self.fixed: dict = {}

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, lists: list[list[str]]) -> None:
        found = set().union(*lists)
        new = found.difference(self.memo)
        if len(self.memo) + len(new) > max(self.limit, len(self.fixed) + len(found)):
            memo, self.memo = self.memo, dict(self.fixed)
            self.memo.update((w, memo[w]) for w in found if w in memo)
        words = list(new)
        for lo in range(0, len(words), JOINED):
            self.remember(words[lo: lo + JOINED])

    def remember(self, words: list[str]) -> None:
        self.memo.update(zip(words, map(self.keep, self.encode(words)), strict=True))

    def pieces(self, texts: Iterable[str]) -> Iterator:
        """For each text the result of ``whole`` or of ``joined`` over its pre-tokens."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> list:
        split = [self.split(x) if self.plain(x) else None for x in texts]
        self._learn([x for x in split if x is not None])
        get = self.memo.__getitem__
        return [self.whole(x) if words is None else self.joined(map(get, words)) for x, words in zip(texts, split, strict=True)]


class ByteIds(_Encoder):
    """Little-endian ids (2 bytes each if the vocabulary allows, else 4) by the byte-level file."""

    def __init__(self, source: str, limit: int | None = None):
        super().__init__(source, limit)
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.split = BYTE_LEVEL.findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)  # a character of a byte-level token stands for one byte

    def remember(self, words: list[str]) -> None:
        """As a space and letters end where the next such pre-token begins, words of this kind
        are encoded as one text, whose ids are dealt out again by the bytes they stand for."""
        joined = [w for w in words if w[0] == " " and w[1:].isalpha()]
        if joined:
            text = "".join(joined)
            ids = np.array(self.encode([text])[0], dtype=self.dtype)
            begins = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == 0x20)
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), begins, side="right") * self.width
            raw, at = ids.tobytes(), [*cuts.tolist(), len(ids) * self.width]
            self.memo.update((w, raw[lo:hi]) for w, lo, hi in zip(joined, at, at[1:], strict=False))
        if len(joined) < len(words):
            super().remember([w for w in words if w not in self.memo])

    def keep(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.keep(self.encode([text])[0])

    def joined(self, parts) -> bytes:
        return b"".join(parts)


class WordCounts(_Encoder):
    """Token counts by the word-end file, with the whole-token shortcut.

    ``fixed`` has each vocabulary string with a word end that the library, given the string
    alone, encodes as that one token: proved once per worker, before any text is read.  Such
    pre-tokens count 1 without merging; only the rest are merged (and remembered)."""

    def __init__(self, source: str, limit: int | None = None):
        super().__init__(source, limit)
        self.fixed = dict.fromkeys(self.prove(json.loads(source)["model"]["vocab"]), 1)
        self.memo = dict(self.fixed)

    def prove(self, vocabulary: dict[str, int]) -> list[str]:
        byte = byte_characters()
        names: dict[str, int] = {}
        for token, number in vocabulary.items():
            if token.endswith(WORD_END):
                raw = bytes(byte[c] for c in token.removesuffix(WORD_END))
                try:
                    names[raw.decode("utf-8")] = number
                except UnicodeDecodeError:
                    continue
        words = [w for w in names if w and WORD_LEVEL.fullmatch(w)]
        return [w for w, ids in zip(words, self.encode(words), strict=True) if ids == [names[w]]]

    def split(self, text: str) -> list[str]:
        return WORD_LEVEL.findall(text.lower())

    def keep(self, ids: list[int]) -> int:
        return len(ids)

    def whole(self, text: str) -> int:
        return len(self.encode([text])[0])

    def joined(self, parts) -> int:
        return sum(parts)


def encoder(kind: type[_Encoder], source: str, limit: int | None = None) -> _Encoder:
    """One encoder per worker process, kind, tokenizer file and memo size."""
    key = (kind.__name__, hashlib.sha256(source.encode()).hexdigest(), limit)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = kind(source, limit)
    return KEPT[key]
