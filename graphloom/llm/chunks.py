"""Cutting texts at places where byte-level BPE never merges, and bounded caches of what the cuts encode to.

The split pattern of the public rank files puts a cut before a lone space, around a line feed and before a lone mark, except within a run
of white space: a run of three or more, or one of two at the end, takes the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

SEPARATORS = "\x1f\x1e\x1d\x1c\ue000\ue001\ue002\ufdd0"
_RUN = re.compile(r"\s{3}|\s{2}\Z")
_MARKS, _SPACED = re.compile(r"[^\w\t-\r ][^\w\t-\r ]"), re.compile(r"\s[.,]")
#: Kinds of UTF-8 bytes: w of letters and digits (ASCII, and Latin letters up to U+024F), s space and line feed, m other printable ASCII, u to be looked at closer.
_KINDS = bytes(ord("w") if chr(b).isalnum() and b < 128 or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC9 else ord("s") if b in (10, 32) else ord("m") if 33 <= b <= 126 else ord("u") for b in range(256))
#: How byte-level models write a byte: printable ones as the character of that number, others from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def byte_level(text: str) -> str:
    """`text` as byte-level models see it."""
    return text.encode().decode("latin-1").translate(_BYTE)


def plain_word(text: str) -> bool:
    """A word of ASCII or Latin letters, which no tokenizer normalises beyond case or cuts (but for I with a dot above)."""
    return text.isalpha() and (text.isascii() or max(text) <= "ɏ" and "İ" not in text)


def looks(text: str) -> tuple[bool, bool]:
    """Whether white space runs as long that the pattern must decide, and whether no two marks stand side by side."""
    kinds = text.encode("utf-8", "surrogatepass").translate(_KINDS)
    if b"u" in kinds or "×" in text or "÷" in text:
        return bool(_RUN.search(text)), "_" not in text and not _MARKS.search(text)
    return b"sss" in kinds or kinds.endswith(b"ss"), b"mm" not in kinds


def special_strings(tokenizer: Tokenizer) -> list[str]:
    """Strings of added tokens: the library looks for them before it cuts a text, so a text that holds one is encoded whole."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


#: Unicode's White_Space, which the tokenizers' engines mean by \s (the regex module's \s has \x1c-\x1f besides).
SPACE = r"\t-\r \x85\xa0  -     　"


def splitter(pattern: str) -> regex.Pattern:
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]")
    return regex.compile(pattern.replace(r"(?!\S)", rf"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))


def marked(text: str, pattern: regex.Pattern, sep: str) -> str:
    """`text` with `sep` (which it doesn't hold) between pieces whose encodings, one after another, are the encoding of the whole."""
    long, lone = looks(text)
    if long:
        return sep.join(pattern.findall(text))
    lone = lone and not (" ." in text or " ," in text or "\n." in text or "\n," in text or not text.isascii() and _SPACED.search(text) or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") and _SPACED.search(text))
    text = text.replace(" ", f"{sep} ").replace("\n", f"{sep}\n{sep}")
    return text.replace(".", f"{sep}.{sep}").replace(",", f"{sep},{sep}") if lone else text


class Memo:
    """What `make` gives for pieces, in two generations of at most `most` pieces and about `room` bytes each;
    pieces over `longest` characters aren't kept.

    A piece used again moves to the newer generation; when that is full it becomes the older one, and the older one goes.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int = 240_000, room: int = 48 << 20, longest: int = 256):
        self.make, self.most, self.room, self.longest = make, most, room, longest
        self.held, self.older, self.size = {}, {}, 0

    def get(self, pieces: list[str]) -> list[bytes]:
        known = list(map(self.held.get, pieces))
        at = [k for k, v in enumerate(known) if v is None]
        if not at:
            return known
        lacking = [pieces[k] for k in at]
        found = list(map(self.older.get, lacking)) if self.older else [None] * len(lacking)
        made = iter(self.make([x for x, v in zip(lacking, found) if v is None]))
        found = [next(made) if v is None else v for v in found]
        for k, v in zip(at, found):
            known[k] = v
        if len(self.held) + len(lacking) > self.most or self.size > self.room:
            self.older, self.held, self.size = self.held, {}, 0
        sizes = list(map(len, lacking))
        if max(sizes) > self.longest:
            lacking, found, sizes = zip(*((x, v, n) for x, v, n in zip(lacking, found, sizes) if n <= self.longest)) if min(sizes) <= self.longest else ((), (), ())
        self.held.update(zip(lacking, found))
        self.size += sum(sizes) + sum(map(len, found)) + 100 * len(sizes)
        return known


def id_bytes(n: int, kind: str = "<u4") -> list[bytes]:
    """The bytes of each id below `n`."""
    every, width = np.arange(n, dtype=kind).tobytes(), np.dtype(kind).itemsize
    return [every[at : at + width] for at in range(0, width * n, width)]


def encode_batch(texts: list[str], mark: Callable[[str, str], str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The ids (u32) of all texts one after another, and how many each has.

    `mark` puts a separator between pieces, `memo` gives pieces' ids as bytes. Pieces are told apart by Arrow; each
    distinct one of the batch is encoded once, and its ids are gathered wherever it stands.
    """
    sep = next((c for c in SEPARATORS if not any(c in t for t in texts)), None)
    if sep is None:  # texts that hold all of them go piece by piece of one character at most between separators
        parts = [b"".join(memo.make(mark(t, SEPARATORS[0]).split(SEPARATORS[0]) if SEPARATORS[0] not in t else [t])) for t in texts]
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], dtype=np.int64)
    lists = pc.split_pattern(pa.array([mark(t, sep) for t in texts], pa.large_string()), sep)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = lists.flatten().dictionary_encode()
    del lists
    codes = coded.indices.to_numpy(zero_copy_only=False)
    parts = memo.get(coded.dictionary.to_pylist())
    del coded
    length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ids = np.frombuffer(b"".join(parts), "<u4")
    del parts
    each = length[codes]
    upto = np.concatenate([[0], np.cumsum(each)])
    small = np.int32 if len(ids) < 1 << 31 and upto[-1] < 1 << 31 else np.int64  # half the memory
    at = np.repeat(((np.cumsum(length) - length)[codes] - upto[:-1]).astype(small), each)
    at += np.arange(len(at), dtype=small)
    return ids[at], np.diff(upto[ends], prepend=0)


class Cache(dict):
    """What `make` gives for a key. Two generations of at most `most` keys each: a key used again moves to the newer."""

    def __init__(self, make: Callable, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def all(self, keys: list) -> list:
        return list(map(self.__getitem__, keys))
