"""Token ids of whole texts by a tokenizers file whose tokens never span white space.

Texts of Latin-1 characters are folded as the file's normaliser folds them and cut at white space;
each distinct folded word is cut by the file's own pattern, and the library's model encodes the
parts once. A bounded cache in each Python worker keeps the ids of words. Other texts, and texts
that may hold a special token, go to the library word by word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from struct import Struct

import numpy as np

from swatchwork.llm.caches import claim

_tokenizers: dict[str, _Words] = {}

#: Characters that str.split() takes as white space though the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_LETTERS = {c for c in range(256) if chr(c).isalpha()}
_NUMBERS = {c for c in range(256) if chr(c).isnumeric()}
_BLANKS = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
#: Latin-1 bytes as the normaliser folds them: white space to a blank, letters to lower case.
_FOLD = bytes(32 if c in _BLANKS else ord(low) if len(low := chr(c).lower()) == 1 and ord(low) < 256 else c for c in range(256))
#: "," for commas and full stops, "s" for other symbols, "a" for all else.
_KIND = bytes(ord("," if c in b",." else "a" if c in _LETTERS | _NUMBERS | _BLANKS else "s") for c in range(256))
_set = lambda codes: "[" + "".join(f"\\x{c:02x}" for c in sorted(codes)) + "]"
#: The file's pattern for parts of a word, in Latin-1.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|{0}+|{1}|[^{2}]+".format(_set(_LETTERS), _set(_NUMBERS), _set(_LETTERS | _NUMBERS | _BLANKS)[1:-1]).encode())


_PACKS = [Struct(f"={n}I").pack for n in range(32)]


def byte_letters() -> dict[int, str]:
    """Letters that a byte-level vocabulary writes for bytes: printable Latin-1 stands for itself,
    the others follow from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Ids(dict):
    """Ids of words; a word that is missing comes from the generation before or is encoded."""

    def __init__(self, old: dict, encode: Callable[[str | bytes], bytes]):
        super().__init__()
        self.old, self.encode = old, encode

    def __missing__(self, word: str | bytes) -> bytes:
        ids = self.old.get(word) or self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class _Words:
    """``size``: words of a generation; two are held. ``step``: words between two looks at the size."""

    def __init__(self, path: str, size: int = 200_000, step: int = 50_000):
        from tokenizers import Tokenizer

        self.lib, self.size, self.step = Tokenizer.from_file(path), size, step
        self.model = self.lib.model
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        self.marks: dict[bytes, bytes] = {}
        self.young = _Ids({}, self._encode)

    def _part(self, part: bytes) -> bytes:
        if part.isalpha():
            text = part.decode()
        else:
            text = "".join(map(self.letters.__getitem__, part.decode("latin-1").encode()))
        ids = [t.id for t in self.model.tokenize(text)]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else array("I", ids).tobytes()

    def _mark(self, part: bytes) -> bytes:
        """Ids of a number or of symbols; a text has few distinct ones, and only short ones are kept."""
        ids = self.marks.get(part)
        if ids is None:
            ids = self._part(part)
            if len(part) <= 8 and len(self.marks) < 5000:
                self.marks[part] = ids
        return ids

    def _encode(self, word: str | bytes) -> bytes:
        if isinstance(word, str):
            return array("I", self.lib.encode(word, add_special_tokens=False).ids).tobytes()
        if word.isalpha():
            return self._part(word)
        parts = _PARTS.findall(word)
        if len(parts) == 1:
            return self._part(parts[0])
        return b"".join((self.young.get(x) or self._part(x)) if x[0] in _LETTERS else self._mark(x) for x in parts)

    def _cut(self, text: str) -> list[str] | list[bytes]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"<|"
        if b"<|" in raw:  # may be a special token, which is matched before anything is folded
            return [text] if _ODD.search(text) else text.split()
        kinds, raw = raw.translate(_KIND), raw.translate(_FOLD)
        if b"s," not in kinds and b",," not in kinds:  # each comma or full stop before a blank is a part of its own
            raw = raw.replace(b", ", b" , ").replace(b". ", b" . ")
        return raw.split()

    def ids(self, text: str) -> np.ndarray:
        words = self._cut(text)
        found = []
        for i in range(0, len(words), self.step):
            if len(self.young) >= self.size:
                self.young.old = {}
                self.young = _Ids(self.young, self._encode)
            found.append(b"".join(map(self.young.__getitem__, words[i : i + self.step] if i or len(words) > self.step else words)))
        return np.frombuffer(b"".join(found), "<u4")


def word_tokenizer(path: str) -> _Words:
    """One tokenizer and cache a worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    words = _tokenizers[path]
    claim(f"words {path}", words.forget)
    return words
