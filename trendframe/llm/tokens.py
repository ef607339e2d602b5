"""Token ids of whole texts by the ``tokenizers`` library, with worker-wide caches.

A byte-level BPE first splits a text by a fixed pattern and then merges
inside each part only, so the ids of a text are the ids of its parts in
order. No part spans the place between a non-space and a single space or line
end, which lets a text be cut there; a different word is then encoded about
once per worker, not once per occurrence. Texts that the cut does not cover
(other scripts, control characters, strings of added tokens) go through
the library as a whole. All paths give the same ids.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from string import punctuation

import numpy as np
import regex
from tokenizers import Tokenizer

# The split pattern of byte-level BPE tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters outside these ranges send a text through the library as a whole.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]")
#: The UTF-8 bytes of those ranges; 0xC2 also leads characters that are not in them.
_USUAL = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xCA)])
_SPACES = re.compile(r"\s\s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: Entries of a cache after which it starts anew.
CACHE = 300_000

_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def unusual(text: str) -> bool:
    """Whether a text has characters that the cut at spaces does not cover."""
    raw = text.encode("utf-8", "surrogatepass")
    return bool(raw.translate(None, _USUAL)) or b"\xc2" in raw and bool(_OTHER.search(text))


def spaced(text: str) -> bool:
    """Whether two white-space characters follow each other."""
    if "\t" in text or "\r" in text:
        return bool(_SPACES.search(text))
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


def _byte_letters() -> dict[int, int]:
    """Byte -> letter by which the vocabulary writes it: printable bytes stand for themselves."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}


def _packed(tokens: list) -> bytes:
    ids = [t.id for t in tokens]
    n = len(ids)
    return _PACK[n](*ids) if n < 64 else struct.pack(f"<{n}I", *ids)


class _Parts(dict):
    """Part of the split pattern -> its ids."""

    def __init__(self, model, cache: int):
        super().__init__()
        self.tokenize, self.letters, self.cache = model.tokenize, _byte_letters(), cache

    def __missing__(self, part: str) -> bytes:
        ids = _packed(self.tokenize(part.encode().decode("latin-1").translate(self.letters)))
        if len(self) >= self.cache:
            self.clear()
        self[part] = ids
        return ids


class _Words(dict):
    """Word after ``lead`` -> ids of both; words used lately outlive a full cache."""

    def __init__(self, parts: _Parts, pattern, lead: str):
        super().__init__()
        self.parts, self.findall, self.lead, self.old = parts, pattern.findall, lead, {}
        self.tokenize, self.letters, self.cache = parts.tokenize, parts.letters, parts.cache
        self.mapped = lead.translate(self.letters)

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.old.pop(word, None)
            if ids is None:
                # letters alone are one part
                after = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = _packed(self.tokenize(self.mapped + after))
        else:
            stem = word.rstrip(punctuation)
            if not stem.isalpha():
                return b"".join([self.parts[p] for p in self.findall(self.lead + word)])
            # marks after letters are a part of their own
            known = stem in self
            ids = self[stem] + self.parts[word[len(stem):]]
            if not known:  # a rare word need not be kept with each of its marks
                return ids
        if len(self) >= self.cache:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` -> little-endian unsigned 32-bit ids, no special tokens added."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        self.by_parts = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
                         and not spec["model"].get("dropout"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size()
        self.pattern = regex.compile(SPLIT)
        self.parts = _Parts(self.tokenizer.model, cache)
        self.words = _Words(self.parts, self.pattern, " ")
        self.firsts = _Words(self.parts, self.pattern, "")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_parts or unusual(text) or any(t in text for t in self.added):
            return self.whole(text)
        if spaced(text):
            return b"".join([self._stretch(x) for x in _BEFORE_SPACE.split(text)])
        return self.parts["\n"].join([self._line(x) for x in text.split("\n")])

    def _stretch(self, text: str) -> bytes:
        """Ids of what lies between two cuts of a text with runs of white space."""
        if text[0] == " " and " " not in text[1:]:
            return self.words[text[1:]]
        return b"".join([self.parts[p] for p in self.pattern.findall(text)])

    def _line(self, line: str) -> bytes:
        """Ids of a line without runs of white space."""
        first, *rest = line.split(" ")
        return self.firsts[first] + b"".join(map(self.words.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder for a vocabulary file; caches live as long as the worker."""
    return Encoder(path, cache)
