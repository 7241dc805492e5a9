"""Token ids by the tokenizers library, remembered by space-delimited unit.

Where the file's normaliser and splitter are one of the two forms below, no
piece runs past a space that stands between two other characters, so a text's
ids are the concatenation of the ids of its units: the first word, then each
following word together with the space before it (byte-level BPE), or each
word alone (word BPE).  Natural text repeats its units, so most are looked up
instead of merged again.  In texts of ``_KNOWN`` characters, on which Python
and the library agree what is a letter, a digit or white space, the units are
the splitter's own pieces, which repeat more often still and need the merges
alone.  Texts that hold the string of an added token, and
all texts under files of any other form, are encoded whole by the library.
The memory of a worker process is bounded: two generations of ``REMEMBERED``
units.
"""

from __future__ import annotations

import json
import os
import re
from array import array

REMEMBERED = 300_000
_WIDE = re.compile(r" \s")
_LONE = re.compile(r"(?<=\S) (?=\S)")
LONG_UNIT = 256

#: composed Latin letters whose lower case is one letter too
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_KNOWN = re.compile(rf"[\t\n\r -~¡¿«»§°{_LATIN}–—‘’“”…€]*")
_BARE = re.compile(r" ?[A-Za-z]+")
_SHORT = "'(?:[stmd]|re|ve|ll)"
#: the splitters of the two forms for such characters
_BYTE_PIECES = re.compile(rf" ?[{_LATIN}]+|{_SHORT}| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"[{_LATIN}]+|{_SHORT}|[0-9]|[^\s0-9{_LATIN}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: bytes as the characters that stand for them in byte-level vocabularies
_AS_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


#: (normaliser, splitter) under which a text falls apart at its lone spaces, without and with the space
_BYTES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class Memory(dict):
    """Ids by unit; what is missing is encoded when it is asked for."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class UnitTokenizer:
    """``encode_batch(texts)``: little-endian unsigned 32-bit ids as bytes, as by ``encode(text, add_special_tokens=False)``."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        told = json.loads(self.tokenizer.to_str())
        form = (told["normalizer"], told["pre_tokenizer"])
        added = told["added_tokens"]
        plain = all(not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) for x in added) and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.by_units = plain and form in (_BYTES, _WORDS)
        self.spaced = form == _BYTES
        self.pieces = (_BYTE_PIECES if self.spaced else _WORD_PIECES).findall
        self.added = [x["content"] for x in added]
        self.tokenize = self.tokenizer.model.tokenize
        self.memory = Memory(self._ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if not self.by_units or any(x in t for x in self.added)]
        if not whole:
            return self._by_units(texts)
        skip = set(whole)
        out = self._by_units(["" if k in skip else t for k, t in enumerate(texts)]) if self.by_units else [b""] * len(texts)
        for k in range(0, len(whole), 100):
            part = whole[k : k + 100]
            for at, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[at] = array("I", e.ids).tobytes()
        return out

    def units(self, text: str) -> list[str]:
        if _KNOWN.fullmatch(text):
            return self.pieces(text if self.spaced else text.lower())
        if not self.spaced:
            return text.split(" ")
        if _WIDE.search(text):  # a run of white space is a piece of its own: cut only at lone spaces
            first, *rest = _LONE.split(text)
            return [first, *(" " + x for x in rest)]
        if "\0" in text:
            first, *rest = text.split(" ")
            return [first, *(" " + x for x in rest)]
        return text.replace(" ", "\0 ").split("\0")

    def _by_units(self, texts: list[str]) -> list[bytes]:
        self.memory.age()
        get = self.memory.__getitem__
        return [b"".join(map(get, self.units(t))) for t in texts]

    def _ids(self, unit: str) -> bytes:
        """Ids of a unit; one of known characters falls into pieces, which need no normaliser or splitter, only the merges."""
        if not _KNOWN.fullmatch(unit):
            return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if not self.spaced:
            unit = unit.lower()
        if _BARE.fullmatch(unit):
            pieces = [unit.replace(" ", "\u0120")]
        else:
            pieces = [p.encode().decode("latin-1").translate(_AS_CHARS) for p in self.pieces(unit)]
        return array("I", [t.id for p in pieces for t in self.tokenize(p)]).tobytes()


_loaded: dict[str, UnitTokenizer] = {}


def tokenizer(file: str) -> UnitTokenizer:
    """One per worker process."""
    if file not in _loaded:
        _loaded[file] = UnitTokenizer(file)
    return _loaded[file]


def runs(texts: list[str], most: int = 1 << 20):
    """Slices of about ``most`` characters."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)
