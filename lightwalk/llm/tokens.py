"""Token ids of whole texts, by the tokenizers library, with memory for the words that return.

A tokenizer file is cut into two steps that agree with encoding the text in one go:

* ``units``: the text is cut where no token can reach across. A word tokenizer that drops white space is cut at every run
  of ASCII white space; a byte-level one before every run of it, which keeps the run with what follows.
* ``pieces``: a unit not met before is cut by the tokenizer's own pattern and given to the tokenizer's model; units with
  characters outside Latin script, and texts with other white space, go through the tokenizer as they are.

Ids of units are kept in a table of bounded size, which only saves time. A tokenizer file whose normaliser, split pattern
or model options are others than the ones these cuts agree with encodes whole texts by the library alone.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from functools import lru_cache

#: The tokenizers' published split patterns, for units of Latin script.
_WORD = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|[0-9]|[^\sa-zA-Z0-9ªµºÀ-ÖØ-öø-ɏ]+")
_BYTES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?[^\sa-zA-Z0-9ªµºÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
#: Units that the patterns above cut as the tokenizer does: ASCII, Latin-1 and Latin Extended letters, no other digits.
_PLAIN = re.compile(r"[ \t-\r!-~À-ÖØ-öø-ĿŁ-ňŊ-ſ]*\Z")
#: White space outside ASCII, and separators, which the byte-level pattern counts as white space.
_SPACES = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Any of these: white space does not stand alone everywhere.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f", "\0")
_UNITS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


#: Normaliser, pre-tokenizer and model options that the cuts agree with.
_NONE = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
STEPS = {
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {**_LEVEL, "use_regex": False}]},
        {**_NONE, "end_of_word_suffix": "</w>"},
    ),
    "bytes": (None, {**_LEVEL, "use_regex": True}, {**_NONE, "end_of_word_suffix": None}),
}


def _steps(tokenizer) -> tuple:
    told = json.loads(tokenizer.to_str())
    model = told["model"]
    return told["normalizer"], told["pre_tokenizer"], {k: model.get(k) for k in (*_NONE, "end_of_word_suffix")} if model["type"] == "BPE" else None


class _Known(dict):
    """Ids of units, in two generations: when the young one is full it becomes the old one, from which units still in use return."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, unit):
        ids = self.old.pop(unit, None) or self.encode(unit)
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. ``kind``: "word" or "bytes". ``plain``: strings of special tokens are text."""

    def __init__(self, path: str, kind: str, remember: int = 400_000, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model, self.kind = self.tokenizer.model, kind
        self.known_file = _steps(self.tokenizer) == STEPS[kind]
        self.letters = "".join(_byte_letters())
        self.marks = set() if plain else {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.space, self.newline = self.letters[ord(" ")], self._pieces(("\n",)) if kind == "bytes" else b""
        self.stops = {c: self._pieces((c,)) for c in ".,;:!?"}
        self.known = _Known(self._word if kind == "word" else self._bytes, remember)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, word: str) -> bytes | None:
        """Ids of ASCII letters, perhaps with one mark after them: the usual unit. None for any other."""
        mark = b""
        if not word.isalpha():
            mark, word = self.stops.get(word[-1:]), word[:-1]
            if mark is None or not word.isalpha():
                return None
        if not word.isascii():
            return None
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes() + mark

    def _word(self, unit: bytes) -> bytes:
        text = unit.decode()
        ids = self._plain(text.lower())
        if ids is not None:
            return ids
        if _LETTERS.match(text):
            return self._pieces((text.lower(),))
        if _PLAIN.match(text) and self.marks.isdisjoint(text):
            return self._pieces(_WORD.findall(text.lower()))
        return self.whole(text)

    def _bytes(self, unit: str) -> bytes:
        first, body = unit[:1], unit[1:]
        if first == "\n":  # a piece by itself before a letter
            ids = self._plain(body)
            if ids is not None:
                return self.newline + ids
        elif first == " " and body.isascii():
            if body.isalpha():
                return array("I", [t.id for t in self.model.tokenize(self.space + body)]).tobytes()
            mark = self.stops.get(body[-1:])
            if mark is not None and body[:-1].isalpha():
                return self.known[unit[:-1]] + mark  # the word alone is likely known
        else:
            ids = self._plain(unit)
            if ids is not None:
                return ids
        if _LETTERS.match(unit):
            return self._pieces((unit,))
        if _PLAIN.match(unit) and self.marks.isdisjoint(unit):
            return self._pieces(_BYTES.findall(unit))
        return self.whole(unit)

    def _pieces(self, parts) -> bytes:
        ids, tokenize = [], self.model.tokenize
        for part in parts:
            if not part.isascii() or part[0] <= " ":
                part = codecs.charmap_decode(part.encode(), "strict", self.letters)[0]
            ids += [t.id for t in tokenize(part)]
        return array("I", ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids of the whole text; null and empty texts have none."""
        if not text:
            return b""
        if not self.known_file:
            return self.whole(text)
        if self.kind == "word":
            return b"".join(map(self.known.__getitem__, text.encode().split()))
        if any(c in text for c in _SPACES):
            return self.whole(text)
        if any(c in text for c in _RUNS):
            units = _UNITS.findall(text)
        else:  # the usual case: white space stands alone
            units = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return b"".join(map(self.known.__getitem__, units))


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder, kept from task to task together with the units that it knows: fewer of a tokenizer that lower-cases its words."""
    return Encoder(path, kind, remember=150_000 if kind == "word" else 400_000)
