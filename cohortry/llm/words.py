"""Token ids by whole words: distinct words are encoded once and looked up afterwards.

A text is cut before single spaces between two non-space characters. Neither tokenizer
pattern used here matches across such a place and normalisation does not either, so the
pieces' ids, joined, are the text's ids. A piece of plain letters and closing marks (no
apostrophe) is two pre-tokens at most and goes straight to the tokenizer's model, and so
do several of them on lines of their own; any other piece goes through the whole tokenizer. A test compares both on random text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Words one worker remembers; about 120 MB. The memory is emptied when full.
REMEMBER = 500_000
#: Longer pieces are encoded but not remembered.
LONG = 64

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = ("  ", " \n", "\n ", *"\t\r\v\f\x1c\x1d\x1e\x1f")
_ODD_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, bool], "WordEncoder"] = {}


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others come after 255."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_SHOWN = _byte_characters()


class WordEncoder:
    """``plain_marks`` encodes the names of special tokens in a text as ordinary characters."""

    def __init__(self, path: str, plain_marks: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_marks
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        samples = ["Ab", "zébra", "Straße", "it", "so%", "be.\nAt", "Ça\nou,"]
        # how plain words reach the model: with the space and line ends between them, or in lower case
        for self.plain, shown in ((lambda w: " " + w, [_SHOWN[10]]), (str.lower, [])):
            self.line = array("I", [t.id for s in shown for t in self.tokenize(s)]).tobytes()
            if all(self._plain(w) == self._whole([" " + w])[0] for w in samples):
                break
        else:
            self.plain = None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, text: str) -> bytes:
        if text.isascii():  # printable, but for spaces
            shown = text.replace(" ", _SHOWN[32])
        else:
            shown = text.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = self._model(text)
            if len(text) <= LONG:
                self.parts[text] = found
        return found

    def _first(self, word: str) -> bytes:
        """Ids of a text's first piece, which no space precedes."""
        m = _PLAIN.fullmatch(word) if self.plain else None
        if not m:
            return self._whole([word])[0]
        return self._part(self.plain(m[1]).lstrip(" ")) + (self._part(m[2]) if m[2] else b"")

    def _plain(self, word: str) -> bytes | None:
        """Ids of a plain word, or of plain words on several lines, that follow a space."""
        m = _PLAIN.fullmatch(word)
        if m:
            ids = self._part(self.plain(m[1]))
            return ids + self._part(m[2]) if m[2] else ids
        if "\n" not in word:
            return None
        lines = [_PLAIN.fullmatch(w) for w in word.split("\n")]
        if not all(lines):
            return None
        ids = [self._part(self.plain(lines[0][1])), self._part(lines[0][2])]
        for m in lines[1:]:
            ids += [self.line, self._part(self.plain(m[1]).lstrip(" ")), self._part(m[2])]
        return b"".join(ids)

    def _learn(self, words: list[str]) -> None:
        """Ids of words that follow a space."""
        other = []
        for word in words:
            ids = self._plain(word) if self.plain else None
            if ids is None:
                other.append(word)
            else:
                self.known[word] = ids
        if other:
            self.known.update(zip(other, self._whole([" " + w for w in other])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        known = self.known
        for text in texts:
            if len(known) > REMEMBER or len(self.parts) > REMEMBER:
                known.clear()
                self.parts.clear()
            odd = (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _ODD)
                   or not text.isascii() and _ODD_WIDE.search(text))
            pieces = _CUT.split(text) if odd else text.split(" ")
            head, rest = "\0" + pieces[0], pieces[1:]
            found = list(map(known.get, rest))
            missing = set()
            if None in found:
                missing = {w for w, ids in zip(rest, found) if ids is None}
                self._learn(list(missing))
                found = map(known.__getitem__, rest)
            if head not in known:
                known[head] = self._first(pieces[0])
            out.append(known[head] + b"".join(found))
            for w in [w for w in (*missing, head) if len(w) > LONG]:
                known.pop(w, None)
        return out


def encoder(path: str, plain_marks: bool = False) -> WordEncoder:
    """The worker's own encoder of a tokenizer file."""
    at = path, plain_marks
    if at not in _ENCODERS:
        _ENCODERS[at] = WordEncoder(path, plain_marks)
    return _ENCODERS[at]
