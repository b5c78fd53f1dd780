"""Byte-level BPE with the tokenizers library, a batch of texts at a time.

The library splits a text into pieces (a word with the blank before it, digits,
signs, white space) and merges inside a piece only, so equal pieces get equal ids.
``Encoder`` finds the pieces of many texts with array operations, lets the library
encode each distinct piece once and gathers the ids. Texts with characters whose
class depends on the Unicode version, or with a special token's string, go through
the library whole, and so do all texts if the file splits them by other rules. The ids equal the library's on the whole text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

#: Characters split here: blocks in which every code point has long been assigned.
PLAIN = r"\x00-\x1b\x20-ȶЁ-҆Ҋ-ԓ‐-‧‰-⁞₠-₱一-龥"
_STRANGE = re.compile(f"[^{PLAIN}]")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Distinct pieces remembered by one task.
REMEMBERED = 250_000


def _byte_letters() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary: printable ones for
    themselves, the others for the code points from 256 on, in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256)}


def _classes() -> np.ndarray:
    out = np.full(0xA000, _OTHER, np.uint8)
    for cp in range(0xA000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = _LETTER
        elif kind[0] == "N":
            out[cp] = _NUMBER
        elif kind[0] == "Z" or cp in (9, 10, 11, 12, 13, 0x85):
            out[cp] = _SPACE
    return out


def cuts(code: np.ndarray, begin: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where a piece starts, for texts that lie behind one another in ``code`` and
    start at the places ``begin``."""
    kind = classes[code]
    size = len(code)
    out = np.zeros(size + 1, bool)
    out[1:size] = kind[1:] != kind[:-1]
    space = kind == _SPACE
    opens = np.zeros(size + 1, bool)  # a text starts here
    opens[begin] = True
    # the last white space before something else is a piece, a blank joins what follows
    ahead = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:size])
    out[ahead] = True
    joined = ahead[code[ahead] == 32] + 1
    out[joined] = False
    out[begin] = True
    quote = np.flatnonzero((code == 39) & out[:size])
    if len(quote):
        ends = np.append(begin, size)
        room = ends[np.searchsorted(ends, quote, "right")] - quote
        padded = np.concatenate([code, np.zeros(2, code.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (room > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for which, n in ((quote[short], 2), (quote[long], 3)):
            out[which + 1] = False
            out[which + n] = True
    return np.flatnonzero(out[:size])


class Encoder:
    """Ids of texts by the vocabulary file ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.split = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                      and not before.get("add_prefix_space"))
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(marks)) if marks else None
        self.classes, self.letters = _classes(), _byte_letters()
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        """Keep the half that most batches held (a piece of one batch is not likely
        to come again)."""
        n = len(self.known)
        often = np.argsort(-self.seen[:n], kind="stable")[: REMEMBERED // 2]
        often = np.sort(often[self.seen[often] > 1])
        names = list(self.known)
        size = self.size[often]
        ends = np.cumsum(size)
        pool = self.pool[np.repeat(self.start[often] - (ends - size), size) + np.arange(int(size.sum()))]
        seen = self.seen[often]
        self.known = {names[i]: k for k, i in enumerate(often.tolist())}
        self.pool, self.used, self.start, self.size, self.seen = pool, len(pool), ends - size, size, seen

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces in the pool; the library's model merges them."""
        merge, letters = self.tokenizer.model.tokenize, self.letters
        ids = [[t.id for t in merge(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.known), self.used + int(size.sum())
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(total, np.uint32)])
        if first + len(pieces) > len(self.start):
            more = np.zeros(first + len(pieces), np.int64)
            self.start, self.size, self.seen = (np.concatenate([x[:first], more]) for x in (self.start, self.size, self.seen))
        self.pool[self.used : total] = np.fromiter(chain.from_iterable(ids), np.uint32, total - self.used)
        self.start[first : first + len(pieces)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(pieces)] = size
        self.seen[first : first + len(pieces)] = 0
        self.used = total
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts in one row, and how many each has."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begin = (np.cumsum(lengths) - lengths)[lengths > 0]
        first = cuts(code, begin, self.classes)
        wide = np.flatnonzero(code >= 0x80)
        extra = np.concatenate([[0], np.cumsum(1 + (code[wide] >= 0x800))])
        place = np.append(first + extra[np.searchsorted(wide, first)], len(code) + extra[-1]).astype(np.int32)
        raw = joined.encode()
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(place.tobytes()), pa.py_buffer(raw)).dictionary_encode()
        pieces = found.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._shrink()
        new = [p for p in pieces if p not in self.known]
        if new:
            self._learn(new)
        held = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.seen[held] += 1
        at = held[found.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])]
        until = np.searchsorted(first, np.cumsum(lengths))
        n = np.diff(np.concatenate([[0], ends])[until], prepend=0)
        return ids, n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and how many each has."""
        odd = [i for i, t in enumerate(texts) if not self.split or _STRANGE.search(t) or self.marks and self.marks.search(t)]
        if not odd:
            return self._pieces(texts)
        rest = sorted(set(range(len(texts))) - set(odd))
        row, count = self._pieces([texts[i] for i in rest])
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, part in zip(rest, np.split(row, np.cumsum(count)[:-1]) if rest else []):
            out[i] = part
        for i, part in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = part
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)
