"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold ``rank * width + position`` of each adjacent
pair of symbols, inner nodes the minimum of their children. So the root is the
leftmost pair of lowest rank. It is merged, the two neighbouring leaves and the
leaf that vanished are updated in logarithmic time, and this goes on until the
root says that no mergeable pair is left. Words of up to 64 symbols are merged
many at a time (one numpy row each); longer ones alone in a tree of their own.

White space always ends a word, so a text is cut there and each distinct piece
is encoded once per task; the table of pieces is bounded and starts anew when
full. Whole texts are encoded, batches are cut by bytes, and nothing is shuffled.

The vocabulary is read from a public tokenizer file (``path``) of the kind with
word ends: NFC, white space dropped, lower case, byte-level symbols, ``</w>``.

Defined cases: a null or empty text has no ids and decodes to the empty text;
strings of special tokens inside a text become their ids; repeated rows and null
ids pass through; other columns are not read. Letters and numbers are those of
the installed Unicode tables; code points that these leave unassigned count as
neither.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, text_batches

#: Symbols of the longest word that is merged together with others.
WIDE = 64
#: Pieces held by one task at most.
HELD = 600_000
_CONTROL = re.compile("[\x1c-\x1f]")
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        chars = _byte_symbols()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], dtype=np.int64)
        self.size = max(self.token) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # A pair listed twice keeps its later rank, as in a table filled in order.
        order = np.lexsort((-np.arange(len(keys)), keys))
        keep = np.append(True, keys[order][1:] != keys[order][:-1])
        self.keys, self.ranks, self.made = keys[order][keep], order[keep], made
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.blank = regex.compile(r"\s+")
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces: dict[str, tuple[bytes, ...]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The base symbols of all words in one row, and where each word ends."""
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        out = self.first[flat]
        out[ends - 1] = self.last[flat[ends - 1]]
        return out, ends

    def _merge_rows(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> list[bytes]:
        """Ids of words of at most ``width`` (a power of two) symbols, cut from ``flat``."""
        n, rows = len(length), np.arange(len(length))
        sym = np.zeros((n, width + 1), dtype=np.int64)
        at = np.minimum(start[:, None] + np.arange(width), len(flat) - 1)
        sym[:, :width] = np.where(np.arange(width) < length[:, None], flat[at], 0)
        after = np.minimum(np.arange(1, width + 1)[None, :], length[:, None]).astype(np.int64)
        after[np.arange(1, width + 1) >= length[:, None]] = width
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        rank = self._rank(sym[:, : width - 1], sym[:, 1:width])
        here = (np.arange(1, width) < length[:, None]) & (rank >= 0)
        tree[:, width : 2 * width - 1] = np.where(here, rank * width + np.arange(width - 1), _NONE)
        for level in (width >> k for k in range(1, width.bit_length())):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        alive = np.arange(width) < length[:, None]
        while True:
            rows = rows[tree[rows, 1] < _NONE]
            if not len(rows):
                break
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            sym[rows, i] = self.made[root // width]
            alive[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            before[rows, k] = i
            tree[rows, width + j] = _NONE
            right = np.where(k < width, self._rank(sym[rows, i], sym[rows, k]), -1)
            tree[rows, width + i] = np.where(right >= 0, right * width + i, _NONE)
            p = before[rows, i]
            left = np.where(p >= 0, self._rank(sym[rows, p], sym[rows, i]), -1)
            at = np.maximum(p, 0)
            tree[rows, width + at] = np.where(p >= 0, np.where(left >= 0, left * width + at, _NONE), tree[rows, width + at])
            for leaf in (j, i, at):
                node = (leaf + width) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
        flat, ends = sym[:, :width][alive].astype("<u4").tobytes(), np.cumsum(alive.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, word: np.ndarray) -> bytes:
        """Ids of one word of any length."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        sym, after, before = word.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = self._rank(word[:-1], word[1:])
        leaves = np.full(width, _NONE, dtype=np.int64)
        leaves[: n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), _NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [_NONE, *np.concatenate(levels[::-1]).tolist()]
        known: dict[int, int] = {}

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def leaf(a: int, b: int) -> int:
            key = sym[a] * self.size + sym[b]
            if key not in known:
                known[key] = int(self._rank(np.array([sym[a]]), np.array([sym[b]]))[0])
            return known[key] * width + a if known[key] >= 0 else _NONE

        gone = [False] * n
        while tree[1] < _NONE:
            i = tree[1] % width
            sym[i], j = int(self.made[tree[1] // width]), after[i]
            gone[j], k = True, after[j]
            after[i] = k
            put(j, _NONE)
            if k < n:
                before[k] = i
            put(i, leaf(i, k) if k < n else _NONE)
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return np.array([s for s, out in zip(sym, gone) if not out], dtype="<u4").tobytes()

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32 bit) of each distinct word."""
        words = [*dict.fromkeys(words)]
        if not words:
            return {}
        out: dict[str, bytes] = {}
        flat, ends = self._symbols(words)
        length = np.diff(ends, prepend=0)
        start, least = ends - length, 0
        for width in (4, 8, 16, 32, WIDE):
            some = np.flatnonzero((length > least) & (length <= width))
            least = width
            for a in range(0, len(some), 20_000):
                part = some[a : a + 20_000]
                out.update(zip([words[i] for i in part.tolist()], self._merge_rows(flat, start[part], length[part], width)))
        for i in np.flatnonzero(length > WIDE).tolist():
            out[words[i]] = self._merge_long(flat[start[i] : ends[i]])
        return out

    def _learn(self, pieces: set[str]) -> None:
        cut = {p: (p,) if p.isalpha() else self.words.findall(p) for p in pieces}
        ids = self.merge([w for words in cut.values() for w in words])
        self.pieces.update({p: ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w]) for p, w in cut.items()})

    def _plain(self, text: str) -> list[str]:
        """Pieces of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        # Lower case is taken letter by letter, so a final sigma has no form of its own.
        text = text.replace("Σ", "σ").lower()
        # The file's white space lacks four control characters that str.split() drops.
        return self.blank.split(text) if _CONTROL.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit integers."""
        marks, split = self.marks, []
        for text in texts:
            parts: list[list[str] | bytes] = []
            if marks and "<|" in text and marks.search(text):
                at = 0
                for m in marks.finditer(text):
                    parts += [self._plain(text[at : m.start()]), self.special[m.group()].to_bytes(4, "little")]
                    at = m.end()
                parts.append(self._plain(text[at:]))
            else:
                parts.append(self._plain(text))
            split.append(parts)
        pieces = {p for parts in split for part in parts if isinstance(part, list) for p in part}
        fresh = pieces - self.pieces.keys()
        if len(self.pieces) + len(fresh) > HELD:
            self.pieces, fresh = {}, pieces
        self._learn(fresh)
        table = self.pieces
        return [b"".join([p if isinstance(p, bytes) else b"".join([table[x] for x in p]) for p in parts]) for parts in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The tokens' strings joined by one space (the file names no decoder)."""
        token = self.token
        return [" ".join([token[i] for i in np.frombuffer(x, dtype="<u4").tolist()]) for x in ids]


def _load(path: str | None) -> WordBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordBpe(path)


def encoder(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(path)
        for batch in text_batches(batches, "text"):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([
                batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array(bpe.decode(ids), pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_tokens, ids (binary, little-endian
    unsigned 32-bit integers) and decoded (the text read back from the ids).
    ``path`` is the tokenizer file as the workers see it; by default the public
    word-level file."""
    kind = df.select(column(df, id_col).alias("id")).schema[0].dataType.simpleString()
    return df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text")).mapInArrow(
        encoder(path), f"id {kind}, n_tokens bigint, ids binary, decoded string")
