"""Spelling variants of the corpus's words by PartEnum signatures.

A word's letters with their counts are a binary vector: its dimensions are (letter,
k-th occurrence). Words one replaced code point apart have one length and vectors
at Hamming distance two; words one inserted or deleted code point apart differ by
one in length and by one dimension. Dimensions are dealt to ``k + 2`` parts (``k``
the distance, a fixed hash of the dimension decides); vectors that differ in ``k``
dimensions agree on all but ``k`` parts, so each word emits one signature per choice of
two parts, for the lengths at which the other word may be found. Near words share a
signature, so an equi-join finds them all, and the edit distance verifies what it finds.

An edit leaves one half of the word as it is. Every signature is therefore emitted
twice, with the first and with the last half of the word in its key: still exact, and
words that merely share letters (anagrams, words over few letters) do not meet.

Counting: a task counts its words in a table of at most ``HELD`` words, which is passed
on whenever it is full, and Spark sums the counts; no list of occurrences is shuffled.

Forms: a word's form is its near word of largest n (ties: the smallest in code-point
order) if that n is at least twice the word's own. The root follows forms to the last;
n at least doubles on the way, so 64 steps are enough and doubling the pointers takes
seven rounds at most.

Defined cases: a null or empty text has no words. A null id counts as empty text
in the rule that deletes code points. Rows that share an id, and repeated rows,
each count. Words over ``least_length`` code points have no upper bound. Without words
there are no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, save, text_batches

#: Distinct words that a task holds while counting.
HELD = 400_000
#: Bytes of text of one step.
PIECE = 4_000_000
#: Letters of Latin-1 stay, only A-Z lower-cased; every other byte parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _counter(least_length: int, drop_every: int):
    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in text_batches(batches, "text", PIECE):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{key or ''}:".encode())
                for word, n in Counter(text.encode("latin-1", "replace").translate(_TABLE).split()).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield batch(counts)
                    counts.clear()
        yield batch(counts)

    return run


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
          drop_every: int = 97) -> DataFrame:
    """word and n: the words of the texts, after the code point that the crc32 of
    ``<id>:<word>`` names is deleted where ``drop_every`` divides that number."""
    rows = docs.select(column(docs, id_col).cast("string").alias("id"), column(docs, text_col).alias("text"))
    counts = rows.mapInArrow(_counter(least_length, drop_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def vector_parts(word: str, parts: int) -> list[bytes]:
    """The word's letter vector: the dimensions of each part, in order."""
    out: list[list[str]] = [[] for _ in range(parts)]
    for letter, n in sorted(Counter(word).items()):
        for k in range(n):
            out[(ord(letter) * 0x9E3779B1 + k * 0x85EBCA77 >> 7) % parts].append(f"{letter}{k}")
    return [" ".join(p).encode() for p in out]


def signatures(word: str) -> list[tuple[str, int, int, bytes]]:
    """(role, length, side, content) of each signature. Words meet within a role
    ``same``, and where a ``short`` one equals a ``long`` one."""
    size = len(word)
    out = []
    for role, length, distance in (("same", size, 2), ("short", size, 1), ("long", size - 1, 1)):
        half = (length + 1) // 2
        sides = (word[:half], word[len(word) - (length - half) :])
        parts = vector_parts(word, distance + 2)
        for chosen in combinations(range(distance + 2), 2):
            body = b"|".join([bytes(chosen), *(parts[p] for p in chosen)])
            out += [(role, length, side, text.encode() + b"|" + body) for side, text in enumerate(sides)]
    return out


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            part = whole.slice(start, 2000)
            at, role, key = [], [], []
            for i, word in enumerate(part.column("word").to_pylist()):
                for kind, length, side, content in signatures(word):
                    at.append(i)
                    role.append(kind)
                    key.append(hashlib.blake2b(b"%d|%d|%d|" % (kind != "same", length, side) + content, digest_size=16).digest())
            yield pa.record_batch([part.column("word").take(pa.array(at, pa.int32())), part.column("n").take(pa.array(at, pa.int32())),
                                   pa.array(role, pa.string()), pa.array(key, pa.binary())], ["word", "n", "role", "key"])


def near_words(found: DataFrame) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words of ``found`` (word, n) that
    differ by one inserted, deleted or replaced code point."""
    signed = save(found.mapInArrow(_signer, "word string, n long, role string, key binary"), "signatures")
    left = signed.filter("role in ('same', 'short')").select("key", F.col("role").alias("kind"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.filter("role in ('same', 'long')").select("key", F.col("role").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    meet = (F.col("kind") == "short") | (F.col("a") < F.col("b"))
    pairs = (left.join(right, "key").filter(meet & (F.levenshtein("a", "b", 1) == 1))
             .groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n")))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (word, form, neither null), by doubling pointers."""
    step = save(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(7):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not step.join(ahead, "root", "left_semi").limit(1).count():
            break
        step = save(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
             drop_every: int = 97, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word."""
    found = save(words(docs, id_col, text_col, least_length, least_count, drop_every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    grouped = near_words(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = found.join(grouped, "word", "left").withColumn("has", -F.col("best.less") >= factor * F.col("n"))
    table = save(chosen.select("word", "n", F.when(F.col("has"), F.col("best.near")).alias("form"),
                               F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(table.filter("form is not null"))
    return (table.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
