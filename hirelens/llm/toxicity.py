"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic model over
hashed words (white-space pieces, lower case, without what is no letter at their ends)
and their first four and five letters, where a word that repeats the one before it
counts once; the document's is their noisy-or ``1 - prod(1 - p)``. Only document labels are known:
the gradient of the document's log loss reaches each sentence in proportion to its
own probability, so weight settles on the sentences that explain the label, and
these are then located. Weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of labelled rows (about ``per_label`` rows and
``per_label_chars`` characters of each label, drawn by hashes of id and place); every document is scored over its whole text.
Where one label is drawn at a higher rate than the other, the ratio of the rates is an
offset of the document's logit while fitting, so scores keep to the odds of all labels.

A sentence ends at a piece that ends in ``.``, ``!`` or ``?`` (symbols after it allowed).

Defined cases: null and empty texts have no sentence and score 0; labels other than 0
and 1, or null, are not learned from; a label row that repeats counts once, of
contradictory ones each counts; documents that share an id share its label; with no label to learn from every text scores 0; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_batches
from .sparse_fit import Ftrl

BITS = 18
DIM = 1 << BITS
_WORD = (1 << 3 * BITS) - 1
PIECE = 4_000_000


class _Pieces(dict):
    """Buckets of a piece's word and of its first 4 and 5 letters, ``BITS`` bits
    each, and above them a 1 where a sentence ends."""

    def __missing__(self, piece: str) -> int:
        a, b = 0, len(piece)
        while a < b and not piece[a].isalpha():
            a += 1
        while b > a and not piece[b - 1].isalpha():
            b -= 1
        end = any(c in ".!?" for c in piece[b:])
        value = end
        for part in (piece[a : min(b, a + 5)] + "5", piece[a : min(b, a + 4)] + "4", piece[a:b]):
            value = (value << BITS) + (zlib.crc32(part.encode("utf-8", "surrogatepass")) & (DIM - 1))
        self[piece] = value
        return value


def unpacked(coded: np.ndarray) -> np.ndarray:
    """The three buckets of each word; ``DIM``, which has no weight, for -1."""
    return np.where(coded[:, None] < 0, DIM, (coded[:, None] >> np.array([0, BITS, 2 * BITS])) & (DIM - 1))


class Sentences:
    """Words of texts laid end to end, cut into sentences."""

    def __init__(self) -> None:
        self.known = _Pieces()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """All words' buckets in one number each (-1 where a word repeats the
        one before it in its sentence), where sentences begin, the number of sentences
        of each text, and the texts' pieces (as written)."""
        pieces = [(t or "").split() for t in texts]
        lower = [(t or "").lower().split() for t in texts]
        if len(self.known) > 400_000:
            self.known.clear()
        counts = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))
        coded = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lower)), dtype=np.int64, count=int(counts.sum()))
        last = np.cumsum(counts)
        ends = (coded >> 3 * BITS).astype(bool)
        ends[last[counts > 0] - 1] = True
        begin = np.flatnonzero(np.append(True, ends[:-1])) if len(ends) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(ends)])
        coded &= _WORD
        again = np.zeros(len(coded), dtype=bool)
        again[1:] = coded[1:] == coded[:-1]
        again[begin] = False
        coded[again] = -1
        return coded, begin, total[last] - total[last - counts], pieces


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Sentences()
    for batch in text_batches(batches, "text", PIECE):
        words, begin, sentences, pieces = cut(batch.column("text").to_pylist())
        sizes = np.diff(np.append(begin, len(words))).astype(np.int32)
        at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
        of = np.concatenate([[0], np.cumsum(sentences)]).astype(np.int32)
        yield pa.record_batch([
            batch.column("label"), batch.column("turn"), pa.ListArray.from_arrays(pa.array(at), pa.array(words)),
            pa.ListArray.from_arrays(pa.array(of), pa.array(sizes))], ["label", "turn", "words", "sizes"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_label: int = 8000, per_label_chars: int = 32_000_000, epochs: int = 5, alpha: float = 0.5, l1: float = 2.0, l2: float = 0.05) -> Model:
    """Fit on the documents of ``docs`` that ``labels`` (id, label) marks 0 or 1.

    The sample holds about ``per_label`` rows and ``per_label_chars`` characters of
    each label (whole documents), so what the driver holds is bounded however long
    documents are and however often an id repeats."""
    marked = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).cast("int").alias("label"))
    marked = marked.filter("id is not null and label in (0, 1)").distinct()
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts:
        return Model(np.zeros(DIM + 1), -40.0)

    def by_label(low: float, high: float):
        return F.when(F.col("label") == 1, high).otherwise(low)

    draw = F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1 << 20)) / float(1 << 20)
    drawn = [min(1.0, per_label / counts.get(k, 1)) for k in (0, 1)]
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    # At most about 2 * per_label ids, whatever the corpus.
    found = texts.join(F.broadcast(marked.filter(draw < by_label(*drawn))), "id")
    held = {r["label"]: r for r in found.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).collect()}
    thin = [min(1.0, per_label / held[k]["n"], per_label_chars / max(1, held[k]["chars"])) if k in held else 1.0 for k in (0, 1)]
    again = F.pmod(F.xxhash64("id", "place", F.lit("thin")), F.lit(1 << 20)) / float(1 << 20)
    odds = drawn[1] * thin[1] / (drawn[0] * thin[0])
    sample = found.filter(again < by_label(*thin)).select("text", "label", F.xxhash64("id", F.lit("turn"), "text").alias("turn"))
    bags = sample.mapInArrow(_bags, "label int, turn long, words array<long>, sizes array<int>").toArrow()
    order = np.argsort(bags.column("turn").to_numpy(), kind="stable").tolist()
    label = bags.column("label").to_pylist()
    words, sizes = bags.column("words").combine_chunks(), bags.column("sizes").combine_chunks()
    model, bias, level = Ftrl((DIM + 1,), alpha, l1, l2), Ftrl((1,), alpha, 0.0, 0.0), -9.0
    for _ in range(epochs):
        for i in order:
            size = sizes[i].values.to_numpy()
            if not len(size):
                continue
            at, where = np.unique(unpacked(words[i].values.to_numpy()), return_inverse=True)
            w, b = model.weights(at), bias.weights()
            real = at < DIM
            w *= real
            begin = np.cumsum(size) - size
            p = _sigmoid(np.add.reduceat(w[where.ravel()], 3 * begin) + b[0] + level)
            whole = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
            # Of the log loss by each sentence's logit; in the sample the document's odds are ``odds`` times as high.
            g = p * (odds if label[i] == 0 else -(1 - whole) / max(whole, 1e-9)) / (1 - whole + odds * whole)
            model.update(at, w, np.bincount(where.ravel(), weights=np.repeat(g, 3 * size), minlength=len(at)) * real)
            bias.update(slice(None), b, np.array([g.sum()]))
    return Model(model.weights(), float(bias.weights()[0] + level))


def _scorer(model: Model, offending: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sentences()
        for batch in text_batches(batches, "text", PIECE):
            words, begin, sentences, pieces = cut(batch.column("text").to_pylist())
            z = np.add.reduceat(model.weights[unpacked(words)].sum(axis=1), begin) + model.bias if len(begin) else np.zeros(0)
            p = _sigmoid(z)
            clear = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
            last = np.cumsum(sentences)
            score = -np.expm1(clear[last] - clear[last - sentences])
            size = np.diff(np.append(begin, len(words)))
            text = np.repeat(np.arange(len(pieces)), sentences)
            base = np.cumsum([0, *map(len, pieces)])
            spans: list[list[dict]] = [[] for _ in pieces]
            for i in np.flatnonzero(p >= offending).tolist():
                t = int(text[i])
                a = int(begin[i] - base[t])
                spans[t].append({"start": a, "end": a + int(size[i]), "score": float(p[i]), "text": " ".join(pieces[t][a : a + int(size[i])])})
            yield pa.record_batch([
                batch.column("id"), pa.array(np.clip(score, 0.0, 1.0) + 0.0, pa.float64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())])))],
                ["id", "score", "sentences"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5) -> DataFrame:
    """id, score and the offending sentences (word interval, score, text) of each row."""
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model, offending),
                           f"id {kind}, score double, sentences array<struct<start:int,end:int,score:double,text:string>>")
