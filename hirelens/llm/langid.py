"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (orders 1 to 3; lower case, every character
that is no letter counts as a space, two spaces around the text) weighted by
TF-IDF: relative frequency in the text times ``log((1 + N) / (1 + df))``, with
document frequencies over *all* training documents. Weights are fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of
labelled rows: about ``per_language`` of each language and ``rows`` in all, shared by
however many languages there are, so every label that occurs is learned. Rows are
drawn by a hash of id, text and place. Languages are sampled at different rates; the
logarithm of a language's rate is added to its logit while fitting and the held-back
rows weigh by its inverse, so the model keeps the languages' odds of the whole table.

A fifth of the sample is held back to choose the temperature that divides the
logits, against labels smoothed by ``SMOOTH``: however well the held-back rows are
told apart, scores stay short of 1, and a text without evidence stays near the odds
of the languages. ``Model.cut`` is the score below which a text is held to be in no
learned language: at most half-way from an even guess to 1, and less if more than
``FALSE_REJECTS`` of the held-back rows would fall below.

The driver holds the sample's features and a table of at most ``CELLS`` weights: with
more than 256 languages, n-grams share fewer buckets. Texts are only read by tasks.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with
a null language or null text are not learned from; with nothing to learn from every
text is ``und``; repeated rows count as documents; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, text_batches
from .sparse_fit import Ftrl

DIM = 1 << 16
ORDERS = (1, 2, 3)
#: Brings relative frequencies to the scale of the learning rate.
SCALE = 100.0
PIECE = 4_000_000
#: Weights the driver holds at most (buckets times languages).
CELLS = 1 << 24
#: Share of a label's probability that calibration spreads over all languages.
SMOOTH = 0.02
#: Share of labelled rows that ``Model.cut`` may fall below.
FALSE_REJECTS = 0.002


class Grams:
    """Hashed n-grams of texts laid end to end, two spaces before each."""

    def __init__(self) -> None:
        self.letter = np.array([0 if 0xD800 <= c < 0xE000 else c if chr(c).isalpha() else 32 for c in range(1 << 16)], dtype=np.uint32)
        self.letter[0xD800:0xE000] = 32

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per order the buckets (uint16), where each text begins, and which
        texts hold a letter."""
        lower = [(t or "").lower() for t in texts]
        size = np.array([len(t) + 2 for t in lower], dtype=np.int64)
        begin = np.cumsum(size) - size
        raw = np.frombuffer(("  " + "  ".join(lower) + "    ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = np.where(raw < 1 << 16, self.letter[np.minimum(raw, 0xFFFF)], raw)
        n = int(size.sum())
        out, h = [], np.zeros(n, dtype=np.uint32)
        for order in ORDERS:
            h = h * np.uint32(0x01000193) + code[order - 1 : order - 1 + n] * np.uint32(0x9E3779B1) + np.uint32(order)
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((x >> np.uint32(16)).astype(np.uint16))
        plain = np.logical_or.reduceat((code[:n] != 32) & (code[:n] < 1 << 16), begin) if len(texts) else np.zeros(0, bool)
        letters = np.array([bool(p) or any(c.isalpha() for c in t) for p, t in zip(plain, lower)], dtype=bool)
        return out, begin, letters


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: idf * weight
    bias: np.ndarray
    temperature: float
    cut: float = 0.0


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, seen, df, n = Grams(), np.zeros(DIM, np.uint8), np.zeros(DIM, np.int64), 0
    for batch in text_batches(batches, "text", PIECE):
        buckets, begin, _ = grams(batch.column("text").to_pylist())
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(buckets[0])]):
            for row in buckets:
                seen[row[a:b]] = 1
            df += seen
            seen[:] = 0
            n += 1
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in text_batches(batches, "text", PIECE):
        buckets, begin, letters = grams(batch.column("text").to_pylist())
        found, times = [], []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(buckets[0])]):
            which, n = np.unique(np.concatenate([row[a:b] for row in buckets]), return_counts=True)
            found.append(which.astype(np.int32))
            times.append(n.astype(np.int32))
        yield pa.record_batch([batch.column("lang"), batch.column("turn"), pa.array(letters), pa.array(found, pa.list_(pa.int32())),
                               pa.array(times, pa.list_(pa.int32()))], ["lang", "turn", "letters", "bucket", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits with the least log loss against smoothed labels, by
    golden section on its log."""
    if not len(truth):
        return 1.0
    target = np.full(logits.shape, SMOOTH / logits.shape[1])
    target[np.arange(len(truth)), truth] += 1 - SMOOTH

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -float((weight * (target * log_p).sum(axis=1)).sum())

    low, high, ratio = -4.0, 3.0, (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500,
          rows: int = 24_000, epochs: int = 3, alpha: float = 0.3, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Fit a model on the rows of ``df`` that have a language and a text. The driver
    sees one row per language, the sample's features and the buckets' counts."""
    labelled = df.select(column(df, id_col).cast("string").alias("id"), column(df, text_col).alias("text"),
                         column(df, lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = labelled.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    empty = Model([], np.zeros((DIM, 0)), np.zeros(0), 1.0)
    if not languages:
        return empty
    fold = max(0, (DIM * len(languages) - 1).bit_length() - (CELLS - 1).bit_length())
    dim = DIM >> fold
    frequency = labelled.select("text").mapInArrow(_document_frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = frequency.column("bucket").to_numpy(), frequency.column("n").to_numpy()
    total, seen = int(n[bucket < 0].sum()), np.zeros(dim)
    np.add.at(seen, bucket[bucket >= 0] >> fold, n[bucket >= 0])
    idf = np.log((1 + total) / (1 + np.minimum(seen, total)))

    share = min(per_language, -(-rows // len(languages)))
    rates = {r["lang"]: min(1.0, share / r["count"]) for r in counts}
    draw = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id(), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    sample = (labelled.filter(draw < rate).select("text", "lang", F.xxhash64("id", F.lit("turn"), "text").alias("turn"))
              .mapInArrow(_features, "lang string, turn long, letters boolean, bucket array<int>, n array<int>").filter("letters").toArrow())
    place = {name: i for i, name in enumerate(languages)}
    order = np.argsort(sample.column("turn").to_numpy(), kind="stable").tolist()
    label = [place[x] for x in sample.column("lang").to_pylist()]
    which, times = sample.column("bucket").combine_chunks(), sample.column("n").combine_chunks()

    def example(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, t = which[i].values.to_numpy() >> fold, times[i].values.to_numpy().astype(np.float64)
        if fold:
            at, where = np.unique(at, return_inverse=True)
            t = np.bincount(where, weights=t)
        return at, t / t.sum() * idf[at] * SCALE

    held = order[::5] if len(order) >= 50 else []
    fit = [i for i in order if i not in set(held)]
    model, bias = Ftrl((dim, len(languages)), alpha, l1, l2), Ftrl((1, len(languages)), alpha, 0.0, 0.0)
    sampled = np.log([rates[name] for name in languages])
    for _ in range(epochs):
        for i in fit:
            at, x = example(i)
            w, b = model.weights(at), bias.weights()
            p = _softmax(x @ w + b[0] + sampled)
            p[label[i]] -= 1.0
            model.update(at, w, x[:, None] * p)
            bias.update(slice(None), b, p[None, :])
    weights, b = model.weights(), bias.weights()[0]
    logits = np.array([x @ weights[at] + b for at, x in map(example, held)]).reshape(len(held), len(languages))
    truth = np.array([label[i] for i in held], dtype=int)
    weight = np.exp(-sampled[truth])
    out = Model(languages, idf[:, None] * weights * SCALE, b, _temperature(logits, truth, weight))
    if held:
        score = _softmax(logits / out.temperature).max(axis=1)
        order = np.argsort(score, kind="stable")
        below = np.cumsum(weight[order]) <= FALSE_REJECTS * weight.sum()
        out.cut = float(min((1 + 1 / len(languages)) / 2, score[order][below.sum()]))
    return out


class Scorer:
    """Best language and its probability of each text; score 0 without a letter."""

    def __init__(self, model: Model):
        self.model, self.grams = model, Grams()
        self.fold = (DIM // max(1, len(model.table))).bit_length() - 1
        self.columns = [np.ascontiguousarray(model.table[:, k]) for k in range(len(model.languages))]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        model = self.model
        buckets, begin, letters = self.grams(texts)
        if not model.languages:
            letters[:] = False
            return np.zeros(len(letters), int), np.zeros(len(letters)), letters
        if self.fold:
            buckets = [row >> self.fold for row in buckets]
        size = np.diff(np.append(begin, len(buckets[0])))[:, None] * len(ORDERS)
        sums = np.stack([sum(np.add.reduceat(c[row], begin) for row in buckets) for c in self.columns], axis=1)
        p = _softmax((sums / size + model.bias) / model.temperature)
        return p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0), letters


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scorer(model)
        for batch in text_batches(batches, "text", PIECE):
            best, score, letters = scored(batch.column("text").to_pylist())
            lang = [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
            yield pa.record_batch([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                  ["id", "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: Model, id_col: Column | str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred (a learned language, or ``und``) and score (its calibrated
    probability) of each row of ``df``."""
    key = (column(df, id_col) if isinstance(id_col, str) else id_col).alias("id")
    rows = df.select(key, column(df, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(model), f"id {kind}, lang_pred string, score double")


def keep(df: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text has a letter and a score
    of at least ``least`` (the model's cut). One pass over the rows, no shuffle."""
    least, at = model.cut if least is None else least, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scorer(model)
        for batch in text_batches(batches, f"c{at}", PIECE):
            _, score, letters = scored(batch.column(at).to_pylist())
            yield batch.filter(pa.array(letters & (score >= least)))

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
