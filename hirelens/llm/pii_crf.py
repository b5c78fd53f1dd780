"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone), which always stay. They miss
mentions that only the rest of the document gives away: the number of a phone
written again without its prefix, a card number with other separators, the local part
of an address. The field has a node for each token with a digit or ``@`` (and for words
equal to the local part of a base address: 6 characters, or 8 if all are letters), labelled O or a kind. Its potentials:

* node: hashed features of shape, length, checks passed and neighbouring words;
* chain: nodes that stand side by side;
* skip: nodes with the same normalised text or the same last seven digits (of the whole
  number where it is written in blanks), however
  far apart; each is tied to the nearest ones alike and to the nearest ones alike
  in a base span, before and after it, so edges grow with the tokens.

Nodes in base spans are evidence. Loopy belief propagation (damped, all messages at
once) carries their labels along the edges; other nodes whose marginal for a kind
reaches ``threshold`` become added spans, neighbours of one kind being one span.

All weights are learned from the corpus by pseudo-likelihood with the patterns as
teacher, on at most about ``sample`` documents that hold a digit or ``@``. For half of
the tokens the node features are hidden, so the edges learn to speak for them; the
edge weights are pulled towards weak agreement, which stands where a corpus
has no repeated mention to learn from.

Defined cases: a null or empty text has no spans; very long tokens and texts are
searched whole in linear time; repeated rows and null ids pass through; without
any token to learn from, no span is added; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
DIM = 1 << 14
#: Features of one node.
WIDTH = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TELLING = re.compile(r"[0-9@]")
_EDGE = "\"'`.,;:!?()[]{}<>|*&%$#=~"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every pattern match, in order; code points."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


@dataclass
class Graph:
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray  # nodes x WIDTH
    label: np.ndarray  # of the base span that covers the node, or 0
    edges: np.ndarray  # edges x 2
    skip: np.ndarray  # whether an edge is a skip edge


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (DIM - 1)


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token)))


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph | None:
    """The field of one document; None where there is no node."""
    locals_ = {text[a:b].partition("@")[0].lower() for a, k, b in spans if k == 0}
    locals_ = {x for x in locals_ if len(x) >= (8 if x.isalpha() else 6)}
    words = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    nodes, features, keys, numbers = [], [], [], []
    for i, (at, word) in enumerate(words):
        core = word.lstrip(_EDGE)
        a = at + len(word) - len(core)
        core = core.rstrip(_EDGE)
        if not core or not (_TELLING.search(core) or core.lower() in locals_):
            continue
        digits = _NOT_DIGIT.sub("", core)
        alnum = "".join(c for c in core.lower() if c.isalnum())
        parts = core.split(".")
        checks = "".join("01"[x] for x in (14 <= len(digits) <= 19 and luhn(digits), len(parts) == 4 and all(p.isdigit() and p.isascii() and _octet(p) for p in parts),
                                           bool("@" in core and _DOMAIN.fullmatch(core.rpartition("@")[2]))))
        nodes.append((i, a, a + len(core)))
        features.append([_bucket(x) for x in (
            "bias", "shape " + _shape(core), f"digits {min(len(digits), 24)}", f"checks {checks}", f"letters {min(len(alnum) - len(digits), 12)}",
            "before " + (words[i - 1][1].lower() if i else ""), "after " + (words[i + 1][1].lower() if i + 1 < len(words) else ""),
            f"plus {word.startswith('+')} {'@' in core} {core.count('.')}")])
        key = [("same", alnum)] if len(alnum) >= 6 else []
        if len(digits) >= 7 and len(digits) * 2 > len(alnum):
            key.append(("digits", digits[-7:]))
        if "@" in core:
            key.append(("local", core.partition("@")[0].lower()))
        elif core.lower() in locals_:
            key.append(("local", core.lower()))
        keys.append(key)
        numbers.append(digits if len(digits) == len(alnum) else "")
    if not nodes:
        return None
    start, end = (np.array([x[j] for x in nodes]) for j in (1, 2))
    label = np.zeros(len(nodes), dtype=np.int64)
    for a, kind, b in reversed(spans):
        label[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = kind + 1
    # A number written in blanks: all its nodes have the key of the joined digits.
    tails: dict[str, list[str]] = {}
    for a, kind, b in spans:
        whole = _NOT_DIGIT.sub("", text[a:b])
        if kind >= 2:
            tails.setdefault(whole[-7:], []).append(whole)
            for n in range(np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")):
                keys[n].append(("digits", whole[-7:]))
    tails = {tail: [*dict.fromkeys(known)] for tail, known in tails.items()}
    for n in range(len(nodes) if tails else 0):
        joined, first = numbers[n], n
        while first and numbers[first] and not label[first] and nodes[first - 1][0] == nodes[first][0] - 1 and numbers[first - 1] and not label[first - 1]:
            first -= 1
            joined = numbers[first] + joined
            if len(joined) > 20:
                break
            bare = joined.lstrip("0")
            if len(bare) >= 7 and any(known.endswith(bare) for known in tails.get(bare[-7:], ())):
                for m in range(first, n + 1):
                    keys[m].append(("digits", bare[-7:]))
    keys = [[*dict.fromkeys(key)] for key in keys]
    edges: dict[tuple[int, int], bool] = {}
    for n in range(1, len(nodes)):
        if nodes[n - 1][0] == nodes[n][0] - 1:
            edges[n - 1, n] = False
    for order in (range(len(nodes)), range(len(nodes) - 1, -1, -1)):
        last: dict[tuple[str, str], int] = {}
        sure: dict[tuple[str, str], int] = {}
        for n in order:
            for key in keys[n]:
                for other in (last.get(key), sure.get(key)):
                    if other is not None:
                        edges[min(n, other), max(n, other)] = True
                last[key] = n
                if label[n]:
                    sure[key] = n
    return Graph(start, end, np.array(features), label, np.array([*edges], dtype=np.int64).reshape(-1, 2), np.array([*edges.values()], dtype=bool))


@dataclass
class Model:
    node: np.ndarray  # DIM x LABELS
    chain: np.ndarray  # LABELS x LABELS, symmetric
    skip: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = lambda rows: pa.array(rows, pa.list_(pa.int32()))
    for batch in text_batches(batches, "text"):
        found = [(t, graph(x, base_spans(x))) for t, x in zip(batch.column("turn").to_pylist(), batch.column("text").to_pylist())]
        found = [(t, g) for t, g in found if g]
        yield pa.record_batch([pa.array([t for t, _ in found], pa.int64()), lists([g.features.ravel().tolist() for _, g in found]),
                               lists([g.label.tolist() for _, g in found]), lists([g.edges.ravel().tolist() for _, g in found]),
                               lists([g.skip.astype(int).tolist() for _, g in found])], ["turn", "features", "label", "edges", "skip"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, epochs: int = 4,
          rate: float = 0.3, l2: float = 1e-4, prior: float = 3.0, pull: float = 0.01) -> Model:
    """Fit node, chain and skip potentials on a bounded sample of ``df``."""
    rows = df.select(column(df, id_col).cast("string").alias("id"), column(df, text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    agree = prior * (np.eye(LABELS) - 1.0 / LABELS)
    model = Model(np.zeros((DIM, LABELS)), 0.2 * agree, agree.copy())
    if not n:
        return model
    draw = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id(), F.lit("pii")), F.lit(1 << 20)) / float(1 << 20)
    found = (rows.filter(draw < min(1.0, sample / n)).select("text", F.xxhash64("id", F.lit("turn"), "text").alias("turn"))
             .mapInArrow(_graphs, "turn long, features array<int>, label array<int>, edges array<int>, skip array<int>").toArrow())
    order = np.argsort(found.column("turn").to_numpy(), kind="stable").tolist()
    cols = {c: found.column(c).combine_chunks() for c in ("features", "label", "edges", "skip")}
    square = np.full((DIM, LABELS), 1e-2)
    hide = np.random.default_rng(7)
    chain0, skip0 = model.chain.copy(), model.skip.copy()
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in order:
            features = cols["features"][i].values.to_numpy().reshape(-1, WIDTH)
            label = cols["label"][i].values.to_numpy()
            edges = cols["edges"][i].values.to_numpy().reshape(-1, 2)
            skip = cols["skip"][i].values.to_numpy().astype(bool)
            seen = hide.random(len(label)) < 0.5
            z = model.node[features].sum(axis=1) * seen[:, None]
            both = np.concatenate([edges, edges[:, ::-1]])
            kind = np.concatenate([skip, skip])
            np.add.at(z, both[:, 1], np.where(kind[:, None], model.skip[label[both[:, 0]]], model.chain[label[both[:, 0]]]))
            g = _softmax(z)
            g[np.arange(len(label)), label] -= 1.0
            own = g * seen[:, None]
            at, where = np.unique(features, return_inverse=True)
            sums = np.zeros((len(at), LABELS))
            np.add.at(sums, where.ravel(), np.repeat(own, WIDTH, axis=0))
            sums += l2 * model.node[at]
            square[at] += sums * sums
            model.node[at] -= step * sums / np.sqrt(square[at])
            for weights, some, towards in ((model.skip, kind, skip0), (model.chain, ~kind, chain0)):
                if some.any():
                    d = np.zeros((LABELS, LABELS))
                    np.add.at(d, label[both[some, 0]], g[both[some, 1]])
                    weights -= 0.1 * step * np.clip((d + d.T) / 2, -1, 1) + pull * step * (weights - towards)
    return model


def marginals(g: Graph, model: Model, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of each node by loopy belief propagation."""
    unary = model.node[g.features].sum(axis=1)
    unary -= np.logaddexp.reduce(unary, axis=1, keepdims=True)
    known = g.label > 0
    unary[known] = -30.0
    unary[known, g.label[known]] = 0.0
    if not len(g.edges):
        return _softmax(unary)
    m = len(g.edges)
    source, target = np.concatenate([g.edges[:, 0], g.edges[:, 1]]), np.concatenate([g.edges[:, 1], g.edges[:, 0]])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    pair = np.where(np.concatenate([g.skip, g.skip])[:, None, None], model.skip, model.chain)
    message = np.zeros((2 * m, LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + pair, axis=1)
        out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
        message = damping * message + (1 - damping) * out
    belief = unary.copy()
    np.add.at(belief, target, message)
    return _softmax(belief)


def added_spans(text: str, spans: list[tuple[int, int, int]], model: Model, threshold: float) -> list[tuple[int, int, int]]:
    """Mentions that the field adds to the base spans of one text."""
    g = graph(text, spans) if spans else None
    if g is None or not g.skip.any() or not (g.label == 0).any():
        return []
    p = marginals(g, model)
    best = p.argmax(axis=1)
    tied = np.zeros(len(best), dtype=bool)  # only what a repeated mention speaks for
    tied[g.edges[g.skip].ravel()] = True
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero((g.label == 0) & tied & (best > 0) & (p.max(axis=1) >= threshold)).tolist():
        a, k, b = int(g.start[i]), int(best[i]) - 1, int(g.end[i])
        if out and out[-1][1] == k and not text[out[-1][2] : a].strip(" ") and a - out[-1][2] <= 1:
            out[-1] = (out[-1][0], k, b)
        else:
            out.append((a, k, b))
    return out


def _finder(model: Model, threshold: float):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, model, threshold) if base else []
                every = sorted([(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in more])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own, "text": text[a:b]} for a, k, b, own in every])
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.list_(span))], ["id", "spans"])

    return run


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """id and spans (kind, start, end, base, text; by start, then kind) of each row."""
    text = column(df, text_col)
    # Texts without a digit or an @ have no span; they need not travel to Python.
    rows = df.select(column(df, id_col).alias("id"), F.when(text.rlike("[0-9@]"), text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_finder(model, threshold), f"id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean,text:string>>")
