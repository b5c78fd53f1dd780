"""Ranked lexical search by scanning texts: a boundary-guarded Aho-Corasick
automaton of all items' terms counts term frequencies straight from the text; no
index of the documents is built, and the automaton's outputs map to items.

Terms are the maximal runs of ASCII letters and digits and of everything beyond
ASCII, with only A-Z lower-cased. As every separator is one ASCII byte, a text's
UTF-8 bytes need one table look-up to become terms between blanks; the automaton
holds each term between two blanks, so it finds whole terms only.

Weights: w = floor(1000 ln((2N + 2) / (2 df + 1))), N documents with a term, df
those that hold the term. A document of n terms among L in all has
m = 100 - 50 + (50 n N) div L and scores, summed over the distinct terms of the item,
w * ((10^9 tf) div (1000 tf + 20 m)).

Items are dealt into blocks of bounded size, each with an automaton of its own, so
what is broadcast never grows beyond ``BLOCK`` (item, term) pairs (an item that is
larger alone is a block of its own). Each block reads the documents once: the scan
writes (document, its hits), the statistics are sums over that table, and the scoring
keeps the best documents of each item in every task, so a task emits at most ``best``
rows per item.

Defined cases: a null or empty text, and a text of separators, holds no term: it is
no document of N and has no rank. An item without terms, or whose terms occur
nowhere, has no rows. Repeated terms of an item count once. Rows that share an
id are documents of their own, likewise items; equal scores go by id, null ids last.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, save, text_batches

#: (item, term) pairs of one block: bounds the automaton and the lists that are broadcast.
BLOCK = 1_000_000
#: Bytes of text scanned at once.
PIECE = 2_000_000
#: Cells of the documents x items table that a task holds.
CELLS = 4_000_000
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """row (a number), id and the distinct terms of each item that has any."""
    text = F.translate(column(items, text_col), _ASCII_UPPER, _ASCII_LOWER)
    found = items.select(F.monotonically_increasing_id().alias("row"), column(items, id_col).alias("id"),
                         F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), 1)).alias("terms"))
    return save(found.filter(F.size("terms") > 0), "items")


def _blocks(items: DataFrame, bound: int) -> list[DataFrame]:
    """The items in blocks of at most ``bound`` terms, or of one item."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, math.ceil(total / bound))
    while True:
        place = F.pmod(F.xxhash64("row"), F.lit(n))
        over = (items.groupBy(place.alias("block")).agg(F.sum(F.size("terms")).alias("size"), F.count(F.lit(1)).alias("items"))
                .filter((F.col("size") > bound) & (F.col("items") > 1)).limit(1).count())
        if not over:
            return [items.filter(place == i) for i in range(n)] if total else []
        n *= 2


def _scanner(terms: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            automaton.add_word(f" {term.decode('latin-1')} ", i)
        automaton.make_automaton()
        for batch in text_batches(batches, "text", PIECE):
            texts = [x or b"" for x in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            ends = np.cumsum(np.array([len(x) + 1 for x in texts], dtype=np.int64))
            raw = b" ".join([b"", *texts, b""]).translate(_TABLE)
            solid = np.frombuffer(raw, dtype=np.uint8) != 32
            first = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
            n = np.diff(np.searchsorted(first, ends, "right"), prepend=0)
            hits = np.fromiter(chain.from_iterable(automaton.iter(raw.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
            # a hit ends with the blank behind the term, which belongs to the same text
            key, tf = np.unique(np.searchsorted(ends, hits[:, 0] - 1) * len(terms) + hits[:, 1], return_counts=True)
            where = np.searchsorted(key, np.arange(len(texts) + 1) * len(terms)).astype(np.int32)
            out = pa.record_batch([batch.column("id"), pa.array(n), pa.ListArray.from_arrays(where, pa.array((key % len(terms)).astype(np.int32))),
                                   pa.ListArray.from_arrays(where, pa.array(tf.astype(np.int32)))], ["id", "n", "term", "tf"])
            yield out.filter(pc.greater(out.column("n"), 0))

    return run


def _counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents holding each term; at -1 the documents, at -2 their terms."""
        df, documents, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("term").flatten().to_numpy(), minlength=size)
            documents += batch.num_rows
            length += int(batch.column("n").to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[documents, length], df[at]]))], ["term", "n"])

    return run


def _ranker(weight: np.ndarray, starts: np.ndarray, members: np.ndarray, rows: np.ndarray, documents: int, length: int, best: int):
    """Keep the ``best`` documents of each item; term t belongs to the items
    ``members[starts[t]:starts[t + 1]]``, numbered as in ``rows``."""
    held = len(rows)
    most = int(np.bincount(members, minlength=1).max()) if len(members) else 0
    doubles = most * int(weight.max(initial=0)) * 10**6 < 2**53  # then sums of doubles are exact

    def least(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, [("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
        item = found.column("item").to_numpy()
        first = np.searchsorted(item, np.arange(held))
        return found.filter(pa.array(np.arange(len(item)) - first[item] < best))

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        docs = batch.num_rows
        term, tf = batch.column("term").flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
        per = pc.list_value_length(batch.column("term")).to_numpy()
        m = 100 - 50 + (50 * batch.column("n").to_numpy() * documents) // length
        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, per)))
        doc = np.repeat(np.arange(docs), per)
        out = np.zeros(held * docs, np.float64 if doubles else np.int64)
        times = starts[term + 1] - starts[term]
        cut = np.searchsorted(np.cumsum(times), np.arange(CELLS, int(times.sum()) + CELLS, CELLS), "right")
        for a, b in zip([0, *cut[:-1].tolist()], cut.tolist()):
            k = times[a:b]
            at = np.repeat(starts[term[a:b]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
            cell, add = members[at] * docs + np.repeat(doc[a:b], k), np.repeat(value[a:b], k)
            if doubles:
                out += np.bincount(cell, weights=add, minlength=len(out))
            else:
                np.add.at(out, cell, add)
        return out.reshape(held, docs).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, kept, waiting = np.zeros(held, np.int64), None, []
        step = max(1, CELLS // held)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                grid = scores(batch)
                bar = floor
                if batch.num_rows > best:
                    bar = np.maximum(bar, np.partition(grid, batch.num_rows - best, axis=1)[:, batch.num_rows - best])
                item, doc = np.nonzero((grid >= bar[:, None]) & (grid > 0))
                waiting.append(pa.table([pa.array(item), pa.array(grid[item, doc]), batch.column("id").take(pa.array(doc))], ["item", "score", "id"]))
                if sum(w.num_rows for w in waiting) > 4 * best * held:
                    kept = least(pa.concat_tables([*([kept] if kept is not None else []), *waiting]))
                    waiting = []
                    item, score = kept.column("item").to_numpy(), kept.column("score").to_numpy()
                    last = np.searchsorted(item, np.arange(held), "right")
                    full = last - np.searchsorted(item, np.arange(held)) == best
                    floor[full] = score[last[full] - 1]
        if kept is not None or waiting:
            kept = least(pa.concat_tables([*([kept] if kept is not None else []), *waiting])).combine_chunks()
            out = pa.table([pa.array(rows).take(kept.column("item")), kept.column("score"), kept.column("id")], ["row", "score", "id"])
            yield from out.to_batches()

    return run


def search(docs: DataFrame, items: DataFrame, best: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``best`` documents of each
    item with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    wanted = item_terms(items, item_id, item_text)
    out = None
    for part in _blocks(wanted, block):
        pairs = part.select("row", F.explode("terms").alias("term")).toArrow()
        if not pairs.num_rows:
            continue
        found = pc.dictionary_encode(pairs.column("term").combine_chunks())
        terms = [t.encode() for t in found.dictionary.to_pylist()]
        rows, member = np.unique(pairs.column("row").to_numpy(), return_inverse=True)
        term = found.indices.to_numpy()
        order = np.lexsort((member, term))
        starts = np.searchsorted(term[order], np.arange(len(terms) + 1))

        hits = save(texts.mapInArrow(_scanner(terms), f"id {kind}, n long, term array<int>, tf array<int>"), "hits")
        totals = hits.select("n", "term").mapInArrow(_counts(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        seen = dict(zip(totals.column("term").to_pylist(), totals.column("n").to_pylist()))
        documents, length = seen.get(-1, 0), seen.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * seen.get(i, 0) + 1))) for i in range(len(terms))], dtype=np.int64)
        rank = _ranker(weight, starts, member[order].astype(np.int64), rows, documents, max(length, 1), best)
        near = hits.mapInArrow(rank, f"row long, score long, id {kind}")
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = spark.createDataFrame([], f"row long, score long, id {kind}")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = out.withColumn("rank", place).filter(F.col("rank") <= best)
    names = wanted.select("row", F.col("id").alias("item_id"))
    return ranked.join(names, "row").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
