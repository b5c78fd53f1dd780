"""Removal of word passages that occur more than once in a corpus.

A window is ``window`` consecutive words of one document; every word covered by a
window that also starts anywhere else goes. Rabin-Karp hashes of all windows are
taken in one vectorised pass over each batch of texts. To count them without
sending one row per word through a shuffle, each window belongs to its anchor, the
smallest hash of the ``window - gram + 1`` grams inside it: equal windows have
equal anchors, and neighbouring windows share theirs, so there is one anchor for
about ten words.

1. anchors are counted; an anchor that occurs once holds only windows that
   occur once (this proves their count, none is left out unchecked);
2. for the other anchors, the hashes of all their windows are counted by
   (anchor, window hash) in Spark, dealt by the window hash where an anchor is
   frequent; runs of repeated windows come back as one bit mask for each anchor;
3. each document's masks are merged into maximal intervals, which are cut.

Before either shuffle a batch settles what repeats inside itself: such places are
marked at once and one row speaks for all of them, so a passage that a third of all
documents share sends one row per batch, not one per document. No group is collected
but a document's own places.

``df`` must be a stored table (or a deterministic read): rows are numbered by place.

Defined cases: a null text has no words; texts shorter than a window lose nothing;
repeated rows are different documents, so their windows repeat; null ids pass
through; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, text_batches
from .words import Rolling, WordHashes, mixed, sliding

#: Bytes of text that are settled together before a shuffle.
PIECE = 5_000_000


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]


def _spread(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key of its own for rows that need no counting."""
    return mixed(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)).view(np.int64)


class _Scan:
    """Grams, windows and anchors of a batch of texts laid end to end."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.span = window, gram, window - gram + 1
        self.hashed, self.rolling = WordHashes(), Rolling()

    def __call__(self, texts: pa.Array) -> bool:
        row, counts = self.hashed(texts)
        if len(row) < self.window:
            return False
        self.grams, self.hashes = self.rolling.windows(row, self.gram, self.window)
        self.starts = np.cumsum(counts) - counts
        self.text = np.repeat(np.arange(len(counts)), counts)
        ends = (self.starts + counts)[self.text]
        n = len(self.hashes)
        self.inside = np.arange(n) + self.window <= ends[:n]
        return bool(self.inside.any())

    def anchors(self) -> np.ndarray:
        """Places of all grams that are the smallest of some window."""
        least = np.where(self.inside, sliding(np.minimum, self.grams, self.span), np.uint64(0))
        pad = np.zeros(self.span - 1, np.uint64)
        most = sliding(np.maximum, np.concatenate([pad, least, pad]), self.span)
        return np.flatnonzero((self.grams == most) & (most > 0))


def anchor_rows(window: int, gram: int):
    """Batches of (row, text) -> (key, row, place, known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(window, gram)
        for batch in text_batches(batches, "text", PIECE):
            if not scan(batch.column("text")):
                continue
            at = scan.anchors()
            key = scan.grams[at].view(np.int64)
            text = scan.text[at]
            row, place = batch.column("row").to_numpy()[text], at - scan.starts[text]
            _, first, where, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            known = (times > 1)[where]
            voice = first[times > 1]
            keys = np.concatenate([np.where(known, _spread(row, place), key), key[voice]])
            speaks = np.zeros(len(keys), dtype=bool)
            speaks[len(key):] = True
            yield pa.record_batch([
                pa.array(keys), pa.array(np.concatenate([row, row[voice]]), pa.int64(), mask=speaks),
                pa.array(np.concatenate([place, place[voice]]).astype(np.int32)), pa.array(np.concatenate([known, np.zeros(len(voice), bool)]))],
                ["key", "row", "place", "known"])

    return run


def window_rows(window: int, gram: int, hot_rows: int = 16):
    """Batches of (row, text, places) -> (kind, key, anchor, row, start, hashes, mask, hot).

    KNOWN rows are runs of windows that repeat inside the batch, as a bit mask.
    ANCHOR rows carry the other windows of one anchor (null where known) and meet
    by anchor. An anchor met ``hot_rows`` times in the batch sends a row for each
    WINDOW instead, which meet by window, and flags itself as hot. Either way
    windows are told apart by the hashes of their anchor and of all their words,
    128 bits together.
    """

    def record(kind: int, key, anchor, row, start, offsets, values, mask, hot: bool) -> pa.RecordBatch:
        n = len(key)
        return pa.record_batch([
            pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(anchor, pa.int64()) if anchor is not None else pa.nulls(n, pa.int64()), row if isinstance(row, pa.Array) else pa.array(row),
            pa.array(np.asarray(start, np.int32)), pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), values),
            pa.array(np.asarray(mask, np.int64)), pa.array(np.full(n, hot))],
            ["kind", "key", "anchor", "row", "start", "hashes", "mask", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(window, gram)
        for batch in text_batches(batches, "text", PIECE):
            if not scan(batch.column("text")):
                continue
            n = len(scan.hashes)
            listed = np.zeros(len(scan.grams), dtype=bool)
            places = batch.column("places")
            sizes = pa.compute.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False)
            listed[np.repeat(scan.starts, sizes) + places.flatten().to_numpy(zero_copy_only=False)] = True
            # The window's anchor: its leftmost smallest gram.
            view = np.lib.stride_tricks.sliding_window_view(scan.grams, scan.span)[:n]
            near = sliding(np.maximum, np.concatenate([listed, np.zeros(scan.span - 1, bool)]), scan.span)[:n] & scan.inside
            at = np.flatnonzero(near)
            anchor = at + view[at].argmin(axis=1)
            ok = listed[anchor]
            at, anchor = at[ok], anchor[ok]
            if not len(at):
                continue
            hashes = scan.hashes[at].view(np.int64)
            _, first, where, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            known = (times > 1)[where]
            # Windows of one anchor are neighbours: a run each.
            begin = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
            size = np.diff(np.append(begin, len(at)))
            text = scan.text[anchor[begin]]
            row, start = batch.column("row").to_numpy()[text], at[begin] - scan.starts[text]
            offset = np.arange(len(at)) - np.repeat(begin, size)
            mask = np.add.reduceat(np.where(known, np.int64(1) << offset, 0), begin)
            grams = scan.grams[anchor[begin]].view(np.int64)
            _, gram_at, gram_of, gram_times = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
            hot = (gram_times >= hot_rows)[gram_of]
            open_ = np.add.reduceat((~known).astype(np.int64), begin) > 0
            none = pa.array([], pa.int64())

            i = np.flatnonzero(mask)
            yield record(0, _spread(row[i], start[i]), None, row[i], start[i], np.zeros(len(i) + 1), none, mask[i], False)
            i = open_ & ~hot
            keep = np.repeat(i, size)
            yield record(1, grams[i], None, row[i], start[i], np.concatenate([[0], np.cumsum(size[i])]),
                         pa.array(hashes[keep], mask=known[keep]), np.zeros(int(i.sum())), False)
            i = np.repeat(hot, size) & ~known
            yield record(2, hashes[i], np.repeat(grams, size)[i], np.repeat(row, size)[i], (np.repeat(start, size) + offset)[i],
                         np.arange(int(i.sum()) + 1), pa.array(hashes[i]), np.zeros(int(i.sum())), False)
            # One row speaks for each repeated window and for each hot anchor.
            voice = first[times > 1]
            run_of = np.searchsorted(begin, voice, "right") - 1
            for kind, some in ((1, ~hot[run_of]), (2, hot[run_of])):
                v = voice[some]
                own = grams[run_of[some]]
                yield record(kind, own if kind == 1 else hashes[v], None if kind == 1 else own, pa.nulls(len(v), pa.int64()), np.zeros(len(v)),
                             np.arange(len(v) + 1), pa.array(hashes[v]), np.zeros(len(v)), False)
            flags = grams[gram_at[gram_times >= hot_rows]]
            yield record(1, flags, None, pa.nulls(len(flags), pa.int64()), np.zeros(len(flags)), np.arange(len(flags) + 1),
                         pa.array(np.zeros(len(flags), np.int64)), np.zeros(len(flags)), True)

    return run


def cutter(window: int):
    """Batches of (id, text, marks) -> (id, n_words, n_removed, kept, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", PIECE):
            total, removed, kept, spans = [], [], [], []
            for words, marks in zip(_words(batch), batch.column("marks").to_pylist()):
                total.append(len(words))
                if not marks:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    spans.append([])
                    continue
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.array([m["start"] for m in marks], dtype=np.int64)
                bits = np.array([m["mask"] for m in marks], dtype=np.int64)
                a, b = np.nonzero((bits[:, None] >> np.arange(window)) & 1)
                np.add.at(edge, starts[a] + b, 1)
                np.add.at(edge, starts[a] + b + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                cuts = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans.append([{"start": s, "end": e} for s, e in zip(cuts[::2].tolist(), cuts[1::2].tolist())])
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]))
            yield pa.record_batch([
                batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["id", "n_words", "n_removed", "kept", "spans"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by a space) and
    spans (removed word intervals, end exclusive). ``window`` is 8 to 60 words."""
    if not 8 <= window <= 60:
        raise ValueError("window must be 8 to 60 words")
    gram = window // 2 - 1
    base = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text"),
                     F.monotonically_increasing_id().alias("row"))
    kind = base.schema["id"].dataType.simpleString()
    anchors = base.select("row", "text").mapInArrow(anchor_rows(window, gram), "key long, row long, place int, known boolean")
    seen = F.count("*").over(Window.partitionBy("key"))
    places = (anchors.withColumn("n", seen).filter(F.col("row").isNotNull() & (F.col("known") | (F.col("n") > 1)))
              .groupBy("row").agg(F.collect_list("place").alias("places")))
    # The id goes along unread, so that this join and the last deal the texts alike, once.
    found = (base.join(places, "row").select("id", "row", "text", "places")
             .mapInArrow(window_rows(window, gram), "kind int, key long, anchor long, row long, start int, hashes array<long>, mask long, hot boolean")
             .repartition("key"))
    each = (found.filter("kind > 0").select("kind", "key", F.coalesce("anchor", "key").alias("anchor"), "row", "start", "hot", F.posexplode("hashes").alias("offset", "hash"))
            .filter("hash is not null")
            .withColumn("hot", F.max("hot").over(Window.partitionBy("key")) | (F.col("kind") == 2)))
    by_anchor = each.filter("not hot").withColumn("n", F.count("*").over(Window.partitionBy("key", "hash")))
    by_window = each.filter("hot").withColumn("n", F.count("*").over(Window.partitionBy("hash", "anchor")))
    bit = F.expr("shiftleft(1L, offset)").alias("mask")
    repeated = "n > 1 and row is not null"
    by_anchor = by_anchor.filter(repeated).groupBy("key", "row", "start").agg(F.bit_or(bit).alias("mask"))
    by_window = by_window.filter(repeated).select("row", "start", bit)
    marks = (found.filter("kind = 0").select("row", "start", "mask").unionByName(by_anchor.drop("key"))
             .unionByName(by_window)
             .groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("marks")))
    return base.join(marks, "row", "left").select("id", "text", "marks").mapInArrow(
        cutter(window), f"id {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:int,end:int>>")
