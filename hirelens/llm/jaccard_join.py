"""Exact Jaccard self-join on word shingles by a size-aware heavy-light join.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two sets link
when 100 * intersection >= 75 * union. Sets up to a boundary are light: every
2-subset of their prefix is a list key, as two linked light sets share their first
two common shingles. Larger sets are heavy: they scan inverted lists of single
shingles, in which light sets near the boundary are indexed too. The boundary
is the one of least cost under the size histogram of all sets: a light set costs
its subsets, a heavy one its postings times ``scan_cost``.

Prefixes follow one global order, frequent shingles last. Frequency comes from a
table of 2^20 counters (1 MB, whatever the corpus) that every batch of documents
adds its repeated shingles to. The order only decides how long lists get; any order
gives the same links.

Near copies would give all pairs of a list. Instead
1. equal sets are one class (sid, from a 128-bit hash of the set); batches send a
   class once;
2. in each list the member found in most lists for its size is the pivot; each class
   is checked against the pivot it shares most lists with, then (in lists that still
   hold several components) against its best neighbour by size. Pairs that a parity
   bit map of the sets rules out are skipped (set bits of the exclusive or are
   shingles not shared); the real sets decide, and links are merged to components;
3. whatever list still holds classes of different components contributes the pairs
   between these, and every one of them is settled by the bit maps or the sets. Lists
   of one pivot hold much the same classes, so they are settled together, and a pair
   that many lists hold is looked at once. Lists of up to ``LONG`` members are dealt
   whole, about 10,000 rows to a group; the classes of a pivot's longer lists are cut
   into blocks, and every two blocks are a group. So no group grows with a list,
   though a list of unlinked classes still costs its pairs, spread over tasks.
So no link that could join two components is left unsettled, and a group of
thousands of near copies costs pairs in proportion to its members.

Texts travel to the check as (left, right) pairs dealt by the left class, whose hot
members are salted. ``df`` must be a stored table (or deterministic read): rows are
numbered by place.

Defined cases: null texts and texts without words have the empty set, link with
nothing and are a class of their own row; a text of fewer words is one shingle; rows
that repeat an id count as documents; a null id never is a component's id unless all
of its ids are null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_names, release, save, text_batches
from .components import components
from .words import Rolling, WordHashes, mixed

PIECE = 5_000_000
BUCKETS = 20
#: Sizes above this are heavy at any cost.
LIGHT_MAX = 256
#: Longer lists are settled by blocks of about ``BLOCK`` classes, two at a time.
LONG = 1000
BLOCK = 1000
#: Numbers of pairs collected before repeated ones are dropped.
HELD = 4_000_000


class Sets:
    """Sorted shingle hashes of texts."""

    def __init__(self, words: int = 5):
        self.k, self.hashed, self.rolling = words, WordHashes(lower=True), Rolling()

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        row, counts = self.hashed(texts)
        grams = self.rolling.windows(row, self.k)[0]
        out, at = [], 0
        for n in counts.tolist():
            if n >= self.k:
                out.append(np.unique(grams[at : at + n - self.k + 1]))
            elif n:
                out.append(self.rolling.windows(row[at : at + n], n)[0] ^ np.uint64(n))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def sid(s: np.ndarray) -> tuple[int, int]:
    """The two halves of the set's 128-bit hash; the first names its class."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
    return tuple(int(np.uint64(x).view(np.int64)) for x in (whole & 0xFFFFFFFFFFFFFFFF, whole >> 64))


def _apart(signed: DataFrame) -> DataFrame:
    """``signed`` with classes whose sets agree in the first half of the hash only
    renamed by both halves, so that different sets never are one class."""
    clash = (signed.filter("sid is not null").groupBy("sid").agg(F.min("check").alias("x"), F.max("check").alias("y"))
             .filter("x <> y").select("sid", F.lit(True).alias("clash")))
    if not clash.limit(1).count():
        return signed
    own = F.when(F.col("clash"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))
    out = save(signed.join(clash, "sid", "left").withColumn("sid", own).select(*signed.columns), "signatures")
    release(signed)
    return out


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def probe_overlap(n: int) -> int:
    """Least intersection of a set of ``n`` with any linked set."""
    return _ceil(3 * n, 4)


def index_overlap(n: int) -> int:
    """Least intersection with a linked set that is no smaller."""
    return _ceil(6 * n, 7)


def subsets(n: int) -> int:
    p = n - probe_overlap(n) + 2
    return p * (p - 1) // 2


def parity(s: np.ndarray) -> bytes:
    """Bit map of the set, at least four bits an element: each bit is the parity
    of the elements that fall on it. Half of it, folded, is that of half the length."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _may_link(bits: list[bytes], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of sets the bit maps do not rule out."""
    width = np.array([len(b) for b in bits])
    tables, place = {}, np.zeros(len(bits), dtype=np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        place[own] = np.arange(len(own))
        tables[w] = np.frombuffer(b"".join([bits[k] for k in own.tolist()]), dtype=np.uint8).reshape(len(own), w)
    out = np.zeros(len(i), dtype=bool)
    for w in tables:
        for v in tables:
            some = np.flatnonzero((width[i] == w) & (width[j] == v))
            for part in (some[k : k + 4096] for k in range(0, len(some), 4096)):
                x, y = tables[w][place[i[part]]], tables[v][place[j[part]]]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                total = size[i[part]] + size[j[part]]
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                out[part] = 7 * ((total - apart) // 2) >= 3 * total
    return out


def boundary(sizes: dict[int, int], scan_cost: float) -> int:
    """Largest light size at the least cost. ``sizes``: sets by size up to LIGHT_MAX."""
    def cost(x: int) -> float:
        light = sum(c * subsets(n) for n, c in sizes.items() if n <= x)
        near = sum(c * (n - index_overlap(n) + 1) for n, c in sizes.items() if 3 * x < 4 * n and n <= x)
        heavy = sum(c * (n - probe_overlap(n) + 1) for n, c in sizes.items() if n > x)
        return light + (near + heavy) * scan_cost

    return min(range(2, LIGHT_MAX + 1), key=cost)


def _heat(words: int):
    """(row, text) -> (kind, key, n): counters of repeated shingles, sizes of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in text_batches(batches, "text", PIECE):
            own = {sid(s): s for s in sets.of(batch.column("text")) if len(s)}
            if not own:
                continue
            shingle, times = np.unique(np.concatenate([*own.values()]), return_counts=True)
            bucket = (shingle[times > 2] >> np.uint64(64 - BUCKETS)).astype(np.int64)
            heat = np.bincount(bucket, weights=times[times > 2], minlength=1).astype(np.int64)
            sizes = np.bincount([len(s) for s in own.values() if len(s) <= LIGHT_MAX], minlength=1)
            for kind, row in ((0, heat), (1, sizes)):
                at = np.flatnonzero(row)
                yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(row[at])], ["kind", "key", "n"])

    return run


def _signatures(words: int, heat: bytes, light: int):
    """(id, row, text) -> (id, row, n, sid, check, lead, bits, subsets, tokens, n_index);
    only the first of equal sets in a batch leads, with bits and list keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, hot = Sets(words), np.frombuffer(heat, dtype=np.uint8)
        none = np.zeros(0, np.uint64)
        for batch in text_batches(batches, "text", PIECE):
            seen: set[tuple[int, int]] = set()
            n, own, bits, pairs, tokens, index = [], [], [], [], [], []
            for s in sets.of(batch.column("text")):
                n.append(len(s))
                own.append(sid(s))
                two = one = none
                index.append(0)
                bits.append(None)
                if len(s) > 1 and own[-1] not in seen:
                    seen.add(own[-1])
                    size = len(s)
                    bits[-1] = parity(s)
                    first = s[np.argsort(hot[s >> np.uint64(64 - BUCKETS)], kind="stable")[: size - probe_overlap(size) + 2]]
                    if size <= light:
                        a, b = np.triu_indices(len(first), 1)
                        two = mixed(first[a] * np.uint64(0x9E3779B97F4A7C15) + first[b])
                        one = first[: size - index_overlap(size) + 1] if 4 * size > 3 * light else none
                        index[-1] = len(one)
                    else:
                        one = first[:-1]
                        index[-1] = size - index_overlap(size) + 1
                pairs.append(two)
                tokens.append(one)

            def lists(rows: list[np.ndarray]) -> pa.Array:
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([none, *rows]).view(np.int64)))

            yield pa.record_batch([
                batch.column("id"), batch.column("row"), pa.array(n, pa.int32()), *(pa.array([o[h] if k else None for o, k in zip(own, n)], pa.int64()) for h in (0, 1)),
                pa.array([b is not None for b in bits]), pa.array(bits, pa.binary()), lists(pairs), lists(tokens), pa.array(index, pa.int32())],
                ["id", "row", "n", "sid", "check", "lead", "bits", "subsets", "tokens", "n_index"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (key, info, sid) -> those of lists of two classes or more;
    of a list only the last row is held."""
    names = ("key", "sid", "info")
    last, joined = {c: np.zeros(0, np.int64) for c in names}, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: np.concatenate([last[c], batch.column(c).to_numpy()]) for c in names}
        fresh = np.append(True, (cols["key"][1:] != cols["key"][:-1]) | (cols["sid"][1:] != cols["sid"][:-1]))
        cols = {c: v[fresh] for c, v in cols.items()}
        same = cols["key"][1:] == cols["key"][:-1]
        before = np.append(joined, same)
        long = (before | np.append(same, False))[:-1]
        if long.any():
            yield pa.record_batch([pa.array(cols[c][:-1][long]) for c in names], [*names])
        last, joined = {c: v[-1:] for c, v in cols.items()}, bool(before[-1])
    if joined:
        yield pa.record_batch([pa.array(last[c]) for c in names], [*names])


def _not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, n_a, n_b, bits_a, bits_b) -> (a, b, shared) the bit maps leave."""
    for batch in batches:
        m = batch.num_rows
        if m:
            bits = batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist()
            size = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()]).astype(np.int64)
            keep = _may_link(bits, size, np.arange(m), np.arange(m, 2 * m))
            yield batch.select(["a", "b", "shared"]).filter(pa.array(keep))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by (key, info, sid) with their component -> pairs (a, b) next
    to each other, of different components, whose sizes allow a link."""
    names = ("key", "sid", "info", "component")
    last = {c: np.zeros(0, np.int64) for c in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {c: np.concatenate([last[c], batch.column(c).to_numpy()]) for c in names}
        last = {c: v[-1:] for c, v in part.items()}
        key, own, n, comp = part["key"], part["sid"], part["info"] >> 2, part["component"]
        i = np.flatnonzero((key[1:] == key[:-1]) & (comp[1:] != comp[:-1]) & (4 * n[:-1] >= 3 * n[1:]))
        yield pa.record_batch([pa.array(own[i]), pa.array(own[i + 1])], ["a", "b"])


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, salt, list): the bit maps of a group's classes (list
    null), then its lists' members -> pairs (a, b) of different components that the
    lists make candidates and the bit maps do not rule out. Members of one block (not
    negative) are no candidates of each other here."""

    def settle(rows: dict[str, list]) -> pa.RecordBatch | None:
        own = np.concatenate(rows["sid"])
        bits = [b for part in rows["bits"] for b in part]
        known = len(bits)
        order = np.argsort(own[:known], kind="stable")
        at = order[np.searchsorted(own[:known], own[known:], sorter=order)]
        key, info, comp, block = (np.concatenate(rows[c])[known:] for c in ("list", "info", "component", "block"))
        n, role = info >> 2, info & 3
        size = np.zeros(known, dtype=np.int64)
        size[at] = n
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(begin[1:], len(key))
        # A pair's place in a table where that is small, else its number.
        seen, codes, held = np.zeros(known * known if known <= 4 * BLOCK else 0, dtype=bool), [], 0
        for a, b in zip(begin.tolist(), end.tolist()):
            most = a + np.searchsorted(n[a:b], n[a:b] * 4 // 3, "right")
            for i in range(a, b - 1):
                # Either both are subsets, or the smaller is indexed and the larger scans.
                ok = (comp[i + 1 : most[i - a]] != comp[i]) & ((role[i + 1 : most[i - a]] & 1 == 1) if role[i] >= 2 else (role[i + 1 : most[i - a]] == 0) & (role[i] == 0))
                if block[i] >= 0:
                    ok &= block[i + 1 : most[i - a]] != block[i]
                j = np.flatnonzero(ok) + i + 1
                if not len(j):
                    continue
                if len(seen):
                    seen[at[i] * known + at[j]] = True
                    continue
                codes.append(at[i] * known + at[j])
                held += len(j)
                if held > HELD:
                    codes, held = [np.unique(np.concatenate(codes))], 0
        code = np.flatnonzero(seen) if len(seen) else np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        if not len(code):
            return None
        i, j = code // known, code % known
        keep = _may_link(bits, size, i, j)
        return pa.record_batch([pa.array(own[i[keep]]), pa.array(own[j[keep]])], ["a", "b"]) if keep.any() else None

    names = ("sid", "list", "info", "component", "block", "bits")
    rows: dict[str, list] = {c: [] for c in names}
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        pivot, salt = (batch.column(c).to_numpy() for c in ("pivot", "salt"))
        begin = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (salt[1:] != salt[:-1])))
        for a, b in zip(begin.tolist(), np.append(begin[1:], batch.num_rows).tolist()):
            if now != (pivot[a], salt[a]):
                if rows["sid"] and (found := settle(rows)):
                    yield found
                rows, now = {c: [] for c in names}, (pivot[a], salt[a])
            part = batch.slice(a, b - a)
            for c in names[:-1]:
                rows[c].append(part.column(c).fill_null(0).to_numpy())
            rows["bits"].append([x for x in part.column("bits").to_pylist() if x is not None])
    if rows["sid"] and (found := settle(rows)):
        yield found


def _linked(words: int):
    """Rows sorted by (a, salt, b), the left set's text first (b null) -> linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, left, head = Sets(words), None, None
        for batch in text_batches(batches, "text", PIECE):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = []
            for x, y, s in zip(a, b, sets.of(batch.column("text"))):
                if y is None:
                    head, left = x, s
                elif head == x:
                    # The larger set's places in the smaller, both sorted.
                    at = np.searchsorted(left, s)
                    both = int((left[np.minimum(at, len(left) - 1)] == s).sum())
                    if 100 * both >= 75 * (len(left) + len(s) - both):
                        found.append((x, y))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _check(pairs: DataFrame, stands: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b: classes) whose sets link. ``stands`` (sid, row) names a row
    of ``texts`` (row, text) for each class; only texts of these pairs are kept."""
    pairs = save(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    own = save(texts.join(stands.select("sid", "row").join(needed, "sid"), "row").select("sid", "text"), "texts")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
    heads = (salts.join(own, F.col("a") == F.col("sid"))
             .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text"))
    members = (pairs.join(salts, "a").join(own, F.col("b") == F.col("sid"))
               .select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b", "text"))
    out = save(heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
               .select("a", "b", "text").mapInArrow(_linked(words), "a long, b long"), "links")
    release(pairs, own)
    return out


def _labelled(members: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """``members`` with the component of ``key`` (itself where it has no link)."""
    renamed = found.select(F.col("node").alias(key), F.col("component").alias(name))
    return members.join(renamed, key, "left").withColumn(name, F.coalesce(name, key))


def _best(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Of each ``b`` the pair with most shared lists that its bit maps allow."""
    side = lambda c: bits.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    left = (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", "n_a", "n_b", "bits_a", "bits_b")
            .mapInArrow(_not_ruled_out, "a long, b long, shared long"))
    return left.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")


def _dealt(held: DataFrame) -> DataFrame:
    """Members of open lists with the group (pivot, salt) that settles them: whole
    lists, or (salt below 0) two blocks of a pivot's long lists, ``block`` being -1
    where the group is one block with itself."""
    part = (F.col("pivot") % 64).alias("part")
    short, long = held.filter(F.col("length") <= LONG), held.filter(F.col("length") > LONG)
    salts = short.groupBy("pivot").agg(F.ceil(F.count("*") / 10_000).alias("salts")).select("*", part)
    whole = (short.select("*", part).join(salts, ["pivot", "part"])
             .select("pivot", F.pmod(F.hash("list"), F.col("salts")).alias("salt"), "list", "sid", "info", "component", F.lit(-1).cast("long").alias("block")))
    blocks = (long.select("pivot", "sid").distinct().groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).select("*", part))
    x, y = F.col("x"), F.col("y")
    cut = (long.select("*", part).join(blocks, ["pivot", "part"]).withColumn("x", F.pmod(F.xxhash64("sid"), F.col("blocks")))
           .withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .select("pivot", (-1 - F.least(x, y) * F.col("blocks") - F.greatest(x, y)).alias("salt"), "list", "sid", "info", "component",
                   F.when(x == y, -1).otherwise(x).cast("long").alias("block")))
    return whole.unionByName(cut)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
            scan_cost: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has one row per row of ``df`` with id, n
    (set size), sid (class, null for the empty set) and component (of classes);
    links has the checked pairs of classes that build the components."""
    spark = df.sparkSession
    base = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = base.schema["id"].dataType.simpleString()
    counted = (base.select("text").mapInArrow(_heat(words), "kind int, key long, n long")
               .groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow())
    kinds, keys, n = (counted.column(c).to_numpy() for c in ("kind", "key", "n"))
    heat = np.zeros(1 << BUCKETS, dtype=np.uint8)
    heat[keys[kinds == 0]] = np.log2(n[kinds == 0]).astype(np.uint8) + 1
    light = boundary(dict(zip(keys[kinds == 1].tolist(), n[kinds == 1].tolist())), scan_cost)

    signed = _apart(save(base.select("id", "row", "text").mapInArrow(
        _signatures(words, heat.tobytes(), light),
        f"id {kind}, row long, n int, sid long, check long, lead boolean, bits binary, subsets array<long>, tokens array<long>, n_index int"), "signatures"))
    size = F.col("n").cast("long") * 4
    role = F.when(F.col("n") <= light, 2).otherwise(F.when(F.col("at") < F.col("n_index"), 3).otherwise(1))
    postings = (signed.select("sid", size.alias("info"), F.explode("subsets").alias("key"))
                .unionByName(signed.select("sid", "n", "n_index", F.posexplode("tokens").alias("at", "key"))
                             .select("sid", (size + role).alias("info"), "key")))
    members = save(postings.select("key", "sid", "info").repartition("key").sortWithinPartitions("key", "info", "sid")
                   .mapInArrow(_members, "key long, sid long, info long"), "lists")

    # One row stands for each class that is in some list with another.
    stands = (signed.filter("lead").groupBy("sid").agg(F.min("row").alias("row"))
              .join(members.select("sid").distinct(), "sid", "left_semi"))
    bits = save(signed.filter("lead").select("row", "n", "bits").join(stands, "row").select("sid", "row", "n", "bits"), "bits")
    texts = base.select("row", "text")
    # The heavy columns are spent; every table goes as soon as nothing reads it.
    rows = save(signed.select("id", "row", "n", "sid"), "rows")
    release(signed)

    degree = members.groupBy("sid").agg((F.count("*") / F.first("info")).alias("degree"))
    ranked = members.join(degree, "sid")
    pivots = ranked.groupBy("key").agg(F.max_by(F.struct("sid", "info"), F.struct("degree", "sid")).alias("p")).withColumn("part", F.col("key") % 64)
    n, m = F.shiftright("info", 2), F.shiftright("p.info", 2)
    star = (members.withColumn("part", F.col("key") % 64).join(pivots, ["key", "part"])
            .filter((F.col("sid") != F.col("p.sid")) & (4 * F.least(n, m) >= 3 * F.greatest(n, m)))
            .groupBy(F.col("p.sid").alias("a"), F.col("sid").alias("b")).agg(F.count("*").alias("shared")))
    links = _check(_best(star, bits), bits, texts, words)
    found = components(links)

    listed = _labelled(members, "sid", found, "component").select("key", "sid", "info", "component")
    beside = (listed.repartition("key").sortWithinPartitions("key", "info", "sid").mapInArrow(_neighbours, "a long, b long")
              .groupBy("a", "b").agg(F.count("*").alias("shared")))
    links = links.unionByName(_check(_best(beside, bits), bits, texts, words))
    release(found)
    found = components(links)

    listed = _labelled(members, "sid", found, "component")
    several = (listed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("length")).filter("x <> y")
               .join(pivots, "key").select("key", "part", "length", F.col("p.sid").alias("pivot")))
    held = save(listed.withColumn("part", F.col("key") % 64).join(several, ["key", "part"])
                .select("pivot", F.col("key").alias("list"), "sid", "info", "component", "length"), "open")
    release(members, found)
    dealt = _dealt(held)
    none = F.lit(None).cast("long")
    maps = (dealt.select("pivot", "salt", "sid").distinct().join(bits.select("sid", "bits"), "sid")
            .select("pivot", "salt", none.alias("list"), "sid", none.alias("info"), none.alias("component"), none.alias("block"), "bits"))
    listed = dealt.select("pivot", "salt", "list", "sid", "info", "component", "block", F.lit(None).cast("binary").alias("bits"))
    left = (maps.unionByName(listed).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "list", "info", "sid")
            .mapInArrow(_open_pairs, "a long, b long").distinct())
    links = links.unionByName(_check(left, bits, texts, words))
    release(held, bits)
    return _labelled(rows, "sid", components(links), "component"), links


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scan_cost: float = 4.0) -> DataFrame:
    """id, row, n, sid and component_id (the smallest id of the component) of each row."""
    docs, _ = classes(df, id_col, text_col, words, scan_cost)
    linked = docs.filter("component is not null")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id")).withColumn("part", F.col("component") % 64)
    alone = docs.filter("component is null").select("id", "row", "n", "sid", F.col("id").alias("component_id"))
    return (linked.withColumn("part", F.col("component") % 64).join(least, ["component", "part"])
            .select("id", "row", "n", "sid", "component_id").unionByName(alone))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scan_cost: float = 4.0) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: those without a link
    and, of each component, the row with its smallest id (of repeated ids, the
    first place)."""
    docs, _ = classes(df, id_col, text_col, words, scan_cost)
    # A null id comes last; the place decides between equal ids.
    order = F.struct(F.col("id").isNull().alias("x"), "id", "row")
    stay = (docs.filter("component is not null").groupBy("component").agg(F.min(order).alias("least")).select("least.row")
            .unionByName(docs.filter("component is null").select("row")))
    (own,) = free_names(df, "row")
    return (df.withColumn(own, F.monotonically_increasing_id())
            .join(stay.select(F.col("row").alias(own)), own, "left_semi").drop(own))
