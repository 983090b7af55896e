"""Repeated passages across documents: every byte covered by a window that also starts earlier is removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import repeated_windows, rolling
from .common import discard, rows_of, stored

GRAM = 32


def _extreme(x: np.ndarray, w: int, pick) -> np.ndarray:
    """The least or largest of each w neighbours, by doubling."""
    n = 1
    while 2 * n <= w:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def _grams(data: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each GRAM bytes; the top bit marks those in `hot` (sorted), which so come last."""
    h = rolling(data, GRAM) >> np.uint64(2)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h |= (hot[at] == h).astype(np.uint64) << np.uint64(63)
    return h


def anchors_of(data: np.ndarray, window: int, hot: np.ndarray) -> np.ndarray:
    """The hash at each place that is an anchor: the least of the GRAM-byte substrings of some window."""
    if len(data) < window:
        return np.empty(0, np.uint64)
    h = _grams(data, hot)
    w = window - GRAM + 1
    low = _extreme(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return h[_extreme(np.concatenate([pad, low, pad]), w, np.maximum) == h]


def anchor_runs(data: np.ndarray, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, end) of the runs of windows whose anchors have one hash.

    Equal windows have equal anchors, wherever they lie.
    """
    if len(data) < window:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    low = _extreme(_grams(data, hot), window - GRAM + 1, np.minimum)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    return low[first], first, np.append(first[1:], len(low))


def _bytes(t: str | None) -> np.ndarray:
    return np.frombuffer((t or "").encode(), np.uint8)


_SIGN = np.uint64((1 << 63) - 1)


def _runs(at: np.ndarray) -> list[int]:
    """Sorted places as flat (start, end) of runs."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1], axis=1).ravel().tolist()


def _windows_of(raw: bytes, window: int) -> np.ndarray:
    """128-bit hashes of all windows of a string, as pairs of longs."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + window]) for i in range(len(raw) - window + 1)), np.int64).reshape(-1, 2)


def _repeats_of_crowds(strings: DataFrame, window: int, found_type: T.StructType) -> DataFrame:
    """What `merge` finds, for anchors with more strings than one task should hold: windows are counted one by one.

    Windows are grouped by a 128-bit hash, counted in parts before the shuffle, so that no group meets in one task.
    """
    first = strings.groupBy("s1", "s2").agg(F.min(F.struct("id", "a")).alias("p"), F.max("string").alias("string")).select("s1", "s2", F.col("p.id").alias("id"), F.col("p.a").alias("a"), "string")
    each_type = T.StructType([*found_type.fields[:4], T.StructField("o", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole, 1 << 18, "string"):
                keys = [_windows_of(x, window) for x in b.column("string").to_pylist()]
                row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                k = np.concatenate(keys)
                cols = [b.column(c).take(pa.array(row)) for c in ("s1", "s2", "id", "a")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([np.arange(len(x)) for x in keys])), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=each_type.names)

    windows = stored(first.mapInArrow(explode, each_type), "windows")
    place = F.struct("id", (F.col("a") + F.col("o")).alias("at"))
    low = windows.groupBy("k1", "k2").agg(F.min(place).alias("low"))
    gone = windows.join(low, ["k1", "k2"]).filter(place != F.col("low")).groupBy("s1", "s2", "id", "a").agg(F.flatten(F.collect_list(F.array("o", F.col("o") + 1))).alias("runs"))
    return stored(first.drop("string").join(gone, ["s1", "s2", "id", "a"], "left").select("s1", "s2", "id", "a", F.coalesce("runs", F.array().cast("array<long>")).alias("runs")), "crowds")


def remove_repeats(
    docs: DataFrame,
    *,
    window: int = 100,
    chunk_bytes: int = 2 << 20,
    task_bytes: int = 8 << 20,
    anchor_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte is removed if a window that covers it occurs earlier: in a row with a smaller id, or earlier in the same.
    Occurrences may overlap, and all are judged on the input. Matches never cross rows.

    1. Windows are cut into runs by an anchor, so that equal windows have equal anchors. Anchors that occur once are
       dropped; what is left are strings around repeated anchors. Anchors known as hot from a hashed 1/16 of the rows
       (at most 1000 of them) come last in the choice, so that the strings around them are equal and collapse; no
       result hangs on that.
    2. A task sends each string once, its other occurrences as a digest of 128 bits. Strings are dealt by anchor.
    3. Equal strings of an anchor, compared by bytes, are one; all but the earliest are removed whole. Where an anchor
       has different strings, the task builds transforms of shards of them (ranges of ids), merges these (bwt.merge) and takes
       the intervals of windows that agree, in bytes: all but the earliest are removed.
    4. Anchors with over `anchor_bytes` of strings go by single windows instead (_repeats_of_crowds), so that no task
       holds more than that.

    Null and empty texts have no bytes, and an empty table gives an empty one. Ids should be distinct: rows that repeat an id and a text are judged as one.
    Rows with a null id keep their bytes and count for no other row. Extra columns are not read. Long texts are read whole, one at a time.
    Each step is stored, and what it was made of is deleted then. A task of step 3 holds about `chunk_bytes` of strings, or one anchor's.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def grams(hot: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in rows_of(whole):
                    hs, ns, ids = [], [], []
                    for i, t in enumerate(b.column("text").to_pylist()):
                        h, n = np.unique(anchors_of(_bytes(t), window, hot), return_counts=True)
                        hs.append(h)
                        ns.append(n > 1)
                        ids.append(np.full(len(h), i))
                    at = np.concatenate(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), b.column("id").take(pa.array(at)), pa.array(np.concatenate(ns))], names=["h", "id", "twice"])

        return run

    id_type = docs.schema[id_col].dataType
    h_id = T.StructType([T.StructField("h", T.LongType()), T.StructField("id", id_type), T.StructField("twice", T.BooleanType())])
    some = read.filter(f"id is not null and octet_length(text) >= {window}")
    counts = some.filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(16)) == 0).mapInArrow(grams(np.empty(0, np.uint64)), h_id).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = np.sort(np.array([r["h"] for r in counts.filter("n >= 20").orderBy(F.desc("n"), "h").limit(1000).collect()], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(hot)

    def anchors(batches):
        yield from grams(sent.value)(batches)

    # a hot anchor is known to occur often and is not counted again
    rows = stored(some.mapInArrow(anchors, h_id).filter("h >= 0"), "rows")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("twice").cast("int")).alias("t")).filter("n > 1 or t > 0").select("h")
    mine = rows.join(often.hint("shuffle_hash"), "h").groupBy("id").agg(F.collect_list(F.shiftleft("h", 1).bitwiseOR(F.col("twice").cast("long"))).alias("hs"))
    wanted = stored(mine, "anchors")
    discard(rows)

    cut_type = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in ("a", "w", "h", "s1", "s2")] + [T.StructField("twice", T.BooleanType()), T.StructField("string", T.BinaryType())])
    digest = xxhash.xxh3_128_digest
    one = np.uint64(1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # strings that this task has sent; rows come by id, so that the first is the earliest
        for whole in batches:
            for b in rows_of(whole, 1 << 20):
                rows, starts, sizes, anchors_at, twice, digests, strings = [], [], [], [], [], [], []
                for i, (t, hs) in enumerate(zip(b.column("text").to_pylist(), b.column("hs"), strict=True)):
                    raw = t.encode()
                    h, first, end = anchor_runs(np.frombuffer(raw, np.uint8), window, sent.value)
                    take = h > _SIGN
                    again = take.copy()
                    if hs.is_valid:
                        mine = np.sort(hs.values.to_numpy().view(np.uint64))
                        at = np.minimum(np.searchsorted(mine >> one, h), len(mine) - 1)
                        mark = mine[at]
                        known = mark >> one == h
                        take |= known
                        again |= known & (mark & one > 0)
                    take = np.flatnonzero(take)
                    first, end = first[take], end[take]
                    rows.append(np.full(len(take), i))
                    starts.append(first)
                    sizes.append(end - first)
                    anchors_at.append(h[take])
                    twice.append(again[take])
                    for a, e in zip(first.tolist(), (end + (window - 1)).tolist(), strict=True):
                        s = raw[a:e]
                        d = digest(s)
                        digests.append(d)
                        if d in seen:
                            strings.append(None)
                        else:
                            strings.append(s)
                            seen.add(d)
                if len(seen) > 200_000:
                    seen.clear()
                if digests:
                    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    cols = [pa.array(np.concatenate(c)) for c in (starts, sizes)] + [pa.array(np.concatenate(anchors_at).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.concatenate(rows))), *cols, pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(np.concatenate(twice)), pa.array(strings, pa.binary())], names=cut_type.names)

    by_id = some.join(wanted, "id", "left").sortWithinPartitions("id")
    pieces = stored(by_id.mapInArrow(cut, cut_type), "pieces")
    discard(wanted)
    candidates = pieces.filter("string is not null").select("h", "id", "a", "w", "s1", "s2", "twice", "string")
    amounts = candidates.groupBy("h").agg(F.sum(F.col("w") + (window - 1)).alias("n"))
    crowded = stored(amounts.filter(F.col("n") > anchor_bytes).select("h"), "crowded")
    crowds = not crowded.isEmpty()
    total = candidates.agg(F.sum(F.col("w") + (window - 1))).first()[0] or 0
    dealt = candidates.join(crowded, "h", "left_anti") if crowds else candidates
    dealt = dealt.drop("w").repartition(int(max(1, total // task_bytes + 1)), "h").sortWithinPartitions("h", "id", "a")
    found_type = T.StructType([T.StructField(c, T.LongType()) for c in ("s1", "s2")] + [T.StructField("id", id_type), T.StructField("a", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType()))])
    keys = ("s1", "s2", "id", "a")

    def solve(t: pa.Table) -> pa.RecordBatch:
        """Of different strings: which windows occur in an earlier one, or earlier in the same."""
        t = t.sort_by([("id", "ascending"), ("a", "ascending")])  # so the first of an interval is the earliest
        strings = t.column("string").to_pylist()
        lengths = np.array([len(x) for x in strings], np.int64)
        start = np.cumsum(lengths) - lengths
        byte, interval = repeated_windows(np.frombuffer(b"".join(strings), np.uint8), start, window)
        gone = np.sort(byte[1:][interval[1:] == interval[:-1]])
        where = np.searchsorted(start, gone, side="right") - 1
        ends = np.searchsorted(where, np.arange(len(lengths) + 1))
        off = gone - start[where]
        runs = [_runs(off[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in keys] + [pa.array(runs, pa.list_(pa.int64()))], names=found_type.names)

    def distinct(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Equal strings as one, by the earliest; then what the different ones of an anchor share."""
        h, s1, s2 = (t.column(c).to_numpy() for c in ("h", "s1", "s2"))
        order = np.lexsort((s2, s1, h))  # stable: the earliest of equal ones first
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
        first = order[new]
        others = np.flatnonzero(~new)
        if len(others):
            of = first[np.cumsum(new)[others] - 1]
            texts = t.column("string").combine_chunks()
            if texts.take(pa.array(order[others])) != texts.take(pa.array(of)):
                raise ValueError("two strings share a digest of 128 bits")
        hf = h[first]
        begin = np.flatnonzero(np.append(True, hf[1:] != hf[:-1]))
        n = np.diff(np.append(begin, len(hf)))
        twice = np.logical_or.reduceat(t.column("twice").to_numpy(zero_copy_only=False)[order], np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])))
        alone = np.repeat((n == 1) & ~twice, n)
        if alone.any():
            got = t.take(pa.array(first[alone])).combine_chunks()
            none = pa.ListArray.from_arrays(pa.array(np.zeros(got.num_rows + 1, np.int32)), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(c).combine_chunks() for c in keys] + [none], names=found_type.names)
        if not alone.all():
            yield solve(t.take(pa.array(first[~alone])))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for whole in batches:
            for b in rows_of(whole, 1 << 20, "string"):
                hs = b.column("h").to_numpy()
                if size >= chunk_bytes:  # go on to the end of the last anchor's strings
                    cutoff = int(np.argmax(hs != last)) if (hs != last).any() else len(hs)
                    held.append(b.slice(0, cutoff))
                    if cutoff == len(hs):
                        size += b.nbytes
                        continue
                    yield from distinct(pa.Table.from_batches(held))
                    held, size, b = [], 0, b.slice(cutoff)
                held.append(b)
                size += b.nbytes
                last = hs[-1]
        if held:
            yield from distinct(pa.Table.from_batches(held))

    found = stored(dealt.mapInArrow(merge, found_type), "found")
    if crowds:
        found = found.union(_repeats_of_crowds(candidates.join(crowded, "h", "left_semi"), window, found_type))
    each = pieces.select("id", "a", "w", "s1", "s2").join(found.select("s1", "s2", F.col("id").alias("fid"), F.col("a").alias("fa"), "runs").hint("shuffle_hash"), ["s1", "s2"])
    here = F.when((F.col("id") == F.col("fid")) & (F.col("a") == F.col("fa")), F.col("runs")).otherwise(F.array(F.lit(0).cast("long"), F.col("w")))
    gone = stored(each.select("id", F.transform(here, lambda x: x + F.col("a")).alias("runs")).filter(F.size("runs") > 0).groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs")), "gone")
    discard(pieces)
    out_type = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole, 1 << 20):
                out = []
                for t, runs in zip(b.column("text").to_pylist(), b.column("runs"), strict=True):
                    raw = (t or "").encode()
                    spans: list[list[int]] = []
                    if runs.is_valid:
                        for s, e in sorted(runs.values.to_numpy().reshape(-1, 2).tolist()):
                            if spans and s <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], e + window - 1)
                            else:
                                spans.append([s, e + window - 1])
                    kept = b"".join(raw[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), pa.array(c[4], pa.binary())], names=out_type.names)

    return read.join(gone, "id", "left").select("id", "text", "runs").mapInArrow(remove, out_type)
