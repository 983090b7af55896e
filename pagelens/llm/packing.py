"""Sequence packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, stored

_SPACE = re.compile(r"[\x1c-\x1f]")
_MARK = "`"
# Below U+0180, the letters, numbers and white space of Unicode. There, lower-casing is sign by sign and
# no two signs compose, so that a text falls into the tokenizer's own pre-tokens with this pattern.
_L, _N, _W = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_PRETOKEN = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_L}{_N}{_W}]+")
_BEYOND = re.compile("[\u0130\u0180-\U0010ffff]")
# The rules of tokenizers whose texts may be cut that way, as their files state them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_encoders: dict = {}


class Encoder:
    """A tokenizer whose ids of pre-tokens (of words, in other alphabets) are kept, up to `limit` of them.

    Parts are only kept for tokenizers that lower-case, drop white space and split by the pattern of word_bpe_49k.json, so that
    a text's ids are those of its parts. Texts that may hold an added token (<|endoftext|>), and all texts of tokenizers with other rules, are encoded whole.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.ids = Tokenizer.from_file(path), limit, {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case, as an added token may be sought in the normalised text
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        rules = json.loads(self.tokenizer.to_str())
        self.whole = rules["normalizer"] != _NORMALIZER or (rules["pre_tokenizer"] or {}).get("pretokenizers", [None])[0] != _SPLIT
        if not self.whole:
            (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as little-endian uint32."""
        if self.whole or (self.added and self.added.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if text.isascii() or not _BEYOND.search(text):
            words = _PRETOKEN.findall(text.lower())
        elif _SPACE.search(text):  # Python splits there, the tokenizer does not
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            words = text.split()
        ids = self.ids
        if new := [w for w in set(words) if w not in ids]:
            if len(ids) + len(new) > self.limit:
                ids.clear()
                new = list(set(words))
            self._learn(new)
        return np.frombuffer(b"".join(map(ids.__getitem__, words)), dtype="<u4")


    def _learn(self, words: list[str]) -> None:
        """Encode words as one text, in which a mark with an id of its own ends each."""
        clean = [w for w in words if _MARK not in w]
        for w in words:
            if _MARK in w:
                self.ids[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join([*clean, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(clean):
            raise ValueError("the mark's id occurs in a word")
        raw, at = ids.tobytes(), 0
        for w, end in zip(clean, (4 * ends).tolist(), strict=True):
            self.ids[w] = raw[at:end]
            at = end + 4


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: full ones first, the rest as the last. Every row has one piece at least."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        tail = np.array([end_id], dtype="<u4")
        for whole in batches:
            for b in rows_of(whole):
                rows: list[tuple[int, ...]] = []
                for i, t in enumerate(b.column("text").to_pylist()):
                    ids = np.concatenate([e.encode(t or ""), tail])
                    rows += [(i, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes()), len(ids)) for a in range(0, len(ids), capacity)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in the order in which they lie) with their counts.

    Lengths are placed from the longest to the shortest. A length goes to the shortest open packs, that is to those
    with the most room, and opens new ones when it does not fit there. Packs with the same pattern are only counted, so
    that the work follows the number of different patterns, not that of pieces.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # sorted
    done: dict[tuple[int, ...], int] = {}

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room == 0:
            done[pattern] = done.get(pattern, 0) + n
            return
        if room not in open_:
            open_[room] = {}
            bisect.insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie in 1..capacity")
        while left:
            if not rooms or rooms[-1] < length:
                put(capacity - length, (length,), left)  # those that can take one more are found again below
                left = 0
                if capacity - length >= length:
                    left = _fold(open_, rooms, put, capacity, length)
                continue
            room = rooms[-1]
            pattern, n = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop()
            take = min(n, left)
            if n > take:
                put(room, pattern, n - take)
            put(room - length, (*pattern, length), take)
            left -= take
    for packs in open_.values():
        for pattern, n in packs.items():
            done[pattern] = done.get(pattern, 0) + n
    return sorted(done.items(), key=lambda x: (tuple(-v for v in x[0]), x[1]))


def _fold(open_, rooms, put, capacity: int, length: int) -> int:
    """Of the packs just opened for one length, put as many as fit together; nothing is left over."""
    n = open_[capacity - length].pop((length,))
    if not open_[capacity - length]:
        del open_[capacity - length]
        rooms.remove(capacity - length)
    each = capacity // length
    full, rest = divmod(n, each)
    if full:
        put(capacity - each * length, (length,) * each, full)
    if rest:
        put(capacity - rest * length, (length,) * rest, 1)
    return 0


def pack(pieces: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces.

    Only the histogram of lengths (at most `capacity` rows) goes to the driver. Of a length, the pieces are ranked by
    counts per partition and a window over (length, partition), so that no task holds all pieces of a length; the
    patterns come back as slots, ranges of ranks (bounded by the number of patterns, not pieces), joined by length.
    """
    spark = pieces.sparkSession
    parts = pieces.withColumn("_part", F.pmod(F.xxhash64(id_col, "start"), F.lit(1024)).cast("int"))
    counts = parts.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, first = [], 0
    at: dict[int, int] = dict.fromkeys(total, 0)
    for pattern, n in shortest_pack_first(total, capacity):
        offset = 0
        i = 0
        while i < len(pattern):  # a run of equal lengths in a pattern takes consecutive ranks in each sequence
            length, k = pattern[i], 1
            while i + k < len(pattern) and pattern[i + k] == length:
                k += 1
            slots.append((length, at[length], at[length] + n * k, first, k, offset))
            at[length] += n * k
            offset += k * length
            i += k
        first += n
    by_length: dict[int, list] = {}
    for length, *s in slots:
        by_length.setdefault(length, []).append(tuple(s))
    table = spark.createDataFrame(sorted(by_length.items()), "length long, slots array<struct<lo:long,hi:long,first:long,k:long,base:long>>")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    starts = counts.select("length", "_part", before)
    rank = (F.row_number().over(Window.partitionBy("length", "_part").orderBy(F.col(id_col), "start")) - 1).alias("_in")
    ranked = parts.select("*", rank).join(starts, ["length", "_part"])
    r = F.col("_in") + F.col("_before")
    placed = ranked.withColumn("_r", r).join(F.broadcast(table), "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("_r")) & (F.col("_r") < s["hi"])), 1)
    placed = placed.withColumn("_s", slot).withColumn("_d", F.col("_r") - F.col("_s.lo"))
    return placed.select(
        *pieces.columns,
        (F.col("_s.first") + F.floor(F.col("_d") / F.col("_s.k"))).cast("long").alias("sequence_id"),
        (F.col("_s.base") + F.pmod("_d", F.col("_s.k")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows into sequences of at most `capacity` ids: one row per piece.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts have one piece, the
    end id. The texts are read and tokenized once; the pieces (numbers only) are stored before their histogram is
    taken. Rows that repeat an id are packed as rows of their own. An empty table gives an empty one. Extra columns
    are not read.
    """
    pieces = stored(token_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, capacity=capacity, id_col=id_col)
