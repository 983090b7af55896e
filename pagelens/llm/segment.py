"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed A* search of the lattice."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import rows_of

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_models: dict[str, Pieces] = {}
_lattices: dict[str, Lattices] = {}


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: np.ndarray, a: np.ndarray | int, b: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed, a place and a step alone."""
    x = _spread(seed + np.asarray(a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _u64(b * 0xD1B54A32D192ED03))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol-buffer message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


def is_bpe(path: str) -> bool:
    """Whether a model file says that it was trained by byte-pair encoding (trainer_spec.model_type; unigram if it says nothing)."""
    with open(path, "rb") as f:
        spec = next((v for k, v in _fields(f.read()) if k == 2), b"")
    return next((v for k, v in _fields(spec) if k == 3), 1) == 2


class Pieces:
    """A SentencePiece vocabulary with identity normalisation, whose pieces hold the mark only at their start.

    Weights are the scores of a unigram model; of a BPE model, whose scores are ranks, -log(rank + 2). A sign without a
    piece becomes its bytes, at a weight below all others.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        if any(MARK in text[i].lstrip(MARK) for i in usual):
            raise ValueError("a piece holds the mark after its start")
        self.bytes_at = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        score = np.array([sp.get_score(i) for i in range(n)])
        ranks = is_bpe(path)
        self.weight = np.full(n, -np.inf)
        self.weight[usual] = -np.log(np.arange(len(usual)) + 2) if ranks else score[usual]
        self.floor = float(self.weight[usual].min()) - 10
        self.text = text
        self.surface = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.longest = max(len(text[i]) for i in usual)
        self.length = np.array([len(t) for t in text])
        self.ascii = np.full(128, -1, np.int32)  # ids of the bytes that are signs of their own
        for c, i in self.bytes_at.items():
            self.length[i] = 1
            if c < 128:
                self.ascii[c] = i
        self.tables = {}
        for size in range(1, self.longest + 1):
            ids = np.array([i for i in usual if len(text[i]) == size])
            if len(ids):
                x = np.frombuffer("".join(text[i] for i in ids).encode("utf-32-le"), np.uint32).reshape(-1, size)
                h = np.zeros(len(ids), np.uint64)
                for k in range(size):
                    h = self._step(h, x[:, k])
                self.tables[size] = self._table(h, ids)

    @staticmethod
    def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    @staticmethod
    def _table(h: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Levels of a hash table without chains: what finds its slot taken goes to the next level."""
        levels = []
        shift = 0
        while len(ids):
            key, value = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
            slot = ((h >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], value[slot[first]] = h[first], ids[first]
            levels.append((shift, key, value))
            rest = np.ones(len(ids), bool)
            rest[first] = False
            h, ids, shift = h[rest], ids[rest], shift + 13
        return levels

    def find(self, h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for shift, key, value in self.tables.get(size, ()):
            slot = ((h >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
            out = np.where(key[slot] == h, np.maximum(out, value[slot]), out)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the one space that encoding puts before a text is taken off."""
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for; `new` lists those not yet worked on."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Lattices:
    """The lattices of different words, laid end to end: at each sign, the pieces that may end there and how likely each is.

    Words stay until `limit` signs are held; then all are dropped. What is kept of a word does not depend on others.
    """

    def __init__(self, model: Pieces, limit: int = 2_000_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.start = self.end = np.empty(0, np.int64)  # by word
        self.signs = np.empty(0, np.uint32)
        self.first = np.zeros(1, np.int64)  # of the pieces by sign, long ones first
        self.piece, self.length = np.empty(0, np.int32), np.empty(0, np.uint8)
        self.share, self.logp, self.upto = np.empty(0), np.empty(0), np.empty(0)  # probability, its log, running sum

    def numbers(self, words: list[list[str]]) -> list[np.ndarray]:
        """The number of each word; lattices of new ones are added."""
        for again in (False, True):
            had, get = len(self.known), self.known.__getitem__
            out = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in words]
            new = self.known.new
            if again or not had or len(self.signs) + sum(map(len, new)) <= self.limit:
                break
            self._clear()
        if new:
            self._add(new)
            self.known.new = []
        return out

    def _add(self, words: list[str]) -> None:
        model = self.model
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(x)
        offset = np.arange(n) - np.repeat(begin, size)
        left = np.repeat(size, size) - offset
        at, h, hits = np.arange(n), np.zeros(n, np.uint64), []
        for k in range(1, model.longest + 1):
            if k > 1:
                more = left[at] >= k
                at, h = at[more], h[more]
            if not len(at):
                break
            h = model._step(h, x[at + k - 1])
            ids = model.find(h, k)
            some = np.flatnonzero(ids >= 0)
            hits.append((at[some] + k - 1, np.full(len(some), k, np.uint8), ids[some]))
        bare = np.ones(n, bool)
        bare[hits[0][0]] = False
        bare = np.flatnonzero(bare)
        hits.append((bare, np.ones(len(bare), np.uint8), np.where(x[bare] < 128, model.ascii[np.minimum(x[bare], 127)], -1)))
        end, length, piece = (np.concatenate(c) for c in zip(*hits[::-1], strict=True))
        w = np.where(piece >= 0, model.weight[piece], -np.inf)
        w[: len(bare)] = model.floor
        swap = np.argsort(-length.astype(np.int8), kind="stable")
        swap = swap[np.argsort(end[swap], kind="stable")]
        end, length, piece, w = end[swap], length[swap], piece[swap], w[swap]
        many = np.bincount(end, minlength=n)
        first = np.append(0, np.cumsum(many))
        total, share, logp = np.zeros(n), np.empty(len(end)), np.empty(len(end))
        t_of = offset[end]
        turn = np.argsort(t_of, kind="stable")
        bounds = np.searchsorted(t_of[turn], np.arange(int(size.max()) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = turn[a:b]
            e, k = end[rows], length[rows].astype(np.int64)
            z = w[rows] + np.where(k == t_of[rows] + 1, 0.0, total[e - k])
            group = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            each = np.diff(np.append(group, len(e)))
            top = np.maximum.reduceat(z, group)
            p = np.exp(z - np.repeat(top, each))
            s = np.add.reduceat(p, group)
            total[e[group]] = top + np.log(s)
            share[rows] = p / np.repeat(s, each)
            logp[rows] = z - np.repeat(total[e[group]], each)
        upto = share.copy()
        for k in range(1, int(many.max())):
            rows = first[:-1][many > k] + k
            upto[rows] += upto[rows - 1]
        upto[first[1:] - 1] = np.inf
        used, had = len(self.signs), len(self.piece)
        self.start, self.end = np.append(self.start, used + begin), np.append(self.end, used + begin + size - 1)
        self.signs = np.append(self.signs, x)
        self.first = np.append(self.first[:-1], had + first)
        for name, new in (("piece", piece), ("length", length), ("share", share), ("logp", logp), ("upto", upto)):
            setattr(self, name, np.append(getattr(self, name), new.astype(getattr(self, name).dtype)))

    def draw(self, word: np.ndarray, seed: np.ndarray, index: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One segmentation of each word: (ids laid end to end, their number by word, log probability by word)."""
        here, begin = self.end[word], self.start[word]
        logp, number = np.zeros(len(word)), np.zeros(len(word), np.int64)
        steps, active, step = [], np.arange(len(word)), 0
        state = _spread(seed + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _u64(turn * 0xD1B54A32D192ED03))
        while len(active):
            u = (state >> np.uint64(11)) * 2.0**-53
            state = state * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            o = self.first[here]
            miss = np.flatnonzero(u >= self.upto[o])
            while len(miss):
                o[miss] += 1
                miss = miss[u[miss] >= self.upto[o[miss]]]
            logp[active] += self.logp[o]
            got = self.piece[o]
            if got.min() < 0:
                got = np.where(got < 0, -1 - self.signs[here].astype(np.int64), got)
            steps.append((active, got))
            number[active] += 1
            here = here - self.length[o]
            on = here >= begin
            here, begin, active, state = here[on], begin[on], active[on], state[on]
            step += 1
        ends = np.cumsum(number)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for s, (a, got) in enumerate(steps):
            ids[ends[a] - 1 - s] = got
        return ids, number, logp

    def chance(self, word: int, path: tuple[int, ...]) -> float:
        """The probability of a segmentation of a word, given as piece lengths from the end."""
        p, out = int(self.end[word]), 1.0
        for k in path:
            out *= self._of(p).get(k, (0.0, 0.0, 0))[0]
            p -= k
        return out

    def _of(self, p: int) -> dict[int, tuple[float, float, int]]:
        """The pieces that end at a sign: length -> (probability, its log, id)."""
        a, b = int(self.first[p]), int(self.first[p + 1])
        return dict(zip(self.length[a:b].tolist(), zip(self.share[a:b].tolist(), self.logp[a:b].tolist(), self.piece[a:b].tolist(), strict=True), strict=True))

    def draw_other(self, word: int, out: list[tuple[int, ...]], seed: np.uint64, index: int, turn: int) -> tuple[list[int], float]:
        """A segmentation of a word that is none of `out` (piece lengths from the end), and its log probability."""
        p, first, ids, logp, step = int(self.end[word]), int(self.start[word]), [], 0.0, 0
        while p >= first:
            options = self._of(p)
            weight = {k: v[0] for k, v in options.items()}
            for path in out:  # what follows the excluded path from here on is taken off
                q, rest = p, 1.0
                for k in path[step:]:
                    rest *= self._of(q)[k][0]
                    q -= k
                weight[path[step]] -= rest
            u = float(uniforms(np.array([seed]), np.array([index]), turn * 65537 + 32768 + step)[0]) * sum(max(v, 0.0) for v in weight.values())
            for k, v in weight.items():
                if v > 0:
                    chosen = k
                    u -= v
                    if u < 0:
                        break
            _, lp, got = options[chosen]
            logp += lp
            ids.append(got if got >= 0 else -1 - int(self.signs[p]))
            out = [path for path in out if path[step] == chosen]
            p -= chosen
            step += 1
        return ids[::-1], logp


@dataclass
class Leaf:
    ids: np.ndarray
    number: np.ndarray  # of ids, by word
    logp: np.ndarray  # by word
    value: float  # perturbed
    parted: int = 0  # the word at which it leaves the leaf that it was parted from
    out: tuple[tuple[int, ...], ...] = ()  # segmentations that are excluded there


def _others(lattices: Lattices, leaves: list[Leaf], parted_words: list[int], seeds: np.ndarray, turn: int, most: int) -> list[list[tuple[float, int]]]:
    """For each leaf the best `most` of the sets left beside it: (perturbed maximum, word at which they part)."""
    count = np.array([len(x.logp) - x.parted for x in leaves])
    begin = np.cumsum(count) - count
    logp = np.concatenate([x.logp[x.parted :] for x in leaves])
    gone = np.exp(logp)
    for d, x in enumerate(leaves):
        for path in x.out:
            gone[begin[d]] += lattices.chance(parted_words[d], path)
    left = 1.0 - gone
    before = np.concatenate([np.cumsum(x.logp)[x.parted :] for x in leaves]) - logp
    phi = np.where(left > 1e-13, np.log(np.maximum(left, 1e-300)) + before, -np.inf)
    index = np.arange(len(logp)) - np.repeat(begin - [x.parted for x in leaves], count)
    u = uniforms(np.repeat(seeds, count), index, (1 << 40) + turn)
    with np.errstate(over="ignore", invalid="ignore"):
        g = phi - np.logaddexp(phi - np.repeat([x.value for x in leaves], count), np.log(-np.log(u)))  # a Gumbel at phi, below value
    g = np.where(phi > -np.inf, g, -np.inf)
    out: list[list[tuple[float, int]]] = [[] for _ in leaves]
    for _ in range(most):
        best = np.maximum.reduceat(g, begin)
        at = np.flatnonzero(g == np.repeat(best, count))
        owner = np.repeat(np.arange(len(leaves)), count)[at]
        owner, first = np.unique(owner, return_index=True)
        at = at[first]
        for d, k, v in zip(owner.tolist(), index[at].tolist(), g[at].tolist(), strict=True):
            if v > -np.inf:
                out[d].append((v, k))
        g[at] = -np.inf
    return out


def sample_batch(lattices: Lattices, texts: list[str], seeds: np.ndarray, samples: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, the best perturbed value first: (ids, log probability, value, inclusion score)."""
    model = lattices.model
    words = lattices.numbers([_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts])
    count = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.empty(0, np.int64)
    begin = np.cumsum(count) - count
    index = np.arange(len(flat)) - np.repeat(begin, count)
    ids, number, logp = lattices.draw(flat, np.repeat(seeds, count), index, 0)
    ends = np.append(0, np.cumsum(number))
    leaves: list[list[Leaf]] = []
    heaps: list[list] = [[] for _ in texts]
    least = np.full(len(texts), -np.inf)
    top = -np.log(-np.log(uniforms(seeds, 0, 1 << 41)))
    for d, (b, c) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
        leaves.append([Leaf(ids[ends[b] : ends[b + c]], number[b : b + c], logp[b : b + c], float(top[d]))])
    live = [d for d in range(len(texts)) if count[d]]
    for turn in range(1, samples + 1):
        chosen = []
        now = [leaves[d][-1] for d in live]
        sets = _others(lattices, now, [int(flat[begin[d] + x.parted]) for d, x in zip(live, now, strict=True)], seeds[live], turn, samples + 1 - turn) if live else []
        for d, found in zip(live, sets, strict=True):
            for g, i in found:
                heapq.heappush(heaps[d], (-g, len(leaves[d]) - 1, i))
            if not heaps[d]:
                continue
            g, parent, i = heapq.heappop(heaps[d])
            if turn == samples:
                least[d] = -g
            else:
                chosen.append((d, -g, leaves[d][parent], i))
        if turn == samples or not chosen:
            break
        tails = [np.arange(begin[d] + i + 1, begin[d] + count[d]) for d, _, _, i in chosen]
        t = np.concatenate(tails)
        new, n, lp = lattices.draw(flat[t], np.repeat(seeds[[c[0] for c in chosen]], [len(x) for x in tails]), index[t], turn)
        e, at = np.append(0, np.cumsum(n)), 0
        for (d, g, old, i), tail in zip(chosen, tails, strict=True):
            head = int(old.number[:i].sum())
            path = tuple(int(model.length[x]) if x >= 0 else 1 for x in old.ids[head : head + old.number[i]][::-1])
            out = (path, *(old.out if i == old.parted else ()))
            mine, p = lattices.draw_other(int(flat[begin[d] + i]), list(out), seeds[d], i, turn)
            z = at + len(tail)
            leaves[d].append(Leaf(np.concatenate([old.ids[:head], np.array(mine, np.int64), new[e[at] : e[z]]]), np.concatenate([old.number[:i], [len(mine)], n[at:z]]), np.concatenate([old.logp[:i], [p], lp[at:z]]), g, i, out))
            at = z
        live = [c[0] for c in chosen]
    return [[(_with_bytes(model, x.ids), total := float(x.logp.sum()), x.value, 1.0 if least[d] == -np.inf else -math.expm1(-math.exp(min(700.0, total - least[d])))) for x in ls] for d, ls in enumerate(leaves)]


def _with_bytes(model: Pieces, ids: np.ndarray) -> np.ndarray:
    """Signs without a piece, held as -1 - code point, become the ids of their bytes."""
    if len(ids) and ids.min() < 0:
        ids = np.array([y for x in ids.tolist() for y in ([x] if x >= 0 else [model.bytes_at[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")])], np.int64)
    return ids.astype("<u4")


def sample_segmentations(docs: DataFrame, model_path: str, *, samples: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row up to `samples` different segmentations, drawn without replacement in proportion to their weight.

    Columns: id, sample (from 0, by falling perturbed value), ids (little-endian uint32), n_ids, log_prob, perturbed,
    inclusion (the chance that a draw of `samples` holds this one, given the threshold that the next one sets; 1 where
    there is none), decoded (whether the ids give the text back).

    Pieces never cross the start of a word, so the lattice of a text is a chain of word lattices; those of equal
    words are built once, and draws are made for all words of the slice together. The search keeps, for
    each set of segmentations left, the exact maximum of its perturbed weights: it pops the best set, draws its best
    segmentation and parts the rest by the first word that differs. Draws depend on the row's id and the seed alone,
    never on how rows are dealt. Null and empty texts have one sample, without ids. Rows that repeat an id and a text
    get the same samples; a null id is a key like others. An empty table gives an empty one, extra columns are not read. A text that
    holds the mark itself is segmented as it stands and does not decode back (decoded is false). Memory follows a few MB of text or the longest text.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("sample", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("log_prob", "perturbed", "inclusion")] + [T.StructField("decoded", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        lattices = _lattices.setdefault(model_path, Lattices(model))
        for whole in batches:
            for b in rows_of(whole, 2 << 20):
                texts = [t or "" for t in b.column("text").to_pylist()]
                seeds = np.array([xxhash.xxh3_64_intdigest(str(i), seed=seed) for i in b.column("id").to_pylist()], np.uint64)
                got = sample_batch(lattices, texts, seeds, samples)
                rows = [(d, k, ids.tobytes(), len(ids), lp, g, q, model.decode(ids) == texts[d]) for d, ls in enumerate(got) for k, (ids, lp, g, q) in enumerate(ls)]
                c = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(c[0])), *(pa.array(x, k) for x, k in zip(c[1:], kinds, strict=True))], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, schema)


_processors: dict = {}


def _processor(path: str):
    import sentencepiece

    if path not in _processors:
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (little-endian uint32) of the model's own best segmentation, n_ids, decoded (whether they give the text back).

    One pass, whole texts; null and empty texts have no ids. Repeated rows and null ids are passed through, an empty table gives an
    empty one, extra columns are not read. A text that holds the mark U+2581 is encoded as the model does and does not decode back.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType()), T.StructField("decoded", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model_path)
        for whole in batches:
            for b in rows_of(whole):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = [sp.encode(t) for t in texts]
                back = [sp.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                raw = [np.array(x, "<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())], names=schema.names)

    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text of ids (little-endian uint32), of any segmentation. Null ids give a null text, none an empty one; an id that the model lacks is an error."""
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model_path)
        for whole in batches:
            for b in rows_of(whole, col="ids"):
                out = [None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=schema.names)

    return rows.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInArrow(run, schema)
