"""LM scoring: causal self-attention in numpy on subword ids whose values are distributions counted over the corpus."""

from __future__ import annotations

import copy
import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import col, documents, fold, materialise, raw, release, releasing, slices, string_array, text_column

VOCABULARY = 50257
END = VOCABULARY  # the end of a text, also what stands before its first subword
CLASSES, SHARED = 768, 32  # classes; the last of them hold all subwords that are not among the most frequent
KINDS, TOPICS, FAR = 16, 16, 4  # kinds of the subword before the last; topics of subwords, told by what comes FAR places later
EMBEDDED, WIDTH = 15, 16  # numbers of an embedding, of a query and a key
CONTEXT, STRIDE = 32, 24  # subwords of a window, and those from one window to the next
STEPS, BATCH = 600, 256  # of the start, at least; windows of a step
RATES = 0.03, 0.01  # of the start, and of the pass over all texts
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 4 << 20
WORDS = 1 << 16  # distinct words that are encoded in one call
LEVELS = 24  # of the logarithm of how often a state was met
RANGE = 64 * CLASSES  # counts that are shuffled in one row


@functools.cache
def encoder():
    """``byte_bpe_50k`` from the library that encodes single words fastest; special strings are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct hashes, the place of one of each, the number of each hash among them), in no order."""
    found = pa.array(hashes).dictionary_encode()
    number = found.indices.to_numpy().astype(np.int64)
    at = np.zeros(len(found.dictionary), np.int64)
    at[number] = np.arange(len(number))
    return hashes[at], at, number


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of several texts: by word its number among the distinct ones, the number of these being the end of a text."""

    hashes: np.ndarray  # of the distinct words
    sequence: np.ndarray  # numbers of all words, an end after each text's
    counts: np.ndarray  # words of each text, without the end
    spelled: np.ndarray  # bytes of the distinct words, A-Z as a-z, one after another
    sizes: np.ndarray  # bytes of each

    @classmethod
    def of(cls, texts: pa.StringArray) -> Words:
        buffer, offsets = raw(texts)
        parts, counts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], [np.zeros(0, np.int64)]
        for a, b in slices(texts):  # small enough for the caches
            low = int(offsets[a])
            starts, ends, firsts = hashing.words(buffer[low : int(offsets[b])], offsets[a : b + 1] - low)
            parts.append((hashing.word_hashes(buffer[low : int(offsets[b])], starts, ends), starts + low, ends + low))
            counts.append(np.diff(firsts))
        every, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.concatenate(counts)
        hashes, at, inverse = distinct(every)
        sequence = np.full(len(every) + len(counts), len(hashes), np.int32)
        sequence[np.arange(len(inverse)) + np.repeat(np.arange(len(texts)), counts)] = inverse
        sizes = ends[at] - starts[at]
        return cls(hashes, sequence, counts, _LOWER[buffer[ragged(starts[at], sizes)]], sizes)


def _odd(spelled: np.ndarray) -> np.ndarray:
    """Bytes where a character may begin that is white space for the encoder, but not between words."""
    after = np.append(spelled[1:], np.uint8(0))
    out = (spelled >= 0x1C) & (spelled <= 0x1F)
    for first, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        out |= (spelled == first) & np.isin(after, seconds)
    return out


def subwords(spelled: np.ndarray, sizes: np.ndarray, coder) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, first of each word and their number): a word is encoded with a space before it.

    All words go through one call, a line each. Words with other white space in them, which a line could join to its
    break, are encoded by themselves.
    """
    starts = np.cumsum(sizes) - sizes
    odd = np.logical_or.reduceat(_odd(spelled), starts) if len(sizes) else np.zeros(0, bool)
    plain = np.flatnonzero(~odd)
    lines = np.full(int((sizes[plain] + 2).sum()), 32, np.uint8)
    at = np.cumsum(sizes[plain] + 2) - sizes[plain] - 2
    lines[at] = 10
    lines[ragged(at + 2, sizes[plain])] = spelled[ragged(starts[plain], sizes[plain])]
    ids = coder.encode_to_numpy(lines.tobytes().decode()).astype(np.int32) if len(plain) else np.zeros(0, np.int32)
    marks = np.flatnonzero(ids == coder.encode_ordinary("\n")[0])
    numbers = np.zeros(len(sizes), np.int64)
    numbers[plain] = np.diff(np.append(marks, len(ids))) - 1
    own = {k: coder.encode_ordinary(" " + spelled[starts[k] : starts[k] + sizes[k]].tobytes().decode()) for k in np.flatnonzero(odd).tolist()}
    numbers[list(own)] = [len(x) for x in own.values()]
    firsts = np.concatenate([[0], np.cumsum(numbers)])
    out = np.zeros(int(firsts[-1]), np.int32)
    out[ragged(firsts[plain], numbers[plain])] = np.delete(ids, marks)
    for k, x in own.items():
        out[firsts[k] : firsts[k + 1]] = x
    return out, firsts


def _pack(numbers: np.ndarray) -> bytes:
    """The numbers' bytes, those of the same place together, compressed."""
    import zstandard

    return zstandard.compress(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes(), 1)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


_CODED = "block long, ids array<{kind}>, learn array<boolean>, n_words array<int>, n_subs array<int>, words binary, subs binary, keys array<long>, key_n array<long>, sub_keys array<int>, sub_n array<long>"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list each."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), kind))


@releasing
def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as numbers: a row for each slice of a block, and one with the block's distinct words and their numbers.

    A word's number is 1 and its place in the block's list of distinct words, most frequent first; 0 is the end of a text.
    """
    from pyspark import TaskContext

    coder, waiting, size, block = encoder(), [], 0, TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        texts, learn = string_array(table.column("t")), table.column("learn").to_numpy().astype(bool)
        bounds = [*slices(texts, SLICE_BYTES)]
        parts = [Words.of(texts[a:b]) for a, b in bounds]
        del texts
        release()
        hashes, at, inverse = distinct(np.concatenate([w.hashes for w in parts]))
        cuts = np.cumsum([len(w.hashes) for w in parts])
        inverse = np.split(inverse, cuts[:-1])
        met = sum(np.bincount(np.append(x, len(hashes))[w.sequence], minlength=len(hashes) + 1) for w, x in zip(parts, inverse, strict=True))
        order = np.argsort(-met[:-1], kind="stable")
        number = np.zeros(len(hashes) + 1, np.int64)
        number[order] = np.arange(1, len(hashes) + 1)
        # one spelling of each distinct word, in the order of their numbers
        spelled, sizes = np.concatenate([w.spelled for w in parts]), np.concatenate([w.sizes for w in parts])
        starts = (np.cumsum(sizes) - sizes)[at[order]]
        sizes = sizes[at[order]]
        ids, lengths = [np.full(1, END, np.int32)], [np.ones(1, np.int64)]
        for a in range(0, len(sizes), WORDS):  # what a call needs besides its result grows with its words
            of = slice(a, a + WORDS)
            some, bounds_of = subwords(spelled[ragged(starts[of], sizes[of])], sizes[of], coder)
            ids.append(some)
            lengths.append(np.diff(bounds_of))
        ids, firsts = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        del spelled, starts
        rows, n = [], np.zeros(len(hashes) + 1, np.int64)
        release()
        for (a, b), w, x in zip(bounds, parts, inverse, strict=True):
            sequence = number[np.append(x, len(hashes))[w.sequence]]
            lengths = np.diff(firsts)[sequence]
            ends = np.cumsum(w.counts + 1)
            n += np.bincount(sequence[np.repeat(learn[a:b], w.counts + 1)], minlength=len(n))
            n_subs = np.add.reduceat(lengths, ends - w.counts - 1)
            rows.append((learn[a:b], w.counts, n_subs, _pack(sequence.astype(np.uint32)), _pack(ids[ragged(firsts[sequence], lengths)].astype(np.uint16))))
        sub_n = np.bincount(ids, np.repeat(n, np.diff(firsts)), VOCABULARY + 1).astype(np.int64)
        used, k, none = np.flatnonzero(sub_n), len(rows), pa.nulls
        id_column = table.column("id").combine_chunks()
        cut = pa.array([*(a for a, _ in bounds), table.num_rows], pa.int32())
        slim = lambda j, kind: pa.concat_arrays([_lists([r[j] for r in rows], kind), none(1, pa.list_(kind))])
        wide = lambda x, kind: pa.concat_arrays([none(k, pa.list_(kind)), _lists([x], kind)])
        blob = lambda j: pa.array([*(r[j] for r in rows), None], pa.binary())
        columns = [
            pa.array(np.full(k + 1, block)), pa.concat_arrays([pa.ListArray.from_arrays(cut, id_column), none(1, pa.list_(id_column.type))]), slim(0, pa.bool_()), slim(1, pa.int32()), slim(2, pa.int32()),
            blob(3), blob(4), wide(hashes[order].view(np.int64), pa.int64()), wide(n[1:], pa.int64()), wide(used, pa.int32()), wide(sub_n[used], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "learn", "n_words", "n_subs", "words", "subs", "keys", "key_n", "sub_keys", "sub_n"])

    for batch in batches:
        # texts of a batch may be more than a block
        texts = string_array(batch.column(batch.schema.get_field_index("t")))
        for a, b in slices(texts, BLOCK_BYTES):
            waiting.append(batch.slice(a, b - a))
            size += sum(len(x) for x in raw(texts[a:b])[:1])
            if size >= BLOCK_BYTES // 2:
                yield flush()
                waiting, size, block = [], 0, block + 1
                release()
    if sum(b.num_rows for b in waiting):
        yield flush()


def before(values: np.ndarray, firsts: np.ndarray, places: int = 1) -> np.ndarray:
    """What stands so many places before each value of its text; 0, the class of the end, before the text's first."""
    out = np.concatenate([np.zeros(min(places, len(values)), values.dtype), values[:-places]])
    for k in range(places):
        out[np.minimum(firsts[:-1] + k, firsts[1:] - 1)] = 0
    return out


def cluster(rows: np.ndarray, weights: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """A group from 0 to k-1 of each row: weighted k-means of the rows' square roots."""
    x, n = np.sqrt(rows), len(rows)
    centres = x[np.argsort(-weights, kind="stable")[: min(k, n)]].copy()
    for _ in range(rounds):
        group = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        mass = np.bincount(group, weights, len(centres))
        for j in np.flatnonzero(mass):
            centres[j] = weights[group == j] @ x[group == j] / mass[j]
    return group


def topics(counts: np.ndarray, k: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(p(topic | row), p(column | topic)) by expectation-maximisation on counts."""
    r = np.random.Generator(np.random.PCG64(seed))
    z, o = r.random((len(counts), k)) + 0.5, r.random((k, counts.shape[1])) + 0.5
    z, o = z / z.sum(1, keepdims=True), o / o.sum(1, keepdims=True)
    for _ in range(rounds):
        share = counts / (z @ o + 1e-12)
        z, o = z * (share @ o.T), o * (z.T @ share)
        z, o = z + 1e-6 * (z.sum(1, keepdims=True) + 1e-9), o + 1e-6 * (o.sum(1, keepdims=True) / o.shape[1] + 1e-12)
        z, o = z / z.sum(1, keepdims=True), o / o.sum(1, keepdims=True)
    return z.astype(np.float32), o.astype(np.float32)


class Model:
    """p(subword | before) = p(class | before) by self-attention * p(subword | class) by counts over the corpus.

    Each place attends to the places of its window up to itself and to three more values that belong to itself. The
    values are distributions over the next class, all counted over the corpus: for a place of the window that of its
    subword's topics; for the place itself, what followed the same subword after a subword of the same kind, what
    followed the same subword, and how frequent classes are. p is their mean weighted by the softmax of the logits:
    query * key + distance for places, learned levels for the others.
    """

    def __init__(self, counts: np.ndarray, seed: int = 3):
        """``counts`` of each subword and, last, of the end."""
        n, head = len(counts), CLASSES - SHARED
        order = np.lexsort((np.arange(n), -counts))
        self.classes = np.empty(n, np.int64)
        order = np.concatenate([[END], order[order != END]])
        self.classes[order[:head]] = np.arange(min(head, n))
        mass = np.cumsum(counts[order[head:]] + 0.01)
        self.classes[order[head:]] = head + np.minimum(mass / mass[-1] * SHARED, SHARED - 1).astype(np.int64)
        smooth = counts + 0.01
        within = np.bincount(self.classes, smooth, CLASSES)
        self.inside = np.log(smooth / within[self.classes]).astype(np.float32)
        self.u = (within / within.sum()).astype(np.float32)
        self.small = False
        self.gather(np.zeros((3, CLASSES, CLASSES)))
        self.gather_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))
        r = np.random.Generator(np.random.PCG64(seed))
        init = lambda: (r.standard_normal((EMBEDDED + 1, WIDTH)) / math.sqrt(EMBEDDED)).astype(np.float32)
        self.w = {"q": init(), "k": init(), "distance": np.full(CONTEXT, -3, np.float32), "level": np.linspace(0, 3, LEVELS).astype(np.float32), "pair": np.zeros(CLASSES, np.float32), "own": np.zeros(CLASSES, np.float32), "none": np.full(1, -3, np.float32)}

    def gather(self, counts: np.ndarray) -> None:
        """``counts`` of (class, class that many places later): 1, 2 and FAR places."""
        self.next = counts[0].astype(np.float32)
        self.next_n = self.next.sum(1)
        smooth = counts[1] + 2 * self.u
        self.kind = cluster(smooth / smooth.sum(1, keepdims=True), self.u.astype(float), KINDS).astype(np.int64)
        # embeddings: what comes next, as the differences of singular vectors tell it
        left, size, _ = np.linalg.svd(np.sqrt((counts[0] + 2 * self.u) / (counts[0].sum(1, keepdims=True) + 2)) - np.sqrt(self.u), full_matrices=False)
        e = left[:, :EMBEDDED] * size[:EMBEDDED] * np.sign(left[np.abs(left).argmax(0), np.arange(len(size))])[:EMBEDDED]
        e = np.concatenate([np.clip(e / np.sqrt(self.u @ (e * e) + 1e-6), -3, 3), np.ones((CLASSES, 1))], 1)
        self.e = np.concatenate([e, np.zeros((1, e.shape[1]))]).astype(np.float32)  # the last row is for places before a text
        z, self.o = topics(counts[2] + 0.5 * self.u, TOPICS)
        self.z = np.zeros((CLASSES + 1, TOPICS + 1), np.float32)
        self.z[:-1, :-1], self.z[:-1, -1] = z, 1  # places before a text weigh nothing
        # the last column of either makes the products with both a sum of weights, or leave it out
        self.o_by_class = np.concatenate([self.o.T, np.zeros((CLASSES, 1), np.float32)], 1)

    def gather_pairs(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """``numbers`` of each (class * KINDS + kind of the one before it) * CLASSES + next class."""
        order = np.argsort(keys, kind="stable")
        self.pairs = _pack(np.diff(keys[order].astype(np.int32), prepend=np.int32(0))), _pack(numbers[order].astype(np.float32))
        self.name, self.dense = uuid.uuid4().hex, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts by state and next class, their sums by state, and the level of each sum."""
        if self.dense is None:
            found = _dense.get(self.name)
            if found is None:
                _dense.clear()  # one model at a time is in use
                keys, numbers = np.cumsum(_unpack(self.pairs[0], np.int32), dtype=np.int32), _unpack(self.pairs[1], np.float32)
                table = np.zeros(CLASSES * KINDS * CLASSES, np.float32)
                table[keys] = numbers
                n = np.bincount(keys // CLASSES, numbers, CLASSES * KINDS).astype(np.float32)
                _dense[self.name] = found = table, n, np.minimum(np.log2(n + 1), LEVELS - 1).astype(np.int64)
            self.dense = found
        return self.dense

    def states(self, classes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class before each place, and the state: that class with the kind of the one before it."""
        last = before(classes, firsts)
        return last, last * KINDS + self.kind.take(before(classes, firsts, 2))

    def own(self, x: np.ndarray, s: np.ndarray, y: np.ndarray, seen: int = 0) -> tuple:
        """Of each place: levels and values of what belongs to itself. ``seen`` 1: the place itself was counted, and is left out."""
        w, (table, n, level), u = self.w, self.values(), self.u.take(y)
        f = np.float32
        following = (np.maximum(self.next.reshape(-1).take(x * CLASSES + y) - f(seen), 0) + u * f(5)) / np.maximum(self.next_n.take(x) + f(5 - seen), 5)
        paired = (np.maximum(table.take(s * CLASSES + y) - f(seen), 0) + following * f(10)) / np.maximum(n.take(s) + f(10 - seen), 10)
        level = level.take(s)
        return level, np.exp(np.minimum(w["level"].take(level) + w["pair"].take(x), 30)), np.exp(np.minimum(w["own"], 30)).take(x), np.exp(np.minimum(w["none"][0], 30)), paired, following, u

    def ready(self, check: bool = True) -> None:
        """Queries and keys by class and what distances add, for the weights as they are.

        With ``check`` also whether no logit of a place can pass 40, so that none needs to be held there.
        """
        w = self.w
        self.queries, self.keys = self.e @ w["q"], self.e @ w["k"]
        apart = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)
        self.apart_by = np.abs(apart)  # what stands to the right weighs nothing and adds nothing
        self.apart = np.where(apart >= 0, w["distance"][self.apart_by], np.float32(-1e4))
        if check:
            self.small = float((self.queries @ self.keys.T).max()) + float(w["distance"].max()) < 40

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, keys, unscaled weights) of windows of classes: the last STRIDE places see themselves and those to their left."""
        q, k = self.queries.take(x[:, CONTEXT - STRIDE :], 0), self.keys.take(x, 0)
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        a += self.apart
        if not self.small:
            np.minimum(a, 40, out=a)
        np.exp(a, out=a)
        return q, k, a

    def logs(self, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Natural log probability of each id, scored once: ``ids`` of all texts, an end after each."""
        self.ready()
        y = self.classes.take(ids)
        x, s = self.states(y, firsts)
        upper, lower = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        for a in range(0, len(ids), 1 << 14):
            part = slice(a, a + (1 << 14))
            _, paired_e, own_e, none_e, paired, following, u = self.own(x[part], s[part], y[part])
            upper[part], lower[part] = paired_e * paired + own_e * following + none_e * u, paired_e + own_e + none_e
        rows = windows(firsts)
        for a in range(0, len(rows), BATCH):
            seen, at, used = places(rows[a : a + BATCH], x)
            got = self.attend(seen)[2] @ self.z.take(seen, 0)
            o = self.o_by_class.take(y.take(at), 0)
            at = at[used]
            upper[at] += np.einsum("nij,nij->ni", got, o)[used]
            lower[at] += got[..., -1][used]
        return np.log(upper / lower) + self.inside.take(ids)

    def flat(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([x.reshape(-1) for x in self.w.values()])

    def take(self, flat: np.ndarray) -> None:
        """The weights that ``flat`` of such a model gives."""
        cuts = np.cumsum([x.size for x in self.w.values()])[:-1]
        self.w = {n: x.reshape(self.w[n].shape).astype(np.float32, copy=False) for n, x in zip(self.w, np.split(flat, cuts), strict=True)}


#: The dense counts of the model in use, by its name; a worker serves several tasks.
_dense: dict[str, tuple] = {}


def windows(firsts: np.ndarray) -> np.ndarray:
    """Windows of texts: by column the text's first place, the first that the window tells, the text's end. Each place is told by one."""
    n = -(-np.diff(firsts) // STRIDE)
    text = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([firsts[:-1][text], firsts[:-1][text] + number * STRIDE, firsts[1:][text]], 1)


def places(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows: classes that their CONTEXT places see, the STRIDE places that they tell, and which of these are the text's.

    ``x`` is the class before each place. Windows overlap by CONTEXT - STRIDE places; before a text there is a class that weighs nothing.
    """
    first, begin, end = rows[:, :1], rows[:, 1:2], rows[:, 2:]
    at = begin + np.arange(STRIDE - CONTEXT, STRIDE)
    seen = x.take(at, mode="clip")
    seen[at < first] = CLASSES
    at = at[:, CONTEXT - STRIDE :]
    used = at < end
    return seen, np.minimum(at, len(x) - 1), used


class Trainer:
    """Fits a model's weights by Adam on windows of texts that its counts hold."""

    def __init__(self, model: Model, rate: float, seed: int = 4):
        self.model, self.rate, self.t, self.loss, self.n = copy.copy(model), rate, 0, 0.0, 0
        self.w = model.flat()
        self.model.take(self.w)  # from now on views of self.w
        self.m, self.s = np.zeros_like(self.w), np.zeros_like(self.w)
        self.r = np.random.Generator(np.random.PCG64(seed))

    def one_pass(self, classes: np.ndarray, firsts: np.ndarray) -> None:
        """Every window of the texts once, in another order."""
        if not len(classes):
            return
        x, s = self.model.states(classes, firsts)
        rows = windows(firsts)
        order = self.r.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            seen, at, used = places(rows[order[a : a + BATCH]], x)
            self.step(seen, s.take(at), classes.take(at), used)

    def step(self, seen: np.ndarray, s: np.ndarray, y: np.ndarray, used: np.ndarray) -> None:
        """One of Adam's steps on windows: classes of their places, states and classes of those to tell, and which of these are a text's."""
        model, n = self.model, int(used.sum())
        model.ready(self.t % 16 == 0)
        z, w, x = model.z.take(seen, 0), model.w, seen[:, CONTEXT - STRIDE :]
        q, k, a = model.attend(seen)
        got = a @ z
        o = model.o_by_class.take(y, 0)  # its last column is 0
        level, paired_e, own_e, none_e, paired, following, u = model.own(x, s, y, 1)
        upper = paired_e * paired + own_e * following + none_e * u + np.einsum("nij,nij->ni", got, o)
        lower = paired_e + own_e + none_e + got[..., -1]
        loss = -float(np.log(upper / lower)[used].sum())
        if not math.isfinite(loss):  # weights that grew too fast: from now on their logits are held
            model.small, self.t = False, self.t + 1
            return
        self.loss += loss
        self.n += n
        up, low = used / (upper * n), used / (lower * n)  # a logit's part is weight * (value * up - low)
        o *= up[..., None]
        o[..., -1] = -low
        da = o @ np.ascontiguousarray(z.transpose(0, 2, 1))
        da *= a
        flat = x.reshape(-1)
        d_pair, d_own = (paired_e * (paired * up - low)).reshape(-1), (own_e * (following * up - low)).reshape(-1)
        by_place, told = da.sum(0), CONTEXT - STRIDE
        e = model.e.take(seen, 0)
        d = np.empty((*seen.shape, 2 * WIDTH), np.float32)
        d[:, :told, :WIDTH] = 0
        d[:, told:, :WIDTH], d[..., WIDTH:] = da @ k, da.transpose(0, 2, 1) @ q
        some = math.gcd(len(seen), 4) * CONTEXT  # products of a few windows at a time: long thin ones are slow
        d = (e.reshape(-1, some, e.shape[-1]).transpose(0, 2, 1) @ d.reshape(-1, some, 2 * WIDTH)).sum(0)
        g = {
            "q": d[:, :WIDTH], "k": d[:, WIDTH:], "distance": np.bincount(model.apart_by.reshape(-1), by_place.reshape(-1), CONTEXT), "level": np.bincount(level.reshape(-1), d_pair, LEVELS),
            "pair": np.bincount(flat, d_pair, CLASSES), "own": np.bincount(flat, d_own, CLASSES), "none": np.array([(none_e * (u * up - low)).sum()]),
        }
        self.t += 1
        step = self.rate * min(1, self.t / 50) / math.sqrt(1 + self.t / 200)
        d = np.concatenate([g[name].reshape(-1) for name in w], dtype=np.float32, casting="same_kind")
        self.m += np.float32(0.1) * (d - self.m)
        self.s += np.float32(0.01) * (d * d - self.s)
        self.w += np.float32(step / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.s / np.float32(1 - 0.99**self.t)) + np.float32(1e-7))


def _learned(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(subword ids, firsts of the texts and the ids' number) of the texts that are learned from, by slice."""
    for row in range(batch.num_rows):
        learn, sizes = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (0, 1))
        ids = _unpack(batch.column(2)[row].as_py(), np.uint16)
        yield ids[np.repeat(learn, sizes)], np.concatenate([[0], np.cumsum(sizes[learn], dtype=np.int64)])


def fit(coded: DataFrame, counts: np.ndarray, tasks: int) -> tuple[Model, float | None, int]:
    """A model of all texts that are learned from; the mean loss of the last pass, and the number of subwords it saw.

    Two passes count what the values are made of. The weights start from the texts of one block; from there each task
    makes one pass over all windows of its texts, and the tasks' weights are averaged by their numbers of subwords.
    All passes are maps; a task's counts, at most CLASSES * KINDS * CLASSES, are shuffled in packed ranges and summed by range.
    """
    model = Model(counts)
    slim = coded.where("subs is not null").select("learn", "n_subs", "subs")
    wide = slim.coalesce(tasks)

    def summed(tally, size: int) -> np.ndarray:
        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for ids, firsts in _learned(batch):
                    if len(ids):
                        total = tally(model, model.classes.take(ids), firsts, total)
            if total is not None:
                yield from _ranges({k: total[k * RANGE : (k + 1) * RANGE] for k in range(-(-len(total) // RANGE))})

        packed = wide.mapInArrow(run, "range long, counts binary").repartition("range")
        total = np.zeros(size, np.int64)
        for k, counts in _unpacked(packed.mapInArrow(_sum_ranges, packed.schema).toArrow()):
            total[k * RANGE : (k + 1) * RANGE] += counts
        return total

    model.gather(summed(_tally, 3 * CLASSES * CLASSES).reshape(3, CLASSES, CLASSES).astype(float))
    pairs = summed(_tally_pairs, CLASSES * KINDS * CLASSES)
    keys = np.flatnonzero(pairs)
    model.gather_pairs(keys, pairs[keys])
    del pairs, keys

    @releasing
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, texts = Trainer(model, RATES[0]), [x for batch in batches for x in _learned(batch)]
        while texts and trainer.t < STEPS and any(len(ids) for ids, _ in texts):
            trainer.n, trainer.loss = 0, 0.0
            for ids, firsts in texts:
                trainer.one_pass(model.classes.take(ids), firsts)
        yield _weights(trainer)

    @releasing
    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model, RATES[1])
        for batch in batches:
            for ids, firsts in _learned(batch):
                trainer.one_pass(model.classes.take(ids), firsts)
        yield _weights(trainer)

    least = coded.where("exists(learn, x -> x)").agg(F.min("block")).first()[0]
    if least is None:
        return model, None, 0
    schema = "n long, loss double, w array<double>"
    model.take(np.mean([r.w for r in coded.where((F.col("block") == least) & F.col("subs").isNotNull()).select("learn", "n_subs", "subs").coalesce(1).mapInArrow(start, schema).collect()], axis=0))
    passed = wide.mapInArrow(one_pass, schema).where("n > 0")
    # summed by place in the row, so that the driver gets one row of weights whatever the number of tasks
    place = passed.select("n", "loss", F.posexplode("w").alias("place", "w"))
    sums = place.groupBy("place").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).toArrow().sort_by("place")
    model.take(sums.column("w").to_numpy() / sums.column("n").to_numpy())
    n = sums.column("n")[0].as_py()
    return model, sums.column("loss")[0].as_py() / n, n


def _unpacked(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a range, its counts) of each row."""
    for k, counts in zip(rows.column("range").to_pylist(), rows.column("counts"), strict=True):
        yield k, _unpack(counts.as_py(), np.int64)


def _ranges(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each range that has counts."""
    for k, x in counts.items():
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_pack(x.astype(np.int64))], pa.binary())], ["range", "counts"])


@releasing
def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each range as one: all of a range come to one task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in _unpacked(batch):
            sums[k] = sums[k] + counts if k in sums else counts
    yield from _ranges(sums)


def _weights(trainer: Trainer) -> pa.RecordBatch:
    w = pa.array([trainer.model.flat().astype(np.float64)], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([trainer.n]), pa.array([trainer.loss]), w], ["n", "loss", "w"])


def _tally(model: Model, y: np.ndarray, firsts: np.ndarray, total: np.ndarray | None) -> np.ndarray:
    """Adds how often each class stands 1, 2 and FAR places after each."""
    size = CLASSES * CLASSES
    total = np.zeros(3 * size, np.int64) if total is None else total
    for k, places in enumerate((1, 2, FAR)):
        total[k * size : (k + 1) * size] += np.bincount(before(y, firsts, places) * CLASSES + y, minlength=size)
    return total


def _tally_pairs(model: Model, y: np.ndarray, firsts: np.ndarray, total: np.ndarray | None) -> np.ndarray:
    """Adds how often each class follows each state."""
    size = CLASSES * KINDS * CLASSES
    total = np.zeros(size, np.uint32) if total is None else total  # a task's texts have fewer than 2**32 subwords
    np.add.at(total, model.states(y, firsts)[1] * CLASSES + y, np.uint32(1))  # as many counts as a table has would be slow
    return total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> tuple[DataFrame, dict]:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, n_subwords, score; and what was learned.

    ``score`` is the log10 probability of the text by the attention model (``Model``). Texts outside the held-out fold
    are learned from, all of them and whole: subword counts give the classes, counts of neighbours the values, and the
    weights are fitted on every window, see ``fit``.

    Texts are read and encoded once, in a map, and written as numbers. Each block of about 16 MB has a list of its
    distinct words (64-bit hashes) with their numbers; these are summed by word, and the sums go back to the blocks, so
    that a word is shuffled once for each block, not for each occurrence.

    Null texts count as empty: only the end. Null ids: learned from, not held out. Repeated rows count as often as they come.
    Empty input: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t"), F.coalesce(fold(id_col, folds) != held, F.lit(True)).alias("learn"))
    kind = dict(base.dtypes)["id"]
    coded = materialise(base.mapInArrow(_code, _CODED.format(kind=kind)), "lm-coded")
    lists = coded.where("keys is not null")
    subs = np.zeros(VOCABULARY + 1, np.int64)
    by_sub = lists.select(F.inline(F.arrays_zip("sub_keys", "sub_n"))).groupBy("sub_keys").agg(F.sum("sub_n").alias("n"))
    for r in by_sub.collect():  # at most one row per subword
        subs[r.sub_keys] = r.n
    words = lists.select(F.inline(F.arrays_zip("keys", "key_n"))).groupBy("keys").agg(F.sum("key_n").alias("c")).where("c > 0")
    words = materialise(words, "lm-words")
    known = words.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    ends = int(subs[END])
    # the end is a token, too
    train_tokens, types = int(known.n or 0) + ends, int(known.v) + (ends > 0)
    blocks = lists.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, blocks // 4)
    model, loss, fitted = fit(coded, subs, tasks)

    @releasing
    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                sizes = one.column(5)[0].values.to_numpy()
                ids, firsts = _unpack(one.column(6)[0].as_py(), np.uint16), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                logs = np.add.reduceat(model.logs(ids, firsts).astype(np.float64), firsts[:-1]) / math.log(10)
                yield pa.RecordBatch.from_arrays([*one.columns[:6], _lists([logs], pa.float64())], ["block", "ids", "learn", "n_words", "words", "n_subs", "score"])

    unseen = math.log10(1 / (train_tokens + types + 1))

    def rated(left: pa.Table, right: pa.Table) -> pa.Table:
        # c by a word's number in the block: 0 is the end, words without a row were never learned
        at, c = right.column("pos").to_numpy() + 1, right.column("c").to_numpy()
        by_number = np.zeros(int(at.max(initial=0)) + 1, np.int64)
        by_number[at] = c
        by_number[0] = ends
        out = []
        for row in range(left.num_rows):
            value = lambda name: left.column(name)[row].values  # noqa: B023, E731
            sequence, n = _unpack(left.column("words")[row].as_py(), np.uint32), value("n_words").to_numpy() + 1
            firsts = np.cumsum(n, dtype=np.int64) - n
            inside = sequence < len(by_number)
            c = np.where(inside, by_number[np.where(inside, sequence, 0)], 0)
            base_score = np.add.reduceat(np.log10(c + 1.0), firsts) + n * unseen
            held_out = ~value("learn").to_numpy(zero_copy_only=False)
            n_known = np.add.reduceat((c > 0).astype(np.int64), firsts)
            columns = [value("ids"), held_out, n.astype(np.int64), n_known, np.full(len(n), train_tokens), base_score, value("n_subs").cast(pa.int64()), value("score")]
            out.append(pa.table([pa.array(x) for x in columns], names=names))
        return pa.concat_tables(out)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = rated(left, right)
        release()
        return out

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "n_subwords", "score"]
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, n_subwords long, score double"
    attended = f"block long, ids array<{kind}>, learn array<boolean>, n_words array<int>, words binary, n_subs array<int>, score array<double>"
    scored = coded.where("subs is not null").select("block", "ids", "learn", "n_words", "words", "n_subs", "subs").mapInArrow(attend, attended)
    pairs = lists.select("block", F.posexplode("keys").alias("pos", "keys")).join(words, "keys").select("block", "pos", "c")
    # a block without a learned word has no counts, but its texts are scored
    out = scored.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(rate, schema)
    return out.withColumnRenamed("id", id_col), {"loss": loss, "fitted": fitted, "train_tokens": train_tokens, "types": types, "model": model}


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))[0]
