"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions, each with a context tree of its own over the DEPTH bytes before. A node
estimates its bit by Krichevsky-Trofimov from the zeros and ones that training documents have there; the weighted
probability of a node is half its own block probability plus half the product of its children's. Both depend on
counts only, so the tree of a whole corpus comes from counts of (DEPTH + 1)-grams, added up in any order. The
predictive probability of a bit is then the estimates of all depths on its path, each with the weight that is left
to it by the shallower ones; the model is frozen while it scores.

Nothing here is held by one task or the driver but nodes of two bytes of context or less, of which there are
65,793 times 255 at most whatever the corpus.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import LOWER, U64, Block, Words, bucket_of, cut, mix64, pack, width, with_answers

DEPTH = 5
TOP = 2
BLOCK = 8 << 20
FOLDS, HELD = 7, 2
_PAD = b"\n" * DEPTH
_LOG_HALF = math.log(0.5)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def stream(words: list[bytes]) -> bytes:
    """The bytes that are coded: each word and a space, then the end."""
    return b" ".join(words) + b" \n" if words else b"\n"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function, x > 0: Stirling's series at x + 8, and the recurrence back."""
    y = x + 8
    i = 1 / (y * y)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Block probability, as a logarithm, that the estimator gives to so many zeros and ones in any order."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def parents(nodes: np.ndarray, depth: int) -> np.ndarray:
    """A node is context << 8 | place among the bits of a byte; its parent of ``depth`` bytes drops the oldest byte."""
    return (nodes >> 8 & ((1 << 8 * depth) - 1)) << 8 | nodes & 255


class Level:
    """Nodes of one depth with their counts, block and weighted probabilities."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.weighted, self.share = own, np.ones(len(nodes))
        else:
            self.weighted = _LOG_HALF + np.logaddexp(own, below)
            self.share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    @classmethod
    def of(cls, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[Level, np.ndarray]:
        """Adds up rows of equal nodes; also where each row went."""
        found, place = np.unique(nodes, return_inverse=True)
        add = lambda v: np.bincount(place, v, len(found))
        return cls(found, add(zeros), add(ones), None if below is None else add(below)), place

    def up(self, depth: int) -> tuple[Level, np.ndarray]:
        return Level.of(parents(self.nodes, depth), self.zeros, self.ones, self.weighted)

    def down(self, zero: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From what shallower depths give to a zero bit, and the weight they leave, to the same with this depth."""
        own = (self.zeros + 0.5) / (self.zeros + self.ones + 1)
        return zero + left * self.share * own, left * (1 - self.share)


class Tree:
    """The part of the context trees below some contexts of TOP + 1 bytes: all grams that end in them."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        byte, context = (grams & 255).astype(np.int64), (grams >> 8).astype(np.int64)
        level = np.arange(8)
        nodes = context[:, None] << 8 | 1 << level | byte[:, None] >> 8 - level
        self.bit = byte[:, None] >> 7 - level & 1
        n = np.repeat(counts.astype(np.float64), 8)
        flat = self.bit.ravel()
        deepest, self.leaf = Level.of(nodes.ravel(), n * (1 - flat), n * flat, None)
        self.levels, self.places = [deepest], []
        for depth in range(DEPTH - 1, TOP, -1):
            upper, place = self.levels[-1].up(depth)
            self.levels.append(upper)
            self.places.append(place)

    def log10(self, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Log10 probability of each gram's last byte after the others."""
        nodes, zero, left = top
        at = np.searchsorted(nodes, parents(self.levels[-1].nodes, TOP))
        zero, left = self.levels[-1].down(zero[at], left[at])
        for level, place in zip(self.levels[-2::-1], self.places[::-1]):
            zero, left = level.down(zero[place], left[place])
        zero = zero[self.leaf].reshape(self.bit.shape)
        return np.log10(np.where(self.bit == 0, zero, 1 - zero)).sum(axis=1)


def top_of(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of TOP bytes of context, with what all depths down to theirs give to a zero bit, and the weight left."""
    levels, places = [Level.of(nodes, zeros, ones, below)[0]], []
    for depth in range(TOP - 1, -1, -1):
        upper, place = levels[-1].up(depth)
        levels.append(upper)
        places.append(place)
    zero, left = levels[-1].down(np.zeros(len(levels[-1].nodes)), np.ones(len(levels[-1].nodes)))
    for level, place in zip(levels[-2::-1], places[::-1]):
        zero, left = level.down(zero[place], left[place])
    return levels[0].nodes, zero, left


class _Grams:
    """Distinct grams of a block, in the order in which buckets are asked, and the words likewise."""

    def __init__(self, block: Block, buckets: int):
        lowered = [t.translate(LOWER) for t in block.texts]
        self.held = np.array([held_out(None if i == Block.NO_ID else i) for i in block.ids.tolist()], bool)
        streams = [stream(t.split()) for t in lowered]
        self.sizes = np.array([len(s) for s in streams], np.int64)
        joined = np.frombuffer(_PAD + _PAD.join(streams), np.uint8)
        ends = np.cumsum(self.sizes + DEPTH)
        grams = np.zeros(len(joined) - DEPTH, U64)
        for k in range(DEPTH + 1):
            grams <<= U64(8)
            grams |= joined[k : len(joined) - DEPTH + k]
        inside = np.ones(len(grams), bool)  # grams that end in padding are no events
        for e in ends[:-1].tolist():
            inside[e - DEPTH : e] = False
        self.grams = grams[inside]
        self.words = Words(lowered)
        self.buckets = buckets

    def word_order(self) -> tuple[np.ndarray, np.ndarray]:
        slots = bucket_of(self.words.hashes()[0], self.buckets) if self.words.vocab else np.zeros(0, np.int64)
        order = np.argsort(slots, kind="stable")
        return order, np.searchsorted(slots[order], np.arange(self.buckets + 1))

    def word_counts(self) -> np.ndarray:
        training = np.repeat(~self.held, np.diff(self.words.starts))
        return np.bincount(self.words.ids[training], minlength=len(self.words.vocab))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other: these compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _pairs(keys: np.ndarray, values: np.ndarray, rest: bytes = b"") -> bytes:
    """Ascending 64-bit keys as differences, their values, and more bytes, compressed."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return zstandard.ZstdCompressor(level=3).compress(len(keys).to_bytes(8, "little") + _planes(steps) + _planes(values) + rest)


def _unpair(body: bytes, value: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n = int.from_bytes(data[:8], "little")
    keys = np.cumsum(_unplanes(data, "<u8", n, 8), dtype="<u8")
    return keys, _unplanes(data, value, n, 8 + 8 * n), data[8 + n * (8 + np.dtype(value).itemsize) :]


def _ask(buckets: int):
    def ask(block: Block) -> list[bytes]:
        g = _Grams(block, buckets)
        marked = g.grams
        del g.grams  # the largest array of a block: changed in place
        marked <<= U64(1)
        np.bitwise_or(marked, np.repeat(g.held, g.sizes), out=marked)
        marked, n = np.unique(marked, return_counts=True)
        grams, place = np.unique(marked >> U64(1), return_inverse=True)
        counts = np.bincount(place, n * (marked & U64(1) == 0), len(grams)).astype("<u4")
        slots = bucket_of(mix64(grams >> U64(8)), buckets)
        order = np.argsort(slots, kind="stable")
        edges = np.searchsorted(slots[order], np.arange(buckets + 1))
        grams, counts = grams[order], counts[order]
        word_order, word_edges = g.word_order()
        word_counts, vocab = g.word_counts(), g.words.vocab
        out = []
        for s in range(buckets):
            i, j = edges[s : s + 2]
            own = word_order[word_edges[s] : word_edges[s + 1]]
            words = _planes(word_counts[own].astype("<u4")) + b"\n".join([vocab[k] for k in own.tolist()])
            out.append(_pairs(grams[i:j], counts[i:j], len(own).to_bytes(8, "little") + words) if j > i or len(own) else b"")
        return out

    return ask


def _words(rest: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int.from_bytes(rest[:8], "little")
    return _unplanes(rest, "<u4", n, 8), rest[8 + 4 * n :].split(b"\n") if n else []


def _totals(bodies: list[bytes]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for body in bodies:
        counts, words = _words(_unpair(body, "<u4")[2])
        for w, c in zip(words, counts.tolist()):
            found[w] = found.get(w, 0) + c
    return found


def _by(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    slots = bucket_of(mix64(keys), buckets)
    order = np.argsort(slots, kind="stable")
    return order, np.searchsorted(slots[order], np.arange(buckets + 1))


def _rows(slot: list[int], body: list[bytes], **more: list) -> pa.Table:
    return pa.table({"slot": pa.array(slot, pa.int32()), "body": pa.array(body, pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in more.items()})


_MERGED = "slot int, body binary, n long, v long"


def _merge(buckets: int):
    """Adds up what blocks count in one bucket; grams go on to the bucket of their last three context bytes."""

    def run(t: pa.Table) -> pa.Table:
        bodies = [x.as_py() for x in t.column("body")]
        parts = [_unpair(b, "<u4")[:2] for b in bodies]
        grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(grams)).astype("<u8")
        order, edges = _by(grams >> U64(8) & U64((1 << 8 * (TOP + 1)) - 1), buckets)  # stable: grams ascend in each
        grams, counts = grams[order], counts[order]
        words = _totals(bodies)
        filled = [s for s in range(buckets) if edges[s + 1] > edges[s]]
        out = [_pairs(grams[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]) for s in filled]
        zeros = [0] * len(filled)
        return _rows([*filled, -1], [*out, b""], n=[*zeros, sum(words.values())], v=[*zeros, sum(c > 0 for c in words.values())])

    return run


def _tree(t: pa.Table) -> Tree:
    parts = [_unpair(x.as_py(), "<u8")[:2] for x in t.column("body")]
    return Tree(np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]))


_NODE = np.dtype([("node", "<i8"), ("zeros", "<f8"), ("ones", "<f8"), ("below", "<f8")])


def _grow(buckets: int):
    """Sums for the nodes of TOP bytes above one bucket's tree."""

    def run(t: pa.Table) -> pa.Table:
        low = _tree(t).levels[-1]
        up, place = np.unique(parents(low.nodes, TOP), return_inverse=True)
        rows = np.zeros(len(up), _NODE)
        rows["node"] = up
        for name, v in (("zeros", low.zeros), ("ones", low.ones), ("below", low.weighted)):
            rows[name] = np.bincount(place, v, len(up))
        order, edges = _by(up.astype(U64), buckets)
        filled = [s for s in range(buckets) if edges[s + 1] > edges[s]]
        return _rows(filled, [rows[order[edges[s] : edges[s + 1]]].tobytes() for s in filled])

    return run


def _gather(t: pa.Table) -> pa.Table:
    rows = np.concatenate([np.frombuffer(x.as_py(), _NODE) for x in t.column("body")])
    nodes, place = np.unique(rows["node"], return_inverse=True)
    out = np.zeros(len(nodes), _NODE)
    out["node"] = nodes
    for name in ("zeros", "ones", "below"):
        out[name] = np.bincount(place, rows[name], len(nodes))
    return _rows([0], [out.tobytes()])


def _predict(buckets: int, top):
    """Log10 probabilities of the grams of one bucket's tree, sent back to the buckets that blocks ask."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpair(x.as_py(), "<u8")[:2] for x in t.column("body")]
        grams, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        ascending = np.argsort(grams)
        grams, counts = grams[ascending], counts[ascending]
        scores = Tree(grams.astype(np.int64), counts).log10(top.value).astype("<f4")
        order, edges = _by(grams >> U64(8), buckets)
        grams, scores = grams[order], scores[order]
        filled = [s for s in range(buckets) if edges[s + 1] > edges[s]]
        return _rows(filled, [_pairs(grams[edges[s] : edges[s + 1]], scores[edges[s] : edges[s + 1]]) for s in filled])

    return run


def _reply(asked: pa.Table, known: pa.Table) -> pa.Table:
    """To each block, the scores of its grams and the training counts of its words, in its own order."""
    bodies = [x.as_py() for x in asked.column("body")]
    parts = [_unpair(x.as_py(), "<f4")[:2] for x in known.column("body")]
    grams, scores = (np.concatenate([p[k] for p in parts] or [np.zeros(0, "<u8")]) for k in (0, 1))
    order = np.argsort(grams)
    grams, scores = grams[order], scores[order]
    totals, out = _totals(bodies), []
    for body in bodies:
        own, _, rest = _unpair(body, "<u4")
        counts = np.array([totals[w] for w in _words(rest)[1]], "<u8")
        replies = _planes(scores[np.searchsorted(grams, own)]) + _planes(counts)
        out.append(zstandard.ZstdCompressor(level=3).compress(len(own).to_bytes(8, "little") + replies))
    return pa.table({"block": asked.column("block"), "slot": asked.column("slot"), "body": pa.array(out, pa.binary())})


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _finish(buckets: int, training: int, n: int, v: int):
    ends = training
    tokens, kinds = n + ends, v + (ends > 0)

    def use(number: int, block: Block, replies: dict[int, bytes]) -> pa.Table:
        g = _Grams(block, buckets)
        grams = np.unique(g.grams)
        scores, counts = [], []
        for body in replies.values():
            data = zstandard.ZstdDecompressor().decompress(body)
            k = int.from_bytes(data[:8], "little")
            scores.append(_unplanes(data, "<f4", k, 8))
            counts.append(_unplanes(data, "<u8", (len(data) - 8 - 4 * k) // 8, 8 + 4 * k))
        by_gram = np.empty(len(grams))
        by_gram[np.argsort(bucket_of(mix64(grams >> U64(8)), buckets), kind="stable")] = np.concatenate(scores)
        parts = range(0, len(g.grams), 1 << 20)
        at_each = np.concatenate([by_gram[np.searchsorted(grams, g.grams[k : k + (1 << 20)])] for k in parts])
        score = np.add.reduceat(at_each, np.cumsum(g.sizes) - g.sizes)
        by_word = np.zeros(len(g.words.vocab), np.int64)
        by_word[g.word_order()[0]] = np.concatenate(counts)
        sizes = np.diff(g.words.starts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        logs = np.log10((by_word + 1) / (tokens + kinds + 1))
        base = np.bincount(doc, logs[g.words.ids], len(sizes)) + math.log10((ends + 1) / (tokens + kinds + 1))
        known = np.bincount(doc, by_word[g.words.ids] > 0, len(sizes)).astype(np.int64) + (ends > 0)
        ids = pa.array([None if i == Block.NO_ID else i for i in block.ids.tolist()], pa.int64())
        columns = [ids, pa.array(g.held), pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), tokens, np.int64))]
        columns += [pa.array(base), pa.array(score), pa.array(g.sizes)]
        return pa.table(columns, names=[c.split()[0] for c in _SCORES.split(", ")])

    return use


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row; the key is an integer.

    Texts are lower-cased (A to Z) and coded as words, each with a space, and an end. ``score`` is the log10
    probability of those n_bytes bytes under the tree of all rows that aren't held out (crc32 of the key's text
    modulo 7 is not 2), so -score / log10(2) / n_bytes is the code length in bits a byte. ``base_score`` is the
    add-one word model's. A null text has an end only; a null key counts as ''. Rows with equal keys all count. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = width(docs, text)
    blocks = pack(docs, key, text, block_bytes, _ask(buckets))
    asked = blocks.filter("slot >= 0").select("block", "slot", "body")
    merged = cut(asked.groupBy("slot").applyInArrow(_merge(buckets), _MERGED))
    n, v = merged.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    name = F.coalesce(docs[key].cast("string"), F.lit(""))
    training = docs.filter(F.crc32(name) % FOLDS != HELD).count()

    grams = merged.filter("slot >= 0").select("slot", "body")
    sums = cut(grams.groupBy("slot").applyInArrow(_grow(buckets), "slot int, body binary").groupBy("slot").applyInArrow(_gather, "slot int, body binary"))
    # Of TOP bytes of context there are 65,793 times 255 nodes of 32 bytes at most (535 MB), whatever the corpus, and far fewer in
    # texts in UTF-8, as most pairs of bytes never occur. They come to the driver a partition at a time.
    some = sums.select("body").toLocalIterator()
    rows = np.concatenate([np.zeros(0, _NODE), *(np.frombuffer(bytes(r["body"]), _NODE) for r in some)])
    top = spark.sparkContext.broadcast(top_of(rows["node"], rows["zeros"], rows["ones"], rows["below"]) if len(rows) else None)
    known = grams.groupBy("slot").applyInArrow(_predict(buckets, top), "slot int, body binary")
    replies = asked.groupBy("slot").cogroup(known.groupBy("slot")).applyInArrow(_reply, "block long, slot int, body binary")
    return with_answers(blocks, replies, _finish(buckets, training, n, v), _SCORES).withColumnRenamed("id", key)
