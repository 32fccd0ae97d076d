"""Alignment of two tokenizers' token ends by merge path, and how often id pairs overlap corpus-wide.

Both token sequences of a text cover the same bytes, so each is a rising list of end offsets. Merging the two lists gives
everything: each step from one end to the next is one overlap of an A and a B token, and an end that both have closes a
group. The merge of a whole run of texts is cut along diagonals of its path, each found by a binary search, into pieces of
equal work that know where they start in either list and need nothing of each other; they advance in step, one array
operation for all. A piece's first step looks at the end that the piece before it closed with, and groups that cross pieces are
stitched by a running count of the closes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.bpe import SPLIT, codec
from tidemill.llm.common import cut, each_run, utf8

#: Steps of the merge that one piece does.
WORK = 64
#: Bytes of text that are merged at once.
RUN = 4 << 20
#: Units that a worker remembers the tokens of; beyond, it starts anew with the next run.
REMEMBER = 500_000
#: Bytes of units that are encoded at once.
BATCH = 1 << 15
#: An id pair as one number: A's id times this, plus B's.
PAIR = 1 << 20
_NEVER = np.iinfo(np.int64).max
_SMALL = np.zeros(256, bool)
_SMALL[[*range(9, 14), *range(28, 33)]] = True
# Last bytes, and bytes before them, of white space beyond ASCII in UTF-8 (U+0085 to U+3000).
_LAST, _MIDDLE, _FIRST = (np.isin(np.arange(256), x) for x in ([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0x80, 0x81, 0x9A], [0xE1, 0xE2, 0xE3]))


def units(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units start in texts one after another, each led by a space: at every text, and at spaces and line ends after
    anything but white space. No token of either kind crosses these: words of A hold white space at their front only, so do
    pieces of B."""
    before = data[:-1]
    white = _SMALL[before].copy()
    if (far := np.flatnonzero(_LAST[before])).size:
        two, three = data[np.maximum(far - 1, 0)], data[np.maximum(far - 2, 0)]
        white[far] |= (two == 0xC2) | (_MIDDLE[two] & _FIRST[three])
    starts = np.zeros(len(data), bool)
    starts[1:] = ((data[1:] == 32) | (data[1:] == 10)) & ~white
    starts[edges[:-1]] = True
    return np.flatnonzero(starts)


class Tokens:
    """Ids and sizes in bytes of the tokens of units, one unit after another: unit k has those from starts[k] on."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Appends units, given as (ids, sizes, tokens of each unit)."""
        ids, sizes, counts = (np.concatenate([r[k] for r in runs]) for k in range(3))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))

    def of(self, uses: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and end offsets over a row of units, and the first token of each text that starts at a unit of ``firsts``."""
        counts = self.starts[uses + 1] - self.starts[uses]
        done = np.concatenate(([0], np.cumsum(counts)))
        places = np.arange(done[-1]) + np.repeat(self.starts[uses] - done[:-1], counts)
        return self.ids[places], np.cumsum(self.sizes[places]), done[firsts]


class Tokenizers:
    """Tokens of units by both tokenizers: a byte-level one (A), and one of pieces that puts a space in front (B). What was
    met before is remembered."""

    def __init__(self, vocabulary: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        a = codec(vocabulary)
        self.bytes_a = {i: b for i, b in a.bytes.items() if i not in a.added.values()}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={b: i for i, b in self.bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces if "/" in pieces else str(public_tokenizers.path(pieces)))
        strings = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in strings):
            raise ValueError("pieces with white space that is not in front can't be aligned by units")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(strings)]
        n = max(max(self.bytes_a) + 1, len(strings))
        self.size_a, self.size_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.size_a[list(self.bytes_a)] = [len(b) for b in self.bytes_a.values()]
        self.size_b[: len(strings)] = [len(b) for b in self.bytes_b]
        self.names = [np.array([f"{i}{end}" for i in range(n)], object) for end in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tokens, self.bad = (Tokens(), Tokens()), set()

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a row of units. The line end in front keeps B from adding a space that the text has already."""
        return self.a.encode_ordinary(text), self.b.encode("\n" + text)[2:]

    def learn(self, found: list[bytes]) -> None:
        """Encodes units, many at once where each ends without white space, so that they part as in a text."""
        batches: list[list[bytes]] = [[]]
        size = 0
        for u in found:
            alone = u[-1] <= 32 or u[-1] >= 128 and u.decode()[-1].isspace()
            if alone or size > BATCH:
                batches.append([])
                size = 0
            batches[-1].append(u)
            size += BATCH + 1 if alone else len(u)
        runs: tuple[list, list] = ([], [])
        for batch in filter(None, batches):
            self._learn(batch, runs)
        for tokens, own in zip(self.tokens, runs):
            if own:
                tokens.add(own)

    def _learn(self, found: list[bytes], runs: tuple[list, list]) -> None:
        joined = b"".join(found)
        a, b = (np.array(x, np.int64) for x in self.encode(joined.decode()))
        good = b"".join([self.bytes_b[i] for i in b.tolist()]) == joined
        if not good and len(found) > 1:
            for u in found:
                self._learn([u], runs)
            return
        ends = np.cumsum([len(u) for u in found])
        for own, ids, sizes, whole in ((runs[0], a, self.size_a[a], True), (runs[1], b, self.size_b[b], good)):
            at = np.searchsorted(np.cumsum(sizes), ends, "right") if whole else np.array([len(ids)])
            own.append((ids, sizes, np.diff(at, prepend=0)))
        if not good:
            self.bad.add(len(self.known))
        for u in found:
            self.known[u] = len(self.known)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """Where the tokens of distinct units are."""
        if len(self.known) > REMEMBER:
            self.forget()
        known = self.known
        self.learn([u for u in found if u not in known])
        return np.array([known[u] for u in found], np.int64)


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` steps of the merge of two rising lists take from ``a`` (which goes first at ties)."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        first = a[mid] <= b[at[open_] - 1 - mid]
        low[open_[first]], high[open_[~first]] = mid[first] + 1, mid[~first]
    return low


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge of two lists of end offsets with one last end: for each step the index in a and in b, whether it takes from a,
    and whether it closes a group (an end that was there before)."""
    total = len(a) + len(b)
    at = np.arange(0, total, work)
    i = diagonals(a, b, at)
    j = at - i
    before = np.maximum(np.where(i > 0, a[i - 1], 0), np.where(j > 0, b[j - 1], 0))
    x, y = np.append(a, _NEVER), np.append(b, _NEVER)
    shape = (work, len(at))
    of_a, of_b, takes, closes = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool), np.zeros(shape, bool)
    for k in range(work):
        of_a[k], of_b[k] = i, j
        p, q = x[i], y[j]
        take = p <= q
        end = np.where(take, p, q)
        takes[k], closes[k] = take, end == before
        before, i, j = end, np.minimum(i + take, len(a)), np.minimum(j + ~take, len(b))
    return tuple(m.T.reshape(-1)[:total] for m in (of_a, of_b, takes, closes))


class Run:
    """A run of texts, aligned: numbers of each text, its digest of groups, and the id pair of every link."""

    def __init__(self, texts: list[bytes], tokenizers: Tokenizers, work: int = WORK):
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.starts = (np.zeros(n + (k == 3), np.int64) for k in range(4))
        self.digests, self.pairs = [""] * n, np.zeros(0, np.int64)
        some = [k for k, t in enumerate(texts) if t]
        if not some:
            return
        uses, firsts, good = self.read([b" " + texts[k] for k in some], tokenizers)
        kept = [k for k, g in zip(some, good) if g]
        if not kept:
            return
        if len(kept) < len(some):
            uses = uses[np.repeat(good, np.diff(firsts))]
            firsts = np.concatenate(([0], np.cumsum(np.diff(firsts)[good])))
        (ids_a, ends_a, starts_a), (ids_b, ends_b, starts_b) = (t.of(uses, firsts) for t in tokenizers.tokens)
        of_a, of_b, takes, closes = merge(ends_a, ends_b, work)
        group = np.cumsum(closes) - closes
        group_a, group_b = group[takes], group[~takes]
        link = ~closes
        self.pairs = ids_a[of_a[link]] * PAIR + ids_b[of_b[link]]
        per_text = np.concatenate(([0], np.cumsum(link)))[starts_a + starts_b]
        self.n_a[kept], self.n_b[kept] = np.diff(starts_a), np.diff(starts_b)
        counts = np.zeros(n, np.int64)
        counts[kept] = np.diff(per_text)
        self.starts[1:] = np.cumsum(counts)
        self.n_groups[kept] = self.n_a[kept] + self.n_b[kept] - counts[kept]
        said = self.say(ids_a, ids_b, group_a, group_b, tokenizers.names)
        for k, s, e in zip(kept, (starts_a + starts_b).tolist(), (starts_a + starts_b)[1:].tolist()):
            self.digests[k] = hashlib.sha256("".join(said[s:e].tolist())[:-1].encode()).hexdigest()

    @staticmethod
    def read(texts: list[bytes], tokenizers: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of texts: which each is, the first of each text, and whether B's bytes are those of the text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        begins = units(data, edges)
        offsets = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        uses = tokenizers.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        firsts = np.searchsorted(begins, edges)
        good = np.ones(len(texts), bool)
        if tokenizers.bad:
            for k in np.unique(np.searchsorted(firsts, np.flatnonzero(np.isin(uses, list(tokenizers.bad))), "right") - 1).tolist():
                ids = tokenizers.tokens[1].of(uses[firsts[k] : firsts[k + 1]], np.zeros(1, np.int64))[0]
                good[k] = b"".join([tokenizers.bytes_b[i] for i in ids.tolist()]) == texts[k]
        return uses, firsts, good

    @staticmethod
    def say(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """The ids as text in the order of groups, A's before B's, each with what follows it."""
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        sum_a, sum_b = (np.concatenate(([0], np.cumsum(np.bincount(g)))) for g in (group_a, group_b))
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + sum_b[group_a]] = np.where(last_a, names[1][a], names[0][a])
        out[np.arange(len(b)) + sum_a[group_b + 1]] = np.where(last_b, names[2][b], names[0][b])
        return out


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(vocabulary: str, pieces: str) -> Tokenizers:
    """Kept for the life of the worker process."""
    if (vocabulary, pieces) not in _TOKENIZERS:
        _TOKENIZERS[vocabulary, pieces] = Tokenizers(vocabulary, pieces)
    return _TOKENIZERS[vocabulary, pieces]


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def blocks(docs: DataFrame, vocabulary: str, pieces: str, key: str, text: str, run_bytes: int) -> DataFrame:
    """(block, docs, links, pairs, held): runs of aligned texts. ``docs`` and ``links`` are packed, a link is an index into the
    block's distinct ``pairs``, and ``held`` says how many of its texts hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, both, squeeze = TaskContext.get().partitionId(), tokenizers(vocabulary, pieces), zstandard.ZstdCompressor(level=1)
        for k, t in enumerate(each_run(batches, "text", run_bytes)):
            r = Run([utf8(x.as_py()) for x in t.column("text")], both)
            coded = pa.array(r.pairs).dictionary_encode()
            links, pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            text_of = np.repeat(np.arange(len(t)), np.diff(r.starts))
            once = pc.unique(pa.array(text_of * max(1, len(pairs)) + links)).to_numpy(zero_copy_only=False)
            held = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
            own = pa.table({"key": t.column("key"), "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": np.diff(r.starts), "groups_sha256": r.digests})
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) + k], pa.int64()),
                    "docs": pa.array([_ipc(own)], pa.binary()),
                    "links": pa.array([squeeze.compress(links.astype("<u4").tobytes())], pa.binary()),
                    "pairs": pa.array([pairs.to_numpy(zero_copy_only=False)], pa.list_(pa.int64())),
                    "held": pa.array([held], pa.list_(pa.int64())),
                }
            )

    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return slim.mapInArrow(run, "block long, docs binary, links binary, pairs array<long>, held array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many texts hold each linked id pair, and whether no pair of its A id is held by more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counts = cut(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count")))
    of_a = F.expr(f"pair div {PAIR}").alias("a")
    top = counts.groupBy(of_a).agg(F.max("count").alias("most"))
    return counts.withColumn("a", of_a).join(top, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, vocabulary: str, pieces: str, key: str = "doc_id", text: str = "text", run_bytes: int = RUN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A text is led by a space for the byte-level tokenizer A; the piece tokenizer B does so itself. Texts that are null or
    empty, or whose tokens' bytes differ between the two, have no tokens: zeros and an empty digest. Repeated rows count as
    texts of their own and come back one for one, whatever their keys. Other columns are not read; an empty table gives an
    empty result. What the corpus-wide counts cost is a row for each pair of a run, never a link.
    """
    kind = docs.schema[key].dataType.simpleString()
    aligned = cut(blocks(docs, vocabulary, pieces, key, text, run_bytes))
    asked = aligned.select("block", F.posexplode("pairs").alias("k", "pair"))
    told = asked.join(pair_counts(aligned), "pair").select("block", "k", "count", "best").toDF("block", "k", "count", "best")

    def use(own: pa.Table, got: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(own.column("docs")[0].as_py()).read_all()
        links = np.frombuffer(zstandard.ZstdDecompressor().decompress(own.column("links")[0].as_py()), "<u4")
        order = np.argsort(np.asarray(got.column("k")))
        starts = np.concatenate(([0], np.cumsum(np.asarray(docs.column("n_links")))))
        sums = []
        for name in ("best", "count"):
            values = got.column(name).to_numpy()[order].astype(np.int64)
            sums.append(np.diff(np.concatenate(([0], np.cumsum(values[links])))[starts]))
        told = docs.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
        return told.select(["key", *NUMBERS, "groups_sha256"])

    schema = f"key {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string"
    whole = aligned.select("block", "docs", "links").toDF("block", "docs", "links").groupBy("block").cogroup(told.groupBy("block"))
    return whole.applyInArrow(use, schema).withColumnRenamed("key", key)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def links(text: str, vocabulary: str, pieces: str) -> Iterable[tuple[int, int]]:
    """The id pairs that overlap in one text, in order."""
    pairs = Run([utf8(text)], tokenizers(vocabulary, pieces)).pairs
    return [(p // PAIR, p % PAIR) for p in pairs.tolist()]
