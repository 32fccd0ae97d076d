"""MinHash near-duplicate detection: universal hash minima, banding, signature check, exact check, components.

Equal word sequences are one node from the start, so copies never meet each other. Nodes are numbered by their digest, not
by the documents' keys, so that rows of one key stay apart by their texts. Cells (here bands) are never expanded into all
pairs: first every member of a cell is held against the cell's first node, and components of the links found join most of
each cell. In cells that still hold several components, the members outside the most common one are a query set against
all members, in blocks of bounded bytes: sketches tell which members have any partner left, and only those send their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import LOWER, U64, Rolling, Words, as_row, cut, each_run, stored, utf8

SHINGLE = 5
ROWS, BANDS = 5, 40
#: Signature rows that agree, of ROWS * BANDS, below which a pair isn't checked: six standard deviations below 0.75.
LEAST_EQUAL = round(ROWS * BANDS * (0.75 - 6 * (0.75 * 0.25 / (ROWS * BANDS)) ** 0.5))
#: Ids (8 bytes each) up to which a list of documents is broadcast instead of joined by shuffling the texts.
BROADCAST_IDS = 1_000_000
#: Shingles (8 bytes each) in a block of queries, and of the documents that it meets. Of sketches, SKETCHES times as many.
QUERIES, MET, SKETCHES = 1 << 21, 1 << 22, 4
#: Links (16 bytes each) in a partition while components are sought, at least: few links need few tasks.
EDGES = 1 << 14
_RUN = 4 << 20
_CHUNK = 1 << 15


def _family(n: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier (odd) and summand of n universal hash functions x -> high bits of a * x + b modulo 2**64."""
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (2, n), U64)
    return draws[0] | U64(1), draws[1]


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all 5-word shingles, with repeats, and where each text's begin (one more than texts)."""
    words = Words(texts)
    sizes = np.diff(words.starts)
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=edges[1:])
    if not edges[-1]:
        return np.zeros(0, U64), edges
    first = np.arange(edges[-1]) - np.repeat(edges[:-1] - words.starts[:-1], counts)
    length = np.repeat(np.minimum(sizes, SHINGLE), counts)
    return Rolling(words.hashes()[0][words.ids]).at(first, length), edges


def minima(hashes: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """Minima of n universal hashes over each text's shingles, one row per text that has any."""
    a, b = _family(n)
    begins = edges[:-1][np.diff(edges) > 0]
    out = np.empty((len(begins), n), U64)
    ends = np.append(begins[1:], len(hashes))
    k = 0
    while k < len(begins):
        j = max(k + 1, int(np.searchsorted(ends, begins[k] + _CHUNK, "right")))
        part, at = hashes[begins[k] : ends[j - 1]], begins[k:j] - begins[k]
        buffer = np.empty_like(part)
        for i in range(n):
            np.multiply(part, a[i], out=buffer)
            buffer += b[i]
            out[k:j, i] = np.minimum.reduceat(buffer, at)
        k = j
    return out


def band_keys() -> Column:
    """64-bit keys of a sketch's bands, ROWS minima each; the band's number is part of the key."""
    return F.expr(f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(sketch, {2 * ROWS} * k + 1, {2 * ROWS})))")


def mark(docs: DataFrame, text: str) -> Column:
    """A 64-bit hash of the text as it stands: with the key it tells which rows are meant."""
    return F.xxhash64(F.coalesce(docs[text], F.lit("")))


def signed(docs: DataFrame, key: str, text: str, schema: str, describe: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """(id, mark, same, n, and the columns of ``schema`` that ``describe`` makes of each text's sorted set of shingle hashes).

    ``same`` is a digest of the word sequence, ``n`` the size of the set."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_run(batches, "text", _RUN):
            texts = [utf8(x.as_py()).translate(LOWER) for x in t.column("text")]
            hashes, edges = shingle_hashes(texts)
            sets = [np.unique(hashes[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("id").combine_chunks(),
                    t.column("mark").combine_chunks(),
                    pa.array([_same(x) for x in texts], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *describe(sets),
                ],
                ["id", "mark", "same", "n", *names],
            )

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(docs[key].alias("id"), mark(docs, text).alias("mark"), docs[text].alias("text"))
    return slim.mapInArrow(run, f"id {kind}, mark long, same binary, n long, {schema}")


def _same(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _sketches(sets: list[np.ndarray]) -> list[pa.Array]:
    """16 bits of each minimum; null without shingles."""
    edges = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
    found = iter((minima(np.concatenate([np.zeros(0, U64), *sets]), edges, ROWS * BANDS) >> U64(48)).astype("<u2"))
    return [pa.array([next(found).tobytes() if len(x) else None for x in sets], pa.binary())]


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, id, same): the sorted distinct shingle hashes as bytes. Texts are read by key, and
    told apart by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_run(batches, "text", _RUN):
            texts = [utf8(x.as_py()).translate(LOWER) for x in t.column("text")]
            hashes, edges = shingle_hashes(texts)
            sets = [np.unique(hashes[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([_same(x) for x in texts], pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    found = only(docs, nodes.select("id"), "id").select("text").mapInArrow(run, "digest binary, shingles binary")
    return found.join(nodes.select("node", "same"), F.col("digest") == F.col("same")).dropDuplicates(["node"]).select("node", "shingles")


def _both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """``pairs`` with ``value`` of either node as x and y."""
    left = of.select(of["node"].alias("a"), of[value].alias("x"))
    return pairs.join(left, "a").join(left.withColumnsRenamed({"a": "b", "x": "y"}), "b")


def _where(pairs: DataFrame, test) -> DataFrame:
    """Pairs (a, b) whose x and y bytes pass ``test``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            hit = [test(x.as_py(), y.as_py()) for x, y in zip(t.column("x"), t.column("y"))]
            yield t.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(x: bytes, y: bytes) -> bool:
    return int(np.count_nonzero(np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2"))) >= LEAST_EQUAL


def _near(sketches: list[bytes], n: np.ndarray, queries: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, other) of different roots whose sketches are alike, those of one query at a time."""
    rows = np.frombuffer(b"".join(sketches), "<u2").reshape(len(sketches), -1)
    for q in queries.tolist():
        found = np.flatnonzero((np.count_nonzero(rows == rows[q], axis=1) >= LEAST_EQUAL) & (roots != roots[q]))
        yield np.full(len(found), q), found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share so many hundredths of their union."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


@dataclass(frozen=True)
class Way:
    """A way to link documents whose shingle sets share ``percent`` hundredths of their union.

    Linked documents share a cell (a 64-bit number among those of the column ``cells``). ``alike`` tells of two sketches, and
    ``near`` of many at once (sketches, sizes, indexes of queries, roots), which pairs may be linked: it gives them in parts of
    bounded size, which are used one after another and never held together."""

    percent: int
    cells: Callable[[], Column]
    alike: Callable[[bytes, bytes], bool]
    near: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


MINHASH = Way(75, band_keys, _alike, _near)


def only(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (or, left_anti, isn't) among ``ids``, a table of one column.

    Ids are broadcast up to BROADCAST_IDS of them; more are joined by key.
    """
    ids = cut(ids.distinct().toDF("only_id"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key] == ids["only_id"], how)


def confirm(pairs: DataFrame, unique: DataFrame, docs: DataFrame, way: Way) -> DataFrame:
    """The pairs (a, b) that are linked: sketches are compared first, full sets decide."""
    alike = cut(_where(_both(pairs, unique, "sketch"), way.alike))
    nodes = unique.join(alike.select("a").union(alike.select("b")).distinct().toDF("node"), "node", "left_semi")
    sets, percent = cut(_sets(docs, nodes)), way.percent
    return _where(_both(alike, sets, "shingles"), lambda x, y: linked(np.frombuffer(x, U64), np.frombuffer(y, U64), percent))


def _families(t: pa.Table) -> Iterator[pa.Table]:
    """The families in a group, each with a query and another root."""
    t = t.sort_by([("family", "ascending"), ("node", "ascending")])
    family = np.asarray(t.column("family"))
    edges = [0, *(np.flatnonzero(np.diff(family)) + 1).tolist(), len(family)]
    for start, end in zip(edges, edges[1:]):
        part = t.slice(start, end - start)
        if np.asarray(part.column("query")).any():
            yield part


def _candidates(t: pa.Table, way: Way) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a family, (query, member of another root), that sketches leave, some at a time."""
    sketches = [x.as_py() for x in t.column("sketch")]
    return way.near(sketches, np.asarray(t.column("n")), np.flatnonzero(np.asarray(t.column("query"))), np.asarray(t.column("root")))


def _survivors(way: Way) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        kept = [part.select(["family", "node"]).filter(pa.array(_some(part))) for part in _families(t)]
        return pa.concat_tables([t.slice(0, 0).select(["family", "node"]), *kept])

    def _some(part: pa.Table) -> np.ndarray:
        left = np.zeros(len(part), bool)
        for a, b in _candidates(part, way):
            left[a] = left[b] = True
        return left

    return run


def _meet(way: Way) -> Callable[[pa.Table], pa.Table]:
    """Links between queries and members: of each query, one to every other root."""

    def run(t: pa.Table) -> pa.Table:
        a, b = [], []
        for part in _families(t):
            nodes, roots = part.column("node").to_pylist(), part.column("root").to_pylist()
            sets = [np.frombuffer(x.as_py(), U64) for x in part.column("shingles")]
            found = set()
            for some in _candidates(part, way):
                for q, k in zip(*(x.tolist() for x in some)):
                    if (q, roots[k]) not in found and linked(sets[q], sets[k], way.percent):
                        found.add((q, roots[k]))
                        a.append(nodes[q])
                        b.append(nodes[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in_blocks(members: DataFrame, weight: Column, times: int) -> DataFrame:
    """Members of (family, node, n, root) dealt into groups (at, block, salt): queries, which are the members with another root
    than the family's, by block, each to all salts; members by salt, each to all blocks. Families of one block share groups, of
    which there are so many that one holds no more than about a block, however many families there are."""
    spark = members.sparkSession
    parts = members.groupBy("family").agg(
        F.ceil(F.coalesce(F.sum(F.when(F.col("root") != F.col("family"), weight)), F.lit(0)) / (times * QUERIES)).cast("int").alias("blocks"),
        F.ceil(F.sum(weight) / (times * MET)).cast("int").alias("salts"),
        F.sum(weight).alias("weight"),
    )
    whole = parts.filter("blocks = 1 AND salts = 1").agg(F.sum("weight")).first()[0] or 0
    few = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // (times * MET)))
    at = F.when((F.col("blocks") == 1) & (F.col("salts") == 1), F.pmod(F.xxhash64("family"), F.lit(few))).otherwise(-1 - F.col("family"))
    members = members.join(parts.filter("blocks > 0").drop("weight"), "family").withColumn("at", at)
    block, salt = F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "salts").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = members.filter("root <> family").select("at", "family", "node", "n", "root", block.alias("block"), each("salts").alias("salt"), F.lit(True).alias("query"))
    met = members.select("at", "family", "node", "n", "root", each("blocks").alias("block"), salt.alias("salt"), F.lit(False).alias("query"))
    return queries.union(met.select(*queries.columns))


def _meetings(labelled: DataFrame, unique: DataFrame, docs: DataFrame, way: Way) -> DataFrame:
    """Links between components within cells, of (cell, node, n, root). A cell's family is its most common root; the
    members of a family's cells with another root are queries against all members."""
    roots = labelled.groupBy("cell", "root").agg(F.count("*").alias("k"))
    families = roots.groupBy("cell").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    members = labelled.join(families.select("cell", F.col("most.root").alias("family")), "cell")
    members = cut(members.select("family", "node", "n", "root").distinct())
    by, sketch = ["at", "block", "salt"], unique.select("node", "sketch")
    left = _in_blocks(members, F.col("n") + 64, SKETCHES).join(sketch, "node").groupBy(*by).applyInArrow(_survivors(way), "family long, node long")
    left = cut(members.join(left.distinct().toDF("family", "node"), ["family", "node"]))
    sets = _sets(docs, unique.join(left.select("node").distinct(), "node", "left_semi"))
    return _in_blocks(left, F.col("n"), 1).join(sketch, "node").join(sets, "node").groupBy(*by).applyInArrow(_meet(way), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b) but the roots: the smallest id that can be reached.

    Alternates large-star (every larger neighbour moves to the smallest known id) and small-star (the same for
    smaller neighbours) until every id has either larger neighbours only or one, a smaller. Minima are aggregated
    before they are joined back, so that an id with very many neighbours is no group in one task.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    parts = edges.count() // EDGES + 1  # no round has more edges than this
    while True:
        ways = edges.select("u", "v").union(edges.select("v", "u")).toDF("x", "y").coalesce(parts)
        least = cut(ways.groupBy("x").agg(F.min("y").alias("low"), F.count("*").alias("ways")).coalesce(parts))
        if least.filter("low < x AND ways > 1").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        large = ways.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.least("low", "x").alias("v")).coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))


def components_of(signs: DataFrame, docs: DataFrame, key: str, text: str, way: Way) -> DataFrame:
    """(id, mark, n, component): every row of ``signs`` (made by ``signed``, with a sketch), with the least id that links reach."""
    some = signs.filter("n > 0 AND id IS NOT NULL")
    rest = [c for c in signs.columns if c not in ("id", "mark", "same")]
    unique = stored(some.groupBy("same").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in rest)).withColumn("node", F.monotonically_increasing_id()))
    whole = docs.select(docs[key].alias("id"), docs[text].alias("text"))

    placed = unique.select("node", "n", F.explode(way.cells()).alias("cell"))
    heads = placed.groupBy("cell").agg(F.min("node").alias("head"), F.min_by("n", "node").alias("head_n"), F.count("*").alias("m")).filter("m > 1")
    shared = stored(placed.join(heads, "cell"))
    fits = 100 * F.least("n", "head_n") >= way.percent * F.greatest("n", "head_n")
    stars = shared.filter((F.col("node") != F.col("head")) & fits).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    root = components(confirm(stars, unique, whole, way)).toDF("node", "root")

    labelled = shared.filter("m > 2").join(root, "node", "left").select("cell", "node", "n", F.coalesce("root", "node").alias("root"))
    more = cut(_meetings(stored(labelled), unique, whole, way))
    if not more.isEmpty():
        root = components(root.toDF("a", "b").union(more)).toDF("node", "root")

    first = cut(unique.select("same", "id", "node").join(root, "node", "left").select("same", "id", F.coalesce("root", "node").alias("root")))
    least = first.groupBy("root").agg(F.min("id").alias("component"))
    found = signs.select("id", "mark", "n", "same").join(first.join(least, "root").select("same", "component"), "same", "left")
    return found.select("id", "mark", "n", F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id")).alias("component"))


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return components_of(stored(signed(docs, key, text, "sketch binary", _sketches)), docs, key, text, MINHASH)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Words are lower-cased (A to Z). Texts of which the shared shingles are at least 75 of 100 of all are linked;
    bands find such a pair with a chance of 1 - 2e-5 at the threshold itself, and more above. Null, empty and
    blank texts have no shingles and no links. Rows with equal keys are placed by their own text each. A row with a null key has
    no links and a null component, and is kept. An empty table gives an empty result; other columns are not read.
    """
    found = _placed(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller key, told by key and text: rows of one key go or stay by
    their own texts. Columns, their names and repeated rows are unchanged."""
    told = docs.select(as_row(docs), docs[key].alias("of"), mark(docs, text).alias("mark"))
    gone = cut(_placed(docs, key, text).filter("NOT id <=> component").select(F.col("id").alias("gone"), F.col("mark").alias("gone_mark")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return told.join(gone, (F.col("of") == F.col("gone")) & (F.col("mark") == F.col("gone_mark")), "left_anti").select("row.*")
