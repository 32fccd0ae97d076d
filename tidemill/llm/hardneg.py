"""Hard negatives by blocks along a Hilbert curve with zone maps.

Vectors are sorted along a Hilbert curve through all their dimensions and written as Parquet, one row for each block of
neighbours: ids, labels, packed components, and the least and greatest component of every dimension (the zone map). A search
asks, for each anchor, for the best rows whose score lies in windows. Interval arithmetic on a zone map bounds the scores
that an anchor can have in a block; a first look at the anchor's own part of the curve gives a floor under its last hit; and only blocks whose
bounds reach into a window above its floor are read, by chunks of anchors. Nothing else is skipped, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import cut, stored

#: Rows in a block (at most), blocks in a part (what one probe reads at once), anchors in a chunk, zone maps looked at by one task.
BLOCK, PART, CHUNK, ZONES = 256, 32, 1024, 4096
#: Bits of a component that place a vector on the curve.
BITS = 2
_FAR = (1 << 63) - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of cells (rows of ``bits``-bit coordinates) along a Hilbert curve, as bytes that sort like them.

    The coordinates are turned and mirrored plane by plane from the highest bit down, Gray-coded across dimensions, and
    their bits interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    if not len(x):
        return np.zeros((cells.shape[0], 0), np.uint8)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros(x.shape[1], np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0)
    x ^= flip
    planes = [(x >> k) & 1 for k in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


def _cells(vectors: np.ndarray) -> np.ndarray:
    """Two bits a component: its sign, and whether it is beyond the mean size of the vector's components."""
    size = np.abs(vectors).mean(axis=1, keepdims=True) if vectors.shape[1] else np.zeros((len(vectors), 1))
    return np.where(vectors < 0, (vectors > -size).astype(np.int64), 2 + (vectors > size))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _narrow(vectors: np.ndarray) -> bytes:
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _wide(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * dims)}" if n * dims else "<i8").reshape(n, dims).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and of b: in doubles where these hold every sum, else in Python's integers."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with any vector between ``low`` and ``high``, per zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def arrange(rows: DataFrame, key: str, vector: str, label: str, anchor: Column, scale: int, block: int = BLOCK) -> DataFrame:
    """The table of blocks: (block, part, dims, n, ids, labels, anchors, vectors, low, high), one row for each."""
    whole = F.transform(rows[vector], lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.forall(rows[vector], lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    slim = rows.filter(rows[label].isNotNull() & rows[vector].isNotNull() & fine).select(
        F.size(rows[vector]).alias("dims"), rows[key].cast("long").alias("id"), rows[label].cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            sizes = np.asarray(t.column("dims"))
            places: list = [None] * len(sizes)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                curve = hilbert(_cells(_matrix(t.column("v").take(pa.array(at)), d)), BITS)
                for k, p in zip(at.tolist(), curve):
                    places[k] = p.tobytes()
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(places, pa.binary())], [*t.schema.names, "place"])

    placed = slim.mapInArrow(place, "dims int, id long, label long, anchor boolean, v array<long>, place binary")
    order = ["dims", "place", "id"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for t in _runs(batches, block):
            d = t.column("dims")[0].as_py()
            v = _matrix(t.column("v"), d)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) + k], pa.int64()),
                    "part": pa.array([(part << 32) + k // PART], pa.int64()),
                    "dims": pa.array([d], pa.int32()),
                    "n": pa.array([len(v)], pa.int32()),
                    "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())),
                    "labels": pa.array([t.column("label").to_pylist()], pa.list_(pa.int64())),
                    "anchors": pa.array([np.flatnonzero(t.column("anchor").to_numpy())], pa.list_(pa.int64())),
                    "vectors": pa.array([_narrow(v)], pa.binary()),
                    "low": pa.array([v.min(axis=0)], pa.list_(pa.int64())),
                    "high": pa.array([v.max(axis=0)], pa.list_(pa.int64())),
                }
            )
            k += 1

    return stored(sorted_.drop("place").mapInArrow(pack, "block long, part long, dims int, n int, ids array<long>, labels array<long>, anchors array<long>, vectors binary, low array<long>, high array<long>"))


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Regroups sorted rows into runs of ``size`` rows, fewer where the number of dimensions changes and at the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        dims = np.asarray(batch.column("dims"))
        edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
        for start, end in zip(edges, edges[1:]):
            if held and start < end and held[0].column("dims")[0].as_py() != dims[start]:
                yield pa.Table.from_batches(held)
                held = []
            while start < end:
                take = min(end - start, size - sum(len(h) for h in held))
                held.append(batch.slice(start, take))
                start += take
                if sum(len(h) for h in held) == size:
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


def anchors_of(table: DataFrame) -> DataFrame:
    """(row, id, label, dims, home, chunk, vector) of every anchor; neighbours on the curve share a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                v, at = _wide(r["vectors"], r["n"], r["dims"]), r["anchors"]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array([r["block"] * BLOCK + k for k in at], pa.int64()),
                        "id": pa.array([r["ids"][k] for k in at], pa.int64()),
                        "label": pa.array([r["labels"][k] for k in at], pa.int64()),
                        "dims": pa.array([r["dims"]] * len(at), pa.int32()),
                        "home": pa.array([r["part"]] * len(at), pa.int64()),
                        "vector": pa.array(list(v[at]), pa.list_(pa.int64())),
                    }
                )

    some = table.filter(F.size("anchors") > 0).select("block", "part", "dims", "n", "ids", "labels", "anchors", "vectors")
    size = table.agg(F.sum(F.size("anchors")), F.max("part")).first()
    chunks, tasks = -(-(size[0] or 0) // CHUNK), ((size[1] or 0) >> 32) + 1
    found = some.mapInArrow(run, "row long, id long, label long, dims int, home long, vector array<long>")
    return cut(found.withColumn("chunk", F.expr(f"(shiftright(home, 32) * {max(1, chunks)}) div {tasks}")))


def _hits(asked: pa.Table, blocks: pa.Table, same: bool, k: int) -> dict[str, list]:
    """The best k rows of the blocks for every window of every anchor: score down, then id, then place in the table."""
    out: dict[str, list] = {"row": [], "w": [], "found": [], "id": [], "score": []}
    if not len(asked) or not len(blocks):
        return out
    d = asked.column("dims")[0].as_py()
    parts = blocks.select(["block", "n", "ids", "labels", "vectors"]).to_pylist()
    ids = np.array([_FAR if x is None else x for p in parts for x in p["ids"]], np.int64)
    null = np.array([x is None for p in parts for x in p["ids"]], bool)
    labels = np.array([x for p in parts for x in p["labels"]], np.int64)
    rows = np.concatenate([p["block"] * BLOCK + np.arange(p["n"]) for p in parts])
    scores = product(_matrix(asked.column("vector"), d), np.concatenate([_wide(p["vectors"], p["n"], d) for p in parts]))
    for own, row, label, windows in zip(scores, asked.column("row").to_pylist(), asked.column("label").to_pylist(), asked.column("windows").to_pylist()):
        allowed = (labels == label) & (rows != row) if same else labels != label
        for window in windows:
            at = np.flatnonzero(allowed & (own >= max(window["low"], window["floor"])) & (own <= window["high"]))
            if len(at) > 4 * k:
                least = np.partition(own[at], len(at) - k)[len(at) - k]
                at = at[own[at] >= least]
            at = at[np.lexsort((rows[at], ids[at], null[at], -own[at]))[:k]]
            out["row"] += [row] * len(at)
            out["w"] += [window["w"]] * len(at)
            out["found"] += rows[at].tolist()
            out["id"] += [None if n else i for i, n in zip(ids[at].tolist(), null[at].tolist())]
            out["score"] += own[at].tolist()
    return out


_HITS = "row long, w int, found long, id long, score long"


def _probe(asked: DataFrame, blocks: DataFrame, by: list[str], same: bool, k: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(_hits(left, right, same, k), pa.schema([("row", pa.int64()), ("w", pa.int32()), ("found", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    mine, theirs = [*by, "row", "label", "vector", "windows"], [*by, "block", "n", "ids", "labels", "vectors"]
    left, right = asked.select(*mine).toDF(*mine), blocks.select(*theirs).toDF(*theirs)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, _HITS)


def needed(asked: DataFrame, table: DataFrame, salts: int) -> DataFrame:
    """(chunk, block) that some anchor of the chunk must read: its score bounds in the block's zone reach into one of its windows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(len(right), bool)
        if len(left) and len(right):
            d, windows = left.column("dims")[0].as_py(), left.column("windows").to_pylist()
            least, most = bounds(_matrix(left.column("vector"), d), _matrix(right.column("low"), d), _matrix(right.column("high"), d))
            for low, high, own in zip(least, most, windows):
                for w in own:
                    hit |= (high >= max(w["low"], w["floor"])) & (low <= w["high"])
        chunk = left.column("chunk")[0].as_py() if len(left) else 0
        return pa.table({"chunk": pa.array([chunk] * int(hit.sum()), pa.int64()), "block": right.column("block").filter(pa.array(hit))})

    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "chunk", "dims", "vector", "windows")
    zones = table.select((F.col("block") % salts).cast("int").alias("salt"), "block", "dims", "low", "high")
    zones = zones.join(F.broadcast(asked.agg(F.max("chunk").alias("last"))), F.lit(True)).select("salt", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"), "block", "dims", "low", "high")
    by = ["dims", "chunk", "salt"]
    return every.groupBy(*by).cogroup(zones.groupBy(*by)).applyInArrow(run, "chunk long, block long")


def search(table: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """(row, w, rank, id, score): the best k rows, of the anchor's label (itself left out) or of others, in each window
    (row, w, low, high): score down, then id, rows without an id last."""
    best = Window.partitionBy("row", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "found")
    struct = F.struct("w", "low", "high", F.coalesce("floor", F.lit(-_FAR)).alias("floor"))

    def asking(windows: DataFrame) -> DataFrame:
        return anchors.join(windows.groupBy("row").agg(F.sort_array(F.collect_list(struct)).alias("windows")), "row")

    home = asking(windows.withColumn("floor", F.lit(None).cast("long"))).withColumnRenamed("home", "part")
    seen = _probe(home, table, ["dims", "part"], same, k)
    floors = seen.groupBy("row", "w").agg(F.min("score").alias("least"), F.count("*").alias("hits")).filter(F.col("hits") >= k)
    asked = cut(asking(windows.join(floors.select("row", "w", F.col("least").alias("floor")), ["row", "w"], "left")))
    blocks = table.count()
    read = cut(needed(asked, table, max(1, -(-blocks // ZONES))))
    found = _probe_parts(asked, read.join(table, "block"), same, k)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("row", "w", "rank", "id", "score")


def _probe_parts(asked: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """Probes each chunk of anchors in each part of the table that holds a block which the chunk needs."""
    parts = blocks.select("chunk", "dims", "part").distinct()
    return _probe(asked.join(parts, ["chunk", "dims"]), blocks, ["dims", "chunk", "part"], same, k)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); scores are their integer inner products. Of each row where ``anchor`` holds, the
    ``positives`` best other rows of its label are found, and for each of these the ``negatives`` best rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's. Rows with a null label or vector, or with a null or
    non-finite component take no part; vectors meet those of their own length only. A row with a null key can be found, after
    others of its score, and repeated rows are rows of their own. An anchor without a positive or a negative gives no row; an
    empty table gives an empty result; other columns are not read. Scores must fit a long.
    """
    table = arrange(rows, key, vector, label, anchor, scale, block)
    anchors = anchors_of(table)
    ends = lambda lo, hi: (lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    best = cut(search(table, anchors, anchors.select("row", F.lit(0).alias("w"), *ends(F.lit(-_FAR), F.lit(_FAR))), True, positives))
    exact = F.col("score").cast("decimal(20,0)")
    window = ends(F.ceil(exact * F.lit(low).cast("decimal(4,0)") / F.lit(100)), F.floor(exact * F.lit(high).cast("decimal(4,0)") / F.lit(100)))
    windows = best.select("row", F.col("rank").alias("w"), *window).filter("low <= high")
    worst = search(table, anchors, windows, False, negatives)
    of = best.select("row", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    return worst.join(of, ["row", "w"]).join(named, "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
