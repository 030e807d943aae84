"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of cosine >= c lie within epsilon = sqrt(2 - 2c).  They are projected on LEADING principal
directions, with the length of what is left as one more coordinate (distances never grow by that), and sorted by their grid cells of side
epsilon there (epsilon grid order).  The sorted sequence is cut into blocks, about as many as give every task some pairs of
blocks, and none above BLOCK_BYTES.  Each block carries the boxes of its leaves; pairs of blocks of which no two leaves' boxes lie within epsilon are
provably distant and never meet, so that no vector of them moves.  Within a pair the two intervals are halved recursively, again skipping
distant halves, down to leaves whose cosines are computed in double precision from the vectors as given.  Where vectors spread evenly in
many directions no box excludes another, and the work (not what is moved, up to blocks of BLOCK_BYTES) grows with the square of the rows.

Equal vectors form one class (told by 128 bits), compared once and counted with its size.  A block pair puts out at most one
row per vector: its links and the least member of its local component, never its pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
different lengths.  Repeated rows with one vec_id are separate vectors of that id; a null id links with nothing.  An empty table gives no rows; other
columns are ignored, whatever their names.

The directions come from at most SAMPLE vectors of each length (first by hash); they only steer pruning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import discard, mapped, materialize, partitions, ship, split_join
from pagequarry.llm.components import connected_components

LEADING, LEAF, SAMPLE, BLOCK_BYTES = 8, 256, 2048, 16_000_000


def directions(x: np.ndarray) -> np.ndarray:
    """LEADING orthonormal columns (fewer for short vectors) of largest variance."""
    x = x - x.mean(axis=0)
    _, v = np.linalg.eigh(x.T @ x)
    return v[:, ::-1][:, :LEADING]


def coordinates(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The projections, and the length of the rest."""
    p = unit @ basis
    return np.concatenate([p, np.sqrt(np.maximum(1 - (p * p).sum(axis=1, keepdims=True), 0))], axis=1)


def reach(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-7


def block_pair(a: dict, b: dict, cosine: float, same: bool, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, links, root) over the vectors of a and b laid end to end; a and b hold vec and size."""
    na = len(a["size"])
    n = na if same else na + len(b["size"])
    links = np.zeros(n, dtype=np.int64)
    label = np.arange(n)
    eps = reach(cosine)
    unit = [x["vec"] / np.linalg.norm(x["vec"], axis=1, keepdims=True) for x in (a, b)]
    proj = [coordinates(x, basis) for x in unit]
    shift = 0 if same else na

    def box(p: np.ndarray, memo: dict, lo: int, hi: int):
        if (lo, hi) not in memo:
            memo[lo, hi] = p[lo:hi].min(axis=0), p[lo:hi].max(axis=0)
        return memo[lo, hi]

    boxes_a: dict = {}
    boxes_b: dict = boxes_a if same else {}
    todo = [(0, na, 0, len(b["size"]))]
    while todo:
        al, ah, bl, bh = todo.pop()
        if same and bh <= al:
            continue  # met the other way round
        lo1, hi1 = box(proj[0], boxes_a, al, ah)
        lo2, hi2 = box(proj[1], boxes_b, bl, bh)
        gap = np.maximum(np.maximum(lo1 - hi2, lo2 - hi1), 0)
        if gap @ gap > eps * eps:
            continue
        if ah - al > LEAF or bh - bl > LEAF:
            ma = [(al, (al + ah) // 2), ((al + ah) // 2, ah)] if ah - al > LEAF else [(al, ah)]
            mb = [(bl, (bl + bh) // 2), ((bl + bh) // 2, bh)] if bh - bl > LEAF else [(bl, bh)]
            todo += [(*x, *y) for x in ma for y in mb]
            continue
        near = unit[0][al:ah] @ unit[1][bl:bh].T >= cosine
        if same:
            near &= np.arange(bl, bh)[None, :] > np.arange(al, ah)[:, None]
        if not near.any():
            continue
        links[al:ah] += near @ b["size"][bl:bh]
        links[bl + shift : bh + shift] += near.T @ a["size"][al:ah]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            own = label[np.flatnonzero(near[i]) + bl + shift]
            if (own != label[al + i]).any():
                merged = np.unique(np.append(own, label[al + i]))
                label[np.isin(label, merged)] = merged[0]
    at = np.flatnonzero(links)
    return at, links[at], label[at]


def _load(r: pa.StructScalar, dim: int, kind: str) -> dict:
    cid, size, vec = (r[k].as_buffer() for k in ("cid", "size", "vec"))
    return {"cid": np.frombuffer(cid, dtype="<i8"), "size": np.frombuffer(size, dtype="<i8"), "vec": np.frombuffer(vec, dtype=kind).astype(np.float64).reshape(-1, dim)}


def _bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the directions: one job, and what reaches the driver is a few columns for each length."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("h1", "h2"), "cid"))
    some = classes.withColumn("place", place).where(F.col("place") <= SAMPLE).select("dim", "place", "v")

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for dim, v in zip(b.column("dim").to_pylist(), b.column("v").to_pylist(), strict=True):
                for done in [d for d in held if d != dim]:
                    yield made(done, held.pop(done))
                held.setdefault(dim, []).append(np.array(v, dtype=np.float64))
        for dim, rows in held.items():
            yield made(dim, rows)

    def made(dim: int, rows: list) -> pa.RecordBatch:
        x = np.stack(rows)
        basis = directions(x / np.linalg.norm(x, axis=1, keepdims=True))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([basis.astype("<f8").tobytes()], pa.binary())], ["dim", "basis"])

    sorted_ = some.repartition(partitions(classes.sparkSession), "dim").sortWithinPartitions("dim", "place")
    rows = mapped(sorted_, run, "dim int, basis binary", "embedding").collect()
    return {r.dim: np.frombuffer(r.basis, dtype="<f8").reshape(r.dim, -1) for r in rows}


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, width = ("<f4", 4) if narrow else ("<f8", 8)  # as given: the cosines are computed from doubles of these
    src = vectors.selectExpr("cast(vec_id as bigint) vec_id", f"cast(embedding as array<{'float' if narrow else 'double'}>) v")
    ok = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    # adding 0 makes one of both zeros
    src = src.selectExpr("vec_id", f"case when {ok} then v end v").selectExpr("vec_id", "v", "transform(v, x -> x + 0) w").selectExpr("vec_id", "v", "case when v is not null then xxhash64(w, 17) end h1", "case when v is not null then xxhash64(31, w) end h2")
    good = src.where("v is not null and vec_id is not null")
    classes = good.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = materialize(classes.withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id()), "vec")
    bases = _bases(classes)
    eps = reach(cosine)
    tasks = partitions(spark)
    counts = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    rows_of = {d: max(LEAF, min(-(-n // math.ceil(math.sqrt(8 * tasks))), BLOCK_BYTES // (d * width))) for d, n in counts.items()}

    def project(batches):
        for b in batches:
            dims, raw, cells = b.column("dim").to_pylist(), [], []
            for d, v in zip(dims, b.column("v").to_pylist(), strict=True):
                x = np.array(v, dtype=np.float64)
                raw.append(x.astype(kind).tobytes())
                cells.append(np.floor((x / np.linalg.norm(x)) @ bases[d] / eps).astype(int).tolist())
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("size"), b.column("dim"), pa.array(raw, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], ["cid", "size", "dim", "raw", "cells"])

    def pack(batches):
        """Runs of the sorted rows of one length as blocks."""
        from pyspark import TaskContext

        part, made, held, dim = TaskContext.get().partitionId() << 32, 0, [], None

        def block():
            x = np.frombuffer(b"".join(r[2] for r in held), dtype=kind).astype(np.float64).reshape(-1, dim)
            at = coordinates(x / np.linalg.norm(x, axis=1, keepdims=True), bases[dim])
            leaf = np.arange(0, len(x), LEAF)
            lo, hi = np.minimum.reduceat(at, leaf), np.maximum.reduceat(at, leaf)
            ids, sizes = (np.array([r[i] for r in held], dtype="<i8").tobytes() for i in (0, 1))
            values = [[dim], [part + made], [ids], [sizes], [b"".join(r[2] for r in held)], [lo.tolist()], [hi.tolist()]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["dim", "block", "cid", "size", "vec", "lo", "hi"])

        for b in batches:
            for cid, size, d, raw in zip(*(b.column(c).to_pylist() for c in ("cid", "size", "dim", "raw")), strict=True):
                if held and (d != dim or len(held) >= rows_of[dim]):
                    yield block()
                    made, held = made + 1, []
                dim = d
                held.append((cid, size, raw))
        if held:
            yield block()

    placed = mapped(classes.select("cid", "v", "size", "dim"), project, "cid bigint, size bigint, dim int, raw binary, cells array<int>", "embedding")
    placed = placed.repartitionByRange(tasks, "dim", "cells", "cid").sortWithinPartitions("dim", "cells", "cid")
    blocks = materialize(mapped(placed, pack, "dim int, block bigint, cid binary, size binary, vec binary, lo array<array<double>>, hi array<array<double>>", "embedding"), "block")

    # blocks meet in the cells of the first two directions that they may reach, and are compared leaf by leaf
    side = blocks.select("dim", "block", "lo", "hi")
    cell = f"transform(sequence(0, least(1, size(lo[0]) - 2)), i -> sequence(cast(floor(array_min(transform(lo, x -> x[i])) / {eps!r}) as int) - {{0}}, cast(floor(array_max(transform(hi, x -> x[i])) / {eps!r}) as int) + {{0}}))"
    spread = "explode(flatten(transform(c[0], x -> transform(coalesce(get(c, 1), array(0)), y -> struct(x, y))))) c"
    left = side.selectExpr("dim", "block a", "lo la", "hi ha", cell.format(1) + " c").selectExpr("dim", "a", "la", "ha", spread)
    right = side.selectExpr("dim", "block b", "lo lb", "hi hb", cell.format(0) + " c").selectExpr("dim", "b", "lb", "hb", spread)
    gap = "aggregate(sequence(0, size(p) - 1), 0D, (s, i) -> s + pow(greatest(p[i] - hb[v][i], lb[v][i] - ha[u][i], 0D), 2))"
    near = f"exists(sequence(0, size(la) - 1), u -> exists(sequence(0, size(lb) - 1), v -> {gap.replace('size(p)', 'size(la[u])').replace('p[i]', 'la[u][i]')} <= {eps * eps!r}))"
    met = left.join(right, ["dim", "c"]).where("a <= b").dropDuplicates(["dim", "a", "b"]).where(near).select("dim", "a", "b")
    item = F.struct("cid", "size", "vec")
    pairs = met.join(blocks.select("dim", F.col("block").alias("a"), item.alias("x")), ["dim", "a"]).join(blocks.select("dim", F.col("block").alias("b"), item.alias("y")), ["dim", "b"])
    pairs = pairs.selectExpr("dim", "a", "b", "x", "if(a = b, null, y) y")

    def joined(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, same = batch.column("dim")[i].as_py(), not batch.column("y")[i].is_valid
                x = _load(batch.column("x")[i], dim, kind)
                y = x if same else _load(batch.column("y")[i], dim, kind)
                at, n, top = block_pair(x, y, cosine, same, bases[dim])
                cid = x["cid"] if same else np.concatenate([x["cid"], y["cid"]])
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(n), pa.array(cid[top])], ["cid", "n", "top"])

    met = materialize(mapped(pairs.repartition(tasks, "dim", "a", "b").select("dim", "x", "y"), joined, "cid bigint, n bigint, top bigint", "embedding"), "met")
    found = connected_components(met.selectExpr("cid a", "top b"))
    links = met.groupBy("cid").agg(F.sum("n").alias("links"))
    named = classes.select("cid", "h1", "h2", "rep", "size").join(found.selectExpr("node cid", "component"), "cid", "left").join(links, "cid", "left").selectExpr("h1", "h2", "rep", "coalesce(component, cid) component", "coalesce(links, 0L) + size - 1 links").where("links > 0")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("d"))
    name = materialize(split_join(named, least, "component", "d").select("h1", "h2", "links", "component_id"), "name")
    discard(classes, blocks, met)
    out = src.selectExpr("vec_id", "case when vec_id is not null then h1 end h1", "h2").join(name, ["h1", "h2"], "left")
    return out.selectExpr("vec_id", "coalesce(links, 0L) n_links", "coalesce(component_id, vec_id) component_id", "vec_id = coalesce(component_id, vec_id) kept")
