"""MinHash near-dedup by a signature-coordinate inverted join.

A text's set holds its distinct shingles of five words (A-Z lower-cased); a shorter text is one shingle.
Texts of equal sets form a class.  Each class is posted under its COORDS (coordinate, value) pairs.  Pairs
of classes above the similarity share at least ``match_threshold`` coordinates but for a chance below
1e-5, which prunes the join exactly:

* prefix: two classes with t of K common coordinates share one of the first K - t + 1 in any common order;
* skip: values posted by more than LONG classes are left out of the count, and the prefix is taken over
  the others, as long as a class has fewer than t such values;
* classes with t or more of them (large groups of near copies) are compared with the least and greatest
  class under each such value; what that leaves apart within a group is compared block against block,
  on full sets, and only links that join components are put out.

All links are confirmed on full shingle sets: 100 * intersection >= percent * union.  What can be lost is a link of a pair
with under ``match_threshold`` equal coordinates, a chance of about 9e-6 for a pair right at the similarity.

Shingles are told apart by 64-bit hashes, sets by 128 bits and their size; classes bear numbers, not hashes.

Null, empty and blank texts have no set and link with nothing; rows with a null id link with nothing.
Repeated rows are judged by their own text and take the smallest id of their component.  Very long texts are one set like
any other, made a text at a time; no table, no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import Words, chunks, discard, grams, mapped, materialize, mix, partitions, ship, split_join
from pagequarry.llm.components import connected_components

COORDS, WORDS, LONG = 64, 5, 64
#: Blocks of sets that are compared with each other hold about so many sets, and about so many bytes, at most.
MINOR, MEMBER, BLOCK_BYTES = 256, 1024, 2_000_000
_RNG = np.random.Generator(np.random.PCG64(1010))
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)


def match_threshold(percent: int, coords: int = COORDS) -> int:
    """Common coordinates that a pair at the similarity has, less 4.5 standard deviations."""
    s = percent / 100
    return max(1, math.floor(coords * s - 4.5 * math.sqrt(coords * s * (1 - s))))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], lower=True)
        h = w.hash
        g = grams(h, WORDS)
        for a, b in zip(w.first.tolist(), w.last.tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(g[a : b - WORDS + 1]))
            else:
                out.append(grams(h[a:b], b - a, 99) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    with np.errstate(over="ignore"):
        x = int(np.add.reduce(mix(s))) if len(s) else 0
        y = int(np.add.reduce(mix(s ^ np.uint64(0x5DEECE66D1234567)))) if len(s) else 0
    return x - (x >> 63 << 64), y - (y >> 63 << 64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minima of each set, all of them non-empty."""
    x = np.concatenate(sets)
    head = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), COORDS), dtype=np.uint32)
    for j in range(COORDS):
        out[:, j] = np.minimum.reduceat(((x * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), head)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, k1, k2 (the set's key) and sig of every row."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(2).to_pylist()]
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi])
                sig: list[bytes | None] = [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    for i, s in zip(full, signatures([sets[i] for i in full]), strict=True):
                        sig[i] = s.astype(">u4").tobytes()
                keys = [set_key(s) for s in sets]
                ids = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.column(0), ids.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "th", "n", "k1", "k2", "sig"],
                )

    src = docs.selectExpr("cast(doc_id as bigint) doc_id", "xxhash64(text) th", "text")
    return mapped(src, run, "doc_id bigint, th bigint, n bigint, k1 bigint, k2 bigint, sig binary", "minhash")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and set (bytes of sorted hashes) of the classes in ``wanted`` (cid, rep, k1, k2, n), from their first texts."""

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi])
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["k1", "k2", "n", "set"],
                )

    src = docs.selectExpr("cast(doc_id as bigint) rep", "text").join(wanted.select("rep").distinct(), "rep", "left_semi").select("rep", "text")
    got = mapped(src, run, "k1 bigint, k2 bigint, n bigint, set binary", "minhash")
    return got.join(wanted, ["k1", "k2", "n"]).select("cid", "set").dropDuplicates(["cid"])


def _agree(pairs: DataFrame, classes: DataFrame, t: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those with t common coordinates and sizes that allow the similarity."""
    side = classes.select("cid", "n", "sig")
    both = pairs.join(side.selectExpr("cid a", "n n_a", "sig sig_a"), "a").join(side.selectExpr("cid b", "n n_b", "sig sig_b"), "b")
    both = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=">u4").reshape(-1, COORDS) for i in (2, 3))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= t))

    return mapped(both, run, "a bigint, b bigint", "minhash")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.selectExpr("cid a", "set set_a"), "a").join(sets.selectExpr("cid b", "set set_b"), "b")

    def run(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return mapped(both.select("a", "b", "set_a", "set_b"), run, "a bigint, b bigint", "minhash")


def block_links(minor: list[dict], member: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between different components among two blocks of {cid, comp, set}, only as many as join them."""
    left = [np.frombuffer(r["set"], dtype=np.uint64) for r in minor]
    right = [np.frombuffer(r["set"], dtype=np.uint64) for r in member]
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(x, y)
    ln, rn = np.array([len(s) for s in left], dtype=np.int64), np.array([len(s) for s in right], dtype=np.int64)
    inter = np.zeros((len(left), len(right)), dtype=np.float32)
    row_x, row_y = np.repeat(np.arange(len(left)), ln), np.repeat(np.arange(len(right)), rn)
    at_x, at_y = np.searchsorted(common, x), np.searchsorted(common, y)
    ok_x = np.append(common, 0)[at_x] == x if len(common) else np.zeros(len(x), dtype=bool)
    ok_y = np.append(common, 0)[at_y] == y if len(common) else np.zeros(len(y), dtype=bool)
    for lo in range(0, len(common), 4096):
        a, b = (np.zeros((len(n), min(4096, len(common) - lo)), dtype=np.float32) for n in (left, right))
        for m, rows, at, ok in ((a, row_x, at_x, ok_x), (b, row_y, at_y, ok_y)):
            use = ok & (at >= lo) & (at < lo + 4096)
            m[rows[use], at[use] - lo] = 1
        inter += a @ b.T
    got = inter.astype(np.int64)
    linked = 100 * got >= percent * (ln[:, None] + rn[None, :] - got)
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(minor[i]["comp"]), root(member[j]["comp"])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((minor[i]["cid"], member[j]["cid"]))
    return out


def _rest(hot: DataFrame, groups: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the comparison with least and greatest classes left out, within groups of hot classes.

    Only classes outside a group's largest component are compared with the group's others, block against block; each pair of
    blocks is a row of its own, dealt by (group, block, block).
    """
    comp = found.selectExpr("node cid", "component comp")
    rows = hot.select("cid").join(groups.selectExpr("node cid", "component g"), "cid", "left").join(comp, "cid", "left").join(sets, "cid")
    rows = materialize(rows.selectExpr("cid", "coalesce(g, cid) g", "coalesce(comp, cid) comp", "length(set) bytes"), "hot")
    sizes = rows.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("g").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max_by("bytes", F.struct("n", "comp")).alias("main_bytes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps"), F.max("n").alias("most"))
    blocks = f"cast(ceil(greatest({{}} / {BLOCK_BYTES}.0, {{}} / {{}}.0)) as int)"
    main = main.where("comps > 1").selectExpr("g", "main", blocks.format("(bytes - main_bytes)", "(n - most)", MINOR) + " minors", blocks.format("bytes", "n", MEMBER) + " members")
    rows = rows.join(main, "g").join(sets, "cid")
    item = F.collect_list(F.struct("cid", "comp", "set"))
    minor = materialize(rows.where("comp <> main").withColumn("i", F.expr("pmod(xxhash64(cid, 1), minors)")).groupBy("g", "i").agg(item.alias("x"), F.max("members").alias("members")), "minor")
    member = rows.withColumn("j", F.expr("pmod(xxhash64(cid, 2), members)")).groupBy("g", "j").agg(item.alias("y"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                links = block_links(b.column(0)[i].as_py(), b.column(1)[i].as_py(), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    pairs = minor.selectExpr("g", "i", "explode(sequence(0L, members - 1L)) j")
    both = pairs.join(minor.drop("members"), ["g", "i"]).join(member, ["g", "j"]).repartition(partitions(hot.sparkSession), "g", "i", "j")
    return mapped(both.select("x", "y"), run, "a bigint, b bigint", "minhash")


def judged(docs: DataFrame, percent: int = 85) -> DataFrame:
    """A row for each row of ``docs``: doc_id, th (xxhash64 of its text), n_shingles, component (its number; null for one row alone), component_id."""
    ship(docs.sparkSession)
    t = match_threshold(percent)
    signed = materialize(_signed(docs), "sig")
    rows = signed.where("n > 0 and doc_id is not null")
    key = ["k1", "k2", "n"]
    # sig is a function of the key, so any of them will do
    classes = rows.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    # unique numbers; that a lost task numbers its rows anew doesn't matter, as only what is written counts
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "class")

    posted = classes.selectExpr("cid", f"posexplode(transform(sequence(0, {COORDS - 1}), i -> xxhash64(i, substring(sig, 4 * i + 1, 4)))) as (pos, key)")
    # the least and greatest class of each value that more than LONG classes share lead the others
    common = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("n > 1")
    common = common.selectExpr("key", f"n > {LONG} hot", f"case when n > {LONG} then lo end lo", f"case when n > {LONG} then hi end hi")
    lists = posted.join(common, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "hot", "lo", "hi"))).alias("v"))
    lists = materialize(lists.selectExpr("cid", "v", "filter(v, x -> x.hot) h"), "post")
    prefix = COORDS - t + 1
    # the place of a short value among the class's short values, those that no other class has included
    short = lists.selectExpr("cid", f"explode(filter(v, x -> not x.hot and x.pos - size(filter(h, y -> y.pos < x.pos)) < {prefix})) x").selectExpr("cid", "x.key key")
    pairs = short.selectExpr("key", "cid a").join(short.selectExpr("key", "cid b"), "key").where("a < b").select("a", "b").distinct()
    hot = lists.where(f"size(h) >= {t}")
    led = hot.selectExpr("cid", f"explode(array_distinct(flatten(transform(slice(h, 1, {prefix}), x -> array(x.lo, x.hi))))) lead")
    led = led.where("cid <> lead").selectExpr("least(cid, lead) a", "greatest(cid, lead) b").distinct()
    led = materialize(led, "led")

    agreed = materialize(_agree(pairs.unionByName(led).distinct(), classes, t, percent), "agree")
    wanted = agreed.selectExpr("explode(array(a, b)) cid").unionByName(led.selectExpr("explode(array(a, b)) cid")).distinct().join(classes.select("cid", "rep", *key), "cid")
    want = materialize(wanted, "want")
    sets = materialize(_sets(docs, want), "set")
    links = materialize(_confirm(agreed, sets, percent), "link")
    found = connected_components(links)
    groups = connected_components(led)
    more = materialize(_rest(hot, groups, found, sets, percent), "link")
    found = connected_components(found.selectExpr("node a", "component b").unionByName(more))

    # The smallest id of each component, for classes with copies or links.
    named = classes.select("cid", *key, "rep", "copies").join(found.selectExpr("node cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    name = materialize(named.select(*key, "component").join(least, "component").select(*key, "component", "component_id"), "name")
    discard(classes, lists, led, agreed, want, sets, links, more)
    out = signed.drop("sig").withColumn("k1", F.expr("case when n > 0 and doc_id is not null then k1 end")).join(name, key, "left")
    return out.selectExpr("doc_id", "th", "n n_shingles", "component", "coalesce(component_id, doc_id) component_id")


def minhash_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return judged(docs, percent).selectExpr("doc_id", "n_shingles", "component_id", "doc_id = component_id kept")


def keep_one(docs: DataFrame, percent: int) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, and of rows with that id the one of the least text hash.

    Exact repeats of a row are one row.  Rows without a set or without an id all stay.  Decisions are of rows, by id and text, not of
    ids: where an id is given twice, a text without near copies stays whatever becomes of the other.
    """
    each = materialize(judged(docs, percent).where("component is not null").groupBy("component", "doc_id", "th").agg(F.count("*").alias("n")), "row")
    best = each.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.count("*").alias("d"))
    named = split_join(each, best, "component", "d")
    verdict = named.selectExpr("doc_id _pq_id", "th _pq_th", "doc_id <> best.doc_id or th <> best.th _pq_away", "n > 1 _pq_again").where("_pq_away or _pq_again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_pq_id", F.expr("cast(doc_id as bigint)")).withColumn("_pq_th", F.expr("xxhash64(text)"))
    stay = keyed.join(verdict, ["_pq_id", "_pq_th"], "left_anti").select(*columns)
    if each.where("n > 1").isEmpty():  # no row is repeated
        return stay
    again = keyed.join(verdict.where("not _pq_away"), ["_pq_id", "_pq_th"])
    once = again.groupBy("_pq_id", "_pq_th").agg(F.first(F.struct(*columns)).alias("_pq_row"))
    return stay.unionByName(once.select("_pq_row.*"))
