"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Distinct fingerprints
(copies share one) are dealt to candidate partitions by the bits of ``KEEP`` of ``BLOCKS`` blocks: two
fingerprints that differ in at most ``max_bits`` bits agree on at least ``BLOCKS - max_bits`` blocks, so no
link is lost. Inside a partition each fingerprint has a row of Hamming distances to many fixed reference
fingerprints (the pivot table); a pair whose rows differ anywhere by more than ``max_bits`` is discarded
by the triangle inequality, and the survivors are verified by their own Hamming distance.

Large partitions are split by the table's coordinates: at a middle distance to a pivot, rows below and
rows above go on apart, and across the cut only the strips that lie within ``max_bits`` of each other are
compared, split by further pivots in turn; up to ``PAIRS`` pairs are compared at once. The links are the
same at any size, and go on as a tree per partition, never as all pairs.

Edge cases: null and empty texts have fingerprint zero and are linked like others; fewer words than a
shingle: the whole sequence; rows with a null id link like others, but a null id never represents a group
that has another (else component null); rows that repeat an id are rows of their own; ids are of any
ordered type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, quoted, strings
from .components import components

BLOCKS, PIVOTS, PAIRS, MERGE = 6, 24, 1 << 16, 1 << 20  # pairs compared and merged at once
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, hash, fp long): the text's hash and the fingerprint of every row, its 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(t, words) for t in strings(b, text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({id_col: b.column(id_col), "hash": b.column("_hash"), "fp": pa.array(fp, pa.int64())})

    return docs.select(id_col, text_col, text_hash(F.col(text_col)).alias("_hash")).mapInArrow(run, f"{id_col} {kind}, hash bigint, fp bigint")


def masks(max_bits: int) -> list[int]:
    """64-bit masks of all choices of blocks that a linked pair must agree on."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, BLOCKS - max_bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed hashes."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], np.uint64)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def close_pairs(fp: np.ndarray, max_bits: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct fingerprints at most ``max_bits`` apart, in batches of at most ``PAIRS``."""
    table = pivot_table(fp, refs)
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(fp)), None)]  # rows against themselves, or against others
    while todo:
        a, b = todo.pop()
        size = len(a) * len(a if b is None else b)
        cut = _cut(table, a, b, max_bits) if size > PAIRS else None
        if cut is not None:
            todo += cut
            continue
        for i in range(0, len(a), max(1, PAIRS // max(1, len(a if b is None else b)))):
            own = a[i : i + max(1, PAIRS // max(1, len(a if b is None else b)))]
            x, y = _survivors(table, own, a if b is None else b, max_bits)
            near = np.bitwise_count(fp[x] ^ fp[y]) <= max_bits
            near &= (x < y) if b is None else True
            if near.any():
                yield x[near], y[near]


def _survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose largest coordinate difference is within the bound."""
    ok = np.abs(table[a, 0][:, None] - table[b, 0][None, :]) <= max_bits
    for k in range(1, 4):
        ok &= np.abs(table[a, k][:, None] - table[b, k][None, :]) <= max_bits
    i, j = np.nonzero(ok)
    x, y = a[i], b[j]
    kept = (np.abs(table[x] - table[y]) <= max_bits).all(axis=1)
    return x[kept], y[kept]


def _cut(table: np.ndarray, a: np.ndarray, b: np.ndarray | None, max_bits: int) -> list | None:
    """Parts of a comparison, cut at a middle distance to the pivot that spreads the rows most; None where no pivot splits them."""
    both = a if b is None else np.concatenate([a, b])
    spread = np.ptp(table[both], axis=0)
    k = int(spread.argmax())
    if spread[k] <= max_bits:
        return None
    m = min(int(np.median(table[both, k])), int(table[both, k].max()) - 1)
    low = lambda x: x[table[x, k] <= m]
    high = lambda x: x[table[x, k] > m]
    under = lambda x: x[(table[x, k] <= m) & (table[x, k] > m - max_bits)]
    over = lambda x: x[(table[x, k] > m) & (table[x, k] <= m + max_bits)]
    parts = [(low(a), None), (high(a), None), (under(a), over(a))] if b is None else [(low(a), low(b)), (high(a), high(b)), (under(a), over(b)), (over(a), under(b))]
    return [(x, y) for x, y in parts if len(x) and (y is None or len(y))]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of everyone's component once a and b are linked; ``root`` is that of the links so far."""
    a, b = root[a], root[b]
    apart = a != b
    a, b = a[apart], b[apart]
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for x in (a, b):
            np.minimum.at(root, before[x], low)
            np.minimum.at(root, x, low)
        root = root[root]
        if (root == before).all():
            return root
    return root


def roots(fp: np.ndarray, max_bits: int, refs: np.ndarray) -> np.ndarray:
    """For each fingerprint the place of the first one of its component; links are merged as they come."""
    root, held, n = np.arange(len(fp)), [], 0
    for pair in close_pairs(fp, max_bits, refs):
        held.append(pair)
        n += len(pair[0])
        if n >= MERGE:
            root, held, n = _merge(root, *map(np.concatenate, zip(*held))), [], 0
    return _merge(root, *map(np.concatenate, zip(*held))) if held else root


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """distinct(fp) to (a, b): linked fingerprints, as a tree for each candidate partition."""
    bands = masks(max_bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(bands)]))
    rows = distinct.select("fp", keys.alias("k")).select("k.band", "k.key", "fp").repartition("band", "key").sortWithinPartitions("band", "key")
    refs = pivots()

    def tree(fp: np.ndarray, out: list) -> None:
        root = roots(fp.view(np.uint64), max_bits, refs)
        order = np.argsort(root, kind="stable")
        first = np.searchsorted(root[order], root[order])
        at = np.arange(len(order)) - first
        child = np.flatnonzero(at > 0)
        if not len(child):
            return
        out.append((fp[order[first[child] + (at[child] - 1) // 2]], fp[order[child]]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "fp")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            band, key = cols[:2]
            cut = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
            last = cut[-1] if len(cut) else 0
            held = [c[last:] for c in cols]
            yield from found([c[:last] for c in cols], cut[:-1])
        if held is not None:
            yield from found(held, np.empty(0, int))

    def found(cols: list[np.ndarray], cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        band, _, fp = cols
        start, end, out = np.concatenate([[0], cut]), np.concatenate([cut, [len(band)]]), []
        for s, e in zip(start[end - start > 1], end[end - start > 1]):
            tree(fp[s:e], out)
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([x for x, _ in out]), pa.int64()), "b": pa.array(np.concatenate([x for _, x in out]), pa.int64())})

    return rows.mapInArrow(run, "a bigint, b bigint")


def classes(own: DataFrame, id_col: str, max_bits: int, scratch: Scratch) -> DataFrame:
    """own(id, hash, fp) to (fp, best): the best row of each fingerprint's component: the smallest id, nulls last, then the smallest fingerprint and text hash."""
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "fp", "hash"))
    distinct = scratch.save(own.groupBy("fp").agg(best.alias("best")))
    pairs = scratch.save(links(distinct, max_bits))
    linked = components(pairs, scratch)
    named = scratch.save(linked.join(distinct, linked.v == distinct.fp).select("v", "p", "best"))
    least = scratch.save(named.groupBy(F.col("p").alias("label")).agg(F.min("best").alias("least")))
    of_linked = named.join(least, named.p == least.label).select("v", "least")
    out = scratch.save(distinct.join(of_linked, distinct.fp == of_linked.v, "left").select("fp", F.coalesce("least", "best").alias("best")))
    scratch.drop(distinct, pairs, linked, named, least)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(id, fp, component_id): the component is the smallest id reachable over links, the row's own included."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    return own.join(classes(own, id_col, max_bits, scratch), "fp").select(id_col, "fp", F.col("best.id").alias("component_id"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """One row of each group: that of the smallest id (null only if the group has no other); rows that repeat its id and text count once."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    best = classes(own, id_col, max_bits, scratch).where("fp = best.fp").select(F.col("best.id").alias("kept_id"), F.col("best.hash").alias("kept_hash"))
    kept = scratch.save(best)
    often = scratch.save(own.groupBy(F.col(id_col).alias("kept_id"), F.col("hash").alias("kept_hash")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    scratch.drop(own)

    def among(rows: DataFrame, how: str) -> DataFrame:
        same = F.col(f"d.{quoted(id_col)}").eqNullSafe(F.col("k.kept_id")) & (text_hash(F.col(f"d.{quoted(text_col)}")) == F.col("k.kept_hash"))
        return docs.alias("d").join(rows.alias("k"), same, how)

    if not often.take(1):
        return among(kept, "left_semi")
    both = ["kept_id", "kept_hash"]
    once = among(kept.join(often, kept.kept_id.eqNullSafe(often.kept_id) & (kept.kept_hash == often.kept_hash), "left_anti"), "left_semi")
    many = kept.join(often, kept.kept_id.eqNullSafe(often.kept_id) & (kept.kept_hash == often.kept_hash), "left_semi").select(*both)
    return once.unionByName(among(many, "left_semi").dropDuplicates([id_col, text_col]))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
