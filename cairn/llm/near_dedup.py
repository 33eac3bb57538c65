"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Texts with the same shingle set form a class; one document stands for it. Its
signature has BANDS x ROWS minima. Bands of whole minima find candidates; only
the low BITS of each minimum are kept, packed, for the comparison. Documents
that share a band's bucket are joined through the bucket's smallest id, never
pair by pair, and the components of that graph are the candidate groups: all
links lie inside them. A group is compared in blocks of BLOCK documents; a
task has two blocks, whatever the size of the group. It counts equal low bits
of all pairs at once, corrects the share for chance collisions, and confirms
on the full sets what the estimate leaves and what is not connected yet. Only
links that join two parts leave the task.

At a similarity of 0.8 a pair shares no band with probability 1.3e-7.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ROW, cut, keyed, text_of
from cairn.llm.graph import components

BANDS, ROWS, BITS = 40, 5, 4
#: Least similarity in percent, and how far below it an estimate may lie (6 standard errors) before a pair is left out.
PERCENT, MARGIN = 80, 0.2
#: Documents of a block, and word hashes that a worker remembers.
BLOCK, REMEMBERED = 256, 1_500_000

_K = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 31, _K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, _K, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text (A-Z lower-cased); of all its words if they are fewer."""
    own = text.encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    n = min(words, len(own))
    s = np.full(len(own) - n + 1, n, np.uint64)
    for i in range(n):
        s = s * np.uint64(0x100000001B3) + _mixed(h[i : len(own) - n + 1 + i] * _ODD[i % 16])
    return np.unique(_mixed(s))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(_K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        y = x[at : at + 256, None] * _A
        y += _B
        np.minimum(best, y.min(0), out=best)
    return best


def bands(m: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) * _ODD[15]
    for r in m.reshape(BANDS, ROWS).T:
        h = _mixed((h ^ r) * _ODD[14])
    return h.view(np.int64)


def packed(m: np.ndarray) -> bytes:
    low = (m & np.uint32(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << np.uint8(4))).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of all pairs of two arrays of packed signatures (as rows of uint64)."""
    differ = np.zeros((len(a), len(b)), np.int64)
    low = np.uint64(0x1111111111111111)
    for i in range(a.shape[1]):
        x = a[:, i, None] ^ b[None, :, i]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ += np.bitwise_count(x & low)
    chance = 2.0**-BITS
    return ((1 - differ / _K) - chance) / (1 - chance)


def _signed(words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some, n, digest, low, keys = batch.slice(at, 1024), [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingle_set(text, words)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    m = minima(s) if len(s) else None
                    low.append(packed(m) if len(s) else b"")
                    keys.append(bands(m) if len(s) else np.zeros(0, np.int64))
                yield pa.record_batch([some.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "low", "bands"])

    return run


def _linked(words: int):
    """Reads (comp, i, j, block, doc_id, low, text) sorted by (comp, i, j); yields joining links (u, v)."""

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        i, j = members[0][1], members[0][2]
        left = [m for m in members if m[3] == i]
        right = left if i == j else [m for m in members if m[3] == j]
        if not right or not left:
            return []
        width = -(-_K * BITS // 64)
        as_rows = lambda ms: np.frombuffer(b"".join(m[5].ljust(8 * width, b"\0") for m in ms), np.uint64).reshape(len(ms), width)
        close = estimates(as_rows(left), as_rows(right))
        a, b = np.nonzero(close >= PERCENT / 100 - MARGIN)
        if i == j:
            a, b = a[a < b], b[a < b]
        order = np.argsort(-close[a, b], kind="stable")
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(x):
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        def of(m):
            if m[4] not in sets:
                sets[m[4]] = shingle_set(m[6], words)
            return sets[m[4]]

        out = []
        for p, q in zip(a[order].tolist(), b[order].tolist(), strict=True):
            u, v = left[p], right[q]
            if find(u[4]) == find(v[4]):
                continue
            x, y = of(u), of(v)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                root[find(u[4])] = find(v[4])
                out.append((u[4], v[4]))
        return out

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

    def run(batches):
        out = []
        for _, members in groupby(rows(batches), key=lambda m: m[:3]):
            out += links(list(members))
            if len(out) > 5000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])
                out = []
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    return run


def near_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * common >= 80 * all shingles of ``words``
    words. Null and empty texts and white space have no shingle and no link. A
    document with a null doc_id is linked with nothing. Rows are compared each
    by itself, also where they share a doc_id: a component has the links of all
    of its rows, and is named by the smallest doc_id among them.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")))
    own = F.when(F.col("doc_id").isNull(), -1 - F.col(ROW)).otherwise(F.col(ROW)).alias("own")
    found = row_groups(rows.select(own, "text"), words).join(rows.select(own, "doc_id"), "own")
    # a table of its own, so that a component of very many rows can be split where it is joined
    least = cut(found.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = found.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def row_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """own, n_shingles, component (smallest own reachable) of rows own (different numbers; those below 0 are linked with nothing) and text."""
    rows = docs.select(F.col("own").alias("doc_id"), "text")
    signed = cut(rows.mapInArrow(_signed(words), "doc_id long, n_shingles long, digest binary, low binary, bands array<bigint>"))
    live = signed.where("n_shingles > 0 and doc_id >= 0")
    classes = cut(live.groupBy("digest").agg(F.min("doc_id").alias("id")))
    # one signature per class: equal sets have equal ones
    heads = live.join(classes, (live["digest"] == classes["digest"]) & (live["doc_id"] == classes["id"]), "left_semi")
    heads = cut(heads.select(F.col("doc_id").alias("id"), "low", "bands"))
    keys = heads.select("id", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("bucket", "first")
    # an id is linked to the smallest of its buckets' first ids, and those to each other once for all ids: the same components with about one edge an id
    firsts = keys.join(shared, "bucket").groupBy("id").agg(F.min("first").alias("v"), F.collect_set("first").alias("all"))
    edges = firsts.select(F.explode(F.array_union("all", F.array("id"))).alias("u"), "v").where("u <> v").distinct()
    groups = cut(components(cut(edges)))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "component").join(heads.select("id", "low"), "id")
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.join(rows.withColumnRenamed("doc_id", "id"), "id")
    other = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("component", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "low", "text")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    links = cut(dealt.mapInArrow(_linked(words), "u long, v long"))
    found = components(links).select("id", "component")
    named = classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & (F.col("doc_id") >= 0), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select(F.col("doc_id").alias("own"), "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: exactly one of each group.

    Every row counts by itself, whatever its doc_id. The smallest doc_id stays (null
    comes last), then the smallest MD5 of the text. A row without shingles stays.
    """
    rows = keyed(docs)
    found = row_groups(rows.select(F.col(ROW).alias("own"), text_of("text").alias("text"))).select(F.col("own").alias(ROW), F.col("component").alias("component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", ROW)
    best = rows.select(ROW, "doc_id", F.unhex(F.md5(text_of("text"))).alias("tie")).join(found, ROW).groupBy("component_id").agg(F.min(order).alias("best"))
    return rows.join(best.select(F.col(f"best.{ROW}").alias(ROW)), ROW, "left_semi").select(*docs.columns)
