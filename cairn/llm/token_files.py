"""Token ids in Re-Pair compressed shard files, in ascending doc_id order.

Documents are range-partitioned by doc_id and sorted; each task encodes its
texts and writes shards of at most SHARD ids (a longer document has a shard of
its own). A shard repeatedly replaces its most frequent adjacent id pairs by
nonterminals and keeps the rules with the length that each expands to, so that
any range of a document's ids can be read without expanding the rest. The
shards travel through Spark's Parquet writer, one row a shard with its bytes,
and so through its commit protocol and any file system it knows.

A shard, little-endian: magic, then uint32 counts (rules, symbols, documents),
uint8 bits of a symbol; left symbols of the rules, their right symbols and the
symbols themselves, each packed by bits; uint32 expansion length per rule; per
document int64 doc_id, uint8 whether that is null, uint32 first symbol, uint32
first id. Symbols below BASE are ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import shared_path, text_of
from cairn.llm.tokens import END, tokenizer_file, word_encoder

MAGIC = b"CRP2"
#: Number of ids of the vocabulary; nonterminals follow.
BASE = 49408
#: Ids of a shard, and occurrences that pay for a rule's two symbols and length.
SHARD, OFTEN = 1 << 20, 6
_HASH_BITS = 19
_DEAD = 1 << _HASH_BITS


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The slot in which a pair is counted; pairs with END have one of their own that counts nothing."""
    slots = (((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(32 - _HASH_BITS)).astype(np.int32)
    slots[(left == END) | (right == END)] = _DEAD
    return slots


def _apart(at: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Whether a place stays if of each run of one symbol only every other place does, from the left."""
    stay = np.ones(len(at), bool)
    runs = at[alike]
    if len(runs):
        fresh = np.concatenate(([True], np.diff(runs) > 1))
        begin = runs[np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))]
        stay[alike] = (runs - begin) % 2 == 0
    return stay


def _claimed(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places are taken if of two that overlap the one with the higher rank comes first, and no further one fits."""
    taken = np.zeros(len(at), bool)
    left = np.arange(len(at))
    while len(left):
        beside = np.diff(at[left]) == 1
        r = rank[left]
        wins = np.ones(len(left), bool)
        wins[1:] &= ~beside | (r[1:] > r[:-1])
        wins[:-1] &= ~beside | (r[:-1] > r[1:])
        taken[left[wins]] = True
        out = wins.copy()
        out[1:] |= wins[:-1] & beside
        out[:-1] |= wins[1:] & beside
        left = left[~out]
    return taken


def re_pair(ids: np.ndarray, base: int = BASE, often: int = OFTEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left and right symbol of each rule). Pairs with END are never replaced, so no symbol spans two documents.

    Each round replaces all pairs that pay; where two of them want the same
    symbol, the more frequent one gets it, so the most frequent pair of all is
    always replaced everywhere, and others where that leaves room. The rounds end when no pair occurs ``often``
    times. Pairs are counted in hash slots, which follow the replacements: a
    slot that stays under ``often`` holds no pair that pays. While most places
    are still in question one pair stands for its slot and others wait; once
    they are few, and always before the end, pairs are counted themselves.
    """
    seq = ids.astype(np.uint32)
    lefts, rights, n_rules = [], [], 0
    slots = _slots(seq[:-1], seq[1:])
    counts = np.bincount(slots, minlength=_DEAD + 1)
    exact = False
    while len(slots):
        counts[_DEAD] = 0
        at = np.flatnonzero((counts >= often)[slots])
        left, right = seq[at], seq[at + 1]
        stay = _apart(at, left == right)
        at, key = at[stay], left[stay].astype(np.uint64) << np.uint64(32) | right[stay]
        exact = exact or 4 * len(at) < len(seq)
        if exact:
            pairs, which = np.unique(key, return_inverse=True)
        else:
            which, pairs = slots[at], np.zeros(_DEAD, np.uint64)
            pairs[which] = key
            own = pairs[which] == key
            at, which = at[own], which[own]
        found = np.bincount(which, minlength=len(pairs))
        pays = found >= often
        if not pays.any():
            if exact:
                break
            exact = True
            continue
        hit = pays[which]
        at, which = at[hit], which[hit]
        wins = _claimed(at, (found * len(pairs) + np.arange(len(pairs)))[which])
        at, which = at[wins], which[wins]
        pays = np.bincount(which, minlength=len(pairs)) >= often
        hit = pays[which]
        at, which = at[hit], which[hit]
        number = (np.cumsum(pays) - 1 + n_rules + base).astype(np.uint32)
        # the pairs around each place go, those around the new symbol come
        near = np.zeros(len(seq) + 1, bool)
        near[at] = near[at + 1] = near[at - 1] = True
        gone = slots[near[: len(slots)]]
        seq[at] = number[which]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, slots = seq[keep], slots[keep[:-1]][: len(seq) - len(at) - 1]
        at = at - np.arange(len(at))
        near = np.zeros(len(seq) + 1, bool)
        near[at] = near[at - 1] = True
        fresh = np.flatnonzero(near[: len(slots)])
        slots[fresh] = _slots(seq[fresh], seq[fresh + 1])
        np.subtract.at(counts, gone.astype(np.intp), np.int64(1))
        np.add.at(counts, slots[fresh].astype(np.intp), np.int64(1))
        lefts.append((pairs[pays] >> np.uint64(32)).astype(np.uint32))
        rights.append((pairs[pays] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        n_rules += int(pays.sum())
    empty = np.zeros(0, np.uint32)
    return seq, np.concatenate(lefts or [empty]), np.concatenate(rights or [empty])


def _by_level(left: np.ndarray, right: np.ndarray, base: int) -> list[np.ndarray]:
    """The rules in groups: each needs only ids and rules of groups before it (a rule's symbols have smaller numbers)."""
    level = np.zeros(base + len(left), np.int32)
    while len(left):
        new = np.maximum(level[left], level[right]) + 1
        if (new == level[base:]).all():
            break
        level[base:] = new
    order = np.argsort(level[base:], kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[base:][order])) + 1) if len(left) else []


def _lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each symbol expands to."""
    size = np.ones(base + len(left), np.uint32)
    for some in _by_level(left, right, base):
        size[base + some] = size[left[some]] + size[right[some]]
    return size


def _gathered(flat: np.ndarray, starts: np.ndarray, size: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The expansions of some symbols, one after the other."""
    n = size[symbols].astype(np.int64)
    ends = np.cumsum(n)
    return flat[np.repeat(starts[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _expansions(left: np.ndarray, right: np.ndarray, size: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(all expansions one after the other, where each symbol's begins)."""
    starts = np.concatenate(([0], np.cumsum(size[:-1], dtype=np.int64)))
    flat = np.zeros(int(starts[-1] + size[-1]), np.uint32)
    flat[:base] = np.arange(base)
    for some in _by_level(left, right, base):
        n = size[base + some].astype(np.int64)
        ends = np.cumsum(n)
        where = np.repeat(starts[base + some] - (ends - n), n) + np.arange(ends[-1])
        flat[where] = _gathered(flat, starts, size, np.column_stack((left[some], right[some])).ravel())
    return flat, starts


def _packed(symbols: np.ndarray, bits: int) -> bytes:
    # eight symbols fill as many bytes as a symbol has bits, and each of these takes parts of few symbols
    eight = np.zeros((-(-len(symbols) // 8), 8), np.uint32)
    eight.reshape(-1)[: len(symbols)] = symbols
    eight = np.ascontiguousarray(eight.T)
    out = np.zeros((eight.shape[1], bits), np.uint8)
    for k in range(bits):
        byte = np.zeros(eight.shape[1], np.uint32)
        for nth in range(8 * k // bits, (8 * k + 7) // bits + 1):
            shift = (nth + 1) * bits - 8 * k - 8
            byte |= eight[nth] >> np.uint32(shift) if shift >= 0 else eight[nth] << np.uint32(-shift)
        out[:, k] = byte  # the last eight bits of it
    return out.tobytes()[: -(-len(symbols) * bits // 8)]


def _unpacked(data: np.ndarray, bits: int, begin: int, end: int) -> np.ndarray:
    """Symbols begin to end of packed ones; only their bytes are looked at."""
    first = begin * bits // 8
    raw = np.unpackbits(data[first : -(-end * bits // 8)])[begin * bits - 8 * first :][: (end - begin) * bits]
    wide = np.zeros((end - begin, 32), np.uint8)
    wide[:, 32 - bits :] = raw.reshape(-1, bits)
    return np.packbits(wide).view(">u4").astype(np.uint32)


_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("symbol", "<u4"), ("first", "<u4")])
_HEAD = struct.Struct("<IIIB")


def write_shard(documents: list[tuple[int | None, bytes]]) -> bytes:
    """The file of some documents (doc_id, ids as little-endian uint32 bytes with the end id)."""
    ids = np.frombuffer(b"".join(x for _, x in documents), "<u4")
    firsts = np.cumsum([0, *(len(x) // 4 for _, x in documents)])[:-1]
    seq, left, right = re_pair(ids)
    size = _lengths(left, right, BASE)
    ends = np.cumsum(size[seq], dtype=np.int64)
    bits = (BASE + len(left) - 1).bit_length()
    index = np.zeros(len(documents), _INDEX)
    index["doc_id"], index["null"] = [i or 0 for i, _ in documents], [i is None for i, _ in documents]
    index["symbol"], index["first"] = np.searchsorted(ends, firsts, side="right"), firsts
    head = MAGIC + _HEAD.pack(len(left), len(seq), len(documents), bits)
    return b"".join((head, *(_packed(x, bits) for x in (left, right, seq)), size[BASE:].astype("<u4").tobytes(), index.tobytes()))


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        n_rules, self.n_symbols, n_docs, self.bits = _HEAD.unpack_from(data, 4)
        at, parts = 4 + _HEAD.size, []
        for n in (n_rules, n_rules, self.n_symbols):
            parts.append(np.frombuffer(data, np.uint8, -(-n * self.bits // 8), at))
            at += parts[-1].nbytes
        sizes = np.frombuffer(data, "<u4", n_rules, at)
        self.index = np.frombuffer(data, _INDEX, n_docs, at + sizes.nbytes)
        self.packed = parts[2]
        left, right = (_unpacked(x, self.bits, 0, n_rules) for x in parts[:2])
        self.size = np.concatenate((np.ones(BASE, np.uint32), sizes))
        self.flat, self.starts = _expansions(left, right, self.size, BASE)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.starts, self.size, seq)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order."""
        ids = self._expand(_unpacked(self.packed, self.bits, 0, self.n_symbols))
        stops = [*self.index["first"][1:].tolist(), len(ids)]
        for i, (doc_id, null, _, first) in enumerate(self.index.tolist()):
            yield None if null else doc_id, ids[first : stops[i]]

    def read(self, nth: int, start: int, length: int) -> np.ndarray:
        """Some ids of the nth document; only the symbols that hold them are expanded."""
        stop = int(self.index["symbol"][nth + 1]) if nth + 1 < len(self.index) else self.n_symbols
        seq = _unpacked(self.packed, self.bits, int(self.index["symbol"][nth]), stop)
        ends = np.cumsum(self.size[seq], dtype=np.int64)
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, start + length, side="left")) + 1
        skip = start - (int(ends[first - 1]) if first else 0)
        return self._expand(seq[first:last])[skip : skip + length]


def _writer(path: str):
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, shard, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal shard, held, n
            row = pa.record_batch({"part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()), "n_ids": pa.array([n // 4], pa.int64()), "data": pa.array([write_shard(held)], pa.binary())})
            shard, held, n = shard + 1, [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                ids = some.column(0).to_pylist()
                for doc_id, data in zip(ids, word_encoder(path).encode_all(some.column(1).to_pylist()), strict=True):
                    if held and n + len(data) + 4 > 4 * SHARD:
                        yield close()
                    held.append((doc_id, data + end))
                    n += len(data) + 4
        if held:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of every text of ``docs`` (null: empty) with the end id, in ascending doc_id order, to ``path``.

    Null ids come first. Rows with the same or a null doc_id follow each other
    by a hash of their texts, then by the texts: an id with many rows is spread
    over tasks as well. A text of any length is one document; one longer than
    SHARD ids has a shard of its own. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    shards = ordered.mapInArrow(_writer(tokenizer or tokenizer_file()), "part long, shard long, n_ids long, data binary")
    # ids are packed already: another compression would not pay
    shards.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def _reader(batches):
    out = []

    def rows():
        fields = ["part", "shard", "place", "doc_id", "n_tokens", "ids_crc32"]
        batch = pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 6)], names=fields)
        out.clear()
        return batch

    for batch in batches:
        for part, shard, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            place = 0
            for doc_id, ids in Shard(data.as_py()).documents():
                out.append((part.as_py(), shard.as_py(), place, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                place += len(ids)
            if len(out) > 10_000:
                yield rows()
    if out:
        yield rows()


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    rows = files.select("part", "shard", "data").mapInArrow(_reader, "part long, shard long, place long, doc_id long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    # within a range partition first, then over one row per partition
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    bases = parts.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and current row) - n AS base")
    inner = sizes.selectExpr("part", "shard", "sum(n) over (partition by part order by shard rows between unbounded preceding and current row) - n AS inner")
    starts = inner.join(bases, "part")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path)
