"""Harmonic packing of documents into sequences of at most CAPACITY tokens.

A sequence of class k holds k pieces of at most CAPACITY // k tokens. A document
is cut into full sequences and, for the rest, into pieces that fill their
class's slot to at least FULL: a rest that would leave a larger gap is cut at
the next smaller class's slot. So the class of a piece says how many share its
sequence, and each task fills sequences of each class on its own, k pieces at a
time. The fewer than k pieces of a class that a task has left over go to one
more round by class, and what that leaves is laid best fit by falling length,
in groups of about GROUP pieces that do not depend on each other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, text_of
from cairn.llm.tokens import END, tokenizer_file, word_encoder

CAPACITY = 4096
#: Share of its slot that a piece fills at least, unless it is the last of at most TINY tokens.
FULL, TINY = 0.97, 64
#: Pieces that are laid best fit together, and pieces left by all tasks of which a round by class has no more in one part.
GROUP, PART = 20_000, 4_000_000
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, slot long, sequence_id long, offset long"


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of n tokens."""
    out = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if rest >= FULL * slot or rest <= TINY:
            out.append((k, rest))
            break
        out.append((k + 1, capacity // (k + 1)))
        rest -= capacity // (k + 1)
    return out


def _fill(pieces: list, k: int) -> list[list]:
    return [pieces[i : i + k] for i in range(0, len(pieces) - k + 1, k)]


def _pack(path: str, capacity: int):
    end = np.array([END], "<u4").tobytes()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in _SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        held, out = defaultdict(list), []

        def rows():
            batch = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 9, types, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                some = batch.slice(begin, 4096)
                for doc_id, data in zip(some.column(0).to_pylist(), word_encoder(path).encode_all(some.column(1).to_pylist()), strict=True):
                    data += end
                    at, n = 0, len(data) // 4
                    for k, length in piece_lengths(n, capacity):
                        held[k].append((doc_id, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n))
                        at += length
                        if len(held[k]) == k:
                            offset = 0
                            for slot, p in enumerate(held.pop(k)):
                                out.append((*p, k, slot, sequence, offset))
                                offset += p[2]
                            sequence += 1
                if len(out) > 10_000:
                    yield rows()
        for k, pieces in held.items():
            out += [(*p, k, None, None, None) for p in pieces]
        if out:
            yield rows()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its one id is the end id. Rows are packed as they
    come; rows with the same or a null doc_id are packed like all others. A
    text of any length is encoded whole and cut; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    pieces = cut(rows.mapInArrow(_pack(tokenizer or tokenizer_file(), capacity), _SCHEMA))
    full = pieces.where("sequence_id is not null")
    left = pieces.where("sequence_id is null")
    # at most k - 1 pieces of class k from each task come here
    some = F.xxhash64("doc_id", "start", "length", "ids_crc32")
    parts = 1 + left.count() // PART
    by_class = Window.partitionBy("class", "part").orderBy("doc_id", "start", "length", "ids_crc32")
    left = left.withColumn("part", F.pmod(some, F.lit(parts)).cast("int"))
    left = left.withColumn("nth", F.row_number().over(by_class) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("class", "part")))
    left = left.withColumn("bin", F.floor(F.col("nth") / F.col("class")))
    in_bin = F.col("bin") < F.floor(F.col("all") / F.col("class"))
    span = Window.partitionBy("class", "part", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    number = F.lit(1 << 62) + F.col("class").cast("long") * (1 << 44) + F.col("part").cast("long") * (1 << 24) + F.col("bin")
    filled = left.where(in_bin).withColumn("sequence_id", number).withColumn("offset", F.coalesce(F.sum("length").over(span), F.lit(0)))
    rest = cut(left.where(~in_bin).select(*[x.split()[0] for x in _SCHEMA.split(", ")]))
    groups = 1 + rest.count() // GROUP
    last = rest.groupBy(F.pmod(some, F.lit(groups)).alias("group")).applyInPandas(_best_fit(capacity, groups), _SCHEMA)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(columns).unionByName(filled.select(columns)).unionByName(last.select(columns))


def _best_fit(capacity: int, groups: int):
    def run(key, pieces):
        """Each piece, the longest first, goes where it leaves the least room."""
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        base, n_open, rooms = (1 << 62) + (1 << 61) + int(key[0]), 0, []
        sequences, offsets = [], []
        for n in pieces["length"].tolist():
            i = bisect_left(rooms, (n, -1))
            room, number = rooms.pop(i) if i < len(rooms) else (capacity, n_open)
            n_open += number == n_open
            sequences.append(base + number * groups)
            offsets.append(capacity - room)
            if room > n:
                insort(rooms, (room - n, number))
        pieces["sequence_id"], pieces["offset"], pieces["slot"] = sequences, offsets, 0
        return pieces[[x.split()[0] for x in _SCHEMA.split(", ")]]

    return run
