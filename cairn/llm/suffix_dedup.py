"""Removal of byte strings of LENGTH bytes that occur more than once, by a distributed merge sort of suffixes.

Suffixes are sorted where they can matter. Every window of LENGTH bytes has an
anchor: the leftmost of its grams of GRAM bytes with the smallest hash. Equal
windows have equal grams at the same offset, so a window whose gram occurs
once in the corpus occurs once, and only anchors whose gram occurs again are
looked at. Their suffixes, with the bytes before them, are collapsed where
they are the same and sorted into runs by each task; the runs are front-coded,
exchanged by range of suffix, and merged by a loser tree that never compares a
known prefix again. The merge yields the common prefixes of neighbours; with
those of the reversed text before the anchors they say, byte by byte, which
windows are the same. Texts that are the same as a whole (MD5) take part once.

The surroundings of an anchor reach as far as any window around it. Grams with
more than HOT different surroundings, as those of a passage in very many
documents, would be one heavy group in the merge: their windows are counted by
128-bit hashes instead, which combine before the shuffle and spread evenly. Of
anchors whose surroundings are the same, too, one stands for all there.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, free, text_of
from cairn.llm.suffix_merge import class_ends, decoded, front_coded, merged

#: Bytes of a repeated string, and of the gram that anchors it.
LENGTH, GRAM = 200, 48
#: Different surroundings of a gram up to which it is merged as one group, and suffixes of a bucket on average.
HOT, BUCKET = 4096, 20_000
#: Suffixes that are looked at for each bucket to find where the ranges begin; it bears on the balance of tasks alone.
SAMPLED = 50
#: Bytes of suffixes that a task holds before it closes its runs.
HELD = 8 << 20

_WINDOWS = LENGTH - GRAM + 1
_LEFT = LENGTH - GRAM
#: Windows that are looked at together, which bounds the memory for a text of any length; places within are numbered by the low 24 bits.
_PIECE = 1 << 18
_LOW = np.uint64((1 << 24) - 1)
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_ahead = [_powers(b, 1 << 12) for b in _BASE]
_back = [_powers(pow(b, -1, 1 << 64), 1 << 12) for b in _BASE]


def _grown(n: int) -> None:
    if len(_ahead[0]) < n:
        for k, b in enumerate(_BASE):
            _ahead[k], _back[k] = _powers(b, 2 * n), _powers(pow(b, -1, 1 << 64), 2 * n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of any substring of a text, from sums of prefixes."""

    def __init__(self, data: bytes):
        self.codes = np.frombuffer(data, np.uint8)
        self.n = len(data)
        _grown(self.n + 1)
        self.sums: list = [None, None]

    def sub(self, begin: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        return _mixed((self._sums(k)[end] - self._sums(k)[begin]) * _back[k][begin])

    def _sums(self, k: int) -> np.ndarray:
        if self.sums[k] is None:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_BYTE[k][self.codes] * _ahead[k][: self.n], out=s[1:])
            self.sums[k] = s
        return self.sums[k]

    def grams(self) -> np.ndarray:
        s = self._sums(0)
        return _mixed((s[GRAM:] - s[:-GRAM]) * _back[0][: self.n - GRAM + 1])


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """The anchors of a text: at, first and last window of each, gram, surroundings (hashes)."""

    def __init__(self, data: bytes):
        windows = len(data) - LENGTH + 1
        parts = [self._piece(data, begin, min(begin + _PIECE, windows)) for begin in range(0, windows, _PIECE)]
        self.at, self.first, self.left, self.right, self.gram, self.around = (np.concatenate(x) for x in zip(*parts, strict=True))
        new = np.concatenate(([True], self.at[1:] != self.at[:-1]))  # an anchor on both sides of a piece's end is one
        for name in ("at", "first", "left", "right", "gram", "around"):
            setattr(self, name, getattr(self, name)[new])
        self.last = np.concatenate((self.first[1:] - 1, [windows - 1]))

    @staticmethod
    def _piece(data: bytes, begin: int, end: int) -> tuple:
        low = max(0, begin - _LEFT)
        h = Hashed(data[low : end + 2 * LENGTH])
        grams = h.grams()
        v = grams[begin - low : end - low + _WINDOWS - 1]
        v = (v & ~_LOW) | np.arange(len(v), dtype=np.uint64)
        place = (_least(v, _WINDOWS) & _LOW).astype(np.int64)
        new = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        at = place[new] + begin
        left, right = np.minimum(at, _LEFT), np.minimum(len(data) - at, LENGTH)
        size = (left * 256 + right).astype(np.uint64)
        around = _mixed(h.sub(at - left - low, at + right - low, 1) + size * np.uint64(0x9E3779B97F4A7C15))
        return at, new + begin, left, right, grams[at - low], around


def _anchored(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            some = batch.slice(begin, 512)
            grams, around, ends = [], [], [0]
            for data in some.column(1):
                data, n = data.as_py(), 0
                if len(data) >= LENGTH:
                    a = Anchors(data)
                    grams.append(a.gram)
                    around.append(a.around)
                    n = len(a.at)
                ends.append(ends[-1] + n)
            of = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64)))  # noqa: E731, B023
            yield pa.record_batch([some.column(0), of(grams), of(around)], names=["key", "gram", "around"])


#: What a text's anchor is told: its suffix is to be merged; its windows are to be counted; all its windows occur again.
_MERGE, _COUNT, _SURE = 1, 2, 4
_ITEM = np.dtype([("item", "<i8"), ("from", "u1"), ("to", "u1"), ("left", "u1"), ("right", "u1"), ("again", "?")])


def _pack_run(items: dict[tuple[bytes, bytes], list]) -> bytes:
    """Items (suffix, before) -> [item, from, to, again] as a front-coded run."""
    some = sorted(items.items())
    shared, lengths, rests = front_coded([k[0] for k, _ in some])
    table = np.zeros(len(some), _ITEM)
    for i, name in enumerate(("item", "from", "to", "again")):
        table[name] = [v[i] for _, v in some]
    table["left"], table["right"] = [len(k[1]) for k, _ in some], [len(k[0]) for k, _ in some]
    before = b"".join(k[1] for k, _ in some)
    return b"".join((struct.pack("<III", len(some), len(rests), len(before)), shared, lengths, rests, before, table.tobytes()))


def _open_run(data: bytes):
    n, n_rests, n_before = struct.unpack_from("<III", data)
    ends = np.cumsum([12, n, n, n_rests, n_before]).tolist()
    shared, lengths, rests, before = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))
    return decoded(shared, lengths, rests), before, np.frombuffer(data, _ITEM, n, ends[-1])


def _told(batches):
    """(key, bytes, anchors, numbers of the anchors to merge, of those to count, of sure ones) of each different text."""
    last = None
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column(0)[i].as_py()
            if key == last:  # a copy of the same text; the join has sorted by key
                continue
            last, data, told = key, batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), np.int64)
            which = told >> 3
            yield key, data, Anchors(data), *(which[told & x > 0].tolist() for x in (_MERGE, _COUNT, _SURE))


def _heads(batches):
    """The first bytes of the suffixes to merge, as numbers in the order of the bytes."""
    for _, data, a, merge, _, _ in _told(batches):
        yield pa.record_batch([pa.array([int.from_bytes(data[x : x + 8], "big") - (1 << 63) for x in a.at[merge].tolist()], pa.int64())], names=["head"])


_RIM = "key binary, items array<bigint>, ats array<bigint>, sure array<bigint>, bucket int, run binary, w1 bigint, w2 bigint, at bigint, off int"


def _rims(bounds: list[int]):
    """Reads (key, bytes, told); yields the items that each text has, runs of items by bucket, and windows to count."""
    many = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.binary()), ("items", many), ("ats", many), ("sure", many), ("bucket", pa.int32()), ("run", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64()), ("at", pa.int64()), ("off", pa.int32())])
    edges = np.array(bounds, np.int64)

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, dict] = {}
        size, number = 0, TaskContext.get().partitionId() << 40
        keys, items, ats, spans = [], [], [], []

        def close():
            nonlocal size
            size = 0
            for bucket in sorted(held):
                yield rows(bucket=[bucket], run=[_pack_run(held.pop(bucket))])
            yield rows(key=keys, items=items, ats=ats, sure=spans)
            for x in (keys, items, ats, spans):
                x.clear()

        for key, data, a, merge, count, sure in _told(batches):
            mine = []
            heads = [int.from_bytes(data[x : x + 8], "big") - (1 << 63) for x in a.at[merge].tolist()]
            for j, bucket in zip(merge, np.searchsorted(edges, heads, side="right").tolist(), strict=True):
                at, left = int(a.at[j]), int(a.left[j])
                suffix, before = data[at : at + int(a.right[j])], data[at - left : at][::-1]
                own = held.setdefault(bucket, {})
                if (item := own.get((suffix, before))) is None:
                    own[suffix, before] = item = [number, at - int(a.last[j]), at - int(a.first[j]), False]
                    number += 1
                    size += len(suffix) + left
                else:
                    item[3] = True  # the same bytes around: all its windows occur again
                mine.append(item[0])
            if merge or sure:
                keys.append(key)
                items.append(mine)
                ats.append(a.at[merge].tolist())
                spans.append(np.column_stack((a.first[sure], a.last[sure] + LENGTH)).ravel().tolist())
            for j in count:
                first, last, at = int(a.first[j]), int(a.last[j]), int(a.at[j])
                h, p = Hashed(data[first : last + LENGTH]), np.arange(last - first + 1)
                yield rows(key=[key] * len(p), w1=h.sub(p, p + LENGTH, 0).view(np.int64), w2=h.sub(p, p + LENGTH, 1).view(np.int64), at=[at] * len(p), off=(at - first - p).astype(np.int32))
            if size > HELD:
                yield from close()
        yield from close()

    return run


def repeated_windows(runs: list[bytes]) -> list[tuple[int, int, int]]:
    """(item, least and greatest offset of its repeated windows) of the items in the runs that have any."""
    opened = [_open_run(r) for r in runs]
    firsts = np.cumsum([0, *(len(t) for _, _, t in opened)])
    nth = [int(x) for x in firsts[:-1]]
    order, shared = [], []
    for run, common, _ in merged([s for s, _, _ in opened]):
        order.append(nth[run])
        nth[run] += 1
        shared.append(common)
    order, shared = np.array(order), np.array(shared)
    items = np.concatenate([t for _, _, t in opened])
    n = len(items)
    before = np.zeros((n, _LEFT), np.uint8)
    before[np.arange(_LEFT) < items["left"][:, None]] = np.frombuffer(b"".join(b for _, b, _ in opened), np.uint8)
    # the texts before the anchors, read backwards, in order and with their common prefixes
    by_left = np.argsort(before.view(f"S{_LEFT}").ravel(), kind="stable")
    near = before[by_left]
    differ = near[1:] != near[:-1]
    shared_left = np.concatenate(([0], np.where(differ.any(1), differ.argmax(1), _LEFT)))
    low, high = np.full(n, 255), np.full(n, -1)
    again = items["again"]
    low[again], high[again] = items["from"][again], items["to"][again]
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for off in range(_WINDOWS):
        live = np.flatnonzero((items["from"] <= off) & (off <= items["to"]) & (items["left"] >= off) & (items["right"] >= LENGTH - off))
        if len(live) < 2:
            continue
        right_class[order] = class_ends(shared, LENGTH - off)
        left_class[by_left] = class_ends(shared_left, off) if off else 0
        window = right_class[live] * (n + 1) + left_class[live]
        sort = np.argsort(window, kind="stable")
        same = window[sort][1:] == window[sort][:-1]
        found = live[sort[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]
        low[found] = np.minimum(low[found], off)
        high[found] = np.maximum(high[found], off)
    found = np.flatnonzero(high >= 0)
    return list(zip(items["item"][found].tolist(), low[found].tolist(), high[found].tolist(), strict=True))


def _merged(batches):
    def rows():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    for _, some in groupby(rows(), key=lambda r: r[0]):
        found = repeated_windows([r for _, r in some])
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else ((),) * 3, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["item", "low", "high"])


def _kept(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            out = []
            for doc_id, data, copied, spans in zip(*(batch.slice(begin, 512).column(i).to_pylist() for i in range(4)), strict=True):
                kept, removed, n_spans = keep(data, [0, len(data)] if copied and len(data) >= LENGTH else spans or [])
                out.append((doc_id, len(data), removed, n_spans, hashlib.sha256(kept).hexdigest()))
            yield pa.record_batch([pa.array(x, pa.string() if i == 4 else pa.int64()) for i, x in enumerate(zip(*out, strict=True))], names=names)


def keep(data: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """(remaining bytes, number of removed ones, removed runs) for spans as a flat list of begins and ends, in any order."""
    parts, at, n = [], -1, 0
    for begin, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if begin > at:
            parts.append(data[max(at, 0) : begin])
            n += 1
        at = max(at, end)
    kept = b"".join([*parts, data[max(at, 0) :]])
    return kept, len(data) - len(kept), n


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    data = text_of("text").cast("binary")
    return docs.select(*columns, data.alias("bytes"), F.unhex(F.md5(data)).alias("key"))


def _bounds(told: DataFrame, texts: DataFrame, size: int) -> list[int]:
    """Where the ranges of the buckets begin, from the suffixes of some texts."""
    buckets = -(-size // BUCKET)
    if buckets < 2:
        return []
    some = told.where(F.pmod(F.xxhash64("key"), F.lit(max(1, size // (SAMPLED * buckets)))) == 0)
    heads = texts.join(F.broadcast(some.select(F.col("key").alias("k"))), F.col("key") == F.col("k"), "left_semi").join(some, "key")
    heads = heads.select("key", "bytes", "told").sortWithinPartitions("key").mapInArrow(_heads, "head bigint")
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return sorted(set(heads.agg(F.percentile_approx("head", shares, 10 * buckets).alias("b")).first().b or []))


def repeats(docs: DataFrame) -> DataFrame:
    """key (MD5 of the text), copied (the whole text occurs again), spans: of each text with something to remove."""
    spark = docs.sparkSession
    texts = _keyed(docs).select("key", "bytes")
    anchored = texts.mapInArrow(_anchored, "key binary, gram array<bigint>, around array<bigint>")
    anchored = cut(anchored.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("gram").alias("gram"), F.first("around").alias("around")))
    free(spark)
    zipped = anchored.select("key", F.posexplode(F.arrays_zip("gram", "around")).alias("nth", "a")).select("key", "nth", "a.gram", "a.around")
    name = F.xxhash64("key", "nth")
    seen = cut(zipped.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first")))
    free(spark)
    grams = seen.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    seen = cut(seen.join(grams.hint("shuffle_merge"), "gram").select("gram", "around", "n", "first", F.when(F.col("kinds") > HOT, _COUNT).otherwise(_MERGE).alias("way")))
    size = seen.where(F.col("way") == _MERGE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    free(spark)
    stands = F.when(name == F.col("first"), F.lit(_COUNT)).otherwise(0) + F.when(F.col("n") > 1, _SURE).otherwise(0)
    told = zipped.join(seen.hint("shuffle_merge"), ["gram", "around"]).select("key", (F.col("nth") * 8 + F.when(F.col("way") == _MERGE, _MERGE).otherwise(stands)).alias("told"))
    told = cut(told.groupBy("key").agg(F.collect_list("told").alias("told")))
    copied = anchored.where("copies > 1").select("key")
    free(spark)
    bounds = _bounds(told, texts, size)
    rims = cut(texts.join(told.hint("shuffle_merge"), "key").mapInArrow(_rims(bounds), _RIM))
    free(spark)
    runs = rims.where("run is not null").select("bucket", "run").repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket")
    # each of these is written by itself, so that no task holds the buffers of several joins
    found = cut(runs.mapInArrow(_merged, "item bigint, low int, high int"))
    free(spark)
    items = rims.where("items is not null").select("key", F.explode(F.arrays_zip("items", "ats")).alias("m")).select("key", F.col("m.items").alias("item"), F.col("m.ats").alias("at"))
    span = lambda low, high: F.array(F.col("at") - F.col(high), F.col("at") - F.col(low) + LENGTH).alias("spans")
    spans = items.join(found, "item").select("key", span("low", "high"))
    spans = spans.unionByName(rims.where("size(sure) > 0").select("key", F.col("sure").alias("spans")))
    windows = rims.where("w1 is not null").select("w1", "w2", "key", "at", "off")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    counted = windows.join(again.hint("shuffle_merge"), ["w1", "w2"]).groupBy("key", "at").agg(F.min("off").alias("low"), F.max("off").alias("high"))
    spans = spans.unionByName(cut(counted.select("key", span("low", "high"))))
    free(spark)
    marked = spans.withColumn("copied", F.lit(False)).unionByName(copied.select("key", F.array().cast("array<bigint>").alias("spans"), F.lit(True).alias("copied")))
    out = cut(marked.groupBy("key").agg(F.max("copied").alias("copied"), F.flatten(F.collect_list("spans")).alias("spans")))
    free(spark)
    return out.select("key", "copied", F.when(~F.col("copied"), F.col("spans")).alias("spans"))


def suffix_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Rows with the same text, whatever their doc_ids (null
    ones too), lose it whole if it has LENGTH bytes or more. A text of any
    length is taken whole. Other columns are not read.
    """
    rows = _keyed(docs, F.col("doc_id").cast("long")).join(repeats(docs.select("text")).hint("shuffle_merge"), "key", "left")
    return rows.select("doc_id", "bytes", "copied", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the repeated byte strings, n_chars (if there) counted anew.

    A character that loses some of its bytes goes whole. Null texts stay null,
    every row stays, whatever its doc_id, and so do all other columns.
    """
    columns = docs.columns

    def run(batches):
        for batch in batches:
            row, texts = batch.column(0), []
            own = row.field(columns.index("text")).to_pylist()
            for text, data, copied, spans in zip(own, *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                kept, _, n = keep(data, [0, len(data)] if copied and len(data) >= LENGTH else spans or [])
                texts.append(kept.decode("utf-8", "ignore") if n else text)
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else row.field(i) for i, c in enumerate(columns)], names=columns)

    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    out = _keyed(docs, whole).join(repeats(docs.select("text")).hint("shuffle_merge"), "key", "left").select("row", "bytes", "copied", "spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
