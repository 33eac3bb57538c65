"""Passages of WINDOW words that were seen before, located by sharded Aho-Corasick automata.

Confirm: every window has an anchor, the leftmost of its grams of GRAM words
with the smallest hash. A window whose gram occurs once occurs once, so only
the stretches around anchors whose gram occurs again are cut out of the texts
(segments) and their windows counted by 128-bit hashes. A window that recurs is
a phrase; its first place is kept.

Compile: the phrases are dealt to shards by the place where they first stand,
so that those of one passage are together. A shard's phrases, as sequences of
word numbers, make one automaton of bounded size (PHRASES on average).

Stream: each segment goes to the shards that hold a phrase of it; the automaton
compares words, not hashes, and gives every place where a phrase stands. What
lies behind its first place is removed. Shards that many segments go to are
compiled several times, for ROUTED segments each.

A place is the number of all words of the documents before it, by doc_id (null
ones last). Texts that are the same as a whole take part once, under the
smallest doc_id; in the other rows all their words were seen before.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut, free, text_of
from cairn.llm.suffix_dedup import Hashed

#: Words of a phrase, and of the gram that anchors it.
WINDOW, GRAM = 20, 8
#: Windows of a segment, phrases of a shard on average, places that go to the same shard together (a power of two), and segments that one automaton reads.
SEGMENT, PHRASES, TOGETHER, ROUTED = 2048, 20_000, 1 << 11, 20_000
#: Words that are hashed together, and windows that are looked at together.
_PIECE = 1 << 16
_LOW = np.uint64((1 << 18) - 1)
_SPAN = WINDOW - GRAM + 1
_BASES = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each word (k: 0 or 1, for two independent ones)."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(words), _PIECE):
        data = b" ".join(words[at : at + _PIECE])
        stops = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
        out.append(Hashed(data).sub(np.concatenate(([0], stops[:-1] + 1)), stops, k))
    return np.concatenate(out)


def rolled(h: np.ndarray, width: int, k: int) -> np.ndarray:
    """A hash of every ``width`` neighbours."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _BASES[k] + h[j : n + j]
    return _mixed(out)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram, first and last window of each anchor, from the words' hashes."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, grams = [], []
    for begin in range(0, n, _PIECE):
        g = rolled(h[begin : min(begin + _PIECE, n) + WINDOW - 1], GRAM, 0)
        least = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width < _SPAN:  # of each _SPAN neighbours, by ever wider steps
            step = min(width, _SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place = (least & _LOW).astype(np.int64)
        places.append(place + begin)
        grams.append(g[place])
    place = np.concatenate(places)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    return np.concatenate(grams)[first], first, np.append(first[1:] - 1, n - 1)


def _rows(batches, size: int = 512):
    for batch in batches:
        for begin in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, size).columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _anchored(batches):
    """key, doc, n_words, grams of each text."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            some = batch.slice(begin, 512)
            grams, ends, sizes = [np.zeros(0, np.uint64)], [0], []
            for data in some.column(2):
                words = data.as_py().split()
                sizes.append(len(words))
                if len(words) >= WINDOW:
                    grams.append(anchors(word_hashes(words, 0))[0])
                    ends.append(ends[-1] + len(grams[-1]))
                else:
                    ends.append(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams).view(np.int64)))
            yield pa.record_batch([some.column(0), some.column(1), pa.array(sizes, pa.int64()), lists], names=["key", "doc", "n_words", "grams"])


def _numbered(batches):
    """Sorted rows (key, doc, copies, n_words, grams) with part and the words of the part's rows before them."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(3).to_numpy()
        within = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        yield pa.record_batch([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(within, pa.int64())], names=[*batch.schema.names, "part", "within"])


_SEGMENTS = pa.schema([("key", pa.binary()), ("begin", pa.int64()), ("place", pa.int64()), ("words", pa.binary()), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64()))])


def _segments(batches):
    """(key, bytes, base, numbers of the anchors whose gram occurs again) -> segments with the hashes of their windows."""
    last, out, held = None, [], 0
    for key, data, base, again in _rows(batches):
        if key == last:  # another row with the same text
            continue
        last, words = key, data.split()
        h = word_hashes(words, 0)
        _, first, end = anchors(h)
        again = np.sort(np.array(again, np.int64))
        joins = np.flatnonzero(end[again][:-1] + 1 != first[again][1:]) + 1
        others = word_hashes(words, 1)
        for begin, stop in zip(first[again][np.append(0, joins)].tolist(), (end[again][np.append(joins - 1, len(again) - 1)] + 1).tolist(), strict=True):
            for at in range(begin, stop, SEGMENT):
                to = min(at + SEGMENT, stop) + WINDOW - 1
                hashes = [rolled(x[at:to], WINDOW, k).view(np.int64) for k, x in enumerate((h, others))]
                out.append((key, at, base + at, b" ".join(words[at:to]), *hashes))
                held += to - at
        if held > 200_000:
            yield _batch(out, _SEGMENTS)
            out, held = [], 0
    yield _batch(out, _SEGMENTS)


_FOUND = pa.schema([("key", pa.binary()), ("spans", pa.list_(pa.int64()))])


def _located(batches):
    """Sorted rows (shard, salt, kind, key, begin, place, words, homes): phrases (kind 0) before segments (kind 1) -> spans of words to remove."""
    import ahocorasick

    out: list[tuple] = []
    for _, rows in groupby(_rows(batches, 64), key=lambda r: r[:2]):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        numbers: dict[bytes, int] = {}
        firsts: list[int] = []
        ready = False
        for _, _, kind, key, begin, place, data, homes in rows:
            if kind == 0:
                sequence = tuple([numbers.setdefault(w, len(numbers) + 1) for w in data.split()])
                for p in homes:
                    automaton.add_word(sequence[p : p + WINDOW], len(firsts))
                    firsts.append(place + p)
                continue
            if not firsts:
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            spans: list[int] = []
            for end, phrase in automaton.iter(tuple([numbers.get(w, 0) for w in data.split()])):
                at = end - WINDOW + 1
                if place + at > firsts[phrase]:
                    if spans and begin + at <= spans[-1]:
                        spans[-1] = begin + end + 1
                    else:
                        spans += (begin + at, begin + end + 1)
            if spans:
                out.append((key, spans))
                if len(out) >= 512:
                    yield _batch(out, _FOUND)
                    out = []
    yield _batch(out, _FOUND)


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    data = text_of("text").cast("binary")
    return docs.select(*columns, data.alias("bytes"), F.unhex(F.md5(data)).alias("key"))


def seen_before(docs: DataFrame) -> DataFrame:
    """key (MD5 of the text), doc (its smallest doc_id), copies (rows with this text), spans (begins and ends, in words, that were seen before in its first row): of each text with copies or spans."""
    spark = docs.sparkSession
    doc = F.col("doc_id").cast("long").alias("doc")
    texts = _keyed(docs, doc)
    anchored = texts.select("key", "doc", "bytes").mapInArrow(_anchored, "key binary, doc long, n_words long, grams array<bigint>")
    one = anchored.groupBy("key").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"), F.first("grams").alias("grams"))
    order = [F.col("doc").isNull(), "doc", "key"]
    numbered = one.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, one.schema.simpleString()[7:-1] + ", part long, within long")
    one = cut(numbered)
    free(spark)
    # one row for each part; a part starts where those before it end
    starts = one.groupBy("part").agg(F.max(F.col("within") + F.col("n_words")).alias("size"))
    starts = starts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    named = one.select("part", "within", F.posexplode("grams").alias("nth", "gram"), F.xxhash64("key").alias("t"))
    # a table of its own, so that Spark can split a gram that very many texts have when it joins
    often = cut(named.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    free(spark)
    told = named.join(often.hint("shuffle_merge"), "gram").groupBy("part", "within", "t").agg(F.collect_list("nth").alias("again"))
    told = told.join(F.broadcast(starts), "part").select("part", "within", "t", (F.col("start") + F.col("within")).alias("base"), "again")
    told = cut(told.join(one.select("part", "within", F.xxhash64("key").alias("t"), "key").hint("shuffle_merge"), ["part", "within", "t"]).select("key", "base", "again"))
    free(spark)
    segments = texts.select("key", "bytes").join(told.hint("shuffle_merge"), "key").select("key", "bytes", "base", "again")
    segments = segments.mapInArrow(_segments, "key binary, begin long, place long, words binary, w1 array<bigint>, w2 array<bigint>")
    segments = cut(segments.withColumn("segment", F.monotonically_increasing_id()))
    free(spark)
    windows = segments.select("segment", F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w"), "place")
    windows = windows.select("segment", "at", (F.col("place") + F.col("at")).alias("place"), "w.w1", "w.w2")
    phrases = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").select("w1", "w2", "first")
    phrases = cut(phrases)
    free(spark)
    shards = -(-phrases.count() // PHRASES) or 1
    shard = F.pmod(F.xxhash64(F.shiftright("first", TOGETHER.bit_length() - 1)), F.lit(shards)).alias("shard")
    places = windows.join(phrases.hint("shuffle_merge"), ["w1", "w2"]).select("segment", shard, F.when(F.col("place") == F.col("first"), F.col("at")).alias("home"))
    routes = cut(places.groupBy("segment", "shard").agg(F.collect_list("home").alias("homes"), F.count(F.lit(1)).alias("n")))
    free(spark)
    parts = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ROUTED).alias("salts"))
    routed = routes.join(parts, "shard").join(segments.select("segment", "key", "begin", "place", "words").hint("shuffle_merge"), "segment")
    none = F.lit(None).cast("array<int>")
    supply = routed.where(F.size("homes") > 0).select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "key", "begin", "place", "words", "homes")
    read = routed.where(F.col("n") > F.size("homes")).select("shard", F.pmod(F.xxhash64("segment"), "salts").alias("salt"), F.lit(1).alias("kind"), "key", "begin", "place", "words", none.alias("homes"))
    found = supply.unionByName(read).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_located, "key binary, spans array<bigint>")
    found = cut(found)
    free(spark)
    copied = one.where("copies > 1").select("key", "doc", "copies", F.array().cast("array<bigint>").alias("spans"))
    marked = copied.unionByName(found.select("key", F.lit(None).cast("long").alias("doc"), F.lit(0).cast("long").alias("copies"), "spans"))
    return cut(marked.groupBy("key").agg(F.max("doc").alias("doc"), F.max("copies").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans")))


def kept_words(data: bytes, whole: bool, spans: list[int] | None) -> tuple[list[bytes], int]:
    """(words that stay, number of all words); whole: every window was seen before."""
    words = data.split()
    n = len(words)
    if whole and n >= WINDOW:
        return [], n
    if spans:
        keep = np.ones(n, bool)
        for begin, end in zip(spans[::2], spans[1::2], strict=True):
            keep[begin:end] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return words, n


def _digested(batches):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    schema = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()), (names[2], pa.int64()), (names[3], pa.string())])
    out = []
    for doc_id, data, later, spans in _rows(batches):
        words, n = kept_words(data, later, spans)
        out.append((doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        if len(out) >= 1024:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def _judged(docs: DataFrame, *columns) -> DataFrame:
    """columns, bytes, later (the text stands in a row before), spans."""
    rows = _keyed(docs, F.col("doc_id").cast("long").alias("own"), *columns)
    seen = seen_before(docs.select("doc_id", "text"))
    later = (F.coalesce("copies", F.lit(0)) > 1) & ~F.col("own").eqNullSafe(F.col("doc"))
    return rows.join(seen.hint("shuffle_merge"), "key", "left").withColumn("later", later)


def phrase_digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. Rows with the same doc_id and text share their
    verdict: neither is earlier. Different texts under one doc_id go by MD5. Null
    doc_ids come after all others. Texts of any length are taken whole. An empty
    table gives no rows. Other columns are not read.
    """
    return _judged(docs).select("own", "bytes", "later", "spans").mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def phrase_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without phrases seen before, the words that stay joined by one space; texts that lose nothing stay as they are.

    Every row stays, null texts stay null, and so do all other columns.
    """
    columns = docs.columns

    def run(batches):
        for batch in batches:
            row, texts = batch.column(0), []
            own = row.field(columns.index("text")).to_pylist()
            for text, data, later, spans in zip(own, *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words, n = kept_words(data, later, spans)
                texts.append(text if len(words) == n else b" ".join(words).decode())
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else row.field(i) for i, c in enumerate(columns)], names=columns)

    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    return _judged(docs, whole).select("row", "bytes", "later", "spans").mapInArrow(run, docs.schema)


#: The contract's columns in SQL, for documents with different ids.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
p AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT h, min(row(doc_id, i)) AS first FROM p GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM p JOIN f USING (h) WHERE row(doc_id, i) > first),
s AS (SELECT n.doc_id, string_agg(word, ' ' ORDER BY n.k) AS kept, count(*) AS n FROM n ANTI JOIN g ON g.doc_id = n.doc_id AND g.k = n.k GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""
