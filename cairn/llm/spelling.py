"""Spelling variants: words one edit apart, found by walking a trie as a relation, level by level.

The trie of the vocabulary is a distributed table of edges. A node is the
prefix that it stands for; it has edges of its own only if two words or more go
on from it, otherwise the rest of its one word hangs on the edge that leads
there. The frontier is a table of states (word, position, node, edits). Level t
joins the states at nodes of depth t with the edges of that depth: a state
without an edit follows its word's own edge, and takes any other edge as a
replaced or an inserted character; a state with an edit follows its word's next
character only. A state that cannot take its next character at the new node is
left out at once, as edges carry the characters that go on from their end. A
state with one edit whose word ends at a word of the trie is a pair.

One edit leaves one half of a word as it is. So words are walked forwards and
backwards, and enter the trie at the node of the half that is left; the edit is
looked for in the other half, where nodes have few edges and few words. Of a
pair only one direction is walked (replacement by a greater character,
insertion where it cannot come later), so each is found once; a deletion is the
insertion seen from the other word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, free

#: Code points and occurrences of a word, one run in DAMAGED loses a code point, and how much more often a form occurs.
LENGTH, OFTEN, DAMAGED, TIMES = 5, 3, 97, 2
#: Prefix lengths that are counted in one job, different words that a task holds, and characters that are split at once.
DEPTHS, HELD, SLICE = 32, 150_000, 1 << 20

_RUN, _OTHER = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _slices(text: str):
    """The text in parts that end outside of words."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            stop = _OTHER.search(text, end)
            end = stop.end() if stop else len(text)
        yield text[at:end]
        at = end


def _counted(batches):
    """(word, n) of the documents' runs after damage; what a task holds is sent on when it is much."""
    lowered: dict[str, tuple[str, bytes]] = {}
    counts: dict[str, int] = {}

    def out():
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for some in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
        for doc_id, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
            runs: Counter[str] = Counter()
            for part in _slices(text or ""):
                runs.update(_RUN.findall(part))
            begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in runs.items():
                if (known := lowered.get(run)) is None:
                    low = run.lower() if run.isascii() else run.translate(_LOWER)
                    if len(lowered) > HELD:
                        lowered.clear()
                    lowered[run] = known = low, low.encode()
                word, data = known
                h = zlib.crc32(data, begin)
                if h % DAMAGED == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= LENGTH:
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > HELD:
                yield out()
                counts.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough, written."""
    words = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    return cut(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN))


def _at(path: str, position: Column | int) -> Column:
    """The character of a path at a position from 0."""
    return F.substring(path, F.lit(position) + 1 if isinstance(position, int) else position + 1, F.lit(1))


def trie(paths: DataFrame) -> DataFrame:
    """The edges of both directions, written: back, depth, node, char, child, target and target_n (the one path below a leaf's edge, or the one that ends at child), leaf, next (characters that go on).

    A path has the edges below its first half, as no word enters above that of another that is near.
    """
    half = F.floor((F.col("size") - 1) / 2).cast("int")
    counted, some, low = [], paths, 0
    while True:
        depth = F.explode(F.sequence(F.greatest(F.lit(low), half) + 1, F.least("size", F.lit(low + DEPTHS)))).alias("depth")
        prefixes = some.where((F.col("size") > low) & (half < low + DEPTHS)).select("back", "path", "n", "size", depth)
        ends = F.max(F.when(F.col("size") == F.col("depth"), F.col("n"))).alias("end_n")
        nodes = prefixes.groupBy("back", F.substring("path", F.lit(1), F.col("depth")).alias("child"), "depth").agg(F.count(F.lit(1)).alias("words"), F.min("path").alias("path"), F.min("n").alias("n"), ends)
        counted.append(cut(nodes))
        low += DEPTHS
        if some.where(F.col("size") > low).isEmpty():
            break
        # paths go on where they have not begun or still share a prefix
        deep = counted[-1].where((F.col("depth") == low) & (F.col("words") > 1)).select(F.col("back").alias("b"), F.col("child").alias("shared"), F.lit(True).alias("on"))
        some = some.where(F.col("size") > low).join(deep, (F.col("back") == F.col("b")) & (F.substring("path", 1, low) == F.col("shared")), "left")
        some = cut(some.where((half >= low) | F.col("on")).select(*paths.columns))
    nodes = counted[0]
    for more in counted[1:]:
        nodes = nodes.unionByName(more)
    inner = nodes.where("words > 1").select("back", "depth", "child", F.when(F.col("end_n").isNotNull(), F.col("child")).alias("target"), F.col("end_n").alias("target_n"), F.lit(False).alias("leaf"))
    # the shortest prefix that no other path has is where the rest of a path hangs
    alone = nodes.where("words = 1").groupBy("back", F.col("path").alias("target"), F.col("n").alias("target_n")).agg(F.min("depth").alias("depth"))
    leaves = alone.select("back", "depth", F.substring("target", F.lit(1), F.col("depth")).alias("child"), "target", "target_n", F.lit(True).alias("leaf"))
    edges = inner.unionByName(leaves).select("back", "depth", F.substring("child", F.lit(1), F.col("depth") - 1).alias("node"), _at("child", F.col("depth") - 1).alias("char"), "child", "target", "target_n", "leaf")
    edges = cut(edges)
    onward = edges.groupBy("back", F.col("node").alias("child")).agg(F.concat_ws("", F.sort_array(F.collect_set("char"))).alias("next"))
    return cut(edges.join(onward, ["back", "child"], "left"))


_STATE = ["back", "path", "n", "size"]


def _arrived(joined: DataFrame) -> DataFrame:
    """States and pairs of rows that have taken an edge; pos is the character to take next, edits tells whether one has been made."""
    rest = F.substring("path", F.col("pos") + 1, F.col("size"))
    at_end = F.col("pos") >= F.col("size")
    edited = F.col("edits") == 1
    pair = edited & F.when(F.col("leaf"), F.col("target") == F.concat("child", rest)).otherwise(at_end & F.col("target").isNotNull())
    onward = ~F.col("leaf") & (~edited | (~at_end & F.col("next").contains(_at("path", F.col("pos")))))
    out = joined.where(pair | onward)
    return out.select(*_STATE, "pos", F.col("child").alias("node"), "edits", F.when(pair, F.col("target")).alias("near"), F.when(pair, F.col("target_n")).alias("near_n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n of words that are exactly one edit apart, each pair once."""
    spark = words.sparkSession
    both = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("path")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("path")))).alias("p")
    paths = cut(words.select("n", both).select("p.back", "p.path", "n", F.char_length("p.path").alias("size")))
    edges = trie(paths)
    free(spark)
    # forwards the first half (rounded down) is left as it is, backwards the rest
    entry = F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2)).cast("int")
    ends = edges.agg(F.min("depth"), F.max("depth")).first()
    states, found = None, []
    for level in range((ends[0] or 1) - 1, ends[1] or 0):
        here = edges.where(F.col("depth") == level + 1).drop("depth")
        enter = paths.where(entry == level).select(*_STATE, F.lit(level).alias("pos"), F.substring("path", 1, level).alias("node"), F.lit(0).alias("edits"))
        plain = enter if states is None else enter.unionByName(states.where("edits = 0"))
        plain = plain.join(here, ["back", "node"])
        own, before = _at("path", level), F.substring("path", level, 1)
        later = F.when(F.col("back"), (entry < level) & (F.col("char") != before)).otherwise((F.col("size") == level) | (F.col("char") != own))
        step = lambda pos, edits: F.struct(F.lit(pos).alias("pos"), F.lit(edits).alias("edits"))
        follow = F.when(F.col("char") == own, step(level + 1, 0))
        replace = F.when((F.col("size") > level) & (F.col("char") > own), step(level + 1, 1))
        steps = F.array_compact(F.array(follow, replace, F.when(later, step(level, 1))))
        frontier = _arrived(plain.drop("pos", "edits").select("*", F.inline(steps)))
        if states is not None:
            edited = states.where("edits = 1").withColumn("char", _at("path", F.col("pos"))).join(here, ["back", "node", "char"])
            frontier = frontier.unionByName(_arrived(edited.withColumn("pos", F.col("pos") + 1)))
        frontier = cut(frontier)
        free(spark)
        found.append(frontier.where("near is not null").select("back", "path", "n", "near", "near_n"))
        states = frontier.where("near is null").select(*_STATE, "pos", "node", "edits")
    out = found[0] if found else paths.select("back", "path", "n", F.col("path").alias("near"), F.col("n").alias("near_n")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    forwards = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias("word" if c == "path" else c)
    return out.select(forwards("path"), "n", forwards("near"), "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form. Each round doubles the way that is known; forms grow TIMES more frequent with each step, so rounds are few."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = cut(steps.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` with LENGTH code points and OFTEN occurrences.

    Null and empty texts have no words; a null doc_id is the empty string where
    the damage is dealt. Repeated rows count again, rows with the same doc_id
    are damaged alike. Near words that are equally frequent go by code points.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    words = vocabulary(docs)
    free(docs.sparkSession)
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    better = -F.col("best.m") >= TIMES * F.col("n")
    best = cut(best.select("word", "n_near", F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.m")).alias("form_n")))
    free(docs.sparkSession)
    out = words.join(best, "word", "left").join(_roots(best.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: The contract's columns in SQL, for documents with an id.
SQL = """
WITH RECURSIVE bits AS (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS n)),
t AS (SELECT list(c ORDER BY n) AS crc FROM bits),
x AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
y AS (SELECT w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS bytes FROM x GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a // 256, crc[xor(a, b) % 256 + 1])), 4294967295) AS h FROM y, t),
g AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
f AS (SELECT p.word, count(*) AS n_near, min(row(-b.n, b.word)) AS best FROM p JOIN v b ON b.word = p.near GROUP BY 1),
o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root, 0 AS steps FROM o UNION ALL SELECT r.word, o.form, steps + 1 FROM r JOIN o ON o.word = r.root WHERE o.form IS NOT NULL)
SELECT o.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM o JOIN (SELECT word, arg_max(root, steps) AS root FROM r GROUP BY 1) USING (word)
"""
