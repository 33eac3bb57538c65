"""Repair of damaged conversations by weighted interval parsing.

A conversation's rows are edited (keep, change of role, deletion, insertion) until
their role initials are a word of ``(s?(ua)+)?``. The grammar of all edited
conversations is in Chomsky normal form: with 0 to 3 as the states of that
language's automaton, nonterminal [p, q] derives every edit of a span of rows
that leads from p to q, and [p, q] -> [p, r] [r, q] are all its binary rules. A cell
holds the cheapest (cost, audit) of one nonterminal over one span. Insertions
need no row, so the cells of single rows are closed under insertions on both
sides. Every derivation of a span can be cut at any row, so all splits of a
span give the same cell and one is enough: spans are combined bottom-up by
their length, first inside blocks of BLOCK rows, then blocks by WIDE at a time
in rounds of a Spark job each. (Of two audits of one span with the same cost
none begins with the other, as what follows would be insertions that cost
something; so the least audit of a span is made of least audits of its parts.)

Rows are ordered by range over all tasks and blocks are parts of those ranges,
so a conversation of any length is parsed by many tasks. Its audit (a byte a
row) and its digest, which SHA-256 takes in order, are the result's and are
streamed through one task with no more than the audit in memory.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm.common import cut

#: Rows of a block, and blocks that one step of a round combines.
BLOCK, WIDE = 256, 256
#: Costs of edits; a truncated row that stays adds ROUGH.
REROLE, DELETE, INSERT, ROUGH = 2, 3, 2, 1

#: The automaton of ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The nonterminals, those with no word left out, and for each the pairs of parts by number.
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in PAIRS]
_FAIR = {"su", "ua", "au"}

Cell = list[tuple[int, str] | None]


def joined(left: Cell, right: Cell) -> Cell:
    """The cells of a span from those of its two parts."""
    out: Cell = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = left[i], right[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost <= best[0]:
                    found = (cost, a[1] + b[1])
                    if best is None or found < best:
                        best = found
        out.append(best)
    return out


def _insertions() -> Cell:
    """The closure of the empty span: what insertions alone lead to."""
    none = [(0, "") if p == q else None for p, q in PAIRS]
    one = [(INSERT, "I") if any(_NEXT.get((p, c)) == q for c in "ua") else none[i] for i, (p, q) in enumerate(PAIRS)]
    return joined(one, joined(one, one))


_EMPTY = _insertions()


@lru_cache(maxsize=None)
def row_cell(initial: str, gone: bool, rough: bool) -> tuple:
    """The cells of one row: gone rows must be deleted, rough ones cost more if they stay."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in PAIRS]
    for i, (p, q) in enumerate(PAIRS):
        if not gone:
            if any(_NEXT.get((p, c)) == q for c in "ua"):
                cell[i] = min(cell[i] or (99, ""), (REROLE + rough * ROUGH, "R"))
            if _NEXT.get((p, initial)) == q:
                cell[i] = min(cell[i] or (99, ""), (rough * ROUGH, "K"))
    return tuple(joined(_EMPTY, joined(cell, _EMPTY)))


def parsed(spans: list) -> Cell:
    """The cells of all the rows, from neighbouring spans upwards by length."""
    while len(spans) > 1:
        pairs = [joined(a, b) for a, b in zip(spans[::2], spans[1::2], strict=False)]
        spans = pairs + ([spans[-1]] if len(spans) % 2 else [])
    return list(spans[0])


def best(cell: Cell) -> tuple[int, str]:
    """Cheapest (cost, audit) of a conversation: none of its rows stays, or it ends after an answer."""
    return min(cell[_AT[0, 0]], cell[_AT[0, 3]])


class Block:
    """What is known of consecutive rows of one conversation. Its rows come in order; so do the blocks that it takes in."""

    def __init__(self, initial: str, turn: int | None, fault: int, gone: bool):
        self.spans = [row_cell(initial if initial in ("s", "u", "a") else "", gone, fault == 3)]
        self.first = self.last = initial
        self.faults = [fault == 1, fault == 2, fault == 3, 0]
        self.low, self.high, self.turns = turn, turn, int(turn is not None)

    @classmethod
    def of(cls, costs, audits, first, last, faults, low, high, turns):
        self = cls.__new__(cls)
        self.spans = [[None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]]
        self.first, self.last, self.faults, self.low, self.high, self.turns = first, last, list(faults), low, high, turns
        return self

    def take(self, other: Block) -> None:
        self.spans += other.spans
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        self.faults[3] += self.last + other.first not in _FAIR
        self.last = other.last
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    def row(self) -> tuple:
        cell = parsed(self.spans)
        cost, audit = best(cell)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        costs, audits = [None if c is None else c[0] for c in cell], [None if c is None else c[1] for c in cell]
        return costs, audits, self.first, self.last, [int(x) for x in self.faults], self.low, self.high, self.turns, gaps, cost, audit


_BLOCK = "part long, nth long, whole boolean, costs array<long>, audits array<string>, first string, last string, faults array<long>, low long, high long, turns long, gaps long, cost long, audit string"


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    many = lambda t: pa.list_(t)
    types = [key, pa.int64(), pa.int64(), pa.bool_(), many(pa.int64()), many(pa.string()), pa.string(), pa.string(), many(pa.int64())] + [pa.int64()] * 5 + [pa.string()]
    names = ["conv_id", *(x.strip().split(" ")[0] for x in _BLOCK.split(", "))]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _leaves(key: pa.DataType):
    """Ordered rows (conv_id, turn, role, digest, blank, rough, first turn) of one range -> its blocks."""

    def run(batches):
        from pyspark import TaskContext

        part, out, block, n, nth, begun, last = TaskContext.get().partitionId(), [], None, 0, 0, True, None
        for row in _rows(batches):
            conv, turn, role, digest, blank, rough, again, first = row
            same = last is not None and last[0] == conv
            if block is not None and (n == BLOCK or not same):
                # a conversation that has a neighbour on both sides in this range is whole
                out.append((conv if same else last[0], part, nth, not same and nth == 0 and not begun, *block.row()))
                begun, nth, block = begun and same, nth + 1 if same else 0, None
                if len(out) >= 500:
                    yield _batch(out, key)
                    out = []
            copy = same and (turn, role, digest) == last[1:4]
            fault = 1 if blank else 2 if copy or (again and turn != first) else 3 if rough else 0
            one = Block(role[:1], turn, fault, fault in (1, 2))
            if block is None:
                block, n = one, 1
            else:
                block.take(one)
                n += 1
            last = row
        if block is not None:
            out.append((last[0], part, nth, False, *block.row()))
        yield _batch(out, key)

    return run


def _round(key: pa.DataType):
    """Blocks (conv_id, part, nth, ...) in order -> one block of those that share part and nth."""

    def run(batches):
        out, block, last = [], None, None
        for conv, part, nth, *rest in _rows(batches):
            one = Block.of(*rest)
            if block is not None and last == (conv, part, nth):
                block.take(one)
                continue
            if block is not None:
                out.append((*last, False, *block.row()))
                if len(out) >= 500:
                    yield _batch(out, key)
                    out = []
            block, last = one, (conv, part, nth)
        if block is not None:
            out.append((*last, False, *block.row()))
        yield _batch(out, key)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` deals; nulls are one space there and in role and text."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def parse(rows: DataFrame) -> DataFrame:
    """One block per conv_id of ``rows`` (conv_id, turn, role, text): its faults, gaps, cost and audit."""
    kind = rows.schema["conv_id"].dataType
    key, schema = to_arrow_type(kind), f"conv_id {kind.simpleString()}, {_BLOCK}"
    slim = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("rough"),
    )
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    again = slim.groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), earliest.alias("e")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.lit(True).alias("again"), F.col("e.turn").alias("first"))
    slim = slim.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").select(*slim.columns, F.coalesce("again", F.lit(False)).alias("again"), "first")
    order = ["conv_id", "turn", "role", "digest"]
    blocks = cut(slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_leaves(key), schema))
    whole, rest = blocks.where("whole"), blocks.where("not whole")
    columns = ["costs", "audits", "first", "last", "faults", "low", "high", "turns"]
    while any(ends := rest.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.max("nth"), F.lit(0))).first()):
        # the blocks of a range first, then the ranges
        group = ["part", F.floor(F.col("nth") / WIDE).alias("nth")] if ends[1] else [F.floor(F.col("part") / WIDE).alias("part"), F.lit(0).cast("long").alias("nth")]
        some = rest.select("conv_id", *group, *columns, F.col("part").alias("p"), F.col("nth").alias("k"))
        some = some.repartition("conv_id", "part", "nth").sortWithinPartitions("conv_id", "part", "nth", "p", "k").drop("p", "k")
        rest = cut(some.mapInArrow(_round(key), schema))
    return whole.unionByName(rest)


def repaired(rows, audit: str):
    """The lines role:text of a conversation's rows (role, text) under an audit of edits; rows are read one by one."""
    letters, n = iter(audit), 0

    def line(role: str, text: str, letter: str) -> str:
        nonlocal n
        if letter == "K" and role[:1] == "s":
            return f"{role}:{text}"
        n += 1  # questions and answers take turns, so the place says which role a row has now
        return f"{role if letter == 'K' else 'user' if n % 2 else 'assistant'}:{text}"

    for role, text in rows:
        for letter in letters:
            if letter == "I":
                yield line("", "", letter)
                continue
            if letter != "D":
                yield line(role, text, letter)
            break
    for letter in letters:
        yield line("", "", letter)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _texts(row, rows):
    """(role, text) of this row and of the rest of the rows."""
    yield row[2:4]
    for r in rows:
        yield r[2:4]


def _digested(key: pa.DataType):
    """Sorted rows (conv_id, kind, role, text, counts, audit), a parse (kind 0) before its texts (kind 1) -> one row per conversation."""
    types = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches):
        out = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            counts, audit, texts = [0] * 6, "", ()
            for row in rows:
                if row[1] == 1:
                    texts = _texts(row, rows)
                    break
                if row[1] == 0:
                    counts, audit = row[4], row[5]
            sha, gap = hashlib.sha256(), b""
            for text in repaired(texts, audit):
                sha.update(gap + text.encode())
                gap = b"\n"
            out.append((conv, *counts, audit, sha.hexdigest()))
            if len(out) == 1000:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after ``damaged``.

    Rows go by turn (null turns first), rows with the same turn by role and
    then by MD5 of the text. Of a row's faults the first counts. A role is known by its
    first character; one that is empty or stands for no word of the grammar
    can only be changed or deleted. A null conv_id is a conversation of its own.
    A conversation of which no row is left has zeros, an empty audit and the
    digest of nothing. An empty table gives no rows. Other columns are not read.
    """
    return _judged(conversations.select("conv_id").distinct(), damaged(conversations))


def _judged(ids: DataFrame, rows: DataFrame) -> DataFrame:
    kind = ids.schema["conv_id"].dataType
    blocks = parse(rows)
    none, no_audit = F.lit(None).cast("array<bigint>").alias("counts"), F.lit(None).cast("string").alias("audit")
    blank = F.lit(None).cast("string")
    counts = F.array("gaps", *[F.col("faults")[i] for i in range(4)], "cost").alias("counts")
    order = [F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest")]
    every = ids.select("conv_id", F.lit(-1).alias("kind"), blank.alias("role"), blank.alias("text"), none, no_audit, *order)
    every = every.unionByName(blocks.select("conv_id", F.lit(0).alias("kind"), blank.alias("role"), blank.alias("text"), counts, "audit", *order))
    digest = F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")
    every = every.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "role", "text", none, no_audit, "turn", digest))
    sorted_rows = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("turn", "digest")
    result = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return sorted_rows.mapInArrow(_digested(to_arrow_type(kind)), result)


def _sql() -> str:
    """The same in SQL, for conversations whose turns differ: the automaton is walked row by row, the best of each state kept."""
    edges = ", ".join(f"({p}, '{c}', {q})" for (p, c), q in _NEXT.items())
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE bits AS (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS n)),
t AS (SELECT list(c ORDER BY n) AS crc FROM bits),
k AS (SELECT c.conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations c),
d AS (SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda a, b: xor(a // 256, crc[xor(a, b) % 256 + 1])), 4294967295) % 20 AS kind FROM k, t),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM m),
r AS (SELECT *, role[1] AS letter, CASE WHEN NOT regexp_matches(text, '{word}') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
e AS (SELECT * FROM (VALUES {edges}) AS x(p, l, q)),
i AS (SELECT s AS p, s AS q, 0 AS cost, '' AS audit FROM (SELECT unnest(range(4)) AS s) UNION ALL SELECT p, q, {INSERT}, 'I' FROM e WHERE l <> 's' UNION ALL SELECT a.p, b.q, {2 * INSERT}, 'II' FROM e a JOIN e b ON b.p = a.q WHERE a.l <> 's' AND b.l <> 's'),
z AS (SELECT conv_id, 0 AS pos, i.q, i.cost, i.audit FROM c, i WHERE i.p = 0
  UNION ALL SELECT conv_id, pos, q, cost, audit FROM (
    SELECT z.conv_id, z.pos + 1 AS pos, i.q, z.cost + x.cost + i.cost AS cost, z.audit || x.audit || i.audit AS audit FROM z JOIN r ON r.conv_id = z.conv_id AND r.pos = z.pos + 1,
    LATERAL (SELECT z.q AS q, {DELETE} AS cost, 'D' AS audit UNION ALL SELECT e.q, {ROUGH} * (r.fault = 3)::INT, 'K' FROM e WHERE e.p = z.q AND e.l = r.letter AND r.fault NOT IN (1, 2) UNION ALL SELECT e.q, {REROLE} + {ROUGH} * (r.fault = 3)::INT, 'R' FROM e WHERE e.p = z.q AND e.l <> 's' AND r.fault NOT IN (1, 2)) x
    JOIN i ON i.p = x.q QUALIFY row_number() OVER (PARTITION BY z.conv_id, i.q ORDER BY z.cost + x.cost + i.cost, z.audit || x.audit || i.audit) = 1)),
b AS (SELECT c.conv_id, z.cost, z.audit FROM c JOIN z ON z.conv_id = c.conv_id AND z.pos = c.n AND z.q IN (0, 3) QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY z.cost, z.audit) = 1),
l AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS nth FROM b),
v AS (SELECT conv_id, nth, audit[nth] AS edit, length(replace(substr(audit, 1, nth), 'I', '')) AS pos FROM l),
u AS (SELECT v.conv_id, v.nth, v.edit, CASE WHEN v.edit = 'I' THEN '' ELSE r.role END AS role, CASE WHEN v.edit = 'I' THEN '' ELSE r.text END AS text, coalesce(v.edit = 'K' AND r.letter = 's', false) AS first FROM v LEFT JOIN r ON r.conv_id = v.conv_id AND r.pos = v.pos WHERE v.edit <> 'D'),
y AS (SELECT conv_id, nth, CASE WHEN edit = 'K' THEN role WHEN sum((NOT first)::INT) OVER (PARTITION BY conv_id ORDER BY nth) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line FROM u),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS lines FROM y GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c USING (conv_id) LEFT JOIN b USING (conv_id) LEFT JOIN h USING (conv_id)"""


#: For conversations with an id and turns that differ, as in the given tables.
SQL = _sql()
