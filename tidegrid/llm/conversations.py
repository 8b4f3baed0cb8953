"""Cheapest repair of conversations, by a DuckDB recursive query inside hash-partitioned batches.

A conversation is well formed if the initials of its roles give `(s?(ua)+)?`. A row may be
kept (free), have its role set to user or assistant (`REROLE`), or be deleted (`DELETE`;
blank and duplicate rows must be), and an empty user or assistant turn may be inserted
anywhere (`INSERT`); a truncated row that stays adds `TRUNCATED`. The grammar has four
states: nothing yet, after s, after u, after a. `MOVES` lists what one row, with the
inserts before it, can do from each state.

1. `ordered`: rows get their places (a range shuffle, so a long conversation is spread).
2. `with_faults`: the first fault of each row. A row is a duplicate if an equal one has a
   lower place; least places are taken by segment first, so a row that a long
   conversation repeats without end meets as one value a segment.
3. `audits`: conversations are cut into segments of `SEGMENT` rows. Whole segments are
   dealt by hash; a task gives batches of them to DuckDB, whose recursive query advances
   all by one turn a step and keeps, for each segment, state at its start and state now,
   the least (cost, audit). The same query then joins `FAN` segments at a time, until a
   conversation has one row a state. So no task holds a long conversation's rows, only
   audits: one letter a row and insert.
4. `edited`: rows and audits are dealt by conversation and read in order, one row at a
   time. A hash of a conversation's text has to be taken in order, so one task reads a
   conversation here, without keeping it.

Among audits of one cost the least as ASCII text is taken. Any two audits that reach one
state by the same rows at one cost differ before either ends, so the least of each state
is part of the least of the whole.

Defined results: a null role or text is one space (so null text is blank, and a role of
one space can only be changed or deleted); an empty role likewise; rows of null conv_id
are one conversation; a null turn comes first; equal turns go by role, then text; rows
that repeat all of these are duplicates; conversations without rows get cost 0 and an
empty audit; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._duck import crc32
from ._order import indexed
from ._session import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT, FAN, BATCH = 128, 8, 1 << 14
SPACES = " \t\n\x0b\x0c\r"
NONE, S, U, A = range(4)
#: The state after an insert
INSERTED = {NONE: U, S: U, U: A, A: U}
#: What is inserted after the last row: inserts to reach a whole conversation
LAST = {NONE: 0, S: 2, U: 1, A: 0}
#: A row's class: must go, or the initial that it has; 4 more if it is truncated
GONE, KINDS = 0, {"s": 1, "u": 2, "a": 3, "": 4}


def moves() -> list[tuple[int, int, int, int, str]]:
    """(class, state, next state, cost, letters): the least way of each row with up to two inserts before it."""
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for kind in range(9):
        late, initial = (kind > 4) * TRUNCATED, {1: "s", 2: "u", 3: "a", 5: "s", 6: "u", 7: "a"}.get(kind, "")
        for start in (NONE, S, U, A):
            at, cost, letters = start, 0, ""
            for _ in range(3):
                ways = [(at, DELETE, "D")]
                if kind != GONE:
                    ways += [(U, KEEP + late, "K")] * (initial == "u" and at != U) + [(A, KEEP + late, "K")] * (initial == "a" and at == U) + [(S, KEEP + late, "K")] * (initial == "s" and at == NONE)
                    ways += [(A if at == U else U, REROLE + late, "R")]
                for to, more, letter in ways:
                    key, value = (kind, start, to), (cost + more, letters + letter)
                    best[key] = min(best.get(key, value), value)
                at, cost, letters = INSERTED[at], cost + INSERT, letters + "I"
    return [(*k, *v) for k, v in sorted(best.items())]


ADVANCE = """
WITH RECURSIVE walk AS (
  SELECT g.grp, 0 AS pos, e.state AS entry, e.state AS state, CAST(0 AS BIGINT) AS cost, '' AS audit
  FROM groups g JOIN (SELECT unnest([0, 1, 2, 3]) AS state) e ON e.state = 0 OR NOT g.first
  UNION ALL
  SELECT grp, pos + 1, entry, b, best.cost, best.audit FROM (
    SELECT w.grp, w.pos, w.entry, u.b, min(struct_pack(cost := w.cost + u.cost, audit := w.audit || u.audit)) AS best
    FROM walk w JOIN units u ON u.grp = w.grp AND u.pos = w.pos AND u.a = w.state GROUP BY w.grp, w.pos, w.entry, u.b))
SELECT g.grp, w.entry AS a, w.state AS b, w.cost, w.audit FROM walk w JOIN groups g ON g.grp = w.grp AND g.size = w.pos"""
UNITS = "key string, seg long, pos int, a int, b int, cost long, audit string"


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def ordered(turns: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, place, members."""
    rows = turns.select(_key().alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return indexed(rows, "key", "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows with fault: blank, duplicate, truncated or an empty text."""
    rows = rows.withColumn("seg", F.expr(f"place div {SEGMENT}")).withColumn("same", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    first = rows.groupBy("key", "same", "seg").agg(F.min("place").alias("first")).withColumn("first", F.min("first").over(Window.partitionBy("key", "same")))
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.join(first, ["key", "same", "seg"]).withColumn("fault", fault).drop("first", "same", "seg")


def _changes(table: pa.Table) -> list[int]:
    """Where a group (key, seg) begins."""
    if not table.num_rows:
        return []
    differ = [pc.not_equal(c[1:], c[:-1]) for c in (table["key"].combine_chunks(), table["seg"].combine_chunks())]
    return [0, *(pc.indices_nonzero(pc.or_(*differ)).to_numpy() + 1).tolist()]


def _advance(whole_rows: bool):
    """Least (cost, audit) of each group by state before and after; rows: key, seg, pos and kind (whole_rows), or units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        con.execute("CREATE TABLE moves (kind INT, a INT, b INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", [list(m) for m in moves()])

        def solved(table: pa.Table, begin: list[int]) -> Iterator[pa.RecordBatch]:
            ends = np.array([*begin[1:], table.num_rows], np.int64)
            grp = np.repeat(np.arange(len(begin)), ends - begin)
            heads = table.select(["key", "seg"]).take(pa.array(begin))
            groups = pa.table({"grp": np.arange(len(begin)), "size": table["pos"].combine_chunks().to_numpy()[ends - 1] + 1, "first": heads["seg"].combine_chunks().to_numpy() == 0})
            rows = table.append_column("grp", pa.array(grp))
            con.register("groups", groups)
            con.register("batch", rows)
            try:
                con.execute("CREATE OR REPLACE TEMP TABLE units AS " + ("SELECT r.grp, r.pos, m.a, m.b, m.cost, m.audit FROM batch r JOIN moves m ON m.kind = r.kind" if whole_rows else "SELECT grp, pos, a, b, cost, audit FROM batch"))
                out = con.execute(ADVANCE).to_arrow_table()
            finally:
                con.unregister("groups")
                con.unregister("batch")
            named = heads.take(out["grp"].combine_chunks())
            found = pa.table([named["key"].cast(pa.string()), named["seg"], *(out[c].cast(k) for c, k in (("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())))], names=["key", "seg", "a", "b", "cost", "audit"])
            yield from found.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BATCH:
                table = pa.Table.from_batches(held)
                begin = _changes(table)
                if len(begin) > 1:  # the last group may go on
                    yield from solved(table.slice(0, begin[-1]), begin[:-1])
                    table = table.slice(begin[-1])
                held, count = table.combine_chunks().to_batches(), table.num_rows
        if count:
            table = pa.Table.from_batches(held)
            yield from solved(table, _changes(table))

    return K.lean(run)


def audits(rows: DataFrame) -> DataFrame:
    """key, cost, audit of every conversation in rows (with_faults)."""
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(
        F.when(initial == "s", KINDS["s"]).when(initial == "u", KINDS["u"]).when(initial == "a", KINDS["a"]).otherwise(KINDS[""]) + F.when(F.col("fault") == "truncated", 4).otherwise(0)
    )
    units = rows.select("key", F.expr(f"place div {SEGMENT}").alias("seg"), F.expr(f"CAST(place % {SEGMENT} AS INT)").alias("pos"), kind.cast("int").alias("kind"))
    out = "key string, seg long, a int, b int, cost long, audit string"
    found = written(units.repartition("key", "seg").sortWithinPartitions("key", "seg", "pos").mapInArrow(_advance(True), out), "walked")
    longest = rows.agg(F.max("members")).first()[0] or 0
    segments = -(-longest // SEGMENT)
    ready = []
    while segments > 1:  # conversations of one segment wait
        many = found.groupBy("key").agg(F.max("seg").alias("last"))
        marked = written(found.join(many, "key"), "marked")
        ready.append(marked.where("last = 0").drop("last"))
        units = marked.where("last > 0").select("key", F.expr(f"seg div {FAN}").alias("seg"), F.expr(f"CAST(seg % {FAN} AS INT)").alias("pos"), "a", "b", "cost", "audit")
        found = written(units.repartition("key", "seg").sortWithinPartitions("key", "seg", "pos").mapInArrow(_advance(False), out), "walked")
        segments = -(-segments // FAN)
    for other in ready:
        found = found.unionByName(other)
    inserts = F.element_at(F.array(*(F.lit(LAST[s]) for s in (NONE, S, U, A))), F.col("b") + 1)
    least = F.min(F.struct((F.col("cost") + inserts * INSERT).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), inserts)).alias("audit")))
    return found.groupBy("key").agg(least.alias("best")).select("key", "best.cost", "best.audit")


EDITED = "conv_id long, at long, edit string, turn long, role string, text string, fault string, was string, cost long, audit string"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place -1: a conversation's audit) to edited rows, in order. An inserted row has no turn and no former role."""
    audit, at, state, names = "", 0, NONE, [f.split()[0] for f in EDITED.split(", ")]

    def inserts(conv) -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = INSERTED[state]
            yield conv, at, "I", None, "user" if state == U else "assistant", "", None, None, None, None
            at += 1

    def rows(batch) -> Iterator[tuple]:
        nonlocal audit, at, state
        for conv, place, turn, role, text, fault, cost, letters in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "turn", "role", "text", "fault", "cost", "audit")), strict=True):
            if place < 0:
                audit, at, state = letters or "", 0, NONE
                yield conv, None, None, None, None, None, None, None, cost or 0, audit
            else:
                edit, new = audit[at], role
                if edit == "R":
                    new = "assistant" if state == U else "user"
                if edit != "D":
                    state = {"s": S, "u": U, "a": A}[new[:1]]
                yield conv, at, edit, turn, new, text, fault, role, None, None
                at += 1
            yield from inserts(conv)

    for batch in K.pieces(batches, 1 << 20):
        out = list(zip(*rows(batch), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("conv_id", "at", "turn", "cost") else pa.string()) for k, v in zip(names, out, strict=True)], names)


def edited(rows: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """Every row and insert in order, after a row (edit null) with its conversation's cost and audit.

    ids: key, conv_id of all conversations, each once."""
    heads = ids.join(found, "key", "left").select("key", "conv_id", F.lit(-1).cast("long").alias("place"), "cost", "audit")
    all_ = rows.select("key", "conv_id", "place", "turn", "role", "text", "fault").unionByName(heads, allowMissingColumns=True).withColumn("conv_id", F.col("conv_id").cast("long"))
    return all_.repartition("key").sortWithinPartitions("key", "place").mapInArrow(_edit, EDITED)


def _plan(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    rows = written(with_faults(ordered(turns)), "turns")
    return edited(rows, audits(rows), (turns if ids is None else ids).select(_key().alias("key"), "conv_id").distinct())


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, at, edit (K, R, D or I), turn, role, text, fault and was (the role before) of every turn kept, changed, deleted or inserted."""
    return _plan(turns).where("edit is not null").drop("cost", "audit")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now = [f.split()[0] for f in DIGEST.split(", ")], None

    def close() -> tuple:
        gaps = now["turns"][1] - now["turns"][0] + 1 - now["distinct"] if now["turns"] else 0
        return now["conv"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], now["audit"], now["sha"].hexdigest()

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k in ("audit", "repaired_sha256") else pa.int64()) for k, v in zip(names, zip(*done, strict=True), strict=True)], names)

    for batch in batches:
        done = []
        for conv, edit, turn, role, text, fault, was, cost, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "role", "text", "fault", "was", "cost", "audit")), strict=True):
            if edit is None:
                if now:
                    done.append(close())
                now = {"conv": conv, "cost": cost, "audit": audit, "sha": hashlib.sha256(), "any": False, "turns": None, "distinct": 0, "was": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                continue
            if edit != "I":
                if fault:
                    now[fault] += 1
                if now["was"] is not None:
                    now["illegal"] += now["was"][:1] + was[:1] not in ("su", "ua", "au")
                now["was"] = was
                if turn is not None:
                    now["distinct"] += not now["turns"] or turn != now["turns"][1]
                    now["turns"] = (now["turns"][0] if now["turns"] else turn, turn)
            if edit != "D":
                now["sha"].update(("\n" * now["any"] + f"{role}:{text}").encode())
                now["any"] = True
        if done:
            yield batch_of(done)
    if now:
        yield batch_of([close()])


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage: by CRC-32 of conv_id and turn a row is dropped, emptied, stripped of its end marks, repeated or given to the user."""
    rows = turns.select(_key().alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    code = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = rows.withColumn("code", code).where("code <> 0").withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return _plan(damaged(turns), turns).mapInArrow(_digest, DIGEST)


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP11_SQL = f"""
WITH RECURSIVE source AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(turn AS VARCHAR), ' ') AS said FROM conversations),
coded AS (SELECT *, {crc32("(key || ':' || said)")} % 20 AS code FROM source),
left_ AS (
  SELECT key, conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM coded CROSS JOIN (SELECT unnest([0, 1]) AS copy) c WHERE code <> 0 AND (copy = 0 OR code = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) - 1 AS pos FROM left_),
marked AS (SELECT *, right(rtrim(text, {_WHITE}), 1) AS mark, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) AS nth, left(role, 1) AS initial FROM placed),
turns AS (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
classed AS (SELECT key, pos, CASE WHEN fault IN ('blank', 'duplicate') THEN 0 ELSE CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END + CASE WHEN fault = 'truncated' THEN 4 ELSE 0 END END AS kind FROM turns),
moves(kind, a, b, cost, audit) AS (VALUES {", ".join(str(m) for m in moves())}),
sizes AS (SELECT key, count(*) AS n FROM turns GROUP BY key),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM sizes
  UNION ALL
  SELECT key, pos + 1, b, best.cost, best.audit FROM (
    SELECT w.key, w.pos, m.b, min(struct_pack(cost := w.cost + m.cost, audit := w.audit || m.audit)) AS best
    FROM walk w JOIN classed c ON c.key = w.key AND c.pos = w.pos JOIN moves m ON m.kind = c.kind AND m.a = w.state GROUP BY w.key, w.pos, m.b)),
least AS (
  SELECT w.key, min(struct_pack(cost := w.cost + 2 * i.n, audit := w.audit || repeat('I', i.n))) AS best
  FROM walk w JOIN sizes s ON s.key = w.key AND s.n = w.pos JOIN (VALUES {", ".join(f"({s}, {n})" for s, n in LAST.items())}) i(state, n) ON i.state = w.state GROUP BY w.key),
letters AS (SELECT key, spot, substr(best.audit, CAST(spot AS INT), 1) AS letter FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS spot FROM least)),
numbered AS (SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER w - 1 AS pos, sum(CAST(letter <> 'D' AS INT)) OVER w - 1 AS made FROM letters WINDOW w AS (PARTITION BY key ORDER BY spot ROWS UNBOUNDED PRECEDING)),
made AS (
  SELECT n.key, n.spot, n.made, n.letter, CASE WHEN n.letter <> 'I' THEN t.role END AS role, CASE WHEN n.letter <> 'I' THEN t.text ELSE '' END AS text,
    max(CASE WHEN n.made = 0 AND n.letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.key) AS s
  FROM numbered n LEFT JOIN turns t ON t.key = n.key AND t.pos = n.pos WHERE n.letter <> 'D'),
texts AS (SELECT key, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY spot)) AS sha FROM made GROUP BY key),
pairs AS (SELECT key, sum(CASE WHEN before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM (SELECT key, initial, lag(initial) OVER (PARTITION BY key ORDER BY pos) AS before FROM turns) GROUP BY key),
counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM turns GROUP BY key)
SELECT s.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(p.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(l.best.cost, 0) AS BIGINT) AS cost, coalesce(l.best.audit, '') AS audit, coalesce(x.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM source) s LEFT JOIN counts c USING (key) LEFT JOIN pairs p USING (key) LEFT JOIN least l USING (key) LEFT JOIN texts x USING (key)"""
