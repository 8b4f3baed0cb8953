"""Repairs against an exhaustive search over edits and against the damage in plain Python."""

import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidegrid.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, place string, seg string, audit string, code string, key string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Uniform-cost search over (rows used, roles so far); ties by the letters. The roles are kept as their pattern only."""
    kinds = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, last, made = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, letters, made
        for role in ("user", "assistant"):
            if (last, role[0]) in step:
                heapq.heappush(heap, (cost + 2, letters + "I", i, role[0], (*made, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, last, made))
            if kinds[i] in ("", "truncated"):
                late = kinds[i] == "truncated"
                if (last, role[:1]) in step:
                    heapq.heappush(heap, (cost + late, letters + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if (last, to[0]) in step:
                        heapq.heappush(heap, (cost + 2 + late, letters + "R", i + 1, to[0], (*made, f"{to}:{text}")))
    raise AssertionError


def damage(table):
    out = {}
    for conv, turn, role, text in table:
        held = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def expected(table):
    want = set()
    for conv, rows in damage(table).items():
        cost, letters, made = cheapest(rows)
        kinds, turns, first = faults(rows), {r[0] for r in rows if r[0] is not None}, [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want.add((str(conv), gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return want


def found(spark, table, path):
    rows = [(*r, "a", "b", "c", "d", "e") for r in table]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    by_sql = [(str(r[0]), *r[1:]) for r in con.execute(C.OP11_SQL).fetchall()]
    out = [(str(r[0]), *r[1:]) for r in C.op11_conversations(spark, str(path)).collect()]
    assert len(out) == len(set(out)) and sorted(out) == sorted(by_sql)
    return set(out)


def talk(rng, conv, n):
    said = ["Yes.", "No!", "half a", "", " \t", "What?", "x" * 30 + ".", "end. \n", "odd. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "a", "sage"]
    return [(conv, None if rng.random() < 0.05 else int(i + rng.integers(0, 2)), roles[min(rng.integers(0, 12) % (5 if rng.random() < 0.8 else 11), 10)], None if rng.random() < 0.03 else said[rng.integers(0, len(said))]) for i in range(n)]


def test_against_search(spark, tmp_path):
    rng = np.random.default_rng(3)
    table = [r for conv in range(150) for r in talk(rng, conv, int(rng.integers(1, 12)))]
    table += [(None, 0, "user", "hi."), (None, 1, "assistant", "yes."), (None, 1, "assistant", "yes."), (900, None, None, None), (901, None, "user", "a."), (902, 5, "user", "z" * 200_000)]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:3".encode()) % 20 == 0)
    table += [(dropped, 3, "user", "gone."), (0, 0, "user", "again."), (0, 0, "user", "again.")]
    assert found(spark, table, tmp_path) == expected(table)


def test_long_conversations_are_joined_from_segments(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(C, "SEGMENT", 4)
    monkeypatch.setattr(C, "FAN", 3)
    table = [r for conv, n in ((1, 200), (2, 37), (3, 4), (4, 5), (5, 1)) for r in talk(rng, conv, n)]
    assert found(spark, table, tmp_path) == expected(table)


def test_moves_are_least():
    ways = {m[:3] for m in C.moves()}
    assert (C.GONE, C.U, C.U) in ways and all(m[4].count("I") * 2 + (m[4][-1] == "D") * 3 <= m[3] for m in C.moves())


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "More."), (1, 2, "assistant", "More."), (2, 0, "user", "A?"), (2, 1, "assistant", "B.")]
    out = sorted((r.conv_id, r.at, r.edit, r.role, r.text, r.fault, r.was) for r in C.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert [(o[0], o[2], o[3]) for o in out] == [(1, "R", "user"), (1, "K", "assistant"), (1, "D", "assistant"), (2, "K", "user"), (2, "K", "assistant")]
    assert out[2][5] == "duplicate" and out[0][6] == "assistant"


def test_empty_table(spark, tmp_path):
    assert found(spark, [], tmp_path) == set()


@pytest.mark.parametrize("rows", [[], [(0, "s", "a.")], [(0, "assistant", "a.")], [(0, "user", "a"), (1, "system", "b.")]])
def test_search_itself(rows):
    cost, letters, made = cheapest(rows)
    assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made)) and cost >= 0 and len(letters.replace("I", "")) == len(rows)
