"""Manifests against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import merkle
from tidegrid.llm._order import indexed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, tree string, digest string, level string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, add=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + add, row[1]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(digests, arity=2):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def sides(levels, i, arity=2):
    out = []
    for level in levels[:-1]:
        a = i // arity * arity
        run = level[a : a + arity]
        out.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= arity
    return out


def fold(digest, proof):
    for left, right in proof:
        digest = sha(left + digest + right)
    return digest


def table():
    rows = [(i, f"text {i} é" * (i % 3), "en" if i % 4 else "de", "s", i) for i in range(150)]
    rows += [(7, "other", "en", None, 3), (7, "other", "en", None, 3), (None, "no id", "en", "s", 5), (301, None, None, None, None), (302, "x" * 100_000, "", "s", None), (303, "", "only", "s", 0), (14, "t", "fr", "s", 1), (21, "u", "fr", "s", None), (49, "v", "fr", "s", 9)]
    return [(*r, "clash", "clash", "clash", "clash") for r in rows]


def test_manifest_against_brute_force(spark, tmp_path):
    spark.createDataFrame(table(), SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    groups = {}
    for r in table():
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = held, grow([leaf(r) for r in held])
    top = grow([trees[g][1][-1][0] for g in names])
    want = []
    for k, g in enumerate(names):
        held, levels = trees[g]
        for i, r in enumerate(held):
            proof = sides(levels, i) + sides(top, k)
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = fold(leaf(r, int(odd)), proof)
            want.append((str(r[0]), levels[0][i], levels[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), got, got == top[-1][0]))
    found = [(str(r[0]), *r[1:]) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want) and 0 < sum(not r[-1] for r in found) < len(found)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_proofs_of_any_arity(spark, arity):
    sizes = {"a": 1, "b": arity, "c": arity**3 + 1, "d": 700}
    rows = [(g, i, sha(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    leaves = indexed(spark.createDataFrame(rows, "tree string, i long, name string").withColumn("digest", F.unhex("name")), "tree", "i")
    levels = {g: grow([sha(f"{g}{i}") for i in range(n)], arity) for g, n in sizes.items()}
    top = grow([levels[g][-1][0] for g in sorted(sizes)], arity)
    for r in merkle.manifest(leaves, arity).withColumn("folded", merkle.fold(F.col("digest"), F.col("proof"))).collect():
        assert r.folded == top[-1][0] == r.root.hex() and r.subroot.hex() == levels[r.tree][-1][0]
        assert [tuple(p) for p in r.proof] == sides(levels[r.tree], r.i, arity) + sides(top, sorted(sizes).index(r.tree), arity)


def test_empty_table_and_single_row(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, f"{tmp_path}/a").count() == 0
    one = (5, "t", None, None, 1, "", "", "", "")
    spark.createDataFrame([one], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    row = merkle.op13_merkle_manifest(spark, f"{tmp_path}/b").first()
    assert row.leaf == row.subroot == row.root == leaf(one) and row.proof_sha256 == sha("") and row.verified


def test_places_of_a_large_group_and_ties(spark):
    rows = [("a", i % 50) for i in range(3000)] + [("b", 1)]
    out = indexed(spark.createDataFrame(rows, "g string, v long").repartition(7), "g", "v").collect()
    placed = sorted((r.place, r.v) for r in out if r.g == "a")
    assert [p for p, _ in placed] == list(range(3000)) and [v for _, v in placed] == sorted(i % 50 for i in range(3000))
    assert {r.members for r in out if r.g == "a"} == {3000} and [(r.place, r.members) for r in out if r.g == "b"] == [(0, 1)]
