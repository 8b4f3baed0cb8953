"""Merkle trees over the rows of a table, one tree a group, and proofs looked up by coordinates.

A leaf is the SHA-256 of a row's fields. The leaves of a group, in order, are node
level 0; every `arity` consecutive nodes of a level (the last run may be shorter) give
one node of the next, until one is left: the group's subroot. The subroots, ordered
by group, are the leaves of one more tree, whose last node is the root.

A node is found by its coordinates (tree, level, index). What a proof of node i needs
follows from i and the group's size alone: at level k the run of i div arity**k, but
for that node itself. Nodes are built and proofs looked up in tiers of `TIER` levels:

1. `nodes`: a block of arity**TIER neighbours is folded into all nodes above it within
   the tier; the tables of nodes are written, a tier each.
2. `_own`: each node at the foot of a tier explodes the coordinates that it needs within
   the tier, joins the node table by them, and puts what it finds in order.
3. `_proofs`: tiers are joined from the top. A node's proof is its own tier's, and the
   proof of the block it lies in. So a node near the root, which half of all leaves
   need, is joined with the few nodes of the tier below and not with each leaf: no key
   of a join has more than arity**TIER rows, even if all rows are of one group.

A proof is an array with an entry a level: the digests left of the node in its run and
those right of it, as hex text. Folding a leaf with it gives the root.

Defined results: a null field is `-` (an empty text is `0:`); rows that repeat a doc_id
are leaves of their own, ordered by digest; a null doc_id comes first and is never
tampered with; a null group is a group of its own, before all others; an empty table
gives no rows; columns that are not named play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._duck import crc32
from ._order import indexed
from ._session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, TIER = 2, 6


def sized(value: Column) -> Column:
    """A field of a leaf: its bytes, a colon and its value; `-` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*values), 256))


def levels(arity: int, members: str = "members") -> Column:
    """Levels above the leaves: the least k with arity**k >= members."""
    powers = [arity**k for k in range(63) if arity**k < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < F.col(members)))


def _text(at: str) -> str:
    return f"lower(hex({at}))"


def _tier(feet: DataFrame, low: int, arity: int) -> DataFrame:
    """All nodes of the levels low + 1 to low + TIER, from the nodes at level low."""
    block, size = arity**TIER, f"least({TIER}, height - {low})"
    step = f"transform(sequence(0, (size(s.now) - 1) div {arity}), i -> sha2(array_join(slice(s.now, CAST(i AS INT) * {arity} + 1, {arity}), ''), 256))"
    folded = f"""aggregate(sequence(1, {size}), named_struct('now', now, 'all', CAST(array() AS ARRAY<STRUCT<level: INT, at: INT, digest: BINARY>>)),
      (s, k) -> transform(array({step}), n -> named_struct('now', n, 'all', concat(s.all, transform(n, (d, i) -> named_struct('level', k, 'at', i, 'digest', unhex(d))))))[0], s -> s.all)"""
    blocks = feet.where(f"height > {low}").groupBy("tree", "members", "height", F.expr(f"place div {block}").alias("block"))
    rows = blocks.agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run")).withColumn("now", F.expr(f"transform(run, x -> {_text('x.digest')})"))
    powers = ", ".join(f"{arity**(TIER - k)}L" for k in range(1, TIER + 1))
    return rows.select("tree", "members", "height", "block", F.explode(F.expr(folded)).alias("x")).select(
        "tree", "members", "height", (F.col("x.level") + low).alias("level"), F.expr(f"block * element_at(array({powers}), x.level) + x.at").alias("place"), "x.digest"
    )


def nodes(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """Tables of nodes (tree, members, height, level, place, digest): the leaves, then a written one for each tier.

    leaves: tree, members, place, digest. members: leaves of the tree."""
    height = leaves.withColumn("height", levels(arity))
    tiers = [height.select("tree", "members", "height", F.lit(0).alias("level"), "place", "digest")]
    top = height.agg(F.max("height")).first()[0] or 0
    for low in range(0, top, TIER):
        feet = tiers[-1].where(F.col("level") == low)
        tiers.append(written(_tier(feet, low, arity), f"nodes-{low}"))
    return tiers


def _own(tiers: list[DataFrame], t: int, arity: int) -> DataFrame:
    """tree, place, height, proof: the part of a proof within tier t, of every node at its foot."""
    low = t * TIER
    feet = tiers[t].where((F.col("level") == low) & ((F.col("height") > low) | F.lit(low == 0))).select("tree", "place", "members", "height")
    powers = ", ".join(f"{arity**k}L" for k in range(TIER))
    here = f"(place div element_at(array({powers}), k + 1))"
    count = f"((members - 1) div ({arity**low}L * element_at(array({powers}), k + 1)) + 1)"
    run = f"filter(sequence({here} div {arity} * {arity}, {here} div {arity} * {arity} + {arity - 1}), i -> i <> {here} AND i < {count})"
    inner = f"filter(sequence(0, {TIER - 1}), k -> k < height - {low})"
    need = f"flatten(transform({inner}, k -> transform({run}, i -> named_struct('level', k + {low}, 'sibling', i))))"
    asked = feet.select("tree", "place", "members", "height", F.explode_outer(F.expr(need)).alias("x")).select("tree", "place", "members", "height", "x.level", "x.sibling")
    known = tiers[t].where(F.col("level") == low)
    if t + 1 < len(tiers):
        known = known.unionByName(tiers[t + 1].where(F.col("level") < low + TIER))
    found = asked.join(known.select("tree", "level", F.col("place").alias("sibling"), "digest"), ["tree", "level", "sibling"], "left")
    rows = found.groupBy("tree", "place", "height").agg(F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "sibling", "digest")))).alias("all"))
    side = lambda sign: f"array_join(transform(filter(all, x -> x.level = k + {low} AND x.sibling {sign} {here}), x -> {_text('x.digest')}), '')"
    return rows.select("tree", "place", "height", F.expr(f"transform({inner}, k -> named_struct('left', {side('<')}, 'right', {side('>')}))").alias("proof"))


def _proofs(tiers: list[DataFrame], arity: int, ends: DataFrame) -> DataFrame:
    """tree, place, proof and the columns of ends, for every leaf; ends: for each tree, what follows its last node (proof and others)."""
    more = [c for c in ends.columns if c not in ("tree", "height", "proof")]
    above = None
    for t in range(max(1, len(tiers) - 1) - 1, -1, -1):
        low = t * TIER
        own = _own(tiers, t, arity).withColumnRenamed("proof", "own").withColumn("block", F.expr(f"place div {arity**TIER}"))
        stop = ends.where((F.col("height") <= low + TIER) & ((F.col("height") > low) | F.lit(low == 0))).select("tree", F.lit(0).cast("long").alias("block"), "proof", *more)
        upper = stop if above is None else stop.unionByName(above.withColumnRenamed("place", "block"))
        above = own.join(upper, ["tree", "block"]).select("tree", "place", F.concat("own", "proof").alias("proof"), *more)
    return above


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """tree, height, digest of each tree's last node."""
    ends = [t.where(F.col("level") == F.col("height")).select("tree", "height", "digest") for t in tiers]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out.distinct()  # a tier's last level is the next one's foot


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """leaves (tree: string, not null; place, members, digest and others) with subroot, root (binary) and proof."""
    others = [c for c in leaves.columns if c not in ("tree", "place", "members", "digest")]
    tiers = nodes(leaves, arity)
    ends = written(_tops(tiers), "subroots")
    forest = indexed(ends.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest")), "tree", "name")
    above = nodes(forest, arity)
    root = _tops(above).select(F.col("tree"), "height", F.col("digest").alias("root"), F.array().cast("array<struct<left: string, right: string>>").alias("proof"))
    upper = _proofs(above, arity, root).join(forest.select("tree", "place", "name", F.col("digest").alias("subroot")), ["tree", "place"])
    upper = upper.select(F.col("name").alias("tree"), "subroot", "root", "proof").join(ends.select("tree", "height"), "tree")
    found = _proofs(tiers, arity, upper)
    return leaves.select("tree", "place", "members", "digest", *others).join(found, ["tree", "place"])


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex text) that a leaf (binary) and a proof give."""
    return F.aggregate(proof, F.lower(F.hex(leaf)), lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]).cast("binary"), 256))


def proof_hash(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = [sized(F.col(c)) for c in FIELDS]
    tampered = [sized(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else sized(F.col(c)) for c in FIELDS]
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), digest(plain).alias("digest"), F.when(chosen, digest(tampered)).alias("tampered")
    )
    leaves = written(indexed(written(rows, "leaves"), "tree", "doc_id", "digest"), "placed")
    out = manifest(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("proof")))
    text = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == text("root")).alias("verified"),
    )


def _sized_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


_LEAF_SQL = "sha256(" + " || ".join("{}" for _ in FIELDS) + ")"
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF_SQL.format(*(_sized_sql(c) for c in FIELDS))} AS leaf,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF_SQL.format(*(_sized_sql("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS))} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
node AS (
  SELECT coalesce('=' || lang, '') AS tree, 0 AS level, place, leaf AS d, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(d, '' ORDER BY place)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY tree, level, place // 2, n),
tops AS (SELECT tree, d AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1),
above AS (
  SELECT 0 AS level, place, subroot AS d, n FROM tops
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(d, '' ORDER BY place)), (n + 1) // 2 FROM above WHERE n > 1 GROUP BY level, place // 2, n),
root AS (SELECT d AS root, level AS height FROM above WHERE n = 1),
low AS (
  SELECT p.tree, p.place, list({{'l': CASE WHEN s.place < p.place >> k.k THEN s.d ELSE '' END, 'r': CASE WHEN s.place > p.place >> k.k THEN s.d ELSE '' END}} ORDER BY k.k) AS proof
  FROM (SELECT tree, place FROM node WHERE level = 0) p JOIN tops t ON t.tree = p.tree JOIN (SELECT unnest(range(62)) AS k) k ON k.k < t.height
  LEFT JOIN node s ON s.tree = p.tree AND s.level = k.k AND s.place = xor(p.place >> k.k, 1) GROUP BY p.tree, p.place),
high AS (
  SELECT t.tree, list({{'l': CASE WHEN s.place < t.place >> k.k THEN s.d ELSE '' END, 'r': CASE WHEN s.place > t.place >> k.k THEN s.d ELSE '' END}} ORDER BY k.k) AS proof
  FROM tops t CROSS JOIN root r JOIN (SELECT unnest(range(62)) AS k) k ON k.k < r.height
  LEFT JOIN above s ON s.level = k.k AND s.place = xor(t.place >> k.k, 1) GROUP BY t.tree),
whole AS (
  SELECT p.doc_id, p.leaf, coalesce(p.tampered, p.leaf) AS shown, t.subroot, r.root, list_concat(coalesce(low.proof, []), coalesce(high.proof, [])) AS proof
  FROM placed p JOIN tops t ON t.tree = coalesce('=' || p.lang, '') CROSS JOIN root r LEFT JOIN low ON low.tree = t.tree AND low.place = p.place LEFT JOIN high ON high.tree = t.tree),
folded AS (SELECT *, list_reduce(list_prepend({{'l': '', 'r': shown}}, proof), lambda a, p: {{'l': '', 'r': sha256(p.l || a.r || p.r)}}).r AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda p: p.l || p.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
