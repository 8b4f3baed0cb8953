"""URL filter: rules first, a path-template tree for the rest. DataFrame functions only.

Rules (host suffix, path prefix) decide the urls they fit; the longest wins. The
urls they decide are the labelled examples of the method. Per host, the path's
segments form a tree. Segments that look generated (numbers, hexadecimal or mixed
codes) become wildcards at once; level by level, a node whose children are many and
rare gets one wildcard child in their place. Every such template counts its blocked
and allowed examples. Sibling templates (same host, same parent) whose blocked share
does not differ statistically from their siblings' common share (a two-proportion z
test), those without examples included, are merged. A template is blocked if its
smoothed purity (blocked + a * host's share) / (examples + a) reaches `threshold`;
the host's share is smoothed the same way towards the share of all hosts.

The tree is built over distinct (host, shape) pairs, not over pages, from the root down
to the last level at which a node can have more than `many` children: no host has so
many shapes that are longer. All counts are sums, so a hot host is combined before its
shuffle.

Defined results: null urls and urls without :// have empty host and path, no rule
and the verdict of the share of all hosts; an empty table gives no rows; repeated
rows count each; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import written

#: (host suffix, path prefix, verdict), in the order of the contract
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANY, RARE, Z, SMOOTH, THRESHOLD = 20, 3.0, 1.96, 2.0, 0.5
#: Levels of the tree in one plan
LEVELS, END = 4, 2_147_483_647


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host/path) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, suffix + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    """Segments with generated ones made wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: (
        F.when(F.regexp_like(s, F.lit(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$")), F.lit("{n}"))
        .when(F.regexp_like(s, F.lit(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}(\.[A-Za-z0-9]{1,5})?$")), F.lit("{x}"))
        .when(F.regexp_like(s, F.lit(r"[0-9].*[0-9].*[0-9]")), F.lit("{c}"))
        .otherwise(s)
    )
    return F.transform(parts, kind)


def _purity(blocked: Column, seen: Column, prior: Column) -> Column:
    return (blocked + F.lit(SMOOTH) * prior) / (seen + F.lit(SMOOTH))


def _deepest(shapes: DataFrame, many: int) -> int:
    """Levels at which a node may have more than `many` children: some host has so many shapes that reach below."""
    sizes = shapes.groupBy("host", F.size("shape").alias("size")).agg(F.count("*").alias("n"))
    longer = sizes.withColumn("longer", F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size"))))  # a row a length
    return longer.where(F.col("longer") > many).agg(F.max("size")).first()[0] or 0


def templates(shapes: DataFrame, *, many: int = MANY, rare: float = RARE) -> DataFrame:
    """shapes (host, shape, pages, blocked, seen) with a column template: the shape after generalising."""
    out = shapes.withColumn("template", F.col("shape"))
    for level in range(_deepest(shapes, many)):
        if level and level % LEVELS == 0:
            out = written(out, "templates")
        head = F.concat_ws("/", F.slice("template", 1, level))
        child = F.get("template", F.lit(level))
        here = out.withColumn("_head", head).withColumn("_child", child)
        per_child = here.where("_child is not null").groupBy("host", "_head", "_child").agg(F.sum("pages").alias("pages"))
        wide = per_child.groupBy("host", "_head").agg(F.count("*").alias("children"), F.sum("pages").alias("pages"))
        wide = wide.where((F.col("children") > many) & (F.col("pages") < F.col("children") * rare)).select("host", "_head", F.lit(True).alias("_wide"))
        here = here.join(wide, ["host", "_head"], "left")
        starred = F.concat(F.slice("template", 1, level), F.array(F.lit("*")), F.slice("template", level + 2, END))
        out = here.withColumn("template", F.when(F.col("_wide") & F.col("_child").isNotNull(), starred).otherwise(F.col("template"))).drop("_head", "_child", "_wide")
    return out


def verdicts(shapes: DataFrame, **options) -> DataFrame:
    """host, shape, judged ('allow' or 'block'), purity of every distinct shape."""
    tree = templates(shapes, **options).withColumn("name", F.concat_ws("/", "template"))
    tree = written(tree.withColumn("parent", F.concat_ws("/", F.expr("slice(template, 1, greatest(size(template) - 1, 0))"))), "tree")
    node = tree.groupBy("host", "parent", "name").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))
    node = written(node, "node")
    family = node.groupBy("host", "parent").agg(F.sum("blocked").alias("f_blocked"), F.sum("seen").alias("f_seen"))
    host = family.groupBy("host").agg(F.sum("f_blocked").alias("h_blocked"), F.sum("f_seen").alias("h_seen"))
    every = host.agg(F.coalesce(F.sum("h_blocked"), F.lit(0)).alias("a_blocked"), F.coalesce(F.sum("h_seen"), F.lit(0)).alias("a_seen"))  # one row
    node = node.join(family, ["host", "parent"])
    others_b, others_n = F.col("f_blocked") - F.col("blocked"), F.col("f_seen") - F.col("seen")
    share = F.col("f_blocked") / F.greatest(F.col("f_seen"), F.lit(1))
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("seen"), F.lit(1)) + 1 / F.greatest(others_n, F.lit(1))))
    gap = F.abs(F.col("blocked") / F.greatest(F.col("seen"), F.lit(1)) - others_b / F.greatest(others_n, F.lit(1)))
    differs = (F.col("seen") > 0) & (others_n > 0) & (gap > F.lit(Z) * spread)
    node = node.withColumn("alone", differs)
    merged = node.where(~F.col("alone")).groupBy("host", "parent").agg(F.sum("blocked").alias("m_blocked"), F.sum("seen").alias("m_seen"))
    node = node.join(merged, ["host", "parent"], "left").join(host, "host").join(F.broadcast(every))
    blocked = F.when(F.col("alone"), F.col("blocked")).otherwise(F.col("m_blocked"))
    seen = F.when(F.col("alone"), F.col("seen")).otherwise(F.col("m_seen"))
    overall = (F.col("a_blocked") + 0.5) / (F.col("a_seen") + 1)
    node = node.withColumn("purity", _purity(blocked, seen, _purity(F.col("h_blocked"), F.col("h_seen"), overall)))
    judged = F.when(F.col("purity") >= THRESHOLD, "block").otherwise("allow")
    return tree.select("host", "shape", "name").join(node.select("host", "name", "purity", judged.alias("judged")), ["host", "name"]).select("host", "shape", "judged", "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, many: int = MANY, rare: float = RARE) -> DataFrame:
    """page_id, host, path, rule, verdict, purity (of the url's template; null where a rule decides) of every page."""
    host, path = split_url(F.coalesce(F.col("url").cast("string"), F.lit("")))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shape", _shape(F.col("path")))
    shapes = base.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"), F.count("ruled").alias("seen"))
    known = verdicts(written(shapes, "shapes"), many=many, rare=rare)
    out = base.where("rule is null").join(known, ["host", "shape"]).select("page_id", "host", "path", "rule", F.col("judged").alias("verdict"), "purity")
    return base.where("rule is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("purity")).unionByName(out)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _op7_sql() -> str:
    ruled = "\n".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    what = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    pick = "CASE WHEN regexp_full_match(s, '[0-9]+(\\.[A-Za-z0-9]{1,5})?') THEN '{n}' WHEN regexp_matches(s, '[0-9]') AND (regexp_full_match(s, '[0-9A-Fa-f-]{8,}(\\.[A-Za-z0-9]{1,5})?')) THEN '{x}' WHEN regexp_matches(s, '[0-9].*[0-9].*[0-9]') THEN '{c}' ELSE s END"
    one = f"list_transform(parts, lambda s: {pick})"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b0 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b1 AS (SELECT *, CASE {ruled} END AS rule, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM b0),
b AS (SELECT *, CASE rule {what} END AS ruled, {one} AS shape FROM b1),
shp AS (SELECT host, shape, count(*) AS pages, count(*) FILTER (WHERE ruled = 'block') AS blocked, count(ruled) AS seen FROM b GROUP BY host, shape),
t AS (
  SELECT 0 AS k, host, shape, pages, blocked, seen, shape AS tpl, (SELECT max(len(shape)) FROM shp) AS deepest FROM shp
  UNION ALL
  SELECT k + 1, host, shape, pages, blocked, seen, CASE WHEN len(tpl) > k AND children > {MANY} AND p < children * {RARE} THEN tpl[1:k] || ['*'] || tpl[k + 2:] ELSE tpl END, deepest
  FROM (SELECT *, count(DISTINCT CASE WHEN len(tpl) > k THEN tpl[k + 1] END) OVER w AS children, sum(CASE WHEN len(tpl) > k THEN pages ELSE 0 END) OVER w AS p
    FROM t WHERE k < deepest WINDOW w AS (PARTITION BY host, array_to_string(tpl[1:k], '/')))),
tree AS (SELECT host, shape, blocked, seen, array_to_string(tpl, '/') AS name, array_to_string(tpl[1:greatest(len(tpl) - 1, 0)], '/') AS parent FROM t WHERE k = deepest),
node AS (SELECT host, parent, name, sum(blocked) AS blocked, sum(seen) AS seen FROM tree GROUP BY ALL),
fam AS (SELECT *, sum(blocked) OVER (PARTITION BY host, parent) AS fb, sum(seen) OVER (PARTITION BY host, parent) AS fs, sum(blocked) OVER (PARTITION BY host) AS hb, sum(seen) OVER (PARTITION BY host) AS hs, sum(blocked) OVER () AS ab, sum(seen) OVER () AS an FROM node),
alone AS (SELECT *, seen > 0 AND fs - seen > 0 AND abs(blocked / greatest(seen, 1) - (fb - blocked) / greatest(fs - seen, 1)) > {Z} * sqrt(fb / greatest(fs, 1) * (1 - fb / greatest(fs, 1)) * (1 / greatest(seen, 1) + 1 / greatest(fs - seen, 1))) AS alone FROM fam),
pool AS (SELECT *, CASE WHEN alone THEN blocked ELSE sum(CASE WHEN NOT alone THEN blocked END) OVER (PARTITION BY host, parent) END AS mb, CASE WHEN alone THEN seen ELSE sum(CASE WHEN NOT alone THEN seen END) OVER (PARTITION BY host, parent) END AS ms FROM alone),
judged AS (SELECT host, name, CASE WHEN (mb + {SMOOTH} * ((hb + {SMOOTH} * ((ab + 0.5) / (an + 1))) / (hs + {SMOOTH}))) / (ms + {SMOOTH}) >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS judged FROM pool),
known AS (SELECT DISTINCT t.host, t.shape, j.judged FROM tree t JOIN judged j ON t.host = j.host AND t.name = j.name)
SELECT page_id, b.host, path, rule, coalesce(ruled, judged) AS verdict FROM b LEFT JOIN known k ON b.host = k.host AND b.shape = k.shape
"""


OP7_SQL = _op7_sql()
