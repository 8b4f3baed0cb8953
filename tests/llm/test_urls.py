"""The path-template tree against a plain Python one; no depth is cut off."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidegrid.llm import urls

RULES = (("a.net", "/ok", "allow"), ("a.net", "/no", "block"), ("net", "/x/y/z/w/good/1", "allow"), ("net", "/x/y/z/w/bad/1", "block"), ("net", "/x/good/1", "allow"), ("net", "/x/bad/1", "block"))


def kind(s):
    if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})?", s):
        return "{n}"
    if re.search("[0-9]", s) and re.fullmatch(r"[0-9A-Fa-f-]{8,}(\.[A-Za-z0-9]{1,5})?", s):
        return "{x}"
    return "{c}" if len(re.findall("[0-9]", s)) >= 3 else s


def plain(pages, rules, many=urls.MANY):
    seen, shape, label = defaultdict(lambda: [0, 0, 0]), {}, {}
    for i, url in pages.items():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        shape[i] = host, tuple(kind(s) for s in path.split("/") if s)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        label[i] = max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None
        count = seen[shape[i]]
        count[0] += 1
        count[1] += label[i] == "block"
        count[2] += label[i] is not None
    template = {k: k[1] for k in seen}
    for level in range(max((len(t) for t in template.values()), default=0)):
        children, pages_ = defaultdict(set), Counter()
        for (host, s), t in template.items():
            if len(t) > level:
                children[host, t[:level]].add(t[level])
                pages_[host, t[:level]] += seen[host, s][0]
        for (host, s), t in list(template.items()):
            node = host, t[:level]
            if len(t) > level and len(children[node]) > many and pages_[node] < len(children[node]) * urls.RARE:
                template[host, s] = (*t[:level], "*", *t[level + 1 :])
    node, family, hosts, every = Counter(), Counter(), Counter(), Counter()
    parents = defaultdict(set)
    for (host, s), t in template.items():
        parent = host, t[:-1]
        parents[parent].add(t)
        for where, key in ((node, (host, t)), (family, parent), (hosts, host), (every, 0)):
            where[key, "b"] += seen[host, s][1]
            where[key, "n"] += seen[host, s][2]
    smooth = lambda b, n, prior: (b + urls.SMOOTH * prior) / (n + urls.SMOOTH)
    overall = (every[0, "b"] + 0.5) / (every[0, "n"] + 1)
    verdict = {}
    for parent, names in parents.items():
        fb, fn, host = family[parent, "b"], family[parent, "n"], parent[0]
        alone = set()
        for t in names:
            b, n = node[(host, t), "b"], node[(host, t), "n"]
            share = fb / max(fn, 1)
            spread = math.sqrt(share * (1 - share) * (1 / max(n, 1) + 1 / max(fn - n, 1)))
            if n > 0 and fn - n > 0 and abs(b / max(n, 1) - (fb - b) / max(fn - n, 1)) > urls.Z * spread:
                alone.add(t)
        mb, mn = (sum(node[(host, t), c] for t in names - alone) for c in "bn")
        for t in names:
            b, n = (node[(host, t), "b"], node[(host, t), "n"]) if t in alone else (mb, mn)
            verdict[host, t] = "block" if smooth(b, n, smooth(hosts[host, "b"], hosts[host, "n"], overall)) >= urls.THRESHOLD else "allow"
    return {i: label[i] or verdict[shape[i][0], template[shape[i]]] for i in pages}


def random_pages(seed, n=900):
    rng = np.random.default_rng(seed)
    words = ["ok", "no", "fr", "de", "es", "en", "1", "a", "list", "7f3a9b2c11", "x9y8z7", *(f"t{i}" for i in range(60))]
    hosts = ["a.net", "B.A.net", "c.org", "example.org", "d.com", "e.com", "f.info"]
    out = {i: f"http://{hosts[rng.integers(0, 7)]}/" + "/".join(words[min(rng.integers(0, 71), rng.integers(0, 71))] for _ in range(rng.integers(0, 9))) for i in range(n)}
    return out | {n: None, n + 1: "none", n + 2: "http://z.net" + "/q" * 300 + "?x"}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_tree(spark, seed, tmp_path):
    pages = random_pages(seed)
    rows = spark.createDataFrame(list(pages.items()), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(rows).collect()}
    assert got == plain(pages, urls.RULES) and len(set(got.values())) == 2
    con = duckdb.connect()
    rows.toPandas().to_parquet(tmp_path / "pages.parquet", index=False)
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert dict(con.execute(urls.OP7_SQL.replace("SELECT page_id, b.host, path, rule, coalesce(ruled, judged) AS verdict", "SELECT page_id, coalesce(ruled, judged) AS verdict")).fetchall()) == got


@pytest.mark.parametrize("prefix", ["/x", "/x/y/z/w"])
def test_a_telling_segment_counts_at_any_depth(spark, prefix):
    pages = {}
    for side in ("good", "bad"):
        for k in range(20):
            pages[len(pages)] = f"http://h.net{prefix}/{side}/{k if k < 4 else 100 + k}"
    for side in ("good", "bad"):
        for k in range(4):
            pages[len(pages)] = f"http://h.net{prefix}/{side}/{900 + k}"
    rows = spark.createDataFrame(list(pages.items()), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(rows, RULES).collect()}
    assert got == plain(pages, RULES) and [got[i] for i in range(40, 48)] == ["allow"] * 4 + ["block"] * 4


def test_wide_nodes_far_down(spark):
    """Thirty rare children at the ninth level are one wildcard."""
    deep = "/s" * 8
    pages = {k: f"http://a.net/ok{deep}/{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'pqrst'[k // 26]}" for k in range(60)}
    rows = spark.createDataFrame([(k, u, "clash") for k, u in pages.items()], "page_id long, url string, host string")
    shapes = rows.selectExpr("'a.net' AS host", f"split(substr(url, {len('http://a.net/') + 1}), '/') AS shape", "1L AS pages", "0L AS blocked", "1L AS seen")
    assert {tuple(r.template) for r in urls.templates(shapes).collect()} == {("ok", *["s"] * 8, "*")}
    assert set(r.verdict for r in urls.judge(rows, RULES).collect()) == {"allow"}
