"""The pipeline's stages, one on what the other kept, on awkward tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidegrid.llm import quality, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, taken string"
SPACE = r"[^\x20\x09-\x0D]+"


def said(seed, n=120, kind="good"):
    return " ".join(f"{kind}{w}" for w in np.random.default_rng(seed).integers(0, 400, n))


ITEM = "The quick brown benchmark item has more than ten words in it, certainly so"


def rows():
    a, b, long = said(1), said(2), said(3, 30_000)
    texts = [a, a, a + " tail", b, said(4), said(5), None, "", " \t", "one", long, said(6) + " " + ITEM + " " + said(7), ITEM, said(8, kind="BAD!!"), said(9, kind="BAD!!"), *(said(100 + i) for i in range(60)), *(said(200 + i, kind="BAD!!") for i in range(60))]
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    out += [(4, said(10), "en", "s1", 3), (4, said(10), "en", "s1", 3), (None, said(11), None, "s2", None), (None, None, None, None, None), (5, said(5), "en", "s2", None)]
    return [(*r, "clash", "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("BAD" not in (t or "")), 0) for i, (_, t, *_) in enumerate(rows()) if t and 15 <= i < 135]
    spark.createDataFrame([*labels, (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x y"), (1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_every_stage_on_what_is_left(spark, folder):
    docs, whole = spark.read.parquet(f"{folder}/documents.parquet"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(r) for r in out.collect()]
        if name != "token-ID / binary output":
            assert out.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ") and all(r[5:] == ("clash",) * 3 for r in after)
            docs = spark.createDataFrame(after, SCHEMA).repartition(3)
        seen.append((name, before, after))
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    # 1: rejected documents go, whole ones stay as they are
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert Counter(b) == Counter(r for r in a if model.score(r[1] or "") >= quality.THRESHOLD)
    assert sum("BAD" in (r[1] or "") for r in b) == 0 and sum("good" in (r[1] or "") for r in b) >= 60
    # 2: of each class of near copies the rows of the least doc_id, all rows without words or doc_id
    sets = [shingles(r[1]) for r in b]
    root = list(range(len(b)))
    for _ in b:
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    classes = defaultdict(list)
    for i, r in enumerate(b):
        if sets[i]:
            classes[root[i]].append(r)
    stay = [r for r, s in zip(b, sets, strict=True) if not s]
    for members in classes.values():
        least = min((r[0] for r in members if r[0] is not None), default=None)
        stay += [r for r in members if r[0] is None or r[0] == least]
    assert Counter(c) == Counter(stay) and len(c) < len(b)
    # 3: windows of the item go, other documents stay
    item = words(ITEM)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}

    def hit(r):
        w = words(r[1])
        return any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    assert sum(map(hit, c)) in (1, 2) and not any(map(hit, d)) and Counter(r for r in c if not hit(r)) <= Counter(d)
    every = Counter(w for x in c for w in words(x[1]))
    assert all(Counter(words(r[1])) <= every for r in d)
    # 4: whole documents and beginnings of them, at most twice their words, near one and a half of all words
    size = lambda rs: sum(len(re.findall(SPACE, r[1] or "")) for r in rs)
    stock = Counter(d)
    assert all(r in stock or any(x[:1] + x[2:] == r[:1] + r[2:] and (x[1] or "").startswith(r[1] or "") for x in d) for r in e)
    assert all(size([r for r in e if r[0] == i]) <= 2 * size([r for r in d if r[0] == i]) for i in {r[0] for r in d})
    assert abs(size(e) - 1.5 * size(d)) <= max(len(re.findall(SPACE, r[1] or "")) for r in d) + 200
    # 5: the ids of every row, one after the other
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    want = Counter()
    for r in e:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = [r.asDict() for r in stage(spark, spark.createDataFrame(e, SCHEMA), folder).collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want and len(f) == len(e)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_run_and_its_rows_do_not_depend_on_partitions(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows()[::-1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32)
    one, two = (sorted(map(key, corpus_pipeline.run(spark, p).collect())) for p in (folder, str(tmp_path)))
    assert one == two and len(one) > 60


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
