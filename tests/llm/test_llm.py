"""The operators against brute force on small and awkward tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidegrid.llm import _kernel as K
from tidegrid.llm import de_bruijn, decontaminate, fingerprint, jaccard, lm, mixing, quality, suffix_dedup, token_files, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, node string"
SPACE = r"[^\x20\x09-\x0D]+"


def base(n=140, seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "érable", "x" * 40, *(f"w{i}" for i in range(60))]
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


def awkward():
    a, b, c = base(), base(seed=2), base(400, 3)
    near = a.replace("w7", "W7", 1) + " tail"
    texts = [a, a, near, b, b[:300] + "\n" + c[:900], c, "", None, "  \t\n", "one", "one two", "one two three", c + " " + a, "日本 text 'll <|endoftext|> end", a.upper(), b + " " + b, "\x00 \x0b nul"]
    return [(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None, "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return {r[0]: r[1] or "" for r in awkward()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, n, num):
    sets = {}
    for k, t in texts().items():
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, n=n, num=num).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in sets}


def thue_morse(n, letters="ab"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits[:n])


@pytest.mark.parametrize("n", [1024, 4096])
def test_texts_that_differ_by_structure_only(spark, n):
    """Words and texts on which polynomials modulo a power of two collide."""
    from tokenizers import Tokenizer

    a, b = thue_morse(n), thue_morse(n, "ba")
    rows = [(0, a), (1, b), (2, " ".join(a)), (3, " ".join(b)), (4, f"{a} x y"), (5, f"{b} x y")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprint.fingerprints(table).collect()}) == len(rows)
    assert {r.doc_id: r.component_id for r in jaccard.classes(table.where("doc_id not in (2, 3)"), n=3, num=90).collect()} == {i: i for i in (0, 1, 4, 5)}
    gone = removed({k: t.split() for k, t in rows})
    assert {r.doc_id: r.n_removed for r in de_bruijn.dedup(table).collect()} == {k: int(g.sum()) for k, g in gone.items()}
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    want = {k: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in rows}
    assert {r.doc_id: r.ids_crc32 for r in token_files.tokens(table).collect()} == want


def test_jaccard_of_repeated_and_null_ids(spark):
    """Rows that repeat a doc_id with other texts link by their own texts; rows without one link others too."""
    a, b, c = base(120, 1), base(120, 2), base(120, 4)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, a + " y"), (5, b + " y"), (None, c), (6, c + " z"), (None, "alone"), (2, a + " z")]
    table = spark.createDataFrame([(*r, "k", "g") for r in rows], "doc_id long, text string, key string, gone string")
    got = [(r.doc_id or 0, r.component_id) for r in jaccard.classes(table, n=3, num=90).collect()]
    assert len(got) == len(rows) and set(got) == {(0, 6), (0, None), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)}
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard.one_of_each(table, n=3, num=90).collect())
    assert kept == sorted([(0, c), (0, "alone"), (1, a), (1, b), (6, c + " z")])


def test_clashing_columns(spark):
    names = ["score", "key", "more", "size", "taken", "copies", "part", "copy", "gone", "spans", "node", "label", "n"]
    rows = [(i, base(80, i), f"s{i % 2}", *names) for i in range(6)]
    table = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    bench = spark.createDataFrame([(1, " ".join(base(80, 2).split()[5:30]), "clash")], "item_id long, text string, spans string")
    for out in (jaccard.one_of_each(table), decontaminate.clean(table, bench), mixing.mix(table)):
        assert out.columns == table.columns and all(tuple(r)[3:] == tuple(names) for r in out.collect())


def removed(seqs, length=50):
    first, out = {}, {}
    for k in sorted(seqs):
        for i in range(len(seqs[k]) - length + 1):
            first.setdefault(tuple(seqs[k][i : i + length]), k)
    for k, v in seqs.items():
        out[k] = np.zeros(len(v), bool)
        for i in range(len(v) - length + 1):
            if first[tuple(v[i : i + length])] < k:
                out[k][i : i + length] = True
    return out


def test_word_dedup(docs):
    seqs = {k: re.findall(SPACE, t) for k, t in texts().items()}
    gone = removed(seqs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in de_bruijn.dedup(docs).collect()}
    assert got == {k: (len(v), int(gone[k].sum()), " ".join(w for w, g in zip(v, gone[k]) if not g)) for k, v in seqs.items()}


def test_coordinates_are_named_as_spark_does(spark):
    key = np.array([0, 1, -5, 2**62 + 9, -(2**63)], np.int64)
    at = np.array([0, 7, 49, 12345, 2**31 - 1], np.int64)
    rows = spark.createDataFrame(list(zip(key.tolist(), at.tolist())), "key long, at long").selectExpr("xxhash64(key, at) AS h").collect()
    with np.errstate(over="ignore"):
        assert [r.h for r in rows] == de_bruijn.coordinate(key, at).view(np.int64).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_word_dedup_on_random_graphs(spark, seed):
    """Few words and shared passages, so paths branch, end, start and loop; ids and rows repeat, some are null."""
    rng = np.random.default_rng(seed)
    parts = [" ".join(f"w{i}" for i in rng.integers(0, 2 + 3 * seed, rng.integers(1, 30))) for _ in range(8)]
    said = [" ".join(parts[i] for i in rng.integers(0, 8, rng.integers(0, 14))) for _ in range(40)]
    rows = [(int(rng.integers(0, 30)), t) for t in said] + [(None, said[0]), (3, None), (1, said[1]), (1, said[1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    least, length = {}, 12
    words = [(d, (t or "").split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - length + 1 if d is not None else 0):
            least[tuple(w[i : i + length])] = min(d, least.get(tuple(w[i : i + length]), d))
    want = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - length + 1 if d is not None else 0):
            if least[tuple(w[i : i + length])] < d:
                gone |= set(range(i, i + length))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, de_bruijn.dedup(table, length=length).collect()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("limit", [200, de_bruijn.LIMIT])
def test_segments_hold_what_documents_share(spark, limit):
    """Every window that two documents have lies in a segment, no word lies in two, and text that no other document has is left out before single windows are shuffled."""
    rng, length = np.random.default_rng(7), 50
    passage, loop = [f"p{i}" for i in range(60)], ["a", "b"] * 80
    words = {d: [f"w{i}" for i in rng.integers(0, 10**6, 1000)] for d in range(30)}
    for d in range(0, 30, 3):
        words[d][100:160] = passage
        words[d][170 : 170 + 60] = passage  # near the first, so that both are one segment
    words[1][:160] = words[2][-160:] = loop
    words[4][500:600] = words[4][:100]  # repeats in one document only
    rows = [(d, "\t\u3000 \n".join(w) if d % 2 else " ".join(w)) for d, w in words.items()] + [(None, " ".join(passage)), (31, None), (32, " "), (33, " ".join(passage))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    said = {d: (t or "").encode().split() for d, t in rows if d is not None}
    kept, taken = {}, {d: np.zeros(len(w), int) for d, w in said.items()}
    for r in de_bruijn.segments(table, de_bruijn.shared(table, length, limit), length, limit).collect():
        own = r.text.encode().split()
        assert own == said[r.doc_id][r.base : r.base + len(own)]
        taken[r.doc_id][r.base : r.base + len(own)] += 1
        kept.setdefault(r.doc_id, set()).update(range(r.base, r.base + len(own) - length + 1))
    assert max(t.max(initial=0) for t in taken.values()) == 1
    holders = {}
    for d, w in said.items():
        for i in range(len(w) - length + 1):
            holders.setdefault(tuple(w[i : i + length]), set()).add(d)
    for d, w in said.items():
        assert {i for i in range(len(w) - length + 1) if len(holders[tuple(w[i : i + length])]) > 1} <= kept.get(d, set())
    assert sum(t.sum() for t in taken.values()) < sum(len(w) for w in said.values()) / 8
    gone = removed(said)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in de_bruijn.dedup(table.where("doc_id is not null")).collect()}
    assert got == {d: (len(w), int(gone[d].sum()), b" ".join(x for x, g in zip(w, gone[d]) if not g).decode()) for d, w in said.items()}


def test_minimizers_do_not_depend_on_the_batch():
    symbols = K.mix(np.random.default_rng(6).integers(0, 3, 400).astype(np.uint64))
    more = np.concatenate((symbols, K.mix(np.arange(70_000, dtype=np.uint64))))
    one, two = (K.anchors(x, np.array([0, 400, len(x)]), 20, 50, 32) for x in (symbols, more))
    n = int((two[4] == 0).sum())
    assert n == len(one[0]) and all((a == b[:n]).all() for a, b in zip(one, two, strict=True))


def test_byte_dedup(docs):
    seqs = {k: t.encode() for k, t in texts().items()}
    gone = removed(seqs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == {k: (len(v), int(gone[k].sum()), hashlib.sha256(bytes(b for b, g in zip(v, gone[k]) if not g)).hexdigest()) for k, v in seqs.items()}


def test_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(token_files.tokenizer_path()), 0, {}
    for k, t in sorted(texts().items()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.tokens(docs).collect()} == want


def test_token_file_random_access(tmp_path):
    files, path = token_files._open(f"file://{tmp_path}")
    writer = token_files.Writer(files, f"{path}/x")
    ids = np.arange(700_000) % 50_000
    writer.add([1], ids, np.array([0, len(ids)]))
    writer.close()
    shard = token_files.TokenFile(f"{tmp_path}/x.ids")
    for k in (0, 255, 256, len(ids) // token_files.SEQUENCE):
        got, mask = shard.sequence(k)
        want = ids[k * token_files.SEQUENCE : (k + 1) * token_files.SEQUENCE]
        assert (got[: len(want)] == want).all() and mask.sum() == len(want)


def test_fingerprint(docs):
    a, b = "one\ntwo three\nfour", "four\none\ntwo three"
    assert fingerprint.fingerprint(a) == fingerprint.fingerprint(b)
    assert fingerprint.combine(fingerprint.fingerprint("one\ntwo three"), fingerprint.fingerprint("four")) == fingerprint.fingerprint(a)
    assert fingerprint.combine(fingerprint.fingerprint(a), fingerprint.fingerprint("four"), -1) == fingerprint.fingerprint("one\ntwo three")
    t = texts()
    for r in fingerprint.edits(docs).collect():
        own, after = t[r.doc_id], t[(r.doc_id + 1) % len(t)]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.fingerprint(own), fingerprint.fingerprint(edited))
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1 or edited != own)


def test_decontamination(spark, docs):
    item = " ".join(base(400, 3).split()[5:30])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "one two"), (4, "")], "item_id long, text string")
    for block in (decontaminate.BLOCK, 1):
        hits = {r.doc_id: (r.n_words, r["items"]) for r in decontaminate.contamination(docs, bench, block=block).collect()}
        assert {k for k, (_, i) in hits.items() if "1" in i} == {5, 12} | {k for k in hits if k == 4 and "1" in hits[4][1]}
        assert {k for k, (_, i) in hits.items() if "3" in i} == {10, 11}
    left = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    assert 10 not in left and left[11] == "three" and left[0] == texts()[0]


def test_decontamination_of_null_and_repeated_ids(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "three four")], "item_id long, text string")
    rows = [(None, "one two a"), (None, "b three four"), (7, "one two c"), (7, "clean")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (decontaminate.BLOCK, 1):
        assert sorted(r["items"] for r in decontaminate.contamination(table, bench, block=block).collect()) == [[], ["1"], ["1"], ["2"]]
        assert sorted(r.text for r in decontaminate.clean(table, bench, block=block).collect()) == ["a", "b", "c", "clean"]


def test_mixing(docs):
    rows = mixing.mix_plan(mixing.sizes(docs)).collect()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(v - k[1]) <= 1 for k, v in taken.items())
    assert abs(sum(k[1] for k in taken) - 1.5 * sum(r.size for r in rows)) < 1e-6


def test_urls(spark):
    cases = [("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("x://org/", "org", "/", "org/", "allow"), ("x://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("x://notorg", "notorg", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None)]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    for r in urls.judge(pages).collect():
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_quality(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join((f"good{w}" if i % 2 else f"BAD{w}!!") for w in rng.integers(0, 99, 60))) for i in range(300)] + [(300, None), (301, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 0), (6, None)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert np.mean([(scores[i] > 0.5) == (i % 2 == 1) for i in range(300)]) > 0.97 and all(0 <= s <= 1 for s in scores.values())


def test_quality_ratio_of_labels_outlives_the_sample_bound(spark):
    """Overlapping classes, 6 good : 1 bad: a bounded sample means the same threshold as all labels."""
    rng = np.random.default_rng(4)
    good = [i % 7 != 0 for i in range(1400)]
    rows = [(i, " ".join((f"good{w}" if rng.random() < (0.55 if g else 0.45) else f"BAD{w}!!") for w in rng.integers(0, 30, 40))) for i, g in enumerate(good)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    bounded = quality.fit(table, labels, fold=None, per_class=200)
    assert abs(np.mean([bounded.score(t) for _, t in rows]) - 6 / 7) < 0.06
    lone = spark.createDataFrame([(i, int(i > 0)) for i in range(1400)], "doc_id long, quality int")
    assert abs(quality.fit(table, lone, fold=None, per_class=200).score("x") - 1400 / 1402) < 1e-9


def test_lm(docs):
    model = lm.fit(docs)
    for r in lm.score(docs, model).collect():
        n = len(re.findall(SPACE, texts()[r.doc_id]))
        assert r.n_tokens == n and (r.mean_log_probability is None) == (n == 0) and r.pseudo_log_likelihood <= 0


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Bit by bit, over several trainers of more than one chunk, null and repeated ids among the rows."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 90 == 7 else i % 380, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 1500) % 5000)) for i in range(400)]
    rows += [rows[3], (8, None), (9, "")]
    monkeypatch.setattr(lm, "SHARE", 1 << 21)
    found = []
    for n in (1, 16):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        chunks = lm.chunked(table).collect()
        assert len({r.chunk for r in chunks}) == len(chunks) > len({r.chunk >> lm.NUMBER for r in chunks}) > 1
        assert sum(len(r.doc_id) for r in chunks) == len(rows)
        found.append(sorted(map(repr, lm.score(table, lm.fit(table)).collect())))
    assert found[0] == found[1]


def test_lm_gradients():
    """Against differences of the loss, and the loss against a plain softmax, with logits below and above SAFE."""
    rng = np.random.default_rng(9)
    around, target = rng.integers(0, 30, (2500, 4)).astype(np.uint16), rng.integers(0, lm.CLASSES, 2500)
    for scale in (0.3, 12.0):
        weights = [(rng.standard_normal(shape) * scale).astype(np.float32) for shape in lm.SHAPES]
        weights[0] /= 4 * scale

        def loss(weights):
            hidden = np.tanh(sum(weights[0][k].astype(float)[around[:, k]] for k in range(4)))
            z = hidden @ weights[1].astype(float) + weights[2]
            z -= z.max(1, keepdims=True)
            return np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), target]

        assert np.allclose(-lm.log_probabilities(weights, around, target), loss(weights), atol=1e-3)
        for k, g in enumerate(lm.Trainer(weights).gradients(around, target)):
            for at in [tuple(rng.integers(0, min(m, 30)) for m in lm.SHAPES[k]) for _ in range(5)]:
                near = []
                for step in (1e-2, -1e-2):
                    moved = [w.astype(float) for w in weights]
                    moved[k][at] += step
                    near.append(loss(moved).mean())
                assert abs((near[0] - near[1]) / 2e-2 - g[at]) < 1e-3 * max(1, scale)


def test_lm_counts_tokens_one_by_one(spark):
    """More distinct tokens than a table of 2**18 buckets has: the totals of all chunks are exact, and no token inherits another's."""
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(3000)) + " again") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    vocabulary = lm.vocabulary_of(lm.chunked(table))
    assert vocabulary.total.sum() == 100 * 3001 + 0.5 * (100 * 3000 + 1)
    bits = 8
    keys = np.sort(K.mix(np.arange(300_000, dtype=np.uint64)))
    parts = [lm.pieces_of(keys[k::3], np.full(len(keys[k::3]), 1 + 299 * k), k, bits, True, True) for k in range(3)]
    parts.append(lm.pieces_of(keys, np.ones(len(keys), int), 3, bits, True, True))
    import pyarrow as pa

    table = pa.Table.from_batches(parts)
    got = {}
    for shard in range(1 << bits):
        for r in lm._add_up(table.filter(pa.compute.equal(table["shard"], shard))).to_pylist():
            got.setdefault(r["chunk"], []).append(lm.unpack(r["counts"], r["n"]))
    assert (np.concatenate(got[3]) == 2 + 299 * (np.arange(300_000) % 3)).all()


def test_lm_predicts_rare_tokens_from_both_neighbours(spark):
    """Of two tokens with one count and one class, the one its neighbours call for scores higher; a class adds up to 1."""
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(lm.OWN)]
    rare = [f"r{i}" for i in range(300)]
    rows = []
    for d in range(60):
        words = []
        for i in rng.permutation(300):
            words += [*rng.choice(common, 6), f"l{i}", rare[i], f"n{i}"]
        rows.append((d, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.fit(table)
    import pyarrow as pa

    def mean(texts):
        made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return np.mean([r.pseudo_log_likelihood for r in lm.score(made, model).collect()])

    hashes = lm.words(pa.RecordBatch.from_pydict({"text": [" ".join(rare)]}))[0]
    cls = model.vocabulary.places(hashes)[0]
    pairs = [(i, j) for i in range(300) for j in range(300) if i != j and cls[i] == cls[j] >= lm.OWN][:50]
    right, wrong = mean([f"l{i} {rare[i]} n{i}" for i, _ in pairs]), mean([f"l{i} {rare[j]} n{i}" for i, j in pairs])
    assert right > wrong + 1
    i = pairs[0][0]
    totals, keys = [], {}
    for _, t in rows:
        h, f = lm.words(pa.RecordBatch.from_pydict({"text": [t]}))
        u, ids = np.unique(h, return_inverse=True)
        k, c, _ = lm.keys_of(model.vocabulary, u, ids, f)
        for a, b in zip(k, c, strict=True):
            keys[a] = keys.get(a, 0) + b
    for w in [w for w in rows[0][1].split() if w not in common]:
        h, f = lm.words(pa.RecordBatch.from_pydict({"text": [f"l{i} {w} n{i}"]}))
        u, ids = np.unique(h, return_inverse=True)
        k, _, at = lm.keys_of(model.vocabulary, u, ids, f)
        kinds = model.vocabulary.places(h)[0]
        if kinds[1] == cls[i]:
            middle = int((kinds[:1] >= lm.OWN).sum())
            totals.append(np.exp(lm.within(model.vocabulary, kinds[1:2], np.array([keys.get(x, 0) for x in k]), at[:, middle : middle + 1], 0))[0])
    assert abs(sum(totals) - 1) < 1e-9


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (jaccard.classes(empty), de_bruijn.dedup(empty), suffix_dedup.dedup(empty), fingerprint.edits(empty), decontaminate.contamination(empty, bench), mixing.mix_plan(mixing.sizes(empty)), quality.score(empty, quality.fit(empty, labels)), lm.score(empty, lm.fit(empty))):
        assert out.count() == 0


def test_anchors_cover_every_window():
    symbols = K.mix(np.random.default_rng(5).integers(0, 4, 3000).astype(np.uint64))
    firsts = np.array([0, 40, 1000, 1000, 3000])
    _, at, lo, hi, row = K.anchors(symbols, firsts, 12, 50)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert sorted(covered) == [i for i in range(3000) if K.room(firsts)[i] >= 50]
    assert ((at >= hi) & (at + 12 <= lo + 50)).all()


def test_jaccard_of_a_large_group_near_the_threshold(spark, monkeypatch):
    """Copies with edits of their own: about half of all pairs link, and no cell's least set links all of them."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for at in rng.integers(0, len(base), int(rng.integers(1, 4))):
            words[at] = f"x{d}_{at}"
        rows.append((d, " ".join(words)))
    monkeypatch.setattr(jaccard, "GROUP", 16)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=5, num=85).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) > 1


def test_matrix_products_keep_to_one_thread():
    """The network's products take no more CPU than time, though the library may use four threads."""
    import os
    import subprocess
    import sys

    code = """
import time
import numpy as np
from tidegrid.llm import lm
from tidegrid.llm import _kernel as K
vocabulary = lm.Vocabulary(np.arange(500, dtype=np.uint64), np.ones(500), np.ones(lm.SHARED))
class share: value = (vocabulary, lm.initial(vocabulary))
import pyarrow as pa
hashes, ids = np.arange(500, dtype=np.uint64), np.random.default_rng(1).integers(0, 500, 300_000).astype(np.uint32)
table = pa.table({"trainer": [0], "chunk": [0], "sizes": [[len(ids)]], "ids": [ids.tobytes()], "hashes": [hashes.tobytes()]})
cpu, wall = time.process_time(), time.time()
lm._train(share)((pa.scalar(0),), table)
print((time.process_time() - cpu) / (time.time() - wall))
"""
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": "4", "OPENBLAS_NUM_THREADS": "4"}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 1.3


def test_lm_steps_keep_memory_between_arrays():
    """A step's arrays take the memory of those before them, and the worker gives it back at the end."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from tidegrid.llm import lm
from tidegrid.llm import _kernel as K
rng = np.random.default_rng(1)
said = [" ".join(map(str, rng.integers(0, 50000, 400))) for _ in range(3000)]
docs = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": said, "trainer": [0] * 3000})
vocabulary = lm.Vocabulary(np.arange(500, dtype=np.uint64), np.ones(500), np.ones(lm.SHARED))
class share: value = (vocabulary, None)
chunks = list(lm._cut(iter([docs])))
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
a = faults()
cut = len(list(lm._cut(iter([docs]))))
b = faults()
keys = sum(x.num_rows for x in lm._pieces(share, 9, 1, True, True)(iter(chunks)))
c = faults()
held = int(open("/proc/self/statm").read().split()[1])
K.give_back()
print(cut, keys, (b - a) / cut, (c - b) / cut, held - int(open("/proc/self/statm").read().split()[1]))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    cut, keys, cutting, naming, given = map(float, done.stdout.split())
    assert cut > 4 and keys > 500 and cutting < 2500 and naming < 1200 and given > 0


def test_lm_tallies_keys():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 60, 500).astype(np.uint64), np.zeros(0, np.uint64), np.array([7, 1 << 63, 7], np.uint64)):
        want = np.unique(keys, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(lm.tallied(keys), want, strict=True))


def test_groups_may_keep_some_memory():
    """Between groups a worker keeps what it is told to, so the next group's arrays need not be mapped anew; else nothing."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from tidegrid.llm import _kernel as K
K.hold()
def step(table):
    return sum(float((np.ones(1 << 18) * k).sum()) for k in range(4))
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for but in (0, K.HELD):
    run = K.lean_group(step, but)
    run(None)
    a = faults()
    for _ in range(10):
        run(None)
    print((faults() - a) / 10)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    anew, kept = map(float, done.stdout.split())
    assert anew > 400 and kept < 100  # an array has 512 pages


def test_lm_chunks_name_tokens_in_two_bytes():
    """Four bytes only where a chunk has more than 65,536 distinct tokens; both are read back."""
    import pyarrow as pa

    for n, size in ((65_536, 2), (65_537, 4)):
        text = " ".join(f"{i:x}" for i in [*range(n), 7])
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "trainer": pa.array([0], pa.int32())})
        (row,) = next(lm._cut(iter([batch]))).to_pylist()
        assert row["tokens"] == n + 1 and len(row["ids"]) == size * (n + 1)
        hashes, ids, firsts = lm._read(row)
        assert np.array_equal(hashes[ids], lm.words(batch)[0]) and list(firsts) == [0, n + 1]


def test_lm_tally_leaves_out_what_cannot_be_frequent(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "FREQUENT", 50)
    rng = np.random.default_rng(3)
    shards = [(np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64)), rng.integers(1, 400, 300)) for _ in range(40)]
    run, found = lm._tally(), []
    for h, n in shards:
        halves = [(h[::2], n[::2]), (h, n)]
        table = pa.table({"n": [len(i) for i, _ in halves], "names": [i.tobytes() for i, _ in halves], "counts": [lm.pack(c) for _, c in halves]})
        found += [(-r["n"], np.int64(r["hash"]).view(np.uint64)) for r in run(table).to_pylist() if r["hash"] is not None]
    want = sorted((-int(c * (2 - i % 2)), x) for h, n in shards for i, (x, c) in enumerate(zip(h, n, strict=True)))
    assert sorted(found)[:50] == [(float(n), x) for n, x in want[:50]] and len(found) < 40 * 50 / 4


def test_lm_packs_many_at_once(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    counts = rng.choice([0, 1, 2, 254, 255, 256, 1 << 40], 1000)
    ends = np.array([0, 3, 3, 400, 999, 1000])
    each = [lm.pack(counts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert lm.packs(counts, ends) == each
    assert np.array_equal(lm.unpacks(each, list(np.diff([0, *ends]))), counts)
    keys = [np.sort(K.mix(rng.integers(0, 3000, 900).astype(np.uint64))) for _ in range(4)]
    keys = [np.unique(k) for k in keys]
    table = pa.Table.from_batches([lm.pieces_of(k.copy(), np.full(len(k), 100 + i), i, 0, i != 2, i != 3) for i, k in enumerate(keys)])
    totals = {}
    for i, k in enumerate(keys):
        for x in k.tolist():
            totals[x] = totals.get(x, 0) + (100 + i) * (i != 2)
    for bits in (40, 64):  # sorted with their places in one number, and apart
        monkeypatch.setattr(lm, "NAME", bits)
        got = {r["chunk"]: list(lm.unpack(r["counts"], r["n"])) for r in lm._add_up(table).to_pylist()}
        assert got == {i: [totals[x] for x in keys[i].tolist()] for i in range(3)}
