"""Hash chains: what sealing gives, and what each kind of damage shows as."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import chain


@pytest.fixture(scope="module")
def log(spark):
    rows = [("one", i, "run", f"h{i % 7}", None if i == 5 else f'{{"x": {i}, "é": "{"y" * (i % 11)}"}}') for i in range(10_000)] + [(f"c{i}", 1, "note", "h", "p") for i in range(20)]
    out = chain.seal(spark.createDataFrame(rows, "chain string, ts long, kind string, subject string, payload string")).cache()
    yield out
    out.unpersist()


def found(log):
    return {r.chain: (r.records, r.sound, r.broken_at, r.fault) for r in chain.verify(log).collect()}


def test_ten_thousand_records_verify(log):
    out = found(log)
    assert out.pop("one") == (10_000, True, None, None) and set(out.values()) == {(1, True, None, None)} and len(out) == 20
    last = "0" * 64
    for r in log.where("chain = 'one' AND seq < 300").orderBy("seq").collect():
        text = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.seq, r.ts, r.kind, r.subject, r.payload, last))
        assert r.prev_hash == last and r.hash == hashlib.sha256(text.encode()).hexdigest()
        last = r.hash


@pytest.mark.parametrize(("change", "want"), [
    (lambda d: d.withColumn("payload", F.when(F.col("seq") == 6543, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))), (10_000, False, 6543, "edited")),
    (lambda d: d.withColumn("kind", F.when(F.col("seq") == 12, "note").otherwise(F.col("kind"))).withColumn("hash", F.when(F.col("seq") == 12, chain.record_hash()).otherwise(F.col("hash"))), (10_000, False, 13, "unlinked")),
    (lambda d: d.where("seq <> 7000"), (9_999, False, 7001, "gap")),
    (lambda d: d.where("seq > 99"), (9_900, False, 100, "gap")),
    (lambda d: d.unionByName(d.where("seq = 40")), (10_001, False, 40, "repeated")),
    (lambda d: d.withColumn("seq", F.when(F.col("seq") == 50, 51).when(F.col("seq") == 51, 50).otherwise(F.col("seq"))), (10_000, False, 50, "unlinked")),
    (lambda d: d.withColumn("prev_hash", F.when(F.col("seq") == 0, F.lit("f" * 64)).otherwise(F.col("prev_hash"))), (10_000, False, 0, "unlinked")),
    (lambda d: d.where("seq < 9000"), (9_000, True, None, None)),
])
def test_damage_names_its_record(log, change, want):
    assert found(change(log.where("chain = 'one'")))["one"] == want


def test_no_records(spark):
    assert chain.verify(chain.seal(spark.createDataFrame([], "chain string, ts long, kind string, subject string, payload string"))).count() == 0
