import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import mixing, packing, tokens


def test_differencing_balances():
    part = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    loads = np.bincount(part, weights=[8, 7, 6, 5, 4])
    assert abs(loads[0] - loads[1]) <= 2
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 100) for _ in range(200)])
    loads = np.bincount(packing.differencing(sizes, 10), weights=sizes, minlength=10)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 3


def test_fill_keeps_the_capacity():
    rng = random.Random(2)
    for capacity in (10, 100, 1000):
        sizes = np.array([rng.randint(0, capacity) for _ in range(150)])
        part = packing.fill(sizes, capacity)
        loads = np.bincount(part, weights=sizes)
        assert loads.max() <= capacity and len(part) == 150
        assert len(loads) <= max(1.35 * sizes.sum() / capacity + 2, (2 * sizes > capacity).sum() * 1.2 + 2)
    assert packing.fill(np.array([], dtype=int), 5).tolist() == [] and packing.fill(np.array([5, 5]), 5).tolist() in ([0, 1], [1, 0])


def test_pack_places_every_token_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 3, 40, 200, 700, 1500])) for i in range(400)] + [(900, None)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("id", F.lit("clash")).drop("id")
    packs = spark.createDataFrame([("s", 512), ("m", 2048), ("bad", 0), (None, 5)], "pack_name string, capacity_tokens int")
    got = packing.pack(sizes, packs).collect()
    for name, capacity in (("s", 512), ("m", 2048)):
        mine = [r for r in got if r["pack_name"] == name]
        per_doc, loads = {}, {}
        for r in mine:
            per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["n_tokens"]
            loads[r["container"]] = loads.get(r["container"], 0) + r["n_tokens"]
        assert per_doc == {i: n for i, n in rows if n is not None} and max(loads.values()) <= capacity
        assert all(n <= capacity or len([1 for r in mine if r["doc_id"] == i]) == -(-n // capacity) for i, n in rows if n)
        assert all(len([1 for r in mine if r["doc_id"] == i]) == 1 for i, n in rows if n is not None and n <= capacity)
    report = {r["pack_name"]: r["used_share"] for r in packing.fill_report(packing.pack(sizes, packs)).collect()}
    assert set(report) == {"s", "m"} and min(report.values()) > 0.75
    assert packing.pack(sizes.where("false"), packs).collect() == []


def test_token_counts(spark):
    d = spark.createDataFrame([("hello world",), ("",), (None,), ("x" * 100_000,), ("<|endoftext|>",)], "text string")
    got = [r[0] for r in d.select(tokens.token_count(F.col("text"))).collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] is None and got[3] > 1000 and got[4] > 1


def _targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int").where("source <> 'gone' or target_share > 0.05")


def test_mix_reaches_shares_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.randint(20, 400)) for i, s in enumerate(["a"] * 3000 + ["b"] * 400 + ["c"] * 300 + ["none"] * 50)]
    sizes = spark.createDataFrame(rows, "id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    report = {r["source"]: r for r in mixing.share_report(mixed, targets).collect()}
    for r in report.values():
        assert r["reached_share"] == pytest.approx(r["target_share"], abs=0.005) and r["most_copies"] <= r["max_repeats"]
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1.0)
    # the scarcest source is used up
    full = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    assert any(report[s]["tokens"] == pytest.approx(full[s] * report[s]["max_repeats"], rel=0.01) for s in "abc")
    again = {tuple(r) for r in mixing.mix(sizes, targets).collect()}
    assert again == {tuple(r) for r in mixed.collect()}
    assert mixing.mix(sizes.where("false"), targets).collect() == []


def test_equal_texts_are_one(spark):
    d = spark.createDataFrame([(2, "x", "a"), (1, "x", "b"), (3, "y", "a"), (4, None, "a"), (5, "z", "other"), (6, "z", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {(r["id"], r["source"]) for r in mixing.distinct_texts(d, "doc_id", "text", "source", targets).collect()}
    assert got == {(1, "b"), (3, "a")}
