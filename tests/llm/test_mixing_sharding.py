import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from voxelweave.llm import mixing, sharding

from .cases import documents, empty


def test_bisection(spark):
    tokens = [1000, 100, 10, 0]
    totals = mixing.ListTotals(tokens)
    found = mixing.solve(totals, target_entropy=0.9)
    w = mixing.weights(tokens, found.exponent)
    assert mixing.entropy(w) == pytest.approx(0.9, abs=1e-9) and w[3] == 0 and 0 < found.exponent < 1
    assert w[0] / w[1] == pytest.approx(10**found.exponent)
    found = mixing.solve(totals, max_epochs=3)
    w = mixing.weights(tokens, found.exponent)
    assert max(x * found.spent / t for x, t in zip(w, tokens) if t) == pytest.approx(3) and found.spent == 1110
    found = mixing.solve(totals, max_epochs=1.5, whole=True)
    w = mixing.weights(tokens, found.exponent)
    assert min(x * found.spent / t for x, t in zip(w, tokens) if t) == pytest.approx(1)
    assert max(x * found.spent / t for x, t in zip(w, tokens) if t) == pytest.approx(1.5)
    assert mixing.solve(totals, target_entropy=9).exponent == 0 and mixing.solve(totals, target_entropy=0.1).exponent > 1
    again = mixing.TableTotals(spark.createDataFrame([(t,) for t in tokens], "t long"))
    for how in ({"target_entropy": 0.9}, {"max_epochs": 3}, {"max_epochs": 1.5, "whole": True}):
        one, two = (mixing.solve(t, **how) for t in (totals, again))
        assert two.exponent == pytest.approx(one.exponent, rel=1e-12) and two.norm == pytest.approx(one.norm, rel=1e-12) and two.spent == pytest.approx(one.spent)
    assert mixing.solve(mixing.ListTotals([]), max_epochs=2).spent == 0 and mixing.solve(mixing.ListTotals([0]), max_epochs=2).spent == 0
    with pytest.raises(ValueError):
        mixing.solve(totals, max_epochs=2, budget=10_000)
    with pytest.raises(ValueError):
        mixing.solve(totals)


def plain_schedule(spark, docs, plans, seed):
    """Every use ``(doc, source, epoch, block)`` by walking each source's permutations one row after the other."""
    rows, uses = mixing.dealt(docs, "source", "doc_id", "text", None, seed).collect(), Counter()
    for p in plans:
        own = [r for r in rows if r.source == p.source]
        key = "n" if p.source is None else "s" + p.source
        whole = math.floor(p.epochs + 1e-9) if p.tokens else 1
        left = p.budget - whole * p.tokens if p.tokens else 0
        present = sorted({r["__b"] for r in own})
        for epoch in range(whole + (left >= 0.5)):
            keys = spark.createDataFrame([(key, b, epoch) for b in present], "__src string, __b int, epoch int").select("__b", mixing.block_order(seed).alias("k")).collect()
            for place, block in enumerate(b for _, b in sorted((r.k, r["__b"]) for r in keys)):
                inside = [r for r in own if r["__b"] == block]
                size = sum(r.n_tokens for r in inside)
                fits = epoch < whole or size <= left
                if not fits:
                    by_place = sorted({r["__g"] for r in inside})
                    for g in by_place:
                        some = [r for r in inside if r["__g"] == g]
                        left -= sum(r.n_tokens for r in some)
                        if left < 0:
                            break
                        uses.update((r.doc_id, r.source, epoch, place) for r in some)
                    break
                uses.update((r.doc_id, r.source, epoch, place) for r in inside)
                left -= size if epoch >= whole else 0
    return uses


@pytest.mark.parametrize("how", [{"max_epochs": 2.5}, {"target_entropy": 1.3}, {"max_epochs": 1.5, "whole": True}, {"max_epochs": 1.0, "budget": 1500.0}])
def test_budgets(spark, how):
    docs = spark.createDataFrame([(i, f"s{min(3, int(math.log2(1 + i % 60) / 1.5))}" if i % 11 else None, "w " * (1 + i % 7)) for i in range(2500)], "doc_id long, source string, text string")
    out, plans = mixing.schedule(docs, seed=3, **how)
    rows, plans = out.collect(), plans.collect()
    spent, seen = Counter(), Counter((r.doc_id, r.source) for r in rows)
    for r in rows:
        spent[r.source] += r.n_tokens
        assert r.n_tokens == len(r.text.split())
    tokens = [p.tokens for p in plans]
    assert [p.weight for p in plans] == pytest.approx(mixing.weights(tokens, plans[0].exponent))
    for p in plans:
        assert p.budget - 8 < spent[p.source] <= p.budget + 1e-6
        counts = [seen[r.doc_id, r.source] for r in docs.collect() if r.source == p.source]
        assert max(counts) - min(counts) <= 1 and min(counts) == math.floor(p.epochs + 1e-9)
    assert Counter((r.doc_id, r.source, r.epoch, r.block) for r in rows) == plain_schedule(spark, docs, plans, 3)


def test_blocks_have_fixed_members(spark):
    """A block's rows stay together in every epoch, in an order of blocks of its own."""
    docs = spark.createDataFrame([(i, "a" if i % 9 else "b", f"w {i}") for i in range(1500)], "doc_id long, source string, text string")
    rows = mixing.schedule(docs, max_epochs=3.0)[0].where("source = 'b'").collect()
    by = [{} for _ in range(3)]
    for r in rows:
        if r.epoch < 2:
            by[r.epoch].setdefault(r.block, set()).add(r.doc_id)
    assert sorted(map(sorted, by[0].values())) == sorted(map(sorted, by[1].values())) and by[0] != by[1]


def test_mixing_odd_rows(spark):
    docs = documents(spark)
    out, plans = mixing.schedule(docs, max_epochs=2.0)
    assert out.columns == [*docs.columns, "n_tokens", "epoch", "block"] and plans.count() == docs.select("source").distinct().count()
    assert mixing.digest(empty(spark)).count() == 0
    kept = mixing.schedule(docs, max_epochs=1.5, whole=True)[0]
    assert kept.where("epoch = 0").count() == docs.count()
    clash = docs.selectExpr("*", "'x' AS block", "1.5 AS epoch", "7 AS n_tokens")
    assert mixing.schedule(clash, max_epochs=2.0)[0].columns == out.columns
    assert mixing.schedule(clash, max_epochs=2.0, tokens_col="n_tokens")[0].where("n_tokens <> 7").count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id long, source string, text string")
    assert mixing.digest(nothing).count() == 2


def plain_table(names, slots):
    """Shards take turns: each claims the first free slot of its own order."""
    orders = []
    for n in names:
        seed = hashlib.sha256(n.encode()).digest()
        at, skip = int.from_bytes(seed[:8], "big") % slots, int.from_bytes(seed[8:16], "big") % (slots - 1) + 1
        orders.append(iter([(at + k * skip) % slots for k in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for shard, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(s for s in order if s not in owner)] = shard
    return [owner[s] for s in range(slots)]


def test_table_by_plain_turns():
    names = [f"n{k}" for k in range(7)]
    assert sharding.lookup_table(names, 211).tolist() == plain_table(names, 211)


def test_table_is_fair_and_stable():
    names = [f"n{k}" for k in range(10)]
    full = sharding.lookup_table(names, 1009)
    assert np.ptp(np.bincount(full)) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    stay = full != 9
    assert (full[stay] == fewer[stay]).mean() > 0.7
    double = np.bincount(sharding.lookup_table(names, 1009, {"n3": 2}))
    assert abs(double[3] - 2 * double[0]) <= 2
    for bad in ({"slots": 100}, {"shards": []}, {"shards": ["a", "a"]}, {"weights": {"n0": -1}}):
        with pytest.raises(ValueError):
            sharding.lookup_table(**{"shards": names, "slots": 1009} | bad)


def test_placement(spark, tmp_path):
    docs = documents(spark)
    out = sharding.assign(docs, shards=7, slots=101)
    table = sharding.lookup_table(7, 101)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns, "slot", "shard"]
    assert all(table[r.slot] == r.shard for r in rows)
    assert len({(r.doc_id, r.slot) for r in rows}) == len({r.doc_id for r in rows})
    assert "Exchange hash" not in out._jdf.queryExecution().toString()
    clash = docs.selectExpr("*", "'x' AS slot", "0.5 AS shard")
    assert sharding.assign(clash, shards=7, slots=101).select(*out.columns).collect() == rows
    sharding.write_shards(docs, str(tmp_path / "s"), 7, files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
    assert sharding.digest(empty(spark)).count() == 0
