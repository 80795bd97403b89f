import random

import numpy as np
import pytest

from tracewell.llm import mixing
from tracewell.llm.mixing import TEMPER, mix, mixed_copies, mixing_rates


def rows(n=1500, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choices(["big", "mid", "small", None], [70, 20, 8, 2])[0]
        lang = rng.choices(["en", "de"], [80, 20] if source == "big" else [40, 60])[0]
        out.append((i, "w " * rng.randint(1, 300), lang, source))
    return out


def docs_of(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string")


def brute(data, targets, rounds=300):
    """The same optimum by scaling one dimension after another."""
    tokens = np.array([len(t.split()) for _, t, _, _ in data], float)
    keys = [np.array([str(r[3]) for r in data]), np.array([r[2] for r in data]), np.floor(np.log2(tokens)).astype(int).astype(str)]
    rate, total = np.ones(len(data)), tokens.sum()
    for _ in range(rounds):
        for key, wanted in zip(keys, targets):
            for value, share in wanted.items():
                on = key == value
                rate[on] *= share * total / (rate[on] * tokens[on]).sum()
    return rate, keys, tokens


def test_rates_match_iterated_scaling(spark):
    data = rows()
    tokens = np.array([len(t.split()) for _, t, _, _ in data], float)
    share = lambda key: {v: tokens[key == v].sum() / tokens.sum() for v in np.unique(key)}
    source = {v: x**TEMPER for v, x in share(np.array([str(r[3]) for r in data])).items()}
    source = {v: x / sum(source.values()) for v, x in source.items()}
    rate, keys, _ = brute(data, [source, share(np.array([r[2] for r in data])), share(np.floor(np.log2(tokens)).astype(int).astype(str))])
    got = {r.doc_id: r for r in mixed_copies(docs_of(spark, data), budget=tokens.sum()).collect()}
    mine = np.array([got[i].rate for i in range(len(data))])
    assert np.allclose(mine, rate, rtol=1e-4)
    # constraints hold, and copies keep them about
    for value, want in source.items():
        on = keys[0] == value
        assert abs((mine * tokens)[on].sum() / tokens.sum() - want) < 1e-6
        copies = np.array([got[i].copies for i in range(len(data))])
        assert abs((copies * tokens)[on].sum() / (copies * tokens).sum() - want) < 0.03
    assert all(abs(r.copies - r.rate) < 1 for r in got.values())


def test_default_budget_loses_nothing(spark):
    docs = docs_of(spark, rows())
    got = mixed_copies(docs).collect()
    assert min(r.copies for r in got) == 1 and min(r.rate for r in got) >= 1 - 1e-9
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert out.select("doc_id").distinct().count() == docs.count()


def test_given_targets(spark):
    docs = docs_of(spark, [r for r in rows() if r[3]])
    got = mixed_copies(docs, {"source": {"big": 1, "mid": 1, "small": 2, "nowhere": 5}}, budget=1e5).collect()
    tokens = {s: sum(r.rate * r.tokens for r in got if r.source == s) for s in ("big", "mid", "small")}
    assert np.allclose([tokens["big"], tokens["mid"], tokens["small"]], [25e3, 25e3, 50e3], rtol=1e-4)
    with pytest.raises(ValueError):
        mixing_rates(docs.selectExpr("source", "lang", "1L tokens"), {"source": {"big": 0}})


def test_edge_rows(spark):
    data = [(1, None, "en", "a", 1), (2, "", None, "a", 2), (3, "x " * 100_000, "en", None, 3), (4, "a b", "en", "b", 4), (4, "a b", "en", "b", 4), (None, "q", "de", "b", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, rate int")
    got = mixed_copies(docs).collect()
    assert len(got) == 6 and all(r.copies is not None for r in got)
    assert len({(r.rate, r.copies) for r in got if r.doc_id == 4}) == 1
    out = mix(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}
    assert mixed_copies(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    only_empty = docs.where("text is null or text = ''")
    assert mix(only_empty).count() == 2


def test_many_sources_and_many_languages(spark, monkeypatch):
    """Far more sources than a dense system would take; languages by conjugate gradients as by the whole Hessian."""
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(1, 60), f"l{rng.randrange(12)}", f"s{i % 5200}") for i in range(12_000)]
    docs = docs_of(spark, data).selectExpr("source", "lang", "cast(size(split(trim(text), ' ')) as long) as tokens")
    total = docs.selectExpr("sum(tokens)").first()[0]
    targets = {"lang": {"l0": 2, "l1": 1, "l2": 1}}
    want = {(r.source, r.lang, r.band): r for r in mixing_rates(docs, targets, budget=total).collect()}
    assert len({k[0] for k in want}) == 5200
    lang = lambda v: sum(r.rate * r.tokens for r in want.values() if r.lang == v)
    assert abs(lang("l0") - 2 * lang("l1")) < 1e-4 * total and abs(lang("l1") - lang("l2")) < 1e-4 * total
    assert abs(sum(r.rate * r.tokens for r in want.values()) - total) < 1e-6 * total
    monkeypatch.setattr(mixing, "DENSE", 0)
    got = {(r.source, r.lang, r.band): r.rate for r in mixing_rates(docs, targets, budget=total).collect()}
    assert all(abs(got[k] - r.rate) < 1e-4 * r.rate for k, r in want.items())


def test_targets_that_contradict(spark):
    docs = spark.createDataFrame([("a", "en", 10), ("b", "de", 10)], "source string, lang string, tokens long")
    with pytest.warns(UserWarning, match="not met"):
        mixing_rates(docs, {"source": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 3}}, budget=20)
