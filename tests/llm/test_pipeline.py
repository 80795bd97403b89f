import random

import numpy as np
import pytest

import corpus_pipeline
from tracewell.llm.simhash import MAX_DISTANCE, Fingerprinter, Forest

INSULTS = ("idiot", "scum", "moron", "stupid")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of known kinds: clean, toxic, copied, with private data, from sources of unequal size."""
    rng = random.Random(6)
    words = ["".join(rng.choices(["an", "the", "ti", "on", "re", "ou", "mi", "lo"], k=rng.randint(1, 4))) for _ in range(2500)]
    rows, labels, kinds = [], [], {}
    for i in range(600):
        body = rng.choices(words, k=rng.randint(40, 160))
        kind = rng.choices(["clean", "toxic", "private", "copy"], [60, 20, 10, 10])[0]
        if kind == "copy" and i > 50:
            source = rng.choice([k for k, v in kinds.items() if v == "clean"])
            body = rows[source][1].split()
            body[rng.randrange(len(body))] = rng.choice(words)
        elif kind == "toxic":
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(INSULTS))
        elif kind == "private":
            body.insert(rng.randrange(len(body)), f"who{i}@mail.example.com")
        else:
            kind = "clean"
        kinds[i] = kind
        text = " ".join(body)
        rows.append((i, text, "en", rng.choice(["big"] * 8 + ["small"]), len(text)))
        if i % 2:
            labels.append((i, 1, int(kind == "toxic")))
    base = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows, kinds


def test_stages_against_brute_force(spark, folder):
    base, rows, kinds = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, base)
        if name != "bpe":
            assert out.dtypes == docs.dtypes
        seen[name] = [r.asDict() for r in out.collect()]
        docs = spark.createDataFrame([tuple(r.values()) for r in seen[name]], out.schema)
    # toxic documents go, no others
    left = {r["doc_id"]: r for r in seen["toxicity"]}
    assert left.keys() == {i for i, k in kinds.items() if k != "toxic"}
    # one document of each group, found by comparing all pairs
    ids = sorted(left)
    prints = Fingerprinter()([left[i]["text"] for i in ids])
    apart = np.bitwise_count(prints[:, None, :] ^ prints[None]).sum(2)
    forest = Forest(len(ids))
    forest.join(*np.nonzero(np.triu(apart <= MAX_DISTANCE, 1)))
    want = {ids[r] for r in set(forest.parent.tolist())}
    kept = {r["doc_id"] for r in seen["simhash_near_dedup"]}
    assert len(kept ^ want) <= 2 and kept <= left.keys()
    # private data goes, all else stays as it was
    text = {i: t for i, t, *_ in rows}
    for r in seen["pii"]:
        changed = text[r["doc_id"]].replace(f"who{r['doc_id']}@mail.example.com", "[EMAIL]")
        assert r["text"] == changed and r["n_chars"] == len(changed)
    assert {r["doc_id"] for r in seen["pii"]} == kept
    # the small source gains, nothing is lost
    share = lambda rows: sum(len(r["text"].split()) for r in rows if r["source"] == "small") / sum(len(r["text"].split()) for r in rows)
    before = share(seen["pii"])
    goal = before**0.7 / (before**0.7 + (1 - before) ** 0.7)
    assert abs(share(seen["source_mixing"]) - goal) < 0.05
    assert {r["doc_id"] for r in seen["source_mixing"]} == kept
    # every text comes back
    assert len(seen["bpe"]) == len(seen["source_mixing"]) and all(r["round_trip"] for r in seen["bpe"])


def test_run(spark, folder):
    base, _, kinds = folder
    out = corpus_pipeline.run(spark, base)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "tokens", "n_tokens", "round_trip"]
    assert out.select("doc_id").distinct().count() > 300
    assert out.where("not round_trip").count() == 0
