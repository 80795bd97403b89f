import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = public.path(request.param)
    ranks = bpe.read_ranks(path)
    oracle = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.SpeculativeBpe(ranks), oracle, path


ODD = ["a²b ½ c\x1cd'll I've ÀÉ́x ٣٤ 漢字    x  \n\n y\t", "", "   ", "'s 's's", "🙂🙂 x_y __z", "ⅷ Ⅷ x", "á\x85e f", "<|endoftext|>"]


def test_matches_exact_merging(pair):
    mine, oracle, _ = pair
    for text in ODD:
        assert mine.encode([text])[0].tolist() == oracle.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(text):
    ranks = _ranks()
    mine, oracle = ranks
    ids, counts = mine.encode([text])
    assert ids.tolist() == oracle.encode_ordinary(text)
    assert mine.decode(ids, counts) == [text.encode()]


_HELD = []


def _ranks():
    if not _HELD:
        ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
        _HELD.extend([bpe.SpeculativeBpe(ranks), tiktoken.Encoding("o", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _HELD


def test_failing_words_are_merged(pair):
    """Some words must fail the check of pairs, else the exact path isn't exercised."""
    mine, oracle, _ = pair
    rng = random.Random(3)
    words = ["".join(rng.choice(["the", "tion", "ou", "er", "wh", "ing", "é"]) for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    before = mine.counts["merged"]
    assert [mine.encode([w])[0].tolist() for w in words] == [oracle.encode_ordinary(w) for w in words]
    assert mine.counts["merged"] > before


def test_rows(spark, pair):
    _, oracle, path = pair
    long = "the quick étion " * 20000
    rows = [(1, "hello world", 5), (2, None, 6), (3, "", 7), (None, long, None), (1, "hello world", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = bpe.bpe_encode(docs, path)
    assert got.columns == ["doc_id", "n_tokens", "tokens", "n_tokens_1", "round_trip"]
    out = sorted(got.collect(), key=lambda r: (r.doc_id or 0, r.n_tokens or 0))
    by = {(r.doc_id, r.n_tokens): r for r in out}
    assert len(out) == 5
    assert by[2, 6].tokens is None and by[2, 6].n_tokens_1 is None and by[2, 6].round_trip is None
    assert by[3, 7].tokens == [] and by[3, 7].n_tokens_1 == 0 and by[3, 7].round_trip
    assert by[None, None].tokens == oracle.encode_ordinary(long)
    assert all(r.round_trip for r in out if r.tokens is not None)
    decoded = bpe.bpe_decode(got, path)
    assert {(r.doc_id, r.text) for r in decoded.collect()} == {(a, b) for a, b, _ in rows}
    assert bpe.bpe_encode(docs.limit(0), path).count() == 0


def test_very_long_words(pair):
    """A word of a million letters takes seconds; the heap gives what plain merging gives."""
    mine, oracle, _ = pair
    rng = random.Random(4)
    letters = "".join(rng.choices("aeinrstou", k=3000))
    assert mine.encode([letters])[0].tolist() == oracle.encode_ordinary(letters)
    for n in (65, 70, 200, 333):
        word = "".join(rng.choices("abth", k=n)).encode()
        parts = [word[i : i + 1] for i in range(n)]
        while True:
            ranked = [(mine.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in mine.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merged(word, mine.ranks) == [mine.ranks[p] for p in parts]
    start = time.perf_counter()
    many = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    ids, counts = mine.encode([many])
    assert mine.decode(ids, counts) == [many.encode()] and time.perf_counter() - start < 60


def test_pairs_are_forgotten(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER_PAIRS", 5)
    mine, oracle, _ = pair
    text = "speculatively unbelievable tokenisations of antidisestablishmentarian wordings"
    for cut in (text, text[::-1], text.upper()):
        assert mine.encode([cut])[0].tolist() == oracle.encode_ordinary(cut)
    assert len(mine.pairs) < 200
