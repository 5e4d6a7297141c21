"""Words and shingles of whole batches, and the work that near-duplicates need, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from inkwell.llm import near_dup as N
from inkwell.llm import shingles as S


@pytest.fixture(autouse=True)
def wrapping():
    with np.errstate(over="ignore"):
        yield


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    alphabet = "abAB09 .\n-\x00\x7f_éßÀ漢字\U0001f600İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    long = "x" * (S.BLOCK + 5)
    return [*texts, None, "", "...", "one", "One two", "é" * 70, "É" * 70, long, long + "y Z", "a " * S.BLOCK, "word"]


def by_text(values: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    return [values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_word_hashes_of_a_batch():
    texts = odd_texts()
    got = by_text(*S.word_hashes(texts))
    want = [S.words(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    pairs = {(w, g) for ws, gs in zip(want, got) for w, g in zip(ws, gs)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({g for _, g in pairs})  # one hash a word, one word a hash
    assert by_text(*S.word_hashes([])) == [] and by_text(*S.word_hashes([None, ""])) == [[], []]
    assert [by_text(*S.word_hashes([t]))[0] for t in texts] == got  # whatever the other texts are


def test_weighted_shingles_of_a_batch():
    texts = odd_texts()
    seen = {}
    for text, (element, weight) in zip(texts, S.weighted(texts, 5)):
        w = S.words(text)
        n = Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))
        assert len(element) == len(n) and list(element) == sorted(element)
        assert sorted(weight) == pytest.approx(sorted(1 + math.log(c) for c in n.values()))
        if len(n) == 1:
            assert seen.setdefault(next(iter(n)), element[0]) == element[0]
    assert len(set(seen.values())) == len(seen)


def test_sketch_draws_several_times_at_once(monkeypatch):
    """The registers are those of single draws, and a text of one word takes few rounds (it needs about 700 draws)."""
    rng = np.random.default_rng(3)
    size = np.array([1, 2, 0, 5, 300, 1])
    owner = np.repeat(np.arange(len(size)), size)
    element, weight = rng.integers(0, 2**63, len(owner), dtype=np.uint64), rng.uniform(1, 4, len(owner))
    rounds = Counter()
    monkeypatch.setattr(N, "mix", lambda x: (rounds.update(["mix"]), S.mix(x))[1])
    got = N.sketch(owner, element, weight, len(size), 128)
    assert rounds["mix"] < 150
    monkeypatch.setattr(N, "DRAWS", 1)
    assert (N.sketch(owner, element, weight, len(size), 128) == got).all()
    assert not got[2].any() and got[[0, 1, 3, 4, 5]].all()


def members(texts: list[str], tiles: int = 1) -> pd.DataFrame:
    n = len(texts)
    return pd.DataFrame({"band": 1, "doc_id": range(n), "root": range(n), "tile": [i % tiles for i in range(n)], "first": 0, "second": tiles - 1, "text": texts})


def classes(links: pd.DataFrame, n: int) -> list[int]:
    root = list(range(n))
    for a, b in zip(links["a"], links["b"]):
        root = [root[b] if r == root[a] else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize("tiles", [1, 2])
def test_members_of_a_bucket_against_brute_force(tiles):
    rng = random.Random(11)
    base = [[f"t{t}w{i}" for i in range(60)] for t in range(4)]
    texts = []
    for i in range(120):
        w = list(base[i // 2 % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w + w[: rng.choice([0, 0, 20, 60])] * rng.choice([1, 2, 9])))
    texts += ["lone words of its own", "", "two"]
    sets = S.weighted(texts, 5)
    want, n_weighted = [], 0
    for i in range(len(texts)):
        for j in range(i):
            plain, weighted = S.similarity(sets[i], sets[j])
            assert S.alike(sets[i], sets[j], 0.8) == (max(plain, weighted) >= 0.8)
            if max(plain, weighted) >= 0.8 and (tiles == 1 or i % tiles != j % tiles):
                want.append((i, j))
                n_weighted += plain < 0.8
    got = N._across(5, 0.8)(members(texts, tiles))
    assert n_weighted > 20 and set(zip(got["a"], got["b"])) <= set(want)
    assert classes(got, len(texts)) == classes(pd.DataFrame(want, columns=["a", "b"]), len(texts))


def test_unlinked_members_of_a_bucket_are_told_apart_by_a_bound(monkeypatch):
    # Texts that have 0.88 of their shingles in common are 0.78 alike; the exact probability Jaccard isn't made for each pair.
    texts = [" ".join([f"t{j}" for j in range(500)] + [f"o{i}y{j}" for j in range(70)] + ["again"] * 20) for i in range(60)]
    asked = Counter()
    monkeypatch.setattr(N, "similarity", lambda a, b: (asked.update(["pair"]), S.similarity(a, b))[1])
    assert N._across(5, 0.8)(members(texts)).empty
    assert asked["pair"] == 0


def test_null_text_of_a_repeated_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text + " more"), (2, None), (3, None), (4, text + " else")]
    got = {r.doc_id: r.class_id for r in N.near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
