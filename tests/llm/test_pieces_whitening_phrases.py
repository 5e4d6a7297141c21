"""Sentence pieces, tiled whitening and phrase collocations against the library and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import phrases as P
from inkwell.llm import whitening as W
from inkwell.llm.pieces import Pieces, encoded, fingerprints
from inkwell.llm.queries import piece_file

ODD = [
    None, "", " ", "   ", "a", " a  b ", "\n", "a\n\nb\t", "x▁y", "<0x0A></s><unk>", "\x00", "ﬁ á é", "😀 \U000e0041x", "中文没有空格的一段话", "日本語 テキスト",
    "the the the", "word " * 300, "ab" * 20_000, "中文字日本abcdef" * 3_000, " " * 700, "\xa0　​",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


@pytest.fixture(scope="module")
def pieces():
    return Pieces(piece_file())


def test_pieces_are_the_library_s(library, pieces):
    rng = random.Random(7)
    signs = "abcdeéŕ 123 \n\t▁  ()<0x></s>中文字日本　\x00😀'\"ing the "
    some = [p.replace("▁", " ") for p in pieces.piece]
    texts = [t or "" for t in ODD]
    for _ in range(1500):
        texts.append("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))))
        texts.append("".join(rng.choice(some) for _ in range(rng.randint(0, 12))))
        texts.append("".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 9))))
    for text, ids in zip(texts, library.encode(texts)):
        assert pieces.encode(text) == ids
        assert pieces.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids(library, pieces):
    rng = random.Random(8)
    for _ in range(800):
        ids = [rng.randrange(32_000) for _ in range(rng.randint(0, 8))] + [rng.randrange(0, 259) for _ in range(rng.randint(0, 6))]
        rng.shuffle(ids)
        assert pieces.decode(ids) == library.decode(ids)


def test_pairs_and_prefixes(pieces):
    """The last piece of every prefix is the last piece of the prefix's own encoding."""
    word = "▁internationally"
    for end in range(1, len(word) + 1):
        assert pieces._encoded(word[:end])[-1] == pieces._encoded(word)[-1] or end < len(word)
    a, b = pieces.number["▁in"], pieces.number["ter"]
    assert pieces.holds(a, b) == (pieces._encoded("▁inter") == [a, b])


def test_remembered_stretches_are_dropped(pieces, monkeypatch):
    from inkwell.llm import pieces as module

    monkeypatch.setattr(module, "REMEMBERED", 3)
    monkeypatch.setattr(module, "PAIRS", 5)
    small, text = Pieces(piece_file()), "one two three four five six seven one two"
    assert [small.entry(s)[1] for s in small.stretches(text)] == [pieces.entry(s)[1] for s in pieces.stretches(text)]
    assert len(small.known) <= 4


def test_fingerprints(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "again", "x"), (3, "again", "x"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((tuple(r) for r in fingerprints(docs, piece_file()).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = encoded(docs.where("doc_id = 8"), piece_file()).head()
    assert whole["ids"] == library.encode("x▁y") and whole["decoded"] == "x y"
    assert fingerprints(docs.limit(0), piece_file()).count() == 0


def by_hand(vectors: list[list[float]]):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    centred = x - x.mean(0)
    v = centred.T @ centred / len(x)
    return x, v


def test_whitening(spark):
    rng = np.random.default_rng(3)
    data = [[float(c) for c in r] for r in rng.normal(size=(500, 40)) @ np.diag(np.linspace(0.3, 3, 40))]
    odd = [(900, None), (901, [1.0] * 39 + [None]), (902, [1.0] * 39 + [float("nan")]), (903, [1.0] * 39 + [float("inf")]), (904, []), (905, [1.0, 2.0]), (None, data[0]), (7, data[7])]
    rows = list(enumerate(data)) + odd
    taken = data + [data[0], data[7]]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, component int").repartition(5)
    got = W.whiten(table, block=64, tile=7).toPandas()
    x, v = by_hand(taken)
    n = len(x)
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].iloc[0] < 1e-9
    one = got[got["vec_id"] == 5].sort_values("component")
    assert np.allclose(one["explained"], e[:32] / np.trace(v), rtol=1e-9)
    s = [int(t) for t in x.sum(0)]
    assert one["deviation"].iloc[0] == sum((n * int(t) - m) ** 2 for t, m in zip(x[5], s))
    # every component is an eigenvector: its coordinates over all rows give it back
    plain = got[(got["vec_id"] != 7) & got["vec_id"].notna() & (got["vec_id"] != 0)]
    for k in (1, 2, 32):
        w = plain[plain["component"] == k].sort_values("vec_id")
        u, *_ = np.linalg.lstsq((x - x.mean(0))[w["vec_id"].astype(int)], w["whitened"] * np.sqrt(e[k - 1]), rcond=None)
        assert np.allclose(v @ u, e[k - 1] * u, atol=1e-7 * e[0]) and abs(np.linalg.norm(u) - 1) < 1e-9
    assert W.whiten(table.limit(0)).count() == 0


def test_whitening_of_few_rows_and_wide_values(spark):
    """Fewer rows than dimensions: components without variance are left out. Large values stay exact."""
    rng = np.random.default_rng(4)
    few = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=9)]) for i in range(4)], "vec_id long, embedding array<double>")
    got = W.whiten(few).toPandas()
    assert set(got["component"]) == {1, 2, 3} and got["identity_error"].max() < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert W.whiten(same).count() == 0
    wide = [[1e7, 0.5], [-1e7, 0.25], [3e6, -1.0]]
    got = W.whiten(spark.createDataFrame(list(enumerate(wide)), "vec_id long, embedding array<double>")).toPandas()
    x, _ = by_hand(wide)
    s = [int(t) for t in x.sum(0)]
    assert {r.vec_id: r.deviation for r in got.itertuples()} == {i: sum((3 * int(t) - m) ** 2 for t, m in zip(x[i], s)) for i in range(3)}


def test_covariance_in_tiles(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(-500, 500, size=(333, 11)) + 1_000_000
    rows = spark.createDataFrame([([int(c) for c in r],) for r in data], "x array<long>").repartition(4)
    centred = data - data.mean(0)
    for tile, block in ((3, 50), (11, 1000), (64, 7)):
        got = W.covariance(rows, "x", len(data), [int(s) for s in data.sum(0)], tile, block)
        assert np.allclose(got, centred.T @ centred / len(data), rtol=1e-12, atol=1e-9)


def brute(docs, max_n, least, inside, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        rows = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in c.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("chunk", [200, 6_000_000])
def test_phrases(spark, monkeypatch, chunk):
    rng = random.Random(9)
    words = ["a", "B", "cc", "dé", "É", "x\xa0y", "中文", "...", "q-r", "e", "f", "g"]
    docs = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60)))) for _ in range(250)]
    docs += [("en", None), (None, None), ("en", ""), ("en", " . ,\n"), ("fr", "n y " * 900), ("de", "New York City hall " * 40), ("de", "New York City hall " * 40)]
    table = spark.createDataFrame([(i, lang, t, 5) for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string, f int").repartition(4)
    monkeypatch.setattr(P, "CHUNK", chunk)
    for max_n, least, top in ((4, 8, 2000), (3, 2, 25)):
        want = brute(docs, max_n, least, 80, top)
        got = sorted(tuple(r) for r in P.phrases(table, max_n, least, 80, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == want and len(want) > 20
    whole = P.phrases(table, 4, 8, pruned=False).collect()
    assert sorted(tuple(r) for r in whole) == sorted(tuple(r) for r in P.phrases(table, 4, 8).collect())
    assert P.phrases(table.limit(0)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    """2,000,000 times a count of 10^13 leaves 64 bits."""
    known = spark.createDataFrame([("en", 1, "a", 3 * 10**13), ("en", 1, "b", 2 * 10**13 + 1), ("en", 2, "a b", 10**13)], "lang string, n_words int, phrase string, f long")
    total = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    keep, P.counts = P.counts, lambda *a: (known, total)
    try:
        row = P.phrases(known.select("lang", F.lit("").alias("text"))).head()
    finally:
        P.counts = keep
    assert row["score"] == 2_000_000 * 10**13 // (5 * 10**13 + 1)
