"""Collocations: equal to counting every phrase, whatever the size of the table of pairs and the number of rounds."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from evalloop.llm import collocations as co

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, best=co.BEST, least=co.LEAST):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, 5):
                own.update(w[i:i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * own[p[i:i + k]]:
                        gone.add(p[i:i + k])
        found = []
        for p, a in cands.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:best])]
    return sorted(out)


def check(spark, documents, rows, clash=(), **kw):
    docs = documents([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(rows)], clash)
    assert sorted(tuple(r) for r in co.mine(docs, **kw).collect()) == brute(rows, kw.get("best", co.BEST), kw.get("least", co.LEAST))


def corpus(seed, docs=150, words=25):
    rng = random.Random(seed)
    stock = [f"w{k}" for k in range(words)] + ["Été", "x" * 40]
    passages = [" ".join(rng.choices(stock, k=12)) for _ in range(4)]
    def text():
        out = []
        for _ in range(rng.randint(0, 30)):
            out.append(rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choices(stock, weights=[1 / (k + 1) for k in range(len(stock))], k=6)))
        return rng.choice([". ", "\n", "  ", "\t", ";"]).join(out)
    return [(rng.choice(["en", "fr", None, "und"]), text()) for _ in range(docs)]


@pytest.mark.parametrize("seed,best,bits", [(1, 2000, 16), (2, 3, 16), (3, 5, 4), (4, 40, 12)])
def test_equal_to_brute_force(spark, documents, seed, best, bits):
    check(spark, documents, corpus(seed), best=best, cell_bits=bits)


def test_small_windows_and_parts_of_runs(spark, documents, monkeypatch):
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choices("abc", k=400))), ("en", "a b c a b " * 60), ("fr", "la la la la " * 30)]
    check(spark, documents, rows, cell_bits=10)
    got = list(co._windows(np.frombuffer(b"ab cd. ef\nghijkl mnop qrst. u", np.uint8), 4))
    assert b"".join(x.tobytes() for x in got) == b"ab cd. ef\nghijkl mnop qrst. u"
    assert all(x.tobytes()[-1:] in b".\nu" for x in got)


def test_odd_rows(spark, documents):
    rows = [(None, None), ("en", ""), ("en", " \t\n.,"), ("en", "one"), ("xx", "A b. " * 30), ("und", "É É " * 20), (None, "É É " * 20),
            ("en", "word " * 30_000 + "x" * 50_000), ("xx", "a b c\x00 " * 31)]
    check(spark, documents, rows, clash=["a", "n", "phrase", "run", "score", "chunk", "k", "l"], cell_bits=12)
    assert co.mine(documents([]), cell_bits=8).collect() == []
    assert co.mine(documents([(1, "no pair twice", "en", "s", 0)]), cell_bits=8).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 1 << 61
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1)], "lang string, phrase string, a bigint")
    two = spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, a bigint")
    assert co.scored(two, 2, one).first()["score"] == 2_000_000 * (big - 7) // (2 * big - 1)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in co.mine(docs, best=50).collect()) == brute(rows, 50)
