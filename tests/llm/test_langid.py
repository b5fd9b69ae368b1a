import random
import zlib

import numpy as np

from evalloop.llm import langid, queries


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_languages(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) >= 0.98


def texts(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


def model(rng):
    docs = {"aa": texts(rng, "abcde", 4000), "bb": texts(rng, "cdefg", 4000), "cc": texts(rng, "xyz", 4000)}
    counts = np.zeros((langid.SLOTS, 3))
    for k, t in enumerate(docs.values()):
        for w in langid.words(t):
            for s in langid.gram_slots(w, langid.GRAMS, langid.SLOTS):
                counts[s, k] += 1
    return langid.Languages(list(docs), counts)


def test_proportions_of_mixed_documents():
    rng = random.Random(3)
    own = model(rng)
    cases = [("abcde", 100, "xyz", 0, 0, 1.0), ("abcde", 60, "xyz", 40, 0, 0.6), ("cdefg", 30, "xyz", 70, 2, 0.7), ("xyz", 1, "abcde", 0, 2, 1.0)]
    docs = []
    for a, n, b, m, _, _ in cases:
        logs = [own.word_logs(w) for w in langid.words(texts(rng, a, n) + " " + texts(rng, b, m))]
        docs.append((np.array(logs), np.ones(len(logs))))
    best, share = own.mixtures(docs)
    assert best.tolist() == [c[4] for c in cases]
    assert np.allclose(share, [c[5] for c in cases], atol=0.08)
    alone = [own.mixtures([d]) for d in docs]  # a batch changes nothing
    assert [int(b[0]) for b, _ in alone] == best.tolist() and np.allclose([s[0] for _, s in alone], share)


def test_steps_never_lower_the_likelihood(monkeypatch):
    rng = random.Random(5)
    own = model(rng)
    logs = np.array([own.word_logs(w) for w in langid.words(texts(rng, "abcdefg", 50))])
    def fit(steps):
        share = np.full(3, 1 / 3)
        for _ in range(steps):
            joint = share * np.exp(logs)
            share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        return np.log((share * np.exp(logs)).sum(axis=1)).sum(), share
    values = [fit(k)[0] for k in range(15)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


LETTERS = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]


def test_a_document_of_six_languages(spark, documents):
    """Six learned languages: a document of six, of five and of one; the set and the proportions are returned."""
    rng = random.Random(7)
    names = [f"l{k}" for k in range(6)]
    rows = [(k, texts(rng, LETTERS[k % 6], 60), names[k % 6], "s", 0) for k in range(240)]
    rows.append((1000, " ".join(texts(rng, x, 50) for x in LETTERS), None, "s", 0))
    rows.append((1001, " ".join(texts(rng, x, 20 + 10 * k) for k, x in enumerate(LETTERS[:5])), None, "s", 0))
    rows.append((1002, texts(rng, LETTERS[3], 50), None, "s", 0))
    got = {r.doc_id: r for r in langid.languages(documents(rows)).collect()}
    assert set(got[1000].languages) == set(names) and np.allclose(got[1000].shares, 1 / 6, atol=0.03)
    assert got[1001].languages == names[4::-1] and np.allclose(got[1001].shares, [0.3, 0.25, 0.2, 0.15, 0.1], atol=0.03)
    assert got[1002].languages == ["l3"] and got[1002].shares == [1.0] and got[1002].lang_pred == "l3"
    assert all(got[k].languages == [names[k % 6]] for k in range(240))


def test_the_chosen_set_equals_a_search_without_bound():
    """Every k tried on its own, document by document."""
    rng = random.Random(11)
    own = model(rng)
    docs = []
    for _ in range(60):
        text = " ".join(texts(rng, x, rng.randint(0, 12)) for x in ("abcde", "cdefg", "xyz")) + " a"
        logs = np.array([own.word_logs(w) for w in langid.words(text)])
        docs.append((logs, np.ones(len(logs))))
    best, share, chosen = own.sets(docs)
    sizes = set()
    for d, b, c in zip(docs, best, chosen):
        n = [len(d[1])]
        whole, _ = own._steps(*d, np.array(n), np.ones((1, 3)))
        order = np.argsort(-whole[0], kind="stable")
        tried = [(d[0].sum(axis=0).max(), np.eye(3)[d[0].sum(axis=0).argmax()])]
        for k in (2, 3):
            allowed = np.isin(np.arange(3), order[:k]).astype(float)[None]
            s, fit = own._steps(*d, np.array(n), allowed)
            tried.append((fit[0] - 0.5 * (k - 1) * np.log(n[0] + 1), s[0]))
        top = max(tried, key=lambda t: t[0])[1]
        assert np.allclose(top, c) and top.argmax() == b
        sizes.add(int((c > 0).sum()))
    assert sizes == {1, 2, 3}


def test_rows_of_a_repeated_id_are_bounded(spark, documents):
    """A third of the rows repeat one labelled id, another third one text; every language keeps a sample."""
    rng = random.Random(13)
    rows = [(7, texts(rng, "abcde", 5), "aa", "s", 0) for _ in range(2000)]
    rows += [(k + 100, "same words again", "aa", "s", 0) for k in range(2000)]
    rows += [(k + 9000, texts(rng, "xyz", 5), "bb", "s", 0) for k in range(2000)]
    df = documents(rows)
    drawn = langid.sample(df, "doc_id", "text", "lang", 200).collect()
    assert len({(r.lang, r.text) for r in drawn}) == len(drawn)
    for lang in ("aa", "bb"):
        assert 130 <= sum(r.lang == lang for r in drawn) <= 270
    again = langid.sample(df.repartition(5), "doc_id", "text", "lang", 200).collect()
    assert sorted(r.text for r in again) == sorted(r.text for r in drawn)


def test_odd_rows(spark, odd, documents):
    rows = {r.doc_id: r for r in langid.languages(odd).collect()}
    assert {rows[k].lang_pred for k in (1, 2, 3, 8)} == {"und"} and rows[1].score == 0
    assert rows[4].lang_pred != "und"
    assert langid.languages(odd).count() == odd.count()
    assert langid.languages(odd.limit(0)).count() == 0
    unknown = documents([(k, "some words", None, None, 0) for k in range(20)])
    assert {r.lang_pred for r in langid.languages(unknown).collect()} == {"und"}
    digits = documents([(k, t, "xx", None, 0) for k, t in enumerate(["½ ² 12", "a", "中", "ab cd"])])
    assert {r.doc_id: r.lang_pred for r in langid.languages(digits).collect()}[0] == "und"
