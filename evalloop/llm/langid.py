"""Languages of multilingual documents: a mixture of language models, fitted per document by EM.

A language model is a distribution over hashed character trigrams of words.  A document's words are taken as drawn
from a mixture of languages; expectation-maximisation estimates the proportions.  The sets of the k most probable
languages, for every k up to all that were learned, compete by their likelihood less a penalty for each language more
(half the logarithm of the number of words); the largest proportion of the chosen set is the prediction.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import cut_lineage, held_out, prepare, small_side
from evalloop.llm.terms import Remembered, gram_slots, words

#: Distinct texts of a language that its model is learned from, about and in the mean.
SAMPLE = 3_000
SLOTS, GRAMS, SMOOTHING = 1 << 16, (3,), 0.5
STEPS = 12
#: Documents that take their steps together.
TOGETHER = 64


def _word(word: str) -> bool:
    return any(map(str.isalpha, word))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """A stored table of ``text`` and ``lang``: distinct texts whose hash is below the share that gives ``most`` a language.

    The share comes from the number of distinct texts of a language, estimated by a sketch that is merged on the map
    side: however many rows repeat one id or one text, the sample is bounded and every language has one.
    Of the texts only those drawn are shuffled, one row of each per map task.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.xxhash64(F.col(text_col), F.lit(13)).alias("draw"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = cut_lineage(rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n"), F.min("draw").alias("first")).select(
        F.col("lang").alias("of"), (most / F.col("n")).alias("share"), "first"), "lang-sizes")
    drawn = ((F.shiftrightunsigned("draw", 11) / float(1 << 53)) <= F.col("share")) | (F.col("draw") == F.col("first"))
    return cut_lineage(rows.join(small_side(sizes), F.col("lang") == F.col("of")).filter(drawn).groupBy("lang", "draw").agg(
        F.first("text").alias("text")).select("lang", "text"), "lang-sample")


class Languages:
    """Names and log-probabilities of trigram slots by language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=0)) if names else counts

    def word_logs(self, word: str) -> np.ndarray | None:
        """Log-likelihood of a word under each language, None if it has no letter."""
        return self.logs[gram_slots(word, GRAMS, SLOTS)].sum(axis=0) if _word(word) else None

    def mixtures(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The best language of the chosen set and its proportion in the mixture of all, for documents as in ``sets``."""
        best, share, _ = self.sets(docs)
        return best, share

    def sets(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``mixtures``, and the proportions in the chosen set (documents x languages, 0 outside the set).

        Documents are given as (word logs, counts), none empty.  The sets are the k languages with the largest
        proportions in the mixture of all, for every k.  By concavity the likelihood of any set is at most that of the mixture
        of all plus N log max_j g_j (N words, g_j the mean of p_j(w) / p(w)): a document leaves the search
        when this bound less the penalty of k no longer exceeds its best score, so nothing that could win is left out.
        All documents of a batch take their steps together.
        """
        logs = np.concatenate([d[0] for d in docs])
        counts = np.concatenate([d[1] for d in docs])
        lengths = np.array([len(d[1]) for d in docs])
        starts = np.cumsum(lengths) - lengths
        many = len(self.names)
        whole, full = self._steps(logs, counts, lengths, np.ones((len(docs), many)))
        words_of = np.add.reduceat(counts, starts)
        each = 0.5 * np.log(words_of + 1)
        most = full + words_of * np.log(np.maximum(self._slack(logs, counts, lengths, whole), 1.0)) + 1e-6
        single = np.add.reduceat(counts[:, None] * logs, starts)
        score, best = single.max(axis=1), single.argmax(axis=1)
        chosen = np.zeros((len(docs), many))
        chosen[np.arange(len(docs)), best] = 1.0
        rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1)
        doc = np.repeat(np.arange(len(docs)), lengths)
        going = np.arange(len(docs))
        for k in range(2, many + 1):
            going = going[most[going] - (k - 1) * each[going] > score[going]]
            if not len(going):
                break
            some = np.isin(doc, going)
            share, fit = (whole[going], full[going]) if k == many else self._steps(
                logs[some], counts[some], lengths[going], (rank[going] < k).astype(float))
            fit = fit - (k - 1) * each[going]
            won = fit > score[going]
            at = going[won]
            score[at], best[at], chosen[at] = fit[won], share[won].argmax(axis=1), share[won]
        return best, np.clip(whole[np.arange(len(docs)), best], 0.0, 1.0), chosen

    @staticmethod
    def _slack(logs: np.ndarray, counts: np.ndarray, lengths: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The largest mean of p_j(w) / p(w) over the words of each document: 1 where the mixture cannot gain."""
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        like = np.exp(logs - logs.max(axis=1)[:, None])
        ratio = like * (counts / np.maximum((share[doc] * like).sum(axis=1), 1e-300))[:, None]
        return (np.add.reduceat(ratio, starts) / np.add.reduceat(counts, starts)[:, None]).max(axis=1)

    @staticmethod
    def _steps(logs: np.ndarray, counts: np.ndarray, lengths: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the allowed languages after the steps of EM, and the log-likelihood under them."""
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        sizes = np.add.reduceat(counts, starts)
        top = logs.max(axis=1)
        like = np.exp(logs - top[:, None])
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            joint = share[doc] * like
            joint *= (counts / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            share = np.add.reduceat(joint, starts) / sizes[:, None]
        total = np.maximum((share[doc] * like).sum(axis=1), 1e-300)
        return share, np.add.reduceat(counts * (top + np.log(total)), starts)


class KnownWords:
    """Word logs of one worker, by place; forgotten between batches when there are more than ``most``."""

    def __init__(self, languages: Languages, most: int = 300_000):
        self.languages, self.most = languages, most
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, len(languages.names)))

    def learn(self, words_of_batch: set[str]) -> None:
        """Adds the new words of a batch: their slots are summed together.  A word without a letter has place -1."""
        if len(self.place) > self.most:
            self.place.clear()
            self.logs = self.logs[:0]
        new = [w for w in words_of_batch if w not in self.place]
        self.place.update((w, -1) for w in new)
        new = [w for w in new if _word(w)]
        if new:
            slots = [gram_slots(w, GRAMS, SLOTS) for w in new]
            starts = np.cumsum([0, *map(len, slots[:-1])])
            sums = np.add.reduceat(self.languages.logs[[s for row in slots for s in row]], starts)
            self.place.update(zip(new, range(len(self.logs), len(self.logs) + len(new))))
            self.logs = np.concatenate([self.logs, sums])

    def of(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Word logs and counts of a document."""
        at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        return (self.logs[at], n) if (at >= 0).all() else (self.logs[at[at >= 0]], n[at >= 0])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> Languages:
    """Trigram counts by language, summed by Spark; languages times ``SLOTS`` numbers at most reach the driver.

    The model takes 0.5 MB a language in the driver and in each worker: ``lang`` is to hold languages, not free text.
    """
    prepare(docs.sparkSession)
    texts = sample(docs, id_col, text_col, lang_col, most)

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        known = Remembered(lambda w: np.array(gram_slots(w, GRAMS, SLOTS) if _word(w) else [], np.int64), 50_000)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = [known[w] for w in words(text)]
                if found:
                    own = seen.setdefault(lang, np.zeros(SLOTS, np.int64))
                    own += np.bincount(np.concatenate(found), minlength=SLOTS)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                                             names=["lang", "slot", "n"])

    rows = texts.mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in rows})
    counts = np.zeros((SLOTS, len(names)))
    for r in rows:
        counts[r["slot"], names.index(r["lang"])] = r["n"]
    return Languages(names, counts)


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred``, ``score``, ``languages``, ``shares`` of every row: one pass over whole texts, no shuffle.

    ``score`` is the proportion of the predicted language in the mixture of all; ``languages`` is the chosen set, the
    largest proportion first (ties by name), and ``shares`` its proportions.  Null texts and texts without a letter
    are ``und`` with score 0 and an empty set, as is everything if no language was learned; ids may be null or
    repeat; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = ids.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        own = shared.value
        known = KnownWords(own)
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            found, shares = [[] for _ in names], [[] for _ in names]
            counts = [Counter(words(t)) for t in batch.column("text").to_pylist()] if own.names else []
            for first in range(0, len(counts), TOGETHER):
                some = counts[first:first + TOGETHER]
                known.learn(set().union(*some))
                held = [(first + k, x) for k, x in enumerate(map(known.of, some)) if len(x[1])]
                if held:
                    best, share, chosen = own.sets([x for _, x in held])
                    for (k, _), b, s, c in zip(held, best.tolist(), share.tolist(), chosen):
                        names[k], scores[k] = own.names[b], s
                        order = [j for j in np.argsort(-c, kind="stable").tolist() if c[j] > 0]
                        found[k], shares[k] = [own.names[j] for j in order], c[order].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(found, pa.list_(pa.string())),
                 pa.array(shares, pa.list_(pa.float64()))], names=["_id", "lang_pred", "score", "languages", "shares"])

    found = ids.mapInArrow(run, f"_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>")
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", "score", "languages", "shares")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
