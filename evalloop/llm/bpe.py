"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For each prefix of a piece of text exactly one token can be the last of its encoding: a token that ends the
prefix (found by the automaton over the vocabulary, whose suffix links list all tokens that end at a
position) and that the last token of the remaining prefix tolerates on its right.  Two neighbours
tolerate each other when merging their joint text again yields just these two tokens, which only the merges
across their border can prevent.  The last tokens are stored for every prefix; following them back from
the end gives the ids.  The work is linear in the length of a piece, also for texts without any blank.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloop.llm.common import prepare

#: Pieces whose ids a worker remembers, in each of two generations.
REMEMBERED = 200_000
#: Longer pieces are encoded anew each time, which bounds the memory of what is remembered.
LONGEST_REMEMBERED = 64
#: Pairs of neighbours whose test a worker remembers.
REMEMBERED_PAIRS = 400_000

# White space as Unicode defines it, and the piece pattern of the vocabulary.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"

#: The pattern over texts of ASCII and Latin-1 alone, where the letters and numbers are few enough to be named.
_LETTER, _NUMBER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_LATIN = re.compile(f"{SUFFIXES}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{SPACE}{_LETTER}{_NUMBER}]+"
                    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_ANY = regex.compile(f"{SUFFIXES}| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+"
                     f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_BEYOND_LATIN = re.compile("[^\\x00-\\xff]")

_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves; the other bytes take U+0100 and up in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(0x100 + k)
    return [letters[b] for b in range(256)]


class Pieces(dict):
    """Ids of pieces as decimal text, encoded when first met; two generations bound its size."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.encode(piece)))
            if len(piece) > LONGEST_REMEMBERED:
                return ids
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.letters = [letters[b] for b in range(256)]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.octets = {i: bytes(byte_of[c] for c in w) for w, i in vocab.items()
                       if w not in self.special}
        self.octets.update({i: w.encode() for w, i in self.special.items()})
        self.by_text = {str(i): b for i, b in self.octets.items()}
        #: rank of a merge by its two halves; of a token, the rank that makes it and its halves
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {i: -1 for i in self.octets}
        self.halves: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = k
            if made not in self.halves:
                self.halves[made], self.born[made] = pair, k
        self._tolerated: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            if word not in self.special and (i in self.halves or len(word) == 1):
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.pieces = Pieces(self.encode_piece)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _stable(self, a: int, b: int, until_a: int, until_b: int) -> bool:
        """No merge across the border of neighbours ``a``, ``b`` comes before those that make them.

        Both borders are unwound in reverse order of their making; a merge across the border wins over one
        further right at equal rank, and loses against one further left.
        """
        rank, born, halves = self.rank, self.born, self.halves
        while True:
            across = rank.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                return False
            if born[a] > born[b]:
                until_a, a = born[a], halves[a][1]
            elif born[b] >= 0:
                until_b, b = born[b], halves[b][0]
            else:
                return True

    def tolerates(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._tolerated.get(key)
        if known is None:
            if len(self._tolerated) >= REMEMBERED_PAIRS:
                self._tolerated.clear()
            known = self._tolerated[key] = self._stable(a, b, _NEVER, _NEVER)
        return known

    def sound(self, token: int) -> bool:
        """Merging the token's own text yields the token."""
        known = self._sound.get(token)
        if known is None:
            known = True
            if token in self.halves:
                (a, b), made = self.halves[token], self.born[token]
                known = self.sound(a) and self.sound(b) and self._stable(a, b, made, made)
            self._sound[token] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece: the unique last token of every prefix, then back from the end."""
        word = piece.encode().decode("latin-1").translate(self.table)
        size = len(word)
        last, length = [-1] * (size + 1), [0] * (size + 1)
        tolerated, tolerates = self._tolerated.get, self.tolerates
        for end, (token, n) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            if n == end:
                fits = self.sound(token)
            else:
                before = last[end - n]
                if before < 0:
                    continue
                fits = tolerated(before << 20 | token)
                if fits is None:
                    fits = tolerates(before, token)
                fits = fits and self.sound(token)
            if fits:
                last[end], length[end] = token, n
        ids, at = [], size
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def encode_text(self, text: str | None) -> str:
        """The ids of a text in decimal, joined by commas; empty for a null or empty text."""
        if not text:
            return ""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(str(self.special[part]))
            elif part:
                found = (_ANY if _BEYOND_LATIN.search(part) else _LATIN).findall(part)
                out.append(",".join(map(self.pieces.__getitem__, found)))
        return ",".join(out)

    def encode(self, text: str | None) -> list[int]:
        ids = self.encode_text(text)
        return [int(x) for x in ids.split(",")] if ids else []

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.octets.__getitem__, ids)).decode("utf-8", "replace")

    def decode_text(self, ids: str) -> str:
        """``decode`` of ids in decimal, joined by commas."""
        return b"".join(map(self.by_text.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@lru_cache(maxsize=4)
def codec(text: str) -> Codec:
    """The codec of a vocabulary given as JSON text; a worker builds it once."""
    return Codec(json.loads(text))


def _spec(path: str) -> str:
    """Vocabulary files are small and lie with the driver; the tasks get their text."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(_spec(path))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids (array<int>) of ``text_col``; null and empty texts have none.

    ``path``: the vocabulary file (tokenizers JSON, byte-level BPE), read on the driver.  A column that is
    already called ``ids_col`` is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    prepare(docs.sparkSession)
    spec = _shared(docs, path)

    @pandas_udf("array<int>")
    def run(texts):
        own = codec(spec.value)
        return texts.map(own.encode)

    return docs.withColumn(ids_col, run(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col``; null ids give the empty text."""
    from pyspark.sql.functions import pandas_udf

    prepare(docs.sparkSession)
    spec = _shared(docs, path)

    @pandas_udf("string")
    def run(ids):
        own = codec(spec.value)
        return ids.map(lambda x: own.decode(() if x is None else [int(i) for i in x]))

    return docs.withColumn(text_col, run(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: whole texts encoded, then decoded from the ids.

    One pass over the rows without a shuffle.  Null texts count as empty (no ids, digests of nothing); ids may
    be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    ids = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = ids.schema[0].dataType.simpleString()
    spec = _shared(docs, path)

    def run(batches):
        own = codec(spec.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            sizes, coded, back = [], [], []
            for text in batch.column(1):
                tokens = own.encode_text(text.as_py())
                sizes.append(tokens.count(",") + 1 if tokens else 0)
                coded.append(sha(tokens))
                back.append(sha(own.decode_text(tokens)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
