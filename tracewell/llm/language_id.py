"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator that its code point seeds. A letter n-gram is the
product of its letters' vectors, each rotated by its place; a text is the sum of its n-grams' vectors, a language the
sum of its texts'. A document gets the language whose prototype has the largest cosine with it.

A column with more than max_languages values is an error. Defined cases: a null text, or one without letters, is `und` with score 0; if nothing was learned all are; ties go to
the language that sorts first; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    dim: int = 1024
    n: int = 3
    seed: int = 5
    #: More distinct languages than this stop the run: prototypes meet on the driver, 1,024 numbers each.
    max_languages: int = 1000
    #: So many n-grams are gathered before they are counted and summed up.
    piece: int = 1 << 20


_tables: dict[str, np.ndarray] = {}


def _lower_letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a blank."""
    if "lower" not in _tables:
        t = np.full(sys.maxunicode + 1, 32, np.int32)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _tables["lower"] = t
    return _tables["lower"]


class Profiles:
    """Vectors of letters and n-grams, made when first needed."""

    def __init__(self, p: LanguageParams) -> None:
        self.p = p
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng([self.p.seed, c]).integers(0, 2, self.p.dim).astype(np.int8) * 2 - 1
        return self.letters[c]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A row for each n-gram code (21 bits a letter): the product of the rotated letters."""
        out = np.ones((len(codes), self.p.dim), np.int8)
        for place in range(self.p.n):
            each, back = np.unique((codes >> (21 * (self.p.n - 1 - place))) & ((1 << 21) - 1), return_inverse=True)
            out *= np.roll(np.array([self.letter(int(c)) for c in each]).reshape(-1, self.p.dim), self.p.n - 1 - place, axis=1)[back]
        return out

    def codes(self, text: str | None) -> np.ndarray:
        """n-gram codes of a whole text, its words separated by single blanks."""
        n = self.p.n
        raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.concatenate([[32], _lower_letters()[raw], [32]]).astype(np.int64)
        low = low[(low != 32) | (np.concatenate([[0], low[:-1]]) != 32)]
        if len(low) < n:
            return np.zeros(0, np.int64)
        code = low[: len(low) - n + 1]
        for k in range(1, n):
            code = (code << 21) | low[k : len(low) - n + 1 + k]
        return code

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: the sum of its n-grams' vectors."""
        out = np.zeros((len(texts), self.p.dim), np.float32)
        owners, codes, size = [], [], 0

        def flush() -> None:
            nonlocal owners, codes, size
            if codes:
                each, back = np.unique(np.concatenate(codes), return_inverse=True)
                owner = np.concatenate(owners)
                rows, row_of = np.unique(owner, return_inverse=True)
                for at in range(0, len(each), 4096):  # a bounded piece of the n-gram table at a time
                    vectors = self.grams(each[at : at + 4096]).astype(np.float32)
                    here = (back >= at) & (back < at + 4096)
                    counts = np.bincount(row_of[here] * len(vectors) + (back[here] - at), minlength=len(rows) * len(vectors)).reshape(len(rows), len(vectors)).astype(np.float32)
                    out[rows] += counts @ vectors
            owners, codes, size = [], [], 0

        for i, text in enumerate(texts):
            code = self.codes(text)
            if len(code):
                owners.append(np.full(len(code), i))
                codes.append(code)
                size += len(code)
            if size >= self.p.piece:
                flush()
        flush()
        return out


def prototypes(docs: DataFrame, p: LanguageParams = LanguageParams()) -> dict[str, np.ndarray]:
    """The sum over each language's documents outside the held-out fold. Each batch sends one vector a language; Spark adds them up per dimension."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, sums = Profiles(p), {}
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                got = profiles.bundles(list(part["text"]))
                for lang in part["lang"].unique():
                    sums[lang] = sums.get(lang, 0) + got[(part["lang"] == lang).to_numpy()].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(p.dim, dtype="int32"), "value": v})

    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    if learn.select("lang").distinct().limit(p.max_languages + 1).count() > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages")
    # Sums of whole numbers below 2^53 are the same in any order.
    rows = learn.mapInPandas(partial, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(p.dim))[r["dim"]] = r["value"]
    return out


def predict_languages(docs: DataFrame, p: LanguageParams = LanguageParams()) -> DataFrame:
    """Per document: doc_id, lang_pred, score (the cosine, not below 0)."""
    learned = sorted(prototypes(docs, p).items())
    names = [k for k, v in learned if np.linalg.norm(v) > 0]
    matrix = np.array([v / np.linalg.norm(v) for k, v in learned if k in set(names)]).reshape(-1, p.dim)
    model = docs.sparkSession.sparkContext.broadcast((names, matrix.astype(np.float32)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        profiles = Profiles(p)
        for b in batches:
            pred, score = [], []
            for at in range(0, b.num_rows, 500):
                got = profiles.bundles(b.column("text").slice(at, 500).to_pylist())
                norm = np.linalg.norm(got, axis=1)
                cos = (got @ matrix.T if names else np.zeros((len(got), 1))) / np.maximum(norm, 1e-9)[:, None]
                best = cos.argmax(1)
                seen = (norm > 0) & bool(names)
                pred += [names[k] if s else UNKNOWN for k, s in zip(best, seen, strict=True)]
                score += [float(min(1.0, max(0.0, cos[i, k]))) if s else 0.0 for i, (k, s) in enumerate(zip(best, seen, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    return predict_languages(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
