"""Language identification with a string kernel: Nystrom landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-grams (1 to 3 characters, folded to lower case, hashed to 2^16
places) that both hold, divided by the root of the product of how many each holds: a blended-spectrum
presence kernel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecairn.llm.common import column, inputs, map_rows, small, unit_hash

PLACES = 1 << 16
UNKNOWN = "und"


def presence(text: str, row: np.ndarray) -> None:
    """Sets the places of all n-grams of the whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mixed = codes * np.uint32(0x9E3779B1)
    row[mixed >> np.uint32(16)] = 1
    if len(codes) > 1:
        pair = mixed[:-1] * np.uint32(0x85EBCA6B) + mixed[1:]
        row[(pair * np.uint32(0xC2B2AE35)) >> np.uint32(16)] = 1
        if len(codes) > 2:
            row[((pair[:-1] * np.uint32(0x27D4EB2F) + mixed[2:]) * np.uint32(0x165667B1)) >> np.uint32(16)] = 1


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    """``weights[place, language]``: landmarks, Nystrom map and regression folded into one matrix.

    The kernel row of a text with the landmarks, times the coefficients, is the presence row times this
    matrix, divided by the root of the number of places the text holds. Its size does not depend on the corpus.
    """

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(rows.sum(axis=1), 1.0))
        return (rows @ self.weights) / norm[:, None] + self.bias

    def known(self, rows: np.ndarray) -> np.ndarray:
        """Share of a text's places that a landmark holds too; it does not follow the length of the text."""
        return (rows @ self.weights.any(axis=1).astype(np.float32)) / np.maximum(rows.sum(axis=1), 1.0)


def fit(packed: np.ndarray, labels: list[str], landmarks: int = 48, ridge: float = 1e-3, block: int = 64) -> Model:
    """Nystrom features from the first ``landmarks`` rows of every language, then ridge regression to +1 and -1.

    ``packed`` has one row of presence bits per text. Only ``block`` rows are unpacked at a time, and of them
    only the places of landmarks: the kernel with a landmark sees no others, their weights stay zero.
    """
    languages = sorted(set(labels))
    where = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(where == c)[:landmarks] for c in range(len(languages))])
    held = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    places = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(packed[chosen], axis=0)))

    def unit(rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(places)), dtype=np.float32)
        for k, row in enumerate(rows):
            np.divide(np.unpackbits(packed[row])[places], np.sqrt(np.float32(max(held[row], 1))), out=out[k])
        return out

    marks = unit(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([unit(np.arange(k, min(k + block, len(packed)))) @ marks.T for k in range(0, len(packed), block)])
    features = kernel.astype(np.float64) @ root
    centre = features.mean(axis=0)
    target = np.where(where[:, None] == np.arange(len(languages)), 1.0, -1.0)
    middle = target.mean(axis=0)
    centred = features - centre
    gram = centred.T @ centred + ridge * len(packed) * np.eye(centred.shape[1])
    solution = np.linalg.solve(gram, centred.T @ (target - middle))
    weights = np.zeros((8 * packed.shape[1], len(languages)), dtype=np.float32)
    weights[places] = marks.T @ (root @ solution).astype(np.float32)
    return Model(languages, weights, (middle - centre @ solution).astype(np.float32))


def train(docs: DataFrame, allowed: Column, per_language: int = 150, **options) -> Model | None:
    """Model from at most ``per_language`` rows of each language, the smallest hashes of doc_id and text.

    The sample bound is a parameter; the number of languages is that of the labels. Rows with null text or
    lang or without a letter are not used. The hash threshold leaves about twice the bound per language
    before ranking, so no language is sorted whole. None if no row is labelled.
    """
    labelled = inputs(docs, doc_id="doc_id", text="text", lang="lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    drawn = labelled.withColumn("_h", unit_hash("doc_id", "text", F.lit("sample")))
    near = drawn.join(small(counts), "lang").where(F.col("_h") * F.col("_n") < F.lit(2.0 * per_language))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    sample = near.withColumn("_r", rank).where(F.col("_r") <= per_language).select("lang", "_h", "text")

    def features(batch) -> dict:
        packed = []
        for text in column(batch, "text").to_pylist():
            row = np.zeros(PLACES, dtype=np.uint8)
            if has_letter(text):
                presence(text, row)
            packed.append(np.packbits(row).tobytes())
        return {"lang": column(batch, "lang"), "_h": column(batch, "_h"), "bits": packed}

    got = [r for r in map_rows(sample, features, "lang string, _h double, bits binary").collect() if any(r["bits"])]
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["_h"], r["bits"]))
    packed = np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in got])
    return fit(packed, [r["lang"] for r in got], **options)


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` and ``known`` for every row, with the columns ``keep`` (doc_id by default).

    ``known`` is the share of the text's n-grams (hashed) that landmarks hold. ``und`` with 0 for both if the text is null or has no letter, or if nothing was learned. Otherwise the
    language with the largest regression value, ties to the first in order; the score is that value moved
    from [-1, 1] to [0, 1]. Texts are read whole; a batch is one matrix product of bounded size.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    if {"text", "lang_pred", "score", "known"} & set(keep):
        raise ValueError("keep must not name text, lang_pred, score or known")
    shared = spark.sparkContext.broadcast(model)

    def run(batch) -> dict:
        known = shared.value
        texts = column(batch, "text").to_pylist()
        usable = [k for k, t in enumerate(texts) if t and has_letter(t)] if known else []
        names, scores, share = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if usable:
            rows = np.zeros((len(usable), PLACES), dtype=np.float32)
            for row, k in zip(rows, usable):
                presence(texts[k], row)
            values = known.scores(rows)
            for k, n, v, part in zip(usable, values.argmax(axis=1).tolist(), np.clip(values.max(axis=1), -1, 1).tolist(), known.known(rows).tolist()):
                names[k], scores[k], share[k] = known.languages[n], (v + 1) / 2, part
        return {**{c: column(batch, c) for c in keep}, "lang_pred": names, "score": scores, "known": share}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_rows(docs.select(*keep, "text"), run, f"{fields}, lang_pred string, score double, known double", 96)
