"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters (ASCII and Latin-1 capitals folded, ASCII marks and digits as
blanks), weighted by relative frequency times inverse document frequency. The document frequencies come from all documents of
the training fold. The weights are trained with follow-the-regularised-leader-proximal and elastic-net penalties, which leave
most of them at zero, on a bounded sample by hash: of each language ``PER_LANGUAGE`` documents at most, fewer where there are so
many languages that this would pass ``SAMPLE`` in all, but every document of a language that has no more than its share; no language is left out. A
tenth of the sample is held back to find the temperature that calibrates the probabilities.

Since features are linear in the n-gram counts, a text of any length is scored by adding up weights in slices of bounded
size; nothing is shuffled.

The training fold is every document with crc32(doc_id as text) mod 4 other than 2 (a null doc_id counts as an empty text) and
a lang. Nulls and texts without a letter are ``und`` with score 0, and so is every text if there is nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.llm.shared import stage
from marketebb.llm.words import buffers, slices

BITS, WIDTHS = 16, (1, 2, 3)
SIZE = 1 << BITS
PER_LANGUAGE, SAMPLE, EPOCHS = 600, 6_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 1e-3
SCALE = 20.0  # relative frequencies are small numbers


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(first row, number of n-grams by row, hashes of each width in text order, row border of each width) by slices."""
    data, offsets = buffers(column)
    for a, b in slices(offsets, 1 << 20):
        own = data[offsets[a] : offsets[b]]
        starts = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # characters before each byte
        ends = starts[offsets[a : b + 1] - offsets[a]]
        c = np.frombuffer(own.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(c) != ends[-1]:  # text that is not UTF-8: by row
            texts = [own[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a], strict=True)]
            c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        capital = ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))
        c = c + (capital.astype(np.uint32) << 5)
        c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
        size = np.diff(ends)
        hashes, borders, total = [], [], np.zeros(b - a, np.int64)
        for n in WIDTHS:
            h = np.full(max(len(c) - n + 1, 0), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint32(0x85EBCA77)
                h ^= h >> np.uint32(15)
            inside = np.ones(len(h), bool)
            for i in range(1, n):
                late = ends[1:] - i
                inside[late[(late >= 0) & (late < len(h))]] = False
            hashes.append((h[inside] >> np.uint32(32 - BITS)).astype(np.int32))
            kept = np.maximum(size - n + 1, 0)
            borders.append(np.concatenate([[0], np.cumsum(kept)]))
            total += kept
        yield a, total, hashes, borders


def in_training(doc_id: str = "doc_id") -> Column:
    """Whether a document is of the training fold."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(gram, n): in how many texts each hashed n-gram occurs; at most ``SIZE`` rows leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(SIZE, np.int64), np.zeros(SIZE, bool), 0
        for b in batches:
            for _, sizes, hashes, borders in grams(b.column(0)):
                for r in range(len(sizes)):
                    for h, e in zip(hashes, borders, strict=True):
                        seen[h[e[r] : e[r + 1]]] = True
                    total += seen
                    seen[:] = False
                n += len(sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def examples(docs: DataFrame) -> DataFrame:
    """(lang, h, grams, tf) of the rows: distinct n-grams and their relative frequencies."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sizes, hashes, borders in grams(b.column("text")):
                own = [np.unique(np.concatenate([h[e[r] : e[r + 1]] for h, e in zip(hashes, borders, strict=True)]), return_counts=True) for r in range(len(sizes))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("lang").slice(first, len(sizes)), b.column("h").slice(first, len(sizes)),
                     pa.array([g for g, _ in own], pa.list_(pa.int32())), pa.array([n / max(n.sum(), 1) for _, n in own], pa.list_(pa.float64()))],
                    ["lang", "h", "grams", "tf"],
                )

    return docs.select("lang", "h", "text").mapInArrow(features, "lang string, h long, grams array<int>, tf array<double>")


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (SIZE + 1, languages): times the inverse document frequency; the last row is the bias
    temperature: float = 1.0

    def logits(self, total: np.ndarray, hashes: list[np.ndarray], borders: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(total), len(self.languages)))
        for h, e in zip(hashes, borders, strict=True):
            for k in range(out.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[:SIZE, k][h])])
                out[:, k] += sums[e[1:]] - sums[e[:-1]]
        return out / np.maximum(total, 1)[:, None] + self.weights[SIZE]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights (SIZE + 1, classes) of FTRL-proximal with elastic net over sparse rows (indices, values)."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(z[at], n[at])
            error = softmax(x @ w)
            error[labels[i]] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame) -> Model | None:
    fold = docs.select("doc_id", "text", "lang").where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency = document_frequencies(fold).toPandas()  # at most SIZE + 1 rows
    n = float(frequency.loc[frequency["gram"] == -1, "n"].sum())
    if not n:
        return None
    idf = np.full(SIZE, np.log(1 + n))
    known = frequency[frequency["gram"] >= 0]
    idf[known["gram"]] = np.log((1 + n) / (1 + known["n"])) + 1e-3
    # which documents are the sample is settled on narrow rows, language by language; only theirs are read again
    h = F.xxhash64("doc_id", "text").alias("h")
    key = fold.select("lang", h)
    counts = stage(key.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota = max(1, min(PER_LANGUAGE, SAMPLE // max(counts.count(), 1)))
    chosen = key.join(counts, "lang").where(F.pmod("h", F.lit(1 << 31)) < F.lit(2.0 * quota * (1 << 31)) / F.col("n")).select("lang", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = stage(chosen.withColumn("nth", nth).where(F.col("nth") <= quota).select("lang", "h"), "language-sample")
    rows = fold.select("*", h).join(chosen, ["lang", "h"])
    got = examples(rows).dropDuplicates(["lang", "h"]).toPandas().sort_values(["h", "lang"], ignore_index=True)
    languages = sorted(got["lang"].unique())
    if not languages:
        return None
    labels = np.array([languages.index(x) for x in got["lang"]])
    sparse = [(np.append(g, SIZE).astype(int), np.append(np.asarray(tf) * idf[np.asarray(g, int)] * SCALE, 1.0)) for g, tf in zip(got["grams"], got["tf"], strict=True)]
    held = np.arange(len(labels)) % 10 == 0 if len(labels) >= 20 else np.zeros(len(labels), bool)
    weights = ftrl([sparse[i] for i in np.flatnonzero(~held)], labels[~held], len(languages))
    model = Model(languages, weights.copy())
    if held.any():
        model.temperature = temperature(np.array([x @ weights[at] for at, x in (sparse[i] for i in np.flatnonzero(held))]), labels[held])
    model.weights[:SIZE] *= idf[:, None] * SCALE
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    rows = docs.select("doc_id", (~in_training()).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        names = np.array(m.languages, object)
        for b in batches:
            for first, total, hashes, borders in grams(b.column("text")):
                p = softmax(m.logits(total, hashes, borders) / m.temperature)
                cut = b.slice(first, len(total))
                letter = cut.column("letter").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("held_out"), pa.array(np.where(letter, names[p.argmax(1)], "und"), pa.string()), pa.array(np.where(letter, p.max(1), 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.mapInArrow(predict, schema)


def language(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
