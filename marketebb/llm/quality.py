"""Quality rules with an isolation forest over their statistics.

The rules count words, characters, symbols, repeated lines and repeated three-word runs of each whole text. Two of them
reject by themselves (``base_failed``). For the rest an isolation forest, trees of random splits over ratios of such
statistics (symbols, word length, capitals, marks, and the shares of repeated lines and of repeated words), gives each document its mean path length: documents that few splits set apart are anomalous. The forest is
grown and its threshold calibrated on labelled rows: at most ``sample`` of them, those of the least hash of doc_id. Half of
them grow the trees, good rows (quality 1) with a share ``contamination`` of bad ones (quality 0), so that anomalies are as
rare as the method assumes. On the other half the threshold is the one that finds most bad rows while it rejects at most
``clean_loss`` of the good rows that the rules pass. Without labelled bad rows the forest rejects nothing.

One pass over the documents, no shuffle of texts: only labelled texts meet the labels, in a join with at most ``sample``
rows.

Nulls: a null text has no words and fails the rules. doc_id and further columns pass through. A label counts if quality is
0 or 1 and doc_id is not null; a doc_id labelled twice takes the worse label. Texts are measured whole, one at a time. A score equal to the
threshold keeps; equal rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketebb.llm.shared import fresh, stage

MIN_WORDS, REPEAT_SHARE = 50, 50
SYMBOLS = b"#*$%&|<>"
SAMPLE, TREES, TREE_ROWS, CLEAN_LOSS, CONTAMINATION = 20_000, 200, 256, 0.002, 0.015
RATIOS = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    runs = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(runs)) == len(runs):
        return 0
    seen = Counter(runs)
    total, upto = 0, 0
    for i, run in enumerate(runs):
        if seen[run] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five counts of the rules and the ratios that the forest sees."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * RATIOS
    inside = b"".join(words)
    codes = np.frombuffer(inside, np.uint8)
    chars = int(((codes & 0xC0) != 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    kinds = np.bincount(codes, minlength=256)
    upper, lower, digits = int(kinds[65:91].sum()), int(kinds[97:123].sum()), int(kinds[48:58].sum())
    marks = int(kinds[33:127].sum()) - upper - lower - digits
    ratios = [math.log1p(4 * symbols / n), chars / n / 8, upper / (upper + lower + 1), math.log1p(4 * marks / n), dup / max(len(lines), 1), repeat / n]
    return [n, chars, symbols, dup, repeat], ratios


def base_failed(counts: list[int]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_SHARE * counts[0]


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: feature (-1 for a leaf), cut, left child, path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        deepest = int(np.ceil(np.log2(max(self.size, 2))))
        feature, cut, left, path = [0], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            free = np.flatnonzero(high > low)
            if depth >= deepest or len(own) < 2 or not len(free):
                feature[at], path[at] = -1, depth + float(_average_path(np.array(len(own))))
                continue
            f = int(rng.choice(free))
            c = float(rng.uniform(low[f], high[f]))
            under = own[:, f] < c
            if not under.any():  # c fell on the least value
                under = own[:, f] <= low[f]
                c = float(np.nextafter(low[f], np.inf))
            feature[at], cut[at], left[at] = f, c, len(feature)
            for part in (own[under], own[~under]):
                todo.append((len(feature), part, depth + 1))
                feature.append(0), cut.append(0.0), left.append(0), path.append(0.0)
        return np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1: 2 ** -(mean path / expected path)."""
        total = np.zeros(len(rows))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(rows), np.int32)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                f = feature[at[inner]]
                at[inner] = left[at[inner]] + (rows[inner, f] >= cut[at[inner]])
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / max(float(_average_path(np.array(self.size))), 1e-9))


class Model:
    """A forest and the score above which a document is rejected."""

    def __init__(self, forest: Forest | None, threshold: float) -> None:
        self.forest, self.threshold = forest, threshold

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return self.forest.scores(ratios) if self.forest else np.zeros(len(ratios))

    def rejects(self, scores: np.ndarray) -> np.ndarray:
        return scores > self.threshold


def calibrate(scores: np.ndarray, bad: np.ndarray, clean_loss: float = CLEAN_LOSS) -> float:
    """The least score that rejects at most this share of the good rows."""
    good = np.sort(scores[~bad])[::-1]
    return float(good[min(int(clean_loss * len(good)), len(good) - 1)]) if len(good) and bad.any() else np.inf


def train(ratios: np.ndarray, bad: np.ndarray, grow: np.ndarray, clean_loss: float = CLEAN_LOSS) -> Model:
    """From rows that the rules pass; ``grow`` tells the half that grows the trees."""
    if not bad.any() or bad.all() or grow.sum() < 2 or (~grow).sum() < 2:
        return Model(None, np.inf)
    good, rare = ratios[grow & ~bad], ratios[grow & bad]
    rare = rare[: math.ceil(CONTAMINATION * len(good))]
    forest = Forest(np.concatenate([good, rare]))
    return Model(forest, calibrate(forest.scores(ratios[~grow]), bad[~grow], clean_loss))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(h, bad, counts, ratios) of at most ``sample`` labelled documents."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in _texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("bad"), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))],
                ["h", "bad", "counts", "ratios"],
            )

    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    chosen = stage(known.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(sample), "labelled")
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("h", "bad", "text").mapInArrow(measure, "h long, bad boolean, counts array<long>, ratios array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean_loss: float = CLEAN_LOSS) -> Model:
    # a doc_id that many rows share would bring in more rows than labels
    got = labelled(docs, labels, sample).orderBy("h").limit(sample).toPandas()
    got = got[[not base_failed(list(c)) for c in got["counts"]]] if len(got) else got
    if not len(got):
        return Model(None, np.inf)
    return train(np.array(got["ratios"].tolist(), float), got["bad"].to_numpy(bool), (got["h"].to_numpy() >> 20) % 2 == 0, clean_loss)


def annotate(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of the documents, after them a struct ``name``: the counts, base_failed, score and kept."""
    names = list(COUNTS)
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in _texts(b.column(text))]
            scores = model_.value.scores(np.array([x for _, x in found]).reshape(len(found), -1))
            failed = [base_failed(x) for x, _ in found]
            kept = ~(model_.value.rejects(scores) | np.array(failed, bool))
            struct = pa.StructArray.from_arrays(
                [*(pa.array([x[i] for x, _ in found], pa.int64()) for i in range(len(names))), pa.array(failed, pa.bool_()), pa.array(scores), pa.array(kept)],
                [*names, "base_failed", "score", "kept"],
            )
            yield pa.RecordBatch.from_arrays([*b.columns, struct], [*b.schema.names, name])

    text = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    kind = "struct<" + ",".join(f"{n}:long" for n in names) + ",base_failed:boolean,score:double,kept:boolean>"
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))]))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean_loss: float = CLEAN_LOSS) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the anomaly score of every document."""
    model = fit(docs, labels, sample, clean_loss)
    out = annotate(docs.select("doc_id", "text"), model, "_quality")
    return out.select("doc_id", *(F.col(f"_quality.{c}") for c in (*COUNTS, "base_failed", "kept", "score")))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean_loss: float = CLEAN_LOSS) -> DataFrame:
    """The documents that rules and forest keep, with all their columns."""
    (name,) = fresh(docs, "quality_verdict")
    return annotate(docs, fit(docs, labels, sample, clean_loss), name).where(F.col(name)["kept"]).select(docs.columns)
