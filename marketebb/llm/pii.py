"""Personal data: pattern spans, and a skip-chain conditional random field that labels what the patterns miss.

Base spans are those of four fixed patterns (e-mail, IP address, payment card, phone), with checks. They always stay.

The field labels the tokens that have a digit or an ``@`` (all other tokens are ``none`` by a hard constraint, so a document
without such tokens costs one search). Its potentials: shape features of the token, the labels of the neighbours in the
text, and skip edges: tokens with the same digits or the same letters, however distant, are linked to their next
occurrence, so a number that is recognised in one place is recognised where it stands without its usual form. Labels come
from loopy sum-product message passing over chain and skip edges together. Runs of tokens with one label whose marginals
reach ``SURE`` and that have the digits of their kind become added spans, if they touch no base span.

Training is by pseudo-likelihood (each token given the labels around it) on a bounded sample: whole texts with such tokens, in
order of their hash, as far as there are at most ``SAMPLE`` of them with at most ``SAMPLE_CHARS`` characters together (the
first is always taken), labelled by their base spans. Two kinds of changed copies teach the skip potentials: an
entity is repeated in a worn form at the end of its document, and shape features are dropped at random.

Nulls: a null text is an empty one. Everything else passes through; equal rows have equal results.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketebb.llm.shared import fresh

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS, SURE, ROUNDS, DROP = 3_000, 8_000_000, 0.9, 12, 0.3
MARKS = ".,;:!?\"'()[]{}<>=|*"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address holds one @, so the matches follow from the runs around each @: linear for any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # no later match begins before this @
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers holds a match for every four numbers in it."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by start, then kind; ends are exclusive, places in code points."""
    if not _HINT.search(text):
        return []
    out: list[Span] = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    out += [(s, 1, e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# The field. Label 0 is none, label k + 1 is KINDS[k].

N_LABELS = len(KINDS) + 1


def tokens_of(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether the token before is one too) of the tokens with a digit or an @, without the marks around."""
    out: list[tuple[int, int, bool]] = []
    last, at = -1, 0
    while m := _HINT.search(text, at):
        a = m.start()
        while a > 0 and not _blank(text[a - 1]):
            a -= 1
        b = _TOKEN.match(text, a).end()
        close = last >= 0 and all(_blank(c) and c != "\n" for c in text[last:a])
        out.append((a, b, close))
        last = at = b
    return out


def _blank(c: str) -> bool:
    return c == " " or "\x09" <= c <= "\x0d"


def shape(token: str) -> list[int]:
    """Indices of the features of a token."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    bare = token.strip(MARKS)
    out = [0, 1 + min(digits, 20)]  # up to 21
    out.append(22 + min(token.count("."), 4))  # up to 26
    out.append(27 + min(letters, 12) // 3)  # up to 31
    tests = (
        token[:1] == "+", "(" in token and ")" in token, "-" in token, "@" in token, "=" in token, '"' in token,
        bool(_DOMAIN.search(token)) and "@" in token, digits > 0 and letters > 0, bare.isdigit(), 12 <= digits <= 19 and letters == 0 and luhn(re.sub("[^0-9]", "", token)),
        token.count(".") >= 3 and next(ips(token), None) is not None,
    )
    return out + [32 + i for i, t in enumerate(tests) if t]


N_FEATURES = 32 + 11


def form(token: str) -> str | None:
    """What repeated tokens have in common: the digits (three or more), or an address in lower case."""
    if "@" in token:
        return token.strip(MARKS).lower()
    digits = re.sub("[^0-9]", "", token)
    if len(digits) < 3:
        return None
    letters = "".join(c for c in token.lower() if c.isalpha())
    return f"{digits}{letters}"


@dataclass
class Graph:
    """Tokens of several documents: features, chain edges and skip edges (pairs of token indices)."""

    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    places: list[tuple[int, int, int]]  # document, start, end
    open_left: np.ndarray
    open_right: np.ndarray


def graph(texts: list[str]) -> Graph:
    rows, chain, skip, places, left = [], [], [], [], []
    for d, text in enumerate(texts):
        last: dict[str, int] = {}
        for a, b, close in tokens_of(text):
            i = len(places)
            places.append((d, a, b))
            x = np.zeros(N_FEATURES)
            x[shape(text[a:b])] = 1
            rows.append(x)
            left.append(not close)
            if close:
                chain.append((i - 1, i))
            if f := form(text[a:b]):
                if f in last and (i - 1 != last[f] or not close):
                    skip.append((last[f], i))
                last[f] = i
    left_ = np.array(left, bool)
    right = np.ones(len(places), bool)
    if chain:
        right[np.array(chain)[:, 0]] = False
    pairs = [np.array(e, int).reshape(-1, 2) for e in (chain, skip)]
    return Graph(np.array(rows).reshape(-1, N_FEATURES), *pairs, places, left_, right)


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    step: np.ndarray  # label before x label; row 0 also stands for the clamped tokens around a run
    same: np.ndarray  # label x label over a skip edge, symmetric

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product; messages of all edges move at once, damped by half."""
        node = g.features @ self.unary
        node[g.open_left] += self.step[0]
        node[g.open_right] += self.step[:, 0]
        ends = np.concatenate([g.chain, g.skip])
        if not len(ends):
            return _normal(node)
        table = np.concatenate([np.repeat(self.step[None], len(g.chain), 0), np.repeat(self.same[None], len(g.skip), 0)])
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(source), N_LABELS))
        for _ in range(rounds):
            belief = node.copy()
            np.add.at(belief, target, message)
            out = _log_sum((belief[source] - message[back])[:, :, None] + table)
            out -= out.max(1, keepdims=True)
            if np.abs(out - message).max() < 1e-4:
                break
            message = 0.5 * message + 0.5 * out
        belief = node.copy()
        np.add.at(belief, target, message)
        return _normal(belief)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return np.log(np.exp(x - top).sum(1)) + top[:, 0]


def _normal(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gold(g: Graph, spans: list[list[Span]]) -> np.ndarray:
    """Labels from spans: a token takes the kind of the span over most of it."""
    out = np.zeros(len(g.places), int)
    for i, (d, a, b) in enumerate(g.places):
        over = [(min(b, e) - max(a, s), k) for s, k, e in spans[d] if s < b and e > a]
        if over and max(over)[0] * 2 >= b - a:
            out[i] = max(over)[1] + 1
    return out


def worn(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with one of its entities again at the end, in a form that its pattern misses."""
    s, k, e = spans[rng.integers(len(spans))]
    entity = text[s:e]
    entity = {0: lambda: entity.replace(".", " ", 1) if rng.random() < 0.3 else f"<{entity}>", 1: lambda: f"[{entity}]", 2: lambda: f"#{entity}", 3: lambda: entity.lstrip("+")}[k]()
    filler = " " + " ".join(["so"] * int(rng.integers(1, 30))) + " "
    return text + filler + entity, [*spans, (len(text) + len(filler), k, len(text) + len(filler) + len(entity))]


def train(texts: list[str], drop: float = DROP, steps: int = 300, seed: int = 5) -> Field:
    """Pseudo-likelihood by full-batch gradient steps with momentum and an L2 penalty."""
    rng = np.random.default_rng(seed)
    spans = [base_spans(t) for t in texts]
    more = [worn(t, s, rng) for t, s in zip(texts, spans, strict=True) if s]
    g = graph([*texts, *(t for t, _ in more)])
    y = gold(g, [*spans, *(s for _, s in more)])
    field = Field(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS)))
    if not len(y) or not y.any():
        field.unary[0, 0] = 20.0  # nothing to learn: no token is personal data
        return field
    one = np.eye(N_LABELS)[y]
    x = g.features * (rng.random(g.features.shape) > drop)
    x[:, 0] = 1

    def around(edges: np.ndarray, to: int) -> np.ndarray:
        out = np.zeros((len(y), N_LABELS))
        np.add.at(out, edges[:, to], one[edges[:, 1 - to]])
        return out

    before, after = around(g.chain, 1), around(g.chain, 0)
    before[g.open_left, 0] += 1
    after[g.open_right, 0] += 1
    linked = around(g.skip, 0) + around(g.skip, 1)
    speed = [np.zeros_like(p) for p in (field.unary, field.step, field.same)]
    # rare kinds count as much as common ones, within a factor
    weight = np.clip(len(y) / (N_LABELS * np.maximum(np.bincount(y, minlength=N_LABELS), 1)), 0.2, 5.0)[y]
    for _ in range(steps):
        p = _normal(x @ field.unary + before @ field.step + after @ field.step.T + linked @ field.same)
        error = (one - p) * weight[:, None] / weight.sum()
        same = linked.T @ error
        grads = (x.T @ error, before.T @ error + (after.T @ error).T, (same + same.T) / 2)
        for k, (param, grad) in enumerate(zip((field.unary, field.step, field.same), grads, strict=True)):
            speed[k] = 0.9 * speed[k] + 2.0 * (grad - 1e-5 * param)
            param += speed[k]
    return field


def _fits(kind: int, text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    return (text.count("@") == 1 and text[0] != "@" and text[-1] != "@", text.count(".") >= 3, 12 <= digits <= 19, 7 <= digits <= 15)[kind]


def added_spans(field: Field, texts: list[str], base: list[list[Span]], sure: float = SURE) -> list[list[Span]]:
    """Spans of the field beside the base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts)
    if not g.places:
        return out
    p = field.marginals(g)
    label = np.where(p.max(1) >= sure, p.argmax(1), 0)
    i = 0
    while i < len(label):
        d, a, b = g.places[i]
        j = i + 1
        while j < len(label) and not g.open_left[j] and label[j] == label[i]:
            b, j = g.places[j][2], j + 1
        if label[i]:
            text, kind = texts[d], int(label[i]) - 1
            while a < b and text[a] in MARKS and not (kind == 3 and text[a] == "("):
                a += 1
            while b > a and text[b - 1] in MARKS:
                b -= 1
            if b > a and _fits(kind, text[a:b]) and not any(s < b and e > a for s, _, e in base[d]):
                out[d].append((a, kind, b))
        i = j
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field:
    """From whole texts with a digit or an @, in order of hash: at most ``sample``, with at most ``chars`` characters together."""
    hinted = docs.select("text").where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    sizes = hinted.groupBy("h").agg(F.max(F.length("text")).alias("n")).orderBy("h").limit(sample).collect()
    if not sizes:
        return train([])
    # only whole texts: a part of one would lack the repetitions that the skip edges learn from
    total = itertools.accumulate(r.n for r in sizes)
    least = [r.h for i, (r, t) in enumerate(zip(sizes, total, strict=True)) if i == 0 or t <= chars][-1]
    rows = hinted.where(F.col("h") <= least).dropDuplicates(["h"]).orderBy("h")
    return train([r.text for r in rows.collect()])


def annotate(docs: DataFrame, field: Field, name: str, masked: bool = False) -> DataFrame:
    """All columns and a struct ``name``: counts of base spans, base_sha256, spans; with ``masked`` the text without them."""
    field_ = docs.sparkSession.sparkContext.broadcast(field)
    text_at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(text_at)]
            base = [base_spans(t) for t in texts]
            some = [i for i, t in enumerate(texts) if _HINT.search(t)]
            more: list[list[Span]] = [[] for _ in texts]
            for i in range(0, len(some), 256):
                own = some[i : i + 256]
                for k, s in zip(own, added_spans(field_.value, [texts[k] for k in own], [base[k] for k in own]), strict=True):
                    more[k] = s
            every = [sorted(s + m) for s, m in zip(base, more, strict=True)]
            columns = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in range(len(KINDS))]
            columns += [pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), pa.array([joined(s) for s in every], pa.string())]
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if masked:
                columns.append(pa.array([mask(t, s) if s else None for t, s in zip(texts, every, strict=True)], pa.string()))
                names.append("masked")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(columns, names)], [*b.schema.names, name])

    kind = ",".join(f"n_{k}:long" for k in KINDS) + ",base_sha256:string,spans:string" + ",masked:string" * masked
    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField(name, T.DataType.fromDDL(f"struct<{kind}>"))]))


def mask(text: str, spans: list[Span]) -> str:
    """The text with a label in place of every span; overlapping spans become one label, that of the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and all spans of every document."""
    out = annotate(docs.select("doc_id", "text"), fit(docs, sample), "_pii")
    return out.select("doc_id", *(F.col(f"_pii.{c}") for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")))


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with their personal data masked; n_chars follows where it is a column and the text has changed."""
    names = docs.columns
    (found,) = fresh(docs, "personal_data")
    out = annotate(docs, fit(docs, sample), found, masked=True)
    text = next(c for c in names if c.lower() == "text")
    masked = F.col(found)["masked"]
    if (n := next((c for c in names if c.lower() == "n_chars"), None)) is not None:
        out = out.withColumn(n, F.when(masked.isNotNull(), F.length(masked)).otherwise(F.col(n)).cast(docs.schema[n].dataType))
    return out.withColumn(text, F.coalesce(masked, F.col(text))).select(names)
