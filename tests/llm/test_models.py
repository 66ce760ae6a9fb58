"""Quality forest, personal data field, language model, licence scan."""

from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketebb.llm import language, licences, pii, quality
from tests.conftest import SF
from tests.llm.conftest import SCHEMA, prose, rows

KINDS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def brute_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    again = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)]


def test_statistics():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab é#|\n\t\x0b\x1c ") for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text.encode())[0] == brute_counts(text)


def test_quality(odd, docs, labels):
    model = quality.fit(docs, labels)
    for table in (docs, odd):
        got = quality.annotate(table.select("doc_id", "text"), model, "v").select("text", "v.*").collect()
        assert len(got) == table.count()
        for r in got:
            counts = [r[c] for c in quality.COUNTS]
            if len(r.text or "") < 20_000:
                assert counts == brute_counts(r.text)
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert r.kept == (not r.base_failed and r.score <= model.threshold)


def test_forest_finds_anomalies_and_leaves_clean_rows():
    rng = np.random.default_rng(2)
    good = rng.normal(0, 1, (3000, 4))
    bad = rng.normal(7, 0.5, (150, 4))
    model = quality.train(np.concatenate([good, bad]), np.arange(3150) >= 3000, np.arange(3150) % 2 == 0)
    assert model.rejects(model.scores(rng.normal(7, 0.5, (200, 4)))).mean() > 0.95
    assert model.rejects(model.scores(rng.normal(0, 1, (2000, 4)))).mean() < 0.01


def test_quality_without_usable_labels(spark, odd, empty):
    none = spark.createDataFrame([(None, 1), (1, None), (77, 0)], "doc_id long, quality int")
    got = quality.quality(odd, none).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert quality.quality(empty, none).count() == 0
    kept = quality.keep_good(odd, none)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)


def brute_spans(text):
    out = []
    for k, pattern in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(5)
    for signs, n in (("a1@.+-( )2%4é\n", 6000), ("0123456789 -", 3000), ("12.", 2000)):
        for _ in range(n):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a@" * 100_000, "1." * 150_000, "+1 " * 100_000, "a@b-" * 50_000):
        pii.base_spans(text)
        assert time.time() - began < 20


def test_skip_edges_carry_labels():
    texts = [f"reach me at +1 ({a}55) 555-{b}97 or u{a}.{b}@mail.example.com today, version {a}. of 20{a}" for a in range(1, 10) for b in range(10, 60, 7)]
    field = pii.train(texts)
    text = "call +1 (455) 555-8597 soon. " + "word " * 50 + "again 1 (455) 555-8597 please"
    found = pii.added_spans(field, [text], [pii.base_spans(text)])[0]
    assert [(text[s:e], pii.KINDS[k]) for s, k, e in found] == [("1 (455) 555-8597", "phone")]
    clean = "version 3. of 2024 and 12 apples"
    assert pii.added_spans(field, [clean], [pii.base_spans(clean)]) == [[]]


def test_field_learns_from_entities_far_behind_the_first_digit(spark):
    """Every text opens with a year; entities and their repetitions lie thousands of characters behind it."""
    start, gap = "Year 2024. " + "word " * 1000, "word " * 200
    numbers = [(a, b) for a in range(1, 10) for b in range(10, 60, 7)]
    texts = [f"{start} reach me at +1 ({a}55) 555-{b}97 {gap} or u{a}.{b}@mail.example.com today, version {a}. of 20{a}" for a, b in numbers]
    texts.append(f"{start} call +1 (455) 555-8597 soon. {gap} again 1 (455) 555-8597 please")
    got = {r.doc_id: r.spans.split(",") for r in pii.pii(spark.createDataFrame(rows([*enumerate(texts)]), SCHEMA)).collect()}
    found = [(kind, texts[-1][int(s) : int(e)]) for kind, s, e in (x.split(":") for x in got[len(texts) - 1])]
    assert found == [("phone", "+1 (455) 555-8597"), ("phone", "1 (455) 555-8597")]


def test_field_without_personal_data_adds_nothing():
    field = pii.train([])
    assert pii.added_spans(field, ["12 apples 123456789"], [[]]) == [[]]
    assert pii.added_spans(field, [""], [[]]) == [[]]


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(0)
    n = pii.N_LABELS
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, n)), rng.normal(size=(n, n)), np.zeros((n, n)))
    g = pii.Graph(rng.normal(size=(3, pii.N_FEATURES)), np.array([[0, 1], [1, 2]]), np.zeros((0, 2), int), [(0, 0, 1)] * 3, np.array([True, False, False]), np.array([False, False, True]))
    node = g.features @ field.unary
    node[0] += field.step[0]
    node[2] += field.step[:, 0]
    joint = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2] + field.step[:, :, None] + field.step[None])
    joint /= joint.sum()
    want = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
    assert np.allclose(field.marginals(g, rounds=60), want, atol=1e-3)


def test_pii(odd):
    got = sorted((tuple(r) for r in pii.pii(odd).collect()), key=str)
    base = []
    for r in odd.collect():
        spans = brute_spans(r.text or "") if len(r.text or "") < 100_000 else []
        base.append((r.doc_id, *(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(pii.joined(spans).encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(base, key=str)


def test_redact(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.schema == odd.schema
    rows_ = {r.doc_id: r for r in out.collect()}
    assert rows_[13].text.endswith("mail [EMAIL] ip [IP] [PHONE] card [CARD]")
    assert rows_[13].n_chars == len(rows_[13].text)
    before = {r.doc_id: r.text for r in odd.collect()}
    assert all(before[i] == r.text for i, r in rows_.items() if i != 13)


def test_pii_empty(empty):
    assert pii.pii(empty).count() == 0


def test_language_on_held_out_documents(docs):
    got = language.language(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 60").collect()
    assert len(got) > 20
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd, docs, empty):
    model = language.fit(docs)
    got = language.identify(odd, model).collect()
    texts = odd.collect()
    assert len(got) == len(texts)
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in t.text or "") for t in texts)
    assert language.language(empty).count() == 0
    assert language.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None


def test_language_inputs_do_not_leak(docs):
    """Neither lang nor source nor doc_id of a predicted row matters, nor the labels of held-out rows."""
    held = ~language.in_training()
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.language(d).collect()} for d in (docs, changed))
    assert a == b


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.temperature(logits * 5, labels) - 5) < 1


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    xs = [(np.array([y, 10 + int(rng.integers(50)), language.SIZE]), np.ones(3)) for y in (i % 2 for i in range(400))]
    w = language.ftrl(xs, np.arange(400) % 2, 2)
    assert w[0].argmax() == 0 and w[1].argmax() == 1
    assert (w != 0).any(1).sum() < 70


def test_licences(spark, odd):
    notes = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Foobar Source Licence.", None, "",
    ]
    texts = [(100 + i, f"{prose(i, 60)}.\n{t}\n{prose(i + 50, 30)}" if t else t) for i, t in enumerate(notes)]
    texts += [(200 + i, prose(300 + i, 80) + ".\n" + prose(400 + i, 40)) for i in range(40)]
    table = spark.createDataFrame(rows(texts), SCHEMA).unionByName(odd)
    got = {r.doc_id: (r.paragraph, r.family) for r in licences.licences(table).collect()}
    want = {100: (1, "apache"), 101: (1, "mit"), 102: (1, "cc-by-nc"), 103: (1, "gpl")}
    assert {k: v for k, v in got.items() if k != 104} == want
    assert got.get(104, (1, "unknown")) == (1, "unknown")


def test_licence_lines_that_the_sample_holds_are_found(spark):
    """Lines without the word license, each in many documents, beside ordinary uses of their words."""
    notes = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "unknown": "All rights reserved.",
    }
    plain = "all seats are reserved and human rights.\npermission was granted to a person.\nthe source of binary numbers.\nforms of use and charge."
    texts = [(1000 * k + i, f"{prose(100 * k + i, 40)}.\n{t}\n{prose(100 * k + i + 50, 20)}") for k, t in enumerate(notes.values(), 1) for i in range(40)]
    texts += [(9000 + i, f"{prose(900 + i, 60)}.\n{plain}\n{prose(1900 + i, 30)}") for i in range(120)]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.licences(spark.createDataFrame(rows(texts), SCHEMA)).collect())
    assert got == [(1000 * k + i, 1, f) for k, f in enumerate(notes, 1) for i in range(40)]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_licence_notices_at_any_width(spark, mark):
    notices = {
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    }
    texts, want = [], []
    for k, (family, notice) in enumerate(notices.items()):
        for width in (200, 79, 60, 40):
            head = [prose(k, 9) + ".", "", *textwrap.wrap(notice, width), "", prose(k + 9, 30)]
            texts.append((100 * k + width, "\n".join(mark + x for x in head)))
            want.append((100 * k + width, family))
    texts += [(9000 + i, prose(300 + i, 80) + ".\n" + prose(400 + i, 40)) for i in range(40)]
    got = sorted((r.doc_id, r.family) for r in licences.licences(spark.createDataFrame(rows(texts), SCHEMA)).collect())
    assert got == sorted(want)


def test_licence_scores_by_brute_force(spark):
    """Probabilities and containment of a scan, recomputed in plain Python from the model's weights."""
    notes = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This material is licensed for internal use only.", "All rights reserved."]
    texts = [(i, f"{prose(i, 40)}.\n{t}\n{prose(i + 50, 20)}.") for i, t in enumerate(notes)] + [(100 + i, prose(900 + i, 60)) for i in range(60)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    model = licences.fit(docs)
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    for i, t in enumerate(notes):
        ws = re.findall(r"[^\W_]+(?:\.[0-9]+)?", t.lower())
        grams = {*ws, *(" ".join(p) for p in zip(ws, ws[1:], strict=False))}
        logits = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.bias)))
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p[1:].argmax()) + 1
        if p[best] < model.least:
            assert i not in got
            continue
        shares = [0.0]
        for template in licences.TEMPLATES[model.families[best]] if model.families[best] != "unknown" else ():
            ts = re.findall(r"[^\W_]+(?:\.[0-9]+)?", template.lower())
            pairs = {" ".join(q) for q in zip(ts, ts[1:], strict=False)}
            shares.append(len(pairs & grams) / len(pairs))
        r = got[i]
        assert abs(r.probability - p[best]) < 1e-9 and abs(r.containment - max(shares)) < 1e-12 and r.paragraph == 1
        assert r.family == (model.families[best] if max(shares) >= licences.CONFIRM else "unknown")


def test_licence_model_learns_from_every_paragraph(spark):
    """Each word of the templates stands in one of many texts: none is an anchor, whatever text holds it."""
    single = sorted({w for _, t in licences.sentences() for w in re.findall(r"[a-z]{3,}", t.lower())} - {*licences.ABOUT})
    texts = [(i, prose(i, 6, "abcdefgh"[i % 8]) + f" n{i} {single[i // 16] if i % 16 == 0 and i // 16 < len(single) else ''}") for i in range(16 * len(single))]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert len(texts) > 1200 and not {*single} & {*licences.fit(docs).anchors}


def test_licence_negatives_by_brute_force(spark):
    """Every distinct paragraph counts once, unless it may be a licence line."""
    def spoken(t):
        return re.findall(r"[^\W_]+(?:\.[0-9]+)?", t.lower())

    def grams(ws):
        return {*ws, *(" ".join(p) for p in zip(ws, ws[1:], strict=False))}

    own = sorted(set().union(*(grams(spoken(t)) for _, t in licences.sentences())))
    rng = random.Random(4)
    lines = [" ".join(rng.choice(["the", "of", "rights", "all", "reserved", "copy", "w1", "w2", "bsd", "charge"]) for _ in range(rng.randint(1, 9))) + "." for _ in range(3000)]
    lines += ["no licence here.", "the copy; of the charge.", "free of charge to any w1 person w2 obtaining a copy."]
    texts = [(i, "\n".join(rng.choice(lines) for _ in range(20))) for i in range(500)] + [(900, None), (901, ""), (902, "\n".join(lines[-3:]))]
    want = {}
    for line in {x for _, t in texts if t for x in t.split("\n")}:
        ws, has = spoken(line), grams(spoken(line))
        said = [spoken(t) for _, t in licences.sentences()]
        runs = [t[i : i + 4] for t in said for i in range(max(len(t) - 4, 0) + 1)]
        runs = [r for r in runs if len(r) < 4 or sum(w not in licences.SMALL for w in r) > 1]
        near = any(len(has & (p := grams(t) - {*t})) >= max(3, len(p) / 4) for t in said)
        if not ({*ws} & {*licences.ABOUT} or near or any(ws[i : i + len(r)] == r for r in runs for i in range(len(ws)))):
            key = "\n".join(sorted(has & {*own})), "\n".join(sorted({*ws[:8]} & {*own}))
            want[key] = want.get(key, 0) + 1
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {}
    for r in licences.negatives(docs.unionByName(docs), own).collect():
        got[r.grams, r.opening] = got.get((r.grams, r.opening), 0) + r.n
    assert got == want and 0 < len(want) < len(lines)


def test_licence_threshold_is_exact(spark):
    rng = random.Random(6)
    for values in ([], [0.5], [rng.random() / 2 + 0.5 for _ in range(400)], [0.9 + i * 1e-15 for i in range(50)] + [0.5], [0.75] * 9):
        data = [(p, rng.randint(1, 5)) for p in values]
        chances = spark.createDataFrame(data, "p double, n long")
        each = sorted((p for p, n in data for _ in range(n)), reverse=True)
        for most in (0, 3, 47, len(each)):
            assert licences.least_letting(chances, most) == (each[most] if most < len(each) else None)


def test_licence_lines_are_joined_as_by_plain_patterns(spark):
    rng = random.Random(5)
    marks = ["\n", "\n", " ", "\t", "*/", "-->", "a", "b.", "!", "\r", "# ", "//", "/*", "é", ")", "--"]
    table = spark.createDataFrame([("".join(rng.choice(marks) for _ in range(rng.randint(0, 40))),) for _ in range(5000)], "text string")
    plain = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"(?m)^[ \t]*+(?:/\*++|\*++/?|//++|#++|--++|;++|%++|<!--)?[ \t]*+", "")
    plain = F.regexp_replace(plain, r"(?<![ \t])[ \t]*+(?:(?:\*/|-->)[ \t]*+)?(?=\n)", "")
    plain = F.regexp_replace(plain, r"(?<![.!?][^\p{L}\p{N}\n]{0,8})(?<!\n)\n(?!\n)", " ")
    assert table.where(plain != licences.unwrapped(F.col("text"))).count() == 0


def test_no_language_is_left_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"

    def text(k, i):
        rng = random.Random(1000 * k + i)
        own = random.Random(k).sample(letters, 6)
        return " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 7))) for _ in range(40))

    data, n = [], 0
    for k in range(100):
        for i in range(5 if k == 7 else 70):
            while zlib.crc32(str(n).encode()) % 4 == 2:
                n += 1
            data.append((n, text(k, i), f"l{k}", "s", 1, "k", 1, "q", 0.0))
            n += 1
    got = language.language(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    of = {r[0]: r[2] for r in data}
    assert len({r.lang_pred for r in got}) == 100
    assert any(r.lang_pred == "l7" for r in got if of[r.doc_id] == "l7")


def test_path_lengths_by_recursion():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, quality.RATIOS))
    forest = quality.Forest(data, trees=20, tree_rows=64)

    def walk(tree, row, at=0):
        feature, cut, left, path = tree
        return path[at] if feature[at] < 0 else walk(tree, row, left[at] + (row[feature[at]] >= cut[at]))

    c = 2 * (math.log(63) + 0.5772156649) - 2 * 63 / 64
    want = [2 ** -(sum(walk(t, r) for t in forest.trees) / 20 / c) for r in data]
    assert np.allclose(forest.scores(data), want)


def test_repeated_lines_are_anomalous(docs, labels):
    model = quality.fit(docs, labels)
    lines = [f"{prose(i, 2)}" for i in range(100)]
    random.Random(3).shuffle(lines)
    repeated = quality.statistics("\n".join([*[prose(i, 2) for i in range(100)], *lines]).encode())
    clean = quality.statistics("\n".join(f"{prose(i, 12)}." for i in range(20)).encode())
    assert repeated[0][3] == 100
    a, b = model.scores(np.array([repeated[1], clean[1]]))
    flat = model.scores(np.array([[*repeated[1][:4], 0.0, 0.0]]))[0]
    assert a > b and a > flat


def test_licences_empty(empty):
    assert licences.licences(empty).count() == 0
