import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import fixtures
from tideline.llm import decontaminate, licenses, secrets, toxicity

LETTER = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(LETTER, lower(text or ""))


def joined_hash(values):
    return hashlib.sha256(",".join(values).encode()).hexdigest()


# -- secrets


def plain_spans(text):
    out = [("assign", m.start(), m.end(), m[2]) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[1], rank[x[0]]))


def plain_loose(text, base):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_-]+={0,2}", text):
        v = m[0]
        if len(v) < 20 or len(re.findall("[0-9]", v)) < 3 or not re.search("[a-z]", v) or not re.search("[A-Z]", v):
            continue
        if -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) < 3.5:
            continue
        if all(m.end() <= a or b <= m.start() for _, a, b, _ in base):
            out.append(("owned", m.start(), m.end(), v))
    return out


def test_secrets(spark):
    rows = fixtures.rows()
    got = secrets.scan_secrets(fixtures.frame(spark), repo="concat_ws('/', source, lang)", owner="source")
    owners, want = defaultdict(set), Counter()
    for r in rows:
        base = plain_spans(r[1] or "")
        for x in base + plain_loose(r[1] or "", base):
            owners[x[3]].add(r[3])
    for r in rows:
        base = plain_spans(r[1] or "")
        more = [x for x in plain_loose(r[1] or "", base) if len(owners[x[3]]) == 1]
        spans = sorted(base + more, key=lambda x: (x[1], ["assign", "access", "hex", "owned"].index(x[0])))
        count = Counter(x[0] for x in base)
        name = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in xs)
        want[r[0], count["assign"], count["access"], count["hex"], joined_hash([name(base)]), name(spans)] += 1
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert sum(r["n_assign"] for r in got.collect()) and sum(r["n_hex"] for r in got.collect())
    assert secrets.scan_secrets(fixtures.empty(spark), repo="source", owner="source").collect() == []


def test_ownership_counts(spark):
    found = spark.createDataFrame([("h", o, r) for o, r in [("a", "a/1"), ("a", "a/2"), ("a", "a/2"), ("b", "b/1"), (None, None)]], "hash string, owner string, repo string")
    assert [tuple(r) for r in secrets.ownership(found).collect()] == [("h", 5, 4, 3)]


def test_copied_loose_values_are_counted(spark):
    value, live = "Q7xK9mP2vT4wZ8nR5bY3cL", "aB3dE6gH9jK2mN5pQ8sT1vW4"
    rows = [(k, f"see {value} here" + f" {live}" * (k == 0), "en", f"src{k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["spans"], r["n_owned"], r["n_owner_specific"], r["n_copied"]) for r in secrets.scan_secrets(docs, repo="source", owner="source").collect()}
    assert got == {0: (f"owned:32:{32 + len(live)}", 1, 1, 1), 1: ("", 0, 0, 1), 2: ("", 0, 0, 1)}


def test_padded_loose_values_need_no_other_run(spark):
    values = ["Q7xK9mP2vT4wZ8nR5b==", "aB3dE6gH9jK2mN5pQ8s=", "Q7xK9mP2vT4wZ8nR5==", "aB3dE6gH9jK2mN5pQ8"]
    rows = [(k, f"({v})", "en", f"src{k}") for k, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs, repo="source", owner="source").collect()}
    assert got == {0: "owned:1:21", 1: "owned:1:21", 2: "", 3: ""}


# -- benchmark decontamination


ITEMS = [(1, "one two three"), (2, None), (3, ""), (4, "!!"), (10, "solo"), (11, "solo"), (12, "b a b a b a b a b a b a b"), (None, "an item without id yet long enough to have one window of ten words")]


def plain_match(texts, items, window=10):
    out = []
    for t in texts:
        words, hit, seen = words_of(t), set(), set()
        for i, item in items:
            own = words_of(item)
            size = min(window, len(own))
            for k in range(len(own) - size + 1) if own else ():
                for a in range(len(words) - size + 1):
                    if words[a : a + size] == own[k : k + size]:
                        hit.update(range(a, a + size))
                        seen.add("" if i is None else str(i))
        out.append((len(words), len(hit), len(seen), joined_hash(sorted(seen)), bool(hit)))
    return out


@pytest.mark.parametrize("shard_words,group_bytes", [(100_000, 64_000_000), (20, 64_000_000), (20, 12_000)])
def test_decontamination(spark, shard_words, group_bytes):
    rows = [r for r in fixtures.rows() if len(r[1] or "") < 20_000]
    items = [*ITEMS, *((100 + k, " ".join((rows[20 + k][1] or "").split()[3:40])) for k in range(5))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    docs = spark.createDataFrame([*rows, *((900 + k, f"x {t} ONE two\nthree! solo b a b a b a b a b a b", *rows[0][2:]) for k, (_, t) in enumerate(items))], fixtures.SCHEMA)
    got = decontaminate.match_items(docs, benchmark, shard_words=shard_words, group_bytes=group_bytes, keep=["doc_id"]).collect()
    _, groups = decontaminate.write_automata(benchmark, "item_id", "text", 10, shard_words, group_bytes)
    assert (len(groups) > 1) == (group_bytes < 64_000_000) and (sum(map(len, groups)) > 1) == (shard_words == 20)
    given = docs.collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(given, plain_match([r["text"] for r in given], items)))
    assert Counter(map(tuple, got)) == want
    assert any(r["contaminated"] for r in got)
    assert decontaminate.match_items(fixtures.empty(spark), benchmark, keep=["doc_id"]).collect() == []
    none = decontaminate.match_items(docs, benchmark.limit(0), keep=["doc_id"]).collect()
    assert len(none) == len(given) and not any(r["contaminated"] for r in none)


def test_long_texts_and_items_are_matched_whole(spark):
    """Items longer than a piece, and texts longer than a stride, with hits over the edges of both."""
    rng = np.random.default_rng(3)
    spell = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 40, n))
    items = [(k, spell(n)) for k, n in enumerate((1500, 300, 9, 4))]
    texts = [f"{spell(700)} {' '.join(items[0][1].split()[40:1300])} {spell(5)} {items[2][1]} {items[3][1]}", items[1][1], spell(2000)]
    docs = spark.createDataFrame([*enumerate(texts), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for group_bytes in (64_000_000, 12_000):
        got = {r[0]: tuple(r)[1:] for r in decontaminate.match_items(docs, benchmark, shard_words=400, group_bytes=group_bytes, keep=["doc_id"]).collect()}
        assert got == dict(enumerate(plain_match([*texts, None], items))) and got[0][1] >= 1260
        cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, benchmark, shard_words=400, group_bytes=group_bytes, most_coverage=2.0).collect()}
        assert set(cut) == {0, 1, 2, 3} and cut[1] == "" and len(words_of(cut[0])) == got[0][0] - got[0][1]


def test_kept_columns_may_be_called_as_results(spark):
    docs = spark.createDataFrame([(1, "text", 5, "x")], "doc_id long, text string, n_words long, spans string")
    benchmark = spark.createDataFrame([(1, "text")], "item_id long, text string")
    got = decontaminate.match_items(docs, benchmark, with_spans=True).first()
    assert (got["n_words_given"], got["n_words"], got["spans_given"], got["spans"][0]["end"], got["text"]) == (5, 1, "x", 4, "text")
    graded = spark.createDataFrame([(1, "text", True)], "doc_id long, text string, toxic boolean")
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([50.0, 51, 52]))
    assert toxicity.grade_texts(graded, model, keep=["doc_id", "toxic"]).columns[:3] == ["doc_id", "toxic_given", "toxic"]


def test_automata_of_a_million_words_fit_a_worker():
    rng = np.random.default_rng(9)
    size = 0
    for k in range(10):
        words = [b"w%d" % w for w in rng.zipf(1.3, 100_000) % 50_000]
        raw = decontaminate.SuffixAutomaton.built([(str(k * 2000 + a), words[a : a + 50]) for a in range(0, 100_000, 50)], 10).packed()
        size += len(raw)
    assert size < 150_000_000


def test_remove_spans(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    clean = "nothing here is in any test item at all and it goes on"
    docs = spark.createDataFrame([(1, f"{clean} {passage.upper()}! {clean}", 0, "c"), (2, passage, 0, "c"), (3, clean, 7, "c"), (4, None, None, "c")], "doc_id long, text string, n_chars long, c0 string")
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.remove_spans(docs, benchmark, length_column="n_chars").collect()}
    assert set(out) == {1, 3, 4}
    assert out[1]["text"] == f"{clean} ! {clean}" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[3]["text"] == clean and out[3]["n_chars"] == 7 and out[4]["text"] is None


# -- licenses


def plain_license(text, templates=licenses.TEMPLATES, containment=0.9):
    text = text or ""
    words = words_of(text)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(a, label) for a in range(len(words)) if words[a : a + len(p)] == p]
    labels, score, blocks = {x for _, x in places}, 1.0 if places else 0.0, 0
    for line in text.split("\n"):
        own, hit = set(words_of(line)), False
        for label, ts in templates.items():
            for t in ts:
                w = set(words_of(t))
                if len(own & w) >= math.ceil(containment * len(w) - 1e-9):
                    labels.add(label)
                    score, hit = max(score, len(own & w) / len(w)), True
        blocks += hit
    at = [a for a, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score, blocks


def test_licenses(spark):
    rng = np.random.default_rng(4)
    rows = fixtures.rows()
    for k, t in enumerate([t for ts in licenses.TEMPLATES.values() for t in ts]):
        words = t.split()
        for drop in range(4):
            keep = [w for i, w in enumerate(words) if i not in set(rng.permutation(len(words))[:drop].tolist())]
            rows.append((1000 + 10 * k + drop, f"first line\n{' '.join(rng.permutation(keep))} and more words\nlast", *rows[0][2:]))
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter((r[0], *plain_license(r[1])) for r in rows)
    assert licenses.scan_licenses(fixtures.empty(spark)).collect() == []


def plain_wrapped(text, templates=licenses.TEMPLATES, containment=0.9):
    """As plain_license, with windows over line ends: every run of a template's length / containment words."""
    out = list(plain_license(text, templates, containment))
    words = [(w, k) for k, line in enumerate((text or "").split("\n")) for w in words_of(line)]
    labels, covered = set(out[5].split(",")) - {""}, set()
    for label, ts in templates.items():
        for t in ts:
            size, own = math.ceil(len(words_of(t)) / containment - 1e-9), set(words_of(t))
            need = math.ceil(containment * len(own) - 1e-9)
            full = {k for k in {k for _, k in words} if len(own & {w for w, j in words if j == k}) >= need}
            for a in range(len(words)):
                window = words[a : a + size]
                if len(common := own & {w for w, _ in window}) >= need:
                    labels.add(label)
                    out[6] = max(out[6], len(common) / len(own))
                rest = [a + i for i, (w, k) in enumerate(window) if w in own and k not in full]
                if len({words[i][0] for i in rest}) >= need:
                    covered.update(("in", i) for i in range(rest[0], rest[-1] + 1))
                    covered.update(("joined", i) for i in range(rest[0], rest[-1]))
    inside = [i for kind, i in covered if kind == "in"]
    out[7] += sum(("joined", i - 1) not in covered for i in inside)
    out[5] = ",".join(sorted(labels))
    return tuple(out)


WRAPPED = {
    "mit": "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files\n */\nint x;",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n",
    "lgpl": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at */",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\n\npurpose with or without fee is hereby granted, provided that",
    "gpl": "dnl This program is free software: you can redistribute it and/or modify\ndnl it under the terms of the GNU General Public License as published by",
}


def test_wrapped_licenses(spark):
    rng = np.random.default_rng(5)
    rows = list(WRAPPED.items())
    rows += [(f"{a} {b}", WRAPPED[a] + "\n" + WRAPPED[b]) for a in WRAPPED for b in WRAPPED]
    for k, t in enumerate([t for ts in licenses.TEMPLATES.values() for t in ts]):
        for drop in range(4):
            gone = set(rng.permutation(len(t.split()))[:drop].tolist())
            cut = [w + ("\n * " if rng.random() < 0.3 else " ") for i, w in enumerate(t.split()) if i not in gone]
            rows += [(f"{k} {drop}", "".join(cut)), (f"{k} {drop} twice", f"x {t}\n{''.join(cut)}\n\n{''.join(cut)} {t}"), (f"{k} {drop} far", ("many other words " * 3).join(cut))]
    got = {r[0]: tuple(r)[1:] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    for label in WRAPPED:
        assert label in got[label][5].split(",") and got[label][6] >= 0.9 and got[label][7] == 1
    assert got == {k: plain_wrapped(t) for k, t in rows}


# -- toxicity


def test_toxicity_held_out(spark):
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    held = toxicity.grade_texts(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F_toxic(labels)), "doc_id").collect()
    right = sum(bool(r["toxic"]) == bool(r["label"]) for r in held) / len(held)
    found = sum(r["toxic"] for r in held if r["label"]) / max(1, sum(bool(r["label"]) for r in held))
    assert right >= 0.9 and found >= 0.6  # 200 labelled rows to learn from


def F_toxic(labels):
    return labels["toxic"].alias("label")


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(10, 60)] + [(None, 1, None), (11, None, None)], "doc_id long, toxic int, text string")
    model = toxicity.train(fixtures.frame(spark), labels, per_class=20)
    rows = toxicity.grade_texts(fixtures.frame(spark), model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in fixtures.rows())
    assert all(0 <= r["expected_severity"] <= 3 and 0 <= r["grade"] <= 3 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in rows)
    none = toxicity.train(fixtures.frame(spark), labels.limit(0))
    assert not any(r["toxic"] for r in toxicity.grade_texts(fixtures.frame(spark), none).collect())
    assert toxicity.grade_texts(fixtures.empty(spark), model).collect() == []
    kept = toxicity.without_toxic(fixtures.frame(spark), model)
    assert kept.columns == fixtures.COLUMNS and kept.count() == sum(not r["toxic"] for r in rows)


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    x, grade = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        x.append(np.unique(np.concatenate([rng.integers(4, 30, 5), np.arange(g)])))
        grade.append(g)
    weights, thresholds = toxicity.fit_ordinal(x, np.array(grade), 30, 4)
    score = np.array([weights[f].sum() for f in x])
    guess = (score[:, None] > thresholds[None, :]).sum(1)
    assert (guess == np.array(grade)).mean() > 0.9 and (np.diff(thresholds) > 0).all()
