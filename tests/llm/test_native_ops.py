"""Mixing, quality rules and licence scans against brute force; they run no Python on executors."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feira.llm import licenses, mixing, quality

DOCS = "doc_id long, text string, source string, lang string, extra int"
LONG = "word " * 3000


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the cat {i} sat on the mat number {i} and then the dog came " * (1 + i % 4), f"s{i % 5}", "en", 1)
            for i in range(60)]
    rows += [(100, None, "s1", None, 2), (101, "", None, "en", 2), (102, LONG, "s0", "en", 2), (None, "no id here", "s2", "en", 2),
             (7, "the cat 7 again", "s2", "en", 2), (7, "the cat 7 again", "s2", "en", 2), (103, "x " * 40, None, "fr", 2)]
    return frame(spark, rows)


def brute_mix(rows):
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while free:  # reshare the excess until no source is above its cap
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.remove(s)
        left -= sum(target[s] for s in over)
    out = []
    for s in names:
        mine = [r for r in rows if r["source"] == s]
        key = {id(r): hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest() for r in mine}
        at, budget = 0, math.floor(target[s] + 1e-6)
        for r in sorted(mine, key=lambda r: (key[id(r)], r["doc_id"] is not None, r["doc_id"] or 0, len(words(r["text"])))):
            n = len(words(r["text"]))
            epochs, rest = divmod(budget, size[s]) if size[s] else (0, 0)
            out.append((r["doc_id"], n, size[s], round(target[s], 6), epochs * n + max(0, min(n, rest - at))))
            at += n
    return Counter(out)


def test_mix_equals_brute_force_and_any_partitioning(docs):
    rows = docs.collect()
    for n in (1, 7):
        got = mixing.mix(docs.repartition(n)).collect()
        assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix(rows)


def test_mix_budgets(docs):
    out = mixing.mix(docs)
    assert out.filter("taken > 3 * size").count() == 0
    per = (docs.select("doc_id", "source").distinct().join(out, "doc_id").groupBy("source")
           .agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).filter("source <> 's2'").collect())
    for r in per:
        assert r.source is None or abs(r.taken - r.target) <= 1


def test_mix_rows_keep_columns_and_clashing_names(spark, docs):
    odd = docs.withColumn("size", F.lit("x")).withColumn("taken", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3))
    out = mixing.mixed_rows(odd)
    assert out.columns == [*odd.columns, "mix_size", "mix_target", "mix_taken"]
    assert out.filter("mix_taken <= 0").count() == 0
    assert out.filter("size = 'x' AND taken = 1 AND row = 2 AND key = 3").count() == out.count() > 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert mixing.mix(none).count() == 0
    assert quality.quality(none).count() == 0
    assert quality.keep_good(none).count() == 0
    assert licenses.scan(none).count() == 0


def brute_base(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


TEXTS = [None, "", " \n\t ", "a b c d e a b c d e", "one two three four five six seven eight nine ten", LONG,
         "x\nx\n\n x\n  \nx y", "a b c d e f g a b c d e f g h", "#*$%&|<> é ü ñ 漢字 " * 12, "A\x0bB\x0cC\rD", "😀 😀 " * 30,
         "a " * 9, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q1 q2 q3 q4 q5"]


def test_quality_base_counts(spark):
    df = frame(spark, [(i, t, "s", "en" if i % 2 else None, 0) for i, t in enumerate(TEXTS)])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality.quality(df).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(TEXTS)}


def test_quality_rejects_junk_and_keeps_prose(spark):
    prose = [f"The cat number{i} sat on the mat and the dog{i} looked at it while rain{i} fell on the roof of house{i} "
             f"in the town, and then the man{i} came to see what the noise was about in the end." for i in range(40)]
    junk = " ".join(f"QX{i}$$$ ZW{i}%%%" for i in range(40))
    rows = [(i, t, "s", "en", 0) for i, t in enumerate(prose)] + [(99, junk, "s", "en", 0)]
    df = frame(spark, rows)
    kept = {r.doc_id for r in quality.quality(df).filter("kept").collect()}
    assert kept == set(range(40))
    out = quality.keep_good(df.withColumn("__extra", F.lit(1)))
    assert out.columns == [*df.columns, "__extra"] and {r.doc_id for r in out.collect()} == kept


def test_quality_without_languages(spark):
    df = frame(spark, [(1, "one two three four five six seven eight nine ten eleven", "s", None, 0)])
    assert quality.quality(df).first().kept


def lic_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_licence(text):
    w = lic_words(text)
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


LICENCES = [None, "", "CC BY cc by-cc/by", "This work is licensed under the GNU General Public License, version 3.",
            "Released under the MIT License.", "All rights reserved. ALL RIGHTS RESERVED", "all rights", "mit license is not here but mit",
            "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "general public licenses",
            "words " * 500 + "Released under the MIT License. " + "words " * 500 + "All rights reserved", "çc by cc bÿ"]


def test_licence_base_and_labels(spark):
    df = frame(spark, [(i, t, "s", None, 0) for i, t in enumerate(LICENCES)])
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(LICENCES):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[4].labels == "mit" and got[3].labels == "gpl" and got[9].labels == "apache"
    assert "cc-by-nc" in got[8].labels.split(",")
    assert got[11].labels == "mit,reserved" and got[7].labels == "" and got[0].score == 0


def test_licences_of_a_file_with_every_notice(spark):
    every = " ".join(f"{t}. some filler words between" for _, t, _ in licenses.TEMPLATES)
    four = " ".join(t for label, t, _ in licenses.TEMPLATES if label in ("bsd", "isc", "mit", "apache"))
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, [doc_row for doc_row in (
        (1, every, "s", None, 0), (2, four, "s", None, 0), (3, "nothing here", "s", None, 0))])).collect()}
    assert got[1] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert got[2] == "apache,bsd,isc,mit" and got[3] == ""


def brute_labels(text, postings):
    """(labels, score) by trying every segment at every place."""
    w, found = lic_words(text), {}
    for t, s in enumerate(licenses.SEGMENTS):
        rare = {k for k in postings if any(x == t for x, _ in postings[k])}
        for o in range(-len(s.words) + 1, len(w)):
            hit = [x for i, x in enumerate(s.words) if 0 <= o + i < len(w) and w[o + i] == x]
            votes = sum(x in rare for x in hit)
            key = all(0 <= o + s.place + i < len(w) and w[o + s.place + i] == x for i, x in enumerate(s.key))
            if (votes >= min(licenses.VOTES, len(rare)) and key and len(hit) >= licenses.COVER * len(s.words)
                    and (not s.alone or len(w) == len(s.words))):
                found[t] = max(found.get(t, 0), len(hit))
    labels, score = {x for x in brute_licence(text)[4].split(",") if x}, 0.0
    if labels:
        score = 1.0
    shares = []
    for licence, (label, _, _) in enumerate(licenses.TEMPLATES):
        own = [(t, s) for t, s in enumerate(licenses.SEGMENTS) if s.licence == licence]
        share = sum(found.get(t, 0) for t, _ in own) / sum(len(s.words) for _, s in own)
        if share >= licenses.SHARE and any(s.key and t in found for t, s in own):
            labels.add(label)
            shares.append(share)
    return ",".join(sorted(labels)), max(shares) if shares else score


def licence_files():
    rng = random.Random(3)
    whole = [t for _, t, _ in licenses.TEMPLATES]
    files = [*LICENCES, *whole, "MIT License", "The MIT License is not meant", "SPDX-License-Identifier: BSD-3-Clause", "BSD License\nCopyright 2020",
             "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}", "Mozilla Public License",
             "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             whole[0] + " " + whole[1], "x " * 3000 + whole[6] + " y" * 3000]
    for text in whole[:11]:
        for every in (9, 25, 40):  # a word changed, missing or put in every few words
            w = text.split()
            for i in range(rng.randrange(every), len(w), every):
                w[i] = rng.choice(["", "other", w[i] + " new"])
            files.append("Copyright 2021 Some Body\n" + " ".join(w))
    return files


def test_licence_labels_and_score_by_brute_force(spark):
    files = licence_files()
    df = frame(spark, [(i, t, "s", None, 0) for i, t in enumerate(files)])
    _, postings = licenses.build_index(licenses.document_frequencies(df), len(files))
    for r in licenses.scan(df).collect():
        labels, score = brute_labels(files[r.doc_id], postings)
        assert (r.labels, round(r.score, 12)) == (labels, round(score, 12)), files[r.doc_id]


def test_licences_named_tagged_and_edited(spark):
    text = dict((label, t) for label, t, _ in reversed(licenses.TEMPLATES[:11]))
    words = {k: t.split() for k, t in text.items()}
    edited = {k: " ".join([*w[:3], "inserted", *w[3:]]) for k, w in words.items()}
    files = {"MIT License": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "# SPDX-License-Identifier: Apache-2.0": "apache",
             "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
             "You may use it under the ISC license": "isc", **{t: k for k, t in text.items()}, **{t: k for k, t in edited.items()}}
    df = frame(spark, [(i, t, "s", None, 0) for i, t in enumerate(files)])
    for r in licenses.scan(df).collect():
        assert list(files.values())[r.doc_id] in r.labels.split(","), (r, list(files)[r.doc_id])


def test_native_plans_have_no_python(docs):
    for df in (mixing.mix(docs), quality.quality(docs), licenses.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowColumnVector", ""))
