"""Null, repeated and text ids, clashing column names, shared wording, small languages, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feira.llm import decontaminate, langid, licenses, mixing, near_dup, queries, quality, rollup, toxicity
from feira.llm._store import scratch
from feira.llm.oracle import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["__node", "__n", "__id", "__kept", "__t", "__words", "__pass", "__leak", "mix_size", "row", "id", "t", "node", "leak", "hash",
            "tree", "size", "target", "taken", "name", "key", "range", "best", "comp", "place", "y"]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def english(seed, n):
    r = random.Random(seed)
    common = "the of and to in a is that it was for on are with as his they at be this".split()
    return " ".join(r.choice(common) if r.random() < 0.5 else "word" + str(r.randrange(900)) for _ in range(n))


def german(seed, n):
    r = random.Random(seed)
    common = "der die und in den von zu das mit sich des auf nicht ein eine als auch es an werden".split()
    return " ".join(r.choice(common) if r.random() < 0.5 else "Wort" + str(r.randrange(900)) for _ in range(n))


# --- quality ---------------------------------------------------------------------------------

def test_clean_texts_of_a_small_language_are_kept(spark):
    rows = [(i, english(i, 2000), "en", "s", None) for i in range(200)]
    rows += [(1000 + i, german(i, 60), "de", "s", None) for i in range(10)]  # 600 words, under 1% of all
    rows += [(2000, german(77, 60), "nl", "s", None), (2001, german(78, 60), None, "s", None)]  # no reference; no language
    out = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    assert all(out[1000 + i] for i in range(10)) and out[2000]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas())
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, kept FROM ({ORACLE['op6_quality']})").fetchall()}
    assert out == want


def test_own_reference_of_a_small_language_judges(spark):
    rows = [(i, english(i, 2000), "en", "s", None) for i in range(200)] + [(500 + i, german(i, 90), "de", "s", None) for i in range(12)]
    rows += [(900, " ".join(f"zq{k}x" for k in range(80)), "de", "s", None)]
    out = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    assert all(out[500 + i] for i in range(12)) and not out[900]


# --- language identification -----------------------------------------------------------------

def test_null_and_repeated_ids_train(spark):
    rows = [(None, (english if i % 2 else german)(i, 30), "en" if i % 2 else "de", "s", None) for i in range(600)]
    rows += [(7, english(9000 + i, 30), "en", "s", None) for i in range(50)] + [(8, None, "en", "s", None), (9, "1 2 3", "de", "s", None)]
    out = langid.identify(frame(spark, rows), F.lit(False)).collect()
    assert Counter(r.lang_pred for r in out if r.doc_id == 7) == {"en": 50}
    assert Counter(r.lang_pred for r in out if r.doc_id is None)["und"] == 0
    assert {r.lang_pred for r in out if r.doc_id in (8, 9)} == {"und"}


def test_language_and_toxicity_of_nothing(spark):
    empty = frame(spark, [])
    assert langid.identify(empty, F.lit(False)).collect() == []
    assert [r.lang_pred for r in langid.identify(frame(spark, [(1, "some text", None, "s", None)]), F.lit(False)).collect()] == ["und"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled(empty, toxicity.grades_of(labels)))
    assert toxicity.without_toxic(empty, model).count() == 0


# --- decontamination -------------------------------------------------------------------------

def sentences(seed, n):
    r = random.Random(seed)
    return [f"v{r.randrange(9000)}" for _ in range(n)]


def test_shared_instructions_are_no_leak(spark):
    instruction = sentences(1, 18)
    items = [(i, " ".join(instruction + sentences(100 + i, 22))) for i in range(60)]
    docs = [(i, " ".join(sentences(500 + i, 40) + instruction + sentences(900 + i, 40)), "en", "s", None) for i in range(40)]
    docs += [(99, " ".join(sentences(3, 30)) + " " + items[17][1], "en", "s", None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, docs), bench).collect()}
    assert found == {(99, 17)}
    assert {r.doc_id for r in decontaminate.without_leaks(frame(spark, docs), bench).collect()} == set(range(40))
    only = spark.createDataFrame([(i, " ".join(instruction)) for i in range(5)] + [(9, " ".join([*instruction, "more"]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(frame(spark, docs[:1]), only).collect()} == {0}  # nothing else to go by


def test_leaks_are_decided_by_text_whatever_the_id(spark):
    leak, clean = " ".join(sentences(5, 60)), " ".join(sentences(6, 60))
    bench = spark.createDataFrame([("i-1", leak)], "item_id string, text string")
    docs = [("q-1", leak), ("q-2", clean), (None, leak), ("x", leak), ("x", clean), ("y", None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()} == {("q-1", "i-1"), (None, "i-1"), ("x", "i-1")}
    left = sorted(((r.doc_id, r.text) for r in decontaminate.without_leaks(df, bench).collect()), key=str)
    assert left == sorted([("q-2", clean), ("x", clean), ("y", None), (None, "")], key=str)
    long = " ".join(sentences(8, 120_000)) + " " + leak
    assert decontaminate.matches(spark.createDataFrame([("l", long)], "doc_id string, text string"), bench).count() == 1


# --- token counts ----------------------------------------------------------------------------

def test_token_rollup_equals_counts_over_rows(spark, tmp_path):
    texts = ["alpha beta gamma", "delta, epsilon!", "", "zeta eta theta iota"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[3]), (3, texts[3]), (None, texts[3]), (4, None), (5, texts[2]), (None, texts[1])]
    docs = frame(spark, [(i, t, "en" if k % 2 else None, f"s{k % 3}", None) for k, (i, t) in enumerate(rows)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.bytes) for r in queries.op4_token_rollup(spark, str(tmp_path)).collect()}
    with open(queries.VOCABULARY, "rb") as f:
        count = rollup.bpe_counter(f.read(), queries.PATTERN)
    best = {}
    for k, (i, t) in enumerate(rows):
        best.setdefault(t or "", []).append((i is not None, i or 0, k))
    kept = {min(v)[2] for v in best.values()}
    want = {}
    for k, (i, t) in enumerate(rows):
        if k in kept:
            t = t or ""
            bpe, words = int(count(pa.array([t]))[0]), len(re.findall(r"[^\W_]+", t))
            for name, n in (("byte_bpe_50k/1", bpe), ("words/2", words)):
                old = want.get((f"s{k % 3}", "en" if k % 2 else None, name), (0, 0, 0))
                want[(f"s{k % 3}", "en" if k % 2 else None, name)] = (old[0] + 1, old[1] + n, old[2] + len(t.encode()))
    assert {k: v for k, v in got.items() if v != (0, 0, 0)} == want


# --- mixing ----------------------------------------------------------------------------------

def test_rows_without_an_id_spread_over_places(spark):
    rows = [(None, english(i, 12 + i % 3), "en", "a", None) for i in range(1000)] + [(i, english(i, 5), "en", "a", None) for i in range(50)]
    df = frame(spark, rows)
    out = mixing.mix(df)
    total = out.agg(F.sum("taken"), F.max("target")).first()
    assert total[0] == total[1] == sum(len(r[1].split()) for r in rows)
    keyed = df.select("doc_id", mixing.word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit("mix:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit("")))).alias("key"), F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(mixing.SPREAD))).alias("spread"))
    placed = mixing.ranged(keyed, hashlib.md5(b"mix:").hexdigest())
    assert placed.groupBy(*mixing.PLACE).count().agg(F.max("count")).first()[0] < 40
    order = [(r.key, r.doc_id is not None, r.doc_id or 0, r["size"]) for r in placed.orderBy(*mixing.PLACE, "key", "doc_id", "size").collect()]
    assert order == sorted(order)


# --- every stage -----------------------------------------------------------------------------

@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_column_name_and_id(spark, sf_small, name, stage):
    rows = [(i if i % 3 else None, english(i % 40, 60 + i % 5), "en", f"s{i % 2}", i) for i in range(80)]
    rows += [(5, None, None, None, None), (5, "", "en", "s0", None), (None, None, None, None, None), (5, german(3, 60), "de", "s1", 1)]
    df = frame(spark, rows).withColumns({c: F.lit(f"kept {c}") for c in CLASHING})
    path = scratch(spark, f"clash-{name}")
    stage(spark, df, sf_small).write.parquet(path)
    out = spark.read.parquet(path)
    assert out.columns[:len(df.columns)] == df.columns and 0 < out.count() <= len(rows)
    assert all(out.filter(F.col(f"`{c}`") != f"kept {c}").count() == 0 for c in CLASHING[:4] + ["mix_size"])
    nothing = stage(spark, df.limit(0), sf_small)
    assert nothing.count() == 0 and nothing.columns[:len(df.columns)] == df.columns


def test_queries_take_clashing_names(spark):
    rows = [(i, english(i, 40), "en", "s", None) for i in range(30)] + [(1, None, None, None, None), (None, english(3, 40), "en", "s", None)]
    plain, clash = frame(spark, rows), frame(spark, rows).withColumns({c: F.lit("x") for c in CLASHING})

    def same(op):
        assert Counter(map(str, op(plain).collect())) == Counter(map(str, op(clash).collect()))

    same(near_dup.near_duplicates)
    same(quality.quality)
    same(licenses.scan)
    same(mixing.mix)
    same(lambda d: langid.identify(d, queries.crc_is_2("doc_id", 4)))


def test_equal_texts_are_drawn_once_and_ties_stay_exact(spark):
    rows = [(i, english(i % 7, 50), "en", "s", None) for i in range(300)]
    out = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {r.class_id for r in out} == set(range(7)) and all(r.class_id == r.doc_id % 7 for r in out)


def test_recall_of_near_duplicates_by_edit_rate(spark):
    """Pairs of 200 words with some words replaced, at a plain similarity of 0.8 or more: at least 0.9 are found."""
    r, rows, want = random.Random(6), [], []
    for g in range(120):
        base = [f"w{r.randrange(6000)}" for _ in range(200)]
        other = list(base)
        for _ in range(g % 5):
            other[r.randrange(200)] = f"x{r.randrange(10 ** 6)}"
        rows += [(2 * g, " ".join(base), "en", "s", None), (2 * g + 1, " ".join(other), "en", "s", None)]
        a, b = ({tuple(w[i:i + 5]) for i in range(196)} for w in (base, other))
        if len(a & b) >= 0.83 * len(a | b):
            want.append(g)
    cls = {x.doc_id: x.class_id for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    found = [g for g in want if cls[2 * g + 1] == 2 * g]
    assert len(want) > 60 and len(found) >= 0.9 * len(want)
