"""Operators that run Python inside tasks, against brute force, round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feira.llm import chat, ctw, decontaminate, langid, near_dup, rollup, toxicity
from feira.llm.queries import PATTERN, VOCABULARY, crc_is_2

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None)


def prose(seed, n=80):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


# --- near duplicates -------------------------------------------------------------------------

def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    df = Counter(s for x in sets for s in x)
    n = max(sum(bool(x) for x in sets), 2)
    weight = [{s: (1 + math.log(k)) * (1 + near_dup.IDF_STRENGTH * (1 - min(math.log(df[s]) / math.log(n), 1)))
               for s, k in x.items()} for x in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = weight[i], weight[j]
            if a and b:
                shared = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
                if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared) - 1e-9:
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark):
    rows, i = [], 0
    for g in range(12):
        base = prose(g)
        for c in range(1 + g):
            w = list(base)
            for _ in range(c % 5):
                w[random.Random(g * 100 + c).randrange(len(w))] = f"edit{g}-{c}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(500, "a b"), (501, "A  b"), (502, "a b c"), (503, None), (504, ""), (505, " \n"), (506, " ".join(prose(99, 4000))),
             (507, " ".join(prose(99, 4000))), (508, " ".join([*prose(99, 4000)[:3900], *prose(7, 100)]))]
    got = {r.doc_id: r for r in near_dup.near_duplicates(frame(spark, [doc(a, b) for a, b in rows])).collect()}
    want = brute_classes(rows)
    assert {k: v.class_id for k, v in got.items()} == want
    assert all(v.is_kept == (k == v.class_id) for k, v in got.items())


def test_near_duplicates_hot_group_is_one_class(spark):
    base = prose(1, 120)
    rows = []
    for i in range(700):
        w = list(base)
        w[i % 120] = f"e{i}"
        rows.append(doc(i, " ".join(w)))
    rows += [doc(1000 + i, " ".join(prose(2 + i, 60) + base[:40])) for i in range(300)]  # a shared passage, no duplicates
    out = near_dup.near_duplicates(frame(spark, rows))
    assert out.filter("doc_id < 1000").select("class_id").distinct().count() == 1
    assert out.filter("doc_id >= 1000 AND class_id <> doc_id").count() == 0


def test_deduplicate_keeps_one_of_each(spark):
    a, b = " ".join(prose(1)), " ".join(prose(2))
    df = frame(spark, [doc(3, a), doc(1, a), doc(2, b), doc(2, b), doc(None, "free text here"), doc(5, None), doc(6, "")])
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in near_dup.deduplicate(df.withColumn("node", F.lit(1))).collect())
    assert kept == [-1, 1, 2, 5, 6]
    assert near_dup.deduplicate(frame(spark, [])).count() == 0


def test_deduplicate_decides_on_rows_not_on_ids(spark):
    a, b, c = (" ".join(prose(k)) for k in (1, 2, 3))
    df = frame(spark, [doc(1, a), doc(2, a), doc(2, b), doc(None, a), doc(None, a), doc(None, c), doc(None, c), doc(None, ""), doc(None, None),
                       doc(7, ""), doc(7, ""), doc(7, c + " x")])
    kept = sorted((r.doc_id or -1, r.text or "") for r in near_dup.deduplicate(df).collect())
    assert kept == sorted([(1, a), (2, b), (-1, ""), (-1, ""), (7, ""), (7, c + " x")])


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 1 << 48, 200, dtype=np.uint64))
    w = rng.uniform(1, 3, 200)
    a, b = np.arange(150), np.arange(20, 200)
    drawn = near_dup.Sampler(samples=3000)(np.r_[h[a], h[b]], np.r_[np.zeros(150, int), np.ones(180, int)], np.r_[w[a], 1.2 * w[b]], 2)
    x, y = np.zeros(200), np.zeros(200)
    x[a], y[b] = w[a], 1.2 * w[b]
    assert abs((drawn[0] == drawn[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.03


# --- decontamination -------------------------------------------------------------------------

ITEM = "If a train travels 120 km in 2 hours while Alice drives 80 km in 2 hours how much faster is the train"


@pytest.fixture(scope="module")
def leaks(spark):
    docs = frame(spark, [
        doc(1, "Some words before. " + ITEM + " and words after it."),
        doc(2, ITEM.replace("120", "300").replace("80", "90").replace("2 hours", "5 hours").replace("Alice", "Maria")),
        doc(3, ITEM.replace("in 2 hours while", "in 2 hours while").replace("80 km in 2 hours", "80 km in 7 hours")),  # 2 -> 2 and 7
        doc(4, "a clean text about trains that travel and people who drive faster than they should in the rain"),
        doc(5, None), doc(6, ""), doc(7, "word " * 5000 + ITEM), doc(8, "red green blue seven"), doc(None, ITEM)])
    bench = spark.createDataFrame([(10, ITEM), (11, "red green blue seven"), (12, None), (13, "too short")], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}


def test_copies_and_reparameterised_items_are_found(leaks):
    assert set(leaks) == {(1, 10), (2, 10), (7, 10), (8, 11), (None, 10)}
    assert leaks[1, 10].changed == 0 and leaks[2, 10].changed > 0 and leaks[2, 10].windows == leaks[2, 10].item_windows


def test_edited_copies_and_excerpts_are_found(spark):
    w = ITEM.split()
    long = prose(3, 120)
    bench = spark.createDataFrame([(10, ITEM), (20, " ".join(prose(4, 38))), (30, " ".join(long)),
                                   (40, " ".join(prose(6, 18)))], "item_id long, text string")
    half = prose(4, 38)
    changed = ITEM.replace("120", "300").replace("80", "90").replace("2 hours", "5 hours").replace("Alice", "Maria").split()
    docs = frame(spark, [
        doc(1, " ".join([*half[:19], "indeed", *half[19:]])), doc(2, " ".join([*half[:18], *half[19:]])),
        doc(3, " ".join([*half[:19], "one", "two", "three", "four", "five", "six", *half[19:]])),
        doc(4, " ".join([*changed[:15], "then", *changed[15:]])),
        doc(5, " ".join([*prose(50, 30), *long[40:53], *prose(51, 30)])), doc(6, " ".join([*prose(50, 30), *long[40:52], *prose(51, 30)])),
        doc(7, " ".join([*half[19:], *prose(52, 400), *half[:12]])),
        doc(8, " ".join([*w[:15], "then", *w[15:]]).replace("80 km in then 2", "80 km in then 7")),  # 2 -> 2 and 7
        doc(9, " ".join([*half[:19], "indeed", *half[19:]]) + " " + " ".join(prose(60, 200)) + " " + " ".join(half)),
        doc(11, " ".join([*prose(6, 18)[:9], "indeed", *prose(6, 18)[9:]]))])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 20), (2, 20), (3, 20), (4, 10), (5, 30), (7, 20), (9, 20), (11, 40)}
    assert got[1, 20].windows == 24 and got[9, 20].windows == 31 == got[9, 20].item_windows and got[4, 10].changed > 0


def test_names_numbers_and_other_case_are_found(spark):
    names = " ".join(f"{a} {b}" for a, b in zip("Anna Berta Carla Dora Emil Franz Gerd Hans".split(), "Maier Schulz Weber Koch Braun Wolf Neumann Vogel".split()))
    table = " ".join(str(1000 + 37 * i) for i in range(20))
    mixed = "when Alice Smith and Robert Jones met Carol White in Paris they sold Peter Green and Anna Black nine cars for Henry Ford"
    bench = spark.createDataFrame([(1, "list " + names), (2, table), (3, mixed), (4, "Total 55 17 91 2024")], "item_id long, text string")
    docs = frame(spark, [doc(1, "before list " + names + " after"), doc(2, "see " + table + " there"), doc(3, mixed.lower()),
                         doc(4, "x " + mixed.upper() + " y"), doc(5, "x total 55 17 91 2024 y"), doc(6, " ".join(str(7 * i) for i in range(40))),
                         doc(7, "list " + " ".join(reversed(names.split())))])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 4)}
    assert all(r.changed == 0 and r.windows == r.item_windows for r in got.values())


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert decontaminate.matches(frame(spark, []), bench).count() == 0
    docs = frame(spark, [doc(1, ITEM)])
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).columns == docs.columns


# --- context-tree weighting ------------------------------------------------------------------

def brute_ctw(train, score):
    depth = ctw.DEPTH
    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def symbols(t):
        b = b"\0" * depth + t.encode() + b"\0"
        return [(b[i - depth:i], b[i]) for i in range(depth, len(b))]

    for t in train:
        for c, x in symbols(t):
            for k in range(8):
                heap = (1 << k) | (x >> (8 - k))
                for d in range(depth + 1):
                    counts[c[depth - d:], heap][x >> (7 - k) & 1] += 1
                    if d < depth:
                        kids[c[depth - d:], heap].add((c[depth - d - 1:], heap))

    def pe(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    def pw(s):
        own = pe(counts[s])
        return own if len(s[0]) == depth else np.logaddexp(own, sum(pw(z) for z in kids[s])) - math.log(2)

    def p(c, x):
        total = 0.0
        for k in range(8):
            heap, bit, q = (1 << k) | (x >> (8 - k)), x >> (7 - k) & 1, None
            for d in range(depth, -1, -1):
                s = (c[depth - d:], heap)
                n = counts.get(s, [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                share = 1 / (1 + math.exp(sum(pw(z) for z in kids.get(s, ())) - pe(n)))
                q = own if d == depth else share * own + (1 - share) * q
            total += math.log10(q)
        return total

    return [sum(p(c, x) for c, x in symbols(t)) for t in score]


TRAIN, TEST = ["abab abab", "abba", "bbbb a", "é\x00é"], ["abc ab", "zz", "", "abab"]


@pytest.mark.parametrize("head", [(1 << 20, 1 << 18), (4, 2), (0, 0)])
def test_ctw_equals_brute_force_whatever_is_broadcast(spark, monkeypatch, head):
    monkeypatch.setattr(ctw, "HEAD", head[0])
    monkeypatch.setattr(ctw, "HEAD_WORDS", head[1])
    rows = [doc(i, t) for i, t in enumerate(TRAIN + TEST)] + [doc(99, None)]
    out = {r.doc_id: r for r in ctw.score(frame(spark, rows), F.col("doc_id") >= len(TRAIN)).collect()}
    want = brute_ctw(TRAIN, TRAIN + TEST)
    for i, w in enumerate(want):
        assert abs(out[i].score - w) < 1e-9
    c = Counter(x for t in TRAIN for x in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TRAIN + TEST):
        tokens = [*t.split(), None]
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert abs(out[i].base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)) < 1e-9
    assert out[99].n_tokens == 1 and abs(out[99].score - want[len(TRAIN) + 2]) < 1e-9


def test_ctw_of_empty_table(spark):
    assert ctw.score(frame(spark, []), F.lit(False)).count() == 0


# --- rollups ---------------------------------------------------------------------------------

def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rows = "source string, lang string, tokenizer string, tokens long, bytes long"
    a = spark.createDataFrame([("x", "en", "v1", 5, 10), ("x", "en", "v1", 7, 20), (None, None, "v1", 1, 1)], rows)
    totals = rollup.Rollup(spark, str(tmp_path / "t"))
    assert totals.totals().count() == 0
    assert totals.commit("b1", rollup.signed(a, 1)) and not totals.commit("b1", rollup.signed(a, 1))
    totals.commit("b2", rollup.signed(a.limit(1), -1))
    totals.commit("b3", rollup.revised(a.filter("tokens = 7"), a.filter("tokens = 7").withColumn("tokens", F.lit(9).cast("long"))))
    totals.commit("b4", rollup.signed(a.limit(0), 1))
    want = {("x", "en", "v1", 1, 9, 20), (None, None, "v1", 1, 1, 1)}
    assert {tuple(r) for r in totals.totals().collect()} == want
    (tmp_path / "t" / "b9").mkdir()  # an attempt that never finished is not read, and is overwritten
    assert {tuple(r) for r in totals.totals().collect()} == want
    assert totals.compact("s1") and {tuple(r) for r in totals.totals().collect()} == want
    assert totals.commit("b9", rollup.signed(a.filter("source IS NULL"), -1))
    assert {tuple(r) for r in totals.totals().collect()} == {("x", "en", "v1", 1, 9, 20)}
    with pytest.raises(ValueError):
        totals.commit("../x", rollup.signed(a, 1))


def test_bpe_counts_equal_whole_text_encoding():
    import base64

    import tiktoken

    data = open(VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    parts = ["word", "don't", "42", "é", "漢字", " ", "  ", "\n", "\n\n", "\t", " ", "!?", "a.b", "😀", "\x1c", "<|x|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(600)] + ["", "a b c", " a", "a ", "a b " * 5000]
    got = rollup.bpe_counter(data, PATTERN)(pa.array([*texts, None]))
    assert got.tolist() == [*[len(enc.encode_ordinary(t)) for t in texts], 0]


# --- chat ------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x|> <\\\\| <| |> \\", "", None, "é漢😀\n\n", "plain " * 2000]
    rows = [(c, t, "assistant" if t % 2 else "user", odd[(c + t) % len(odd)]) for c in range(6) for t in range(c + 1)]
    rows += [(None, 1, "assistant", "x"), (9, None, None, "a"), (9, 2, "assistant\n", "b"), (9, 2, "assistant", "c"), (9, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chat.assemble(df, VOCABULARY, PATTERN)
    got = {r.conv_id: r for r in chat.digests(made, VOCABULARY, PATTERN).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        shown = sum(len("<|im_start|><|im_sep|><|im_end|>") + len(chat.escape(r[2] or "")) + len(chat.escape(r[3] or "")) for r in turns)
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == shown
    reserved = made.select(F.explode("ids").alias("i")).filter("i >= 50256").count()
    assert reserved == 3 * len(rows)  # control strings in texts never become reserved ids


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("<|\\>a") for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_chat_of_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.assemble(none, VOCABULARY, PATTERN), VOCABULARY, PATTERN).count() == 0


# --- language and toxicity -------------------------------------------------------------------

def test_language_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    extra = frame(spark, [doc(-1, None), doc(-2, ""), doc(-3, "123 !?"), (-4, "Les mots sont dans la rue et le chat", None, "s", 1)])
    out = langid.identify(docs.unionByName(extra), crc_is_2("doc_id", 4))
    r = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.97
    odd = {x.doc_id: x for x in out.filter("doc_id < 0").collect()}
    assert [odd[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and odd[-1].score == 0
    assert out.filter("score < 0 OR score > 1").count() == 0 and out.count() == docs.count() + 4


def test_more_languages_than_64_are_learned(spark):
    r = random.Random(8)
    words = {f"l{k:02d}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(70)}
    rows = [doc(100 * k + i, " ".join(r.choice(w) for _ in range(30)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(8)]
    out = langid.identify(frame(spark, rows), F.col("doc_id") % 100 >= 6).filter("held_out").collect()
    assert len(out) == 140 and {x.doc_id: x.lang_pred for x in out} == {x.doc_id: f"l{x.doc_id // 100:02d}" for x in out}


def test_language_without_labels(spark):
    out = langid.identify(frame(spark, [doc(1, "some text", None), doc(2, None, None)]), F.lit(False))
    assert {r.lang_pred for r in out.collect()} == {"und"}


def test_toxicity_learns_words_and_beginnings(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = [f"w{''.join(r.choice('abcdefgh') for _ in range(4))}" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(1 + i % 3):
                w[r.randrange(30)] = r.choice(["grump", "zorkla" + r.choice("abcdefgh") + r.choice("abcdefgh")])
        rows.append(doc(i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (0, 1), (9999, 1), (3, None)]
    df = frame(spark, rows + [doc(1000, "nice words only"), doc(1001, "you zorklaxy"), doc(1002, None), doc(1003, "")])
    grades = spark.createDataFrame(labels, "doc_id long, grade int")
    model = toxicity.fit(toxicity.labelled(df, grades))
    assert (np.diff(model.thresholds) >= 0).all() and (model.weights >= 0).all()
    out = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    wrong = sum((out[i].p_toxic >= 0.5) != (i % 5 == 0) for i in range(400))
    assert wrong <= 4 and out[1001].p_toxic >= 0.5
    assert max(out[i].p_toxic for i in (1000, 1002, 1003)) < 0.5
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.filter("doc_id = 1001").count() == 0 and kept.filter("doc_id IN (1000, 1002, 1003)").count() == 3


def test_severity_follows_the_grades_of_the_data(spark):
    """Grades 0 to 3 set by which words a text holds, not by how many: the order is learned,
    and every row equals the cumulative-link formula computed word by word."""
    r = random.Random(5)
    mark = {1: "mildak", 2: "meduro", 3: "gravix"}
    rows, labels = [], []
    for i in range(800):
        w = [f"w{''.join(r.choice('abcdefgh') for _ in range(4))}" for _ in range(25)]
        grade = i % 8 if i % 8 <= 3 else 0
        for g in range(1, grade + 1):  # a grade's text holds the marks up to it; long texts repeat grade 1's mark
            w[5 * g] = mark[g]
        if grade == 1:
            w += [mark[1]] * 6
        rows.append(doc(i, " ".join(w)))
        labels.append((i, grade))
    df = frame(spark, rows)
    grades = spark.createDataFrame(labels, "doc_id long, grade int")
    model = toxicity.fit(toxicity.labelled(df, grades))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) >= 0).all() and (model.weights >= 0).all()
    weight = dict(zip(model.words, model.weights))
    texts = {row[0]: row[1] for row in rows}
    out = toxicity.score(df, model).collect()
    for x in out:
        z = sum(weight.get(f, 0.0) for f in {f for word in set(texts[x.doc_id].split()) for f in toxicity.features_of(word)})
        at_least = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert x.severity == pytest.approx(sum(at_least)) and x.p_toxic == pytest.approx(at_least[0])
        cells = [1 - at_least[0], at_least[0] - at_least[1], at_least[1] - at_least[2], at_least[2]]
        assert cells[x.grade] == pytest.approx(max(cells))
    want = dict(labels)
    assert sum(x.grade == want[x.doc_id] for x in out) >= 0.95 * len(out)
    mean = [np.mean([x.severity for x in out if want[x.doc_id] == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 2


def test_binary_labels_give_one_threshold(spark):
    r = random.Random(6)
    plain = [[f"w{''.join(r.choice('abcdefgh') for _ in range(4))}" for _ in range(20)] for _ in range(200)]
    rows = [doc(i, " ".join(w[:9] + ["grump"] * (i % 4 == 0) + w[9:])) for i, w in enumerate(plain)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    model = toxicity.fit(toxicity.labelled(df, toxicity.grades_of(labels)))
    assert len(model.thresholds) == 1
    assert all(x.severity == x.p_toxic and x.grade == int(x.p_toxic > 0.5) for x in toxicity.score(df, model).collect())


def test_toxicity_without_labels(spark):
    df = frame(spark, [doc(1, "any text"), doc(2, None)])
    for grades in ([], [(1, 0)]):
        model = toxicity.fit(toxicity.labelled(df, spark.createDataFrame(grades, "doc_id long, grade int")))
        assert [r.severity for r in toxicity.score(df, model).collect()] == [0.0, 0.0]
        assert toxicity.without_toxic(df, model).count() == 2


def test_many_copies_of_one_text_are_one_piece_of_evidence(spark):
    copy = " ".join(f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [doc(i, copy + f" x{i}") for i in range(30)] + [doc(100 + i, " ".join(prose(i, 20))) for i in range(100)]
    grades = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(100)], "doc_id long, grade int")
    df = frame(spark, rows)
    assert "=rareaa" not in toxicity.choose_features(toxicity.labelled(df, grades))
