"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms per document are held against language references with the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1):
character classes (white space, upper case, digit, sentence punctuation,
symbol, everything else) and the common words of a language (its COMMON most
frequent words, and the rest). The references are learned from all documents,
one per value of ``lang`` with LANGUAGE_WORDS words or 1% of all words. Those
of at least 1% (100 at most, whatever the column holds) are literals that
every document is held against, and the closest counts, so a wrong or missing
``lang`` does no harm. The others are a table joined by ``lang``: a document
of such a language is held against its own reference too. A document whose
``lang`` has no reference at all is not judged by the method.

A document is rejected by the method if it has at least MIN_WORDS_CHARS words
and the character distance exceeds MAX_CHAR, or if it has at least MIN_WORDS
words and the word distance exceeds MAX_WORD (short texts do not fill a
histogram). Base rules come first:
fewer than 10 words, or more than 20% of the words inside repeated 5-word
windows.

Defined cases: null text has no words and fails; ties between common words
go to the smaller word; without any reference (no known language) the method
rejects nothing; ``keep_good`` keeps all columns, whatever their names.
Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._store import cut

COMMON = 32
MIN_WORDS_CHARS = 20
MIN_WORDS = 50
MAX_CHAR = 0.30
MAX_WORD = 0.45
LANGUAGE_SHARE = 0.01
LANGUAGE_WORDS = 500

WS = r"\x20\x09-\x0D"
#: The characters of the base count n_symbols (fixed values).
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "upper", "digit", "mark", "symbol", "rest")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"([^{WS}]+)"), F.lit(1))


def repeated_words(words: Column) -> Column:
    """Number of words inside 5-word windows that occur at least twice."""

    def of_hashes(h: Column) -> Column:
        keys = F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(
            s, lambda x, i: F.coalesce(x["k"] == F.get(s, i + 1)["k"], F.lit(False))
            | ((i > 0) & (x["k"] == F.get(s, F.greatest(i - 1, F.lit(0)))["k"]))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))),
            F.lit(0), lambda a, x: a + x))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _char_counts(t: Column, word_chars: Column, n_symbols: Column) -> list[Column]:
    """Counts in the order of CLASSES."""
    total = F.char_length(t)

    def count(keep: str) -> Column:
        return F.char_length(F.regexp_replace(t, keep, ""))

    space = total - word_chars
    upper, digit, mark = count(r"[^\p{Lu}]+"), count(r"[^0-9]+"), count(r"[^.,;:!?'\"()\-]+")
    return [space, upper, digit, mark, n_symbols, total - space - upper - digit - mark - n_symbols]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __t, __words and the base counts."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(rf"[^{WS}]"))
    # arrays of the row are bound once (let); the word array itself is a column
    return (docs.withColumn("__t", t)
            .withColumn("__words", words_of(F.col("__t")))
            .withColumn("__n_words", F.size("__words").cast("long"))
            .withColumn("__word_chars", F.char_length(F.array_join("__words", "")).cast("long"))
            .withColumn("__n_symbols", F.char_length(F.regexp_replace("__t", f"[^{SYMBOLS}]+", "")).cast("long"))
            .withColumn("__n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, big, chars, words, top): shares in the order of CLASSES, share of
    each common word, and their sum; ``big``: at least 1% of all words.

    Counted over all documents; one row per language.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.filter(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), t.alias("t"))
    word_chars = F.char_length(F.regexp_replace("t", rf"[{WS}]+", ""))
    symbols = F.char_length(F.regexp_replace("t", f"[^{SYMBOLS}]+", ""))
    counts = _char_counts(F.col("t"), word_chars, symbols)
    chars = rows.groupBy("lang").agg(*[F.sum(c.cast("long")).alias(n) for c, n in zip(counts, CLASSES)])
    word = (rows.select("lang", F.explode(words_of(F.lower("t"))).alias("word"))
            .groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = word.groupBy("lang").agg(F.sum("n").alias("all"))
    # Spark keeps only the first COMMON rows of each language before the shuffle
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (word.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= COMMON)
           .groupBy("lang").agg(F.collect_list(F.struct("word", "n")).alias("top")))
    grand = totals.agg(F.sum("all").alias("grand"))
    big = F.col("all") >= F.col("grand") * LANGUAGE_SHARE
    kept = totals.crossJoin(F.broadcast(grand)).filter(big | (F.col("all") >= LANGUAGE_WORDS)).join(chars, "lang").join(top, "lang")
    n = F.greatest(sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])), F.lit(1))
    shares = F.transform("top", lambda x: F.struct(x["word"].alias("word"), (x["n"] / F.col("all")).alias("share")))
    out = kept.select("lang", big.alias("big"), F.array(*[F.col(c) / n for c in CLASSES]).alias("chars"),
                      F.map_from_entries(shares).alias("words"))
    return cut(out.withColumn("top", F.aggregate(F.array_sort(F.map_values("words")), F.lit(0.0), lambda a, x: a + x)))


def big_references(refs: DataFrame) -> dict[str, dict]:
    """{lang: {"chars": ..., "words": ...}} of the languages with 1% of all words or more (100 at most)."""
    rows = refs.filter("big").select("lang", "chars", "words").collect()
    return {r["lang"]: {"chars": list(r["chars"]), "words": dict(sorted(r["words"].items()))} for r in sorted(rows)}


def _terms(p: Column, q: Column) -> Column:
    """p log2(p / m) + q log2(q / m), m = (p + q) / 2."""
    return (F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))
            + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(F.lit(0.0)))


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def _to_chars(counts: list[Column], shares: list[Column]) -> Column:
    total = F.greatest(sum(counts[1:], counts[0]), F.lit(1))
    parts = [_terms(c / total, q) for c, q in zip(counts, shares)]
    return F.sqrt(F.greatest(sum(parts[1:], parts[0]) / 2, F.lit(0.0)))


def _char_distance(counts: list[Column], refs: dict[str, dict]) -> Column:
    return _least([_to_chars(counts, [F.lit(float(q)) for q in r["chars"]]) for r in refs.values()])


def _entries(words: Column, known: Callable[[Column], Column]) -> Column:
    """(w, n): the words, lower-cased, that ``known`` accepts, with their counts."""
    common = F.sort_array(F.filter(F.transform(words, lambda w: F.lower(w)), known))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                          lambda x: (x["i"] == 0) | (x["w"] != F.get(s, F.greatest(x["i"] - 1, F.lit(0)))))
        return let(starts, lambda b: F.transform(b, lambda x, k: F.struct(
            x["w"].alias("w"), (F.coalesce(F.get(b, k + 1)["i"], F.size(s)) - x["i"]).alias("n"))))

    return let(common, runs)


def _to_words(entries: Column, n: Column, share: Column, top: Column) -> Column:
    """Distance of the counts ``entries`` of a text of n words to a reference's shares, which add up to ``top``."""
    hits = F.filter(F.transform(entries, lambda e: F.struct(
        (e["n"] / n).alias("p"), F.try_element_at(share, e["w"]).alias("q"))), lambda e: e["q"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("terms"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    summed = F.aggregate(hits, zero, lambda a, e: F.struct(
        (a["terms"] + _terms(e["p"], e["q"])).alias("terms"), (a["p"] + e["p"]).alias("p"), (a["q"] + e["q"]).alias("q")))
    return let(summed, lambda z: F.sqrt(F.greatest(
        (z["terms"] + (top - z["q"]) + _terms(F.greatest(1 - z["p"], F.lit(0.0)), 1 - top)) / 2, F.lit(0.0))))


def _word_distance(words: Column, refs: dict[str, dict]) -> Column:
    known = sorted({w for r in refs.values() for w in r["words"]})
    n = F.greatest(F.size(words), F.lit(1)).cast("double")

    def to(entries: Column, ref: dict) -> Column:
        share = F.create_map(*[F.lit(x) for pair in ref["words"].items() for x in pair])
        return _to_words(entries, n, share, F.lit(float(sum(ref["words"].values()))))

    return let(_entries(words, lambda w: w.isin(known)), lambda e: _least([to(e, r) for r in refs.values()]))


def _with_own_reference(docs: DataFrame, refs: DataFrame, big: list[str], lang_col: str) -> DataFrame:
    """``docs`` with __own, the reference of the row's language if that is not a big one. Rows
    that need none get keys of their own, so a large language is not dealt to one task."""
    lang = F.col(f"`{lang_col}`")
    none = lang.isNull() | lang.isin(big) if big else lang.isNull()
    key = F.when(none, F.concat(F.lit("#"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
                 ).otherwise(F.concat(F.lit("="), lang))
    own = refs.filter("NOT big").select(F.concat(F.lit("="), "lang").alias("__key"), F.struct("chars", "words", "top").alias("__own"))
    return docs.withColumn("__key", key).join(own, "__key", "left").drop("__key")


def judged(docs: DataFrame, refs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with __n_words, __word_chars, __n_symbols, __n_dup_lines,
    __n_repeat_words, __base_failed, __kept."""
    big = big_references(refs)
    small = refs.filter("NOT big").limit(1).count() > 0
    rows = _with_own_reference(docs, refs, list(big), lang_col) if small else docs
    out = (measured(rows, text_col)
           .withColumn("__n_repeat_words", repeated_words(F.col("__words")).cast("long"))
           .withColumn("__base_failed", (F.col("__n_words") < 10)
                       | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))))
    verdict = F.lit(True)
    if big:
        counts = _char_counts(F.col("__t"), F.col("__word_chars"), F.col("__n_symbols"))
        char, word = _char_distance(counts, big), _word_distance(F.col("__words"), big)
        lang = F.col(f"`{lang_col}`")
        strange = lang.isNotNull() & ~lang.isin(list(big))
        if small:
            own, n = F.col("__own"), F.greatest(F.size("__words"), F.lit(1)).cast("double")
            theirs = _entries(F.col("__words"), lambda w: F.map_contains_key(own["words"], w))
            char = F.least(char, F.when(own.isNotNull(), _to_chars(counts, [F.get(own["chars"], i) for i in range(len(CLASSES))])))
            word = F.least(word, F.when(own.isNotNull(), let(theirs, lambda e: _to_words(e, n, own["words"], own["top"]))))
            strange = strange & own.isNull()
        near = (F.col("__n_words") < MIN_WORDS_CHARS) | (char <= MAX_CHAR)
        usual = (F.col("__n_words") < MIN_WORDS) | (word <= MAX_WORD)
        verdict = strange | (near & usual)
    out = out.withColumn("__kept", ~F.col("__base_failed") & verdict)
    return out.drop("__t", "__words", "__own")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with its base counts and the verdict."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    out = judged(slim, references(slim))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came.

    The verdict goes through a one-element generator: a filter on it would be
    pushed below the projections and repeat their work at every reference.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    out = judged(rows, references(rows))
    return out.select("row", F.explode_outer(F.array("__kept")).alias("pass")).filter("pass").select("row.*")
