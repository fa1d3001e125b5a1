"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer version) are kept as batches of signed
deltas in a shared folder. A batch is a set of changes - inserts (+), deletes
(-), revised counts (- old, + new) - that is summed per key before it is
written, so a batch holds one row per key it touches and a total is the sum of
all batches. Sums are additive, so batches may be committed in any order.

A batch is written to a folder of its own name. Spark's committer puts the
marker file there last: a batch with the marker is never written again
(committing it twice changes nothing), one without it - a lost driver, a
failed job - is overwritten by the next attempt and never read.

``compact`` folds all committed batches into one snapshot batch that names
them; batches named by a snapshot are not counted again.

Defined cases: null source or lang is a key like any other; null text has no
tokens and no bytes; keys whose documents sum to zero are left out of the
totals; repeated rows count as often as they occur; an empty batch is
committed and changes nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._ship import map_arrow

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "bytes"]
_BATCH = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"
#: White space in the sense of the tokenizers' split pattern.
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CACHE = 500_000


class Rollup:
    """Totals in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _place(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/{batch}"

    def committed(self, batch: str) -> bool:
        files, Path = self._files()
        return files.exists(Path(f"{self._place(batch)}/_SUCCESS"))

    def batches(self) -> list[str]:
        files, Path = self._files()
        if not files.exists(Path(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(Path(self.path)) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith((".", "_")) and self.committed(n))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer, sign, tokens, bytes); False if it was committed before."""
        if self.committed(batch):
            return False
        delta = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("docs"),
            F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"),
            F.sum(F.col("sign") * F.col("bytes")).cast("long").alias("bytes"))
        delta.withColumn("covers", F.lit(None).cast("string")).write.mode("overwrite").parquet(self._place(batch))
        return True

    def _live(self) -> DataFrame:
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], _BATCH + ", covers string, batch string")
        parts = [self.spark.read.schema(_BATCH + ", covers string").parquet(self._place(n)).withColumn("batch", F.lit(n))
                 for n in names]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        folded = rows.filter("covers IS NOT NULL").select(F.explode(F.split("covers", ",")).alias("batch")).distinct()
        return rows.join(folded, "batch", "left_anti")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, bytes) over all committed batches."""
        return (self._live().filter("docs IS NOT NULL").groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
                .filter("docs <> 0 OR tokens <> 0 OR bytes <> 0"))

    def compact(self, name: str) -> bool:
        """Fold all committed batches into one snapshot; False if ``name`` exists."""
        if self.committed(name):
            return False
        names = [n for n in self.batches()]
        folded = self.totals().withColumn("covers", F.lit(",".join(names)))
        mark = self.spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _BATCH.split(", "))],
                                          F.lit(",".join(names)).alias("covers"))
        folded.unionByName(mark).write.mode("overwrite").parquet(self._place(name))
        return True


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Changes that add (+1) or take away (-1) the rows of (source, lang, tokenizer, tokens, bytes)."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("sign"), "tokens", "bytes")


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the counts ``old`` by ``new``."""
    return signed(old, -1).unionByName(signed(new, 1))


def bpe_counter(vocabulary: bytes, pattern: str):
    """A function from a text column to token counts, for a byte-pair vocabulary in rank format.

    A single blank between two other characters always starts a new piece of
    the split pattern, so a text without longer runs of white space is counted
    by its pieces between blanks, each distinct piece once.
    """
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("feira", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    seen: dict[str, int] = {}

    def size(piece: str) -> int:
        n = seen.get(piece)
        if n is None:
            if len(seen) > _CACHE:
                seen.clear()
            n = seen[piece] = len(encoding.encode_ordinary(piece))
        return n

    def count(texts: pa.Array) -> np.ndarray:
        texts = T.plain(texts)
        odd = pc.match_substring_regex(texts, f"^{_SPACE}|{_SPACE}{{2}}|{_SPACE}$").to_numpy(zero_copy_only=False).astype(bool)
        odd |= pc.equal(texts, "").to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(odd):
            out[i] = len(encoding.encode_ordinary(texts[int(i)].as_py()))
        at = np.flatnonzero(~odd)
        if len(at):
            lists = pc.split_pattern(T.plain(texts.take(pa.array(at))), " ")
            pieces = lists.flatten().dictionary_encode()
            code = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(n) - n
            names = pieces.dictionary.to_pylist()
            later = np.ones(len(code), bool)
            later[first] = False
            blank = np.zeros(len(names), np.int64)
            for k in np.unique(code[later]):
                blank[k] = size(" " + names[k])
            each = np.where(later, blank[code], 0)
            each[first] = [size(names[k]) for k in code[first]]
            out[at] = np.add.reduceat(each, first)
        return out

    return count


def bpe_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` (without its text) with the number of tokens per row; ``path``: the vocabulary file."""
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe_counter(vocabulary.value, pattern)
        for batch in batches:
            for part in T.slices(batch, "__t"):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(count(part.column("__t")))],
                                                 [*keep, out])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__t"))
    schema = rows.drop("__t").schema.add(out, "long")
    return map_arrow(rows, run, schema)
