"""Chat formatting by token-level assembly.

Each turn becomes  START role SEP text END  where START, SEP and END are
reserved ids above the vocabulary. Role and text are encoded separately as
ordinary text, so nothing inside them can ever become a reserved id. In the
rendered text the reserved ids show as control strings; ``<|`` inside a role
or text is escaped as ``<\\|`` (one more backslash where there are some
already), which is reversible and leaves all other text as it is.

The loss mask covers the text of assistant turns and nothing else. The tokens
of a conversation are the turns in order; ``start`` is the number of its tokens
before the turn (a prefix sum), and so is the mask's place. One row per turn:
a conversation of any length needs no array of its own length.

Encoding runs row by row before the rows of a conversation meet. ``digests``
reads the assembled ids back in order, conversation by conversation, holding
one turn at a time.

Defined cases: null text or role: empty; turns of a conversation are ordered
by turn (null first), then role, then tokens; rows with a null conv_id form one
conversation; repeated rows are repeated turns; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._ship import map_arrow

#: Control strings of the template, in the order of their reserved ids (fixed values).
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


class Template:
    """Encoder of turns over a byte-pair vocabulary in rank format."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.base = max(ranks.values()) + 1
        self.start, self.sep, self.end = range(self.base, self.base + 3)
        self.encoding = tiktoken.Encoding("feira", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids, first and end of the loss mask)."""
        head = [self.start, *self.encoding.encode_ordinary(escape(role)), self.sep]
        body = self.encoding.encode_ordinary(escape(text))
        first, end = (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)
        return [*head, *body, self.end], first, end

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of one turn's ids."""
        cut = np.flatnonzero(ids >= self.base)
        if ids[cut].tolist() != [self.start, self.sep, self.end] or cut[0] != 0 or cut[2] != len(ids) - 1:
            raise ValueError("not one well-formed turn")
        return unescape(self.text(ids[1:cut[1]])), unescape(self.text(ids[cut[1] + 1:cut[2]]))

    def rendered(self, ids: np.ndarray) -> str:
        """The formatted text of the ids."""
        out, at = [], 0
        for i in np.flatnonzero(ids >= self.base):
            out += [self.text(ids[at:i]), CONTROL[ids[i] - self.base]]
            at = i + 1
        return "".join([*out, self.text(ids[at:])])


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB


def encoded(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, ids, loss_first, loss_end), one row per turn, not yet in order."""
    vocabulary = _vocabulary(turns, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(vocabulary.value, pattern)
        for batch in batches:
            for part in T.slices(batch, "text"):
                done = [template.turn(role, text) for role, text in
                        zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"),
                     pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.int64()),
                     pa.array([d[2] for d in done], pa.int64())],
                    ["conv_id", "turn", "role", "ids", "loss_first", "loss_end"])

    none = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_arrow(rows, run, f"conv_id {of['conv_id']}, turn {of['turn']}, role string, ids array<int>,"
                                " loss_first long, loss_end long")


def assemble(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, start, ids, loss): ``loss[i]`` is true where a token counts for the loss.

    ``start`` is the prefix sum of the tokens of the conversation's earlier turns.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "ids").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long")
    return (encoded(turns, path, pattern).withColumn("start", place)
            .select("conv_id", "turn", "role", "start", "ids",
                    F.transform("ids", lambda x, i: (i >= F.col("loss_first")) & (i < F.col("loss_end"))).alias("loss")))


def digests(assembled: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the assembled tokens hold, read back: (conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_tokens)."""
    vocabulary = _vocabulary(assembled, path)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(vocabulary.value, pattern)
        now: dict | None = None
        done: list[dict] = []

        def close() -> None:
            if now is not None:
                done.append({"conv_id": now["id"], "n_turns": now["turns"], "turns_sha256": now["all"].hexdigest(),
                             "loss_chars": now["chars"], "loss_sha256": now["loss"].hexdigest(),
                             "formatted_chars": now["formatted"], "n_tokens": now["tokens"]})

        def flush(like: pa.DataType) -> pa.RecordBatch:
            types = [like, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], t) for n, t in zip(names, types)], names)
            done.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            ids_, loss_ = batch.column("ids"), batch.column("loss")
            starts = batch.column("start").to_pylist()
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(),
                           "formatted": 0, "tokens": 0}
                ids = ids_[i].values.to_numpy()
                loss = loss_[i].values.to_numpy(zero_copy_only=False)
                if starts[i] != now["tokens"]:
                    raise ValueError("turns out of order")
                role, text = template.read(ids)
                now["all"].update(f"{role}\n{text}\n".encode())
                masked = unescape(template.text(ids[loss]))
                now["loss"].update(masked.encode())
                now["chars"] += len(masked)
                now["formatted"] += len(template.rendered(ids))
                now["turns"] += 1
                now["tokens"] += len(ids)
            if len(done) > 10_000:
                yield flush(kind)
        close()
        if done:
            yield flush(kind)

    ident = assembled.schema["conv_id"].dataType.simpleString()
    rows = assembled.select("conv_id", "start", "ids", "loss", F.size("ids").alias("n"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "start", "n").drop("n")
    return map_arrow(rows, run, f"conv_id {ident}, n_turns long, turns_sha256 string, loss_chars long,"
                                " loss_sha256 string, formatted_chars long, n_tokens long")
