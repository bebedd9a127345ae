"""Chat formatting by token-level assembly.

Every turn becomes START role SEP text END, where the three marks are reserved ids above the tokenizer's vocabulary
and role and text are encoded separately, so that no content can ever produce a mark. A turn's place in its
conversation and the span of its loss mask are prefix sums of segment lengths.

Escaping: the marks' strings all begin with `<|`, so in content every `<`, run of backslashes, `|` gets one more
backslash; `<|` itself becomes `<\\|`. Taking one backslash away gives the content back, whatever it held.

Order: by turn, null first; ties by role, then text. A null role or text is empty. Rows with a null conversation
form one conversation. Repeated rows are turns of their own; an empty table gives an empty result. Other columns of
the input are never read. Texts may be of any length: a row is encoded alone, and a conversation is streamed.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import process_cache, small_batches

#: The marks' strings and their ids, counted from the first free id of the vocabulary (50,256 is left to <|endoftext|>).
MARKS = {50257: "<|im_start|>", 50258: "<|im_sep|>", 50259: "<|im_end|>"}
START, SEP, END = MARKS


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def ranks_encoding(path: str, pattern: str):
    """The byte-level BPE of a file of base64 pieces and ranks, without special tokens."""
    import tiktoken

    def make():
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return process_cache(("encoding", path), make)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


SEGMENTS = "conv_id long, position long, start long, input_ids array<int>, loss_from long, loss_to long"


def format_conversations(turns: DataFrame, ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its position (from 1), the tokens before it in its
    conversation, its ids, and the span of its conversation's tokens under the loss mask (empty unless the role is
    `assistant`). Conversations are whole and in order within a partition."""
    path, pattern = ranks or default_ranks()
    rows = small_batches(turns).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def assemble(batches):
        encoding = ranks_encoding(path, pattern)
        roles: dict[str, list[int]] = {}
        conv, position, start = object(), 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch[x].to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, position, start = c, 0, 0
                if role not in roles:
                    if len(roles) > 1000:
                        roles.clear()
                    roles[role] = [START, *encoding.encode_ordinary(escape(role)), SEP]
                head, body = roles[role], encoding.encode_ordinary(escape(text))
                position += 1
                loss = start + len(head)
                out.append((c, position, start, [*head, *body, END], loss, loss + len(body) * (role == "assistant")))
                start += len(head) + len(body) + 1
                if len(out) == 512:
                    yield segments(out)
                    out = []
            if out:
                yield segments(out)

    def segments(out):
        c, position, start, ids, loss_from, loss_to = zip(*out, strict=True)
        longs = [pa.array(x, pa.int64()) for x in (c, position, start, loss_from, loss_to)]
        arrays = [*longs[:3], pa.array(ids, pa.list_(pa.int32())), *longs[3:]]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "position", "start", "input_ids", "loss_from", "loss_to"])

    return rows.mapInArrow(assemble, SEGMENTS)


def assembled(segments: DataFrame) -> DataFrame:
    """One row per conversation: input_ids and, of the same length, loss_mask (0 or 1). For conversations that fit a
    row; digests() reads any."""
    rows = segments.withColumn(
        "mask",
        F.expr("transform(input_ids, (x, i) -> int(start + i >= loss_from and start + i < loss_to))"),
    )
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "input_ids", "mask"))).alias("all"))
    return rows.select(
        "conv_id", F.expr("flatten(transform(all, x -> x.input_ids))").alias("input_ids"),
        F.expr("flatten(transform(all, x -> x.mask))").alias("loss_mask"),
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame, ranks: tuple[str, str] | None = None) -> DataFrame:
    """What the ids and masks say, decoded again: per conversation its turns, the digest of role, newline, text,
    newline of all turns, length and digest of the text under the loss mask, and the length of the whole format."""
    path, pattern = ranks or default_ranks()
    rows = segments.select("conv_id", "position", "start", "input_ids", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def read(batches):
        encoding = ranks_encoding(path, pattern)

        def text(ids) -> str:
            return encoding.decode_bytes(ids.tolist()).decode("utf-8")

        conv, held = object(), None
        for batch in batches:
            out = []
            flat = batch["input_ids"].flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *batch["input_ids"].value_lengths().to_pylist()])
            columns = (batch[x].to_pylist() for x in ("conv_id", "start", "loss_from", "loss_to"))
            for i, (c, start, loss_from, loss_to) in enumerate(zip(*columns, strict=True)):
                ids = flat[ends[i] : ends[i + 1]]
                if c != conv:
                    if held:
                        out.append(finished(conv, held))
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                marks = np.flatnonzero(ids >= START)
                if ids[marks].tolist() != [START, SEP, END] or marks[0] != 0 or marks[2] != len(ids) - 1:
                    raise ValueError(f"conversation {c} has a turn that is not START role SEP text END")
                role, body = text(ids[1 : marks[1]]), text(ids[marks[1] + 1 : -1])
                loss = unescape(text(ids[loss_from - start : loss_to - start]))
                held[0] += 1
                held[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                held[2] += len(loss)
                held[3].update(loss.encode())
                held[4] += len(role) + len(body) + sum(map(len, MARKS.values()))
            if out:
                yield table(out)
        if held:
            yield table([finished(conv, held)])

    def finished(conv, held):
        return conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]

    def table(out):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(read, DIGESTS)
