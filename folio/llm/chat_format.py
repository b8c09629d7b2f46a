"""Chat formatting with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other chat formats. Inside texts their first sign is followed by one backslash more.
_CONTROL = re.compile(r"(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])")
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    """Roles are one line in the template: backslashes and line feeds are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the character spans of the texts to be learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{_role(role)}\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask and the masked characters: token spans, sorted, meet the sorted turn spans by binary search.

    A token counts if it shares a character with a span; of a token that reaches over a span's edge only the shared characters are masked.
    """
    mask, chars = np.zeros(len(offsets), bool), []
    ends, starts = np.maximum.accumulate(offsets[:, 1]) if len(offsets) else offsets[:, 1], offsets[:, 0]
    for a, b in spans:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        touched = offsets[lo:hi]
        if b > a and len(touched):  # an empty text has nothing to learn, wherever it stands
            mask[lo:hi] = True
            chars.append((max(a, int(touched[:, 0].min())), min(b, int(touched[:, 1].max()))))
    return mask, chars


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: formatted text, token ids, token mask, masked character spans and turn count.

    Turns are in order of turn, ties by role and text; null roles and texts are empty, rows of a null conv_id are one conversation, repeated rows are
    repeated turns, an empty table gives an empty result, other columns are not read. A conversation is one record and is handled as a whole. The
    tokenizer's file is read by the driver and sent to the tasks: a vocabulary is some megabytes, however many rows there are.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    models: list = []
    with open(tokenizer, encoding="utf-8") as file:
        shared = conversations.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not models:
            from tokenizers import Tokenizer

            models.append(Tokenizer.from_str(shared.value))
            models[0].encode_special_tokens = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
                tokens = models[0].encode_batch([text for text, _ in rendered], add_special_tokens=False)
                masks = [loss_mask(np.array(t.offsets, np.int64).reshape(-1, 2), spans) for t, (_, spans) in zip(tokens, rendered, strict=True)]
                columns = [
                    part.column(0),
                    pa.array([text for text, _ in rendered], pa.string()),
                    pa.array([t.ids for t in tokens], pa.list_(pa.int32())),
                    pa.array([m.tolist() for m, _ in masks], pa.list_(pa.bool_())),
                    pa.array([[x for span in chars for x in span] for _, chars in masks], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<bigint>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[a:b]) for a, b in zip(flat[::2], flat[1::2], strict=True))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            made = list(zip(*rows, strict=True)) or [[]] * 5
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return digests(format_conversations(rows.union(probe)))
