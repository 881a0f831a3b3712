"""Conversations as training text with an offset-aligned loss mask.

A conversation is rendered whole, encoded once with character offsets, and the tokens to learn from are those whose
span meets an assistant text: both lists of spans are sorted, so binary search finds each turn's tokens.

Template: ``<s>``, then for each turn ``[INST]`` role, line end, text; the turns of the role to learn from are
``[/INST]`` text ``</s>``. Control strings inside texts and roles get a backslash after their first character, one more
than those already there, so reading back takes one away and nothing is ambiguous. A line end in a role is written as
``\\n`` and its backslashes are doubled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers, processors

from pagequill.llm.staging import ship

BEGIN, END, ASK, ANSWER = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = [BEGIN, END, ASK, ANSWER]
LEARNT = "assistant"
SCHEMA = "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"
RAW = re.compile(r"<(\\*)(?=/?s>)|\[(\\*)(?=/?INST\])")
ESCAPED = re.compile(r"<\\(\\*)(?=/?s>)|\[\\(\\*)(?=/?INST\])")
TURN = re.compile(r"\[INST\]([^\n]*)\n|\[/INST\]|</s>")
BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    return RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of the texts to learn from, in code points."""
    parts, spans, size = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        head, tail = (ANSWER, END) if role == LEARNT else (f"{ASK}{_role(role)}\n", "")
        parts += [head, body, tail]
        size += len(head)
        if role == LEARNT and body:
            spans.append((size, size + len(body)))
        size += len(body) + len(tail)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns: list[tuple[str, str]] = []
    marks = list(TURN.finditer(formatted))
    for mark, after in zip(marks, [*marks[1:], None], strict=True):
        if mark[0] != END:
            text = unescape(formatted[mark.end() : after.start() if after else len(formatted)])
            turns.append((LEARNT if mark[0] == ANSWER else _role_back(mark[1]), text))
    return turns


def chat_tokenizer(path: str) -> Tokenizer:
    """The vocabulary file with the control strings as special tokens; offsets cover every character."""
    out = Tokenizer.from_file(path)
    out.add_special_tokens(CONTROLS)
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    return out


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a span, and the parts of the spans under those tokens."""
    under = np.zeros(len(offsets), bool)
    covered = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for start, end in spans:
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        if lo < hi:
            under[lo:hi] = True
            covered.append((int(max(start, starts[lo])), int(min(end, ends[lo:hi].max()))))
    return under, covered


def format_conversations(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, n_turns, formatted, token_ids, loss_mask, loss_spans)``, one row for each conversation.

    Rows are ordered by turn, then by role and text; null turns come first. Null roles and texts are empty. Rows with a
    null conversation id are one conversation. A conversation is one row of the result and is held whole. Other columns
    are ignored.
    """
    ship(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    whole = turns.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return whole.mapInArrow(lambda b: _format(b, tokenizer_path), SCHEMA)


def _format(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    tokenizer = chat_tokenizer(path)
    for batch in batches:
        held, size = [], 0
        for i in range(batch.num_rows):
            turns = [(t["role"], t["text"]) for t in batch.column("turns")[i].as_py()]
            text, spans = render(turns)
            held.append((batch.column("conv_id")[i].as_py(), len(turns), text, spans))
            size += len(text)
            if size >= BATCH_CHARS:
                yield _encoded(tokenizer, held)
                held, size = [], 0
        if held:
            yield _encoded(tokenizer, held)


def _encoded(tokenizer: Tokenizer, held: list[tuple]) -> pa.RecordBatch:
    ids, masks, covered = [], [], []
    for code, (_, _, _, spans) in zip(tokenizer.encode_batch([h[2] for h in held], add_special_tokens=False), held, strict=True):
        under, parts = mask(np.array(code.offsets, np.int64).reshape(-1, 2), spans)
        ids.append(np.array(code.ids, np.int32))
        masks.append(under)
        covered.append([{"start": a, "end": b} for a, b in parts])
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(values), kind))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.string())]
    columns += [lists(ids, pa.int32()), lists(masks, pa.bool_()), pa.array(covered, span)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "token_ids", "loss_mask", "loss_spans"])
