"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of turns to one string; nothing else of it is
known.  Successive prefixes of a conversation are rendered and each output compared
with the one before.  Where the earlier output is a prefix of the later, the rest is
the new turn's span; where it is not, the template rewrites history, which is
reported, and a turn's span runs between the places up to which the outputs of the
prefixes agree with the last one.  Inside a span, the text is located by rendering
the same prefix with a mark as the turn's text.

Prefix rendering costs the square of a conversation's turns; one conversation is the
unit of work and has to fit in a task.

Turns are ordered by turn (nulls first), then role and text.  Null text and null role
count as empty, a null conv_id is a conversation of its own; repeated rows are turns
of their own.  Other columns are not read.  An empty table gives no conversations.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import small_batches

#: Strings that steer a chat model. Fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
#: The first character of a control string inside a text; a backslash goes behind it.
OPENING = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
def mark_for(text: str) -> str:
    """A string that stands for a turn's text while its place is looked for; not in text."""
    return next(m for i in range(len(text) + 2) if (m := f"\ue000{i}\ue001") not in text)


Turn = tuple[str, str]


def escape(text: str) -> str:
    """No control string is left; unescape() gives the text back, whatever it holds."""
    return OPENING.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def chatml(turns: list[Turn]) -> str:
    """Header with the role, text, end mark for each turn; appends only."""
    return "".join(f"<|im_start|>{escape_role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def inst(turns: list[Turn]) -> str:
    """Instruction brackets around what is not the assistant's; appends only."""
    return "".join(f"{escape(t)} </s>" if r == "assistant" else f"<s>[INST] {escape(t)} [/INST] " for r, t in turns)


def last_answer(turns: list[Turn]) -> str:
    """Drops every answer but the last: a template that rewrites history."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return chatml([t for i, t in enumerate(turns) if t[0] != "assistant" or i == last])


class Located(NamedTuple):
    text: str
    spans: list[tuple[int, int]]  #: of each turn with its marks
    inner: list[tuple[int, int] | None]  #: of each turn's text, None if it can't be told
    rewritten: int | None  #: the first turn whose addition changed earlier output


def locate(render: Callable[[list[Turn]], str], turns: list[Turn]) -> Located:
    outputs = [render([])]
    inner: list[tuple[int, int] | None] = []
    rewritten = None
    for i, (role, _) in enumerate(turns):
        outputs.append(render(turns[: i + 1]))
        if rewritten is None and not outputs[-1].startswith(outputs[-2]):
            rewritten = i
        mark = mark_for(outputs[-1])
        head, found, tail = render([*turns[:i], (role, mark)]).partition(mark)
        fits = found and mark not in tail and outputs[-1].startswith(head) and outputs[-1].endswith(tail) and len(head) + len(tail) <= len(outputs[-1])
        inner.append((len(head), len(outputs[-1]) - len(tail)) if fits else None)
    if rewritten is None:
        ends = [len(x) for x in outputs]
    else:
        ends, last = [], outputs[-1]
        for x in outputs:
            ends.append(max(len(commonprefix([x, last])), ends[-1] if ends else 0))
        inner = [x if x and x[1] <= ends[i + 1] and outputs[i + 1][: x[1]] == last[: x[1]] else None for i, x in enumerate(inner)]
    return Located(outputs[-1], list(zip(ends, ends[1:], strict=False)), inner, rewritten)


#: How to read role and text back from a span: (role, text) of chatml().
CHATML_SPAN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)


def read_back(text: str, spans: list[tuple[int, int]]) -> list[Turn]:
    """The turns that chatml() wrote, from its output and the located spans."""
    return [(unescape(m[1]), unescape(m[2])) for a, b in spans if (m := CHATML_SPAN.fullmatch(text, a, b))]


def format_chats(df: DataFrame, render: Callable[[list[Turn]], str] = chatml, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turn_starts, turn_ends, loss (spans under the loss mask), rewritten for each conversation.

    Rows are dealt by conv_id and sorted within the partition, so one conversation at a
    time is held, not one partition.
    """

    def one(conv: int | None, turns: list[Turn]) -> dict:
        x = locate(render, turns)
        loss = [{"start": p[0], "end": p[1]} for p, (r, _) in zip(x.inner, turns, strict=True) if p and r == loss_role]
        return {"conv_id": conv, "formatted": x.text, "turn_starts": [a for a, _ in x.spans], "turn_ends": [b for _, b in x.spans], "loss": loss, "rewritten": x.rewritten is not None}

    shape = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_starts", pa.list_(pa.int64())), ("turn_ends", pa.list_(pa.int64())), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rewritten", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns, done, held = None, [], [], 0
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if turns and conv != at:
                    done.append(one(at, turns))
                    held, turns = held + len(done[-1]["formatted"]), []
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(done, shape)
                        done, held = [], 0
                at = conv
                turns.append((role or "", text or ""))
        if turns:
            done.append(one(at, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, shape)

    rows = small_batches(df).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, formatted string, turn_starts array<long>, turn_ends array<long>, loss array<struct<start: bigint, end: bigint>>, rewritten boolean")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text = r["formatted"]
                turns = read_back(text, list(zip(r["turn_starts"], r["turn_ends"], strict=True)))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in r["loss"])
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{a}\n{t}\n" for a, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": len(text), "rewritten": r["rewritten"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())]))

    return df.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
