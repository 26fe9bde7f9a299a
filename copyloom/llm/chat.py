"""Chat formatting: conversations as training text with a loss mask, and the way back.

A template of the sandboxed language in `template.py` is compiled to closures. Tasks get whole conversations in order of
their turns and render them turn by turn; what comes out is cut into parts of bounded length, so that neither a
conversation of any number of turns nor its formatted text has to fit in memory. Control strings inside texts and roles
are escaped: their first characters become a backslash and a letter, a backslash becomes two.

Nulls and edge cases: a null text or role is empty; turns come by turn (nulls first), then role, then text, so ties and
repeated rows have an order and all count; rows with a null conv_id form one conversation; an empty table formats
nothing; further columns are ignored. A single turn must fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.template import compile_template

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Strings that mark something in common chat formats. Fixed values.
CONTROL = (START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% set start = '" + START + "' %}{% set middle = '" + MIDDLE + "' %}"
    "{% for m in messages %}{{ start }}{{ m.role | escape }}{{ middle }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)
PART_CHARS = 1 << 20
FORMATTED = "conv string, part int, formatted string, loss_start array<int>, loss_end array<int>"
READ = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaping(control: tuple[str, ...] = CONTROL) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """Functions that escape and unescape a text, so that no control string is left in it."""
    firsts = ["\\", *sorted({c[0] for c in control} - {"\\"})]
    codes = {c: "\\" + ("\\" if c == "\\" else chr(ord("a") + i)) for i, c in enumerate(firsts)}
    back = {v[1]: k for k, v in codes.items()}
    there = re.compile("[" + "".join(re.escape(c) for c in firsts) + "]")
    return (
        lambda text: there.sub(lambda m: codes[m[0]], text),
        lambda text: re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S) if "\\" in text else text,
    )


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from batch.itertuples(index=False, name=None)


def _conversation(row: tuple) -> tuple[bool, str]:
    return isinstance(row[0], str), _text(row[0])


def _formatter(template: str, control: tuple[str, ...], part_chars: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template, {"escape": escaping(control)[0]})
        done: list[tuple] = []
        waiting = 0
        for (known, conv), rows in groupby(_rows(batches), key=_conversation):
            name = conv if known else None
            part, texts, length, starts, ends = 0, [], 0, [], []
            for text, masked in render(messages=({"role": _text(r), "text": _text(t)} for _, r, t in rows)):
                if masked and text:
                    starts.append(length)
                    ends.append(length + len(text))
                texts.append(text)
                length += len(text)
                if length >= part_chars:
                    done.append((name, part, "".join(texts), starts, ends))
                    waiting += length
                    part, texts, length, starts, ends = part + 1, [], 0, [], []
                if waiting >= part_chars:
                    yield pd.DataFrame(done, columns=["conv", "part", "formatted", "loss_start", "loss_end"])
                    done, waiting = [], 0
            if length or not part:
                done.append((name, part, "".join(texts), starts, ends))
                waiting += length + 100
        if done:
            yield pd.DataFrame(done, columns=["conv", "part", "formatted", "loss_start", "loss_end"])

    return write


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL, part_chars: int = PART_CHARS
) -> DataFrame:
    """conv (conv_id as text), part, formatted, loss_start, loss_end: the formatted text of every conversation.

    A conversation's parts follow each other in one partition; the loss mask is given by code points within a part.
    """
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return rows.mapInPandas(_formatter(template, control, part_chars), FORMATTED)


def _reader(control: tuple[str, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unescape = escaping(control)[1]
        turn = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END) + "\n", re.S)
        done: list[tuple] = []
        for (known, conv), parts in groupby(_rows(batches), key=_conversation):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = formatted_chars = 0
            waiting = ""
            for _, _, formatted, starts, ends in parts:
                formatted_chars += len(formatted)
                for start, end in zip(starts, ends, strict=True):
                    text = unescape(formatted[start:end])
                    loss_chars += len(text)
                    loss.update(text.encode())
                waiting, at = waiting + formatted, 0
                while m := turn.match(waiting, at):
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n_turns, at = n_turns + 1, m.end()
                waiting = waiting[at:]
            if waiting:
                raise ValueError(f"conversation {conv}: {waiting[:40]!r} is not a turn")
            done.append((conv if known else None, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted_chars))
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=[f.split()[0] for f in READ.split(", ")])
                done = []
        if done:
            yield pd.DataFrame(done, columns=[f.split()[0] for f in READ.split(", ")])

    return read


def read_formatted(formatted: DataFrame, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Reads texts formatted with `TEMPLATE` back: the turns, and what lies under the loss mask, as counts and digests."""
    rows = formatted.mapInPandas(_reader(control), READ)
    return rows.withColumn("conv_id", F.col("conv").cast("long")).select("conv_id", *(f.split()[0] for f in READ.split(", ")[1:]))
