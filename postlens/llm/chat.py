"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Each longer prefix of a conversation is
rendered and compared with the output before: what was added is the new turn's span, and an output that
does not begin with the one before shows a template that rewrites history, which is an error or is
marked. Conversations are sorted on their key and streamed, so a task holds one conversation. A
conversation of n turns is rendered n times, as a black box must be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_OUT = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\c"}
_BACK = {v: k for k, v in _OUT.items()}


def escaped(text: str) -> str:
    """No control string of the template survives in the result: neither `<` nor `[` does."""
    return re.sub(r"[\\<\[]", lambda m: _OUT[m[0]], text)


def escaped_role(role: str) -> str:
    """A role stands in brackets, so `]` goes too."""
    return re.sub(r"[\\<\[\]]", lambda m: _OUT[m[0]], role)


def unescaped(text: str) -> str:
    """Reads back texts and roles in one pass: a backslash always begins an escape."""
    return re.sub(r"\\[\\lbc]", lambda m: _BACK[m[0]], text)


def instruct_template(turns: list[Turn]) -> str:
    """`<s>[INST] user [/INST]`, `<s>[OUT] assistant [/OUT]</s>`, `<s>[SYS] system [/SYS]`, else `<s>[ROLE name] text [/ROLE]`."""
    out = []
    for role, text in turns:
        body = escaped(text)
        if role == "assistant":
            out.append(f"<s>[OUT] {body} [/OUT]</s>")
        elif role in ("user", "system"):
            tag = "INST" if role == "user" else "SYS"
            out.append(f"<s>[{tag}] {body} [/{tag}]")
        else:
            out.append(f"<s>[ROLE {escaped_role(role)}] {body} [/ROLE]")
    return "".join(out)


_TURN = re.compile(r"<s>\[(INST|OUT|SYS|ROLE)(?: ([^\]]*))?\] (.*) \[/(?:INST|OUT|SYS|ROLE)\](?:</s>)?", re.S)
_ROLES = {"INST": "user", "OUT": "assistant", "SYS": "system"}


def read_turn(span: str) -> tuple[str, str, int, int]:
    """Role, text and the place of the escaped text in a span of instruct_template."""
    m = _TURN.fullmatch(span)
    if not m:
        raise ValueError(f"not a turn of the template: {span[:80]!r}")
    role = _ROLES.get(m[1]) or unescaped(m[2])
    return role, unescaped(m[3]), m.start(3), m.end(3)


def spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], int | None]:
    """The last output, each turn's span in it, and the first turn that rewrote history, if any."""
    before, found = "", []
    for i in range(1, len(turns) + 1):
        now = template(turns[:i])
        if not now.startswith(before):
            return now, found, i - 1
        found.append((len(before), len(now)))
        before = now
    return before, found, None


def _key(conv_id: Column) -> tuple[Column, Column]:
    """pandas has no null integers: a number and whether it stands for a null."""
    return F.coalesce(conv_id.cast("long"), F.lit(0)).alias("conv_id"), conv_id.isNull().alias("unknown")


def _named() -> Column:
    return F.when(~F.col("unknown"), F.col("conv_id")).alias("conv_id")


def format_conversations(rows: DataFrame, template: Template = instruct_template, read: Callable = read_turn) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv_id, formatted, turn_spans, loss_spans, rewritten_at.

    turn_spans and loss_spans hold (start, stop) in code points of formatted; loss_spans cover the assistant
    texts alone. rewritten_at is null unless the template rewrote history; then the spans end there.
    Null texts and roles are empty. Rows that share a turn number are ordered by role and text; a null
    conv_id is a conversation; an empty table gives none.
    """
    slim = rows.select(
        *_key(F.col("conv_id")), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "unknown", "turn", "role", "text")

    columns = ["conv_id", "unknown", "formatted", "turn_spans", "loss_spans", "rewritten_at"]

    def one(key, turns: list[Turn]) -> dict:
        formatted, found, rewritten = spans(turns, template)
        loss = []
        if rewritten is None:
            for a, b in found:
                role, _, start, stop = read(formatted[a:b])
                if role == "assistant":
                    loss.append((a + start, a + stop))
        return {"conv_id": key[0], "unknown": key[1], "formatted": formatted, "turn_spans": found, "loss_spans": loss, "rewritten_at": rewritten}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, turns, done = (), [], []
        for pdf in batches:
            for conv_id, unknown, role, text in zip(*(pdf[c].tolist() for c in ("conv_id", "unknown", "role", "text")), strict=True):
                if (conv_id, unknown) != key:
                    if turns:
                        done.append(one(key, turns))
                    key, turns = (conv_id, unknown), []
                    if len(done) >= 500:
                        yield pd.DataFrame(done, columns=columns).astype({"rewritten_at": "Int32"})
                        done = []
                turns.append((role, text))
        if turns:
            done.append(one(key, turns))
        if done:
            yield pd.DataFrame(done, columns=columns).astype({"rewritten_at": "Int32"})

    schema = "conv_id long, unknown boolean, formatted string, turn_spans array<struct<start:long,stop:long>>, loss_spans array<struct<start:long,stop:long>>, rewritten_at int"
    return dealt.mapInPandas(run, schema).select(_named(), *columns[2:])


def digests(formatted: DataFrame, read: Callable = read_turn) -> DataFrame:
    """What format_conversations wrote, read back from it: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, turn_spans, loss_spans in zip(pdf["formatted"], pdf["turn_spans"], pdf["loss_spans"], strict=True):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for s in turn_spans:
                    role, said, _, _ = read(text[s["start"] : s["stop"]])
                    turns.update(f"{role}\n{said}\n".encode())
                chars = 0
                for s in loss_spans:
                    said = unescaped(text[s["start"] : s["stop"]])
                    chars += len(said)
                    loss.update(said.encode())
                rows.append((len(turn_spans), turns.hexdigest(), chars, loss.hexdigest(), len(text)))
            yield pd.concat([pdf[["conv_id", "unknown"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = "conv_id long, unknown boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(*_key(F.col("conv_id")), "formatted", "turn_spans", "loss_spans").mapInPandas(run, schema).select(_named(), *names)
