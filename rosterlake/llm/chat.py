r"""Chat formatting: a template as a black box, whose turns are located by rendering successive prefixes.

The template is any function from a list of (role, text) to a string.  Rendering
the first k turns, for each k, and comparing consecutive outputs gives each
turn's span: what the k-th output adds after the (k-1)-th.  Where an output
does not start with the one before, the template rewrites history: the
conversation is flagged, and its span starts at the last common character.  The
loss mask needs no more knowledge of the template: a trained turn is rendered
with two other texts in its place, and what these two outputs share before and
after is the turn's header and end, so that the text's own span is what is left.

The template here writes ``<|turn|>role<|text|>text<|end|>\n``; inside roles and
texts a backslash doubles, and a control string gets one after its first
character, so that removing one backslash before each character restores them.

Defined cases: null role or text counts as empty; a null conv_id is one
conversation; equal turn numbers are ordered by role, then text, null turn
numbers first; repeated rows are turns each; other columns are dropped; an
empty table gives no rows; a conversation whose template rewrites history has no
loss mask, as its spans don't hold in the last output.  A conversation is
rendered in one task, each prefix in full, as a black box leaves no other way.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]

# Control strings of this and other chat templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    # Replacing until none is left: breaking one control string may not leave another.
    text = text.replace("\\", "\\\\")
    while _CONTROL.search(text):
        text = _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def template(turns: Turns) -> str:
    return "".join(f"<|turn|>{escape(role)}<|text|>{escape(text)}<|end|>\n" for role, text in turns)


def turn_spans(turns: Turns, render: Callable[[Turns], str] = template) -> tuple[str, list[tuple[int, int]], bool]:
    """The whole output, each turn's (start, end) in it, and whether the template rewrites history."""
    before, spans, rewrites = render([]), [], False
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        if now.startswith(before):
            start = len(before)
        else:
            rewrites, start = True, len(os.path.commonprefix((before, now)))
        spans.append((start, len(now)))
        before = now
    return before, spans, rewrites


# Two texts that share no start and no end; templates that trim or join texts to their marks still tell them apart.
PROBES = ("a", "b")


def loss_spans(turns: Turns, spans: list[tuple[int, int]], render: Callable[[Turns], str] = template, trained: str = "assistant") -> list[tuple[int, int]]:
    """Where the trained role's texts lie in the output, header and end mark left out, by rendering each with other texts in its place."""
    found = []
    for k, ((role, _), (_, end)) in enumerate(zip(turns, spans, strict=True)):
        if role == trained:
            one, two = (render([*turns[:k], (role, probe)]) for probe in PROBES)
            head = len(os.path.commonprefix((one, two)))
            tail = len(os.path.commonprefix((one[:head:-1], two[:head:-1])))
            found.append((head, end - tail))
    return found


def format_conversations(rows: DataFrame, render: Callable[[Turns], str] = template) -> DataFrame:
    """conv_id, formatted, turn_spans, loss_spans, rewrites_history: one row per conversation.

    Rows are dealt by conversation and sorted; each task streams them and holds
    one conversation at a time.
    """
    ordered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))

    def one(conv: str, turns: Turns) -> tuple:
        output, spans, rewrites = turn_spans(turns, render)
        loss = [] if rewrites else loss_spans(turns, spans, render)
        return (None if conv == "-" else int(conv), output, [list(s) for s in spans], [list(s) for s in loss], rewrites)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "formatted", "turn_spans", "loss_spans", "rewrites_history"]

        def frame(done):
            return pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})

        now, turns = None, []
        for batch in batches:
            done = []
            for conv, role, text in zip(batch["conv"].tolist(), batch["role"].tolist(), batch["text"].tolist(), strict=True):
                if conv != now:
                    if now is not None:
                        done.append(one(now, turns))
                    now, turns = conv, []
                turns.append((role, text))
            if done:
                yield frame(done)
        if now is not None:
            yield frame([one(now, turns)])

    return ordered.mapInPandas(run, "conv_id long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewrites_history boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history: parsed from the output alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, loss in zip(batch["formatted"], batch["loss_spans"], strict=True):
                turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                lost = "".join(unescape(text[a:b]) for a, b in loss)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            frame = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            frame.insert(0, "conv_id", batch["conv_id"].astype("Int64").to_numpy())
            frame["rewrites_history"] = batch["rewrites_history"].to_numpy()
            yield frame

    return formatted.select("conv_id", "formatted", "loss_spans", "rewrites_history").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    )
