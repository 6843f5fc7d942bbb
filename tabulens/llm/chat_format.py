"""Chat formatting: a fingerprint of a record's field paths selects the mapping that reads it.

A record is a JSON object. Its nested field paths (``messages[].role``), sorted and hashed, are its fingerprint; a layout is
registered under the fingerprint of every combination of its fields and says declaratively where the turns are. Canonical
turns (role, text) are written in one template:

    <|im_start|>role\\ntext<|im_end|>\\n

and the assistant's texts are the spans under the loss mask. In roles and texts a backslash is doubled and a backslash goes
behind the first character of every control string (a line break in a role is ``\\\\;``), so no text can pose as markup and reading back gives every text exactly.

Edge cases: a null text or role is an empty one, and a field that is null counts as absent. A record of unknown layout, a
null one or one that is no JSON object keeps its row, with null results. Turns are taken by number; turns with equal numbers
by role and text, a null number first. Rows with a null id are one conversation. Repeated rows are repeated turns. An empty
table gives no rows. A conversation is one value of one row, as every conversation of a training set is, and must fit there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulens.llm.common import col, small_batches

START, END = "<|im_start|>", "<|im_end|>"
# The control strings of common chat templates.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<bos>", "<eos>",
    "<start_of_turn>", "<end_of_turn>",
)
# Other names of the three canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPE = re.compile(r"\\([\\;])?")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


@dataclass(frozen=True)
class ListLayout:
    """Turns are the items of a list; each has its role and its text in a field."""

    items: str
    role: str
    text: str
    optional: tuple[str, ...] = ()
    rename: bool = True

    def paths(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return tuple(f"{self.items}[].{f}" for f in (self.role, self.text)), self.optional

    def turns(self, record: dict[str, Any]) -> list[tuple[str, str]]:
        first = [("system", record[s]) for s in ("system",) if isinstance(record.get(s), str)]
        items = [(item.get(self.role) or "", item.get(self.text) or "") for item in record[self.items]]
        return first + [(ROLES.get(role, role) if self.rename else role, text) for role, text in items]


@dataclass(frozen=True)
class FieldLayout:
    """Each turn is a field, or several joined by an empty line, in the order given."""

    fields: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        every = tuple(f for _, names in self.fields for f in names)
        return tuple(f for f in every if f not in self.optional), self.optional

    def turns(self, record: dict[str, Any]) -> list[tuple[str, str]]:
        there = [(role, [record[n] for n in names if record.get(n) is not None]) for role, names in self.fields]
        return [(role, "\n\n".join(texts)) for role, texts in there if texts]


LAYOUTS: dict[str, ListLayout | FieldLayout] = {
    "turn_rows": ListLayout("turns", "role", "text", rename=False),
    "messages": ListLayout("messages", "role", "content", ("system", "id")),
    "sharegpt": ListLayout("conversations", "from", "value", ("system", "id")),
    "instruction": FieldLayout((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    "prompt_response": FieldLayout((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    "prompt_completion": FieldLayout((("user", ("prompt",)), ("assistant", ("completion",)))),
    "question_answer": FieldLayout((("user", ("context", "question")), ("assistant", ("answer",))), ("context",)),
}


def field_paths(value: Any, path: str = "") -> set[str]:
    """The paths of all fields that hold a value, lists marked by []."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items() if v is not None))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{path}[]") for v in value)) if value else {f"{path}[]"}
    return {path}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: dict[str, ListLayout | FieldLayout]) -> dict[str, str]:
    """The name of the layout for each fingerprint; of equal fingerprints the first layout has it."""
    known: dict[str, str] = {}
    for name, layout in layouts.items():
        needed, optional = layout.paths()
        for k in range(len(optional) + 1):
            for extra in combinations(optional, k):
                known.setdefault(fingerprint((*needed, *extra)), name)
    return known


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: {"\\": "\\", ";": "\n"}.get(m[1], ""), text)


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\;") + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END + "\n")
        at += len(out[-1])
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def format_records(records: DataFrame, record: str = "record", layouts: dict[str, ListLayout | FieldLayout] | None = None) -> DataFrame:
    """The rows with ``chat``: fingerprint, layout, formatted text, loss spans (start, end in code points)."""
    small_batches(records.sparkSession)
    known_layouts = LAYOUTS if layouts is None else layouts
    known = registry(known_layouts)

    @pandas_udf("fingerprint string, layout string, formatted string, loss array<struct<start: int, end: int>>")
    def convert(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                found = json.loads(value) if value is not None else None
            except ValueError:
                found = None
            if not isinstance(found, dict):
                rows.append((None, None, None, None))
                continue
            mark = fingerprint(field_paths(found))
            name = known.get(mark)
            if name is None:
                rows.append((mark, None, None, None))
                continue
            text, spans = write(known_layouts[name].turns(found))
            rows.append((mark, name, text, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=["fingerprint", "layout", "formatted", "loss"])

    return records.withColumn("chat", convert(col(record)))


def conversation_records(turns: DataFrame) -> DataFrame:
    """One JSON record for each conv_id, from rows by turn (conv_id, turn, role, text)."""
    item = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(ordered.alias("turns"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What reading the output gives: n_turns, the digests of turns and loss texts, and the lengths."""

    @pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(texts: pd.Series, losses: pd.Series) -> pd.DataFrame:
        rows = []
        for text, loss in zip(texts, losses):
            turns = read(text or "")
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in (loss if loss is not None else ()))
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text or "")))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", digest("chat.formatted", "chat.loss").alias("d")).select("conv_id", "d.*")
