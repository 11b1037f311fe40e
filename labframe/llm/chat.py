"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply under the loss mask.
Turns behind the last assistant turn are kept in one more example that trains nothing, so the output holds every turn.

Template of a turn: ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no control string can come from a text; in roles a newline also gets a backslash.
Dropping the backslash before any character undoes all of it.

Cases: null text and null role count as empty. Turns are ordered by number, nulls first, then by role and text, so ties and
repeated rows have one order. A null conv_id is a conversation of its own. Empty tables give empty results. Other columns,
whatever their names, are ignored. Very long texts are formatted whole; a conversation is one array in one task, so its
turns must fit there together. The size of the output is the square of a conversation's length, which is what the
expansion means; no row is dropped for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
EXAMPLES = "conv_id long, example int, formatted string, loss_start int, loss_end int"
READ = "conv_id long, example int, n_turns long, turns_sha256 string, loss_text string, formatted_chars long"
_TURN = re.compile(r"<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def gather(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns as an ordered array of (turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per example. loss_start and loss_end are code points in ``formatted``: the reply with its escapes.

    An example that trains nothing has loss_start = loss_end.
    """

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "example", "formatted", "loss_start", "loss_end"]
        for batch in batches:
            rows, held = [], 0
            for conv_id, turns in zip(batch.conv_id, batch.turns, strict=True):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                so_far, n = "", 0
                for turn in turns:
                    head = f"{START}{escape_role(turn['role'])}\n"
                    text = escape(turn["text"])
                    start = len(so_far) + len(head)
                    so_far += f"{head}{text}{END}\n"
                    if target := turn["role"] == target_role:
                        rows.append((conv_id, n, so_far, start, start + len(text)))
                        n, held = n + 1, held + len(so_far)
                if len(turns) and not target:
                    rows.append((conv_id, n, so_far, len(so_far), len(so_far)))
                    held += len(so_far)
                if held > 8_000_000:  # hand on before a batch of long conversations fills the memory
                    yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    return gather(conversations).mapInPandas(examples, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """What a trainer reads from each example: its turns (as a digest), the unescaped text under the mask, its length."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv_id, k, text, start, end in zip(b.conv_id, b.example, b.formatted, b.loss_start, b.loss_end, strict=True):
                turns = [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((None if pd.isna(conv_id) else int(conv_id), k, len(turns), digest, unescape(text[start:end]), len(text)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"conv_id": "Int64"})

    return examples.mapInPandas(parse, READ)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone. The longest example holds every turn."""
    read = read_back(examples)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss_text"))), lambda x: x["loss_text"]), "")
    got = read.groupBy("conv_id").agg(
        F.max_by(F.struct("n_turns", "turns_sha256"), "example").alias("all"), joined.alias("loss"), F.sum("formatted_chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return got.select(
        "conv_id", "all.n_turns", "all.turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
