"""Chat formatting in budgeted windows.

Turns are formatted by a template whose control strings are escaped inside texts,
and counted in tokens where they are read. Prefix sums of the counts over a
conversation choose spans of whole turns that fit the budget. Every window starts
with the conversation's system turn and with limited history from the span
before; the loss mask covers each assistant text once, in the window where it is
new.

A conversation's windows depend on each other, so they are laid by one task, which
streams through its sorted turns and holds no more than a window and the history.
Tokenizing, the costly part, is spread by rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.llm.common import table
from tabularium.llm.tokens import encoder, public_vocabulary

# The control strings of the template.
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET, HISTORY = 2048, 512
SYSTEM, ASSISTANT = "system", "assistant"

_RISKY = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(ROLE_END)}(.*?){re.escape(CLOSE)}", re.S)


def escape(text: str) -> str:
    r"""Text without control strings: a backslash follows the first character of each, and doubles each backslash."""
    return _RISKY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str | None, text: str | None) -> str:
    return f"{OPEN}{escape(role or '')}{ROLE_END}{escape(text or '')}{CLOSE}"


def turns_of(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(window)]


@dataclass
class Turn:
    role: str
    shown: str
    upto: int  # tokens of the conversation up to and with this turn
    tokens: int

    def target(self) -> tuple[int, int]:
        """Where the text lies in what is shown."""
        return self.shown.index(ROLE_END) + len(ROLE_END), len(self.shown) - len(CLOSE)


@dataclass
class Layout:
    """Windows of one conversation, from its turns in order."""

    budget: int
    history: int
    system: Turn | None = None
    recent: deque = field(default_factory=deque)
    fresh: list = field(default_factory=list)
    repeated: list = field(default_factory=list)
    number: int = 0

    def add(self, turn: Turn) -> Iterator[dict]:
        if self.fresh and turn.upto - self._base() > self.budget:
            yield self.closed()
            head = [self.system] if self.system and turn.role != SYSTEM and self.system.tokens + turn.tokens <= self.budget else []
            room = self.budget - turn.tokens - sum(t.tokens for t in head)
            past = [t for t in self.recent if t is not self.system and self._since(t, turn) <= min(self.history, room)]
            self.repeated, self.fresh = head + past, []
        self.fresh.append(turn)
        if turn.role == SYSTEM:
            self.system = turn
        self.recent.append(turn)
        while self.recent and turn.upto - (self.recent[0].upto - self.recent[0].tokens) > self.history:
            self.recent.popleft()

    @staticmethod
    def _since(earlier: Turn, turn: Turn) -> int:
        """Tokens from the start of an earlier turn to that of this one."""
        return turn.upto - turn.tokens - (earlier.upto - earlier.tokens)

    def _base(self) -> int:
        """The prefix sum at which the window would start, were all its turns consecutive."""
        return self.fresh[0].upto - self.fresh[0].tokens - sum(t.tokens for t in self.repeated)

    def closed(self) -> dict:
        at, mask, shown = 0, [], self.repeated + self.fresh
        for n, turn in enumerate(shown):
            if n >= len(self.repeated) and turn.role == ASSISTANT:
                start, end = turn.target()
                mask.append({"start": at + start, "end": at + end})
            at += len(turn.shown)
        self.number += 1
        return {
            "window": self.number - 1, "n_tokens": sum(t.tokens for t in shown), "n_repeated": len(self.repeated), "n_turns": len(self.fresh),
            "text": "".join(t.shown for t in shown), "loss_mask": mask,
        }


WINDOWS = "conv string, window int, n_tokens long, n_repeated int, n_turns int, text string, loss_mask array<struct<start: int, end: int>>"


def _lay(budget: int, history: int, rows_at_once: int = 2000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WINDOWS.split(", ")[:7]]
        now, layout, out = (), None, []
        for batch in batches:
            for conv, role, shown, upto, tokens in zip(batch["conv"], batch["role"], batch["shown"], batch["upto"], batch["tokens"]):
                if (conv,) != now:
                    if layout:
                        out.append({"conv": now[0]} | layout.closed())
                    now, layout = (conv,), Layout(budget, history)
                out += [{"conv": conv} | w for w in layout.add(Turn(role, shown, upto, tokens))]
                if len(out) >= rows_at_once:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if layout:
            out.append({"conv": now[0]} | layout.closed())
        yield pd.DataFrame(out, columns=names)

    return run


def _counted(shown: Column, vocabulary: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(x)) for x in batch], dtype="int64")

    return run(shown)


def _shown(role: Column, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([formatted(r, t) for r, t in zip(roles, texts)], dtype=object)

    return run(role, text)


def windows(
    turns: DataFrame,
    vocabulary: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per window: conv, window (from 0), n_tokens, n_repeated, n_turns, text and loss_mask (character spans).

    Turns are ordered by turn_col, then role and text; a null turn comes first. A null text or role is an empty one;
    rows with a null conversation form one. Repeated rows are turns of their own. A window exceeds the budget only by a
    single turn longer than it. The latest system turn before a window stands at its head wherever it and the first new
    turn fit the budget; history gives way to it. The first n_repeated turns of a window are repeated, the next n_turns
    new. Tied turns keep the order of role and text; a text of any length is one turn. An empty table gives an empty
    result. Other columns are not read, so their names cannot clash. Each partition holds whole conversations, one
    after the other, their windows in order.
    """
    kind = turns.schema[conv_col].dataType
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("shown", _shown(F.col("role"), F.col("text")))
    rows = rows.select("conv", "turn", "role", "shown", _counted(F.col("shown"), vocabulary).alias("tokens"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "shown").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.repartition("conv").withColumn("upto", F.sum("tokens").over(order)).sortWithinPartitions("conv", "turn", "role", "shown")
    laid = summed.select("conv", "role", "shown", "upto", "tokens").mapInPandas(_lay(budget, history), WINDOWS)
    return laid.withColumn("conv", F.col("conv").cast(kind))


READ_BACK = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ_BACK.split(", ")]
    now: tuple = ()
    turns = loss = hashlib.sha256()
    n_turns = loss_chars = chars = 0
    for batch in batches:
        out = []
        for conv, skip, text, mask in zip(batch["conv"], batch["n_repeated"], batch["text"], batch["loss_mask"]):
            if (conv,) != now:
                if now:
                    out.append((now[0], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, turns, loss = (conv,), hashlib.sha256(), hashlib.sha256()
                n_turns = loss_chars = chars = 0
            for role, said in turns_of(text)[skip:]:
                turns.update(f"{role}\n{said}\n".encode())
                n_turns += 1
            for span in mask:
                said = unescape(text[span["start"] : span["end"]])
                loss.update(said.encode())
                loss_chars += len(said)
            chars += len(text)
        yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame([(now[0], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], columns=names)


def read_back(laid: DataFrame, in_order: bool = False) -> DataFrame:
    """What the windows of each conversation hold: conv, n_turns, digests of turns and of the text under the loss mask, lengths.

    Windows that come straight from windows() are in_order; others, such as a table of them, are first dealt by
    conversation and sorted.
    """
    kind = laid.schema["conv"].dataType
    rows = laid.select(F.col("conv").cast("string").alias("conv"), "window", "n_repeated", "text", "loss_mask")
    if not in_order:
        rows = rows.repartition("conv").sortWithinPartitions("conv", "window")
    rows = rows.drop("window")
    return rows.mapInPandas(_read, READ_BACK).withColumn("conv", F.col("conv").cast(kind))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    laid = windows(turns.unionByName(own), public_vocabulary("byte_bpe_50k.json"))
    return read_back(laid, in_order=True).withColumnRenamed("conv", "conv_id")


QUERIES = {"op7_chat_windows": op7_chat_windows}
ORACLES: dict[str, str] = {}
