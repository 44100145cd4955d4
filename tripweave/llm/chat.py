"""Chat formatting that is proved by reading it back with a grammar.

    conversation := turn*
    turn         := "[INST] " text " [/INST]"            a user's
                  | "[SYS] " text " [/SYS]"              a system's
                  | "<s> " text "</s>"                   an assistant's
                  | "[ROLE] " role newline text " [/ROLE]"   any other's

The parser reads every control string as a token of its own, so one that stands inside a text or a
role is an error, also where it could not end the turn: what a tokenizer that knows these strings
sees are the marks of turns and nothing else. Escaped control strings have a backslash behind
their first character, and those that have backslashes there one more, so taking one away gives
the text back. A text is first set as it is; where the parser fails or reads something else from
it, it is escaped, until what is read is what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The words of the template.
OPEN = {"user": "[INST] ", "system": "[SYS] ", "assistant": "<s> "}
CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE = "[ROLE] ", " [/ROLE]"
LEARNED = "assistant"
#: A conversation whose texts are control strings, as a test that travels with the data.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"

CONTROL = re.compile(r"([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)")
TOKEN = re.compile(r"[\[<]/?(?:(?:INST|SYS|ROLE)\]|s>)")
ESCAPED = re.compile(r"([\[<])\\(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)")


class Turn(NamedTuple):
    role: str
    text: str


class Parsed(NamedTuple):
    """A turn as read, with the place of its text in what was parsed, and where the turn ends."""

    turn: Turn
    start: int
    stop: int
    end: int


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def parse_turn(text: str, at: int = 0) -> Parsed:
    """The turn that begins at a place; the first control string behind its opening must close it."""
    for role, opening in OPEN.items():
        if text.startswith(opening, at):
            start, closing = at + len(opening), CLOSE[role]
            break
    else:
        if not text.startswith(OTHER_OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = text.find("\n", at)
        if line < 0 or TOKEN.search(text, at + len(OTHER_OPEN), line):
            raise ValueError(f"no role ends behind {at}")
        role, start, closing = _unescape_role(text[at + len(OTHER_OPEN):line]), line + 1, OTHER_CLOSE
    token = TOKEN.search(text, start)
    stop = token.end() - len(closing) if token else -1
    if stop < start or not text.startswith(closing, stop):
        raise ValueError(f"the turn at {at} is not closed by its own kind")
    return Parsed(Turn(role, unescape(text[start:stop])), start, stop, stop + len(closing))


def parse(text: str) -> list[Parsed]:
    """All turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        turns.append(parse_turn(text, at))
        at = turns[-1].end
    return turns


def _set(turn: Turn, text: str) -> str:
    if turn.role in OPEN:
        return OPEN[turn.role] + text + CLOSE[turn.role]
    return f"{OTHER_OPEN}{_escape_role(turn.role)}\n{text}{OTHER_CLOSE}"


def render(turn: Turn) -> tuple[str, Parsed]:
    """The formatted turn and how it reads, escaped as often as the round trip needs."""
    body = turn.text
    for _ in range(2):
        formatted = _set(turn, body)
        try:
            read = parse_turn(formatted)
            if read.turn == turn and read.end == len(formatted):
                return formatted, read
        except ValueError:
            pass
        body = escape(turn.text)
    raise ValueError("a turn does not come back from its format")


def check_of(role: str, text: str) -> int:
    """A number by which a turn read back is held against the one that was written."""
    return xxhash.xxh64_intdigest(f"{role}\n{text}\n") - (1 << 63)


class Digest:
    """What a conversation reads as, fed turn by turn; holds sums and digests, never its text.
    Raises ValueError where it reads other turns than were written."""

    def __init__(self):
        self.turns = self.loss_chars = self.formatted_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, written: int) -> None:
        at, found = 0, []
        while at < len(formatted):
            read = parse_turn(formatted, at)
            role, text = read.turn
            found.append(check_of(role, text))
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == LEARNED:
                learned = unescape(formatted[read.start:read.stop])
                self.loss_chars += len(learned)
                self.loss.update(learned.encode())
            at = read.end
        if found != [written]:
            raise ValueError("a conversation does not come back from its format")
        self.formatted_chars += len(formatted)

    def row(self) -> list:
        return [self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars]


def format_conversation(turns: Iterable[Turn]) -> str:
    """A whole conversation as one text; raises ValueError unless it reads back the same."""
    turns = list(turns)
    text = "".join(render(turn)[0] for turn in turns)
    if [read.turn for read in parse(text)] != turns:
        raise ValueError("a conversation does not come back from its format")
    return text


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, mask_start, mask_stop and check of every row.

    `formatted` is the turn's part of the conversation; the mask is the span of characters in
    it that are learned (null but for an assistant); the check tells the turn that was written. Rows are formatted where they lie. A null
    role or text counts as empty; further columns are not read.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].cast("bigint").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"))
    schema = T.StructType(rows.schema.fields + [
        T.StructField("formatted", T.StringType()), T.StructField("mask_start", T.LongType()),
        T.StructField("mask_stop", T.LongType()), T.StructField("check", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [Turn(*pair) for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            made = [render(turn) for turn in turns]
            learned = [read.turn.role == LEARNED for _, read in made]
            yield pa.RecordBatch.from_arrays(batch.columns + [
                pa.array([text for text, _ in made], pa.string()),
                pa.array([read.start if own else None for own, (_, read) in zip(learned, made)], pa.int64()),
                pa.array([read.stop if own else None for own, (_, read) in zip(learned, made)], pa.int64()),
                pa.array([check_of(*turn) for turn in turns], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars per
    conversation, parsed from the formatted turns in order of turn and held against the turns that
    were written (a difference is an error).

    Turns come sorted to the task of their conversation and pass through one at a time, so a
    very long conversation needs no more memory than a short one; its digest is one sequence by
    its nature. Turns with equal numbers are in order of role and text, nulls come first.
    """
    order = ["conv_id", "turn", "role", "text"]
    schema = T.StructType([formatted.schema["conv_id"]] + [T.StructField(name, kind) for name, kind in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
        ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for key, text, written in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if digest is None or key != current:
                    if digest:
                        done.append([current, *digest.row()])
                    current, digest = key, Digest()
                digest.feed(text, written)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if digest:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip([current, *digest.row()], arrow)], schema=arrow)

    dealt = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "check")
    return dealt.mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more of a user and an assistant who say control strings.

    Rows that have its id already are turns of the same conversation, in order of turn with its two.
    """
    spark: SparkSession = conversations.sparkSession
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
        "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, read back from their format.

    Null ids are one conversation, a null text or role is empty, repeated rows are turns of
    their own, an empty table gives no rows.
    """
    return read_back(format_turns(conversations))
