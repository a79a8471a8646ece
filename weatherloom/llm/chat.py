"""Chat formatting with any template, which is looked at from outside only.

A template is a function from turns (role, text) to one string. The spans of a conversation's turns
are found by rendering successive prefixes of it and comparing each output with the one before: what
is new belongs to the last turn. A template whose output for a prefix is not where the next output
begins rewrites history; such conversations are marked, as their spans mean nothing. Within a turn's
span the text's place is found by rendering the same turns with a probe in place of the text.

Every prefix of a conversation is rendered whole, so a template may look back as far as it likes. This
takes time that grows with the square of a conversation's turns, and memory for all of them. Only
for a template that its caller declares to depend on at most `look_back` earlier turns, rendering
starts anew from that many turns after each segment, which takes time in proportion to the turns.

Turns are rows. They are sorted by conversation and turn within partitions and stream through Python
a segment at a time.
"""

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

SEGMENT = 32
# `turn_template` writes each turn by itself.
TURN_LOOK_BACK = 0
# Stands in for a text to find its place; templates pass it through as it is.
PROBE = "\ue000"
ROWS_PER_BATCH = 1000

# --- a template whose turns can be read back -----------------------------------------------------

# Fixed marks of the template; ": " ends a role.
TURN, END, ROLE_END = "### ", "</turn>\n", ": "
_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|: ")
_ESCAPED = re.compile(r"\\([\\_])")


def _escape(text: str, control: re.Pattern) -> str:
    """A backslash is doubled, and a control string is broken by `\\_` after its first character."""

    def broken(match):
        found = match[0]
        return "\\\\" if found == "\\" else f"{found[0]}\\_{found[1:]}"

    return control.sub(broken, text)


def escape(text: str) -> str:
    """`text` without any control string; `unescape` gives it back."""
    return _escape(text, _CONTROL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def turn_template(turns: list[Turn]) -> str:
    """`### role: text</turn>` and a line break for each turn, with control strings escaped."""
    return "".join(
        f"{TURN}{_escape(role, _ROLE_CONTROL)}{ROLE_END}{escape(text)}{END}" for role, text in turns
    )


def parse_turns(formatted: str) -> list[Turn]:
    """Turns of a string that `turn_template` wrote, from the string alone."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(TURN).partition(ROLE_END)
        turns.append((unescape(role), unescape(text)))
    return turns


# --- spans by black-box rendering ----------------------------------------------------------------


def turn_pieces(template: Template, before: list[Turn], turns: list[Turn]) -> Iterator[dict]:
    """For each of `turns`, what it adds to the output after the turns `before`.

    `piece`: the text added; `text_start`, `text_end`: where the turn's text lies in it, null if the
    template does not write it in one place; `rewrites`: the output so far has changed.
    """
    shown = list(before)
    last = template(shown)
    for role, text in turns:
        output = template([*shown, (role, text)])
        rewrites = not output.startswith(last)
        piece = output if rewrites else output[len(last) :]
        probed = template([*shown, (role, PROBE)])
        head, found, tail = probed[len(last) :].partition(PROBE)
        placed = (
            not rewrites
            and bool(found)
            and probed.startswith(last)
            and len(piece) >= len(head) + len(tail)
            and piece.startswith(head)
            and piece.endswith(tail)
        )
        yield {
            "piece": piece,
            "text_start": len(head) if placed else None,
            "text_end": len(piece) - len(tail) if placed else None,
            "rewrites": rewrites,
        }
        shown.append((role, text))
        last = output


FORMATTED = (
    "conv_id bigint, position bigint, role string, piece string, span_start bigint, span_end bigint,"
    " text_start bigint, text_end bigint, in_loss boolean, rewrites boolean"
)
_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("role", pa.string()),
        ("piece", pa.string()),
        ("span_start", pa.int64()),
        ("span_end", pa.int64()),
        ("text_start", pa.int64()),
        ("text_end", pa.int64()),
        ("in_loss", pa.bool_()),
        ("rewrites", pa.bool_()),
    ]
)


def _segments(batches, segment: int, look_back: int | None):
    """(conv_id, first position, turns before, turns) of consecutive turns of one conversation.

    The turns before are all of them, or the last `look_back`.
    """
    conv_id, first, before, turns, started = None, 0, [], [], False
    for batch in batches:
        for own, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if started and own != conv_id:
                yield conv_id, first, before, turns
                first, before, turns = 0, [], []
            elif len(turns) == segment:
                yield conv_id, first, before, turns
                first += len(turns)
                before, turns = [*before, *turns], []
                if look_back is not None:
                    before = before[max(len(before) - look_back, 0) :]
            conv_id, started = own, True
            turns.append((role, text))
    if turns:
        yield conv_id, first, before, turns


def _format(template, loss_roles, segment, look_back, schema):
    def formatted(batches):
        rows, at = [], 0
        for conv_id, first, before, turns in _segments(batches, segment, look_back):
            at = at if first else 0
            pieces = turn_pieces(template, before, turns)
            for position, ((role, text), found) in enumerate(zip(turns, pieces), first):
                end = at + len(found["piece"])
                rows.append(
                    {
                        "conv_id": conv_id,
                        "position": position,
                        "role": role,
                        "text": text,
                        "span_start": at,
                        "span_end": end,
                        "in_loss": role in loss_roles,
                        **found,
                    }
                )
                at = end
            if len(rows) >= ROWS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted


def format_conversations(
    conversations: DataFrame,
    template: Template = turn_template,
    loss_roles: tuple[str, ...] = ("assistant",),
    segment: int = SEGMENT,
    look_back: int | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Per turn, in order within a conversation: conv_id, position, role, piece, span_start,
    span_end (in the conversation's output), text_start, text_end (in the piece), in_loss, rewrites,
    and with `with_text` the text as given.

    `conversations` needs conv_id, turn, role and text; other columns are not looked at. Missing
    roles and texts are empty; rows without conv_id are a conversation of their own; turns with the
    same number follow in order of role and text, missing numbers come first. A conversation's
    output is its pieces in order of position. Turns of one conversation go through one task.

    `look_back` declares that what the template writes for a turn depends on at most that many turns
    before it and that it never rewrites more of them; rewriting from further back is then not seen,
    and a task holds a segment of turns at a time. Without it all prefixes are rendered whole.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    columns, schema = FORMATTED, _FORMATTED
    if with_text:
        columns, schema = f"{columns}, text string", schema.append(pa.field("text", pa.string()))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        _format(template, loss_roles, segment, look_back, schema), columns
    )


def _whole(template):
    def compared(batches):
        """The pieces of each conversation, joined, against one rendering of all its turns."""
        conv_id, turns, pieces = None, [], []

        def row():
            return [conv_id, template(turns) == "".join(pieces)]

        for batch in batches:
            rows = []
            for own, position, role, text, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0 and turns:
                    rows.append(row())
                    turns, pieces = [], []
                conv_id = own
                turns.append((role, text))
                pieces.append(piece)
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], ["conv_id", "holds"])
        if turns:
            yield pa.record_batch([[v] for v in row()], ["conv_id", "holds"])

    return compared


def look_back_holds(
    conversations: DataFrame, template: Template, look_back: int, segment: int = SEGMENT
) -> DataFrame:
    """Per conversation, whether the pieces rendered under a declared `look_back` are, joined, what
    the template writes for all its turns at once: conv_id, holds.

    Takes time in proportion to the turns, and memory for one conversation, so it is a test of a
    template rather than a part of formatting. Rows are treated as in `format_conversations`.
    """
    pieces = format_conversations(conversations, template, (), segment, look_back, with_text=True)
    return pieces.select("conv_id", "position", "role", "text", "piece").mapInArrow(
        _whole(template), "conv_id bigint, holds boolean"
    )


_READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)
_READ_COLUMNS = [part.split()[0] for part in _READ.split(",")]


def _read_back(parse):
    def read(batches):
        conv_id, state = None, None

        def row():
            n, turns, chars, loss, size = state
            return [conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for batch in batches:
            rows = []
            columns = ("conv_id", "position", "piece", "in_loss", "text_start", "text_end")
            for own, position, piece, in_loss, start, end in zip(
                *(batch.column(c).to_pylist() for c in columns)
            ):
                if position == 0:
                    if state:
                        rows.append(row())
                    conv_id, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                elif state is None or own != conv_id or position != state[0]:
                    raise ValueError("pieces of a conversation must come together and in order")
                ((role, text),) = parse(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
                if in_loss and start is not None:
                    masked = unescape(piece[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], _READ_COLUMNS)
        if state:
            yield pa.record_batch([[v] for v in row()], _READ_COLUMNS)

    return read


def read_back(formatted: DataFrame, parse=parse_turns) -> DataFrame:
    """Per conversation, from its pieces alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    The rows must come as `format_conversations` gives them, or sorted by conv_id and position with
    no conversation in two partitions. Texts are hashed as they stream by.
    """
    return formatted.mapInArrow(_read_back(parse), _READ)
