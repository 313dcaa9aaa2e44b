"""Chat formatting with a grammar round trip.

Grammar of the formatted text, for which one left-to-right parser suffices::

    text  := turn*
    turn  := "<s>" role "\\n" body "</s>\\n"             role, body := (plain | "\\" any)*

User bodies stand between ``[INST] `` and `` [/INST]``, system bodies between ``<<SYS>>\\n`` and ``\\n<</SYS>>``, all
others stand bare.  A backslash makes the next character plain.  A turn is rendered with as little escaping as its
content allows: as it is; else with backslashes and control strings escaped; else with every special character escaped.
After each try the rendered turn is parsed again, and the first try that gives the turn back, character by character, is
used.  The parser also runs over the whole conversation, as a stream, while its digests are taken.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: What stands around a body, by role.
WRAPS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
#: Roles whose bodies the loss mask covers.
TAUGHT = ("assistant",)
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + r"|\\")
_SPECIAL = re.compile(r"[\\<\[\]>/\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: backslashes and control strings; 2: every character that a control string may hold."""
    return text if level == 0 else (_CONTROL if level == 1 else _SPECIAL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class GrammarError(ValueError):
    """The text is not one of the grammar."""


_TOKEN = re.compile(r"\\.|" + "|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + r"|\n", re.S)


def _find(text: str, at: int, stop: str) -> int:
    """Where the first unescaped ``stop`` begins; no other control string may come before it."""
    for m in _TOKEN.finditer(text, at):
        if m[0] == stop:
            return m.start()
        if m[0] in CONTROLS:
            break
    raise GrammarError(f"no {stop!r} where one has to be")


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role and body, both unescaped, where the escaped body begins and ends, and where the turn ends."""
    if not text.startswith(OPEN, at):
        raise GrammarError("no turn")
    line = _find(text, at + len(OPEN), "\n")
    role = unescape(text[at + len(OPEN) : line])
    before, after = WRAPS.get(role, ("", ""))
    begin = line + 1 + len(before)
    if text[line + 1 : begin] != before:
        raise GrammarError("the body has no beginning")
    mark = after.lstrip()  # the control string at the end of the body, after one character of white space
    end = _find(text, begin, mark or CLOSE) - (len(after) - len(mark))
    tail = after + CLOSE + "\n"
    if end < begin or not text.startswith(tail, end):
        raise GrammarError("the body has no end")
    return role, unescape(text[begin:end]), begin, end, end + len(tail)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its body begins and ends in it.

    Tries the levels of escaping in turn until parsing gives back ``role`` and ``text`` exactly.
    """
    for level in (0, 1, 2):
        before, after = WRAPS.get(role, ("", ""))
        head = OPEN + escape(role, level) + "\n" + before
        body = escape(text, level)
        out = head + body + after + CLOSE + "\n"
        try:
            got_role, got, begin, end, stop = parse_turn(out)
        except GrammarError:
            continue
        if (got_role, got, stop) == (role, text, len(out)):
            return out, begin, end
    raise GrammarError("no level of escaping gives the turn back")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        role, body, _, _, at = parse_turn(text, at)
        out.append((role, body))
    return out


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: ``conv, turn, role, text, rendered, loss_start, loss_end`` (code points in ``rendered``).

    A conversation's formatted text is its ``rendered`` values in order, by turn, then role, then text.  The loss mask
    covers ``rendered`` from ``loss_start`` to ``loss_end``: the body of an assistant turn, nothing of any other, whose
    ends are both 0.  Null role or text counts as empty.  Repeated rows are turns of their own, and turns with one number, role
    and text are equal, so their order does not matter.  A very long text is one turn, rendered whole.  Other columns are
    not read and may have any name; an empty table gives an empty result.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(2).to_pylist()
            done = [render_turn(a or "", b or "") for a, b in zip(roles, batch.column(3).to_pylist(), strict=True)]
            done = [(x, begin, end) if role in TAUGHT else (x, 0, 0) for role, (x, begin, end) in zip(roles, done, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["_conv", "_turn", "_role", "_text", "rendered", "loss_start", "loss_end"])

    plain = rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = plain.mapInArrow(run, f"_conv {kinds[conv]}, _turn {kinds[turn]}, _role string, _text string, rendered string, loss_start long, loss_end long")
    return out.toDF(conv, turn, role, text, "rendered", "loss_start", "loss_end")


def digest(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation, read back from the formatted text.

    ``n_turns``; ``turns_sha256`` over role, newline, text, newline of each turn that the parser finds; ``loss_chars`` and
    ``loss_sha256`` over what stands in ``rendered`` under the loss mask, unescaped; ``formatted_chars``.  A conversation streams through one task turn by turn:
    the digests are sequential by definition, and memory holds one turn, however long the conversation.  Null conversation
    identifiers are one conversation; repeated rows are turns of their own; an empty table gives an empty result.
    """
    kind = dict(formatted.dtypes)[conv]
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, state, done = none, None, []

        def flush(kind_of: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([x[0] for x in done], kind_of)] + [pa.array([x[i + 1] for x in done], f.type) for i, f in enumerate(schema)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def close() -> None:
            n, turns, chars, loss, size = state
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for key, rendered, begin, end in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if now is none or key != now:
                    if now is not none:
                        close()
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(rendered):
                    who, body, _, _, at = parse_turn(rendered, at)
                    state[0] += 1
                    state[1].update(f"{who}\n{body}\n".encode())
                taught = unescape(rendered[begin:end])
                state[2] += len(taught)
                state[3].update(taught.encode())
                state[4] += len(rendered)
            if done:
                yield flush(kind_of)
        if now is not none:
            close()
            yield flush(kind_of)

    ordered = formatted.select(F.col(conv).alias("_conv"), "rendered", "loss_start", "loss_end", F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    ordered = ordered.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "rendered", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)
