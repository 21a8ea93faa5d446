"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|turn|>role`` line, content, ``<|end|>`` line for each turn. The rendered text is
parsed again by a deterministic parser, and the turns it recovers are compared with the source. If they differ,
content that conflicts is escaped, round after round, until they are identical: an escape puts a backslash after
``<`` in each marker-like run ``<\\...|turn|>`` or ``<\\...|end|>`` (any number of backslashes, so escapes nest), and the
parser takes one away. A role that would break its line is escaped in the same way, its line ends as ``<|n|>`` and
``<|r|>``.

Nulls and edge cases: a null role or text is rendered as a turn marked ``<|null|>`` and comes back null, apart from an
empty one; turns are ordered by number, ties by role and text, null numbers first; repeated turns stay; turns with
a null conversation id form one conversation.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"<(\\*)\|(turn|end|null|n|r)\|>")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(s: str) -> str:
    return _MARK.sub(lambda m: f"<{m[1]}\\|{m[2]}|>", s)


def unescape(s: str) -> str:
    return _MARK.sub(lambda m: f"<{m[1][1:]}|{m[2]}|>" if m[1] else m[0], s)


def _role(role: str | None, escaped: bool) -> str:
    if role is None:
        return "<|null|>"
    if not escaped:
        return role
    return escape(role).replace("\n", "<|n|>").replace("\r", "<|r|>")


def render(turns: list[tuple[str | None, str | None]], escaped: list[bool]) -> str:
    """The turns as text, the flagged ones escaped."""
    out = []
    for (role, text), e in zip(turns, escaped):
        body = "<|null|>" if text is None else escape(text) if e else text
        out.append(f"<|turn|>{_role(role, e)}\n{body}<|end|>\n")
    return "".join(out)


def parse(rendered: str) -> list[tuple[str | None, str | None]] | None:
    """The turns of a rendered text; None if it doesn't follow the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            return None
        role, text = m[1], m[2]
        role = None if role == "<|null|>" else unescape(role.replace("<|n|>", "\n").replace("<|r|>", "\r"))
        turns.append((role, None if text == "<|null|>" else unescape(text)))
        at = m.end()
    return turns


def round_trip(turns: list[tuple[str | None, str | None]]) -> tuple[str, int]:
    """A rendering that parses to the same turns, and how many turns it escapes."""
    flags = [False] * len(turns)
    while True:
        rendered = render(turns, flags)
        if parse(rendered) == turns:
            return rendered, sum(flags)
        # escape the turns that don't survive on their own; if all do, the next that holds a mark
        bad = [i for i, t in enumerate(turns) if not flags[i] and parse(render([t], [False])) != [t]]
        bad = bad or [i for i, f in enumerate(flags) if not f][:1]
        for i in bad:
            flags[i] = True


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, escaped_turns, rendered) of each conversation."""

    def run(batches):
        for batch in batches:
            lists = batch.column("c")
            got = [round_trip([(x["r"], x["x"]) for x in c]) for c in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists.value_lengths().cast(pa.int32()), pa.array([n for _, n in got], pa.int32()), pa.array([r for r, _ in got], pa.string())], [key, "turns", "escaped_turns", "rendered"])

    kind = turns.schema[key].dataType.simpleString()
    every = turns.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("x")))).alias("c"))
    return every.mapInArrow(run, f"{key} {kind}, turns int, escaped_turns int, rendered string")
