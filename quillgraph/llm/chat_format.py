"""Chat formatting with a grammar round trip.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn ``[ANS] text </s>``, a system turn
``[SYS] text [/SYS]``; any other role r is ``[ROLE=r] text [/ROLE]``, with r percent-encoded. Each turn is rendered as it
is, read again by the parser, and compared with its source. If they differ, because the text holds strings of the
template, the text is escaped and the turn rendered again, until what is read is the source.

Escaping puts one more backslash behind the opening character of everything that looks like a control string, with any
number of backslashes there; the parser takes one away. So a text that already looks escaped comes back as well, and one
level always suffices. A turn begins and ends with a control string and a blank separates them from the text, so turns
parse alike alone and in a row: nothing needs the whole conversation in memory.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER_END = "[/ROLE]"
_BODY = r"/?INST\]|ANS\]|/?SYS\]|/ROLE\]|ROLE=[^\[\]<\\\s]*\]|/s>"
CONTROL = re.compile(rf"[\[<](?:{_BODY})")
_ESCAPABLE = re.compile(rf"([\[<])(\\*)({_BODY})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)({_BODY})")


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def marks(role: str) -> tuple[str, str]:
    return TURNS.get(role) or (f"[ROLE={quote(role, safe='')}]", OTHER_END)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and begin and length of the text as it stands in ``rendered``, of each turn. Deterministic: the first control
    string opens a turn and the next one must close it."""
    starts = {begin: (role, end) for role, (begin, end) in TURNS.items()}
    out, at = [], 0
    while at < len(rendered):
        opening = CONTROL.match(rendered, at)
        closing = opening and CONTROL.search(rendered, opening.end())
        if not closing:
            raise ValueError(f"no whole turn at {at}")
        mark = opening[0]
        role, end = starts.get(mark) or ((unquote(mark[6:-1]), OTHER_END) if mark.startswith("[ROLE=") else (None, None))
        inside = rendered[opening.end() : closing.start()]
        if role is None or closing[0] != end or len(inside) < 2 or inside[0] != " " or inside[-1] != " ":
            raise ValueError(f"bad turn at {at}")
        out.append((role, unescape(inside[1:-1]), opening.end() + 1, len(inside) - 2))
        at = closing.end()
    return out


def render(role: str, text: str) -> tuple[str, int]:
    """A turn that parses to its source, and how often it was escaped."""
    begin, end = marks(role)
    shown = text
    for level in range(3):
        turn = f"{begin} {shown} {end}"
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn, level
        except ValueError:
            pass
        shown = escape(text)
    raise ValueError(f"a turn doesn't come back: {role!r} {text[:100]!r}")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``rendered``, ``escapes``, ``loss_start`` and ``loss_length`` of each turn.

    The formatted conversation is its ``rendered`` in order (see ``in_order``). The loss mask covers assistant texts:
    code points from ``loss_start`` of ``rendered``; null for other roles. A null text or role counts as empty. A pass
    over the rows, none of which is merged or dropped; an empty table gives an empty result; other columns are ignored.
    """
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turn {turns.schema['turn'].dataType.simpleString()}, role string, rendered string, escapes int, loss_start int, loss_length int"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rendered, escapes, starts, lengths, roles = [], [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turn, level = render(role, text)
                _, _, at, length = parse(turn)[0]
                learn = role == "assistant"
                rendered.append(turn)
                escapes.append(level)
                starts.append(at if learn else None)
                lengths.append(length if learn else None)
                roles.append(role)
            columns = [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(rendered, pa.string()), *(pa.array(x, pa.int32()) for x in (escapes, starts, lengths))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "rendered", "escapes", "loss_start", "loss_length"])

    text = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(run, schema)


def in_order(formatted: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order: null turns first, ties by role and text."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "rendered")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the parser reads from the formatted turns: ``n_turns``, ``turns_sha256`` over role, line break, text,
    line break of each turn, ``loss_chars`` and ``loss_sha256`` over the unescaped texts under the loss mask, and
    ``formatted_chars``, ``escaped_turns``.

    Turns stream through in order and only running digests are kept, so a conversation of any length takes the memory
    of one batch. Null conversation ids are one conversation.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long"

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns"]
        at, state, done = None, None, []

        def close():
            done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv, rendered, start, length, escapes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(rendered[start : start + length])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(rendered)
                state[5] += escapes > 0
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=out)
                done = []
        if state is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=out)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema(
        [("conv_id", to_arrow_type(formatted.schema["conv_id"].dataType)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("escaped_turns", pa.int64())]
    )
    return in_order(formatted).select("conv_id", "rendered", "loss_start", "loss_length", "escapes").mapInArrow(run, schema)


HARD = "</s>[INST] ok [/INST]"


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(1).select(F.expr(f"inline(array(struct(-7L as conv_id, 0L as turn, 'user' as role, '{HARD}' as text), struct(-7L as conv_id, 1L as turn, 'assistant' as role, '{HARD}' as text)))"))
    return read_back(format_turns(turns.unionByName(hard)))


QUERIES = {"op2_chat_format": op2_chat_format}
_TEXT = r"([\[<])(\\*)(/?INST\]|ANS\]|/?SYS\]|/ROLE\]|ROLE=[^\[\]<\\\s]*\]|/s>)"
ORACLES = {
    "op2_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD}'
  UNION ALL SELECT -7, 1, 'assistant', '{HARD}'
), r AS (
  SELECT *, CASE WHEN regexp_matches(text, '{_TEXT}') THEN regexp_replace(text, '{_TEXT}', '\1\\\2\3', 'g') ELSE text END AS shown,
    CASE role WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('[ANS]  </s>') WHEN 'system' THEN length('[SYS]  [/SYS]') END AS marks
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, shown)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, shown) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown) + marks) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (shown <> text) AS BIGINT) AS escaped_turns
FROM r GROUP BY conv_id
"""
}
