"""Chat formatting that is checked by a grammar round trip.

A turn is written as a header line, its text and an end mark:

    ### Assistant:
    text
    </turn>

Headers are ``### User:``, ``### Assistant:``, ``### System:``, ``### Tool:``,
or ``### "name":`` with the role as a JSON string for any other role. Each
rendered turn is parsed again by a deterministic parser and compared with its
source. Text that does not come back is escaped more and more: control strings
get a backslash before them (after any backslashes already there), and if that
is not enough every backslash and number sign does.

The result has one row per turn: its piece of the conversation and where the
text under the loss mask lies in it. The pieces of a conversation in order are
the formatted conversation, so a very long one never has to fit in a row.

Defined cases: null text is empty; a null role is the empty role; rows of a
conversation go by turn, then role, then text; a null turn comes first, a null
conv_id is a conversation of its own; repeated rows are turns of their own.
Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>"
HEADER = re.compile(r'### (?:(User|Assistant|System|Tool)|("(?:[^"\\]|\\.)*")):')
CONTROL = re.compile(r'(\\*)(### (?:User|Assistant|System|Tool|"(?:[^"\\]|\\.)*"):|</turn>)')
#: How the text was escaped, told by the character after the header's colon.
PLAIN, MARKS, ALL = "\n", " \n", "  \n"


def escaped(text: str, level: str) -> str:
    """The text with nothing, its control strings, or every backslash and mark escaped."""
    if level == PLAIN:
        return text
    if level == MARKS:
        return CONTROL.sub(r"\\\1\2", text)
    return re.sub(r"[\\#<]", r"\\\g<0>", text)


def unescaped(text: str, level: str) -> str:
    """The inverse of ``escaped``."""
    if level == PLAIN:
        return text
    if level == MARKS:
        return CONTROL.sub(lambda m: m[1][1:] + m[2], text)
    return re.sub(r"\\([\\#<])", r"\1", text)


def rendered(role: str, text: str, level: str) -> tuple[str, int, int]:
    """One turn's piece, and start and end of its text in the piece."""
    name = NAMES.get(role) or json.dumps(role)
    head = f"### {name}:{level}"
    body = escaped(text, level)
    return f"{head}{body}\n{END}\n", len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted text, or None where it does not follow the grammar.

    turn = header, escape level, text up to the first end mark that no
    backslash precedes and that stands on its own line, newline.
    """
    turns, at = [], 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        if not head:
            return None
        role = ROLES[head[1]] if head[1] else json.loads(head[2])
        level = next((x for x in (ALL, MARKS, PLAIN) if formatted.startswith(x, head.end())), None)
        if level is None:
            return None
        start = head.end() + len(level)
        end = formatted.find(f"\n{END}\n", start)
        if end < 0 or any(not m[1] for m in CONTROL.finditer(formatted, start, end)):
            return None
        turns.append((role, unescaped(formatted[start:end], level)))
        at = end + len(END) + 2
    return turns


def checked(role: str, text: str) -> tuple[str, int, int]:
    """The piece with the least escaping that comes back as the same turn."""
    for level in (PLAIN, MARKS, ALL):
        piece, start, end = rendered(role, text, level)
        if parsed(piece) == [(role, text)]:
            return piece, start, end
    raise ValueError(f"a turn of role {role!r} does not survive the round trip")


FORMATTED = "conv_id long, piece string, loss_start long, loss_end long"


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def format_turns(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, piece, and loss_start and loss_end within the piece (null outside assistant turns), in order.

    Conversations are dealt by id and each partition is sorted, so turns
    stream through a task and no conversation is held whole.
    """
    n = partitions or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, starts, ends = [], [], []
            roles = batch.column(2).to_pylist()
            for role, text in zip(roles, batch.column(3).to_pylist(), strict=True):
                piece, start, end = checked(role, text)
                pieces.append(piece)
                starts.append(start if role == "assistant" else None)
                ends.append(end if role == "assistant" else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["conv_id", "piece", "loss_start", "loss_end"])

    return rows.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, text under the loss mask and length.

    Takes ``format_turns``' rows as they lie, conversation after conversation,
    and keeps running hashes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # conv_id, turns, hash of turns, loss characters, hash of loss, characters

        def row(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for batch in batches:
            done = []
            for conv, piece, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(piece):
                    now[1] += 1
                    now[2].update(_encoded(f"{role}\n{text}\n"))
                if start is not None:
                    level = piece[HEADER.match(piece).end() : start]
                    loss = unescaped(piece[start:end], level)
                    now[3] += len(loss)
                    now[4].update(_encoded(loss))
                now[5] += len(piece)
            if done:
                yield _batch(done)
        if now is not None:
            yield _batch([row(now)])

    return formatted.mapInArrow(run, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in DIGEST.split(", ")])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(given.unionByName(added)))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, CASE WHEN regexp_matches(text, '### (User|Assistant|System|Tool|"([^"\\]|\\.)*"):|</turn>') THEN 1
    ELSE 0 END AS marked FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + CASE WHEN role IN ('user', 'tool') THEN 4 WHEN role = 'system' THEN 6 WHEN role = 'assistant' THEN 9 ELSE length(CAST(to_json(role) AS VARCHAR)) END
    + 2 + CASE WHEN marked = 1 THEN 1 + length(regexp_replace(text, '(\\*)(### (User|Assistant|System|Tool|"([^"\\]|\\.)*"):|</turn>)', '\\\1\2', 'g')) ELSE length(text) END
    + 9) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

QUERIES = {"op5_chat_format": op5_chat_format}
ORACLE = {"op5_chat_format": ORACLE_SQL}
