"""Chat formatting: schema fingerprints choose the mapping to canonical turns, a template marks them reversibly.

A layout is told by the hash of its nested field paths (``messages[].role``); ``LAYOUTS`` lists, for each, the paths it
must have, those it may have, and how its fields become (role, text) turns. Every record is fingerprinted by its own
fields: a JSON record by what it holds, a row of a table by its columns. Records of any mix of layouts go through the
same code. Dots, brackets and backslashes in field names are escaped, so a flat name never looks like a nested one.

A turn is written as ``<turn:role>``, a line end, the text, ``</turn>`` and a line end. In texts a backslash, and
each control string, gets a backslash before it, so every text is read back as it was. The loss mask covers
the texts of assistant turns.

Conversations of any length are formatted turn by turn: rows are sorted by conversation and turn, and only a
hash state is kept. ``read_chats`` reads what ``format_chats`` gives: partitions that hold whole conversations in order.

Defined cases: null texts are empty, a null role is the empty role; turns with equal numbers go in order of role
and text; repeated rows are turns of their own; a null conv_id is one conversation; a record with an empty list of
messages is known and has no turns; a record of unknown layout gives no turns and its fingerprint as error; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import urllib.parse

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, tidy

#: Fields that any record may have beside its turns; they are not read.
META = ("id", "source", "lang")
#: Layouts as declarations: paths that must be there, paths that may be, and the turns: ("row", role, text),
#: ("turns", list, role, text), or ("fields", [(role, fields to join) ...]); ``system`` leads where there is one.
LAYOUTS = [
    {"must": ["conv_id", "role", "text", "turn"], "row": ("role", "text")},
    {"must": ["messages[].content", "messages[].role"], "may": ["messages[].name", "system"], "turns": ("messages", "role", "content")},
    {"must": ["conversations[].from", "conversations[].value"], "may": ["system"], "turns": ("conversations", "from", "value")},
    {"must": ["turns[].role", "turns[].text"], "may": ["system"], "turns": ("turns", "role", "text")},
    {"must": ["messages[]"], "may": ["system"], "turns": ("messages", "role", "content")},
    {"must": ["conversations[]"], "may": ["system"], "turns": ("conversations", "from", "value")},
    {"must": ["turns[]"], "may": ["system"], "turns": ("turns", "role", "text")},
    {"must": ["prompt", "response"], "may": ["system"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"must": ["completion", "prompt"], "may": ["system"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"must": ["answer", "question"], "may": ["system", "context"], "fields": [("user", ["context", "question"]), ("assistant", ["answer"])]},
    {"must": ["instruction", "output"], "may": ["system", "input"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"must": ["chosen", "prompt", "rejected"], "may": ["system"], "fields": [("user", ["prompt"]), ("assistant", ["chosen"])]},
    {"must": ["chosen[].content", "chosen[].role", "rejected[].content", "rejected[].role"], "may": ["prompt"], "turns": ("chosen", "role", "content")},
]
#: Names of roles in other layouts (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "prompter": "user"}

OPEN, CLOSE = "<turn:", "</turn>"
_CONTROL = re.compile(r"\\|<turn:|</turn>")
_ESCAPED = re.compile(r"\\(\\|<turn:|</turn>)")
_MARK = re.compile(r"\\(?:\\|<turn:|</turn>)|</turn>\n")
_HEAD = re.compile(r"<turn:([^>\n]*)>\n")


def fingerprint(paths) -> str:
    return hashlib.sha1("\n".join(sorted(set(paths))).encode()).hexdigest()


def _escaped_name(name: str) -> str:
    return re.sub(r"([\\.\[\]])", r"\\\1", name)


def paths_of_value(value, at: str = "") -> list[str]:
    """Nested field paths of a record; an empty list or object is a path of its own."""
    if isinstance(value, dict) and value:
        return [p for k, v in value.items() for p in paths_of_value(v, f"{at}.{_escaped_name(k)}" if at else _escaped_name(k))]
    if isinstance(value, list):
        return [p for v in value for p in paths_of_value(v, at + "[]")] or [at + "[]"]
    return [at + "{}" if isinstance(value, dict) else at]


def _fingerprints(layout: dict):
    """The fingerprints of a layout: one for each choice of the paths it may have."""
    may = [*layout.get("may", []), *(() if "row" in layout else META)]
    for k in range(len(may) + 1):
        for some in itertools.combinations(may, k):
            yield fingerprint([*layout["must"], *some])


BY_FINGERPRINT = {f: layout for layout in LAYOUTS for f in _fingerprints(layout)}


def turns_of(record: dict) -> tuple[list[tuple[str, str]], str | None]:
    """(role, text) turns of a record, and None or the fingerprint of a layout that isn't known."""
    key = fingerprint(paths_of_value(record))
    layout = BY_FINGERPRINT.get(key)
    if layout is None:
        return [], key
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "row" in layout:
        role, body = layout["row"]
        return [(text(record[role]), text(record[body]))], None
    lead = [("system", t)] if (t := text(record.get("system"))) else []
    if "turns" in layout:
        rows, role, body = layout["turns"]
        return lead + [(ROLES.get(text(t.get(role)).lower(), text(t.get(role))), text(t.get(body))) for t in record[rows]], None
    return lead + [(role, "\n\n".join(t for f in fields if (t := text(record.get(f))))) for role, fields in layout["fields"]], None


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("error", pa.string())])
TURN_ROWS = "conv_id long, turn long, role string, text string, error string"


def _canonical(named):
    """A step that maps records to turns; ``named`` gives (conv_id, number of the first turn, record) of a batch's rows."""

    def run(batches):
        for b in pieces(batches, 1024):
            out = []
            for i, first, record in named(b):
                turns, error = turns_of(record) if isinstance(record, dict) else ([], "not a record")
                out += [(i, None if first is None else first + k, r, t, None) for k, (r, t) in enumerate(turns)]
                if error:
                    out.append((i, None, None, None, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(TURNS)], schema=TURNS)

    return run


def canonical_records(records: DataFrame, column: str = "record", key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, error) of JSON records, each of any known layout; one row with an error for others."""

    def named(b):
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                value = json.loads(raw) if raw is not None else None
            except ValueError:
                value = None
            yield i, 0, value

    return records.select(key, column).mapInArrow(tidy(_canonical(named)), TURN_ROWS)


def canonical_table(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, error) of a table with a row a turn: each row is a record of its columns."""

    def named(b):
        for record in b.to_pylist():
            yield record["conv_id"], record["turn"], record

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(tidy(_canonical(named)), TURN_ROWS)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start, end): the turn as text, and where its loss mask lies."""
    head = f"{OPEN}{urllib.parse.quote(role, safe='')}>\n"
    body = _CONTROL.sub(lambda m: "\\" + m[0], text)
    masked = role == "assistant"
    return head + body + CLOSE + "\n", len(head) if masked else 0, len(head) + len(body) if masked else 0


def read_turns(segment: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    out, at = [], 0
    while at < len(segment):
        head = _HEAD.match(segment, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        end = next((m for m in _MARK.finditer(segment, head.end()) if m[0][0] == "<"), None)
        if end is None:
            raise ValueError(f"the turn at {at} does not end")
        out.append((urllib.parse.unquote(head[1]), _ESCAPED.sub(r"\1", segment[head.end() : end.start()])))
        at = end.end()
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, mask_start, mask_end) in order within sorted partitions, one row a turn."""

    def run(batches):
        for b in batches:
            made = [format_turn(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["conv_id", "segment", "mask_start", "mask_end"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, segment string, mask_start long, mask_end long")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted segments."""

    def run(batches):
        done, state = [], None

        def row():
            i, n, turns, chars, loss, total = state
            return (i, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for b in batches:
            for i, s, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "mask_start", "mask_end"))):
                if state is None or state[0] != i:
                    if state is not None:
                        done.append(row())
                    state = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(s):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                masked = _ESCAPED.sub(r"\1", s[lo:hi])
                state[3] += len(masked)
                state[4].update(masked.encode("utf-8", "replace"))
                state[5] += len(s)
            if done:
                yield _digests(done)
                done = []
        if state is not None:
            yield _digests([row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


#: The added conversation: its text holds an escape and control strings.
PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = json.dumps({"messages": [{"role": role, "content": PROBE} for role in ("user", "assistant")]})
    record = spark.createDataFrame([(-7, probe)], "conv_id long, record string")
    turns = canonical_table(table).union(canonical_records(record)).where("error is null")
    return read_chats(format_chats(turns))
