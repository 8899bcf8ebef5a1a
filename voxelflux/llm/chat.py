"""Chat formatting from event logs: logs are partitioned by conversation, sorted by sequence, folded into final messages, and rendered.

An event is one change of one message: `open` (role; brings a deleted message back empty), `delta` (text is appended), `edit` (text is replaced), `regenerate` (text is
dropped, later deltas stream it anew), `delete`. A conversation is cut into parts of `TURNS` successive turn numbers; a part is folded and rendered on its own, so the longest
conversation spreads over tasks, and a task holds the messages of one part at a time.

Template: `### role: text </turn>` and a line break for each message. In texts and roles `\\`, `###` and `</turn>` (and `:` in roles) get a `\\` before them, so marks are unique and
`unescaped` gives texts back.
"""
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TURNS = 256
EVENT = "conv_id long, turn long, message long, seq long, kind string, role string, text string"
PART = "conv_id long, part long, n_turns long, formatted string, loss array<struct<begin:int,finish:int>>"
LEARNT = "assistant"
CONTROL = {"text": re.compile(r"(\\|###|</turn>)"), "role": re.compile(r"(\\|###|</turn>|:)")}
HIDDEN = re.compile(r"\\(\\|###|</turn>|:)")
#: An escaped control string, or the end of a turn.
STOPS = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n")
HEAD, ROLE_END, TEXT_END = "### ", ": ", " </turn>\n"


def escaped(text: str, where: str = "text") -> str:
    return CONTROL[where].sub(r"\\\1", text)


def unescaped(text: str) -> str:
    return HIDDEN.sub(r"\1", text)


class Fold:
    """The messages of one part of a conversation, changed event by event."""

    def __init__(self):
        self.state = {}                       # (turn, message): [last sequence number, is there, role, pieces]

    def add(self, turn, message, seq, kind, role, text):
        m = self.state.setdefault((turn, message), [None, False, "", []])
        if seq is None or m[0] is not None and seq <= m[0]:
            return                            # no order, or delivered again
        m[0] = seq
        if kind == "open":
            m[1], m[2], m[3] = True, role or "", m[3] if m[1] else []
        elif kind == "delta" and m[1]:
            m[3].append(text or "")
        elif kind == "edit" and m[1]:
            m[3] = [text or ""]
        elif kind == "regenerate":
            m[3] = []
        elif kind == "delete":
            m[1], m[3] = False, []

    def messages(self):
        """(role, text) of the messages that are there, by turn (null first), then message."""
        low = lambda k: tuple((x is not None, x or 0) for x in k)
        return [(m[2], "".join(m[3])) for _, m in sorted(self.state.items(), key=lambda e: low(e[0])) if m[1]]


def rendered(messages) -> tuple[str, list[dict]]:
    """The formatted text of messages, and the spans under the loss mask: the escaped texts of assistant messages."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = HEAD + escaped(role, "role") + ROLE_END, escaped(text)
        if role == LEARNT:
            spans.append({"begin": at + len(head), "finish": at + len(head) + len(body)})
        out += [head, body, TEXT_END]
        at += len(head) + len(body) + len(TEXT_END)
    return "".join(out), spans


def parsed(formatted: str):
    """(role, text) of each turn of a formatted text."""
    at = 0
    for m in STOPS.finditer(formatted):
        if m[0][0] == "<":
            turn, at = formatted[at + len(HEAD):m.start() - 1], m.end()
            mark = next(k.start() for k in re.finditer(r"\\(?:\\|###|</turn>|:)|:", turn) if k[0] == ":")
            yield unescaped(turn[:mark]), unescaped(turn[mark + len(ROLE_END):])


def _folded(batches):
    """Events sorted by conversation, part and sequence become one row for each part with a message."""
    def row(key, fold):
        messages = fold.messages()
        text, spans = rendered(messages)
        return pa.RecordBatch.from_pylist([{"conv_id": key[0], "part": key[1], "n_turns": len(messages), "formatted": text, "loss": spans}], schema=shape) if messages else None
    shape = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                       ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("finish", pa.int32())])))])
    now, fold, done, size = None, None, [], 0
    for batch in batches:
        for conv, part, *event in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "message", "seq", "kind", "role", "text")]):
            if (conv, part) != now:
                if fold is not None and (r := row(now, fold)):
                    done.append(r)
                    size += r.nbytes
                now, fold = (conv, part), Fold()
                if size > 1 << 22:
                    yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                    done, size = [], 0
            fold.add(*event)
    if fold is not None and (r := row(now, fold)):
        done.append(r)
    if done:
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


def formatted(events: DataFrame) -> DataFrame:
    """Formatted conversations of an event log (columns of `EVENT`): one row per conversation and part (turn numbers 256 * part to 256 * part + 255) with conv_id,
    part, n_turns, formatted, loss (spans of characters in `formatted` that are learnt). A conversation's text is that of its parts in order.

    `message` names a message within its turn and may be null. Events are applied in the order of `seq`; one whose seq a message has seen already changes nothing, as do unknown kinds,
    events without seq, and deltas and edits of messages that are not there. Null texts and roles are empty; a null conv_id is one conversation, a null turn comes
    first; messages that were deleted, and conversations without messages, give no row; other columns are ignored; an empty log gives no row.
    """
    cols = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in EVENT.split(", ")]
    log = events.select(*cols).withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-2 ** 55)).cast("long"))
    return log.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_folded, PART)


def _back(batches):
    """Digests of conversations from their parts, in order; a conversation is streamed, never held."""
    def fresh():
        return {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}

    def row(key, s):
        return {"conv_id": key, "n_turns": s["n_turns"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["formatted_chars"]}
    shape = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, s = None, None
    for batch in batches:
        out = []
        for conv, text, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")]):
            if s is None or conv != now:
                out += [row(now, s)] if s else []
                now, s = conv, fresh()
            s["formatted_chars"] += len(text)
            for role, said in parsed(text):
                s["n_turns"] += 1
                s["turns"].update(f"{role}\n{said}\n".encode())
            for span in spans:
                learnt = unescaped(text[span["begin"]:span["finish"]])
                s["loss_chars"] += len(learnt)
                s["loss"].update(learnt.encode())
        yield pa.RecordBatch.from_pylist(out, schema=shape)
    if s:
        yield pa.RecordBatch.from_pylist([row(now, s)], schema=shape)


def read_back(parts: DataFrame) -> DataFrame:
    """Conversations read back from `formatted`: conv_id, n_turns, turns_sha256 (of role, line break, text, line break of each turn), loss_chars, loss_sha256 (text under
    the loss mask, without escapes), formatted_chars. A digest needs a conversation's text in order, so its parts (one for each 256 turns) pass through one task, one at a time."""
    rows = parts.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _cut(text: Column) -> Column:
    """Text in pieces of 200 characters, or of a thousandth of it; one empty piece for an empty text."""
    size = F.greatest(F.lit(200), F.ceil(F.char_length(text) / 1000)).cast("int")
    last = F.greatest(F.ceil(F.char_length(text) / size), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * size + 1, size))


def log_of(turns: DataFrame) -> DataFrame:
    """An event log that leads to the rows of `turns` (conv_id, turn, role, text): by a hash of the row's key a message is streamed, streamed wrongly and regenerated, streamed wrongly and
    edited after all later turns, or deleted, opened again and delivered twice. Rows with one turn number follow in the order of a hash of role and text; repeated rows give
    as many messages."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    step = lambda kind, text=F.lit(None), late=0: F.struct(F.lit(kind).alias("kind"), F.col("role").alias("role"), text.cast("string").alias("text"), F.lit(late).alias("late"))
    stream = lambda text: F.transform(_cut(text), lambda t: step("delta", t))
    draft, final = F.reverse(F.col("text")), F.col("text")
    begin = F.array(step("open"))
    ways = [F.concat(begin, stream(final)), F.concat(begin, stream(draft), F.array(step("regenerate")), stream(final)), F.concat(begin, stream(draft), F.array(step("edit", final, 1))),
            F.concat(begin, stream(draft), F.array(step("delete")), begin, stream(final))]
    way = F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(4)).cast("int")
    events = F.when(way == 0, ways[0]).when(way == 1, ways[1]).when(way == 2, ways[2]).otherwise(ways[3])
    rows = rows.select("conv_id", "turn", F.xxhash64("role", "text", "copy").alias("message"), way.alias("way"), F.posexplode(events).alias("no", "e"))
    seq = F.coalesce(F.col("turn"), F.lit(0)) * 4096 + F.col("no") + F.col("e.late") * F.lit(1 << 40)
    rows = rows.select("conv_id", "turn", "message", seq.alias("seq"), "e.kind", "e.role", "e.text", F.when(F.col("way") == 3, 2).otherwise(1).alias("sent"))
    return rows.withColumn("sent", F.explode(F.sequence(F.lit(1), F.col("sent")))).drop("sent")


#: DuckDB text of the query's rows.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') AS r, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(r) + 2 + length(t) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
