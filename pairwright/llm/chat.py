"""Chat formatting by a finite-state machine over roles.

A declarative template names the marks of a turn, the roles whose text is under the loss
mask, and which role may follow which. Rows stream in the order of their conversation
(sorted by the JVM, spilling to disk); the machine holds only its state, so neither a
conversation nor a partition is gathered in memory. Each turn gives segments: header, text
and end mark, each with a loss flag. Control strings inside texts are escaped: every
occurrence of the escape character or of a mark's first character is replaced by the escape
character and a code of one character, and the reader reverses it. Texts are formatted whole, however long.

Defined results: a null text is empty; a null role is the empty role, which no rule admits;
a null turn comes first; rows of one turn are ordered by role and text; rows with a null
conversation id form one conversation. A conversation whose order the machine refuses is
still formatted; its segments carry the first error. No rows give no segments. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters that may follow the escape character.
CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    """What a formatted turn looks like: open + role + head + text + end."""

    open: str = "<|"
    head: str = "|>\n"
    end: str = "</s>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> roles that may come next; a role is the next state.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    #: Control strings of other templates that texts must not carry through either.
    controls: tuple[str, ...] = ("[INST]", "[/INST]", "<s>", "</s>")

    def __post_init__(self):
        firsts = {m[:1] for m in (self.open, self.head, self.end, *self.controls)}
        if len(self.escape) != 1 or "" in firsts or self.escape in firsts:
            raise ValueError("the escape is one character, and marks and control strings begin with others")
        if len(self.codes()) <= len(firsts):
            raise ValueError("marks and control strings begin with too many different characters")

    def specials(self) -> list[str]:
        return [self.escape, *sorted({m[0] for m in (self.open, self.head, self.end, *self.controls)})]

    def codes(self) -> str:
        """What follows the escape, in the order of specials(); none of these is special itself."""
        return "".join(c for c in CODES if c not in self.specials())

    def escaped(self, text: str) -> str:
        for c, code in zip(self.specials(), self.codes()):
            text = text.replace(c, self.escape + code)
        return text

    def plain(self, text: str) -> str:
        back = dict(zip(self.codes(), self.specials()))
        parts = text.split(self.escape)
        return parts[0] + "".join(back[p[0]] + p[1:] for p in parts[1:])


SEGMENT = "conv_id bigint, seq bigint, kind string, text string, loss boolean, error string"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, error string"


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, without gathering them."""
    r = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return r.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _batches(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("error", pa.string())])
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("error", pa.string())])


def formatter(template: Template, limit: int = 4_000_000):
    """mapInArrow function: ordered rows to segments, in batches of about `limit` characters."""

    def run(batches):
        none = object()
        conv, state, seq, error = none, template.start, 0, None
        out: dict[str, list] = {f.name: [] for f in SEGMENT_ARROW}
        size = 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if conv is none or c != conv:
                    conv, state, seq, error = c, template.start, 0, None
                if error is None and role not in template.follows.get(state, ()):
                    error = f"{role or 'no role'} after {state}"
                state = role
                loss = role in template.loss_roles
                for kind, piece, flag in (("head", template.open + template.escaped(role) + template.head, False), ("text", template.escaped(text), loss), ("end", template.end, False)):
                    for k, v in zip(out, (c, seq, kind, piece, flag, error)):
                        out[k].append(v)
                    seq += 1
                    size += len(piece)
                if size >= limit:
                    yield _batches(out, SEGMENT_ARROW)
                    out, size = {k: [] for k in out}, 0
        if out["seq"]:
            yield _batches(out, SEGMENT_ARROW)

    return run


def reader(template: Template):
    """mapInArrow function: segments, in order, to one digest row per conversation, read back from the formatted string alone."""

    class Conversation:
        def __init__(self, conv):
            self.conv, self.buffer, self.flags, self.turns, self.chars, self.loss_chars, self.error = conv, "", [], 0, 0, 0, None
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def feed(self, text, loss, error):
            self.buffer += text
            self.flags.append((len(text), loss))
            self.chars += len(text)
            self.error = self.error or error
            while (at := self.buffer.find(template.end)) >= 0:
                turn, self.buffer = self.buffer[:at], self.buffer[at + len(template.end) :]
                head = turn.index(template.head, len(template.open))
                if not turn.startswith(template.open):
                    raise ValueError("a turn does not begin with its mark")
                role = template.plain(turn[len(template.open) : head])
                body = template.plain(turn[head + len(template.head) :])
                self.all.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                self.turns += 1
                place, masked = 0, []
                for n, flag in self.flags:
                    if flag:
                        masked.append((turn + template.end)[place : place + n])
                    place += n
                self.flags = []
                said = template.plain("".join(masked))
                self.loss.update(said.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(said)

        def row(self):
            if self.buffer:
                raise ValueError("a conversation ends inside a turn")
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.error

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for c, text, loss, error in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "error"))):
                if now is None or now.conv != c:
                    if now is not None:
                        rows.append(now.row())
                    now = Conversation(c)
                now.feed(text, loss, error)
            if rows:
                yield _batches(dict(zip((f.name for f in DIGEST_ARROW), zip(*rows))), DIGEST_ARROW)
        if now is not None:
            yield _batches(dict(zip((f.name for f in DIGEST_ARROW), ([x] for x in now.row()))), DIGEST_ARROW)

    return run


def segments(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Text segments with loss flags, in order within each partition; a conversation lies in one partition."""
    return ordered(rows).mapInArrow(formatter(template), SEGMENT)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id bigint, turn bigint, role string, text string")
    return segments(rows.unionByName(more)).mapInArrow(reader(Template()), DIGEST).drop("error")


#: formatted_chars counts escapes: one more character for each special one, and the marks of each turn.
OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, length(text) + length(role) + 10
            + length(regexp_replace(text, '[^\\<|\[]', '', 'g')) + length(regexp_replace(role, '[^\\<|\[]', '', 'g')) AS f
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(f) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
