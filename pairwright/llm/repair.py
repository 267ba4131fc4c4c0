"""Conversation structure repair at least cost.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. Every row is kept,
given the role user or assistant, or deleted, and empty user or assistant turns may be
inserted anywhere; blank rows and repetitions have to go, and a truncated row that stays
costs extra. Of the cheapest repairs the one whose audit (the initials of its edits, in
order) is least in ASCII is made.

Rows are dealt out in the order of their conversations to ranges, and cut there into pieces
of PIECE rows at most, so a very long conversation is many pieces. Pieces are hashed into
batches of bounded size. In each batch DuckDB runs one recursive query: every recursion
advances one row in all pieces at once, and keeps for each piece, state before it and state
of the grammar the least cost and its audit. What a piece does from state to state is again
a step, so the same query joins FAN pieces, and these again, until a conversation is one
step. (At equal cost no audit begins another, so the least of a whole has least parts.)
At last the rows stream by, in order, with their audit before them, and are edited.

Defined results: a null role or text is one space; a null turn comes before all others; rows
of one turn are ordered by role, then by the sha256 of their text, and equal rows follow one another; rows
with a null conversation id form one conversation. A row is blank if it has nothing but white
space, else a duplicate if role and text were seen before in its conversation, else truncated
if its last character other than white space isn't one of `.!?`. Texts are looked at whole.
No rows give no rows, and an id without rows gives an empty audit. Other columns are not
looked at, whatever their names.

Equal texts are told by sha256. The repaired text of a conversation is hashed as it streams, so memory doesn't
grow with it, but one task reads it; its audit, a character a row, is one value.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, kept, numbered

#: White space; ends of whole sentences; the automaton of `(s?(ua)+)?` from state 0, accepting in 0 and 3.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = 4
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
#: Rows of a piece, steps that are joined at once, rows of a batch (some 30 bytes each, ten times that in DuckDB).
PIECE, FAN, BATCH_ROWS = 256, 64, 20_000
#: A role and text with more than one HOT-th of all rows is handled apart.
HOT = 256

FOUND = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_FOUND = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SOLVED = "g string, start int, state int, cost bigint, audit string"


def inserted(state: int) -> str:
    """The initial that an inserted turn, or one that gets a role, has in a state."""
    return "a" if state == 2 else "u"


def moves() -> list[tuple[str, int, int, int, str]]:
    """(class, state, next state, cost, letters): the best ways through one row. A class is the row's initial, or ?, and its
    fault: d must go, c is cut. Two turns are inserted before a row at most: three lead where one does."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for initial in "sua?":
        for fault in ("-", "d", "c"):
            for state in range(STATES):
                at, letters, cost = state, "", 0
                for _ in range(3):
                    ways = [(at, DELETE, "D")]
                    if fault != "d":
                        more = CUT if fault == "c" else 0
                        ways += [(STEP[at, initial], more, "K")] if (at, initial) in STEP else []
                        ways.append((STEP[at, inserted(at)], REROLE + more, "R"))
                    for to, price, letter in ways:
                        k, v = (initial + fault, state, to), (cost + price, letters + letter)
                        best[k] = min(best.get(k, v), v)
                    at, letters, cost = STEP[at, inserted(at)], letters + "I", cost + INSERT
    return [(*k, *v) for k, v in sorted(best.items())]


#: Turns that are inserted at the end: state -> audit.
ENDINGS = {0: "", 1: "II", 2: "I", 3: ""}


# ---------------------------------------------------------------- batches

_SOLVE = """
WITH RECURSIVE best(g, start, state, i, cost, audit) USING KEY (g, start, state) AS (
  SELECT g, s::INT, s::INT, 0, 0::BIGINT, '' FROM (SELECT DISTINCT g FROM steps), (SELECT unnest(range({states})) AS s)
  UNION
  SELECT b.g, b.start, m.t, b.i + 1, min(b.cost + m.cost), arg_min(b.audit || m.letters, (b.cost + m.cost, b.audit || m.letters))
  FROM best b JOIN steps m ON m.g = b.g AND m.i = b.i AND m.f = b.state
  GROUP BY b.g, b.start, m.t, b.i)
SELECT g, start, state, cost, audit FROM best JOIN (SELECT g, max(i) + 1 AS n FROM steps GROUP BY g) USING (g) WHERE i = n
"""


def solver(classes: bool):
    """applyInArrow function of a batch: what each piece g does from state to state. Its steps i from 0 are classes of rows, or
    (f, t, cost, letters) themselves."""
    by_class = moves() if classes else None

    def run(table: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            con.register("given", table)
            if classes:
                con.register("moves", pa.table(dict(zip(("class", "f", "t", "cost", "letters"), map(list, zip(*by_class))))))
                con.execute("CREATE TEMP TABLE steps AS SELECT g, i, f::INT AS f, t::INT AS t, cost::BIGINT AS cost, letters FROM given JOIN moves USING (class)")
            else:
                con.execute("CREATE TEMP TABLE steps AS SELECT g, i, f, t, cost, letters FROM given")
            rows = con.sql(_SOLVE.format(states=STATES)).to_arrow_table()
        finally:
            con.close()
        return rows.cast(pa.schema([("g", pa.string()), ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    return run


def solved(steps: DataFrame, group: list[str], size: int, classes: bool) -> DataFrame:
    """group, start, state, cost, audit. steps: group (integers), i and what solver() takes, of `size` rows or as much; a group is bounded."""
    batches = int(max(1, -(-size // BATCH_ROWS)))
    s = steps.withColumn("g", F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group)))
    found = s.drop(*group).withColumn("batch", F.pmod(F.xxhash64("g"), F.lit(batches))).groupBy("batch").applyInArrow(solver(classes), _SOLVED)
    own = F.split("g", ":")
    return found.select(*(F.nullif(own[j], F.lit("")).cast(steps.schema[c].dataType).alias(c) for j, c in enumerate(group)), "start", "state", "cost", "audit")


# ---------------------------------------------------------------- rows


def facts(rows: DataFrame) -> DataFrame:
    """rid, conv_id, turn, role, text, digest, last (the last character that isn't white space)."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), last.alias("last"))
    return numbered(own, "*")


def repetitions(base: DataFrame, number: int) -> DataFrame:
    """rid of the rows whose role and text were seen before in their conversation, blank ones left out."""
    own = base.where("last <> ''").select("conv_id", "role", "digest", F.struct("turn", "rid").alias("at"))
    groups = own.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = kept(groups.withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "role", "digest")}), "repair-repeated")
    # a group with a 256th of all rows is hot; there are 256 of them at most, so they can be broadcast
    large = max(2, number // HOT)
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    hot, cold = F.broadcast(groups.where(F.col("n") >= large)), groups.where(F.col("n") < large)
    found = own.join(hot, same).unionByName(own.join(hot, same, "left_anti").join(cold, same))
    return kept(found.where(F.col("at") > F.col("first")).select("at.rid"), "repair-repetitions")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("rid")]


def pieces(base: DataFrame) -> DataFrame:
    """conv_id, part, piece, i, class of every row: its place in its piece."""
    fault = F.when((F.col("last") == "") | F.col("again"), "d").when(~F.col("last").isin(*ENDS), "c").otherwise("-")
    initial = F.left("role", F.lit(1))
    narrow = base.select("conv_id", "turn", "role", "digest", "rid", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault).alias("class"))
    ranged = kept(narrow.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), "repair-ranges")
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*_order())) - 1
    ranged = ranged.select("conv_id", "part", "class", place.alias("place"))
    return ranged.select("conv_id", "part", F.floor(F.col("place") / PIECE).cast("bigint").alias("piece"), (F.col("place") % PIECE).cast("int").alias("i"), "class")


def audits(base: DataFrame, number: int) -> DataFrame:
    """conv_id, cost, audit of every conversation of base (facts() with the column again)."""
    level = kept(solved(pieces(base), ["conv_id", "part", "piece"], number, True), "repair-steps")
    each = level.select("conv_id", "part", "piece").distinct()
    w = Window.partitionBy("conv_id")
    each = each.withColumn("seq", F.row_number().over(w.orderBy("part", "piece")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    each = each.withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "part", "piece")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "part", "piece")]
    level = kept(level.join(each, same).select("conv_id", "seq", "n", "start", "state", "cost", "audit"), "repair-level")
    done = []
    while True:
        done.append(level.where("n = 1"))
        rest = level.where("n > 1").select("conv_id", F.floor(F.col("seq") / FAN).cast("int").alias("seq"), F.ceil(F.col("n") / FAN).cast("bigint").alias("n"), (F.col("seq") % FAN).cast("int").alias("i"), F.col("start").alias("f"), F.col("state").alias("t"), "cost", F.col("audit").alias("letters"))
        size = rest.agg(F.sum(F.length("letters") + 30)).first()[0]
        if not size:
            break
        # audits grow with each level: FAN pieces of a very long conversation are a batch of their own
        level = kept(solved(rest, ["conv_id", "seq", "n"], size // 30, False), "repair-level")
    ends = F.create_map(*(F.lit(x) for k in ENDINGS.items() for x in k))
    ended = F.struct((F.col("cost") + INSERT * F.length(F.element_at(ends, F.col("state")))).alias("cost"), F.concat("audit", F.element_at(ends, F.col("state"))).alias("audit"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.where("start = 0").groupBy("conv_id").agg(F.min(ended).alias("best")).select("conv_id", "best.cost", "best.audit")


class Conversation:
    """The rows of a conversation as they stream by, edited by its audit."""

    def __init__(self, conv_id, cost: int, audit: str):
        self.conv_id, self.cost, self.audit, self.at, self.state = conv_id, cost, audit, 0, 0
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.sha, self.written = hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written = True
        self.state = STEP[self.state, role[:1]]

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.write({"u": "user", "a": "assistant"}[inserted(self.state)], "")
            self.at += 1

    def row(self, turn, role: str, text: str, last: str, again: bool) -> None:
        if turn is not None and (self.low is None or turn != self.turn):
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if not last:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif last not in ENDS:
            self.truncated += 1
        if self.before is not None and self.before + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = role[:1]
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.write(role, text)
        elif edit == "R":
            self.write({"u": "user", "a": "assistant"}[inserted(self.state)], text)

    def found(self) -> tuple:
        self.insert()
        if self.at != len(self.audit) or self.state not in (0, 3):
            raise ValueError("an audit doesn't fit its conversation")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.sha.hexdigest()


def editor(batches):
    """mapInArrow function: a row with the audit, then the rows of its conversation, in order; one row for each conversation."""
    now, out = None, []

    def flush():
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few rows are Python objects at a time
            few = batch.slice(at, 256)
            for conv, turn, role, text, last, again, cost, audit in zip(*(few.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "last", "again", "cost", "audit"))):
                if audit is not None:
                    if now is not None:
                        out.append(now.found())
                    now = Conversation(conv, cost, audit)
                else:
                    now.row(turn, role, text, last, again)
        if len(out) > 1000:
            yield flush()
    if now is not None:
        out.append(now.found())
    if out:
        yield flush()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text), and of conversations (conv_id): see FOUND."""
    base = facts(rows)
    number = base.count()
    gone = repetitions(base, number)
    few = gone.count() <= MAX_BROADCAST_IDS
    gone = gone.withColumn("again", F.lit(True))
    base = base.join(F.broadcast(gone) if few else gone, "rid", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    heads = kept(audits(base, number), "repair-audits")
    if conversations is not None:
        all_ = conversations.select(F.col("conv_id").cast("bigint").alias("_conv")).distinct()
        heads = all_.join(heads, F.col("_conv").eqNullSafe(F.col("conv_id")), "full_outer")
        heads = heads.select(F.coalesce("_conv", "conv_id").alias("conv_id"), F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    order = ["turn", "role", "digest", "rid"]
    stream = heads.unionByName(base.select("conv_id", *order, "text", "last", "again"), allowMissingColumns=True)
    sorted_ = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("audit").isNull(), F.asc_nulls_first("turn"), *order[1:])
    return sorted_.select("conv_id", "turn", "role", "text", "last", "again", "cost", "audit").mapInArrow(editor, FOUND)


# ---------------------------------------------------------------- the query


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows with faults by crc32 of `conv_id:turn` modulo 20."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20).alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows)


#: DuckDB: crc32 bit by bit; the cheapest repairs row by row, each with its text.
OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
                     lambda r, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(r, b)), 4294967295), 4294967295) % 20 AS harm
  FROM conversations),
r AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) AS two(copy) WHERE harm <> 0 AND (copy = 0 OR harm = 3)),
o AS (
  SELECT *, coalesce(conv_id, -1) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         left(role, 1) AS c, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM r),
q AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM o),
step(f, c, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(f, t, n, lines) AS (
  SELECT f, f, 0, CAST([] AS VARCHAR[]) FROM range(4) AS x(f)
  UNION ALL
  SELECT ins.f, step.t, n + 1, list_append(lines, CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM ins JOIN step ON step.f = ins.t AND step.c <> 's' WHERE n < 2),
edit AS (
  SELECT k, i, f, c AS own, t, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS price, 'K' AS letter, [role || ':' || text] AS line FROM q JOIN step USING (c) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT k, i, f, step.c, t, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [CASE step.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM q, step WHERE step.c <> 's' AND fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT k, i, f, '', f, 2, 'D', CAST([] AS VARCHAR[]) FROM q, range(4) AS x(f)),
way AS (
  SELECT k, i, ins.f, edit.t, price + 5 * n AS price, repeat('I', n) || letter AS letters, list_concat(lines, line) AS said FROM edit JOIN ins ON ins.t = edit.f),
best(k, i, state, cost, audit, said) AS (
  SELECT DISTINCT k, CAST(1 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM q
  UNION ALL
  SELECT b.k, b.i + 1, w.t, CAST(min(b.cost + w.price) AS BIGINT), arg_min(b.audit || w.letters, (b.cost + w.price, b.audit || w.letters)), arg_min(list_concat(b.said, w.said), (b.cost + w.price, b.audit || w.letters))
  FROM best b JOIN way w ON w.k = b.k AND w.i = b.i AND w.f = b.state GROUP BY b.k, b.i, w.t),
ended AS (
  SELECT k, arg_min((cost + 5 * n, audit || repeat('I', n), list_concat(said, lines)), (cost + 5 * n, audit || repeat('I', n))) AS e
  FROM best JOIN ins ON ins.f = best.state AND ins.t IN (0, 3) JOIN (SELECT k, max(i) + 1 AS i FROM q GROUP BY k) USING (k, i) GROUP BY k),
sums AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(e[1], 0) AS cost, coalesce(e[2], '') AS audit, sha256(coalesce(array_to_string(e[3], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS k FROM conversations) c LEFT JOIN sums USING (k) LEFT JOIN ended USING (k)
"""
