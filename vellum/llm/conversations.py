"""Operator 13: repair of a conversation's structure by backward costs and a forward walk.

A repaired conversation's roles are nothing, or user and assistant in turn, with
a system turn in front or without: initials ``(s?(ua)+)?``.  Its edits are Keep, Rerole (to
user or assistant), Delete and Insert (an empty turn).  The state is what stands
last so far: nothing, a system turn, a user's or an assistant's.  Given a state
and an edit, the next state is determined, so a string of edits' initials says
all about a repair.

The cheapest cost from each row and state to the end is computed backwards over
the rows (``behind``).  A walk forward then takes, among the edits that lie on a
cheapest way, the one whose initial is ASCII-least (D, I, K, R), which makes the
whole string ASCII-least, and rebuilds the turns for the digest.

One shuffle brings a conversation's rows together; what a row is by itself
(empty, cut off) is found before it, and whether its role and text were seen
before by a window on the same partitioning.  Both passes are streams over sorted rows: the
backward one hands on, with each row, the costs behind it (differences to the
least, one number), the forward one a running digest.  So a task holds one row and an audit, however
long a conversation is; Spark's sorts spill.  The digest is a chain over the whole repaired text, so
one task must read a conversation whichever way it is cut.

Rows of a conversation stand in the order of turn (null first), then role, then
text; rows alike in all three are interchangeable.  Null roles and texts are one
space.  Rows without conv_id form one conversation.  An empty table has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import map_arrow

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States by what stands last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn put in, the only one of them that may follow, and that role.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept turn by its initial; others may not be kept.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Cheapest ways from the end: nothing, or the turns that are missing.
END = (0, 2 * INSERT, INSERT, 0)

SPACES = " \t\n\x0b\x0c\r"

RESULT = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, copies (0 for a row that is dropped, 2 for one that is repeated).

    What happens to a row is dealt by crc32 of ``conv_id:turn`` (null: one space) modulo 20.
    """
    named = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return named.withColumn("dealt", F.crc32(key.cast("binary")) % 20).select(
        "conv_id",
        "turn",
        F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("dealt") == 0, 0).when(F.col("dealt") == 3, 2).otherwise(1).alias("copies"),
    )


def behind(ahead: tuple[int, ...], initial: str, must_go: bool, cut_off: bool) -> tuple[int, ...]:
    """Cheapest costs to the end from before a row in each state; ahead: from after it."""
    penalty = TRUNCATED if cut_off else 0
    costs = []
    for state in range(4):
        cost = DELETE + ahead[state]
        if not must_go:
            cost = min(cost, REROLE + penalty + ahead[FOLLOWS[state]])
            if initial in KEPT[state]:
                cost = min(cost, penalty + ahead[KEPT[state][initial]])
        costs.append(cost)
    for _ in range(3):  # turns put in before the row: a fourth would come back to a state
        costs = [min(c, INSERT + costs[FOLLOWS[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def step(state: int, now: tuple[int, ...], ahead: tuple[int, ...], initial: str, must_go: bool, cut_off: bool) -> Iterator[tuple[str, int]]:
    """Edits (and the states after them) from before a row to after it: always the ASCII-least on a cheapest way.  now and ahead may lack the same number."""
    penalty = TRUNCATED if cut_off else 0
    while True:
        if now[state] == DELETE + ahead[state]:
            yield "D", state
            return
        if now[state] == INSERT + now[FOLLOWS[state]]:
            state = FOLLOWS[state]
            yield "I", state
        elif initial in KEPT[state] and now[state] == penalty + ahead[KEPT[state][initial]]:
            yield "K", KEPT[state][initial]
            return
        else:
            yield "R", FOLLOWS[state]
            return


def packed(costs: tuple[int, ...]) -> int:
    """Differences to the least cost, a byte each: no state is worth more than a few edits over another."""
    least = min(costs)
    return sum(c - least << 8 * i for i, c in enumerate(costs))


def unpacked(code: int) -> tuple[int, ...]:
    return tuple(code >> 8 * i & 255 for i in range(4))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of conversations with their last rows first, with the costs behind each row."""
    now, costs = object(), END
    for batch in batches:
        ahead = []
        for conv, copies, initial, blank, seen, cut_off in _columns(batch, "conv_id", "copies", "initial", "blank", "seen", "cut_off"):
            if conv != now:
                now, costs = conv, END
            ahead.append(packed(costs))
            if copies == 2:  # the second one goes, at the same cost in any state
                costs = tuple(DELETE + c for c in costs)
            if copies:
                costs = behind(costs, initial, blank or seen, cut_off)
            least = min(costs)
            costs = tuple(c - least for c in costs)
        yield batch.append_column("ahead", pa.array(ahead, pa.int64()))


class _Conversation:
    """What is known of a conversation whose rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.last = conv_id, NOTHING, None
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def insert(self, state: int) -> None:
        self.audit.append("I")
        self.cost += INSERT
        self.put(ROLE[state], "")

    def row(self, turn, role: str, text: str, copies: int, blank: bool, seen: bool, cut_off: bool, ahead: tuple[int, ...]) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        for i in range(copies):
            self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            twice = seen or i > 0
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + (twice and not blank), self.truncated + (cut_off and not twice and not blank)
        if not copies:
            return
        if copies == 2:
            then = tuple(DELETE + c for c in ahead)
        else:
            then = ahead
        must_go = blank or seen
        now = behind(then, initial, must_go, cut_off)
        for edit, after in step(self.state, now, then, initial, must_go, cut_off):
            self.state = after
            if edit == "I":
                self.insert(after)
                continue
            self.audit.append(edit)
            self.cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if cut_off else 0)
            if edit != "D":
                self.put(role if edit == "K" else ROLE[after], text)
        if copies == 2:
            self.audit.append("D")
            self.cost += DELETE

    def end(self) -> list:
        while END[self.state]:
            self.state = FOLLOWS[self.state]
            self.insert(self.state)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of conversations with their first rows first; a row of the result for each conversation."""
    names, kinds = [c.split()[0] for c in RESULT.split(", ")], []
    talk: _Conversation | None = None
    for batch in batches:
        done, kinds = [], [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        for conv, turn, role, text, copies, blank, seen, cut_off, ahead in _columns(batch, "conv_id", "turn", "role", "text", "copies", "blank", "seen", "cut_off", "ahead"):
            if talk is None or conv != talk.conv_id:
                if talk is not None:
                    done.append(talk.end())
                talk = _Conversation(conv)
            if copies:
                talk.row(turn, role, text, copies, blank, seen, cut_off, unpacked(ahead))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if talk is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(talk.end(), kinds)], names)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation, with its faults, the cheapest repair and the digest of the repaired turns.

    rows: conv_id, turn, role, text, copies (0: only the conversation's name counts; 2: the
    row stands twice), as ``damaged`` makes them.
    """
    body = F.rtrim("text", F.lit(SPACES))
    blank, cut_off = body == "", (body != "") & ~F.right(body, F.lit(1)).isin(".", "!", "?")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut_off.alias("cut_off"))
    rows = rows.repartition("conv_id")
    alike = Window.partitionBy("conv_id", F.col("copies") > 0, "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("nth", F.row_number().over(alike)).withColumn("seen", F.col("nth") > 1)
    keys = ("conv_id", "turn", "role", "text", "nth")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    last_first = rows.sortWithinPartitions(*[F.col(k).desc_nulls_last() for k in keys])
    back = map_arrow(last_first, _backward, schema + ", ahead bigint")
    first_first = back.sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    return map_arrow(first_first, _forward, RESULT.format(kind))


#: The contract of the query in DuckDB's SQL: from the last row back, the cheapest and ASCII-least way on from each state.
ORACLE = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS dealt
  FROM conversations
), rows_ AS (
  SELECT conv_id, turn, CASE dealt WHEN 4 THEN 'user' ELSE role END AS role,
         CASE dealt WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE dealt WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM given WHERE dealt <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, E' \t\n\x0b\x0c\r') AS body
  FROM rows_
), judged AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS cut_off,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), follows(state, next, turn) AS (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')),
kept(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put_in AS (
  SELECT state, state AS next, 0 AS n, []::VARCHAR[] AS turns FROM follows
  UNION ALL
  SELECT p.state, f.next, p.n + 1, list_append(p.turns, f.turn) FROM put_in p JOIN follows f ON f.state = p.next WHERE p.n < 3
), edits AS (
  SELECT state, state AS next, 'D' AS edit, NULL::VARCHAR AS initial FROM follows
  UNION ALL SELECT state, next, 'R', NULL::VARCHAR FROM follows
  UNION ALL SELECT state, next, 'K', initial FROM kept
), ways AS (
  SELECT conv_id, n + 1 AS i, state, min(cost) AS cost, arg_min(audit, cost) AS audit, arg_min(turns, cost) AS turns
  FROM (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id),
       (SELECT state, 3 * n AS cost, repeat('I', n) AS audit, turns FROM put_in WHERE next IN (0, 3))
  GROUP BY conv_id, n, state
  UNION ALL
  SELECT conv_id, i, state, arg_min(cost, place), arg_min(audit, place), arg_min(turns, place)
  FROM (
    SELECT *, lpad(cost::VARCHAR, 12, '0') || audit AS place
    FROM (
      SELECT w.conv_id, j.i, p.state,
             3 * p.n + w.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN j.cut_off AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost,
             repeat('I', p.n) || e.edit || w.audit AS audit,
             p.turns || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || j.text] END || w.turns AS turns
      FROM ways w
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i - 1
      JOIN edits e ON e.next = w.state AND (e.edit = 'D' OR NOT (j.blank OR j.seen)) AND (e.edit <> 'K' OR e.initial = j.initial)
      JOIN put_in p ON p.next = e.state
    )
  )
  GROUP BY conv_id, i, state
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut_off AND NOT seen) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = 1 AND w.state = 0
"""
