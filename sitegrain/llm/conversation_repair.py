"""Conversation structure repair by a rank-compressed dynamic program over edits.

A repaired conversation has roles whose initials read ``(s?(ua)+)?``. Edits: keep a turn (K), give it the role user or
assistant (R, cost 3), delete it (D, cost 4), insert an empty turn of either role (I, cost 3). Blank turns and repeats
must be deleted; a truncated turn that stays costs 3 more. Of the cheapest edits, those whose initials come first in
ASCII order are taken.

The program goes turn by turn. A layer holds, for each state of the pattern (nothing yet, after the system turn, after
a user turn, after an assistant turn), the least cost and which of the cheapest audits comes first. The edits between
two layers are a macro: a run of inserts and one edit of a turn, ``I*[DKR]``. These codes are prefix-free, so of two
audits of one layer neither begins the other, and they compare as (rank of the parent, code). Hence no audit is
kept: a layer has ranks in their place, and each state a parent and a code. States that cost so much more than
another that they can never win are dropped; then costs, taken from the least one, and ranks take few values, and a
layer's successor is looked up by the kind of the turn. Four bytes a turn remain, from which the edits are
reconstructed backward.

Spark deals conversations to tasks and sorts them. A task reads each conversation twice from the one sorted stream:
first its turns without texts, for the program, then with texts, to which the edits are applied. So a conversation of any
length needs a few bytes for each turn (and its audit, which is part of the result); it is one task's work, as its digest
must be. Which turns repeat earlier ones comes from an aggregation, whose rows enter the same sort.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import through

#: White space, and the characters that end a sentence.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states that a turn with some initial leads to.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Macro edits in ASCII order; more than two inserts in a row never pay.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: Output rows, or characters of texts and audits, of one batch.
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 22

Layer = tuple[tuple[int, int] | None, ...]


def following(state: int) -> int:
    """The state after an inserted turn, or one that was given a role."""
    return ASSISTANT if state == USER else USER


def _prune(costs: dict[int, int]) -> set[int]:
    """States that cannot be on a cheapest way: from another state, any continuation costs less even with the edits that make up for it."""
    makeup = {
        ASSISTANT: {SYSTEM: 0, USER: INSERT_COST, START: DELETE_COST},
        USER: {ASSISTANT: INSERT_COST, SYSTEM: INSERT_COST, START: INSERT_COST + DELETE_COST},
    }
    return {worse for better, others in makeup.items() if better in costs for worse, extra in others.items() if worse in costs and costs[better] + extra < costs[worse]}


@functools.cache
def advance(layer: Layer, initial: str, must_go: bool, truncated: bool) -> tuple[Layer, int, tuple[tuple[int, int] | None, ...]]:
    """The next layer, the cost by which all of it went up, and for each state its parent and code."""
    best: dict[int, tuple[int, int, int, int]] = {}

    def offer(state: int, cost: int, rank: int, code: str, parent: int) -> None:
        best[state] = min(best.get(state, (1 << 60, 0, 0, 0)), (cost, rank, CODES.index(code), parent))

    late = TRUNCATED_COST if truncated else 0
    for parent, held in enumerate(layer):
        if held is None:
            continue
        state, (cost, rank) = parent, held
        for run in range(3):
            offer(state, cost + DELETE_COST, rank, "I" * run + "D", parent)
            if not must_go:
                offer(following(state), cost + REROLE_COST + late, rank, "I" * run + "R", parent)
                if (state, initial) in AFTER:
                    offer(AFTER[state, initial], cost + late, rank, "I" * run + "K", parent)
            state, cost = following(state), cost + INSERT_COST
    for state in _prune({s: x[0] for s, x in best.items()}):
        del best[state]
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    new = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    return new, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


class Steps:
    """The layers seen so far by number, and what each kind of turn makes of them."""

    def __init__(self) -> None:
        self.first: Layer = ((0, 0), None, None, None)
        self.layers, self.numbers, self.parents = [self.first], {self.first: 0}, []
        self.next: dict[tuple, tuple[int, int, int]] = {}

    def step(self, layer: int, kind: tuple[str, bool, bool]) -> tuple[int, int, int]:
        """(next layer, cost, number of the step's parents)."""
        found = self.next.get((layer, kind))
        if found is None:
            new, cost, parents = advance(self.layers[layer], *kind)
            if new not in self.numbers:
                self.numbers[new] = len(self.layers)
                self.layers.append(new)
            self.parents.append(parents)
            found = self.next[layer, kind] = (self.numbers[new], cost, len(self.parents) - 1)
        return found

    def finish(self, layer: int, taken: array) -> tuple[int, bytearray, int]:
        """(cost above the layer's least, code of each turn, inserts at the end)."""
        closing = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, _, state = min((held[0] + INSERT_COST * closing[s], held[1], s) for s, held in enumerate(self.layers[layer]) if held)
        inserts, codes = closing[state], bytearray(len(taken))
        for i in range(len(taken) - 1, -1, -1):
            state, codes[i] = self.parents[taken[i]][state]
        return cost, codes, inserts


class Conversation:
    """One conversation on its way through a task."""

    def __init__(self, key, steps: Steps) -> None:
        self.key, self.steps, self.layer, self.taken = key, steps, 0, array("I")
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = self.at = self.state = 0
        self.low = self.high = self.before = self.mark = self.codes = None

    def plan(self, turn: int | None, print_: bytes, first: bool, initial: str, blank: bool, cut: bool) -> None:
        """A turn without its text. ``first``: a note that the next turn with this number and print is the first such one."""
        if first:
            self.mark = (turn, print_)
            return
        repeat = not blank and self.mark != (turn, print_)
        if not blank:
            self.mark = None
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        cut = cut and not blank and not repeat
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeat, self.truncated + cut
        self.layer, cost, step = self.steps.step(self.layer, (initial if initial in ("s", "u", "a") else "", blank or repeat, cut))
        self.cost += cost
        self.taken.append(step)

    def close(self) -> None:
        """No more turns to plan: find the edits."""
        if self.codes is None:
            cost, self.codes, self.tail = self.steps.finish(self.layer, self.taken)
            self.cost += cost
            self.taken = None

    def _insert(self) -> tuple[str, str, str]:
        self.state = following(self.state)
        return NAMES[self.state], "", "I"

    def apply(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of the turns that a turn with its text leaves."""
        self.close()
        *inserts, edit = CODES[self.codes[self.at]]
        self.at += 1
        for _ in inserts:
            yield self._insert()
        if edit == "K":
            self.state = AFTER[self.state, role[:1]]
            yield role, text, edit
        elif edit == "R":
            self.state = following(self.state)
            yield NAMES[self.state], text, edit

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.close()
        for _ in range(self.tail):
            yield self._insert()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    @property
    def audit(self) -> str:
        return "".join(CODES[c] for c in self.codes) + "I" * self.tail


def _stream(rows: DataFrame, conv: str, turn: str, role: str, text: str, all_convs: DataFrame) -> DataFrame:
    """What tasks read: for each conversation a head, its turns without texts, its turns with texts."""
    kind = rows.schema[conv].dataType.simpleString()
    turns = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    solid = F.rtrim("text", F.lit(BLANKS))
    blank = solid == ""
    print_ = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("print")
    empty = F.lit(None).cast("string")
    no = F.lit(False)

    def part(df: DataFrame, phase: int, first: Column = no, initial: Column = empty, blank: Column = no, cut: Column = no, role: Column = empty, text: Column = empty) -> DataFrame:
        return df.select("conv", F.lit(phase).alias("phase"), "turn", "print", (~first).alias("later"), initial.alias("initial"), blank.alias("blank"), cut.alias("cut"), role.alias("role"), text.alias("text"))

    heads = part(all_convs.select(F.col(conv).cast(kind).alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("print")).distinct(), 0)
    known = turns.select("conv", "turn", print_, F.substring("role", 1, 1).alias("initial"), blank.alias("is_blank"), ~F.right(solid, F.lit(1)).isin(*STOPS) & ~blank, "role", "text").toDF("conv", "turn", "print", "initial", "is_blank", "is_cut", "role", "text")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = known.filter(~F.col("is_blank")).groupBy("conv", "print").agg(F.min(at).alias("at")).select("conv", F.col("at.turn").alias("turn"), "print")
    narrow = part(known, 1, initial=F.col("initial"), blank=F.col("is_blank"), cut=F.col("is_cut"))
    wide = part(known, 2, role=F.col("role"), text=F.col("text"))
    whole = heads.unionAll(part(firsts, 1, first=F.lit(True))).unionAll(narrow).unionAll(wide)
    return whole.repartition("conv").sortWithinPartitions("conv", "phase", "turn", "print", "later")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, tuple[str, str, str] | None]]:
    """Each conversation with each of its repaired turns, and once with None when it is over."""
    now, steps = None, Steps()
    for batch in batches:
        for conv, phase, turn, print_, later, initial, blank, cut, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if phase == 0:
                if now is not None:
                    yield from ((now, x) for x in now.end())
                    yield now, None
                now = Conversation(conv, steps)
            elif phase == 1:
                now.plan(turn, print_, not later, initial, blank, cut)
            else:
                yield from ((now, x) for x in now.apply(role, text))
    if now is not None:
        yield from ((now, x) for x in now.end())
        yield now, None


def _batched(rows: Iterator[tuple], sizes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sizes(row)
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _key_type(rows: DataFrame, conv: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[conv].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_col, position long (from 0), role, text, edit (K, R or I) of each turn.

    Turns are ordered by number, nulls first, and those with the same number by the digest of role and text. A null role
    or text is one space. Null conversation ids are one conversation. Repeated rows are repeats of a turn. A conversation
    of which nothing is left has no row; an empty table gives none. Other columns are left out.
    """
    kind, arrow = _key_type(rows, conv_col)
    schema = pa.schema([("conv", arrow), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            position = 0
            for talk, turn in _conversations(batches):
                if turn is None:
                    position = 0
                else:
                    yield (talk.key, position, *turn)
                    position += 1

        yield from _batched(turns(), lambda row: len(row[3]), schema)

    made = through(_stream(rows, conv_col, turn_col, role_col, text_col, rows), run, f"conv {kind}, position long, role string, text string, edit string")
    return made.withColumnRenamed("conv", conv_col)


def report(rows: DataFrame, all_convs: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``rows`` and of ``all_convs``: faults, cost, audit, digest of what ``repair`` leaves.

    Nulls, ties and repeats as in ``repair``. A conversation without rows has zeros, an empty audit and the digest of
    nothing. ``repaired_sha256`` is of ``role:text`` of each turn, joined by newlines.
    """
    kind, arrow = _key_type(rows, conv_col)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv", arrow), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def talks() -> Iterator[tuple]:
            digest, joint = hashlib.sha256(), b""
            for talk, turn in _conversations(batches):
                if turn is None:
                    yield (talk.key, *(getattr(talk, c) for c in counts), talk.audit, digest.hexdigest())
                    digest, joint = hashlib.sha256(), b""
                else:
                    digest.update(joint + f"{turn[0]}:{turn[1]}".encode())
                    joint = b"\n"

        yield from _batched(talks(), lambda row: len(row[-2]), schema)

    convs = rows.select(conv_col) if all_convs is None else rows.select(conv_col).unionAll(all_convs.select(conv_col))
    made = through(_stream(rows, conv_col, turn_col, role_col, text_col, convs), run, f"conv {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
    return made.withColumnRenamed("conv", conv_col)


def damage(talks: DataFrame) -> DataFrame:
    """Conversations with faults put in: by a checksum of id and turn, rows are lost, emptied, cut, repeated or given the role user."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"]).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    rows = talks.select("conv_id", "turn", filled["role"].alias("role"), filled["text"].alias("text"), fault.alias("fault"))
    made = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return made.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damage(talks), talks)


#: The same by whole strings: each state of each turn keeps its audit and its text, and the least (cost, audit) wins.
OP12_SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), faulty AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
    FROM keyed, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
    FROM faulty, range(CASE WHEN fault = 0 THEN 0 WHEN fault = 3 THEN 2 ELSE 1 END)
), solid AS (
    SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM damaged
), judged AS (
    SELECT *, left(role, 1) AS initial, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM solid
), runs(p, k, q, made) AS (
    VALUES (0, 0, 0, ''), (0, 1, 2, 'user:' || chr(10)), (0, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
        (1, 0, 1, ''), (1, 1, 2, 'user:' || chr(10)), (1, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
        (2, 0, 2, ''), (2, 1, 3, 'assistant:' || chr(10)), (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)),
        (3, 0, 3, ''), (3, 1, 2, 'user:' || chr(10)), (3, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10))
), edits(q, initial, t, edit, cost, role) AS (
    VALUES (0, NULL, 0, 'D', 4, NULL), (1, NULL, 1, 'D', 4, NULL), (2, NULL, 2, 'D', 4, NULL), (3, NULL, 3, 'D', 4, NULL),
        (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL),
        (0, NULL, 2, 'R', 3, 'user'), (1, NULL, 2, 'R', 3, 'user'), (2, NULL, 3, 'R', 3, 'assistant'), (3, NULL, 2, 'R', 3, 'user')
), macros AS (
    SELECT p, t, initial, edit, repeat('I', k::INTEGER) || edit AS code, 3 * k + cost AS cost, made, role FROM runs JOIN edits USING (q)
), talks AS (
    SELECT c.conv_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n FROM judged GROUP BY conv_id) j ON c.conv_id IS NOT DISTINCT FROM j.conv_id
), dp AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS st, struct_pack(cost := 0::BIGINT, audit := '', made := '') AS way FROM talks
    UNION ALL
    SELECT dp.conv_id, dp.i + 1, m.t, min(struct_pack(cost := way.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END, audit := way.audit || m.code,
        made := way.made || m.made || CASE WHEN m.edit = 'D' THEN '' ELSE coalesce(m.role, r.role) || ':' || r.text || chr(10) END))
    FROM dp JOIN judged r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = dp.i + 1 JOIN macros m ON m.p = dp.st AND (m.initial IS NULL OR m.initial = r.initial) AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    GROUP BY dp.conv_id, dp.i + 1, m.t
), ended AS (
    SELECT dp.conv_id, min(struct_pack(cost := way.cost + 3 * k, audit := way.audit || repeat('I', k::INTEGER), made := way.made || runs.made)) AS way
    FROM dp JOIN talks ON dp.conv_id IS NOT DISTINCT FROM talks.conv_id AND dp.i = talks.n JOIN runs ON runs.p = dp.st AND (runs.q = 3 OR runs.q = 0 AND runs.k = 0) GROUP BY dp.conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit, sha256(left(way.made, greatest(length(way.made) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
