"""Conversation structure repair over a suffix-shared automaton of signatures.

A row of a conversation counts for its repair only through a symbol: its role's initial and
its fault.  A conversation so is a word of symbols, and all words together are few.  Words
are read from their ends: those that end alike share the nodes of that ending, as in a word graph
minimised from the end.  For each node and each state of the grammar ``(s?(ua)+)?`` the
cheapest edits of what follows, and their least audit, are worked out once for all
conversations that pass there.

Long conversations are words of blocks, cut from the end.  A block inside a conversation has
for each state that enters it and each that leaves it the cheapest audit; equally cheap ones of the same
two states are never each other's beginnings (they would differ by insertions, which cost), so the least
audit of a whole conversation is put together from the least audits of its blocks.

What goes through one task for a conversation is a stream of its blocks, held one batch at a time,
as the digest of its repaired text is one hash over all of it; rows are never gathered beyond a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.frames import batches, stored

BLOCK_ROWS = 64
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
MAY_END = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More insertions in one place never help: two bring the grammar back to where it was.
MOST_INSERTIONS = 3

Way = tuple[int, str]  # cost, audit
Node = list[dict[int, Way]]  # for each state: by the state (or END) in which it leaves, the best way
END = -1


def follows(state: int, initial: str) -> bool:
    return {"s": state == START, "u": state != USER, "a": state == USER}.get(initial, False)


def expected(state: int) -> str:
    """Initial of the one role that may be inserted or given."""
    return "a" if state == USER else "u"


def insertions(state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state after) of none, one, two ... inserted rows."""
    for n in range(MOST_INSERTIONS + 1):
        yield n * INSERT, "I" * n, state
        state = AFTER[expected(state)]


def symbol_edits(symbol: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, state after) of what may be done with a row: ``-`` must go, capitals are truncated."""
    yield DELETE, "D", state
    if symbol != "-":
        extra = TRUNCATED if symbol.isupper() else 0
        if follows(state, symbol.lower()):
            yield extra, "K", AFTER[symbol.lower()]
        yield REROLE + extra, "R", AFTER[expected(state)]


def _better(ways: dict[int, Way], leave: int, way: Way) -> None:
    if leave not in ways or way < ways[leave]:
        ways[leave] = way


def end_node() -> Node:
    """Where conversations end: insertions until the grammar may stop."""
    node: Node = [{} for _ in STATES]
    for s in STATES:
        for cost, audit, now in insertions(s):
            if now in MAY_END:
                _better(node[s], END, (cost, audit))
    return node


def border_node() -> Node:
    """Where a block inside a conversation ends: in the state it is in."""
    return [{s: (0, "")} for s in STATES]


def before(symbol: str, node: Node) -> Node:
    """The node of a symbol that ``node`` follows."""
    out: Node = [{} for _ in STATES]
    for s in STATES:
        for c1, a1, mid in insertions(s):
            for c2, a2, now in symbol_edits(symbol, mid):
                for leave, (c3, a3) in node[now].items():
                    _better(out[s], leave, (c1 + c2 + c3, a1 + a2 + a3))
    return out


class Automaton:
    """Nodes along the words that come in the order of their reversed symbols; endings in common are worked out once."""

    def __init__(self) -> None:
        self.path: list[Node] = []
        self.word, self.last = "", None
        self.made = 0

    def node(self, reverse: str, last: bool) -> Node:
        if last is not self.last:
            self.word, self.last, self.path = "", last, [end_node() if last else border_node()]
        common = 0
        while common < min(len(reverse), len(self.word)) and reverse[common] == self.word[common]:
            common += 1
        del self.path[common + 1:]
        for symbol in reverse[common:]:
            self.path.append(before(symbol, self.path[-1]))
            self.made += 1
        self.word = reverse
        return self.path[-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's crc32 of ``conv_id:turn`` calls for (nulls: one blank)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.where("damage <> 0").select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _total(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of a conversation (0 is the last one): its word, its rows and its counts; one shuffle."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    at = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "role", "text").orderBy(at)
    whole = Window.partitionBy("conv_id").orderBy(at, "role", "text", "nth")
    ends = F.rtrim(F.col("text"), F.lit(WHITE))
    df = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumns({
        "pos": F.row_number().over(whole), "n": F.count(F.lit(1)).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "initial": F.substring("role", 1, 1), "earlier": F.lag("role").over(whole), "turn_before": F.lag("turn").over(whole),
        "blank": ends == "", "open": ~F.substring(ends, -1, 1).isin(*STOPS)})
    df = df.withColumns({
        "block": F.floor((F.col("n") - F.col("pos")) / BLOCK_ROWS), "duplicate": ~F.col("blank") & (F.col("nth") > 1),
        "illegal": F.col("earlier").isNotNull() & ~F.concat(F.substring("earlier", 1, 1), "initial").isin("su", "ua", "au"),
        "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))})
    df = df.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("blank") | F.col("duplicate"), "-").when(F.col("truncated"), F.upper(known)).otherwise(known)
    held = F.sort_array(F.collect_list(F.struct("pos", symbol.alias("symbol"), "role", "text")))
    return df.groupBy("conv_id", "block").agg(
        held.alias("held"), *(_total(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "new_turn")),
        F.min("turn").cast("long").alias("low"), F.max("turn").cast("long").alias("high")) \
        .withColumn("word", F.array_join(F.transform("held", lambda x: x["symbol"]), "")) \
        .withColumns({"roles": F.transform("held", lambda x: x["role"]), "texts": F.transform("held", lambda x: x["text"])}).drop("held")


def word_ways(blocks: DataFrame) -> DataFrame:
    """word, last and, for each different word of a block, its ways: [[enter, leave, cost], ...] and their audits."""
    batches(blocks.sparkSession)
    words = blocks.select("word", (F.col("block") == 0).alias("last")).distinct().withColumn("reversed", F.reverse("word"))
    spread = words.repartitionByRange("last", "reversed").sortWithinPartitions("last", "reversed")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in it:
            nodes = [automaton.node(r, e) for r, e in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            ways = [[(s, leave, *way) for s in STATES for leave, way in node[s].items()] for node in nodes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[list(w[:3]) for w in x] for x in ways], pa.list_(pa.list_(pa.int32()))), pa.array([[w[3] for w in x] for x in ways], pa.list_(pa.string()))],
                ["word", "last", "ways", "audits"])

    return spread.mapInArrow(run, "word string, last boolean, ways array<array<int>>, audits array<string>")


def chosen(placed: DataFrame) -> DataFrame:
    """conv_id, block, exits, pieces, costs: for each state that enters a block, where the best whole repair leaves it, its piece, and what it costs to the end."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[Way] = []
        for batch in it:
            out: tuple[list, list, list] = ([], [], [])
            for block, ways, audits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                best: list[tuple[Way, int, str] | None] = [None] * 4
                for (s, leave, cost), audit in zip(ways, audits):
                    after = (0, "") if block == 0 else rest[leave]
                    way = (cost + after[0], audit + after[1])
                    if best[s] is None or way < best[s][0]:
                        best[s] = way, leave, audit
                rest = [b[0] for b in best]
                for column, value in zip(out, ([b[1] for b in best], [b[2] for b in best], [b[0][0] for b in best])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.list_(pa.int64()))],
                ["conv_id", "block", "exits", "pieces", "costs"])

    kind = placed.schema["conv_id"].dataType.simpleString()
    ordered = placed.select("conv_id", "block", "ways", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(run, f"conv_id {kind}, block long, exits array<int>, pieces array<string>, costs array<long>")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "new_turn")


class Repair:
    """One conversation's result, block after block."""

    def __init__(self, cost: int) -> None:
        self.cost, self.state, self.audit, self.sha, self.first = cost, START, [], hashlib.sha256(), True
        self.counts, self.low, self.high = [0] * len(COUNTS), None, None

    def take(self, piece: str, leave: int, row: dict) -> None:
        rows, state = iter(zip(row["roles"], row["texts"])), self.state
        for letter in piece:
            role, text = (None, "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if expected(state) == "a" else "user"
            state = AFTER[role[0]]
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False
        self.state = leave
        self.audit.append(piece)
        self.counts = [a + row[c] for a, c in zip(self.counts, COUNTS)]
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else min(self.low, row["low"])
            self.high = row["high"] if self.high is None else max(self.high, row["high"])

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts[4]
        return gaps, *self.counts[:4], self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def written_out(blocks: DataFrame, choices: DataFrame) -> DataFrame:
    """Results of all conversations that have rows: blocks and their choices stream by in order, each choice before its block."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, choice = False, None, None
        repair = Repair(0)
        names = ["conv_id", *(f.split()[0] for f in RESULT.split(", "))]

        def batch_of(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [like.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

        batch = None
        for batch in it:
            done = []
            for row in batch.to_pylist():
                if row["roles"] is None:
                    choice = row
                    if not open_ or row["conv_id"] != now:
                        if open_:
                            done.append((now, *repair.result()))
                        open_, now, repair = True, row["conv_id"], Repair(row["costs"][START])
                else:
                    repair.take(choice["pieces"][repair.state], choice["exits"][repair.state], row)
            yield batch_of(done, batch)
        if open_:
            yield batch_of([(now, *repair.result())], batch)

    kind = blocks.schema["conv_id"].dataType.simpleString()
    both = blocks.drop("word").unionByName(choices, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("block").desc(), F.col("roles").isNotNull())
    return ordered.mapInArrow(run, f"conv_id {kind}, {RESULT}")


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and repaired digest of each conversation.

    ``rows`` has conv_id, turn, role, text, taken by turn (nulls first), rows of one turn by role and
    text; null roles and texts are one blank, null conversation ids are one conversation.  ``ids`` names
    conversations that may have no rows left; they get zeros, an empty audit and the digest of an empty text.
    Roles count by their first letter; one that isn't s, u or a can't be kept.  Repeated rows are duplicates, empty texts are blank.
    Other columns are not read; an empty table without ids gives an empty result.
    """
    batches(rows.sparkSession)
    blocks = stored(in_blocks(rows), "op11-blocks")
    ways = stored(word_ways(blocks), "op11-ways")
    placed = blocks.select("conv_id", "block", "word", (F.col("block") == 0).alias("last")).join(ways, ["word", "last"])
    found = written_out(blocks, stored(chosen(placed), "op11-choices"))
    if ids is None:
        return found
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    columns = [F.coalesce(F.col(f.split()[0]), F.lit(nothing.get(f.split()[0], 0))).alias(f.split()[0]) for f in RESULT.split(", ")]
    every = ids.select(F.col("conv_id").alias("id")).distinct()
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *columns)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The damage, and its repair, for every conversation of the table; odd rows as in :func:`repaired`."""
    return repaired(damaged(conversations), conversations)
