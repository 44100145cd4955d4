"""Repair of conversation structure by aligning turns to the strings of a grammar.

Roles of a whole conversation read `(s?(ua)+)?`: perhaps a system turn, then a user and an
assistant in turn, or nothing. There is at most one such string of each length, so a repair is an
alignment of the rows to the string of some length, as in Wagner and Fischer's edit distance:

    K  keep a row                  0
    R  name it user or assistant   1
    D  delete it                   2, and required where it is blank or a duplicate
    I  insert an empty user or assistant   5
    a truncated row that is not deleted    5 more

Every length that can still be as cheap as the best repair so far is tried, in a band of diagonals
around which no path can be as cheap (Ukkonen). Equally cheap repairs are told apart by their
audits, the letters of their edits in order: the least one in ASCII wins.

Rows are dealt by ranges of (conversation, turn), so conversations lie side by side and a long one
is cut into blocks, each aligned from every state of the grammar it may begin in. Blocks are then
chained by their costs: first from the last to the first, which settles what every state costs to
the end, then from the first to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripweave.llm.common import bound_batches, once_per_worker, written

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS = 32
BLOCK_BYTES = 4 * 1024 * 1024
MEMO_ROWS = 50_000
PREFIX_CHARS = 64
#: What a text may hold and still be blank, and what a whole sentence ends with.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# States of the grammar: before the first turn, and after a system, user or assistant turn.
STATES = "-sua"
NAMES = {"u": "user", "a": "assistant"}
#: What closes a conversation from each state: insertions that complete the last pair.
TAILS = ("", "II", "I", "")
NEVER = 1 << 40
LEGAL = {"su", "ua", "au"}

BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
    T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("digests", T.ArrayType(T.BinaryType())),
    T.StructField("symbols", T.StringType())])
REPORT = T.StructType([T.StructField(name, T.LongType()) for name in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
TURN = T.StructType([T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


# ---- alignment ------------------------------------------------------------------------------

def symbol_of(role: str, text: str) -> str:
    """What the alignment sees of a row: b for a blank one, else the initial of its role (o for
    others), in upper case if its text is truncated. Duplicates become d later."""
    text = text.rstrip(BLANKS)
    if not text:
        return "b"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if text[-1] in ENDS else initial.upper()


def target(state: str, length: int, system: bool = False) -> str:
    """The string of a length that may follow a state of the grammar."""
    if system and length:
        return "s" + target("s", length - 1)
    return (("au" if state == "u" else "ua") * (length // 2 + 1))[:length]


def align(symbols: str, wanted: str, limit: int, tail: bool) -> tuple[int, str] | None:
    """The cheapest edits that turn rows into a string, the least audit of those; None if all cost
    more than `limit`. Without `tail`, nothing is inserted behind the last row."""
    m, n = len(symbols), len(wanted)
    free = [0]  # rows up to here that may stay
    for symbol in symbols:
        free.append(free[-1] + (symbol not in "bd"))
    forced = DELETE * (m - free[m])
    gap = free[m] - n

    def least(steps: int) -> int:
        return DELETE * steps if steps >= 0 else -INSERT * steps

    diagonals = [d for d in range(-n, free[m] + 1) if forced + least(d) + least(gap - d) <= limit]
    if not diagonals:
        return None
    low, high = diagonals[0], diagonals[-1]
    # cost[i][j]: from having used i rows and j characters to the end, in the band free[i] - j
    cost = [dict() for _ in range(m + 1)]
    for i in range(m, -1, -1):
        here, after = cost[i], cost[i + 1] if i < m else {}
        symbol = symbols[i] if i < m else ""
        for j in range(min(n, free[i] - low), max(0, free[i] - high) - 1, -1):
            if i == m:
                best = 0 if j == n else NEVER
            else:
                best = DELETE + after.get(j, NEVER)
                if j < n and symbol not in "bd":
                    best = min(best, _match(symbol, wanted[j]) + after.get(j + 1, NEVER))
            if j < n and wanted[j] != "s" and (tail or i < m):
                best = min(best, INSERT + here.get(j + 1, NEVER))
            here[j] = best
    total = cost[0].get(0, NEVER)
    if total > limit:
        return None
    audit, i, j = [], 0, 0
    while i < m or j < n:
        left, symbol = cost[i][j], symbols[i] if i < m else ""
        if i < m and left == DELETE + cost[i + 1].get(j, NEVER):
            audit.append("D")
            i += 1
        elif j < n and wanted[j] != "s" and (tail or i < m) and left == INSERT + cost[i].get(j + 1, NEVER):
            audit.append("I")
            j += 1
        else:  # of a row and a character only one of keeping and naming is open
            audit.append("K" if symbol.lower() == wanted[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _match(symbol: str, wanted: str) -> int:
    if symbol.lower() == wanted:
        price = KEEP
    elif wanted == "s":
        return NEVER
    else:
        price = RENAME
    return price + (TRUNCATED if symbol.isupper() else 0)


def _lengths(symbols: str) -> list[tuple[int, int]]:
    """All lengths in order of the least a repair to them can cost, with that cost."""
    free = sum(symbol not in "bd" for symbol in symbols)
    forced = DELETE * (len(symbols) - free)
    most = forced + DELETE * free  # deleting all rows
    found = [(forced + (DELETE * (free - n) if n <= free else INSERT * (n - free)), n)
             for n in range(free + DELETE * free // INSERT + 4)]
    return sorted((least, n) for least, n in found if least <= most + INSERT * len(TAILS[1]))


def repair(symbols: str) -> tuple[int, str]:
    """Cost and audit of the best repair of a whole conversation."""
    best = (DELETE * len(symbols), "D" * len(symbols))
    for least, n in _lengths(symbols):
        if n == 0 or n == 1 or least > best[0]:
            continue
        found = align(symbols, target("-", n, system=n % 2 == 1), best[0], tail=True)
        if found:
            best = min(best, found)
    return best


def block_table(symbols: str) -> list[tuple[int, str] | None]:
    """Cost and audit of the best edits of a block of rows, by state before and state after it.

    An audit ends with the last row, so no audit of a block is the beginning of another, and
    comparing the audits of whole conversations is comparing them block by block.
    """
    table: list[tuple[int, str] | None] = [None] * 16
    for before, state in enumerate(STATES):
        for least, n in _lengths(symbols):
            for system in (False, True) if state == "-" and n else (False,):
                wanted = target(state, n, system)
                at = 4 * before + (STATES.index(wanted[-1]) if n else before)
                limit = table[at][0] if table[at] else DELETE * len(symbols) + INSERT * len(TAILS[1])
                if least <= limit:
                    found = align(symbols, wanted, limit, tail=False)
                    if found and (table[at] is None or found < table[at]):
                        table[at] = found
    return table


def kept(work):
    """`work` of a string, looked up among those the worker has met; at most `MEMO_ROWS` are kept."""
    known = once_per_worker(("repair", work.__name__), dict)

    def run(symbols: str):
        found = known.get(symbols)
        if found is None:
            if len(known) >= MEMO_ROWS:
                known.clear()
            found = known[symbols] = work(symbols)
        return found
    return run


# ---- what comes out ---------------------------------------------------------------------------

class Outcome:
    """A conversation as it is repaired, fed in order: sums, a digest and its audit, and the turns
    of the last feed if they are wanted."""

    def __init__(self, key, turns: bool = False):
        self.key, self.want_turns = key, turns
        self.low = self.high = self.last = None
        self.distinct = self.illegal = self.cost = self.place = 0
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.before, self.state, self.first = None, "-", True
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.made: list[tuple] = []

    def feed(self, turns: list, roles: list, texts: list, symbols: str, audit: str) -> None:
        for turn, role, symbol in zip(turns, roles, symbols):
            if turn is not None:
                self.distinct += turn != self.last
                self.low = turn if self.low is None else self.low
                self.high = self.last = turn
            if self.before is not None:
                self.illegal += self.before + role[:1] not in LEGAL
            self.before = role[:1]
            kind = symbol if symbol in "bd" else "t" if symbol.isupper() else ""
            if kind:
                self.counts[kind] += 1
        at = 0
        for edit in audit:
            if edit == "I":
                self._set(edit, None, "")
                continue
            if edit == "D":
                self.cost += DELETE
            else:
                self._set(edit, roles[at], texts[at])
                self.cost += TRUNCATED if symbols[at].isupper() else 0
            at += 1
        self.audit.append(audit)

    def _set(self, edit: str, role: str | None, text: str) -> None:
        following = role[:1] if edit == "K" else "a" if self.state == "u" else "u"
        role = role if edit == "K" else NAMES[following]
        self.cost += {"K": KEEP, "R": RENAME, "I": INSERT}[edit]
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first, self.state = False, following
        self.place += 1
        if self.want_turns:
            self.made.append((self.place, edit, role, text))

    def close(self) -> None:
        tail = TAILS[STATES.index(self.state)]
        self.feed([], [], [], "", tail)

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return dict(zip(REPORT.names, (
            gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost,
            "".join(self.audit), self.digest.hexdigest())))

    def rows(self, last: bool) -> list[dict]:
        """What there is to give now: turns made since the last call, or the report at the end."""
        if self.want_turns:
            out, self.made = [dict(zip(TURN.names, turn)) for turn in self.made], []
            return out
        return [self.report()] if last else []


def _finish(key, pending: list, turns: bool) -> list[dict]:
    """The outcome of a conversation that lies in one block."""
    symbols, seen = [], set()
    for _, _, _, digest, symbol in pending:
        symbols.append("d" if symbol != "b" and digest in seen else symbol)
        seen.add(digest)
    outcome, spelled = Outcome(key, turns), "".join(symbols)
    outcome.feed(*[[row[i] for row in pending] for i in range(3)], spelled, kept(repair)(spelled)[1])
    return outcome.rows(True)


def _block(part: int, number: int, pending: list) -> dict:
    turns, roles, texts, digests, symbols = zip(*pending) if pending else [()] * 5
    return {"part": part, "number": number, "turns": list(turns), "roles": list(roles), "texts": list(texts),
            "digests": list(digests), "symbols": "".join(symbols)}


# ---- conversations as tables ------------------------------------------------------------------

def _ordered(conversations: DataFrame, dropped: str | None) -> DataFrame:
    """Rows side by side in order of conversation and turn (nulls first). Rows of one turn are in
    order of role, the first characters of the text, and its digest; equal rows are adjacent."""
    def column(name: str, kind: str) -> Column:
        return conversations[name].cast(kind)

    null_text = F.lit(" ")
    rows = conversations.select(
        column("conv_id", "bigint").alias("conv_id"), column("turn", "bigint").alias("turn"),
        F.coalesce(column("role", "string"), null_text).alias("role"),
        F.coalesce(column("text", "string"), null_text).alias("text"),
        (conversations[dropped] if dropped else F.lit(False)).alias("dropped"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    order = ["conv_id", "turn", "role", "prefix", "digest"]
    rows = rows.withColumn("prefix", F.substring("text", 1, PREFIX_CHARS))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("prefix")


def _first_pass(ordered: DataFrame, kind: T.StructType, turns: bool) -> DataFrame:
    """conv_id and either the outcome of a conversation or one of its blocks.

    A conversation that lies whole inside a part, in one block, is done here. What may go on in
    another part (the first and the last conversation of each) or is longer leaves as blocks.
    """
    schema = T.StructType([ordered.schema["conv_id"], T.StructField("out", kind), T.StructField("block", BLOCK)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, pending, held, number, whole, begun = None, [], 0, 0, False, False
        made: list[dict] = []

        def flush(last: bool) -> None:
            """Gives away the pending rows; `last` if the conversation surely ends with them."""
            nonlocal number, whole
            if whole and last:
                made.extend({"conv_id": key, "out": row, "block": None} for row in _finish(key, pending, turns))
                return
            number += 1
            whole = False
            made.append({"conv_id": key, "out": None, "block": _block(part, number, pending)})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for conv, turn, role, text, dropped, digest in zip(*columns):
                if not begun or conv != key:
                    if begun:
                        flush(True)
                    key, pending, held, whole, begun = conv, [], 0, begun, True
                if dropped:
                    continue
                if len(pending) >= BLOCK_ROWS or held >= BLOCK_BYTES:
                    flush(False)
                    pending, held = [], 0
                pending.append((turn, role, text, digest, symbol_of(role, text)))
                held += len(text)
            if made:
                yield pa.RecordBatch.from_pylist(made, arrow)
                made.clear()
        if begun:
            flush(False)
            yield pa.RecordBatch.from_pylist(made, arrow)

    return ordered.mapInArrow(run, schema)


def _mark_duplicates(blocks: DataFrame) -> DataFrame:
    """conv_id, part, number and symbols of every block, duplicates among all rows of the
    conversation marked. Equal rows meet as one row each that is counted per task."""
    place = F.struct("part", "number", "at")
    rows = blocks.select("conv_id", "part", "number", F.posexplode("digests").alias("at", "digest"), "symbols").filter(
        F.substring("symbols", F.col("at") + 1, F.lit(1)) != "b").drop("symbols")
    first = rows.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter(
        "n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    again = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).filter(
        place != F.col("first")).groupBy("part", "number").agg(F.collect_list("at").alias("again"))
    marked = F.array_join(F.transform(
        F.split("symbols", ""), lambda s, i: F.when(F.array_contains("again", i), F.lit("d")).otherwise(s)), "")
    return blocks.select("conv_id", "part", "number", "symbols").join(again, ["part", "number"], "left").select(
        "conv_id", "part", "number", F.when(F.col("again").isNull(), F.col("symbols")).otherwise(marked).alias("symbols"))


CHOICE = T.StructType([T.StructField("symbols", T.StringType()), T.StructField("audits", T.ArrayType(T.StringType())),
                       T.StructField("states", T.ArrayType(T.IntegerType()))])


def _choices(marked: DataFrame) -> DataFrame:
    """For every block and every state it may begin in, the edits of the best repair from there
    to the end of the conversation, and the state they end in.

    Blocks are aligned where they lie; then their costs pass from the last to the first through the
    task of their conversation, one at a time.
    """
    tables = T.StructType(marked.schema.fields + [
        T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.StringType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = kept(block_table)
        for batch in batches:
            made = [table_of(symbols) for symbols in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns + [
                pa.array([[x and x[0] for x in table] for table in made], pa.list_(pa.int64())),
                pa.array([[x and x[1] for x in table] for table in made], pa.list_(pa.string()))], names=tables.names)

    filled = marked.repartition("part", "number").mapInArrow(fill, tables)
    schema = T.StructType(marked.schema.fields[:3] + CHOICE.fields)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, ahead = None, False, []
        for batch in batches:
            columns, audits, states = [batch.column(i).to_pylist() for i in range(6)], [], []
            for conv, costs, edits in zip(columns[0], columns[4], columns[5]):
                if not begun or conv != key:
                    key, begun, ahead = conv, True, [INSERT * len(tail) for tail in TAILS]
                best = [min((costs[4 * e + x] + ahead[x], edits[4 * e + x], x) for x in range(4) if costs[4 * e + x] is not None)
                        for e in range(4)]
                ahead = [cost for cost, _, _ in best]
                audits.append([edit for _, edit, _ in best])
                states.append([x for _, _, x in best])
            yield pa.RecordBatch.from_arrays(batch.columns[:4] + [
                pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], names=schema.names)

    backwards = filled.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    return backwards.mapInArrow(chain, schema)


def _last_pass(blocks: DataFrame, choices: DataFrame, kind: T.StructType, turns: bool) -> DataFrame:
    """The outcomes of conversations in several blocks. A block and its choices stand next to each
    other in the task of the conversation and pass through it in order, so it holds one block."""
    both = blocks.select("conv_id", "part", "number", F.struct("turns", "roles", "texts").alias("rows"),
                         F.lit(None).cast(CHOICE).alias("choice")).unionByName(
        choices.select("conv_id", "part", "number", F.lit(None).cast(
            T.StructType([BLOCK["turns"], BLOCK["roles"], BLOCK["texts"]])).alias("rows"),
            F.struct(*CHOICE.names).alias("choice")))
    schema = T.StructType([blocks.schema["conv_id"], T.StructField("out", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcome, state, choice, made = None, 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if outcome is None or outcome.key != row["conv_id"]:
                    if outcome:
                        outcome.close()
                        made += [(outcome.key, out) for out in outcome.rows(True)]
                    outcome, state = Outcome(row["conv_id"], turns), 0
                if row["choice"]:
                    choice = row["choice"]
                    continue
                rows = row["rows"]
                outcome.feed(rows["turns"], rows["roles"], rows["texts"], choice["symbols"], choice["audits"][state])
                state = choice["states"][state]
                made += [(outcome.key, out) for out in outcome.rows(False)]
            if made:
                yield pa.RecordBatch.from_pylist([{"conv_id": key, "out": out} for key, out in made], arrow)
                made = []
        if outcome:
            outcome.close()
            made += [(outcome.key, out) for out in outcome.rows(True)]
            if made:
                yield pa.RecordBatch.from_pylist([{"conv_id": key, "out": out} for key, out in made], arrow)

    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number", F.col("rows").isNotNull())
    return dealt.mapInArrow(run, schema)


def _repaired(conversations: DataFrame, kind: T.StructType, turns: bool, dropped: str | None) -> DataFrame:
    bound_batches(conversations.sparkSession)
    passed = written(_first_pass(_ordered(conversations, dropped), kind, turns), "repair")
    blocks = passed.filter("block IS NOT NULL").select("conv_id", "block.*")
    late = _last_pass(blocks, _choices(_mark_duplicates(blocks)), kind, turns)
    return passed.filter("out IS NOT NULL").select("conv_id", "out.*").unionByName(late.select("conv_id", "out.*"))


def repair_reports(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every
    conversation.

    Rows are read by turn, nulls first. Null ids are one conversation; a null role or text is one space,
    so a row without a text is blank. Repeated rows are duplicates. The column named `dropped`, if any,
    marks rows that are left out; a conversation of such rows alone has zeros, no audit and the digest of
    nothing. An empty table gives no rows; further columns are not read. The audit and digest of a
    conversation are one sequence each; its rows pass through in blocks.
    """
    return _repaired(conversations, REPORT, False, dropped)


def repaired_turns(conversations: DataFrame, dropped: str | None = None) -> DataFrame:
    """conv_id, place (from 1), edit (K, R or I), role and text of every turn of the repaired
    conversations. Same rules for odd rows as in `repair_reports`."""
    return _repaired(conversations, TURN, True, dropped)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults of five kinds, by a checksum of their conversation and turn (nulls: one
    space) modulo 20: 0 marks the row as dropped, 1 empties its text, 2 takes its sentence ends
    away, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    rows = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].cast("bigint").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), space).alias("role"),
        F.coalesce(conversations["text"].cast("string"), space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fault", F.crc32(key.cast("binary")) % 20)
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(
            F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")
