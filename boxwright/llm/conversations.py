"""Conversation repair over a suffix-shared automaton of row signatures.

Every row is one symbol: its role's initial and its first fault. A block of up to ``BLOCK`` consecutive rows of a conversation
is a word. What an edit costs from a row on depends on the rows behind it alone, so words are minimised from the end: a
node is a suffix, shared by all conversations that end alike. The distinct words of the whole table are sorted by their reversed
text and range-partitioned; a task walks them with one stack, so that each node is solved once: for each state of the
grammar ``(s?(ua)+)?`` the cost to go and the best audit suffix. All choices of a node start with different letters, so the ASCII-least of the
cheapest audits is the one of the least letter, and no audits are compared.

A conversation of many blocks needs the costs behind a block. Less their minimum these are one of a few vectors (the classes), since any
state is reached from any other at a bounded cost; a block's root is then the class behind it instead of the end. Rows move to
blocks in a range sort, so a conversation of any length is cut, not gathered. Only the last step, a hash over a conversation's
text, reads it in order in one task, as a stream that holds one row and one block.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank and duplicate rows), Insert an empty user or assistant row 2; a
truncated row that stays adds 1.

Defined results: a null role or text is one space, null turns come first, equal turns go by role and then by the hash of the text; rows
with the same turn, role and text are copies of each other; a null conv_id is a conversation of its own; an empty table
gives an empty result; other columns are ignored, the names used are the operator's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.session import materialize

BLOCK = 512
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}  # grammar states: start, s, u, a
MADE = (2, 2, 3, 2)  # the state after the one role that can be made in a state
ROLE = {2: "user", 3: "assistant"}
END = -1
ARROW = {"bigint": pa.int64(), "int": pa.int32()}
BLANKS = r"' \t\n\u000b\f\r'"

Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]  # by state: cost to go, audit, state at the block's end
Made = tuple[str, str, str]  # edit, role, text


def step(node: Node, symbol: str) -> Node:
    """The node before ``node`` by a row: D (blank or duplicate) or a role's initial, upper case if truncated."""
    cost, audit, last = node
    cut = int(symbol.isupper())
    base = []
    for q in range(4):
        options = [(3 + cost[q], "D", q)]
        if symbol != "D":
            to = KEEP.get((symbol.lower(), q))
            if to is not None:
                options.append((cut + cost[to], "K", to))
            options.append((2 + cut + cost[MADE[q]], "R", MADE[q]))
        best, letter, to = min(options)
        base.append((best, letter, letter + audit[to], last[to]))
    made = list(base)
    for q in (2, 3, 0, 1):
        ahead = (base if q > 1 else made)[MADE[q]]
        made[q] = min(base[q], (2 + ahead[0], "I", "I" + ahead[2], ahead[3]))
    return tuple(m[0] for m in made), tuple(m[2] for m in made), tuple(m[3] for m in made)


def _classes() -> tuple[list[tuple[int, ...]], dict[tuple[int, str], int]]:
    """All cost vectors (least value 0) behind a row, the end's first, and the class before a class by a symbol."""
    found, moves, at = [(0, 4, 2, 0)], {}, 0
    while at < len(found):
        for symbol in "DsuaxSUAX":
            cost = step((found[at], ("",) * 4, (0,) * 4), symbol)[0]
            vector = tuple(c - min(cost) for c in cost)
            if vector not in found:
                found.append(vector)
            moves[at, symbol] = found.index(vector)
        at += 1
    return found, moves


CLASSES, MOVES = _classes()


def root(behind: int) -> Node:
    """The node at a block's end: the conversation's end, or a class of what follows."""
    if behind == END:
        return CLASSES[0], ("", "II", "I", ""), (0, 3, 3, 3)
    return CLASSES[behind], ("",) * 4, (0, 1, 2, 3)


def damage(rows: DataFrame) -> DataFrame:
    """The rows with ``copies``, after a damage that crc32(conv_id:turn) % 20 picks: 0 drop, 1 empty, 2 no ends, 3 repeat, 4 user."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    name = F.concat(*[F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    kind = F.crc32(name) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _read(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    text, role = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("text", "role"))
    return rows.select("conv_id", "turn", role, text, copies.alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest) with their number and ``code``: b blank, d duplicate, else the initial (x: none of
    s, u, a), upper case if truncated. Conversations whose rows are all dropped keep one row without a code."""
    here = F.col("copies") > 0
    bare = F.expr(f"rtrim({BLANKS}, text)")
    initial = F.expr("left(role, 1)")
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(bare == "", "b").when(F.expr(f"right(rtrim({BLANKS}, text), 1) in ('.', '!', '?')"), kind).otherwise(F.upper(kind))
    light = rows.select("conv_id", *[F.when(here, x).alias(n) for n, x in (("turn", F.col("turn")), ("role", F.col("role")), ("digest", _digest()), ("code", code))], "copies")
    every = light.groupBy("conv_id", "turn", "role", "digest", "code").agg(F.sum("copies").alias("m"))
    # a text was seen before if its first turn is an earlier one; null turns come first
    first = every.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_none"))
    seen = every.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    again = F.col("turn").isNotNull() & (F.col("_none") | (F.col("_least") < F.col("turn")))
    return seen.select("conv_id", "turn", "role", "digest", "m", F.when((F.col("code") != "b") & again, "d").otherwise(F.col("code")).alias("code"))


ORDER = ("turn", "role", "digest")


def blocks(light: DataFrame, size: int = BLOCK) -> DataFrame:
    """Words of up to ``size`` rows in order, with what a conversation's counts need."""
    kind = light.schema["conv_id"].dataType.simpleString()
    turn = light.schema["turn"].dataType.simpleString()
    schema = f"conv_id {kind}, seq long, turn {turn}, role string, digest binary, word string, blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn {turn}, last_turn {turn}, turns long"
    laid = light.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seq, now = 0, None

        def made() -> tuple:
            return now["conv_id"], seq, *now["key"], "".join(now["word"]), *now["faults"], now["illegal"], now["head"], now["tail"], now["first"], now["last"], now["turns"]

        for batch in batches:
            for conv, at, role, digest, m, code in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for copy in range(max(m, 1)):
                    if now is None or now["conv_id"] != conv or len(now["word"]) >= size:
                        if now is not None:
                            yield made()
                            seq += 1
                        now = {"conv_id": conv, "key": (at, role, digest), "word": [], "faults": [0, 0, 0], "illegal": 0, "head": None, "tail": None, "first": None, "last": None, "turns": 0}
                    if code is None:
                        continue
                    c = code if not copy or code == "b" else "d"
                    now["word"].append("D" if c in "bd" else c)
                    if c in "bd":
                        now["faults"]["bd".index(c)] += 1
                    elif c.isupper():
                        now["faults"][2] += 1
                    initial = role[:1]
                    if now["tail"] is None:
                        now["head"] = initial
                    elif now["tail"] + initial not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["tail"] = initial
                    if at is not None and at != now["last"]:
                        now["turns"] += 1
                        now["first"] = at if now["first"] is None else now["first"]
                        now["last"] = at
        if now is not None:
            yield made()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, text, whole = pa.int64(), pa.string(), ARROW[turn]
        types = [long, whole, text, pa.binary(), text, long, long, long, long, text, text, whole, whole, long]
        return _rows_of(batches, [part.split()[0] for part in schema.split(", ")], types, words)

    cut_up = laid.select("conv_id", *ORDER, "m", "code").mapInArrow(cut, schema)
    return materialize(cut_up.withColumn("part", F.spark_partition_id()))


def with_class(words: DataFrame) -> DataFrame:
    """Blocks with ``behind``: END for a conversation's last block, else the class of the costs behind the block."""
    at = Window.partitionBy("conv_id")
    counted = words.withColumn("_n", F.count("*").over(at))
    one, many = counted.where("_n = 1").drop("_n").withColumn("behind", F.lit(END)), counted.where("_n > 1").drop("_n")
    back = many.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, behind, fresh = None, END, True
        for batch in batches:
            out = []
            for c, word in zip(batch.column("conv_id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if fresh or c != conv:
                    conv, behind, fresh = c, END, False
                out.append(behind)
                behind = max(behind, 0)
                for symbol in reversed(word):
                    behind = MOVES[behind, symbol]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "behind"])

    return one.unionByName(back.mapInArrow(walk, back.withColumn("behind", F.lit(END)).schema))


def solved(words: DataFrame) -> DataFrame:
    """(behind, word) with cost, audit and last state by first state: each node of the automaton is solved once a task."""
    distinct = words.groupBy("behind", "word").agg(F.count("*").alias("_n")).select("behind", F.reverse("word").alias("word"))
    laid = distinct.repartitionByRange("behind", "word").sortWithinPartitions("behind", "word")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, before, held = [], "", None
        for batch in batches:
            ends, backs, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for behind, back in zip(ends, backs, strict=True):
                if behind != held:
                    stack, before, held = [root(behind)], "", behind
                same = 0
                for x, y in zip(before, back):  # noqa: B905
                    if x != y:
                        break
                    same += 1
                del stack[same + 1:]
                for symbol in back[same:]:
                    stack.append(step(stack[-1], symbol))
                before = back
                cost, audit, last = stack[-1]
                spent = cost if behind == END else [c - CLASSES[behind][e] for c, e in zip(cost, last, strict=True)]
                out.append((behind, back[::-1], list(spent), list(audit), list(last)))
            if out:
                cols = list(zip(*out, strict=True))
                types = (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["behind", "word", "cost", "audit", "last"])

    return laid.mapInArrow(solve, "behind int, word string, cost array<long>, audit array<string>, last array<int>")


def _stream(rows: DataFrame, size: int) -> tuple[DataFrame, str]:
    """Blocks with their solutions and the rows' texts, in order by conversation in one partition."""
    read = _read(rows)
    words = blocks(symbols(read), size)
    placed = with_class(words)
    both = materialize(placed.join(solved(placed), ["behind", "word"]))
    texts = read.where("copies > 0").select("conv_id", "turn", "role", _digest(), "text", "copies")
    facts = ("part", "seq", "word", "behind", "blank", "duplicate", "truncated", "illegal", "head", "tail", "first_turn", "last_turn", "turns", "cost", "audit", "last")
    heads = both.select("conv_id", *ORDER, F.lit(0).alias("kind"), F.struct(*[f for f in facts if f not in ("word", "behind")]).alias("block"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    none = F.lit(None).cast(heads.schema["block"].dataType)
    bodies = texts.select("conv_id", *ORDER, F.lit(1).alias("kind"), none.alias("block"), "text", "copies")
    order = [F.asc_nulls_first(c) for c in ("conv_id", *ORDER)]
    laid = heads.union(bodies).repartition("conv_id").sortWithinPartitions(*order, "kind", "block.part", "block.seq")
    return laid, rows.schema["conv_id"].dataType.simpleString()


class _Walk:
    """One conversation while its rows stream by: state, audit left and counts."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.left, self.at, self.queue = conv, 0, "", 0, []
        self.audit, self.cost, self.turns, self.last_turn, self.first_turn, self.tail = [], 0, 0, None, None, None
        self.counts = [0, 0, 0, 0]

    def made(self) -> str:
        self.state = MADE[self.state]
        return ROLE[self.state]

    def take(self, b: dict) -> None:
        """Start a block; the state at its start picks the solution."""
        self.left, self.at = b["audit"][self.state], 0
        self.audit.append(self.left)
        self.cost += b["cost"][self.state]
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += b[name]
        if b["head"] is not None:
            self.counts[3] += self.tail is not None and self.tail + b["head"] not in ("su", "ua", "au")
            self.tail = b["tail"]
        if b["turns"]:
            self.turns += b["turns"] - (self.last_turn is not None and self.last_turn == b["first_turn"])
            self.first_turn = b["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = b["last_turn"]

    def ready(self) -> Iterator[Made]:
        """The inserts before the next row; blocks that wait are taken (a block may begin inside equal rows)."""
        while True:
            while self.at < len(self.left) and self.left[self.at] == "I":
                self.at += 1
                yield "I", self.made(), ""
            if self.at < len(self.left) or not self.queue:
                return
            self.take(self.queue.pop(0))

    def row(self, role: str, text: str) -> Iterator[Made]:
        yield from self.ready()
        edit = self.left[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEP[role[:1], self.state]
            yield edit, role, text
        elif edit == "R":
            yield edit, self.made(), text

    def facts(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.conv, gaps, *self.counts, self.cost, "".join(self.audit)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Walk, Made | None]]:
    """(conversation, repaired row) in order, and (conversation, None) at its end."""
    now = None

    def end() -> Iterator[tuple[_Walk, Made | None]]:
        for row in now.ready():
            yield now, row
        yield now, None

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "block", "text", "copies")]
        for conv, role, block, text, copies in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    yield from end()
                now = _Walk(conv)
            if block is not None:
                now.queue.append(block)
            for _ in range(copies):
                for row in now.row(role, text):
                    yield now, row
    if now is not None:
        yield from end()


def _rows_of(batches: Iterator[pa.RecordBatch], names: Sequence[str], types: Sequence[pa.DataType], rows_of) -> Iterator[pa.RecordBatch]:
    """Rows that ``rows_of`` makes of the batches, some thousand at a time; the first column has conv_id's type."""
    kind = []

    def typed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind[:] = [batch.schema.field("conv_id").type]
            yield batch

    out = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kind, *types], strict=True)], names=list(names))

    for row in rows_of(typed()):
        out.append(row)
        if len(out) >= 4096:
            yield packed()
            out = []
    if out:
        yield packed()


def repair(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, least cost, audit and the hash of the repaired text."""
    laid, kind = _stream(rows, size)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, some = hashlib.sha256(), False
        for walk, row in _walked(batches):
            if row is None:
                yield *walk.facts(), digest.hexdigest()
                digest, some = hashlib.sha256(), False
            else:
                digest.update((("\n" if some else "") + row[1] + ":" + row[2]).encode())
                some = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows_of(batches, names, [pa.int64()] * 6 + [pa.string()] * 2, hashed)

    return laid.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The repaired conversations, a row each: conv_id, place from 0, edit, role, text."""
    laid, kind = _stream(rows, size)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for walk, row in _walked(batches):
            if row is not None:
                yield walk.conv, place, *row
            place = 0 if row is None else place + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows_of(batches, ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.string(), pa.string(), pa.string()], placed)

    return laid.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")
