"""Repair of conversations by generalised LR parsing: the cheapest edits that make the roles fit a grammar."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import SPACE
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BITS = 12   # a conversation is parsed in blocks of at most this power of two rows
REMEMBERED = 4096   # blocks whose tables a task keeps; most conversations are short and alike
HEAD = 64         # leading characters of a text that a splitter holds
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # fixed values: what the edits cost

# The grammar S -> (nothing) | B | s B, B -> u a | B u a, as an LR automaton over the initials of roles: where a state
# goes on a terminal or on B, how many symbols it reduces to B, and where a parse may end.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (0, "B"): 3, (1, "u"): 2, (1, "B"): 4, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
ENDS = (0, 3, 4)


def advance(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack behind a terminal and all reductions that follow it; None where the automaton has no action."""
    state = SHIFT.get((stack[-1], symbol))
    if state is None:
        return None
    stack = (*stack, state)
    while stack[-1] in REDUCE:
        below = stack[:-REDUCE[stack[-1]]]
        stack = (*below, SHIFT[below[-1], "B"])
    return stack


def _stack_tops() -> dict[int, dict[str, int]]:
    """For each state that may be on top between rows, the top that a terminal leads to.

    The stacks below equal tops take the same continuations, so the first stack found stands for all of them and
    equal tops are merged.
    """
    stacks, tops = [(0,)], {}
    while stacks:
        stack = stacks.pop()
        if stack[-1] not in tops:
            after = {c: advance(stack, c) for c in "sua"}
            tops[stack[-1]] = {c: s[-1] for c, s in after.items() if s}
            stacks.extend(s for s in after.values() if s)
    return tops


TOPS = _stack_tops()
PLACES = sorted(TOPS)

# A row is one character: its role's initial (other initials fit no rule) and its fault.
FAULTS = ("fine", "blank", "duplicate", "truncated")
CODES = {(initial, fault): chr(ord("A") + 4 * i + f) for i, initial in enumerate("sua?") for f, fault in enumerate(FAULTS)}
ROW_OF = {code: row for row, code in CODES.items()}
INITIAL_OF = {code: row[0] for code, row in ROW_OF.items()}
LEGAL = ("su", "ua", "au")


def _closed(tops: dict) -> dict:
    """Adds the tops that inserted rows lead to. A top has its cost, its node at the row before, and the inserts since.

    Of two ways to one top the cheaper stays, of equals that with the smaller audit. No audit at a row begins another
    one of equal cost, so the order of the nodes decides; the same node would have another cost.
    """
    found = {top: (cost, rank, 0) for top, (cost, rank) in tops.items()}
    grown = dict(found)
    while grown:
        fresh = {}
        for top, (cost, rank, inserts) in grown.items():
            for symbol in ROLES:
                to = TOPS[top].get(symbol)
                way = (cost + INSERT, rank, inserts + 1)
                if to is not None and (to not in found or way[:2] < found[to][:2]):
                    found[to] = fresh[to] = way
        grown = fresh
    return found


def _step(tops: dict, code: str) -> dict:
    """All actions on a row: ``{top: (cost, rank, letters, node before)}``, equal tops merged by the minimum."""
    initial, fault = ROW_OF[code]
    kept = TRUNCATED if fault == "truncated" else 0
    merged: dict = {}

    def offer(top, cost, rank, letters):
        way = (cost, rank, letters)
        if top not in merged or way < merged[top]:
            merged[top] = way

    for top, (cost, rank, inserts) in _closed(tops).items():
        before = "I" * inserts
        offer(top, cost + DELETE, rank, before + "D")
        if fault in ("fine", "truncated"):
            after = TOPS[top]
            if initial in after:
                offer(after[initial], cost + kept + KEEP, rank, before + "K")
            for symbol in ROLES:
                if symbol in after:
                    offer(after[symbol], cost + kept + REROLE, rank, before + "R")
    return merged


def parse_block(codes: str, start: int) -> dict[int, tuple[int, int, str]]:
    """For each top that the rows may lead to from ``start``: the least cost, the place of its audit among the tops'
    audits in order, and the audit.

    The stack is a graph: each row has one node per top with a link to the node before it. Costs and the order of the
    audits are kept, audits are read along the links in the end.
    """
    tops, links = {start: (0, 0)}, []
    for code in codes:
        merged = _step(tops, code)
        origin = {rank: top for top, (_, rank) in tops.items()}
        order = sorted(merged, key=lambda top: merged[top][1:])
        links.append({top: (origin[merged[top][1]], merged[top][2]) for top in merged})
        tops = {top: (merged[top][0], rank) for rank, top in enumerate(order)}
    found = {}
    for top, (cost, rank) in tops.items():
        at, letters = top, []
        for link in reversed(links):
            at, edit = link[at]
            letters.append(edit)
        found[top] = (cost, rank, "".join(reversed(letters)))
    return found


def fold_blocks(blocks: list[dict]) -> tuple[int, list[tuple[int, int]], int]:
    """The least cost of a conversation, the tops at which each block is entered and left, and the inserts behind it.

    ``blocks`` hold, by the top at which a block is entered, costs and places of audits by the top at which it is left.
    """
    tops, links = {0: (0, 0)}, []
    for table in blocks:
        merged: dict = {}
        for top, (cost, rank) in tops.items():
            for to, (more, place) in table[top].items():
                way = (cost + more, rank, place, top)
                if to not in merged or way < merged[to]:
                    merged[to] = way
        order = sorted(merged, key=lambda to: merged[to][1:3])
        links.append({to: way[3] for to, way in merged.items()})
        tops = {to: (merged[to][0], rank) for rank, to in enumerate(order)}
    closed = _closed(tops)
    cost, rank, inserts, _ = min((*closed[top], top) for top in ENDS if top in closed)
    at = next(top for top, (_, r) in tops.items() if r == rank)
    ways = []
    for link in reversed(links):
        ways.append((link[at], at))
        at = link[at]
    return cost, ways[::-1], inserts


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``lost`` of conversations with errors put in by crc32 of
    ``conv_id:turn`` modulo 20.

    0 loses the row, 1 empties its text, 2 takes its ``[.!?]`` out, 3 repeats it, 4 makes its role user. Nulls of the
    role, of the text and within the key count as one space. Lost rows stay as marks, so that no conversation vanishes.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def in_order(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows with ``conversation``, ``turn``, ``role``, ``text``, ``lost`` and ``at``, their place in the order of all rows.

    The order is by conversation, turn (null first), role and text; texts that share their first 64 characters follow
    each other by hash. Splitters cut a conversation of any length, and rows that are equal in everything too.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conversation).alias("conversation"), F.col(order).cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.col("lost") if "lost" in turns.columns else F.lit(False).alias("lost"))
    by = ["conversation", "turn", "role", F.substring("text", 1, HEAD), F.xxhash64("text")]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, *by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    ordered = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("digest", F.sha2("text", 256))
    return materialise(ordered, "conversation-rows")


def coded_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of at most 4,096 rows of one conversation: ``conversation``, ``first``, ``codes`` and what is known of the turns.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text stood in an earlier row of
    the conversation), truncated (its last character other than white space is not one of ``.!?``).
    """
    present = rows.filter(~F.col("lost"))
    repeated = (
        present.groupBy("conversation", "role", "digest").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(F.col("conversation").alias("_conversation"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first")
    )
    repeated = materialise(repeated, "repeated-rows")
    solid = F.col("text").rlike(rf"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    narrow = rows.select("conversation", "turn", "role", "digest", "lost", "at", solid.alias("solid"), ended.alias("ended"))
    met = narrow.join(repeated, (
        narrow["conversation"].eqNullSafe(repeated["_conversation"]) & (narrow["role"] == repeated["_role"]) & (narrow["digest"] == repeated["_digest"])), "left")
    fault = (
        F.when(~F.col("solid"), F.lit(1)).when(F.col("at") > F.col("_first"), F.lit(2)).when(~F.col("ended"), F.lit(3)).otherwise(F.lit(0)))
    initial = F.position(F.substring("role", 1, 1), F.lit("sua")) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), F.lit(3)).otherwise(initial)
    code = F.when(F.col("lost"), F.lit("")).otherwise(F.char(F.lit(ord("A")) + 4 * initial + fault))
    row = F.struct("at", code.alias("code"))
    turn = F.when(~F.col("lost"), F.col("turn"))
    blocks = met.groupBy("conversation", F.shiftright("at", BLOCK_BITS).alias("_block")).agg(
        F.min("at").alias("first"), F.array_sort(F.collect_list(row)).alias("_rows"),
        F.min(turn).alias("least_turn"), F.max(turn).alias("last_turn"), F.size(F.collect_set(turn)).cast("long").alias("turns"))
    return materialise(
        blocks.withColumn("codes", F.array_join(F.transform("_rows", lambda r: r["code"]), "")).drop("_rows", "_block"), "conversation-blocks")


def _illegal(codes: str) -> int:
    initials = "".join(INITIAL_OF[c] for c in codes)
    return sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))


def _block_tables(batches):
    """Costs and places of audits of each block, from every top it may be entered at; -1 marks tops not reached."""
    memo: dict[str, list[int]] = {}
    for batch in batches:
        tables = []
        for codes in batch.column("codes").to_pylist():
            if codes not in memo:
                table = np.full((len(PLACES), len(PLACES), 2), -1, dtype=np.int64)
                for i, start in enumerate(PLACES):
                    for top, (cost, rank, _) in parse_block(codes, start).items():
                        table[i, PLACES.index(top)] = cost, rank
                if len(memo) > REMEMBERED:
                    memo.clear()
                memo[codes] = table.ravel().tolist()
            tables.append(memo[codes])
        codes = batch.column("codes").to_pylist()
        columns = {name: batch.column(name) for name in ("conversation", "first", "least_turn", "last_turn", "turns")}
        columns["illegal"] = pa.array([_illegal(c) for c in codes], pa.int64())
        columns["head"] = pa.array([c[:1] for c in codes], pa.string())
        columns["tail"] = pa.array([c[-1:] for c in codes], pa.string())
        columns["table"] = pa.array(tables, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _table_of(numbers: list[int]) -> dict:
    table = np.array(numbers, dtype=np.int64).reshape(len(PLACES), len(PLACES), 2).tolist()
    return {top: {to: tuple(cell) for to, cell in zip(PLACES, line) if cell[0] >= 0} for top, line in zip(PLACES, table)}


def _paths(batches):
    """Folds the blocks of each conversation, sorted by conversation and place; one row per block.

    Of a conversation only costs and links of its blocks are held.
    """
    fields = ["first", "enter", "leave", "inserts", "cost", "illegal", "gaps"]
    open_key, held = None, []

    def closed():
        cost, ways, inserts = fold_blocks([_table_of(h["table"]) for h in held])
        code, seen, turns, least, illegal = "", None, 0, None, 0
        for h in held:
            illegal += h["illegal"]
            if code and h["head"]:
                illegal += INITIAL_OF[code] + INITIAL_OF[h["head"]] not in LEGAL
            code = h["tail"] or code
            if h["turns"]:
                turns += h["turns"] - (seen is not None and seen == h["least_turn"])
                least, seen = h["least_turn"] if least is None else least, h["last_turn"]
        gaps = seen - least + 1 - turns if turns else 0
        rows = []
        for i, (h, (enter, leave)) in enumerate(zip(held, ways)):
            rows.append((h["first"], enter, leave, inserts if i == len(held) - 1 else 0, *((cost, illegal, gaps) if i == 0 else (0, 0, 0))))
        return rows

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=fields)

    started = False
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if held and row["conversation"] != open_key:
                done.extend(closed())
                held = []
            open_key, started = row["conversation"], True
            held.append(row)
        if done:
            yield batch_of(done)
    if started and held:
        yield batch_of(closed())


def _letters(batches):
    """The audit of each block between the tops that its conversation's path takes."""
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("codes", "enter", "leave")])
        letters = [parse_block(codes, enter)[leave][2] for codes, enter, leave in rows]
        names = ["conversation", "first", "inserts", "cost", "illegal", "gaps"]
        faults = [[sum(ROW_OF[c][1] == f for c in codes) for codes in batch.column("codes").to_pylist()] for f in FAULTS[1:]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(letters, pa.string())] + [pa.array(f, pa.int64()) for f in faults],
            names=[*names, "letters", *FAULTS[1:]])


def parsed(rows: DataFrame) -> DataFrame:
    """``conversation``, ``first``, ``letters`` (the audit of a block), ``inserts`` (behind a conversation's last
    row), ``cost``, ``illegal``, ``gaps`` and faults per block.

    Blocks are parsed wherever they lie, from every state they may be entered in; the fold of a conversation then meets
    a small table per block.
    """
    blocks = coded_blocks(rows)
    kind = blocks.schema["conversation"].dataType.simpleString()
    tables = blocks.mapInArrow(
        _block_tables, f"conversation {kind}, first long, least_turn long, last_turn long, turns long, illegal long, head string, tail string, table array<long>")
    paths = tables.repartition("conversation").sortWithinPartitions("conversation", "first").mapInArrow(
        _paths, "first long, enter long, leave long, inserts long, cost long, illegal long, gaps long")
    faults = ", ".join(f"{f} long" for f in FAULTS[1:])
    return materialise(blocks.join(paths, "first").mapInArrow(
        _letters, f"conversation {kind}, first long, inserts long, cost long, illegal long, gaps long, letters string, {faults}"), "conversation-audits")


def _edited(batches):
    """Applies audits to the rows of each conversation in order; a block's audit comes before its rows, the inserts behind
    all rows come last."""
    open_key, started, top, place, letters = None, False, 0, 0, ""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not started or row["conversation"] != open_key:
                open_key, started, top, place, letters = row["conversation"], True, 0, 0, ""
            if row["kind"] == 0:
                letters, used = row["letters"], 0
                continue
            if row["kind"] == 2:
                letters, used = row["letters"], 0
            while used < len(letters):
                letter = letters[used]
                used += 1
                if letter != "D":
                    symbol = row["role"][:1] if letter == "K" else next(c for c in ROLES if c in TOPS[top])
                    top = TOPS[top][symbol]
                    out.append((row["conversation"], place, letter, row["role"] if letter == "K" else ROLES[symbol], "" if letter == "I" else row["text"]))
                    place += 1
                if letter != "I":
                    break
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("conversation").type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]],
                names=["conversation", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``conversation``, ``place``, ``edit``, ``role`` and ``text``, deleted rows left out.

    Rows lie in order, each conversation in one task, through which they stream.
    """
    none = F.lit(None).cast("string")
    texts = rows.filter(~F.col("lost")).select("conversation", "at", F.lit(1).alias("kind"), none.alias("letters"), "role", "text")
    heads = audits.select("conversation", F.col("first").alias("at"), F.lit(0).alias("kind"), "letters", none.alias("role"), none.alias("text"))
    tails = audits.filter("inserts > 0").select(
        "conversation", F.lit((1 << 63) - 1).alias("at"), F.lit(2).alias("kind"),
        F.repeat(F.lit("I"), F.col("inserts").cast("int")).alias("letters"), none.alias("role"), none.alias("text"))
    kind = rows.schema["conversation"].dataType.simpleString()
    stream = heads.unionByName(texts).unionByName(tails).repartition("conversation").sortWithinPartitions("conversation", "at", "kind")
    return stream.mapInArrow(_edited, f"conversation {kind}, place long, edit string, role string, text string")


def _digests(batches):
    open_key, digest = None, None

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([open_key], kind), pa.array([digest.hexdigest()])], names=["conversation", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conversation").type
        keys, roles, texts = (batch.column(c).to_pylist() for c in ("conversation", "role", "text"))
        for key, role, text in zip(keys, roles, texts):
            if digest is None or key != open_key:
                if digest is not None:
                    yield closed()
                open_key, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield closed()


def text_digests(in_place: DataFrame) -> DataFrame:
    """``conversation`` and ``repaired_sha256`` of the ``role:text`` lines of rows that lie in order, as ``repaired`` gives them."""
    kind = in_place.schema["conversation"].dataType.simpleString()
    return in_place.mapInArrow(_digests, f"conversation {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """The repaired rows and one row per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost`` and ``audit``.

    Roles must read ``(s?(ua)+)?`` by their initials. Keep costs 0, rerole to user or assistant 1, delete 2, insert a row
    without text 5; blank and repeated rows must go, a truncated row that stays costs 5. Of the cheapest repairs the one
    whose audit, the initials of its edits in order, comes first is taken. Null roles and texts count as one space, null
    conversations are one conversation, null turns come first and count in no gap. Rows marked ``lost`` count nowhere, but
    their conversation gets its row. An empty table gives none.

    A generalised LR parser reads the rows: the tops of a graph-structured stack take every action, and equal tops merge
    by the least (cost, audit). Conversations of any length are parsed in blocks on any executor and folded by small
    tables; only the audit and the repaired text, which are single values, pass through one task.
    """
    rows = in_order(turns, conversation, order)
    audits = parsed(rows)
    summed = audits.groupBy("conversation").agg(
        *[F.sum(c).alias(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat("letters", F.repeat(F.lit("I"), F.col("inserts").cast("int"))).alias("letters")))), lambda b: b["letters"]), "").alias("audit"))
    return repaired(rows, audits), summed
