"""Quotation linking for conversations.

A line's level is its number of leading '>' marks, blanks between them allowed. Runs of lines of one level are passages; blank lines end them. A
passage is normalised (lower case, white space collapsed) and hashed to 128 bits; originals are indexed by the hash of each own passage of
level 0, and of each of its lines. A quoted passage, and else its first line, is joined to the latest earlier message of the same
conversation with that hash, else to a message of any other conversation. A message answers the one that its first linked
passage of the lowest level comes from, if that is in its conversation, else the message before it. Messages are then sorted over all partitions by
conversation and turn; a pass over each partition follows answers as far as it holds them, and pointer doubling joins the ends that lie in
other partitions, in logarithmically many rounds. position counts a conversation's messages so that every answer comes after what it answers, depth
is the number of answers up to the thread's root.

Null texts count as empty. Turns order a conversation; what is quoted comes from a strictly earlier turn. Messages that share conversation and turn
are ordered by a hash of conversation, turn, role and text; equal ones count as one and are returned as often as they came. A null
conversation is one of its own; null turns come first. An empty table gives an empty result; extra columns are ignored. A text is parsed
by one task in memory and time linear in its length; no conversation, thread, passage or line need fit into a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netglean.llm.asof import HEAD, OPEN, ROW, TAIL, latest_before
from netglean.llm.shared import forget, save

_MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_BLANK = " \t\r"
MESSAGE, ORIGINAL, QUOTE = range(3)
#: Rows that a task gathers before it sends them on.
FLUSH = 20_000


def lines(text: str) -> list[tuple[int, str]]:
    """Level and text, without marks and outer blanks, of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line) if ">" in line else None
        out.append((m[1].count(">"), line[m.end() :].strip(_BLANK)) if m else (0, line.strip(_BLANK)))
    return out


def passages(text: str) -> list[tuple[int, list[str]]]:
    """Level and lines of the maximal runs of lines of one level; blank lines end runs."""
    out, going = [], False
    for level, line in lines(text):
        if not line:
            going = False
        elif going and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
            going = True
    return out


def unquoted(text: str) -> str:
    """The text without its quoted lines."""
    return "\n".join(x for x in text.split("\n") if not (">" in x and _MARKS.match(x))).strip(_BLANK + "\n")


def passage_hash(text: str) -> bytes:
    return hashlib.md5(" ".join(text.lower().split()).encode(), usedforsecurity=False).digest()


def message_id(conv: int | None, turn: int | None, role: str | None, text: str) -> bytes:
    return hashlib.md5(f"{conv} {turn} {-1 if role is None else len(role)} {role} {text}".encode(), usedforsecurity=False).digest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each message, each distinct hash of its own passages and lines, and each quoted passage and its first line (try 1)."""
    names = ["what", "conv_id", "turn", "id", "role", "clean", "hash", "no", "level", "try"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows.clear()
        return out

    for b in batches:
        for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            me, clean = (conv, turn, message_id(conv, turn, role, text)), unquoted(text)
            rows.append((MESSAGE, *me, role, clean, None, None, None, None))
            own = set()
            for no, (level, ls) in enumerate(passages(text)):
                if not level:
                    own.update(map(passage_hash, ls))
                if len(ls) > 1 and not level:
                    own.add(passage_hash("\n".join(ls)))
                if level:
                    rows += [(QUOTE, *me, None, None, passage_hash(t), no, level, k) for k, t in enumerate(["\n".join(ls), ls[0]][: len(ls)])]
            rows += [(ORIGINAL, *me, None, None, h, None, None, None) for h in sorted(own)]
            size += len(clean)
            if len(rows) >= FLUSH or size >= 4_000_000:
                yield flush()
                size = 0
    if rows:
        yield flush()


def quoting(messages: DataFrame) -> DataFrame:
    """Messages in the form of mail, in three styles by turn: the whole message before, and above it the one before that as the second level;
    only the first line of the message before; the message but one before, with capitals and wider gaps."""
    df = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.xxhash64("role", "text")]
    one = latest_before(df, ["conv_id"], order, F.struct("text"), "one")
    two = latest_before(one, ["conv_id"], order, F.struct(F.col("one.text").alias("text")), "two")
    forget(one)
    mark = lambda c, m: F.regexp_replace(c, "(?m)^", m)
    first = F.substring_index("one.text", "\n", 1)
    loud = F.replace(F.translate("two.text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), F.lit("  "))
    style = F.coalesce(F.pmod("turn", F.lit(3)), F.lit(0))
    text = F.when(style == 0, F.concat_ws("\n", mark(F.col("two.text"), "> > "), mark(F.col("one.text"), "> "), "text")).when(style == 1, F.concat_ws("\n", mark(first, "> "), "text")).otherwise(F.concat_ws("\n", mark(loud, "> "), "text"))
    return two.select("conv_id", "turn", "role", text.alias("text"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by conversation and turn: each with the end of its chain of answers within the partition, and its number there.

    up is that end and dist the way to it. open: the end answers a message of another partition, or is itself one; where is OPEN for a
    message of the partition's first conversation, whose position and, without an answer, parent need what the partitions before hand on.
    """
    names = ["conv_id", "turn", "id", "n_quotes", "n_linked", "n_foreign", "parent_turn", "up", "up_turn", "dist", "open", "position", "_part", "_edge"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
    part = TaskContext.get().partitionId()
    conv, first, started, n = None, None, False, 0
    ends: dict[bytes, tuple[bytes, int | None, int, bool]] = {}
    last: tuple | None = None

    def mark(row: tuple, edge: int) -> tuple:
        return (*row, None, None, None, None, None, None, None, None, n, part, edge)

    for b in batches:
        rows = []
        for c, turn, me, quotes, linked, foreign, source in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "id", "n_quotes", "n_linked", "n_foreign", "source"))):
            if not started:
                conv, first, started = c, (c, turn, me), True
                rows.append(mark(first, HEAD))
            elif c != conv:
                conv, n, last = c, 0, None
                ends.clear()
            here = first[0] == c
            parent = (source["id"], source["turn"]) if source else last
            if parent is None:  # the conversation's first, or the partition's
                end = (me, turn, 0, here)
            elif parent[0] in ends:
                up, up_turn, dist, open_ = ends[parent[0]]
                end = (up, up_turn, dist + 1, open_)
            else:
                end = (parent[0], parent[1], 1, True)
            ends[me] = end
            rows.append((c, turn, me, quotes, linked, foreign, parent and parent[1], *end, n, part, OPEN if here else ROW))
            n, last = n + 1, (me, turn)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(mark((conv, last[1], last[0]), TAIL), kinds)], names)


def _threads(tree: DataFrame) -> DataFrame:
    """tree with parent_turn, root_turn, depth and position. tree: conv_id, turn, id, source (turn and id of the message it quotes, or null), and counts; one row for each id."""
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")]
    schema = "conv_id long, turn long, id binary, n_quotes long, n_linked long, n_foreign long, parent_turn long, up binary, up_turn long, dist long, open boolean, position long, _part int, _edge int"
    sent = save(tree.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_follow, schema), "threads")
    before = Window.partitionBy("conv_id").orderBy("_part", "_edge").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.col("_edge") == TAIL
    carry = sent.where(F.col("_edge") >= HEAD).select("_part", "_edge", F.last(F.when(tail, F.struct("turn", "id")), ignorenulls=True).over(before).alias("previous"), F.sum(F.when(tail, F.col("position"))).over(before).alias("n_before"))
    carry = carry.where((F.col("_edge") == HEAD) & F.col("previous").isNotNull()).select("_part", "previous", "n_before")
    df = sent.where(F.col("_edge") < HEAD).join(carry, "_part", "left")
    here, entry = F.col("_edge") == OPEN, F.col("open") & (F.col("dist") == 0)
    # an end within the partition's first conversation is a root if nothing comes before
    df = df.select(
        "_part", "conv_id", "turn", "id", "n_quotes", "n_linked", "n_foreign", F.when(here, F.coalesce("n_before", F.lit(0))).otherwise(0).alias("n_before"), "position",
        F.when(entry, F.col("previous.turn")).otherwise(F.col("parent_turn")).alias("parent_turn"),
        F.when(entry & F.col("previous").isNotNull(), F.col("previous.id")).otherwise(F.col("up")).alias("up"),
        F.when(entry & F.col("previous").isNotNull(), 1).otherwise(F.col("dist")).cast("long").alias("dist"),
        F.when(entry & F.col("previous").isNotNull(), F.col("previous.turn")).otherwise(F.col("up_turn")).alias("up_turn"), "open",
    )
    roots = df.where("dist = 0").select(F.col("id").alias("up"), F.lit(True).alias("is_root"))
    ends = df.where("open").select("_part", "up").distinct()
    ends = save(ends.join(roots, "up", "left").where("is_root IS NULL").select("_part", "up"), "ends")
    links = df.join(ends.select(F.col("up").alias("id")).distinct(), "id").select("id", "up", "up_turn", "dist").join(ends.select("up").distinct().withColumn("open", F.lit(True)), "up", "left")
    links = save(links.select("id", "up", "up_turn", "dist", F.coalesce("open", F.lit(False)).alias("open")), "links")
    while links.where("open").limit(1).count():
        above = links.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("up_turn").alias("turn2"), F.col("dist").alias("dist2"), F.col("open").alias("open2"))
        new = links.where("open").join(above, "up").select("id", F.col("up2").alias("up"), F.col("turn2").alias("up_turn"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("open2").alias("open"))
        new = save(links.where("NOT open").union(new), "links")
        forget(links)
        links = new
    # each partition gets its own ends, so that one end of very many messages isn't one task's
    own = ends.join(links.select(F.col("id").alias("up"), F.col("up_turn").alias("root_turn"), F.col("dist").alias("more")), "up")
    df = df.join(own, ["_part", "up"], "left")
    return df.select("id", "n_quotes", "n_linked", "n_foreign", "parent_turn", F.when(F.col("more").isNull(), F.col("up_turn")).otherwise(F.col("root_turn")).alias("root_turn"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("position") + F.col("n_before")).alias("position"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, clean (text without quotations), n_quotes, n_linked, n_foreign (linked to other conversations), parent_turn, root_turn, depth and position."""
    df = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = save(df.mapInArrow(_parse, "what int, conv_id long, turn long, id binary, role string, clean string, hash binary, no int, level int, try int"), "parsed")
    events = df.where(F.col("what") != MESSAGE).select("conv_id", "hash", "turn", "id", "no", "level", "try")
    order = [F.col("turn").asc_nulls_first(), F.col("try").isNull(), F.col("id")]  # a turn's quotations before its originals
    sources = latest_before(events, ["conv_id", "hash"], order, F.when(F.col("try").isNull(), F.struct("turn", "id")), "source")
    quotes = sources.where("try IS NOT NULL").select("conv_id", "turn", "id", "no", "level", "try", "hash", "source")
    anywhere = df.where(F.col("what") == ORIGINAL).groupBy("hash").agg(F.min(F.struct("conv_id")).alias("first"), F.max(F.struct("conv_id")).alias("last"))  # one of them is another conversation, if there is any
    other = F.col("first").isNotNull() & ~(F.col("first.conv_id").eqNullSafe(F.col("conv_id")) & F.col("last.conv_id").eqNullSafe(F.col("conv_id")))
    away = quotes.where("source IS NULL").join(anywhere, "hash", "left").select("conv_id", "turn", "id", "no", "level", "try", "source", other.alias("away"))
    quotes = quotes.where("source IS NOT NULL").select("conv_id", "turn", "id", "no", "level", "try", "source", F.lit(False).alias("away")).union(away)
    each = quotes.groupBy("conv_id", "turn", "id", "no").agg(F.min("level").alias("level"), F.min(F.when(F.col("source").isNotNull(), F.struct("try", "source"))).alias("s"), F.max("away").alias("away"))
    each = each.select("conv_id", "turn", "id", "no", "level", "s.source", "away")
    none = {c: F.lit(None).cast(each.schema[c].dataType) for c in ("no", "level", "source", "away")}
    each = each.union(df.where(F.col("what") == MESSAGE).select("conv_id", "turn", "id", *none.values()))
    tree = each.groupBy("conv_id", "turn", "id").agg(
        F.count("no").alias("n_quotes"), F.count("source").alias("n_linked"), F.count_if(F.col("source").isNull() & F.col("away")).alias("n_foreign"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", "no", "source"))).alias("best"),
    )
    threads = _threads(tree.select("conv_id", "turn", "id", "n_quotes", "n_linked", "n_foreign", "best.source"))
    own = df.where(F.col("what") == MESSAGE).select("conv_id", "turn", "role", "clean", "id")
    return own.join(threads, "id").select("conv_id", "turn", "role", "clean", "n_quotes", "n_linked", "n_foreign", "parent_turn", "root_turn", "depth", "position")


def conversations(linked: DataFrame, most: int = 1000) -> DataFrame:
    """link_quotations()'s messages as conversations in the order of replies: conv_id, part and messages (array of position, role, text, parent_turn and depth).

    A conversation of more than most messages is cut into parts of so many, so no task holds more. Equal messages share a position and stand there once.
    """
    df = linked.select("conv_id", F.floor(F.col("position") / most).alias("part"), F.struct("position", "role", F.col("clean").alias("text"), "parent_turn", "depth").alias("m"))
    return df.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("m")).alias("messages"))
