"""Operator 8: chat formatting of reply trees.

Messages form trees: each has an id and its parent's. Pointer doubling, one self-join a round, finds every
message's depth and score total along its path to the root; as many rounds as the logarithm of the depth.
The leaves of a tree are ranked by the mean score of their paths, then by id, and the paths of the best
``branches`` are laid out, again by doubling. Each path becomes one conversation: its turns between marks, and
the spans of the assistant's texts as the loss mask.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline. In texts a ``<`` followed by backslashes and a
``|`` gets one backslash more, so no text holds a control string; in roles a backslash and a newline are
escaped as well. Both are reversed when the output is read back.

Scale: the joins carry ids, parents and scores only, spread by a hash of (tree, id); texts meet their paths
once, at the end. One path is one row, as its formatted text is; a tree with many paths is many rows.

Defined cases: null text and null role are empty; a null tree id is a tree of its own; a message whose
parent is unknown is a root; messages in a circle hang on no root and are left out (the number of
messages ends the rounds); of messages with one (tree, id) each is a node only once, the least by role and text. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescope.llm.bpe import in_batches
from lakescope.llm.shared import frozen, ranked

# The marks of the template, and the role whose texts are learned.
START, END, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"((?:[^\n\\]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted text, and the loss mask as a flat list of starts and ends in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED:
            spans += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def linear_tree(rows: DataFrame, tree: str, order: str) -> DataFrame:
    """Messages that follow one another by ``order`` as a tree with one path: tree, id, parent, role, text."""
    r = ranked(rows.select(F.col(tree).alias("tree"), F.col(order).alias("turn"), "role", "text"), [F.col("tree"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")], "id")
    # the row before it is its parent; that of a tree's first row is in another tree and so unknown
    return r.select("tree", F.col("id").cast("long").alias("id"), "role", "text", (F.col("id") - 1).cast("long").alias("parent"), F.lit(0.0).alias("score"))


def _key(tree: Column, node: Column) -> Column:
    """A join key that is never null."""
    return F.struct(F.coalesce(tree.cast("string"), F.lit("")).alias("t"), tree.isNull().alias("z"), node.alias("n"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, leaf, depth, id): the messages of the best ``branches`` paths of each tree, root at depth 0.

    ``messages``: tree, id, parent, score."""
    m = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.withColumn("k", _key(F.col("tree"), F.col("id"))).withColumn("up", F.when(F.col("parent").isNotNull(), _key(F.col("tree"), F.col("parent"))))
    known = m.select(F.col("k").alias("up"), F.lit(True).alias("there"))
    m = m.join(known, "up", "left").withColumn("up", F.when(F.col("there"), F.col("up"))).drop("there")
    # to: the ancestor 2**round steps up; steps and total: of the path below it
    jump = frozen(m.select("tree", "id", "k", F.col("up").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")))
    jumps, reach = [jump.select("k", "to").filter("to is not null")], 1
    n = jump.count()  # no path is longer; what is unresolved then is a circle
    while reach < n and not jump.filter("to is not null").isEmpty():
        upper = jump.select(F.col("k").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        jump = frozen(jump.join(upper, "to", "left").select(
            "tree", "id", "k", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total")))
        jumps.append(jump.select("k", "to").filter("to is not null"))
        reach *= 2
    inner = m.filter("up is not null").select(F.col("up").alias("k")).distinct()
    leaves = jump.filter("to is null").join(inner, "k", "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("steps")).desc(), F.col("id"))
    leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    laid = frozen(leaves.select("tree", "rank", F.col("id").alias("leaf"), (F.col("steps") - 1).alias("depth"), "k"))
    for k, step in enumerate(jumps):
        more = laid.join(step, "k").select("tree", "rank", "leaf", (F.col("depth") - (1 << k)).alias("depth"), F.col("to").alias("k"))
        laid = frozen(laid.unionByName(more))
    return laid.select("tree", "rank", "leaf", "depth", F.col("k.n").alias("id"))


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, rank, formatted, spans): one formatted conversation for each chosen path.

    ``messages``: tree, id, parent, role, text, score."""
    one = messages.groupBy("tree", "id").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "id", "m.*")
    m = frozen(one)
    p = paths(m.select("tree", "id", "parent", "score"), branches)
    of = m.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = p.join(of, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")))
    whole = turns.groupBy("tree", "rank").agg(F.collect_list(F.struct("depth", "role", "text")).alias("turns"))
    out = pa.schema([("tree", pa.int64()), ("rank", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for batch in batches:
                for tree, rank, ts in zip(*(batch.column(k) for k in range(3)), strict=True):
                    ordered = sorted(ts.as_py(), key=lambda t: t["depth"])
                    yield tree.as_py(), rank.as_py(), *format_turns([(t["role"], t["text"]) for t in ordered])

        yield from in_batches(rows(), out, lambda r: len(r[2]) + 64)

    return whole.select("tree", "rank", "turns").mapInArrow(run, "tree long, rank int, formatted string, spans array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back: conv_id, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    out = pa.schema([("conv_id", pa.int64()), ("rank", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for tree, rank, text, spans in zip(*(batch.column(k) for k in range(4)), strict=True):
                    f, s = text.as_py(), spans.as_py()
                    turns = parse_turns(f)
                    all_turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                    for role, body in turns:
                        all_turns.update(f"{role}\n{body}\n".encode())
                    for a, b in zip(s[::2], s[1::2], strict=True):
                        learned = unescape(f[a:b])
                        loss.update(learned.encode())
                        chars += len(learned)
                    yield tree.as_py(), rank.as_py(), len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(f)

        yield from in_batches(rows(), out, lambda r: 256)

    return formatted.select("tree", "rank", "formatted", "spans").mapInArrow(
        run, "conv_id long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
