"""Chat formatting of reply trees (operator 5).

Messages form trees by parent links. Iterative self-joins enumerate the
root-to-leaf paths: in round k each leaf, known with its ancestors fewer than
2**k links away, is joined with every message's ancestor 2**k links up, so a
tree of depth d takes log2(d) rounds; each round is written to the shared
folder. Branches of a tree are ranked by the sum of their messages' scores,
and each chosen path becomes one conversation.

The template writes ``<|start|>role<|text|>text<|end|>`` and a newline for
each turn. Inside roles and texts every backslash is doubled and every control
string gets a backslash after its first character, so none of them is left and
the inverse is unique. The loss mask lists the code points of assistant texts.

One conversation is one record; its path is gathered in one row, as its text
has to be.

Edge cases: a null text or role counts as empty; messages of a null
conversation form one of their own; a parent that doesn't exist makes a root;
messages on or under a cycle of parents become roots; of messages that repeat
an id in a conversation, the least by parent, role and text stands for all, and
a message without an id can't be placed and is left out; turns that tie are
ordered by role and text; empty tables give empty results; columns besides
those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerloom.llm.common import staged

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Control strings of this and of other common templates; "<|" covers all that begin so.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>")
LEARNED_ROLE = "assistant"

#: A backslash, or a character with which a control string begins here; control strings may overlap.
_ESCAPED = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]], learned: str = LEARNED_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of it to learn."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + TEXT, escape(text)
        if role == learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, dist) of all root-to-leaf paths of ``messages`` (conv, node, parent); node is unique inside conv; dist counts links up from the leaf."""
    nodes = messages.select("conv", "node", "parent")
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = nodes.join(known, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"))
    parents = links.where("up is not null").select("conv", F.col("up").alias("node")).distinct()
    # No path has more links than its conversation has messages.
    deepest = messages.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    links = staged(links, "links")
    jumps, step = links.where("up is not null"), 1
    reach = staged(links.join(parents, ["conv", "node"], "left_anti").select("conv", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist")), "paths")
    while step <= deepest and not jumps.isEmpty():
        more = reach.join(jumps, ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist"))
        reach = staged(reach.unionByName(more), "paths")
        ahead = jumps.select("conv", F.col("node").alias("up"), F.col("up").alias("further"))
        jumps = staged(jumps.join(ahead, ["conv", "up"]).select("conv", "node", F.col("further").alias("up")), "jumps")
        step *= 2
    if jumps.isEmpty():
        return reach
    # What still has an ancestor so far up is on or under a cycle.
    cyclic = jumps.select("conv", "node").distinct()
    alone = cyclic.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist"))
    return reach.join(cyclic, ["conv", "node"], "left_anti").select("conv", "leaf", "node", "dist").unionByName(alone)


def chosen_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Paths of the ``branches`` best-scored leaves of each tree (all if None), with score and rank."""
    found = paths(messages).join(messages.select("conv", "node", "score"), ["conv", "node"])
    best = found.groupBy("conv", "leaf").agg(F.sum("score").alias("score"), F.max_by("node", "dist").alias("root"))
    if branches is None:
        return found.select("conv", "leaf", "node", "dist").join(best.drop("root"), ["conv", "leaf"])
    rank = F.row_number().over(Window.partitionBy("conv", "root").orderBy(F.col("score").desc(), "leaf"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= branches).drop("root")
    return found.select("conv", "leaf", "node", "dist").join(best, ["conv", "leaf"])


def one_per_id(messages: DataFrame) -> DataFrame:
    """One message for each (conv, node) that isn't null."""
    least = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return messages.where("node is not null").groupBy("conv", "node").agg(least).select("conv", "node", "m.*")


def formatted(messages: DataFrame, branches: int | None = None, learned: str = LEARNED_ROLE, unique: bool = False) -> DataFrame:
    """(conv, leaf, score, text, mask) of each chosen path; ``messages`` has conv, node, parent, role, text and score. ``unique`` says that no id is null or repeated."""
    # As a struct, a null conversation equals itself in joins.
    messages = messages.select(F.struct("conv").alias("conv"), "node", "parent", "role", "text", "score")
    messages = messages if unique else one_per_id(messages)
    placed = chosen_paths(messages, branches)
    bodies = messages.select("conv", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("dist")).alias("at"), "role", "text")
    gathered = placed.join(bodies, ["conv", "node"]).groupBy("conv", "leaf").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    gathered = gathered.withColumn("conv", F.col("conv.conv"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()], learned) for turns in batch.column(3)]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            masks = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in made], span)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t for t, _ in made], pa.string()), masks], names=["conv", "leaf", "score", "text", "mask"])

    kinds = {f.name: f.dataType.simpleString() for f in gathered.schema}
    return gathered.mapInArrow(work, f"conv {kinds['conv']}, leaf {kinds['leaf']}, score {kinds['score']}, text string, mask array<struct<start long, end long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """What formatted conversations say when parsed again, and what is under their masks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                rows.append((len(turns), whole, len(learned), hashlib.sha256(learned.encode("utf-8")).hexdigest(), len(text)))
            parts = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]], names=names)

    kind = conversations.schema["conv"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return conversations.select("conv", "text", "mask").mapInArrow(work, schema)


def as_tree(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn replies to the one before it, scored by its characters."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return turns.select(F.col("conv_id").alias("conv"), at.alias("node"), "role", "text").select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """The best branch of every conversation, and of conversation -1 of control strings, formatted, stored and parsed again."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    messages = staged(as_tree(turns.unionByName(probe)), "messages")
    return digests(staged(formatted(messages, branches=1, unique=True), "chats"))
