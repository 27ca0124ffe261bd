"""Chat formatting: reply trees, their best branches, and one masked conversation per chosen branch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.storage import discard, stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MOST_DOUBLINGS = 40

# Inside a turn a backslash is doubled and `<|` gets one between its characters, so a control string never occurs in
# a text; in a role a line feed is written as a backslash and an n besides.
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(column: Column) -> Column:
    doubled = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escaped_role(column: Column) -> Column:
    return F.replace(escaped(column), F.lit("\n"), F.lit("\\n"))


def plain(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def plain_role(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parsed(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first and end character of the written text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        turns.append((plain_role(formatted[at + len(OPEN) : line]), plain(formatted[line + 1 : end]), line + 1, end))
        at = end + len(CLOSE) + 1
    return turns


def branches(messages: DataFrame, keep_branches: int = 1) -> DataFrame:
    """The chosen root-to-leaf paths of reply trees: (tree, branch, rank, node, depth), a row per message of a path.

    messages: tree, node, parent (null at a root) and score. A leaf is a node without replies. Iterative self-joins
    walk up from all leaves at once: round k joins what has been reached with the pointers to the ancestor 2^k above, and
    the pointers with themselves, so a tree of depth d takes log2(d) rounds. A path counts if it ends in a root;
    nodes on a loop or under a missing parent have none. Branches of a tree are ranked by the mean score of their
    messages (null counts as 0), then by length, longer first, then by the leaf's node; the best keep_branches stay (0: all).
    Nodes must be unique in their tree.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    inner = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    reached = stored(nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "reply-paths")
    jump = stored(nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("above")), "reply-jumps")
    total = nodes.count()
    for k in range(MOST_DOUBLINGS):
        if jump.isEmpty() or (1 << k) > total:
            break
        further = reached.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        reached, before = stored(reached.unionByName(further), "reply-paths"), reached
        discard(before)
        right = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump, before = stored(jump.join(right, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")), "reply-jumps"), jump
        discard(before)
    steps = reached.join(nodes, ["tree", "node"])
    whole = steps.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("length"), F.count_if(F.col("parent").isNull()).alias("roots"), F.max("up").alias("top"))
    whole = whole.filter("roots = 1 and length = top + 1")
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("length"), "leaf")
    chosen = whole.withColumn("rank", F.row_number().over(order))
    chosen = chosen.filter(F.col("rank") <= keep_branches) if keep_branches else chosen
    return reached.join(chosen.select("tree", "leaf", "rank", "top"), ["tree", "leaf"]).select("tree", F.col("leaf").alias("branch"), "rank", "node", (F.col("top") - F.col("up")).alias("depth"))


def format_chats(messages: DataFrame, keep_branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, rank, formatted, loss): one conversation per chosen branch of each reply tree.

    messages: tree, node, parent, score, role, text. A turn is written as <|im_start|>role, a line feed, the text,
    <|im_end|> and a line feed; texts and roles are escaped so that parsed() gives them back exactly. loss lists
    (first, end) characters of `formatted`, counted in code points, of every text of loss_role. Null role or text is empty; a tree without
    a root-to-leaf path has no row; an empty table gives none. Other columns are not read. A conversation is one row, so it
    has to fit a task.
    """
    paths = branches(messages, keep_branches)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, ["tree", "node"]).select(
        "tree", "branch", "rank", "depth", (F.col("role") == loss_role).alias("learned"),
        F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"),
    )
    tail = F.lit(CLOSE + "\n")
    # Places are running sums, so a conversation of any length takes one sort.
    placed = turns.withColumn("size", F.length("head") + F.length("body") + len(CLOSE) + 1)
    before = Window.partitionBy("tree", "branch", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first", (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")).cast("int"))
    span = F.struct("first", (F.col("first") + F.length("body")).alias("end"))
    gathered = placed.groupBy("tree", "branch", "rank").agg(
        F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", tail).alias("turn")))).alias("turns"), F.array_sort(F.collect_list(F.when(F.col("learned"), span))).alias("loss")
    )
    return gathered.select("tree", "branch", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss")


def chained(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of plain conversations as reply trees: each turn answers the one before it (ties go by role and text)."""
    order = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.select(F.col(tree).alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader finds in the formatted conversations and under their loss masks."""
    import pyarrow as pa

    def digests(batches):
        from hashlib import sha256

        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parsed(text)
                learned = "".join(plain(text[s["first"] : s["end"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(sha256("".join(f"{role}\n{said}\n" for role, said, _, _ in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            columns = {k: pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *columns.values()], ["tree", *columns])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss").mapInArrow(digests, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
