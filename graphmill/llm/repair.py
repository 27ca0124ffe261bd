"""Conversation structure repair: each turn is a 4x4 min-plus matrix, and a conversation is the product of its turns' matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.llm.storage import discard, stored

#: Initials that a role sequence may have, `(s?(ua)+)?` as an automaton: nothing yet, after s, after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, FINAL = 4, (0, 3)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
#: Turns whose matrices one row of the scan sums up, and rows that one step of the tree joins.
CHUNK, FAN = 4096, 16
#: Sequences of turns whose products a task remembers: the most turns of one, and how many.
MEMO_TURNS, MEMO_ENTRIES = 8, 20_000

Element = tuple[int, str]
Matrix = tuple[tuple[Element | None, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; an element is (cost, audit), the least wins and None is no path.

    Between two states over the same turns an audit decides its cost, and one that continues another costs more, so
    equal costs never meet an audit and its prefix: the order survives concatenation, and products are associative.
    """
    return tuple(tuple(min(((x[0] + y[0], x[1] + y[1]) for x, y in ((a[i][k], b[k][j]) for k in range(STATES)) if x and y), default=None) for j in range(STATES)) for i in range(STATES))


def matrix(cells: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(cells.get((i, j)) for j in range(STATES)) for i in range(STATES))


def closure() -> Matrix:
    """Any number of inserted turns: the star of one insertion."""
    one = {(i, i): (0, "") for i in range(STATES)} | {(i, j): (INSERT_COST, "I") for (i, role), j in STEPS.items() if role in ROLES}
    now = matrix(one)
    while (more := product(now, now)) != now:
        now = more
    return now


CLOSURE = closure()


def parts(mark: str) -> tuple[str, str]:
    """A turn as one character, `a` + 4 times its role's initial (0 to 2, 3 for any other) + its fault: back to both."""
    k = ord(mark) - ord("a")
    return (INITIALS + "?")[k // 4], FAULTS[k % 4]


def turn_matrix(mark: str) -> Matrix:
    """Insertions, then one edit of the turn."""
    initial, fault = parts(mark)
    more = TRUNCATED_COST * (fault == "truncated")
    cells: dict[tuple[int, int], Element] = {(i, i): (DELETE_COST, "D") for i in range(STATES)}
    if fault not in ("blank", "duplicate"):
        for (i, role), j in STEPS.items():
            if role == initial or role in ROLES:
                cells[i, j] = (more, "K") if role == initial else (REROLE_COST + more, "R")
    return product(CLOSURE, matrix(cells))


def scan(marks: str, memo: dict[str, Matrix]) -> Matrix:
    """Product of the matrices of one or more turns, as a balanced tree; memo keeps those of short sequences."""
    if marks in memo:
        return memo[marks]
    half = 1
    while half * 2 < len(marks):
        half *= 2
    found = turn_matrix(marks) if len(marks) == 1 else product(scan(marks[:half], memo), scan(marks[half:], memo))
    if len(marks) <= MEMO_TURNS and len(memo) < MEMO_ENTRIES:
        memo[marks] = found
    return found


def cheapest(whole: Matrix | None) -> Element:
    """Cost and audit of a conversation of that product; None is one without turns."""
    if whole is None:
        return 0, ""
    return min(e for e in (product(whole, CLOSURE)[0][j] for j in FINAL) if e)


def edits(audit: str, marks: str):
    """What becomes of each turn, one string a turn: initials of roles inserted before it, its edit (K kept, D deleted, U or A given that
    role), and after the last turn initials of roles inserted there. Where two roles are possible, the state decides."""
    state, k, before = 0, 0, ""
    end = len(audit.rstrip("I"))
    for at, letter in enumerate(audit[:end]):
        edit = letter
        if letter != "D":
            role = parts(marks[k])[0] if letter == "K" else "a" if state == 2 else "u"
            state = STEPS[state, role]
            edit = {"I": role, "R": role.upper()}.get(letter, letter)
        before += edit
        if letter != "I":
            after = ""
            if at == end - 1:
                for _ in audit[end:]:
                    after += "a" if state == 2 else "u"
                    state = STEPS[state, after[-1]]
            yield before + after
            before, k = "", k + 1


def flat(m: Matrix) -> dict[str, list]:
    cells = [e for row in m for e in row]
    return {"costs": [e and e[0] for e in cells], "audits": [e and e[1] for e in cells]}


def unflat(costs: list, audits: list) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return tuple(tuple(cells[i * STATES : (i + 1) * STATES]) for i in range(STATES))


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with their place `pos` in the order of conversation, turn, role and text, and their fault; stored.

    Dealt by range, so a long conversation spans partitions; ids of a partition grow by one, and partitions are in order.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    dealt = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("pos", F.monotonically_increasing_id()), "turns")
    seen = placed.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(said == "", 1).when(F.col("first").isNull(), 2).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    found = stored(placed.join(seen, "pos", "left").withColumn("fault", fault).drop("first"), "turns-marked")
    discard(placed)
    return found


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chunk_products(turns: DataFrame) -> DataFrame:
    """(conv, pos, marks, costs, audits): the product of up to CHUNK turns of a conversation whose places follow each other."""
    import pyarrow as pa

    def work(batches):
        now, first, after, marks, memo = None, None, None, [], {}

        def out(rows):
            convs, places, found = zip(*rows)
            cells = [flat(scan(m, memo)) for m in found]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(convs), pa.array(places, pa.int64()), pa.array(found), pa.array([c["costs"] for c in cells], pa.list_(pa.int64())), pa.array([c["audits"] for c in cells], pa.list_(pa.string()))],
                ["conv", "pos", "marks", "costs", "audits"],
            )

        for batch in batches:
            done = []
            for k, (conv, pos, mark) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "mark")))):
                if marks and (conv != now[0].as_py() or pos != after or len(marks) == CHUNK):
                    done.append((now, first, "".join(marks)))
                    marks = []
                if not marks:
                    now, first = batch.column("conv").slice(k, 1), pos
                marks.append(mark)
                after = pos + 1
            if done:
                yield out(done)
        if marks:
            yield out([(now, first, "".join(marks))])

    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    ordered = turns.select("conv", "pos", F.chr(4 * initial + F.col("fault") + ord("a")).alias("mark")).repartitionByRange(partitions(turns), "pos").sortWithinPartitions("pos")
    schema = T.StructType([T.StructField("conv", turns.schema["conv"].dataType), T.StructField("pos", T.LongType()), T.StructField("marks", T.StringType()), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))])
    return ordered.mapInArrow(work, schema)


def reduced(chunks: DataFrame) -> DataFrame:
    """(conv, costs, audits): the product of all chunks of a conversation. A step multiplies up to FAN neighbours; it is repeated
    for conversations that still have several products."""
    import pyarrow as pa

    def join(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "costs", "audits"))), key=lambda r: r[0])
        held = [unflat(costs, audits) for _, costs, audits in rows]
        while len(held) > 1:
            held = [product(*held[k : k + 2]) if k + 1 < len(held) else held[k] for k in range(0, len(held), 2)]
        cells = flat(held[0])
        return pa.table({"conv": table.column("conv").slice(0, 1), "pos": [rows[0][0]], "costs": pa.array([cells["costs"]], pa.list_(pa.int64())), "audits": pa.array([cells["audits"]], pa.list_(pa.string()))})

    now, alone = chunks.select("conv", "pos", "costs", "audits"), None
    while True:
        # A row stands for up to CHUNK turns, so even the longest conversation has few to number.
        of = Window.partitionBy("conv")
        numbered = stored(now.withColumn("step", F.floor((F.row_number().over(of.orderBy("pos")) - 1) / FAN)).withColumn("others", F.count("*").over(of) - 1), "products")
        single = numbered.filter("others = 0").select("conv", "costs", "audits")
        alone = alone.unionByName(single) if alone is not None else single
        many = numbered.filter("others > 0")
        if many.isEmpty():
            return alone
        now = many.groupBy("conv", "step").applyInArrow(join, chunks.select("conv", "pos", "costs", "audits").schema)


def walked(chunks: DataFrame, products: DataFrame) -> DataFrame:
    """Per conversation its counts of faults, cost and audit, and for each chunk what becomes of its turns: a string a turn, of
    inserted roles' initials and one of K, D, U and A (kept, deleted, now of user, now of assistant)."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "plans")}
            for held, costs, audits in zip(*(batch.column(c).to_pylist() for c in ("held", "costs", "audits"))):
                marks = "".join(c["marks"] for c in held)
                cost, audit = cheapest(unflat(costs, audits))
                faults, initials = [[parts(m)[k] for m in marks] for k in (1, 0)]
                for name in FAULTS[1:]:
                    out[name].append(faults.count(name))
                out["illegal"].append(sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])))
                out["cost"].append(cost)
                out["audit"].append(audit)
                steps = edits(audit, marks)
                out["plans"].append([{"pos": c["pos"], "plan": [next(steps) for _ in c["marks"]]} for c in held])
            kinds = {"audit": pa.string(), "plans": pa.list_(pa.struct([("pos", pa.int64()), ("plan", pa.list_(pa.string()))]))}
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["conv", *out])

    held = chunks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "marks"))).alias("held"))
    both = held.join(products.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    counts = [T.StructField(k, T.LongType()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
    plan = T.StructType([T.StructField("pos", T.LongType()), T.StructField("plan", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("conv", chunks.schema["conv"].dataType), *counts, T.StructField("audit", T.StringType()), T.StructField("plans", T.ArrayType(plan))])
    return both.mapInArrow(work, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns): the cheapest edits that give every conversation a role sequence `(s?(ua)+)?`, and the turns they leave.

    A turn is kept at no cost, gets the role user or assistant at 2, or is deleted at 3; turns without text of those roles are inserted
    at 2. Blank turns (nothing but white space) and duplicates (role and text seen earlier in the conversation) are deleted;
    a truncated turn (its last character that is no white space is none of .!?) that stays costs 1 more. A turn's first
    fault counts. Of equal costs the least audit (initials of the edits in order) is taken.

    Turns are taken by turn, nulls first, those of one turn by role and text. Each is a matrix over the four states of the
    sequence; neighbours are multiplied in chunks, then in a tree over the chunks of a conversation, so its turns may
    lie in any number of partitions. The audit of a conversation is one value, so it has to fit a row. Null role or text is one
    space, null turns make no gaps, a null conversation is one of its own, repeated rows are duplicates, an empty table gives empty
    results. Other columns are not read.

    report: conv, gaps, blank, duplicate, truncated, illegal (neighbours whose initials are none of su, ua, au), cost, audit.
    turns: conv, pos, step (order by both), role, text, edit (kept, reroled or inserted).
    """
    space = F.lit(" ")
    given = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    all_turns = marked(given)
    chunks = stored(chunk_products(all_turns), "chunks")
    found = stored(walked(chunks, reduced(chunks)), "walked")
    gaps = all_turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv", "of")
    report = found.drop("plans").join(gaps, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "gaps", *FAULTS[1:], "illegal", "cost", "audit")
    plans = found.select(F.explode("plans").alias("p")).select(F.col("p.pos").alias("first"), F.posexplode("p.plan").alias("k", "plan"))
    plans = plans.select((F.col("first") + F.col("k")).alias("pos"), "plan")
    steps = all_turns.join(plans, "pos").select("conv", "pos", "role", "text", F.posexplode(F.split("plan", "")).alias("step", "edit")).filter("edit not in ('D', '')")
    new = F.when(F.lower("edit") == "u", F.lit(ROLES["u"])).otherwise(F.lit(ROLES["a"]))
    kept, inserted = F.col("edit") == "K", F.col("edit").isin("u", "a")
    turns = steps.select(
        "conv", "pos", "step", F.when(kept, F.col("role")).otherwise(new).alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        F.when(kept, "kept").when(inserted, "inserted").otherwise("reroled").alias("edit"),
    )
    return report, turns


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): digest of the lines `role:text` of each conversation's turns. A conversation is hashed in
    order by one task, as SHA-256 can't be joined from parts, but streams through it."""
    import pyarrow as pa

    def work(batches):
        from hashlib import sha256

        now, digest = None, None
        for batch in batches:
            done = []
            for k, (conv, line) in enumerate(zip(batch.column("conv").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist())):
                if digest is None or conv != now[0].as_py():
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = batch.column("conv").slice(k, 1), sha256(line)
                else:
                    digest.update(b"\n" + line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c for c, _ in done]), pa.array([d for _, d in done])], ["conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([now, pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    lines = turns.select("conv", "pos", "step", F.concat("role", F.lit(":"), "text").alias("line")).repartition(partitions(turns), "conv").sortWithinPartitions("conv", "pos", "step")
    schema = T.StructType([T.StructField("conv", turns.schema["conv"].dataType), T.StructField("repaired_sha256", T.StringType())])
    return lines.select("conv", "line").mapInArrow(work, schema)
