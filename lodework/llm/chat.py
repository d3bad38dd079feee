"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by their parents. Iterative self-joins with doubling jumps (a node's ancestor at distance 1, 2,
4, ...) give each node its depth and the sum of the scores from its root, so a tree of depth d takes log2(d) joins.
Each conversation's leaves are ranked by the mean score of their branch, ties to the smaller leaf; the stored jumps
then enumerate the chosen root-to-leaf paths, and each is formatted as one conversation.

Template: `[INST] text [/INST]` for a user, `<s> text </s>` for an assistant, and `<<SYS>>role`, a line end,
`text<</SYS>>` for any other role. A control string inside a text gets one more backslash after its opening
brackets, and loses it when read back, so any text comes back as it was and none is mistaken for the template.
The loss mask covers each assistant's text: spans in bytes of the formatted text's UTF-8.

Nulls and edge cases: a null text or role is empty; a null conversation id is a conversation of its own; a message
whose parent isn't there is a root; messages in a cycle of parents, or below one, are on no path and left out. Rows
that tie in order (or are equal) all stay, in the order of their role and text. Long conversations are put
together in runs of RUN messages. An empty table gives no row. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

RUN = 256
_REST = r"(/?SYS>>|/?s>|/?INST\])"
_ENDS = r"\[/INST\]|</s>|<</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<<|<|\[)(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<<|<|\[)\\(\\*)" + _REST, "$1$2$3")


def _line(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unline(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turn_text(role: Column, text: Column) -> Column:
    """One message in the template."""
    said = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), said, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), said, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), escape(_line(role)), F.lit("\n"), said, F.lit("<</SYS>>")))
    )


def read_turns(formatted: Column) -> Column:
    """The messages of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, _ENDS, -1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p.substr(F.lit(8), F.length(p)), "\n", 1)
        return (
            F.when(p.startswith("[INST] "), F.struct(F.lit("user").alias("role"), unescape(p.substr(F.lit(8), F.length(p) - 8)).alias("text")))
            .when(p.startswith("<s> "), F.struct(F.lit("assistant").alias("role"), unescape(p.substr(F.lit(5), F.length(p) - 5)).alias("text")))
            .otherwise(F.struct(_unline(unescape(head)).alias("role"), unescape(p.substr(F.length(head) + 9, F.length(p))).alias("text")))
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order."""
    raw = formatted.cast("binary")
    return F.transform(spans, lambda s: unescape(F.substring(raw, s["start"] + 1, s["length"]).cast("string")))


def choose_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(conv, path, depth, node) of the best `paths` branches of each conversation.

    nodes: conv, node, parent (null at a root), score; (conv, node) is unique and conv not null."""
    scratch = Scratch(nodes.sparkSession, "chat")
    base = scratch.write(nodes.select("conv", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    there = base.select("conv", F.col("node").alias("up"))
    # A jump leads from a node to its ancestor at distance 2**k; sum and depth cover what lies between.
    jump = scratch.write(
        base.withColumn("to", F.col("parent")).join(there.withColumn("to", F.col("up")), ["conv", "to"], "left").select("conv", "node", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), "score")
    )
    total = base.count()
    levels = [jump]
    while jump.where("up IS NOT NULL").limit(1).count() and (1 << (len(levels) - 1)) <= total:
        to = jump.select("conv", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("also"))
        # Nodes that have reached their root wait aside, so short trees cost no join while long ones go on.
        moved = jump.where("up IS NOT NULL").join(to, ["conv", "up"]).select("conv", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("also")).alias("score"))
        jump = scratch.write(jump.where("up IS NULL").unionByName(moved))
        levels.append(jump)
    parents = base.where("parent IS NOT NULL").select("conv", F.col("parent").alias("node"))
    leaves = jump.where("up IS NULL").join(parents, ["conv", "node"], "left_anti")
    best = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("score") / (F.col("depth") + 1)), "node"))
    chosen = scratch.write(leaves.withColumn("path", best).where(F.col("path") <= paths).select("conv", "path", "node", "depth"))
    for k in range(len(levels) - 2, -1, -1):
        step = levels[k].where("up IS NOT NULL").select("conv", "node", "up")
        above = chosen.join(step, ["conv", "node"]).select("conv", "path", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        new = scratch.write(chosen.unionByName(above))
        scratch.drop(chosen)
        chosen = new
    return chosen


def format_paths(messages: DataFrame) -> DataFrame:
    """messages: conv, path, depth, role, text. A row for each (conv, path): n_turns, formatted, loss_spans."""
    turn = turn_text(F.col("role"), F.col("text"))
    rows = messages.select("conv", "path", "depth", (F.col("role") == "assistant").alias("loss"), turn.alias("said"))
    first = (
        rows.groupBy("conv", "path", F.floor(F.col("depth") / RUN).alias("run"))
        .agg(F.array_sort(F.collect_list(F.struct("depth", "loss", "said"))).alias("turns"))
        .select("conv", "path", "run", F.size("turns").alias("n"), F.array_join("turns.said", "").alias("said"), _spans(F.col("turns")).alias("spans"))
    )
    whole = first.groupBy("conv", "path").agg(F.array_sort(F.collect_list(F.struct("run", "n", "said", "spans"))).alias("runs"))
    begun = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts")),
        lambda acc, r: F.struct((acc["at"] + F.octet_length(r["said"])).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
    )["starts"]
    moved = F.flatten(F.zip_with("runs", begun, lambda r, at: F.transform(r["spans"], lambda s: F.struct((s["start"] + at).cast("int").alias("start"), s["length"].alias("length")))))
    return whole.select(
        "conv", "path", F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["n"]).alias("n_turns"), F.array_join("runs.said", "").alias("formatted"), moved.alias("loss_spans")
    )


def _spans(turns: Column) -> Column:
    """Where in its run each assistant's text stands, between `<s> ` and ` </s>`."""
    kind = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        size = F.octet_length(t["said"])
        span = F.array(F.struct((acc["at"] + 4).alias("start"), (size - 9).alias("length"))).cast(kind)
        return F.struct((acc["at"] + size).alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `node`, their place in the order of all columns given, from 0: range partitions and their sizes, so that
    no key's rows need meet in one task."""
    scratch = Scratch(rows.sparkSession, "order")
    placed = scratch.write(
        rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = dict(placed.groupBy(part.alias("p")).agg(F.count("*")).collect())
    before, so_far = {}, 0
    for p in sorted(sizes):
        before[p] = so_far
        so_far += sizes[p]
    if not sizes:
        return placed.withColumn("node", F.col("_at")).drop("_at")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
    return placed.withColumn("node", offset + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def format_turns(turns: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text): each message answers the one before it."""
    known = F.col("conv_id").isNotNull()
    rows = turns.select(
        "conv_id",
        F.concat(F.when(known, "1").otherwise("0"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    nodes = numbered(rows, "conv", "turn", "role", "text")
    paths = choose_paths(nodes.select("conv", "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score")))
    said = format_paths(paths.join(nodes.select("conv", "node", "role", "text"), ["conv", "node"]))
    ident = F.when(F.substring("conv", 1, 1) == "1", F.expr("substring(conv, 2)")).cast(turns.schema["conv_id"].dataType)
    return said.select(ident.alias("conv_id"), "n_turns", "formatted", "loss_spans")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    done = format_turns(turns.unionByName(extra))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_chat_formatting": op1}
ORACLE = {
    "op1_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(<<|<|\[)(\\*)(/?SYS>>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END) AS formatted FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM g"""
}
