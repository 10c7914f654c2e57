"""Chat formatting: reply trees, their branches, and each chosen branch as one conversation.

Messages name the message they reply to. Self-joins that double their reach in each round give every
message its depth and the score from its root on, so a chain of any length takes as many rounds as its
length has bits. Leaves are ranked by the mean score of their branch; the joins of the rounds, walked back
from the widest one, list the messages of each chosen branch once. Only narrow rows take part in this; texts join at
the end, are escaped and put together by parts of a branch, with the places that a loss mask covers.

A turn is `### role`, a line break, the text, `</turn>` and a line break. Inside texts and roles a backslash
is doubled, `##` becomes `#\\#` and `</` becomes `<\\/`, so neither control string occurs there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.registry import query, table
from logloom.session import hint_small, numbered, stored

HEAD, END = "### ", "</turn>\n"
LEARNED = "assistant"  # the role whose texts the loss mask covers
TURNS = 128  # messages of a branch that come in one row
ESCAPES = [("\\", "\\\\"), ("##", "#\\#"), ("</", "<\\/")]


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, id, parent, role, text, score) of conversations without branches, as `formatted` takes them.

    The parent is the row before it by turn (null last), role and text hash. Null roles and texts are empty;
    repeated rows have one id and stay repeated; a null conversation is one of its own; other columns are ignored.
    """
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = plain.withColumn("hash", F.md5("text"))
    id = F.unhex(F.md5(F.to_json(F.struct("conv", "turn", "role", "hash"), {"ignoreNullFields": "false"})))
    nodes = hashed.select("conv", "turn", "role", "hash", id.alias("id")).distinct()
    placed = stored(numbered(nodes, ["conv", F.col("turn").asc_nulls_last(), "role", "hash"], "place").select("conv", "id", "place"), "turns")
    before = placed.select(F.col("conv").alias("_conv"), F.col("id").alias("parent"), (F.col("place") + 1).alias("place"))
    parents = placed.join(before, "place").filter(F.col("conv").eqNullSafe(F.col("_conv"))).select("id", "parent")
    return hashed.select("conv", id.alias("id"), "role", "text", F.lit(0.0).alias("score")).join(hint_small(parents), "id", "left")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(path, id, pos, last, rank): the messages of the `keep` best branches of every conversation.

    `messages`: (conv, id, parent, score). path is the leaf's id, pos counts from the root, last is the leaf's pos.
    Branches rank by mean score (null: 0), then by id. A message whose parent is missing or in
    another conversation is a root; messages on a cycle have no root, hence no branch. Rows of one id are one message.
    """
    nodes = messages.select("conv", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).filter("id is not null")
    nodes = stored(nodes.groupBy("id").agg(F.min(F.struct("conv", "parent", "score")).alias("n")).select("id", "n.*"), "nodes")
    known = nodes.select(F.col("id").alias("parent"), F.col("conv").alias("_conv"))
    found = nodes.filter("parent is not null").join(known, "parent").filter(F.col("conv").eqNullSafe(F.col("_conv"))).select("id", F.col("parent").alias("up"), F.lit(1).alias("depth"), "score")
    rest = nodes.join(found.select("id"), "id", "left_anti").select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("up"), F.lit(0).alias("depth"), "score")
    state = stored(found.unionByName(rest), "reach")
    steps, open_ = [], state.filter("up is not null").count()
    while open_:
        steps.append(state.filter("up is not null").select("id", "up"))
        next_ = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("score").alias("_score"))
        moved = state.filter("up is not null").join(next_, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("score") + F.col("_score")).alias("score"))
        state = stored(moved.unionByName(state.filter("up is null")), "reach")
        left = state.filter("up is not null").count()
        if left == open_:  # only cycles are left
            break
        open_ = left
    rooted = state.filter("up is null").select("id", "depth", "score")
    inner = steps[0].select(F.col("up").alias("id")).distinct() if steps else nodes.select("id").limit(0)
    leaves = rooted.join(inner, "id", "left_anti").join(nodes.select("id", "conv"), "id")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("score") / (F.col("depth") + 1)), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    held = stored(chosen.select(F.col("id").alias("path"), "id", F.col("depth").alias("last"), "rank"), "branches")
    for step in reversed(steps):
        held = stored(held.unionByName(held.join(step, "id").select("path", F.col("up").alias("id"), "last", "rank")), "branches")
    return held.join(rooted.select("id", F.col("depth").alias("pos")), "id")


def formatted(messages: DataFrame, keep: int = 1, learned: str = LEARNED, turns: int = TURNS) -> DataFrame:
    """(path, last, part, conv, rank, formatted, mask): one row per chosen branch and `turns` messages of it.

    `messages`: (conv, id, parent, role, text, score). Branches of up to `turns` messages have one row; the others'
    parts follow each other. mask: [start, end) in code points of the part, one per text of the learned role, as
    escaped. No rows give none.
    """
    placed = hint_small(stored(branches(messages, keep), "places"))
    part, last = F.expr(f"pos div {turns}").alias("part"), F.expr(f"last div {turns}").alias("last")
    head = F.concat(F.lit(HEAD), F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    texts = messages.select("id", "conv", (F.col("role") == learned).alias("learned"), head.alias("head"), body.alias("body"))
    rows = texts.join(placed, "id").select("path", last, part, "pos", "conv", "rank", "learned", F.length("head").alias("skip"), F.concat("head", "body", F.lit(END)).alias("piece"))
    by = ["path", "last", "part"]
    sizes = F.sum(F.length("piece")).over(Window.partitionBy(*by).orderBy("pos", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = rows.withColumn("end", sizes).withColumn("start", F.col("end") - F.length("piece"))
    mask = F.when(F.col("learned"), F.struct((F.col("start") + F.col("skip")).alias("start"), (F.col("end") - len(END)).alias("end")))
    grouped = laid.groupBy(*by).agg(
        F.first("conv").alias("conv"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"), F.sort_array(F.collect_list(mask)).alias("mask")
    )
    return grouped.select(*by, "conv", "rank", F.array_join("pieces.piece", "").alias("formatted"), "mask")


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out = []
    for piece in text.split(END)[:-1]:
        head, _, body = piece.partition("\n")
        out.append((unescaped(head[len(HEAD):]), unescaped(body)))
    return out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of a branch come one after the other; of each branch what its turns and its mask hold."""
    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now = None
    for batch in batches:
        out = []
        for path, conv, text, starts, ends in zip(batch["path"], batch["conv"], batch["formatted"], batch["starts"], batch["ends"]):
            if now is None or now[0] != path:
                if now:
                    out.append(now[1:])
                now = [path, conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in read_turns(text):
                now[2] += 1
                now[3].update(f"{role}\n{body}\n".encode())
            for start, end in zip(starts, ends):
                body = unescaped(text[start:end])
                now[4] += len(body)
                now[5].update(body.encode())
            now[6] += len(text)
        yield pd.DataFrame([(c, n, s.hexdigest(), k, m.hexdigest(), f) for c, n, s, k, m, f in out], columns=columns)
    if now:
        _, c, n, s, k, m, f = now
        yield pd.DataFrame([(c, n, s.hexdigest(), k, m.hexdigest(), f)], columns=columns)


def read_back(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per branch, read from its formatted parts: conv, n_turns, digests of turns and of masked texts, sizes.

    A digest runs over a branch in order; branches of several parts are sorted and stream through a task, none is held whole.
    """
    rows = parts.select("path", "last", "part", F.col("conv").cast("string").alias("conv"), "formatted", F.col("mask.start").alias("starts"), F.col("mask.end").alias("ends"))
    long = rows.filter("last > 0").repartition("path").sortWithinPartitions("path", "part")
    schema = "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    found = rows.filter("last = 0").mapInPandas(_digests, schema).unionByName(long.mapInPandas(_digests, schema))
    kind = parts.schema["conv"].dataType.simpleString()
    return found.selectExpr(f"cast(conv as {kind}) as `{conv}`", *found.columns[1:])


EXTRA = "\\### Assistant: </turn> ok"


def _sql() -> str:
    safe = "replace(replace(replace({}, '\\', '\\\\'), '##', '#\\#'), '</', '<\\/')".format
    order = "ORDER BY turn NULLS LAST, role, md5(text)"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  sum({len(HEAD) + 1 + len(END)} + length(replace({safe('role')}, chr(10), '\\n')) + length({safe('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op13_chat_format", _sql())
def op13_chat_format(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], rows.schema)
    return read_back(formatted(chains(rows.unionByName(extra))))
