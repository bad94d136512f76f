"""Operator 7: chat formatting by event-sourced reconstruction (DataFrame functions only).

A log has one row per event: ``conv_id, seq, turn, kind, role, text``.
``message`` sets a turn, ``delta`` appends to it (a streamed piece), ``edit``
replaces its text, ``regenerate`` replaces it and drops the later turns that
were written before it. ``fold_events`` partitions the log by conversation and
turn, sorts by ``seq`` and folds; ``render`` joins the turns into one text.

Template: ``<turn>`` role ``<text>`` text ``</turn>`` newline. Inside roles and
texts ``&`` is written ``&amp;`` and ``<`` is written ``&lt;``, so no control
string can occur there and undoing ``&lt;`` before ``&amp;`` restores every text.

Defined results: null roles and texts are empty; an event delivered more than
once counts once; events of equal ``seq`` apply in order of kind, role and text;
null turns come first; null conversation ids form one conversation; an empty log
gives an empty result; other columns are ignored. A long conversation is folded
turn by turn in many tasks; only its finished turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, turn, role, text`` with one row per live turn."""
    log = log.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role",
                     F.coalesce("text", F.lit("")).alias("text"))
    event = F.struct("seq", "kind", "role", "text")
    turns = log.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(event)).alias("events"))
    resets = F.transform(F.col("events"), lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(-1)))
    turns = turns.withColumn("base", F.greatest(F.array_max(resets), F.lit(0)))
    live = F.slice("events", F.col("base") + 1, F.size("events"))
    turns = turns.select(
        "conv_id", "turn",
        F.array_max(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())).alias("any_role"),
        F.element_at("events", (F.col("base") + 1).cast("int"))["role"].alias("role"),
        F.concat_ws("", F.transform(live, lambda e: e["text"])).alias("text"),
        F.element_at("events", -1)["seq"].alias("last_seq"),
        F.array_max(F.transform(F.filter("events", lambda e: e["kind"] == "regenerate"),
                                lambda e: e["seq"])).alias("redone"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("redone").over(earlier))
    return turns.where(F.col("cut").isNull() | F.col("last_seq").isNull() | (F.col("last_seq") > F.col("cut"))) \
        .select("conv_id", "turn", F.coalesce("role", "any_role", F.lit("")).alias("role"), "text")


def render(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans are (start, length) in UTF-8 bytes of
    ``formatted`` and cover the text of each ``learn_role`` turn."""
    t = turns.select("conv_id", "turn", "role", escape(F.col("text")).alias("body"),
                     F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)).alias("head"))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("stop", F.sum(F.octet_length("piece").cast("long")).over(order))
    start = F.col("stop") - F.octet_length("piece") + F.octet_length("head")
    t = t.withColumn("span", F.when(F.col("role") == learn_role,
                                    F.struct(start.alias("start"), F.octet_length("body").cast("long").alias("length"))))
    return t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("stop", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"),
    ).select("conv_id", F.concat_ws("", F.col("pieces.piece")).alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(p, BODY))
    return F.transform(halves, lambda h: F.struct(
        unescape(F.substr(h[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(h[1]).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """Contract columns, all read back from ``formatted`` and ``loss_spans``."""
    # inline() keeps the bytes a column of their own; the optimiser would otherwise
    # move the cast into the lambda and repeat it for every span.
    base = rendered.select("conv_id", F.inline(F.array(F.struct(
        F.col("formatted"), F.col("formatted").cast("binary").alias("raw"), F.col("loss_spans"),
        parse(F.col("formatted")).alias("turns")))))
    learnt = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.decode(F.substr(
        F.col("raw"), (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    out = base.select("conv_id", F.inline(F.array(F.struct(
        F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"),
        F.char_length("formatted").cast("long").alias("formatted_chars")))))
    return out.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
                      F.char_length("learnt").cast("long").alias("loss_chars"),
                      F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
