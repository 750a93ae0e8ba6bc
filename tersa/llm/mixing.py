"""Mixing sources to target weights by hierarchical budgeting over domain, language and source.

A budget of tokens flows down the tree by the weights of siblings. A node can take
``max_epochs`` times its tokens; what it cannot take goes to its siblings first, and only
what they cannot take either has already gone, one level up, to the siblings of their parent:
filling each level against the capacity of whole subtrees does both. Each leaf then takes
whole seeded epochs of its documents and the token-prefix of one more.

All of it is DataFrame operations. Per level one row a node meets in a window; the cut of a
leaf's last epoch is found by radix: sums over 4,096 key groups, then the rows of one group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import pick, written

LEVELS = ("domain", "lang", "source")
#: Leaves up to this many are broadcast to the documents; above it they join by shuffle.
BROADCAST_LEAVES = 50_000
#: Hex digits of a key that make its group.
GROUP_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def default_domain(source: Column) -> Column:
    """One of four domains by the first hex digit of the source's md5, where no domain is known."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1
    return F.concat(F.lit("d"), F.floor(digit / 4).cast("string"))


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Shares ``budget`` (the parent's) among siblings by ``weight``, none above ``cap``; adds ``share``.

    In ascending order of cap over weight the nodes that fill up come first, so one pass of
    running sums finds them. The others share what is left; tokens lost to rounding down go
    one each to the first of these. A weight of 0 gets nothing.
    """
    order = Window.partitionBy(*parents).orderBy("_ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    family = Window.partitionBy(*parents)
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf")))
    zero = F.lit(0).cast("decimal(38,0)")
    seen = nodes.withColumn("_ratio", ratio).select(
        "*",
        F.coalesce(_wide(F.sum("cap").over(before)), zero).alias("_filled"),
        _wide(F.sum("weight").over(onward)).alias("_left"),
        F.row_number().over(order).alias("_at"),
    )
    room = _wide(F.col("budget") - F.col("_filled"))
    full = (F.col("weight") > 0) & (_wide("cap") * F.col("_left") <= _wide("weight") * room)
    seen = seen.withColumn("_room", room).withColumn("_full", full)
    seen = seen.withColumn("_first", F.min(F.when(~F.col("_full"), F.col("_at"))).over(family))
    at_first = F.col("_at") == F.col("_first")
    seen = seen.select(
        "*",
        F.max(F.when(at_first, F.col("_room"))).over(family).alias("_rest"),
        F.max(F.when(at_first, F.col("_left"))).over(family).alias("_weights"),
    )
    open_ = F.col("_first").isNotNull() & (F.col("_at") >= F.col("_first")) & (F.col("weight") > 0) & (F.col("_weights") > 0)
    seen = seen.withColumn(
        "_low", F.when(open_, F.expr("CAST(CAST(weight AS DECIMAL(38,0)) * _rest DIV _weights AS BIGINT)")).otherwise(0)
    )
    lost = F.col("_rest") - F.sum("_low").over(family)
    extra = F.when(open_ & (F.col("_at") - F.col("_first") < lost), 1).otherwise(0)
    share = F.when(open_, F.least(F.col("cap"), F.col("_low") + extra)).when(F.col("_full"), F.col("cap")).otherwise(0)
    return seen.withColumn("share", share.cast("long")).drop(*[c for c in seen.columns if c.startswith("_")])


def _weight(path: list[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """The weight of a node: of the paths given for its depth the one with the fewest stars that matches it, else 1."""
    weight = F.lit(1)
    for key in sorted((k for k in weights if len(k) == len(path)), key=lambda k: -k.count("*")):
        match = F.lit(True)
        for level, name in zip(path, key, strict=True):
            match &= F.lit(True) if name == "*" else F.col(level) == name
        weight = F.when(match, F.lit(weights[key])).otherwise(weight)
    return weight.cast("long")


def budgets(leaves: DataFrame, budget: int | None, max_epochs: int, weights: Mapping[tuple[str, ...], int]) -> DataFrame:
    """domain, lang, source, tokens, share. ``budget`` None: as many tokens as there are.

    ``weights`` maps paths from the root, (domain,), (domain, lang) and (domain, lang, source), to whole
    numbers of 0 or more; "*" in a path stands for any name; a path that is not there weighs 1. What a node can take is
    what its children of some weight can, so that no budget goes where it cannot be spent while others have room.
    """
    given = F.lit(budget).cast("long") if budget is not None else None
    path = list(LEVELS)
    able = F.when(_weight(path, weights) > 0, F.col("tokens") * max_epochs).otherwise(0)
    levels = [leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens")).withColumn("cap", able)]
    for depth in range(len(LEVELS) - 1, 0, -1):
        path = list(LEVELS[:depth])
        nodes = levels[0].groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap"))
        levels.insert(0, nodes.withColumn("cap", F.when(_weight(path, weights) > 0, F.col("cap")).otherwise(0)))
    shares: DataFrame | None = None
    for depth, nodes in enumerate(levels, 1):
        path = list(LEVELS[:depth])
        nodes = nodes.withColumn("weight", _weight(path, weights))
        if shares is None:
            whole = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumn("budget", given if given is not None else F.sum("tokens").over(whole))
            nodes, family = nodes.withColumn("_root", F.lit(0)), ["_root"]
        else:
            family = path[:-1]
            nodes = nodes.join(shares.select(*family, F.col("share").alias("budget")), family)
        shares = fill(nodes, family, path[-1]).select(*path, "tokens", "share")
    return shares


def _key(seed: int, epoch: Column) -> Column:
    """By seed, epoch and doc_id; rows of one leaf that share an id, or have none, are told apart by their turn."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.md5(F.when(F.col("turn") == 0, name).otherwise(F.concat_ws(":", name, F.col("turn").cast("string"))))


def in_turn(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Adds turn: 0, but 0, 1, ... for rows whose leaf and id (``repeated``) come more than once, by their tokens and text (same).
    Only such rows are sorted. Rows with one text are interchangeable."""
    if repeated is None:
        return rows.withColumn("turn", F.lit(0))
    flags = repeated.select(*[F.col(c).alias(f"_{c}") for c in (*LEVELS, "doc_id")], F.lit(True).alias("_again"))
    flags = F.broadcast(flags) if repeated.count() <= BROADCAST_LEAVES else flags
    rows = rows.join(flags, F.expr(" AND ".join(f"{c} <=> _{c}" for c in (*LEVELS, "doc_id"))), "left")
    order = Window.partitionBy(*LEVELS, "doc_id").orderBy("n_tokens", "same")
    again = rows.where("_again").withColumn("turn", F.row_number().over(order) - 1)
    once = rows.where("_again IS NULL").withColumn("turn", F.lit(0))
    return once.unionByName(again).drop("_again", *[f"_{c}" for c in (*LEVELS, "doc_id")])


def plan(sized: DataFrame, budget: int | None, max_epochs: int, weights: Mapping[tuple[str, ...], int], seed: int) -> DataFrame:
    """For each leaf: tokens, share, epochs (whole ones) and cut, the last key that epoch number
    ``epochs`` still takes ('' if none). ``sized``: doc_id, turn, levels, n_tokens, as a written table."""
    names = list(LEVELS)
    leaves = sized.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    shares = written(budgets(leaves, budget, max_epochs, weights), "budgets")
    shares = shares.withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN share DIV tokens ELSE 0 END"))
    shares = shares.withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    keys = sized.join(_held(shares.where("rest > 0")), names)
    keys = keys.withColumn("key", _key(seed, F.col("epochs"))).withColumn("g", F.substring("key", 1, GROUP_DIGITS))
    sums = keys.groupBy(*names, "g", "rest").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy(*names).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0)))
    edge = sums.where((F.col("base") < F.col("rest")) & (F.col("rest") <= F.col("base") + F.col("t")))
    inside = keys.select(*names, "g", "key", "n_tokens").join(_held(edge.drop("t")), [*names, "g"])
    within = Window.partitionBy(*names, "g").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("done", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    cuts = inside.where(F.col("done") < F.col("rest")).groupBy(*names).agg(F.max("key").alias("cut"))
    return shares.join(cuts, names, "left").select(*names, "tokens", "share", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))


def _held(leaves: DataFrame) -> DataFrame:
    """One row a leaf, broadcast if their checked number is small."""
    leaves = written(leaves, "leaves")
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _levelled(docs: DataFrame, domain: Column | None) -> DataFrame:
    """doc (all columns as a struct), domain, lang, source (null: ''), n_tokens, the words of the whole text, and same, its md5."""
    source, lang = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in ("source", "lang"))
    return docs.select(
        F.struct(*docs.columns).alias("doc"),
        docs["doc_id"],
        (domain if domain is not None else default_domain(source)).alias("domain"),
        lang.alias("lang"),
        source.alias("source"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("n_tokens"),
        F.md5(F.coalesce(docs["text"], F.lit(""))).alias("same"),
    )


def mix(
    docs: DataFrame,
    budget: int | None = None,
    max_epochs: int = 2,
    weights: Mapping[tuple[str, ...], int] | None = None,
    seed: int = 17,
    domain: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents, one row for each epoch that takes them, and the plan by leaf.

    A chosen row has doc (all columns of ``docs``, as a struct), domain, lang, source, n_tokens (words
    of the whole text), epoch and order_key, by which an epoch is read. A document is taken if
    the tokens before it in its epoch are fewer than what the leaf has left, so a leaf passes its
    share by less than one document; rows that share an id or have none, and rows repeated whole, are single documents too. A
    null language or source is a leaf ''; a null or empty text has no tokens and comes with
    whole epochs, or before the cut. An empty table, or one without tokens, gives no rows.
    """
    sized = written(_levelled(pick(docs, "doc_id", "text", "lang", "source"), domain).drop("doc"), "sized")
    repeated = written(sized.groupBy(*LEVELS, "doc_id").agg(F.count("*").alias("_n")).where("_n > 1"), "repeated-ids")
    repeated = None if repeated.isEmpty() else repeated
    leaves = written(plan(in_turn(sized, repeated), budget, max_epochs, weights or {}, seed), "mix-plan")
    held = leaves.select(*LEVELS, "epochs", "cut")
    if held.count() <= BROADCAST_LEAVES:
        held = F.broadcast(held)
    rows = in_turn(_levelled(docs, domain), repeated).join(held, list(LEVELS))
    times = F.col("epochs") + (_key(seed, F.col("epochs")) <= F.col("cut")).cast("long")
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return rows.select("doc", *LEVELS, "n_tokens", "epoch", _key(seed, F.col("epoch")).alias("order_key")), leaves
