"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are normalised (lower case, white space runs to one space, none at the ends) and shingled: the SHINGLE characters from
each character on; a shorter line is one shingle. Distinct lines get ROWS x BANDS least hashes; lines that agree
in a band are compared, as sets of 64-bit hashes of shingles, and those similar enough are linked. Distributed union-find
gives components, and of all occurrences of a component's lines the first, by doc_id and place, stays.

Only keys and hashes shuffle; texts of lines travel only for lines that share a band.

The lines of a band meet at its least one, the hub: a line goes to each of its hubs once, however many bands it shares with
them. Each is compared with the hub first, and then with a few lines of the hub's largest component. Only lines that this
leaves in different components meet again, in pages: a hub's lines by size class and hash, of a bounded number. Two pages make
one row, in which a lambda looks at every pair by a bound on the difference of the two sets (their parities), so that a pair of
lines becomes a row only if the bound allows it to be a link. Every pair of rows is then decided by the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import written
from tersa.llm.graph import components

SHINGLE = 9
#: Least hashes of a line, and the triples of them that are its bands: the lines of the affine plane of order 3, as (row, column) in a
#: square of 9. Any five of the nine hashes hold a triple, so of pairs with a similarity of 0.8 the bands find 99 in 100.
ROWS = 9
BANDS = [
    (0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8),
    (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6),
]
PERCENT = 80
#: Shingles of the lines of a page, each line with a surcharge, which bounds their number.
PAGE, SURCHARGE = 262_144, 256
#: 64-bit words of a set's parities, and lines of a hub's main component that each line outside it is compared with before pages.
PARITIES, REPRESENTATIVES = 16, 3
#: Lines that share a band, up to this many, are broadcast as 8-byte keys; beyond it they join by shuffle.
BROADCAST_KEYS = 1_000_000
#: Shingles that are hashed together when a line's are gone through.
STRIDE = 4
_SPACE, _BLANKS = r"[\x20\x09-\x0D]+", " \t\x0b\x0c\r"


def normal(line: Column) -> Column:
    """A line as it is compared. Only lines with something to fold go through the pattern."""
    return F.lower(_folded(line))


def _folded(line: Column) -> Column:
    odd = line.contains("  ")
    for c in _BLANKS[1:]:
        odd |= line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, _SPACE, " ")).otherwise(line))


def _spelled(normalised: Column) -> Column:
    """Two bytes a character (four outside the basic plane), so that any place in a long line is found at once."""
    return F.encode(normalised, "UTF-16BE")


def _places(spelled: Column, size: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.octet_length(spelled) - (2 * size - 1), F.lit(1)), F.lit(2))


def shingles(normalised: Column, size: int = SHINGLE) -> Column:
    """The shingles of a line, spelled, in their order."""
    every = lambda b: F.transform(_places(b, size), lambda i: F.substring(b, i, F.lit(2 * size)))
    return F.get(F.transform(F.array(_spelled(normalised)), every), F.lit(0))


def _hashes(normalised: Column, size: int = SHINGLE) -> Column:
    """The 64-bit hashes of a line's shingles, in their order; equal ones repeat."""
    every = lambda b: F.transform(_places(b, size), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * size))))
    return F.get(F.transform(F.array(_spelled(normalised)), every), F.lit(0))


def _keyed(docs: DataFrame) -> DataFrame:
    """text with ``doc`` (doc_id) and ``same`` (a hash of the text): rows equal in both count as one document."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(text).alias("same"), text.alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, same, place (from 0), line (normalised, not empty)."""
    # A text is put in lower case as a whole. A condition on the line itself would be moved below, and the line be made twice.
    split = _keyed(docs).select("doc", "same", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("place", "raw"))
    return split.where(F.ltrim("raw", F.lit(_BLANKS)) != "").select("doc", "same", "place", _folded(F.col("raw")).alias("line"))


def _turned(h: Column, row: int) -> Column:
    """A hash with its bits rotated as the permutation of a row has them."""
    turn = 16 * (row % 4)
    return h if not turn else F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn))


def _flipped(turned: Column, row: int) -> Column:
    """The rest of a row's permutation of a hash: some bits flipped. Rows of one band rotate differently, so their
    least values are of other bits; rows that rotate alike differ in the first bits flipped."""
    flip = row // 4
    mask = (flip << 61 | 0x0F1E2D3C4B5A6978 * (flip + 1) & (1 << 61) - 1) & (1 << 64) - 1
    return turned.bitwiseXOR(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def marked(docs: DataFrame) -> DataFrame:
    """doc, same, place, key (hash of the line) and least hashes of every line: the one pass over all characters. A row has STRIDE
    shingles that follow one another; past the end of a line the last one repeats."""
    lines = lines_of(docs).select("*", F.xxhash64("line").alias("key"), F.monotonically_increasing_id().alias("id"))
    names = ("id", "doc", "same", "place", "key")
    each = lines.select(*names, _spelled(F.col("line")).alias("b"))
    each = each.select(*names, "b", F.greatest(F.octet_length("b") - (2 * SHINGLE - 1), F.lit(1)).alias("last"))
    each = each.select(*names, "b", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * STRIDE))).alias("i"))
    at = [F.least(F.col("i") + 2 * j, F.col("last")) if j else F.col("i") for j in range(STRIDE)]
    each = each.select(*names, *[F.xxhash64(F.substring("b", i, F.lit(2 * SHINGLE))).alias(f"h{j}") for j, i in enumerate(at)])
    # Rows that rotate alike share what is rotated.
    each = each.select(*names, *[_turned(F.col(f"h{j}"), k).alias(f"t{k}_{j}") for j in range(STRIDE) for k in range(4)])
    each = each.select(*names, *[F.least(*[_flipped(F.col(f"t{k % 4}_{j}"), k) for j in range(STRIDE)]).alias(f"m{k}") for k in range(ROWS)])
    # The names are equal in all rows of an id, so that the least is each.
    return each.groupBy("id").agg(*[F.min(c).alias(c) for c in (*names[1:], *[f"m{k}" for k in range(ROWS)])]).drop("id")


def meetings(marks: DataFrame) -> DataFrame:
    """hub, key: each line that shares a band once with the least line of each band it shares, hubs themselves too."""
    rows = marks.groupBy("key").agg(*[F.first(f"m{k}").alias(f"m{k}") for k in range(ROWS)])
    bands = [F.xxhash64(F.lit(b), *[f"m{k}" for k in triple]) for b, triple in enumerate(BANDS)]
    # Dealt by band once, for the least lines and for the join with them, of which the bands that are shared are the smaller side.
    bands = rows.select("key", F.explode(F.array(*bands)).alias("band")).repartition("band")
    shared = bands.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("_last")).where("hub <> _last")
    return bands.join(shared.select("band", "hub").hint("shuffle_hash"), "band").select("hub", "key").distinct()


def near_lines(docs: DataFrame, meets: DataFrame) -> DataFrame:
    """key, line, n (size of its set of shingles) and p0 ...: whether the hashes of the set that fall on a bit are an odd
    number, for 64 x PARITIES bits; of the lines that meet another."""
    near = meets.select("key").distinct()
    near = F.broadcast(near) if near.count() <= BROADCAST_KEYS else near
    texts = lines_of(docs).select(F.xxhash64("line").alias("key"), "line").join(near, "key", "left_semi")
    texts = written(texts.groupBy("key").agg(F.first("line").alias("line")), "line-texts")
    sets = texts.select("key", F.array_distinct(_hashes(F.col("line"))).alias("set"))
    each = sets.select("key", "set", F.size("set").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.size("set") - 1, F.lit(STRIDE))).alias("i"))
    each = each.select("key", "n", *[F.get("set", F.col("i") + j).alias(f"h{j}") for j in range(STRIDE)])

    def bits(k: int, h: str) -> Column:
        """The bit of a hash, if it is in word ``k``; past the end of a set there is none."""
        bit = F.expr(f"shiftleft(1L, CAST({h} & 63 AS INT))")
        return F.when(F.shiftright(h, 6).bitwiseAND(F.lit(PARITIES - 1)) == k, bit).otherwise(F.lit(0).cast("long"))

    parity = []
    for k in range(PARITIES):
        odd = bits(k, "h0")
        for j in range(1, STRIDE):
            odd = odd.bitwiseXOR(bits(k, f"h{j}"))
        parity.append(F.bit_xor(odd).alias(f"p{k}"))
    return written(texts.join(each.groupBy("key").agg(F.max("n").alias("n"), *parity), "key"), "near-lines", texts)


def _may_be_alike(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """False only for sets that differ in more hashes than they may: each bit in which their parities differ is one at least."""
    bits = sum(F.bit_count(x(f"p{k}").bitwiseXOR(y(f"p{k}"))) for k in range(PARITIES))
    return (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & ((100 + percent) * bits <= (100 - percent) * (x("n") + y("n")))


def similar(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets of shingles reach ``percent`` in 100 of their union."""
    for side in ("a", "b"):
        pairs = pairs.join(near.select([F.col(c).alias(side if c == "key" else f"{c}_{side}") for c in near.columns]), side)
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    common = F.size(F.array_intersect(_hashes(a("line")), _hashes(b("line")))).cast("long")
    return pairs.where(_may_be_alike(a, b, percent)).where((100 + percent) * common >= percent * (a("n") + b("n"))).select("a", "b")


def placed_lines(meets: DataFrame, links: DataFrame) -> DataFrame:
    """hub, key, root, main (the component of most of the hub's lines) where a hub's lines are in several components."""
    roots = components(links).withColumnRenamed("node", "key")
    placed = written(meets.join(roots, "key", "left").select("hub", "key", F.coalesce("root", "key").alias("root")), "placed-lines")
    parts = placed.groupBy("hub", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("hub").agg(F.count("*").alias("k"), F.max_by("root", F.struct("n", "root")).alias("main")).where("k > 1")
    return placed.join(main.select("hub", "main"), "hub")


def across(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each line outside a hub's main component with some of that one, and with one other outside it."""
    out = F.col("root") != F.col("main")
    picked = [F.min_by("key", F.when(~out, F.xxhash64("key", F.lit(k)))).alias(f"k{k}") for k in range(REPRESENTATIVES)]
    other = F.min_by("key", F.when(out, F.xxhash64("key"))).alias("other")
    some = placed.groupBy("hub").agg(F.array(*picked, other).alias("a"))
    pairs = placed.where(out).join(some, "hub").select(F.explode("a").alias("a"), F.col("key").alias("b"))
    return pairs.where("a <> b").distinct()


def left_over(placed: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of lines of one hub in different components that may be alike: every such pair is looked at."""
    # Lines that can be alike are in one size class or in neighbouring ones.
    width = math.log(100 / percent) * 1.0001
    parity = [f"p{k}" for k in range(PARITIES)]
    rows = placed.join(near.select("key", "n", *parity), "key")
    rows = rows.withColumn("out", F.col("root") != F.col("main")).withColumn("class", F.floor(F.log("n") / width))
    group = ["hub", "out", "class"]
    total = rows.groupBy(*group).agg(F.ceil(F.sum(F.col("n") + SURCHARGE) / PAGE).alias("pages"))
    rows = rows.join(total, group).withColumn("page", F.pmod(F.xxhash64("key"), F.col("pages")))
    pages = rows.groupBy(*group, "page").agg(F.collect_list(F.struct("key", "root", "n", *parity)).alias("lines"))
    pages = written(pages, "line-pages")
    x = pages.where("out").select("hub", F.col("class").alias("c"), F.col("page").alias("p"), F.col("lines").alias("own"))
    close = (F.abs(F.col("class") - F.col("c")) <= 1) & (~F.col("out") | (F.col("class") > F.col("c")) | ((F.col("class") == F.col("c")) & (F.col("page") >= F.col("p"))))
    both = x.join(pages, "hub").where(close)

    def found(x: Column) -> Column:
        alike = lambda y: (x["root"] != y["root"]) & _may_be_alike(x.getField, y.getField, percent)
        return F.transform(F.filter("lines", alike), lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))

    pairs = both.select(F.explode(F.flatten(F.transform("own", found))).alias("l")).select("l.a", "l.b")
    return written(pairs.distinct(), "line-pairs", pages)


def line_classes(docs: DataFrame, marks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, root for lines that are linked with a different one."""
    meets = written(meetings(marks), "meets")
    near = near_lines(docs, meets)
    star = meets.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    links = written(similar(star, near, percent), "line-links")
    more = similar(across(placed_lines(meets, links)), near, percent)
    links = written(links.unionByName(more), "line-links", links)
    pairs = left_over(placed_lines(meets, links), near, percent)
    every = written(links.unionByName(similar(pairs, near, percent)), "line-links", links, pairs, meets, near)
    return components(every).withColumnRenamed("node", "key")


def decide(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc, same, n_lines (those with a word), removed (ascending places of lines that go; null if none).

    Lines equal after normalising are one line without any comparison. Each component of lines keeps
    its first occurrence, by doc_id (null first), text hash and place. A null or empty text has no lines. Rows
    equal in id and text are one document here. Ids may be null. An empty table gives no rows. Only doc_id
    and text are read.
    """
    marks = written(marked(docs), "line-marks")
    roots = written(line_classes(docs, marks, percent), "line-roots")
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_KEYS else roots
    at = written(marks.select("doc", "same", "place", "key").distinct().join(roots, "key", "left"), "line-places", marks)
    at = at.withColumn("root", F.coalesce("root", "key"))
    order = F.struct(F.col("doc").isNotNull().alias("k"), "doc", "same", "place")
    first = at.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = at.join(first, "root").where(order != F.col("first")).groupBy("doc", "same").agg(F.sort_array(F.collect_list("place")).alias("removed"))
    found = at.groupBy("doc", "same").agg(F.count("*").alias("n_lines"))
    found = found.join(gone.select(F.col("doc").alias("d"), F.col("same").alias("s"), "removed"), F.expr("doc <=> d AND same = s"), "left").drop("d", "s")
    every = _keyed(docs).select("doc", "same").distinct()
    joined = every.join(found.select(F.col("doc").alias("d"), F.col("same").alias("s"), "n_lines", "removed"), F.expr("doc <=> d AND same = s"), "left")
    return joined.select("doc", "same", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without the lines that ``decide`` removes, all their columns; one that has no words left goes,
    one that had none to begin with stays. ``n_chars``, where there is one, follows the text. A null or empty text and a
    null id stay as they are; rows equal in id and text lose the same lines and all stay; an empty table gives no rows."""
    gone = decide(docs, percent).where(F.size("removed") > 0).select(F.col("doc").alias("_d"), F.col("same").alias("_s"), F.col("removed").alias("_r"))
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), docs["doc_id"].cast("long").alias("_doc"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_same"))
    row = row.join(gone, F.expr("_doc <=> _d AND _same = _s"), "left")
    split = F.split(F.col("row.text"), "\n", -1)
    # Of the places those that stay, by one pass over both lists; the split is bound once a row.
    stay = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_r"))
    kept = F.get(F.transform(F.array(split), lambda all_: F.array_join(F.transform(stay(all_), lambda i: F.get(all_, i)), "\n")), F.lit(0))
    row = row.withColumn("_text", F.when(F.col("_r").isNull(), F.col("row.text")).otherwise(kept))
    row = row.where(F.col("_r").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": F.col("_text")}
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        fresh["n_chars"] = F.when(F.col("_r").isNull(), F.col("row.n_chars")).otherwise(F.length("_text").cast(kind))
    return row.select(*[fresh.get(n, F.col("row").getField(n)).alias(n) for n in names])
