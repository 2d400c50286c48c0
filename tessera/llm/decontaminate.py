"""Benchmark decontamination by template canonicalisation (operator 6), with DataFrame functions only.

Numbers (also number words and the digits that a word such as ``3x`` begins with), units after them and
names (capitalised words inside a sentence) become typed placeholders; everything else is lower-cased
and freed of punctuation.  A capitalised word that begins a sentence may be a name or not, so windows
with such a word stand twice, once with the word itself and once with a name in its place; an item's
window is found by either.  Windows of five such tokens are hash-joined with those of the benchmark.  Hits are gathered per text, item and alignment; what stood in the slots
must map item values to document values one to one (up to ``SLIPS``), so that a question asked again
with other names and numbers is caught while a chance likeness of patterns is not.  A text is
contaminated by an item when at least half of the item's windows are found in it.

Windows are 64-bit hashes of their tokens.  Those with fewer than three literal tokens say too little
to be searched; an item that has no other windows is searched by its own words instead of a template.

The search has two steps.  As half of an item's windows must be found, one of any greater part of them
is: the first step looks for each item's windows that the fewest items share, so a line common to
many items does not pair every text that has it with all of them.  The second compares the texts so
found with their items in full.  Texts are read window by window, and only hits are shuffled.  The
benchmark's windows are broadcast when they are few (the count is checked first); else both sides are
joined by shuffle.

Edge cases: null and empty texts hit nothing; results belong to texts, so rows with the same doc_id
and other texts, rows without doc_id and repeated rows are each answered by their own text; an item of
fewer than five tokens is one window and is hit only by a document of just these tokens; items with
the same text are reported each, rows with the same item_id are one item; only doc_id and text are
read, so other columns may have any name; without benchmark rows nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, salted_join, text_or_empty, unused

WINDOW = 5
LITERALS = 3
COVERAGE = 0.5
#: Share of slot pairs that may contradict the others.
SLIPS = 0.25
#: Rows of windows or found texts up to which a table of them is broadcast, once counted.
BROADCAST_ROWS = 500_000
#: Placeholders start with a letter that no living script uses.
MARK = "ꙮ"
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|inch|inches|meters?|metres?|euros?|dollars?|cents?|percent|degrees?"
SEPARATORS = r"[^\p{L}\p{N}]+"
NAME = r"\p{Lu}(?<=[\p{L}\p{N},;]\s.)\p{Ll}+(?![\p{L}\p{N}])"
NUMBER = rf"(?<![\p{{L}}\p{{N}}])\p{{N}}+(?:{UNITS})?(?![\p{{L}}\p{{N}}])"
MIXED = r"(?<![\p{L}\p{N}])\p{N}+(?=\p{L})"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
CAPITALISED = r"^\p{Lu}\p{Ll}+$"
UNIT = rf"(?<={MARK}num\s?)\b(?:{UNITS})(?![\p{{L}}\p{{N}}])"


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, SEPARATORS, -1), lambda x: x != "")


def templates(df: DataFrame, ident: str, text: str, literal: bool = False) -> DataFrame:
    """``ident``, ``hashes`` of the template's tokens, ``slots`` (null where a token is literal; the whole
    array is null if the text has no slots) and ``openers``, the capitalised words that are literal in
    ``hashes`` but may be names (null elsewhere).  ``literal`` leaves the words as they are."""
    given = df.select(F.col(ident).alias("ident"), F.translate(text_or_empty(text), MARK, " ").alias("t"))
    none = F.lit(None).cast("array<string>")
    if literal:
        return given.select("ident", F.transform(_tokens(F.col("t")), lambda x: F.xxhash64(F.lit("raw"), F.lower(x))).alias("hashes"), none.alias("slots"), none.alias("openers"))
    named = given.withColumn("m", F.regexp_replace("t", NAME, MARK + "name"))
    numbers = F.regexp_replace(F.regexp_replace(F.regexp_replace("m", NUMBER, MARK + "num"), UNIT, MARK + "unit"), MIXED, MARK + "num")
    counted = named.withColumn("m", F.when(F.col("m").rlike(r"\p{N}"), numbers).otherwise(F.col("m")))
    parts = counted.select("ident", _tokens(F.col("m")).alias("tokens"), F.when(F.contains("m", F.lit(MARK)), _tokens(F.col("t"))).alias("raw"))
    parts = parts.withColumn("low", F.transform("tokens", lambda x: F.lower(x)))
    number = lambda x: x.isin(NUMBER_WORDS)
    slots = F.transform("low", lambda x, i: F.when(x.startswith(MARK), F.lower(F.get("raw", i))).when(number(x), x))
    openers = F.transform("tokens", lambda x, i: F.when((x != F.get("low", i)) & x.rlike(CAPITALISED) & ~number(F.get("low", i)), F.get("low", i)))
    return parts.select(
        "ident",
        F.transform("low", lambda x: F.xxhash64(F.when(number(x), MARK + "num").otherwise(x))).alias("hashes"),
        F.when(F.col("raw").isNotNull() | F.exists("low", number), slots).alias("slots"),
        F.when(F.exists("tokens", lambda x: x.rlike(CAPITALISED)), openers).alias("openers"),
    )


def windows(df: DataFrame, ident: str, text: str, literal: bool = False) -> DataFrame:
    """A row for each window: ``ident``, ``pos``, hash ``h``, ``slots`` of the window (null: none).  A window
    with a word that may be a name has a second row, in which it is one."""
    t = templates(df, ident, text, literal)
    n = F.size("hashes")
    window = lambda pos, h, slots: F.struct(pos.alias("pos"), h.alias("h"), slots.alias("slots"))
    whole = F.array(window(F.lit(0), F.xxhash64(F.lit("short"), "hashes"), F.col("slots")))
    name = F.xxhash64(F.lit(MARK + "name"))
    opener = lambda i, k: F.get("openers", i + k)
    plain = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: window(i, F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]), F.when(F.col("slots").isNotNull(), F.slice("slots", i + 1, WINDOW))),
    )
    opened = F.filter(F.sequence(F.lit(0), n - WINDOW), lambda i: F.coalesce(*[opener(i, k) for k in range(WINDOW)]).isNotNull())
    other = F.transform(
        opened,
        lambda i: window(
            i,
            F.xxhash64(*[F.when(opener(i, k).isNotNull(), name).otherwise(F.get("hashes", i + k)) for k in range(WINDOW)]),
            F.array(*[F.coalesce(opener(i, k), F.get("slots", i + k)) for k in range(WINDOW)]),
        ),
    )
    many = F.when(F.col("openers").isNull(), plain).otherwise(F.concat(plain, other))
    listed = F.when(n >= WINDOW, many).when(n > 0, whole)
    # outer: for a plain explode the optimizer would compute the whole array once more, in a filter
    return t.select("ident", F.explode_outer(listed).alias("w")).where("w is not null").select("ident", "w.pos", "w.h", "w.slots")


def window_hashes(df: DataFrame, ident: str, text: str, literal: bool = False) -> DataFrame:
    """``ident`` and ``h`` of the rows of ``windows``, without places and slots."""
    t = templates(df, ident, text, literal)
    n = F.size("hashes")
    starts = F.sequence(F.lit(0), n - WINDOW)
    plain = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    name = F.xxhash64(F.lit(MARK + "name"))
    opener = lambda i, k: F.get("openers", i + k).isNotNull()
    opened = F.filter(starts, lambda i: reduce(Column.__or__, [opener(i, k) for k in range(WINDOW)]))
    other = F.transform(opened, lambda i: F.xxhash64(*[F.when(opener(i, k), name).otherwise(F.get("hashes", i + k)) for k in range(WINDOW)]))
    many = F.when(F.col("openers").isNull(), plain).otherwise(F.concat(plain, other))
    whole = F.array(F.xxhash64(F.lit("short"), "hashes"))
    listed = F.when(n >= WINDOW, many).when(n > 0, whole)
    return t.select("ident", F.explode_outer(listed).alias("h")).where("h is not null")


def item_windows(benchmark: DataFrame, coverage: float = COVERAGE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The benchmark's windows: ``item_id``, ``item_pos``, ``item_h``, ``item_slots``, ``n_windows`` of
    the item, ``literal`` (by its own words) and ``first`` (looked for in the first step)."""
    words = F.coalesce(F.size(F.filter("slots", lambda x: x.isNull())), F.lit(WINDOW))
    found = windows(benchmark, item_id, text).where((words >= LITERALS) | F.col("slots").isNull()).withColumn("literal", F.lit(False))
    named = found.select(F.col("ident").alias("__named")).distinct()
    lost = benchmark.join(named, F.col(item_id).eqNullSafe(F.col("__named")), "left_anti")
    found = found.unionByName(windows(lost, item_id, text, literal=True).withColumn("literal", F.lit(True)))
    found = found.select(F.col("ident").alias("item_id"), F.col("pos").alias("item_pos"), F.col("h").alias("item_h"), F.col("slots").alias("item_slots"), "literal").distinct()
    sharing = found.groupBy("item_h").agg(F.count_distinct("item_id").alias("sharing"))
    places = found.join(sharing, "item_h").groupBy("item_id", "item_pos").agg(F.max("sharing").alias("sharing"))
    item = Window.partitionBy("item_id")
    places = places.select(
        F.col("item_id").alias("i"), F.col("item_pos").alias("p"), F.count(F.lit(1)).over(item).alias("n_windows"),
        F.row_number().over(item.orderBy("sharing", "item_pos")).alias("rank"),
    )
    first = F.col("rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * coverage) + 1
    out = found.join(places, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_pos") == F.col("p"))).withColumn("first", first)
    return cut(out.drop("i", "p", "rank"), "leak-items")


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _searched(texts: DataFrame, items: DataFrame, made: Callable = windows) -> DataFrame:
    """Windows of ``texts`` (``ident``, ``text``), by template, and by words if any of ``items`` is."""
    w = made(texts, "ident", "text")
    return w.unionByName(made(texts, "ident", "text", literal=True)) if not items.where("literal").isEmpty() else w


def identity(text: str) -> Column:
    """What a text is told by: its digest."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Pairs (``ident``: ``identity`` of a text, ``item_id``) with the item's ``covered`` share."""
    items = item_windows(benchmark, coverage)
    texts = docs.select(identity(text).alias("ident"), F.col(text).alias("text"))
    first = items.where("first").select("item_id", "item_h")
    near = _searched(texts, items, window_hashes).join(F.broadcast(first) if _few(first) else first, F.col("h") == F.col("item_h"))
    near = cut(near.select("ident", "item_id").distinct(), "leak-near")
    # the second step: each text so found against its items, window by window
    some = near.select("ident").distinct()
    full = _searched(texts.join(F.broadcast(some) if _few(some) else some, "ident", "left_semi").distinct(), items)
    paired = near.select(F.col("ident").alias("of"), F.col("item_id").alias("item"))
    paired = full.join(F.broadcast(paired) if _few(near) else paired, F.col("ident") == F.col("of"))
    same = F.col("item").eqNullSafe(F.col("item_id")) & (F.col("h") == F.col("item_h"))
    hits = paired.join(F.broadcast(items) if _few(items) else items, same)
    slots = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("a"), z["slots"].alias("b")))
    aligned = hits.groupBy("ident", "item_id", "n_windows", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("found"), F.flatten(F.collect_set(slots)).alias("pairs")
    )
    pairs = F.array_distinct(F.filter("pairs", lambda p: p["a"].isNotNull() & p["b"].isNotNull()))
    aligned = aligned.withColumn("pairs", F.coalesce(pairs, F.array().cast("array<struct<a:string,b:string>>")))
    matched = F.least(
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))),
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))),
    )
    consistent = (F.size("pairs") - matched) <= F.size("pairs") * SLIPS
    per_item = aligned.where(consistent).groupBy("ident", "item_id", "n_windows").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    covered = F.size("found") / F.col("n_windows")
    return per_item.select("ident", "item_id", covered.alias("covered")).where(F.col("covered") >= coverage)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, ``contaminated``, ``n_items``, ``item_ids`` (sorted, comma-joined)."""
    found = matches(docs, benchmark, text).groupBy("ident").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = cut(found, "leak-found")
    rows = docs.select(F.col(doc_id).alias("doc_id"), identity(text).alias("ident"))
    rows = rows.join(F.broadcast(found), "ident", "left") if _few(found) else salted_join(rows, found, ["ident"], ["doc_id"], "left")
    return rows.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    hit = unused(docs, "__hit")
    found = cut(matches(docs, benchmark, text).select(F.col("ident").alias(hit)).distinct(), "leak-found")
    return docs.join(F.broadcast(found) if _few(found) else found, identity(text) == F.col(hit), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
