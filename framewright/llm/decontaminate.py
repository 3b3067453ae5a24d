"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question with other numbers or names has the same template. Windows of
template words are joined by hash with those of the benchmark; the values that stand in the slots of matched windows must
then map consistently: one value of the item to one value of the document, over all matches or over those of one alignment.

A name shows by its capital, so a second template takes names for plain words, whatever their case: text in capitals or title case
meets the benchmark there. Windows without a name are the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import materialise, table, unique_name

WINDOW = 5
#: A window needs so many words that are no placeholders; an item so many words.
LITERALS, SHORTEST = 2, 3
#: A document holds an item if it has so many of its windows: half of them, but at least 3 and at most 8 (of up to 3 windows: all).
SHARE, FEWEST, ENOUGH = 0.5, 3, 8
#: Of an item's slot values, so many must each map to one value of the document.
CONSISTENT = 0.75
#: Matches belong to one alignment if their shifts (place in the document less place in the item) are equal, or in one band of so many words; bands overlap by half.
BAND = 8
#: The benchmark's windows are broadcast up to so many rows (of some 200 bytes), else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The ids of documents to drop are broadcast up to so many (8 bytes each).
BROADCAST_IDS = 1_000_000

# Placeholders: private-use characters, taken out of all texts first.
NUM, NAMED, UNIT = "\ue000", "\ue001", "\ue002"
# Units of measure and money.
UNITS = "km cm mm nm m kg mg g lb lbs oz l ml cl h hr hrs min mins s sec secs ms hz khz mhz ghz kb mb gb tb w kw mw v a ohm pa kpa bar k c f mph kmh percent pct usd eur gbp dollars dollar euros euro pounds pound cents cent meters meter metres metre kilometers kilometer kilometres kilometre miles mile feet foot inches inch yards yard grams gram kilograms kilogram tons ton liters liter litres litre gallons gallon hours hour minutes minute seconds second days day weeks week months month years year degrees degree".split()


KEEP = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D"


def split_kept(text: F.Column, more: str = "") -> F.Column:
    """Words in lower case without signs; more: characters that stay, too."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, f"{KEEP}{more}]+", "")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def unmarked(text: F.Column) -> F.Column:
    """The text without characters that would pass for placeholders."""
    text = F.coalesce(text, F.lit(""))
    some = F.contains(text, F.lit(NUM)) | F.contains(text, F.lit(NAMED)) | F.contains(text, F.lit(UNIT))
    return F.when(some, F.regexp_replace(text, f"[{NUM}{NAMED}{UNIT}]", "")).otherwise(text)


def marked_words(text: F.Column) -> F.Column:
    """The words of a text in lower case without signs; a name, a number and a unit behind a number have their placeholder before them.

    A name is a capitalised word that doesn't begin a sentence.
    """
    t = F.regexp_replace(unmarked(text), r"(?<=[\p{L}\p{N},;)'])([\x20\x09-\x0D]+)(?=\p{Lu})", f"$1{NAMED}")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(\d[\d.,:/]*)", f"{NUM}$1")
    unit = f"(?i)({NUM}\\d[\\d.,:/]*[\\x20\\x09-\\x0D]*)({'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])"
    # A one-element array stands for a variable, so the text is worked out once.
    t = F.transform(F.array(t), lambda x: F.when(F.contains(x, F.lit(NUM)), F.regexp_replace(x, unit, f"$1{UNIT}$2")).otherwise(x))[0]
    return split_kept(t, NUM + NAMED + UNIT)


def template_word(word: F.Column, names: bool) -> F.Column:
    """A word of the template, from a marked one. names: a name is a slot, else its word."""
    name = F.lit(NAMED) if names else F.substring(word, 2, 1 << 30)
    return F.when(word < NUM, word).when(F.startswith(word, F.lit(NAMED)), name).when(is_slot(word), F.regexp_replace(word, f"{NUM}\\d*|(?<={UNIT}).*", NUM)).otherwise(word)


def is_slot(word: F.Column) -> F.Column:
    return F.substring(word, 1, 1).between(NUM, UNIT)


def is_name(word: F.Column) -> F.Column:
    return F.startswith(word, F.lit(NAMED))


def windows_of(rows: DataFrame, width: int) -> DataFrame:
    """Rows with marked words w, once for each window: at (counting from 1) and h, by the template, and where it has a name, also by that without names.

    Words are hashed first, in a step of their own: what follows is compiled, and a window's row is made only where it meets an item's.
    """
    t, p, at = (unique_name(rows, c) for c in ("_t", "_p", "_at"))
    plain = lambda w: F.when(is_name(w), F.xxhash64(template_word(w, False)))
    rows = rows.select("*", F.transform("w", lambda w: F.xxhash64(template_word(w, True))).alias(t), F.transform("w", plain).alias(p))
    # No filter by size: it would be pushed below and work the words out again.
    rows = rows.select("*", F.explode(F.when(F.size("w") >= width, F.sequence(F.lit(1), F.size("w") - width + 1))).alias(at))
    words = [(F.get(t, F.col(at) - 1 + k), F.get(p, F.col(at) - 1 + k)) for k in range(width)]
    h = F.xxhash64(*(x for x, _ in words))
    named = F.coalesce(*(y for _, y in words)).isNotNull()
    both = F.when(named, F.array(h, F.xxhash64(*(F.coalesce(y, x) for x, y in words)))).otherwise(F.array(h))
    return rows.select(*(c for c in rows.columns if c not in (t, p, at)), F.col(at).alias("at"), F.explode(both).alias("h"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item_id, ipos, h, width, slots (place in the window, value) and n_windows for each window of the benchmark with enough literal words.

    An item of SHORTEST words or more that is shorter than a window has one window of all its words.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").select("item_id", marked_words(F.col("text")).alias("w"))
    items = items.withColumn("width", F.least(F.lit(window), F.size("w"))).where(F.col("width") >= min(window, SHORTEST))
    items = items.withColumn("ipos", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1))).withColumn("named", F.explode(F.array(F.lit(True), F.lit(False))))
    items = items.withColumn("part", F.slice("w", F.col("ipos"), F.col("width")))
    slot = lambda x: F.when(F.col("named"), is_slot(x)).otherwise(is_slot(x) & ~is_name(x))
    word = lambda x: F.when(F.col("named"), template_word(x, True)).otherwise(template_word(x, False))
    items = items.withColumn("t", F.transform("part", word)).withColumn("s", F.transform("part", slot))
    items = items.where(F.size(F.filter("s", lambda x: ~x)) >= literals)
    h = F.lit(None).cast("long")
    for n in range(min(window, SHORTEST), window + 1):
        h = F.when(F.col("width") == n, F.xxhash64(*(F.xxhash64(F.get("t", F.lit(k))) for k in range(n)))).otherwise(h)
    slots = F.filter(F.transform("part", lambda x, k: F.struct(k.alias("k"), value_of(x).alias("v"), F.get("s", k).alias("s"))), lambda x: x["s"])
    slots = F.transform(slots, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    items = items.select("item_id", "ipos", "width", h.alias("h"), slots.alias("slots")).distinct()
    sizes = items.groupBy(F.col("item_id").alias("_item")).agg(F.countDistinct("ipos").alias("n_windows"))
    return items.join(sizes, F.col("item_id") == F.col("_item")).drop("_item")


def value_of(word: F.Column) -> F.Column:
    """What stands in the text at a marked word."""
    return F.regexp_replace(word, f"[{NUM}{NAMED}{UNIT}]", "")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, enough: int = ENOUGH) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, n_slots, n_changed for each item that a document holds.

    share, enough: the part of an item's windows that a document must have, and the number that is enough of any item. Null and empty texts
    hold nothing. An item shorter than a window is sought by its whole template; of fewer than SHORTEST words, or without a window
    of enough literal words, it can't be told from chance and is not sought. Items with equal texts are each reported.
    A document that holds an item several times, with other values each time, is judged by each alignment; the figures are those of all matches
    if these are consistent, else of the alignment with the most windows. Rows with one doc_id and the same text are reported once; null ids are ids. Texts are read whole. Empty tables: no rows. Other columns are not read.

    The documents' windows meet the benchmark's where they are made, while the benchmark is small enough to broadcast; only
    matches, with the words of their windows, are shuffled, by document and item, and a group holds an item's windows at most.
    """
    index = materialise(item_windows(benchmark, window, literals), "items")
    widths = {r["width"]: r["n"] for r in index.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most WINDOW rows
    near = sum(widths.values()) <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), marked_words(F.col("text")).alias("w"))  # texts that share an id are told apart
    key, held = ["doc_id", "th", "item_id"], None
    for width in sorted(widths) or [window]:
        of_width = index.where(F.col("width") == width).drop("width")
        found = windows_of(rows, width)
        if near:
            found = found.join(F.broadcast(of_width), "h").withColumn("part", F.slice("w", F.col("at"), width))
        else:
            found = found.withColumn("part", F.slice("w", F.col("at"), width)).drop("w").join(of_width, "h")
        values = F.transform("slots", lambda s: F.struct(s["v"].alias("v"), value_of(F.get(F.col("part"), s["k"])).alias("d")))
        found = found.select(*key, "n_windows", F.struct("ipos", (F.col("at") - F.col("ipos")).alias("shift"), values.alias("pairs")).alias("m"))
        held = found if held is None else held.unionByName(found)
    held = held.groupBy(*key).agg(F.max("n_windows").alias("n_windows"), F.collect_set("m").alias("x"))
    held = held.withColumn("n_matched", F.size(F.array_distinct(F.transform("x", lambda x: x["ipos"]))).cast("long"))
    n = F.col("n_windows")
    least = F.when(n <= FEWEST, n).otherwise(F.least(F.lit(enough), F.greatest(F.lit(FEWEST), F.ceil(n * share))))
    held = held.where(F.col("n_matched") >= least)
    held = held.select(*key, "n_windows", F.explode("x").alias("x"))
    shift = F.col("x.shift")
    group = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    groups = F.array(group(0, F.lit(0)), group(1, shift), group(2, F.floor(shift / BAND)), group(3, F.floor((shift + BAND // 2) / BAND)))  # all, one shift, bands
    held = held.select(*key, "n_windows", F.explode(groups).alias("g"), "x.ipos", "x.pairs").groupBy(*key, "g").agg(F.max("n_windows").alias("n_windows"), F.size(F.collect_set("ipos")).cast("long").alias("n_matched"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    held = held.where(F.col("n_matched") >= least).withColumn("values", F.array_distinct(F.transform("pairs", lambda p: p["v"])))
    steady = F.size(F.filter("values", lambda v: F.size(F.filter("pairs", lambda p: p["v"] == v)) == 1))
    held = held.where(steady >= CONSISTENT * F.size("values"))
    changed = F.size(F.filter("pairs", lambda p: p["v"] != p["d"])).cast("long")
    best = F.min(F.struct((F.col("g.kind") > 0).alias("part"), (-F.col("n_matched")).alias("less"), changed.alias("n_changed"), F.size("values").cast("long").alias("n_slots"))).alias("b")
    held = held.groupBy(*key).agg(F.max("n_windows").alias("n_windows"), best).withColumn("n_matched", -F.col("b.less"))
    return held.select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / n).alias("coverage"), "b.n_slots", "b.n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    leaked = unique_name(docs, "_leaked")
    ids = materialise(find_leaks(docs, benchmark).select(F.col("doc_id").alias(leaked)).distinct(), "leaked")
    if ids.count() <= BROADCAST_IDS:  # else both sides are shuffled
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
