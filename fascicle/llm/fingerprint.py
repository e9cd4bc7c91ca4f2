"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A text is a sequence of units: words of up to ``LONGEST`` characters, and each single
character of longer runs without white space and of scripts that are written without
it, so that no unit depends on where in a run it stands.
A k-mer of ``K`` units is an anchor when the least of its inner s-mers (``S`` units,
by hash) is its first or its last. Whether a k-mer is an anchor depends on nothing
outside it, so equal passages give equal anchors wherever they stand. All anchors are
kept, each with its place. A fingerprint is the set of a text's anchor hashes, 32 bits
each, however long the text is: printed, they stand in order, eight hex digits each.
The likeness of two fingerprints is the Jaccard similarity of these sets. Where texts
match is told by places: each shared hash, at its first place in either text, votes for
the shift between the two, and the shift with most votes is that of the aligned passage.

Null texts count as empty. In a text without any anchor, such as one of fewer than
``K`` units, each unit is one; a blank text has a fixed one. Equal texts have equal fingerprints.
The next document goes by descending id, null ids last, equal ids by text hash;
after the last comes the first. One document alone is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fascicle.llm.common import partitions, text_of

K, S = 5, 2
LONGEST = 24
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
_WORD = rf"[^\s{_UNSPACED}]"
_UNIT = rf"(?<!{_WORD}){_WORD}{{1,{LONGEST}}}+(?!{_WORD})|\S"


def _units(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0)), lambda u: F.xxhash64(u))


def _inner(units: Column) -> Column:
    """The hash of each s-mer."""
    return F.when(F.size(units) >= S, F.transform(F.sequence(F.lit(0), F.size(units) - S), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(S)])))


def with_anchors(df: DataFrame, text: Column, out: str = "anchors") -> DataFrame:
    """``df`` with the anchors of ``text`` in order: structs of the unit at which each starts and its hash."""
    spread = K - S
    df = df.withColumn("__units", _units(text)).withColumn("__inner", _inner(F.col("__units")))
    inner, units = F.col("__inner"), F.col("__units")
    least = lambda i: F.least(*[F.get(inner, i + j) for j in range(spread + 1)])
    edge = lambda i: least(i) == F.least(F.get(inner, i), F.get(inner, i + spread))
    # The s-mers at every second unit cover an odd K but for its last unit.
    anchor = lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(inner, i + j) for j in range(0, spread + 1, S)], F.get(units, i + K - 1)).alias("hash"))
    several = F.transform(F.filter(F.sequence(F.lit(0), F.size(units) - K), edge), anchor)
    df = df.withColumn(out, F.when(F.size(units) >= K, several))
    each = F.transform(units, lambda u, i: F.struct(i.alias("at"), F.xxhash64(u).alias("hash")))
    blank = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.lit("")).alias("hash")))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).when(F.size(units) > 0, each).otherwise(blank)).drop("__units", "__inner")


def fingerprint(anchors: Column) -> Column:
    """The distinct anchor hashes, 32 bits each, in order."""
    return F.array_sort(F.array_distinct(F.transform(anchors, lambda a: F.shiftright(a["hash"], 32).cast("int"))))


def printed(fingerprint: Column) -> Column:
    """Eight hex digits for each of its hashes."""
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.substring(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)), 2, 8)))


def likeness(a: Column, b: Column) -> Column:
    """The share of the hashes of either fingerprint that are in both."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def with_aligned(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the shift of places from anchors ``a`` to ``b`` at which most shared hashes stand, and how many; of equal ones the least shift. Null without a shared hash."""
    # Sorted by hash; of each text's places the first stands next to the other text's: descending in ``a``, ascending in ``b``.
    side = lambda c, k: F.transform(c, lambda x: F.struct(x["hash"].alias("hash"), F.lit(k).alias("side"), (x["at"] if k else -x["at"]).alias("at")))
    df = df.withColumn("__both", F.sort_array(F.concat(side(a, 0), side(b, 1))))
    both = F.col("__both")
    meets = lambda x, i: (x["side"] == 0) & (F.get(both, i + 1)["side"] == 1) & (F.get(both, i + 1)["hash"] == x["hash"])
    shifts = F.transform(both, lambda x, i: F.when(meets(x, i), F.get(both, i + 1)["at"] + x["at"]))
    df = df.withColumn("__shifts", F.sort_array(F.array_compact(shifts)))
    shifts = F.col("__shifts")
    df = df.withColumn("__starts", F.when(F.size(shifts) > 0, F.filter(F.sequence(F.lit(0), F.size(shifts) - 1), lambda i: (i == 0) | (F.get(shifts, i) != F.get(shifts, i - 1)))))
    starts = F.col("__starts")
    runs = F.transform(starts, lambda i, k: F.struct((F.coalesce(F.get(starts, k + 1), F.size(shifts)) - i).alias("anchors"), (-F.get(shifts, i)).alias("back")))
    df = df.withColumn("__most", F.array_max(runs))
    return df.withColumn(out, F.when(F.col("__most").isNotNull(), F.struct((-F.col("__most")["back"]).alias("shift"), F.col("__most")["anchors"].alias("anchors")))).drop("__both", "__shifts", "__starts", "__most")


def with_next(df: DataFrame, key: str, columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``df``, as ``prepare`` extends it, with ``next_`` and the name of each of ``columns``: their values in the next row by descending key.

    Rows go to buckets between quantiles of the key, each sorted alone. The first row
    of each bucket is also put at the end of the bucket before it, so one shuffle and
    no global sort are enough.
    """
    spark = df.sparkSession
    # The bounds are part of the plan, so there are at most 4096.
    n = min(4096, max(64, 4 * partitions(df)))
    df = df.withColumn("__id", F.coalesce(F.col(key), F.lit(-(1 << 63)))).withColumn("__tie", F.xxhash64("text"))
    ids = df.select("__id")
    bounds = sorted({int(x) for x in ids.select(F.col("__id").cast("double")).approxQuantile("__id", [i / n for i in range(1, n)], 0.2 / n)})
    # As many buckets as bounds: driver-made, a few for each shuffle partition.
    bucket = lambda c: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= c)) if bounds else F.lit(0)
    tops = sorted((r[0], r[1]) for r in ids.groupBy(bucket(F.col("__id")).alias("b")).agg(F.max("__id").alias("top")).collect())
    # The top row of each bucket serves the bucket above it; the highest serves the lowest, as the last of all.
    follows = [(top, tops[(i + 1) % len(tops)][0], i + 1 == len(tops)) for i, (_, top) in enumerate(tops)]
    light = df.columns
    own = df.select(*light, bucket(F.col("__id")).alias("__bucket"), F.lit(False).alias("__lent"), F.lit(0).alias("__last"))
    if follows:
        served = F.broadcast(spark.createDataFrame(follows, "__id long, __bucket int, __wraps boolean"))
        first = Window.partitionBy("__id").orderBy("__tie")
        lent = df.join(served, "__id").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
        own = own.unionByName(lent.select(*light, "__bucket", F.lit(True).alias("__lent"), F.col("__wraps").cast("int").alias("__last")))
    # One shuffle, of the columns given; what ``prepare`` adds is made where the rows have arrived, each row once.
    own = own.repartition("__bucket")
    order = Window.partitionBy("__bucket").orderBy("__last", F.desc("__id"), "__lent", "__tie")
    # Lent rows sort behind every row of the bucket that borrows them: their ids are lower, or they wrap around.
    out = prepare(own).select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where(~F.col("__lent"))
    return out.drop("__id", "__tie", "__bucket", "__lent", "__last")


def compare_edited(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each text's fingerprint beside that of the text whose later half is replaced from the next document."""
    docs = df.select(F.col(key), text_of().alias("text"))
    pairs = with_next(docs, key, ["text", "own"], lambda x: with_anchors(x, F.col("text"), "own")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    pairs = pairs.select(key, "n_chars", "own", "next_own", edited.alias("edited"))
    pairs = with_anchors(pairs, F.col("edited"), "edited_own")
    pairs = with_aligned(with_aligned(pairs, "own", "edited_own", "aligned_edited"), "own", "next_own", "aligned_next")
    for side in ("own", "edited_own", "next_own"):
        pairs = pairs.withColumn(f"f_{side}", fingerprint(F.col(side)))
    return pairs.select(
        key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("f_own")).alias("fingerprint"), printed(F.col("f_edited_own")).alias("edited_fingerprint"),
        likeness(F.col("f_own"), F.col("f_edited_own")).alias("near_edited"), likeness(F.col("f_own"), F.col("f_next_own")).alias("near_next"), F.col("own").alias("anchors"), "aligned_edited", "aligned_next",
    )
