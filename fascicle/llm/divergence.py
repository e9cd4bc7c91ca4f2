"""How the sources of a language differ in their words.

Terms are runs of letters (A to Z or outside ASCII), A to Z as a to z. A language keeps
the V terms that stand in at least ``LEAST_DOCS`` of its documents. A group, that is a
language's source, or the language itself, gives each kept term the share
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), with N all its counts of kept
terms. All arithmetic is in whole numbers.

The distance of two sources is the sum of |p - q| over all kept terms. It is found by
inclusion and exclusion over the supports, the terms that a group has at all. With p0
for a term that a group lacks, and z = |p0 - q0|:

* each group's histogram of counts prices its support against the other's q0, as if the
  other had none of these terms (one sorted pass of running sums for each group);
* terms that both have are met through the postings of each term, and correct what the
  two prices say of them: |p - q| - |p - q0| - |p0 - q| + z;
* every other term, in neither support, costs the constant z:
  (V - |support| - |other support|) * z, with the overlap put right by the z above.

Texts are counted in the task before anything is shuffled. Postings are dealt by
language, block of up to ``BLOCK`` sources against another, and a hash of the term, so
that common terms spread over tasks; a task adds its corrections up in one table of
pairs. Pairs leave a task as sums only.

Null text, language or source count as empty. A group without any letter, or a language
without kept terms, has its distances (0 in the latter) and no terms. Empty tables give
an empty result. Rows that repeat count each time. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fascicle.llm.common import cut, text_of, trim

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sources of one side of a block of pairs, and postings that are meant for one block and hash.
BLOCK, POSTINGS = 128, 500_000
#: Different terms of all groups that a task counts before it hands them on, and bytes of a text that it takes apart at a time.
HELD, PIECE = 200_000, 1 << 20
TERM = re.compile(rb"[a-z\x80-\xff]+")


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of about ``PIECE`` bytes that cut no term."""
    at = 0
    while at < len(text):
        end = at + PIECE
        inside = TERM.match(text, end)
        end = inside.end() if inside else end
        yield text[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in _pieces(text.lower()):  # of bytes: A to Z only
                words = TERM.findall(piece)
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) >= HELD:
            yield from _counted(held)
            held = {}
    yield from _counted(held)
    trim()


def _counted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        for s in range(0, len(terms), 1 << 15):
            part = terms[s : s + (1 << 15)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part)),
                    pa.array([source] * len(part)),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in part]),
                    pa.array([docs[t] for t in part]),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def postings(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, lead) of every kept term and source that has it: its counts in the source and the language; ``lead`` marks one row of each term."""
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Dealt by term once: tasks have counted already, and both sums below need no further shuffle.
    whole = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    out = whole.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("lead"))
    return out.where(F.col("docs") >= least_docs).drop("docs")


def share(n: F.Column, all_: F.Column, terms: F.Column) -> F.Column:
    """p of a count among all counts of a group over so many terms; 1 where there are no terms at all."""
    whole = lambda c: c.cast("decimal(20,0)")
    below = whole(all_) + whole(terms) * F.lit(PRIOR)
    # Quotients of whole numbers in 38 digits: exact.
    times = (whole(n) + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(12,0)")
    return F.lit(1).cast("long") + F.coalesce(F.call_function("div", times.cast("decimal(38,0)"), F.nullif(below, F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)")), F.lit(0).cast("long"))


def groups(docs: DataFrame, posted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring (lang, source) with N, its support, p0, the language's V and N, and the source's block among its language's blocks."""
    there = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
    own = posted.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("support"))
    whole = posted.where("lead").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole"))
    out = there.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["own", "support", "terms", "whole"])
    # A row for each source: a language's sources, not its documents.
    by = Window.partitionBy("lang")
    nth = F.row_number().over(by.orderBy("source")) - 1
    blocks = F.ceil(F.count("*").over(by) / BLOCK).cast("int")
    return out.select("*", share(F.lit(0), F.col("own"), F.col("terms")).alias("p0"), F.floor(nth / BLOCK).cast("int").alias("block"), blocks.alias("blocks"))


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a group's support costs against each group of a block that has none of it, and, once for a pair, the constant of the terms that neither has."""
    for b in batches:
        for lang, source, p0, support, terms, bins, others in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "p0", "support", "terms", "bins", "others"))):
            p, k = (np.array([x[c] for x in bins or []], np.int64) for c in ("p", "k"))
            below, many = np.concatenate([[0], np.cumsum(p * k)]), np.concatenate([[0], np.cumsum(k)])
            others = [o for o in others if o["source"] != source]
            q0, size = (np.array([o[c] for o in others], np.int64) for c in ("p0", "support"))
            at = np.searchsorted(p, q0)
            value = q0 * many[at] - below[at] + (below[-1] - below[at]) - q0 * (many[-1] - many[at])
            names = [o["source"] for o in others]
            value += np.where([source < n for n in names], (terms - support - size) * np.abs(p0 - q0), 0)
            pairs = [(min(source, n), max(source, n)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs), pa.string()), pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])


def _corrections(t: pa.Table) -> pa.Table:
    """The corrections of the terms of one hash, for the pairs of two blocks of sources, added up."""
    lang, lo, hi = (t.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
    term = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    block, p, p0 = (t.column(c).to_numpy() for c in ("block", "p", "p0"))
    coded = t.column("source").combine_chunks().dictionary_encode()
    names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sums = np.zeros((len(names), len(names)), np.int64)
    order = np.argsort(term, kind="stable")
    bounds = np.flatnonzero(np.diff(term[order])) + 1
    for rows in np.split(order, bounds):
        if len(rows) < 2:
            continue
        left, right = (rows, rows) if lo == hi else (rows[block[rows] == lo], rows[block[rows] == hi])
        x, x0, y, y0 = p[left, None], p0[left, None], p[right], p0[right]
        sums[source[left, None], source[right]] += np.abs(x - y) - np.abs(x - y0) - np.abs(x0 - y) + np.abs(x0 - y0)
    if lo == hi:
        sums = np.triu(sums, 1)
    i, j = np.nonzero(sums)
    pairs = [(min(names[a], names[b]), max(names[a], names[b])) for a, b in zip(i, j)]
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "a": pa.array([x for x, _ in pairs], pa.string()), "b": pa.array([y for _, y in pairs], pa.string()), "value": pa.array(sums[i, j])})


_PAIRS = "lang string, a string, b string, value long"


def distances(posted: DataFrame, grouped: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language."""
    spark = posted.sparkSession
    priced = posted.join(grouped, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("own"), F.col("terms")))
    bins = priced.groupBy("lang", "source", "n").agg(F.count("*").alias("k"), F.first("p").alias("p"))
    # As many entries as a group has different counts.
    bins = bins.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("p", "k"))).alias("bins"))
    targets = grouped.groupBy("lang", "block").agg(F.collect_list(F.struct("source", "p0", "support")).alias("others"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = grouped.join(bins, ["lang", "source"], "left").select("lang", "source", "p0", "support", "terms", "bins", every.alias("block"))
    one = sides.join(targets, ["lang", "block"]).mapInArrow(_prices, _PAIRS)

    most = grouped.agg(F.max("terms")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), most * 2 * BLOCK // POSTINGS)
    met = priced.select("lang", "source", "term", "p", "p0", "block", every.alias("other"), F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"))
    met = met.select("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "part", "term", "source", "block", "p", "p0")
    both = met.groupBy("lang", "lo", "hi", "part").applyInArrow(_corrections, _PAIRS)
    return one.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def telling_terms(posted: DataFrame, grouped: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` terms of which a source has most more than its language, in share."""
    rows = posted.join(grouped, ["lang", "source"])
    over = share(F.col("n"), F.col("own"), F.col("terms")) - share(F.col("total"), F.col("whole"), F.col("terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where(F.col("value") > 0)
    return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): in part ``pair`` every other source of the language by distance, in part ``term`` the telling terms."""
    posted = cut(postings(docs, lang, source, text, least_docs))
    grouped = cut(groups(docs, posted, lang, source))
    pairs = distances(posted, grouped)
    side = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    both = pairs.select("lang", "value", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s"))
    far = _ranked(both.select("lang", F.col("s.source").alias("source"), F.col("s.item").alias("item"), "value"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return far.withColumn("part", F.lit("pair")).select(columns).unionByName(telling_terms(posted, grouped, top).withColumn("part", F.lit("term")).select(columns))
