"""Exact deduplication, source divergence and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fascicle.llm import codebooks, divergence, exact, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_groups(rows):
    """Rows (key, text) to (key, keep, size, kept, digest), sorted."""
    held = {}
    for key, text in rows:
        held.setdefault(text or "", []).append(key)
    out = []
    for text, keys in held.items():
        keys = sorted(keys, key=lambda k: (k is not None, k), reverse=True)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, keys[0], len(keys), i == 0, sha) for i, k in enumerate(keys)]
    return sorted(out, key=str)


def found_groups(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def awkward(n=600):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a ", "A", "é", "é", "x" * 200_000, "x" * 200_000 + "y", *(f"text {i}" for i in range(60))]
    rows = [(i, rng.choice(texts)) for i in range(n)]
    # Nulls, rows that repeat, one id with two texts, a hot group.
    return rows + [(None, "a"), (None, "a"), (None, "only null ids"), (7, "twice"), (7, "twice"), (7, "other"), *((1000 + i, "hot") for i in range(n))]


@pytest.mark.parametrize("table_bytes", [1, 500, exact.TABLE_BYTES])
def test_groups_of_equal_texts(spark, table_bytes):
    # A table of a byte holds one text: everything else is spilled, level by level.
    rows = awkward() if table_bytes > 1 else awkward()[-40:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_groups(exact.groups(df, table_bytes=table_bytes)) == plain_groups(rows)


def test_equal_texts_with_text_keys_and_clashing_columns(spark):
    rows = [("b", "t", 1, 2, 3), ("a", "t", 4, 5, 6), (None, None, 7, 8, 9), ("c", "", 1, 1, 1)]
    df = spark.createDataFrame(rows, "key string, content string, record long, hash long, `rows` long")
    got = {tuple(r) for r in exact.representatives(df, "key", "content").collect()}
    assert got == {("b", "t", 1, 2, 3), ("c", "", 1, 1, 1)}
    same = {(r["key"], r["keep_id"], r["kept"]) for r in exact.groups(df, "key", "content").collect()}
    assert same == {("b", "b", True), ("a", "b", False), (None, "c", False), ("c", "c", True)}
    only = spark.createDataFrame([(None, None, 1, 1, 1)], df.schema)
    assert exact.representatives(only, "key", "content").collect() == only.collect()


def test_representatives_keep_one_row_of_each_text(spark):
    rows = awkward()
    df = spark.createDataFrame([(k, t, "en", None, i) for i, (k, t) in enumerate(rows)], SCHEMA)
    got = exact.representatives(df).collect()
    assert sorted((r["text"] or "") for r in got) == sorted({t or "" for _, t in rows})
    assert {(r["doc_id"], r["text"]) for r in got} <= set(rows)
    assert exact.representatives(df.where("false")).count() == 0 and exact.groups(df.where("false")).count() == 0


def test_content_table_settles_what_hashes_do_not():
    table = exact.ContentTable()
    names = [f"{i}".encode() for i in range(5000)]
    for i, t in enumerate(names):
        at = table.find(i % 3, t)
        assert at < 0 and table.add(-1 - at, i % 3, t) == i
        if i == 1500:
            break
    assert all(table.find(i % 3, t) == i for i, t in enumerate(names[:1501]))
    assert table.find(0, b"1") < 0 and 2 * len(table.texts) <= len(table.slots)


def plain_audit(rows, least=30, top=50):
    """Whole-number definition, term by term."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        v = len(kept)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}

        def shares(c):
            n = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept]

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            far = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o]))) for o in counts if o != s]
            near = [(t, a - b) for t, a, b in zip(kept, p[s], q) if counts[s][t] and a > b]
            for part, items, most in (("pair", far, len(far)), ("term", near, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def odd_corpus(n=400):
    rng = random.Random(5)
    words = ["the", "The", "THE", "é", "É", "don't", "x1y", "中文", "ﬁ", "K", "K", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None, "é", "z"])
        rows.append((lang, source, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60)))))
    # A group without terms, a language without kept terms and one without letters, equal texts, a long one.
    return rows + [("en", "silent", "1 2 3"), ("en", "nothing", None), ("fr", "a", "un mot"), ("fr", "b", "deux"), ("fr", None, ""), ("zz", "only", ""), ("en", "a", "the " * 30_000), *[("en", "b", "same same text")] * 40]


@pytest.mark.parametrize("block", [2, divergence.BLOCK])
def test_divergence_like_the_plain_sums(spark, monkeypatch, block):
    rows = odd_corpus()
    monkeypatch.setattr(divergence, "BLOCK", block)
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (lang, s, t) in enumerate(rows)], SCHEMA).repartition(3)
    clash = df.withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("value", F.lit(2.0))
    assert audit_rows(divergence.audit(clash)) == plain_audit(rows)


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(none).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert divergence.audit(one).collect() == []
    two = spark.createDataFrame([(1, None, None, "a", None), (2, "words", None, None, None)], SCHEMA)
    assert audit_rows(divergence.audit(two)) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_divergence_counts_in_pieces(monkeypatch):
    text = ("Ab é1 " * 500 + "z" * 3000 + " end").encode()
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert b"".join(divergence._pieces(text)) == text
    assert [w for p in divergence._pieces(text.lower()) for w in divergence.TERM.findall(p)] == divergence.TERM.findall(text.lower())
    monkeypatch.setattr(divergence, "HELD", 3)
    batch = lambda s: pa.RecordBatch.from_arrays([pa.array([s] * 2), pa.array(["s", "t"]), pa.array([b"a b C", b"b 9 a a"])], ["lang", "source", "text"])
    got = Counter()
    for b in divergence._count(iter([batch("x"), batch("y"), batch("x")])):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert got["x", "t", "a"] == 4 and got["x", "t", "a", "docs"] == 2 and got["y", "s", "c"] == 1


def test_shares_beyond_longs(spark):
    n, all_, terms = 9 * 10**17, 9 * 10**18, 123_457
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(all_), F.lit(terms))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (all_ + 5 * terms)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(key, label, vector) rows to {row: ...} by plain rounds of Python's integers."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    xs = [[math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in r[2]] for r in kept]
    d = len(xs[0]) // parts
    cut = [[x[j * d : (j + 1) * d] for j in range(parts)] for x in xs]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        codes = [[min((gap(c[j], e), i) for i, e in enumerate(books[j])) for j in range(parts)] for c in cut]
        if r < rounds:
            for j in range(parts):
                for i in range(len(books[j])):
                    mine = [c[j] for c, code in zip(cut, codes) if code[j][1] == i]
                    if mine:
                        books[j][i] = [sum(col) // len(mine) for col in zip(*mine)]
    errors = [sum(e for e, _ in code) for code in codes]
    shared = Counter()
    for r, e in zip(kept, errors):
        shared[r[1]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in code), e, shared[r[1]], sha) for r, code, e in zip(kept, codes, errors))


def codes_of(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(k, v, label) for k, label, v in rows], schema).repartition(3)


def test_codes_like_plain_rounds(spark):
    rng = np.random.default_rng(6)
    # Coarse steps make ties; some vectors repeat, a label is hot, one is null.
    rows = [(i, [None, 1, 1, 1, 2][i % 5], [float(x) / 8 for x in rng.integers(-3, 4, 16)]) for i in range(900)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(300)] + [(5, 1, rows[5][2]), (None, 2, rows[9][2])]
    bad = [(2000, 1, None), (2001, 1, [float("nan")] + [0.0] * 15), (2002, 1, [float("inf")] + [0.0] * 15), (2003, 1, [None] + [0.0] * 15), (2004, 1, [0.5] * 8)]
    got = codes_of(codebooks.compress(vectors(spark, rows + bad).withColumn("key", F.lit(1)).withColumn("code", F.lit("x"))))
    assert got == plain_codes(rows)


@pytest.mark.parametrize("size", [3e3, 1e6, 1e12, 3e37])
def test_codes_of_large_components(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(size=8) * size]) for i in range(60)]
    fits = lambda v: v if v < 1 << 63 else None
    want = [(k, c, fits(e), fits(s), h) for k, c, e, s, h in plain_codes(rows)]
    assert codes_of(codebooks.compress(vectors(spark, rows))) == want


def test_codes_of_few_and_no_vectors(spark):
    few = [(3, None, [1.0] * 8), (1, None, [-1.0] * 8)]
    assert codes_of(codebooks.compress(vectors(spark, few))) == plain_codes(few)
    assert codebooks.compress(vectors(spark, few).where("false")).collect() == []
    assert codebooks.compress(vectors(spark, [(1, 1, None)])).collect() == []
    with pytest.raises(ValueError):
        codebooks.compress(vectors(spark, [(1, 1, [1.0] * 9)]))


def test_bounds_spare_distances_and_codes_decode(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(size=(16, 16))
    rows = [(i, 0, (near[i % 16] + 0.05 * rng.normal(size=16)).astype("f4").tolist()) for i in range(2000)]
    df = vectors(spark, rows)
    books, coded = codebooks.train(df)
    assert books.scanned < books.possible / 2
    again = {r["vec_id"]: r["code"] for r in codebooks.encode(df, books).collect()}
    assert again == {r["key"]: r["code"] for r in coded.collect()}
    back = {r["vec_id"]: r["vector"] for r in codebooks.decode(codebooks.encode(df, books), books).collect()}
    assert np.mean([np.linalg.norm(np.array(back[k]) - v) for k, _, v in rows]) < 0.3


@pytest.mark.parametrize("name", ["op11_divergence", "op12_exact_dedup", "op13_codes"])
def test_sql_says_the_same_of_awkward_tables(spark, tmp_path, name):
    rng = np.random.default_rng(9)
    docs = [(k, t, lang, s, None) for (lang, s, t), (k, _) in zip(odd_corpus(), awkward())] + [(k, t, "en", None, None) for k, t in awkward()[-60:]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, i % 3 or None, rng.integers(-2, 3, 64).astype(float).tolist()) for i in range(300)]
    vectors(spark, [*rows, (500, 1, None), (501, 1, [float("nan")] * 64)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    rel = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    key = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), rel.columns)
