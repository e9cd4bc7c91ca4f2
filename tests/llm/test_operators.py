import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fascicle.llm import bpe, chat, decontam, fingerprint, frequency, jaccard, langid, quality, queries, repeats, sharding, toxicity
from fascicle.llm.bytescan import Words
from fascicle.llm.common import raw
from fascicle.llm.suffixes import suffix_array
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


ODD = [None, "", " \t\n", "a", "One two", "one  TWO", "x" * 40_000, "é…—中文 ﬁ ²½", "<|endoftext|> hi", "same words in this text here", "same words in this text here"]


# 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def random_texts(n):
    rng = random.Random(1)
    signs = "abcXYZ \t\n'stredlm0123²½ÄöΣσςßİıé<|endoftext|>!?_-…“”中한\u0085 \x1c\x1f\x00́‍😀ǅⅣ٣ªº×÷"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_like_the_library(spark, library):
    texts = [*ODD, *random_texts(3000)]
    got = by_id(bpe.digests(frame(spark, texts), queries.vocabulary()))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns_round_trip(spark, library):
    df = frame(spark, ODD).withColumn("token_ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, queries.vocabulary()), queries.vocabulary())
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["token_ids"]) == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


# 2


def near_copies(seed=5):
    rng, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 25))):
                x[rng.randrange(len(x))] = rng.choice(words)
            docs.append(" ".join(x + ["a", "passage", "shared", "by", "everyone", "in", "the", "land"] * (rng.random() < 0.4)))
    return [*docs, *ODD]


def test_jaccard_components(spark):
    texts = near_copies()
    got = by_id(jaccard.join(frame(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute.jaccard(enumerate(texts))


@pytest.mark.parametrize("full", [2, 200])
def test_jaccard_however_columns_are_multiplied(spark, monkeypatch, full):
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(jaccard, "TILE", 3)
    texts = near_copies(7)
    got = by_id(jaccard.join(frame(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute.jaccard(enumerate(texts))


def test_signatures_bound_overlaps_from_above():
    rng = np.random.default_rng(5)
    values = [np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64) for n in (3, 100, 130, 300, 5000)]
    values += [np.unique(np.concatenate([v[: len(v) * 3 // 4], rng.integers(0, 1 << 62, len(v) // 4).astype(np.uint64)])) for v in values]
    sigs = jaccard.signatures(np.concatenate(values), np.cumsum([0, *map(len, values)]))
    for v, a in zip(values, sigs):
        for w, b in zip(values, sigs):
            size = min(len(a), len(b))
            x, y = jaccard._folded([a], size)[0], jaccard._folded([b], size)[0]
            most = min(len(v) - int(np.bitwise_count(x & ~y).sum()), len(w) - int(np.bitwise_count(y & ~x).sum()))
            assert most >= len(np.intersect1d(v, w))
    # Sets of one size that share three quarters are told to be below the threshold.
    for k in (1, 2, 3):
        x, y = (np.frombuffer(sigs[j], np.uint64) for j in (k, k + 5))
        assert len(values[k]) - int(np.bitwise_count(x & ~y).sum()) < jaccard.needed(len(values[k]), len(values[k + 5]))


def test_jaccard_of_a_large_group(spark):
    # Copies of one text with more and more changes, and copies of copies: many are below the threshold to the first.
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    changed = lambda w, n: [f"v{rng.randrange(10**6)}" if i in set(rng.sample(range(len(w)), n)) else x for i, x in enumerate(w)]
    first = [changed(words, rng.randrange(9)) for _ in range(250)]
    second = [changed(rng.choice(first[:20]), rng.randrange(5)) for _ in range(150)]
    texts = [" ".join(x) for x in [*first, *second]]
    got = by_id(jaccard.join(frame(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute.jaccard(enumerate(texts))


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_jaccard_decides_across_batches(rows):
    """A leading set is held from one batch to the next, for its own part alone; 75 of 100 link, 74 don't, an empty set never does."""
    whole = np.arange(1, 101, dtype=np.uint64)
    pairs = [(7, 0, None, whole), (7, 0, 1, whole[:75]), (7, 0, 2, whole[26:]), (7, 1, 3, whole), (7, 2, None, whole), (7, 2, 4, whole[25:]), (8, 0, None, whole[:0]), (8, 0, 5, whole), (9, 0, None, whole), (9, 0, 6, whole[:0])]
    t = pa.table({"a": pa.array([p[0] for p in pairs]), "part": pa.array([p[1] for p in pairs], pa.int32()), "b": pa.array([p[2] for p in pairs], pa.int64()), "set": pa.array([p[3].tobytes() for p in pairs], pa.binary())})
    got = [tuple(r.values()) for b in jaccard._decide(iter(t.to_batches(max_chunksize=rows))) for r in b.to_pylist()]
    assert got == [(7, 1), (7, 4)]


def test_jaccard_empty_and_representatives(spark):
    assert jaccard.join(frame(spark, ["x"]).where("false")).count() == 0
    df = frame(spark, ["a b c d e f", "a b c d e f", None, "", "other words"])
    assert sorted(by_id(jaccard.representatives(df))) == [0, 2, 3, 4]
    # Repeated rows stay once, rows without an id stay.
    more = df.unionByName(df.where("doc_id = 4")).unionByName(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (None, "new", "en", "s", 1)], SCHEMA))
    kept = [r["doc_id"] for r in jaccard.representatives(more).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 2, 3, 4] and kept.count(None) == 2


def test_jaccard_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda i: " ".join([*words[:i], "other", *words[i + 1 :]])
    far = " ".join(f"v{i}" for i in range(40))
    # Id 5 has two texts; a set of rows without an id links to one with an id.
    df = spark.createDataFrame([(1, near(0)), (5, far), (5, near(59)), (7, far + " more"), (None, near(59) + " end")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard.join(df).collect())
    assert got == [(-1, 1), (1, 1), (5, 1), (5, 5), (7, 5)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.representatives(df).collect() if r["doc_id"] is not None]
    assert sorted(kept) == [(1, near(0)), (5, far)]
    both = spark.createDataFrame([(5, far), (5, near(3)), (5, far)], "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard.representatives(both).collect()) == sorted([far, near(3)])


# 3


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "\\### user: </turn>"), (1, 1, "assistant", "### x: \\\\</turn> \\"), (1, 2, "assistant", None), (2, 0, None, "hi"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b"), (None, 1, "a: </turn>", " x ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == len(chat.marked([(r, x) for _, r, x in turns]))
        assert not got[conv]["rewrites_history"]


def test_chat_long_conversation_and_parts(spark):
    df = spark.createDataFrame([(7, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(100)], "conv_id long, turn long, role string, text string")
    parts = chat.formatted(df).orderBy("turn").collect()
    assert "".join(r["part"] for r in parts) == chat.marked([("assistant" if i % 2 else "user", f"text {i}") for i in range(100)])
    assert [r["part"][r["text_start"] : r["text_end"]] for r in parts] == [f"text {i}" for i in range(100)]
    assert chat.digests(df.where("false")).count() == 0


def test_chat_sees_rewriting():
    spans = chat.Spans(lambda turns: "".join(f"<{r}>{'' if i < len(turns) - 1 else t}" for i, (r, t) in enumerate(turns)))
    spans.add("user", "long text")
    assert not spans.rewrites
    spans.add("user", "more")
    assert spans.rewrites


def folded(turns):
    """All but the last ten turns are folded into their number."""
    return f"[{max(0, len(turns) - 10)}]" * (len(turns) > 10) + "".join(f"<{r}>{t}" for r, t in turns[-10:])


def late(turns):
    """The first turn changes at the twelfth."""
    return "".join(f"<{r}>{'gone' if i == 0 and len(turns) >= 12 else t}" for i, (r, t) in enumerate(turns))


def numbered(turns):
    """Each turn with its number and the role of the first."""
    return "".join(f"<{i} {turns[0][0]}>{t}\n" for i, (_, t) in enumerate(turns))


def read_any(part):
    return "assistant", part


def test_chat_holds_an_additive_template_to_its_word(spark):
    def folding(turns):
        return "".join(f"[{r}]{'...' if i == 0 and len(turns) > 12 else t}\n" for i, (r, t) in enumerate(turns))

    folding.additive = True

    def reader(segment):
        role, _, text = segment[1:-1].partition("]")
        return role, text

    rows = [(k, i, "assistant", f"C:\\\\x and \\### y {i}") for k, n in ((1, 20), (2, 13), (3, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(df, folding, reader).collect()}
    assert {k: r["rewrites_history"] for k, r in got.items()} == {1: True, 2: True, 3: False}
    # The mask holds the text as this reader has it, not as another template would escape it.
    assert got[3]["loss_sha256"] == hashlib.sha256("".join(t for k, _, _, t in rows if k == 3).encode()).hexdigest()


def test_chat_renders_true_prefixes_beyond_the_window(spark):
    turns = [("system" if i == 0 else "user", f"text {i}") for i in range(15)]
    df = spark.createDataFrame([(n, i, r, t) for n in (10, 15) for i, (r, t) in enumerate(turns[:n])], "conv_id long, turn long, role string, text string")
    for template, seen in ((folded, {10: False, 15: True}), (late, {10: False, 15: True}), (numbered, {10: False, 15: False})):
        got = {r["conv_id"]: r for r in chat.digests(df, template, read_any).collect()}
        assert {n: r["rewrites_history"] for n, r in got.items()} == seen
        assert {n: r["formatted_chars"] for n, r in got.items()} == {n: len(template(turns[:n])) for n in seen}
    parts = chat.formatted(df.where("conv_id = 15"), numbered).orderBy("turn").collect()
    assert "".join(r["part"] for r in parts) == numbered(turns)
    assert [r["part"][r["text_start"] : r["text_end"]] for r in parts] == [t for _, t in turns]


# 4


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").collect()
    assert sum((r["p_quality"] >= 0.5) == (r["quality"] == 1) for r in got) >= 0.9 * len(got)
    assert quality.score(docs, labels, F.col("source"), F.col("lang")).count() == docs.count()


def test_quality_posteriors_from_their_formula(spark):
    rng = random.Random(5)
    rows = [(i, "some words here" if rng.random() < 0.6 else "S3ME ;; {} 00", "en" if i % 3 else "de", f"h{rng.choice([0, 0, 0, 1, 1, 2, i])}", 1) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = {i: int(rng.random() < 0.7) for i in range(60)}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = by_id(quality.score(df, labels, F.col("source"), F.col("lang")))
    sigma = lambda x: 1 / (1 + math.exp(-max(-30, min(30, x))))
    odds = lambda p: math.log(p / (1 - p))
    good = {i: marks.get(i, sigma(r["evidence"])) for i, r in got.items()}
    host, path = {i: r["host"] for i, r in got.items()}, {i: (r["host"], r["path"]) for i, r in got.items()}
    of = lambda keys: {k: [i for i in got if keys[i] == k] for k in set(keys.values())}
    hosts, paths = of(host), of(path)
    mean = sum(good.values()) / len(good)

    def prior(groups, around):
        n = {k: len(v) for k, v in groups.items()}
        total = sum(n.values())
        spread = sum(n[k] * (sum(good[i] for i in v) / n[k] - around[k]) ** 2 for k, v in groups.items())
        noise = max(sum(n[k] * around[k] * (1 - around[k]) for k in groups) / total, 1e-6)
        between = (spread - (len(groups) - 1) * noise) / (total - sum(x * x for x in n.values()) / total)
        return min(max(noise / max(between, 1e-6) - 1, 1), 1e6)

    a = prior(hosts, {k: mean for k in hosts})
    p_host = {k: (sum(good[i] for i in v) + a * mean) / (len(v) + a) for k, v in hosts.items()}
    b = prior(paths, {k: p_host[k[0]] for k in paths})
    for i, r in got.items():
        others = [[good[j] for j in group if j != i] for group in (hosts[host[i]], paths[path[i]])]
        without_host = (sum(others[0]) + a * mean) / (len(others[0]) + a)
        without = (sum(others[1]) + b * without_host) / (len(others[1]) + b)
        assert abs(r["p_host"] - p_host[host[i]]) < 1e-9
        assert abs(r["p_quality"] - sigma(r["evidence"] + 0.5 * (odds(without) - odds(mean)))) < 1e-9


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    got = quality.score(docs, labels.where(~held), F.col("source"), F.col("lang")).join(labels.where(held), "doc_id").collect()
    assert len(got) > 10 and sum((r["p_quality"] >= 0.5) == (r["quality"] == 1) for r in got) >= 0.8 * len(got)


def test_quality_edges(spark):
    df = frame(spark, ODD).withColumn("source", F.lit(None).cast("string")).withColumn("evidence", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["p_quality"] for r in quality.score(df, none, F.col("source"), F.col("lang")).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1), (4, 0), (4, 0), (5, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.score(df, some, F.col("source"), F.col("lang")).count() == len(ODD)
    assert quality.score(df.where("false"), some, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink(spark):
    df = spark.createDataFrame([(i, "words of a text", "en", "big" if i < 200 else "tiny", 1) for i in range(201)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(200, 0)], "doc_id long, quality int")
    sites = {r["host"]: r["p_path"] for r in quality.score(df, labels, F.col("source"), F.col("lang")).select("host", "p_path").distinct().collect()}
    assert 0.2 < sites["tiny"] < sites["big"] < 0.8


# 5


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [*ODD, *[" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randrange(50)) for _ in range(rng.randrange(200))) for _ in range(150)]]
    got = by_id(fingerprint.compare_edited(frame(spark, texts).withColumn("next_text", F.lit(0))))
    order = sorted(range(len(texts)), reverse=True)
    for at, k in enumerate(order):
        t, following = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[k]["n_chars"] == len(t)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    assert got[9]["fingerprint"] == got[10]["fingerprint"] and got[10]["near_next"] == 1
    long = [k for k, t in enumerate(texts) if t and len(t.split()) > 60]
    assert 0.15 < np.mean([got[k]["near_edited"] for k in long]) < 0.6
    assert np.mean([got[k]["near_next"] for k in long]) < 0.1


def plain_anchors(units, k=5, s=2):
    """Places at which a k-mer's least s-mer stands first or last, from the hashes of the units' s-mers."""
    return [i for i in range(len(units) - k + 1) if min(units[i : i + k - s + 1]) in (units[i], units[i + k - s])]


def test_fingerprints_and_likeness_from_scratch(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"], k=n)) for n in (0, 1, 4, 5, 6, 30, 300, 3000)] + ["x" * 60, "中文字符没有空格" * 5, None]
    got = by_id(fingerprint.compare_edited(frame(spark, texts)))
    hashes = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    order = sorted(got, reverse=True)
    for k, r in got.items():
        following = got[order[(order.index(k) + 1) % len(order)]]
        for name, other in (("near_edited", r["edited_fingerprint"]), ("near_next", following["fingerprint"])):
            a, b = hashes(r["fingerprint"]), hashes(other)
            assert r[name] == pytest.approx(len(a & b) / len(a | b))
        assert r["fingerprint"] == "".join(sorted(hashes(r["fingerprint"]), key=lambda h: (int(h, 16) + (1 << 31)) % (1 << 32)))
        # The places from the s-mers' hashes, which Spark gives, by a plain reading of the rule.
        words = (texts[k] or "").split() if k < 8 else []
        if len(words) >= 5:
            pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(zip(words, words[1:]))], "i int, a string, b string")
            inner = [x[1] for x in sorted(pairs.select("i", F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))).collect())]
            assert [x["at"] for x in r["anchors"]] == plain_anchors(inner + [0], 5, 2)[: len(r["anchors"])] or not plain_anchors(inner, 5, 2)


def test_fingerprint_edges(spark):
    assert fingerprint.compare_edited(frame(spark, ["x"]).where("false")).count() == 0
    one = fingerprint.compare_edited(frame(spark, ["alone in the table of documents"])).first()
    assert one["near_next"] == 1
    twice = frame(spark, ["a b", "c d"]).unionByName(frame(spark, ["a b", "c d"]))
    assert fingerprint.compare_edited(twice.unionByName(spark.createDataFrame([(None, None, "en", "s", 0)], SCHEMA))).count() == 5


def test_anchors_do_not_depend_on_what_is_around(spark):
    words = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(0, words), (1, "somehow before it all " + words + " and after")], "doc_id long, text string")
    a, b = ({x["hash"]: x["at"] for x in r["anchors"]} for r in fingerprint.with_anchors(df, F.col("text")).orderBy("doc_id").collect())
    assert a.keys() <= b.keys() and {b[h] - a[h] for h in a} == {4}


@pytest.mark.parametrize("signs", ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", "กขคงจฉชซญดตถทนบปผฝพฟมยรลวสหอ"])
def test_anchors_in_runs_without_spaces(spark, signs):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice(signs) for _ in range(n))
    passage = some(200)
    df = spark.createDataFrame([(0, some(40) + passage + some(40)), (1, some(43) + passage + some(40))], "doc_id long, text string")
    a, b = ({(x["hash"], x["at"] - at) for x in r["anchors"] if 0 <= x["at"] - at <= 195} for at, r in zip((40, 43), fingerprint.with_anchors(df, F.col("text")).orderBy("doc_id").collect()))
    assert a == b and len(a) > 50


def test_fingerprints_of_long_texts_are_whole(spark):
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(100)
    # The higher id comes first: 0 is the next of 1, and 1 has the passage 700 words further on.
    texts = [" ".join(prose(2000) + passage + prose(3000)), " ".join(prose(2700) + passage + prose(2500))]
    got = by_id(fingerprint.compare_edited(frame(spark, texts)))
    own = {k: {a["hash"]: a["at"] for a in r["anchors"]} for k, r in got.items()}
    assert all(len(own[k]) > 2000 and max(own[k].values()) > 5000 for k in own)
    shared = own[0].keys() & own[1].keys()
    assert len(shared) > 30 and {own[0][h] - own[1][h] for h in shared} == {-700}
    assert got[1]["near_next"] == len(shared) / len(own[0].keys() | own[1].keys())
    assert got[1]["aligned_next"].asDict() == {"shift": -700, "anchors": len(shared)} and got[0]["aligned_next"]["shift"] == 700
    assert got[1]["aligned_edited"]["shift"] == 0 and got[1]["aligned_edited"]["anchors"] > 1000
    apart = by_id(fingerprint.compare_edited(frame(spark, [" ".join(prose(30)), " ".join(prose(30))])))
    assert apart[0]["near_next"] == 0 and apart[0]["aligned_next"] is None


# 6


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    assert sum(r["is_toxic"] == (r["toxic"] == 1) for r in got) >= 0.9 * len(got)


def test_toxicity_chain_from_its_formula(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["plain", "words", "only", "here"]) for _ in range(20)) + " vile nasty" * (i % 3 == 0) + " shoddy" * (i % 4 == 0) for i in range(80)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None if i % 7 == 0 else int(i % 4 != 0)) for i in range(70)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(df, labels)
    assert chain.categories == ("toxic", "poor") and len(chain.links) == 2 and len(chain.links[1].weights) == len(chain.links[1].features) + 2
    # Neither the layout nor the order of the input changes the model.
    again = toxicity.fit(df.repartition(7, F.rand(3)), labels.orderBy(F.desc("doc_id")))
    assert all((x.features == y.features).all() and np.allclose(x.weights, y.weights, atol=1e-6) for x, y in zip(chain.links, again.links))
    got = by_id(toxicity.score(df, chain))
    for i, t in enumerate(texts):
        held, earlier = set(toxicity.buckets(*raw(pa.array([t])))[1].tolist()), []
        for link in chain.links:
            x = link.weights[-1] + sum(w for f, w in zip(link.features.tolist(), link.weights) if f in held) + sum(w * p for w, p in zip(link.weights[len(link.features) :], earlier))
            earlier.append(1 / (1 + math.exp(-x)))
        assert np.allclose([got[i]["p_toxic"], got[i]["p_poor"]], earlier, atol=1e-5)
        assert (got[i]["p_poor"] >= 0.5) == (i % 4 == 0)


def test_toxicity_without_its_label(spark):
    rows = [(i, f"word{i % 3} text", i % 2, i % 2) for i in range(40)]
    docs = frame(spark, [t for _, t, _, _ in rows])
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels.drop("toxic"))).collect()
    assert "p_poor" in got[0].asDict() and {r["is_toxic"] for r in got} == {None}
    bare = toxicity.score(docs, toxicity.fit(docs, labels.select("doc_id")))
    assert bare.columns == ["doc_id", "is_toxic"] and {r["is_toxic"] for r in bare.collect()} == {None}


def test_toxicity_finds_nine_of_ten_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("toxic").agg(F.avg(F.col("is_toxic").cast("int"))).collect()
    found = {r[0]: r[1] for r in got}
    assert found[1] >= 0.9 and found[0] <= 0.01


def test_toxicity_edges(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["plain", "words", "only", "here"]) for _ in range(20)) + (" vile nasty" if i % 3 == 0 else "") for i in range(60)]
    df = frame(spark, [*texts, *ODD]).withColumn("p_toxic", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(5, 0), (None, 1), (50, None)], "doc_id long, toxic int")
    got = by_id(toxicity.score(df, toxicity.fit(df, labels)))
    assert len(got) == 60 + len(ODD)
    assert all(got[i]["is_toxic"] == (i % 3 == 0) for i in range(60)) and not any(got[60 + i]["is_toxic"] for i in range(len(ODD)))
    assert {r["p_toxic"] for r in toxicity.score(df, toxicity.fit(df, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(df.where("false"), toxicity.fit(df, labels)).count() == 0


# 7


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    df = frame(spark, ODD).withColumn("score", F.lit("clash"))
    got = by_id(langid.identify(df))
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[7]["lang_pred"] == "en"
    nobody = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(nobody).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0
    assert langid.accept(frame(spark, ["12 34", "letters"])).count() == 1
    clashing = frame(spark, ["12 34", "letters"]).withColumns({c: F.lit(c) for c in ("score", "lang_pred", "evidence")})
    assert langid.accept(clashing).columns == clashing.columns and langid.accept(clashing).first()["score"] == "score"
    # A row is learned from under its own language, not under another row's of the same id.
    twice = spark.createDataFrame([(1, "the cat and the dog", "en"), (1, "unnamed", None), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    assert set(langid.fit(twice, F.lit(True)).languages) == {"de", "en"}


def test_languages_not_learned_are_rejected(spark):
    rng = random.Random(6)
    strange = [
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
        "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan.",
        "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил и лучше выдумать не мог.",
        "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)),
        "".join(rng.choice("0123456789abcdef") for _ in range(400)),
        "AB-12 X9 K7-Q 44 ZZ9 81",
        "x 1 2 3 4 5",
        "x" * 300,
    ]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = {r["doc_id"] for r in docs.select("doc_id").collect()}
    more = spark.createDataFrame([(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], SCHEMA)
    kept = {r["doc_id"] for r in langid.accept(docs.select(*more.columns).unionByName(more)).collect()}
    assert not kept - clean
    assert len(kept) >= 0.99 * len(clean)


# 8


def test_jump():
    keys = np.arange(-50, 200)
    mixed = sharding.mix(keys)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(mixed, n).tolist() == [brute.jump(int(k), n) for k in mixed]


def test_shards(spark):
    texts = [*ODD, *[f"text {i}" for i in range(500)]]
    df = frame(spark, texts).withColumn("shard", F.lit("clash"))
    got = sharding.shard_rows(df).collect()
    assert len(got) == len(texts)
    for r in got:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    again = frame(spark, ["a"] * 3).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["slot"] for r in sharding.shard_rows(again).collect()) == [0, 1, 2]
    assert sharding.shard_rows(df.where("false")).count() == 0


def test_shard_files(spark, tmp_path):
    df = frame(spark, [f"text {i}" for i in range(100)])
    sharding.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


# 9


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(2000):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        s = s[: rng.randint(1, 6)] * rng.randint(1, 8) if rng.random() < 0.3 else s
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def patchwork(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(3)]
    docs = []
    for _ in range(120):
        x = ""
        for _ in range(rng.randint(0, 4)):
            p, j = rng.choice(base), rng.randint(0, 200)
            x += p[j : j + rng.randint(20, 300)] + "é" * rng.randint(0, 90) * (rng.random() < 0.3)
            x += "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) * (rng.random() < 0.3)
        docs.append(x)
    return [*docs, "a" * 1000, "ab" * 300, "a" * 500, *ODD]


def removed(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats(spark):
    texts = patchwork()
    assert removed(repeats.digests(frame(spark, texts).withColumn("repeats", F.lit(1)))) == brute.removal(enumerate(texts))


def test_repeats_in_small_pieces_and_lots(spark, monkeypatch):
    texts = patchwork(8)
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert [tuple(map(len, repeats.stretches(np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2, np.zeros(frequency.TABLE, np.uint8))))] == [(0,) * 7]
    text, lo, hi = repeats._pieces(np.array([0, 50, 500]), 100)
    assert text.tolist() == [0, 1, 1, 1, 1, 1, 1] and hi[-1] == 500
    assert removed(repeats.digests(frame(spark, texts))) == brute.removal(enumerate(texts))


def test_repeats_of_a_hot_minimizer(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    # One line stands everywhere; what surrounds it is now new, now from a few others.
    line, around = some(90), [some(60) for _ in range(6)]
    texts = [rng.choice([*around, some(60)]) + line + rng.choice([*around, some(60)]) for _ in range(300)]
    assert removed(repeats.digests(frame(spark, texts))) == brute.removal(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_sides_are_sorted_and_compared(seed):
    rng = np.random.default_rng(seed)
    m, sides = 60, []
    for _ in range(2):
        rows, size = rng.integers(0, 2, (m, 100)).astype(np.uint8), rng.integers(0, 101, m)
        rows[m // 2 :] = rows[: m // 2]
        rows[np.arange(100)[None, :] >= size[:, None]] = 0
        sides.append((rows, size))
    for (rows, size), (order, common) in zip(sides, repeats.sorted_sides(sides)):
        held = [rows[i, : size[i]].tobytes() for i in range(m)]
        assert sorted(order.tolist()) == list(range(m))
        for i, (x, y) in enumerate(zip(order[:-1], order[1:]), 1):
            shared = next((k for k, (a, b) in enumerate(zip(held[x], held[y])) if a != b), min(len(held[x]), len(held[y])))
            assert common[i] == shared
        # Rows with a common prefix stand together.
        for t in (1, 20, 60):
            runs = np.cumsum(common < t)
            where = {}
            for k, i in enumerate(order):
                if size[i] >= t:
                    where.setdefault(held[i][:t], set()).add(runs[k])
            assert all(len(x) == 1 for x in where.values())


def test_repeats_empty_and_trimmed(spark):
    assert repeats.digests(frame(spark, ["x"]).where("false")).count() == 0
    shared = "".join(f"é{i}" for i in range(60))
    texts = [shared + "tail one", shared + "tail two", None]
    clashing = frame(spark, texts).withColumns({c: F.lit(1) for c in ("repeats", "row", "doc", "h", "start", "route", "open")})
    got = by_id(repeats.trimmed(clashing))
    assert got[0]["repeats"] == 1
    assert got[0]["text"] == texts[0] and got[1]["text"] == "two" and got[2]["text"] == ""
    twice = frame(spark, ["z" * 300]).unionByName(frame(spark, ["z" * 300]))
    assert [r["n_removed"] for r in repeats.digests(twice).collect()] == [299, 299]


# 10


ITEMS = [(0, "What stands at the corner of the old market square?\nA tall bronze clock."), (1, "Name the river that crosses seven bridges downtown. It is the silver Aldra."), (2, None), (3, "")]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = " ".join(f"filler{i % 37}" for i in range(3000))
    texts = [filler + " " + ITEMS[0][1].upper() + " " + filler, ITEMS[1][1], "the river that crosses nothing at all", "What stands at the corner of the old market square?", *ODD]
    df = frame(spark, texts).withColumn("item_id", F.lit(5))
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.hits(df, bench).collect()) == [(0, 0), (1, 1)]
    assert sorted(by_id(decontam.clean(df, bench))) == list(range(2, len(texts)))
    assert decontam.hits(df, bench.where("false")).count() == 0 and decontam.clean(df, bench.where("false")).count() == len(texts)
    assert decontam.hits(df.where("false"), bench).count() == 0


def plain_hits(docs, items, least, overlap):
    """Every item against each of its own passages of every text, by BM25 over dictionaries."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    words = {k: split(t) for k, t in items}
    words = {k: w for k, w in words.items() if w}
    df = Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / max(1, len(words))
    impact = {}
    for k, w in words.items():
        own = {t: math.log1p((len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in Counter(w).items()}
        impact[k] = {t: v / sum(own.values()) for t, v in own.items()}
    out = {}
    for d, text in docs:
        held = split(text)
        for k, t in items:
            if k not in words:
                continue
            n = len(words[k])
            sought = [split(p) for p in decontam.parts(t)]
            for at in range(0, len(held), n):
                own = held[at : at + 2 * n]
                share = sum(v for w, v in impact[k].items() if w in own)
                parts = [max(len(g & grams(own, s)) / max(1, len(g)) for s in (1, 2, 3)) if (g := grams(p, min(3, max(1, len(p))))) else 1.0 for p in sought]
                if share >= least - 1e-9 and min(parts) >= overlap:
                    out[d, k] = max(out.get((d, k), (0.0, 0.0, 0.0)), (share, *parts))
    return out


@pytest.mark.parametrize(("least", "overlap"), [(0.5, 0.6), (0.3, 0.3), (0.5, 0.0)])
def test_decontamination_like_every_passage(spark, least, overlap):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choices(vocabulary, range(60, 0, -1), k=n))
    items = [(i, f"{some(rng.randint(1, 12))}\n{some(rng.randint(1, 6))}") for i in range(30)] + [(90, some(80)), (91, "w1"), (92, None), (93, "")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{some(rng.randint(0, 150))} {t} {some(rng.randint(0, 40))}") for i, (_, t) in enumerate(items[:31])] + [(200, None)]
    got = decontam.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=least, overlap=overlap).collect()
    want = plain_hits(docs, items, least, overlap)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    for r in got:
        assert (r["score"], r["question_overlap"], r["answer_overlap"]) == pytest.approx(want[r["doc_id"], r["item_id"]])


def test_decontamination_is_no_matter_of_other_items(spark):
    question, answer = " ".join(f"q{i}" for i in range(30)), " ".join(f"a{i}" for i in range(10))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = frame(spark, [f"{question} {filler} {answer}", f"{filler} {question} {answer}"])
    one = [(1, f"{question}\n{answer}")]
    for items in (one, one + [(2, " ".join(f"z{i}" for i in range(600)))]):
        got = decontam.hits(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1)}


def test_decontamination_in_slices(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontam, "SLICE_BYTES", 10)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.hits(frame(spark, [ITEMS[0][1], ITEMS[1][1]]), bench).collect()) == [(0, 0), (1, 1)]


def test_slices_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(9)
    # Items ordered by subject, of different lengths; documents hold parts of them, so many scores are near the threshold.
    items = [(i, " ".join(rng.choice([f"s{i // 10}w{rng.randrange(15)}", f"common{rng.randrange(8)}"]) for _ in range(4 + i // 10 * 3))) for i in range(60)]
    texts = [" ".join(x for x in t.split() if rng.random() < rng.choice([0.4, 0.5, 0.6, 0.8])) + " " + " ".join(f"filler{rng.randrange(30)}" for _ in range(40)) for _, t in items for _ in range(4)]
    df, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1 << 20, 1000):
        monkeypatch.setattr(decontam, "SLICE_BYTES", size)
        assert (len(decontam.indexes(bench, 0.5, 0.0)) > 3) == (size == 1000)
        found.append({(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in decontam.hits(df, bench, overlap=0.0).collect()})
        found[-1]["kept"] = sorted(by_id(decontam.clean(df, bench, overlap=0.0)))
    assert len(found[0]) > 50 and min(s[0] for k, s in found[0].items() if k != "kept") < 0.55
    assert found[0] == found[1]


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(4)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))) for i in range(80)]
    index = decontam.ItemIndex(items, 0.5, 0.0)
    for _ in range(100):
        held = Words(*raw(pa.array([" ".join(rng.sample(words, rng.randint(1, 40)))]))).hashes()
        terms = [t for t in np.searchsorted(index.terms, np.unique(held)).tolist() if t < len(index.terms) and index.terms[t] in held]
        scores = np.zeros(len(items))
        for t in terms:
            for i, x in zip(*index.postings(t)):
                scores[i] += x
        assert sorted(i for i, _ in index.wand(terms)) == np.flatnonzero(scores >= 0.5 - 1e-9).tolist()


def plain_bm25(items, texts, least):
    """{(document, item): best score}: every passage against every item, from the formula."""
    words = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in items}
    mean, longest = sum(map(len, words.values())) / len(words), max(map(len, words.values()))
    df = Counter(w for ws in words.values() for w in set(ws))
    best = {}
    for i, ws in words.items():
        impact = {w: math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, tf in Counter(ws).items()}
        for k, t in enumerate(texts):
            held = re.findall(r"[a-z0-9]+", t.lower())
            for s in range(0, len(held), longest):
                score = sum(impact[w] for w in set(held[s : s + 2 * longest]) if w in impact) / sum(impact.values())
                if score >= least - 1e-9:
                    best[k, i] = max(best.get((k, i), 0), score)
    return best


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_hits_are_those_of_exhaustive_scoring(spark, monkeypatch, size):
    rng = random.Random(size)
    # Few lengths and frequencies: many scores are exactly the threshold.
    items = [(i, " ".join(f"q{i % 20}x{(i // 20 * 2 + j) % 8}" for j in range(4))) for i in range(80)]
    texts = [" ".join([*rng.sample([f"q{i}x{j}" for j in range(8)], rng.randint(1, 4)), *(f"filler{rng.randrange(50)}" for _ in range(rng.randrange(30)))]) for i in range(20) for _ in range(6)]
    monkeypatch.setattr(decontam, "SLICE_BYTES", size)
    bench = spark.createDataFrame(items, "item_id long, text string")
    probe = plain_bm25(items, texts, 0.3)
    least = Counter(round(v, 12) for v in probe.values() if v < 0.95).most_common(1)[0][0]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.hits(frame(spark, texts), bench, least=least, overlap=0.0).collect()}
    want = plain_bm25(items, texts, least)
    assert got.keys() == want.keys() and sum(abs(v - least) < 1e-9 for v in want.values()) > 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_items_that_differ_in_one_word_are_told_apart(spark):
    bench = spark.createDataFrame([(0, "some words of text number 3 here")], "item_id long, text string")
    texts = [f"some words of text number {i} here" for i in range(20)]
    assert [r["doc_id"] for r in decontam.hits(frame(spark, texts), bench).collect()] == [3]


def test_chat_holds_a_claim_to_its_word_however_long(spark):
    def late_fold(turns):
        return "".join(f"[{r}]{'...' if i == 0 and len(turns) > 18 else t}\n" for i, (r, t) in enumerate(turns))

    late_fold.additive = True
    rows = [(k, i, "assistant", "x" * 100_000) for k, n in ((1, 20), (2, 18)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rewrites_history"] for r in chat.digests(df, late_fold, read_any).collect()}
    assert got == {1: True, 2: False}
