"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm.common import documents, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import bpe

    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import langid

    return langid.identify(documents(spark, sf_dir))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import sharding

    return sharding.shard_rows(documents(spark, sf_dir))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import jaccard

    return jaccard.join(documents(spark, sf_dir))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import chat

    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import quality

    # The source stands for the host; a path is a source's part in one language.
    return quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import fingerprint

    return fingerprint.compare_edited(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import toxicity

    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import repeats

    return repeats.digests(documents(spark, sf_dir))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import decontam

    return decontam.hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import divergence

    return divergence.audit(documents(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import exact

    return exact.groups(documents(spark, sf_dir))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fascicle.llm import codebooks

    return codebooks.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_shards": op8_shards,
    "op9_repeats": op9_repeats,
    "op10_decontam": op10_decontam,
    "op11_divergence": op11_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_codes": op13_codes,
}


def _rounds(n: int) -> str:
    """Lloyd's rounds over ``parts``, one after another: ``b`` are codebooks, ``a`` nearest entries with their distances."""
    d2 = "list_sum(list_transform(list_zip(p.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
    near = "a{0} as materialized (select rid, j, arg_min(e, (d, e)) as e, min(d) as d from (select rid, p.j, e, {1} as d from parts p join b{0} b on p.j = b.j) group by rid, j)"
    # The floor of a quotient, also below zero.
    floor = "(s - ((s % n) + n) % n) // n"
    moved = (
        "m{0} as materialized (select j, e, list(cast({2} as bigint) order by i) as x from (select a.j, a.e, i, sum(p.x[i]) as s, count(*) as n from a{1} a join parts p using (rid, j), range(1, 9) t(i) group by a.j, a.e, i) group by j, e), "
        "b{0} as materialized (select b.j, b.e, coalesce(m.x, b.x) as x from b{1} b left join m{0} m using (j, e))"
    )
    return ", ".join([near.format(0, d2), *(", ".join([moved.format(r, r - 1, floor), near.format(r, d2)]) for r in range(1, n + 1))])


ORACLE_SQL: dict[str, str] = {
    "op2_jaccard": r"""
        with recursive toks as (
            select doc_id,
                   regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ), sets as (
            select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from toks where len(w) > 0)
        ), sizes as (
            select doc_id, count(*) as n from sets group by doc_id
        ), links as (
            select a.doc_id as a, b.doc_id as b from sets a join sets b on a.g = b.g and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id
            having 100 * count(*) >= 75 * ((select n from sizes where doc_id = a.doc_id) + (select n from sizes where doc_id = b.doc_id) - count(*))
        ), reach as (
            select doc_id, doc_id as c from toks
            union
            select l.b, r.c from reach r join links l on l.a = r.doc_id
        )
        select r.doc_id, cast(coalesce(max(n), 0) as bigint) as n_shingles, min(r.c) as component_id
        from reach r left join sizes using (doc_id) group by r.doc_id
    """,
    "op3_chat": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as txt from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        select conv_id,
               count(*) as n_turns,
               sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt)) as turns_sha256,
               cast(coalesce(sum(length(txt)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(length('### : ') + length(role) + length(' </turn>') + 1
                        + length(replace(replace(replace(txt, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'))) as bigint) as formatted_chars,
               false as rewrites_history
        from rows group by conv_id
    """,
    "op11_divergence": r"""
        with docs as (
            select row_number() over () as d, coalesce(lang, '') as lang, coalesce("source", '') as source,
                   regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
            from documents
        ), grp as (
            select distinct lang, source from docs
        ), tok as (
            select d, lang, source, unnest(w) as term from docs
        ), cnt as (
            select lang, source, term, count(*) as n, count(distinct d) as docs from tok group by lang, source, term
        ), kept as (
            select lang, term, sum(n) as total from cnt group by lang, term having sum(docs) >= 30
        ), v as (
            select lang, count(*) as terms, sum(total) as whole from kept group by lang
        ), own as (
            select lang, source, sum(n) as own from cnt join kept using (lang, term) group by lang, source
        ), p as (
            select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                   1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(o.own, 0) + 5 * v.terms) as p,
                   1 + (1000000000::hugeint * (k.total + 5)) // (v.whole + 5 * v.terms) as q
            from grp g join kept k using (lang) join v using (lang)
            left join own o on o.lang = g.lang and o.source = g.source
            left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term
        ), dist as (
            select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
            from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
        ), pairs as (
            select a.lang, a.source, b.source as item, coalesce(d.value, 0) as value
            from grp a join grp b on a.lang = b.lang and a.source <> b.source
            left join dist d on d.lang = a.lang and d.source = a.source and d.item = b.source
        ), ranked as (
            select lang, source, 'pair' as part, item, value from pairs
            union all
            select lang, source, 'term', term, p - q from p where n > 0 and p > q
        ), out as (
            select lang, source, part, item, cast(value as bigint) as value,
                   cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from ranked
        )
        select * from out where part = 'pair' or rank <= 50
    """,
    "op12_exact_dedup": """
        select doc_id,
               max(doc_id) over same as keep_id,
               count(*) over same as group_size,
               row_number() over (partition by coalesce("text", '') order by doc_id desc nulls last) = 1 as kept,
               sha256(coalesce("text", '')) as text_sha256
        from documents window same as (partition by coalesce("text", ''))
    """,
    "op13_codes": f"""
        with kept as (
            select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, "label",
                   list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v
            from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as materialized (
            select rid, j, v[8 * j + 1 : 8 * j + 8] as x from kept, range(0, 8) t(j)
        ), b0 as materialized (
            select j, cast(rid - 1 as int) as e, x from parts where rid <= 16
        ), {_rounds(6)}, rows as (
            select rid, string_agg(printf('%02x', cast(e as int)), '' order by j) as code, cast(sum(d) as bigint) as error from a6 group by rid
        ), sha as (
            select sha256(string_agg(array_to_string(x, ','), ',' order by j, e)) as codebooks_sha256 from b6
        )
        select vec_id, code, error, cast(sum(error) over (partition by "label") as bigint) as label_error, codebooks_sha256
        from kept join rows using (rid), sha
    """,
}
