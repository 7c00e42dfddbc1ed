"""Registered queries of the subpackage: one per operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeline.functions.basics import let
from gaugeline.llm import chunk_dedup, jaccard_join, langid, line_dedup, merkle, mixing, mtree, multiset_hash, packing, periodic, pii, toxicity, url_filter
from gaugeline.llm.common import crc_mod, lower_ascii, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_mod(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(pii.BASE))
    kinds = F.transform("pii", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    own = len(pii.BASE)
    return found.select(
        "doc_id", *counts[:own], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"),
        *counts[own:], F.size("pii").cast("long").alias("n_spans"),
    )


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP5_SQL = """
with v as (
  select vec_id, min([floor(1024 * x::double) for x in embedding]) as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select * from ranked where rank <= 10
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.packed(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), common as (
  select k, max(doc_id) as holder from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), judged as (
  select doc_id, line, pos, common.k is not null and doc_id <> holder as gone from keyed left join common using (k)
)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sizes as (
  select words.doc_id, count(s) as n from words left join shingles using (doc_id) group by words.doc_id
), links as (
  select x.doc_id as a, y.doc_id as b from shingles x join shingles y using (s)
  where x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
  having 100 * count(*) >= 75 * ((select n from sizes where sizes.doc_id = x.doc_id) + (select n from sizes where sizes.doc_id = y.doc_id) - count(*))
), reach as (
  select doc_id as a, doc_id as b from words union select reach.a, links.b from reach join links on reach.b = links.a
)
select doc_id, n as n_shingles, (select min(b) from reach where a = doc_id) as component_id from sizes
"""


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compared(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32: the checksum of the decimal doc_id, byte by byte through the table of the reversed polynomial.
CRC_SQL = r"""crc as (
  select list(c order by b) as t from (
    select b, list_reduce(list_concat([b::bigint], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) bytes(b)
  )
), hashed as (
  select *, case when doc_id is null then null else xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])
  ), 4294967295) end as h from documents, crc
)"""


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that op11 judges: one in ten (by crc32 of the doc_id) gets a repeated tail."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        sizes = F.struct(n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))
        word = lambda i, s: F.get(w, F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))
        return let(sizes, lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"].cast("long") - 1), lambda i: word(i, s)), " "))

    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    text = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, changed(w)))).otherwise(F.col("text"))
    return docs.withColumn("text", text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.a")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.b")).alias("period"), F.expr("1000 * _best.length div -_best.b").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Groups of six words find the diagonals, as any run has six matches in a row at least.
OP11_SQL = "with " + CRC_SQL + r""", split as (
  select doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from hashed
), shaped as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from split
), stepped as (
  select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from shaped
), texts as (
  select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w
  from stepped
), grams as (
  select doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') as gram from (select doc_id, w, unnest(range(n - 5)) as i from texts where n >= 12)
), diagonals as (
  select x.doc_id, y.i - x.i as q, y.i as i from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i
), islands as (
  select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from diagonals
), stretches as (
  select doc_id, q, min(i) - q as start, max(i) + 6 - min(i) + q as length from islands group by doc_id, q, island
), runs as (
  select doc_id, start, length, min(q) as period from stretches where length >= greatest(12, 2 * q) group by doc_id, start, length
), listed as (
  select doc_id, count(*) as n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) as best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listing
  from runs group by doc_id
), dropped as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as collapsed
  from (select doc_id, unnest(range(n)) as i, unnest(w) as word from texts) left join dropped d using (doc_id, i) where d.doc_id is null group by doc_id
)
select texts.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period, 1000 * best.l // best.p as exponent_milli,
  sha256(coalesce(listing, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from texts left join listed on texts.doc_id = listed.doc_id left join kept on texts.doc_id = kept.doc_id
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = merkle.manifest(docs, tampered=F.when(crc_mod(F.col("doc_id"), 3) == 0, lower_ascii(F.col("text"))))
    return merkle.verified(tree).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified"
    )


def _leaf_sql(text: str) -> str:
    part = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Nodes of all levels; the root's tree has the group of its own, made of the subroots by the order of their languages.
OP12_SQL = "with recursive " + CRC_SQL + f""", leaves as (
  select doc_id, lang, {_leaf_sql('text')} as leaf,
    case when h % 3 = 0 then {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_leaf_sql('text')} end as presented,
    row_number() over (partition by lang order by doc_id) - 1 as place
  from hashed
), nodes as (
  select 0 as level, lang, place, leaf as node, count(*) over (partition by lang) as n from leaves
  union all
  select level, lang, place, node, count(*) over (partition by level, lang) as n from (
    select level + 1 as level, lang, place // 8 as place, sha256(string_agg(node, '' order by place)) as node
    from nodes where n > 1 group by level + 1, lang, place // 8
  )
), subroots as (
  select lang, node, row_number() over (order by lang nulls first) - 1 as place from nodes where n = 1
), tops as (
  select 0 as level, place, node, count(*) over () as n from subroots
  union all
  select level, place, node, count(*) over (partition by level) as n from (
    select level + 1 as level, place // 8 as place, sha256(string_agg(node, '' order by place)) as node from tops where n > 1 group by level + 1, place // 8
  )
), flanks as (
  select x.lang, x.level, x.place,
    coalesce(string_agg(y.node, '' order by y.place) filter (y.place < x.place), '') as a,
    coalesce(string_agg(y.node, '' order by y.place) filter (y.place > x.place), '') as b
  from nodes x join nodes y on x.lang is not distinct from y.lang and x.level = y.level and x.place // 8 = y.place // 8
  where x.n > 1 group by x.lang, x.level, x.place
), top_flanks as (
  select x.level, x.place,
    coalesce(string_agg(y.node, '' order by y.place) filter (y.place < x.place), '') as a,
    coalesce(string_agg(y.node, '' order by y.place) filter (y.place > x.place), '') as b
  from tops x join tops y on x.level = y.level and x.place // 8 = y.place // 8 where x.n > 1 group by x.level, x.place
), ways as (
  select l.doc_id, l.leaf, l.presented, f.level, f.a, f.b from leaves l join flanks f
    on f.lang is not distinct from l.lang and f.place = l.place // power(8, f.level)::bigint
  union all
  select l.doc_id, l.leaf, l.presented, 1000 + f.level, f.a, f.b from leaves l join subroots s on s.lang is not distinct from l.lang
    join top_flanks f on f.place = s.place // power(8, f.level)::bigint
), listed as (
  select doc_id, string_agg(a || b, '' order by level) as proof, list({{'a': a, 'b': b}} order by level) as steps from ways group by doc_id
), folded as (
  select l.doc_id, coalesce(proof, '') as proof, coalesce(steps, []) as steps, presented as node, 0 as k from leaves l left join listed using (doc_id)
  union all
  select doc_id, proof, steps, sha256(steps[k + 1].a || node || steps[k + 1].b), k + 1 from folded where k < len(steps)
)
select l.doc_id, l.leaf, s.node as subroot, t.node as root, sha256(f.proof) as proof_sha256, f.node as folded_root, f.node = t.node as verified
from leaves l join subroots s on s.lang is not distinct from l.lang join tops t on t.n = 1 join folded f on f.doc_id = l.doc_id and f.k = len(f.steps)
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP13_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_personal_data": op4_personal_data,
    "op5_top_k": op5_top_k,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_multiset_hash": op10_multiset_hash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": pipeline,
}
ORACLES = {
    "op5_top_k": OP5_SQL, "op7_line_dedup": OP7_SQL, "op9_jaccard_join": OP9_SQL,
    "op11_periodic_runs": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_exact_dedup": OP13_SQL,
}
