"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm import best_fit, chat_repair, collocations, decontaminate, hard_negatives, license_align, line_crf, maxscore, prefix_tree_join, slot_sharding, suffix_dedup, suffix_tree_lm, surrogates
from slatewise.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of every conversation, repaired and rendered."""
    return chat_repair.repair(table(spark, folder, "conversations"))


def op2_prefix_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the component that its shingle links reach."""
    return prefix_tree_join.link_documents(table(spark, folder, "documents"))


def op3_line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from labels outside the held-out third."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out())
    model = line_crf.train(documents, labels)
    return line_crf.score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minhash_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document by the slot map's first version."""
    return slot_sharding.shard_records(spark, table(spark, folder, "documents"))


def op7_patience_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document."""
    return license_align.find_licenses(table(spark, folder, "documents"))


def op9_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest rows by inner product of every vector whose id is divisible by 50."""
    return maxscore.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q, row_number() over () as r from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.r as asks, a.vec_id as query_id, b.r, b.vec_id, coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) as score
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by asks order by score desc, vec_id, r) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= 5
"""


DUCK_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
DUCK_SHINGLES = "case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"

OP5_SQL = f"""
with items as (select distinct item_id, {DUCK_WORDS} as w from benchmark),
texts as (select doc_id, {DUCK_WORDS} as w from documents),
wanted as (select distinct item_id, unnest({DUCK_SHINGLES}) as s from items),
sizes as (select item_id, count(*) as n from wanted group by item_id),
held as (select distinct doc_id, unnest({DUCK_SHINGLES}) as s from texts)
select doc_id, wanted.item_id, cast(n as bigint) as n_shingles, cast(count(*) as bigint) as n_found, count(*) / n as containment
from held join wanted using (s) join sizes on wanted.item_id is not distinct from sizes.item_id
group by doc_id, wanted.item_id, n having 100 * count(*) >= 75 * n
"""


def op6_conflict_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document in training sequences."""
    return best_fit.pack(table(spark, folder, "documents"))


PII_KEY = b"replace in production"


def op8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_pii(documents, PII_KEY).select("doc_id", "n_mentions", "text")


def op10_induced_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start elsewhere too."""
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 collocations of two or three words of every language."""
    return collocations.collocations(table(spark, folder, "documents"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), total as (
  select lang, sum(len(w)) as n from words group by lang
), runs as (
  select lang, 1 as words, unnest(w) as phrase from words
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words
), counts as (
  select lang, words, phrase, count(*) as f from runs group by lang, words, phrase having count(*) >= 10
), parts as (
  select *, string_split(phrase, ' ') as w from counts where words > 1
), cuts as (
  select lang, words, phrase, f, k, array_to_string(w[1:k], ' ') as left_part, array_to_string(w[k + 1:], ' ') as right_part from (select *, unnest(range(1, words)) as k from parts)
), scored as (
  select c.lang, c.words, c.phrase, c.f, k, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = left_part join counts y on y.lang = c.lang and y.phrase = right_part
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), around as (
  select lang, phrase, max(f) as around from (
    select lang, w[1] || ' ' || w[2] as phrase, f from parts where words = 3 union all select lang, w[2] || ' ' || w[3], f from parts where words = 3
  ) group by lang, phrase
), ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, f desc, b.phrase) as rank
  from best b left join around a on a.lang = b.lang and a.phrase = b.phrase where a.around is null or 100 * a.around < 50 * b.f
)
select lang, cast(rank as integer) as rank, phrase, f as a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join total using (lang) where rank <= 2000
"""


def op12_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of every document under a suffix tree learnt from six sevenths of them."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return suffix_tree_lm.score(table(spark, folder, "documents"), held)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives just below each positive's score, for every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q, row_number() over () as r
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.r as anchor, a.vec_id as anchor_id, a.label = b.label as same, b.r, b.vec_id, cast(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) as bigint) as score
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 100 = 0
), positives as (
  select anchor, anchor_id, r as positive, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id, r) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor, positive order by s.score desc, s.vec_id, s.r) as integer) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from positives p join scored s on s.anchor = p.anchor and not s.same and 100 * s.score between 80 * positive_score and 100 * positive_score
qualify rank <= 5
"""

QUERIES = {
    "op1_chat_repair": (op1_chat_repair, None),
    "op2_prefix_tree_join": (op2_prefix_tree_join, None),
    "op3_line_crf_quality": (op3_line_crf_quality, None),
    "op4_virtual_slots": (op4_virtual_slots, None),
    "op5_minhash_containment": (op5_minhash_containment, OP5_SQL),
    "op6_conflict_best_fit": (op6_conflict_best_fit, None),
    "op7_patience_licenses": (op7_patience_licenses, None),
    "op8_surrogates": (op8_surrogates, None),
    "op9_maxscore": (op9_maxscore, OP9_SQL),
    "op10_induced_suffix_dedup": (op10_induced_suffix_dedup, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_suffix_tree_lm": (op12_suffix_tree_lm, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}
