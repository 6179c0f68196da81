"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Benchmark items are partitioned by their number of distinct five-word shingles into classes of doubling
size.  An item's signature is the smallest hashes of its shingles; the class fixes how many.  With m the
shingles an item may miss at the threshold, a signature holds m + SPARE hashes of the largest size in the
class, so a document that contains the item must contain at least (signature size - m) of them: the search
loses nothing, whatever the length of the document.  Documents that reach that count are candidates; their
whole text is then compared with the item shingle by shingle, as strings.

Only DataFrame functions are used.  Documents are scanned once for candidates and once for the texts of
those found.  Signatures and candidate ids are broadcast while they number at most ``BROADCAST_HASHES`` and
``joins.BROADCAST_IDS``, which is counted; beyond that Spark shuffles both sides.

Defined cases: words are runs of non-space bytes with A-Z lower-cased; an item of fewer than five words is
one shingle, found only in documents of exactly those words; items without words match nothing.  Null
texts are empty.  Rows of one document id are searched and verified one by one,
the best row counting; a null id is an id like any other.  Repeated items are one item.  Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.llm.joins import small
from slatewise.session import stored

SHINGLE = 5
THRESHOLD_PCT = 75
SPARE = 4
BROADCAST_HASHES = 500_000


def word_list(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of all shingles of a word list, in order."""
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(n >= SHINGLE, every).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column) -> Column:
    """The shingles themselves, distinct."""
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))
    return F.array_distinct(F.when(n >= SHINGLE, every).when(n > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>")))


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(_item, _texts): one row per distinct item and its exact shingles."""
    words = benchmark.select(F.col(item_col).alias("_item"), word_list(F.col(text_col)).alias("_words")).where(F.size("_words") > 0).distinct()
    return words.select("_item", "_words", shingle_texts(F.col("_words")).alias("_texts"))


def signatures(items: DataFrame) -> DataFrame:
    """(_item, _words, _hash, _need): the smallest hashes of each item, as many as its size class asks for."""
    sized = items.select("_item", "_words", F.array_sort(F.array_distinct(shingle_hashes(F.col("_words")))).alias("_hashes")).withColumn("_n", F.size("_hashes"))
    top = F.pow(2, F.floor(F.log2("_n")) + 1).cast("int") - 1  # largest size in the class
    keep = F.least(F.col("_n"), F.floor(top * (100 - THRESHOLD_PCT) / 100).cast("int") + SPARE)
    may_miss = F.floor(F.col("_n") * (100 - THRESHOLD_PCT) / 100).cast("int")
    return sized.select("_item", "_words", F.explode(F.slice("_hashes", F.lit(1), keep)).alias("_hash"), (keep - may_miss).alias("_need"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_shingles, n_found, containment) for items of which a document holds three quarters or more."""
    best = _checked(documents, benchmark, id_col, text_col, item_col, item_text_col).groupBy("_id", "_item").agg(F.max(F.struct(F.col("_found") / F.col("_n"), F.col("_n"), F.col("_found"))).alias("_best"))
    n, hits = F.col("_best")["_n"], F.col("_best")["_found"]
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), n.cast("long").alias("n_shingles"), hits.cast("long").alias("n_found"), (hits / n).alias("containment"))


def _checked(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(_id, _text_hash, _item, _n, _found) of every candidate that holds enough: an id with its text, and an item.

    The shingles of the candidates' texts and of the items meet in a join on the shingle itself.  Whole arrays never
    travel with a pair, and no filter can move below the step that splits a text, which runs once for each text.
    """
    items = items_of(benchmark, item_col, item_text_col)
    signed = signatures(items)
    few = signed.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    texts = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text"))
    found = texts.select("_id", "_text_hash", word_list(F.col("_text")).alias("_list")).select("_id", "_text_hash", F.explode(shingle_hashes(F.col("_list"))).alias("_hash"))
    candidates = stored(
        found.join(F.broadcast(signed) if few else signed, "_hash")
        .groupBy("_id", "_text_hash", "_item", "_words")
        .agg(F.count_distinct("_hash").alias("_hits"), F.first("_need").alias("_need"))
        .where(F.col("_hits") >= F.col("_need"))
        .select(F.col("_id").alias("_wanted"), F.col("_text_hash").alias("_wanted_hash"), F.col("_item").alias("_wanted_item"), F.xxhash64("_words").alias("_wanted_words")),
        "candidates",
    )
    ids = stored(candidates.select("_wanted", "_wanted_hash").distinct(), "candidate-ids")
    same = F.col("_id").eqNullSafe(F.col("_wanted")) & (F.col("_text_hash") == F.col("_wanted_hash"))
    lists = texts.join(small(ids), same, "left_semi").select("_id", "_text_hash", word_list(F.col("_text")).alias("_list"))
    held = lists.select("_id", "_text_hash", F.explode(shingle_texts(F.col("_list"))).alias("_shingle"))
    wanted = stored(items.select("_item", F.xxhash64("_words").alias("_item_words"), F.size("_texts").alias("_n"), F.explode("_texts").alias("_shingle")), "item-shingles")
    counted = held.join(small(wanted, BROADCAST_HASHES), "_shingle").groupBy("_id", "_text_hash", "_item", "_item_words", "_n").agg(F.count_distinct("_shingle").cast("int").alias("_found"))
    enough = stored(counted.where(F.col("_found") * 100 >= F.col("_n") * THRESHOLD_PCT), "contained")
    pair = same & F.col("_item").eqNullSafe(F.col("_wanted_item")) & (F.col("_item_words") == F.col("_wanted_words"))
    return enough.join(candidates, pair, "left_semi").select("_id", "_text_hash", "_item", "_n", "_found")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold no benchmark item, all columns kept; rows of one id are decided each by its own text.

    The documents' columns may have any names: they travel as one struct.
    """
    leaks = stored(_checked(documents, benchmark, id_col, text_col, "item_id", "text").select(F.col("_id").alias("_leak"), F.col("_text_hash").alias("_leak_hash")).distinct(), "leaks")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    held = F.col("_row")[id_col].eqNullSafe(F.col("_leak")) & (F.xxhash64(F.col("_row")[text_col]) == F.col("_leak_hash"))
    return rows.join(small(leaks), held, "left_anti").select("_row.*")
