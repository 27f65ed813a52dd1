"""Benchmark decontamination (5): a distributed positional inverted index, DataFrame functions only.

Index: the postings (term, row key, position) of all benchmark terms in the
training texts, written as one segment per input split, each sorted by term, so a
term's postings lie together and a filter on terms skips the rest.

Search: a window (ten consecutive item words, or a shorter item whole) is looked
up by its two rarest terms in the corpus.  Each term's list is adjusted by the
term's offset in the item; where the two lists of a window meet, the item lies on
that diagonal of the text.  Windows with a term that the corpus lacks are dropped
at once.  The diagonals found, usually few, are then compared word by word with
the texts, so phrase matches are exact.  ``near`` gives proximity matches from the
same index; it is a function of its own, which the query does not call.

Defined cases: a null or empty text has no words and no hits; items without words
have no windows; items are known by item_id (rows with the same id are one item, a
null id is named ``null``); rows are told apart by doc_id and text, so null and
repeated ids do no harm; repeated rows are each reported; empty tables give empty
results or no hits; other columns are carried, but for those named n_words or
matches, which the operator's replace.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.tables import materialize, packed, small, table, unpacked

WINDOW = 10
# fixed values of the contract: words are what lies between runs of these, after lower-casing
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\0"  # stands for a text's end in the index; no word has it


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() is the faster of two and changes nothing but A-Z where all characters are single bytes
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def end_term() -> Column:
    return F.xxhash64(F.lit(END))


def row_key() -> Column:
    """Tells rows apart for the joins; a clash would only add a diagonal that the comparison rejects."""
    return F.xxhash64("doc_id", "text")


def read_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, n) of the items with words; ``item`` is a key of (item_id, words)."""
    got = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("words"))
    return got.where(F.size("words") > 0).distinct().select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words",
                                                            F.size("words").alias("n"))


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Postings (term, doc, pos) of the items' terms in all texts, in segments sorted by term.

    A posting of ``END`` gives each text's number of words.
    """
    terms = items.select(F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("term"))
    terms = terms.union(docs.sparkSession.range(1).select(end_term().alias("term")))
    terms = small(materialize(terms.distinct()), 16)
    # the hash of a word stands for it in the index; phrase matches compare the words themselves
    found = F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word")
    postings = docs.select(row_key().alias("doc"), found).select("doc", "pos", F.xxhash64("word").alias("term")).join(terms, "term", "left_semi")
    return materialize(postings.select("term", "doc", "pos").sortWithinPartitions("term"))


def rarest_terms(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, w, k, a_off, a_term, b_off, b_term): each window with its two rarest terms (b null if k is 1)."""
    tf = materialize(index.where(F.col("term") != end_term()).groupBy("term").agg(F.count(F.lit(1)).alias("tf")))
    at = items.select("item", F.posexplode("words").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    found = (at.join(small(tf, 24), "term", "left")
             .groupBy("item").agg(F.array_sort(F.collect_list(F.struct("off", "term", F.coalesce("tf", F.lit(0)).alias("tf")))).alias("at")))
    k = F.least(F.size("at"), F.lit(window))
    rows = found.select("item", "at", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("at") - k)).alias("w"))
    part = F.transform(F.slice("at", F.col("w") + 1, F.col("k")), lambda x: F.struct(x["tf"], x["off"], x["term"]))
    rows = rows.withColumn("order", F.array_sort(part)).where(F.col("order")[0]["tf"] > 0)
    second = lambda f: F.when(F.col("k") > 1, F.get("order", F.lit(1))[f])
    return rows.select("item", "w", "k", F.col("order")[0]["off"].alias("a_off"), F.col("order")[0]["term"].alias("a_term"),
                       second("off").alias("b_off"), second("term").alias("b_term"))


def diagonals(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, item, diag): where the offset-adjusted lists of a window's two rarest terms meet."""
    def lists(prefix: str) -> DataFrame:
        wanted = small(materialize(windows.where(f"{prefix}_term is not null")
                                   .select("item", f"{prefix}_off", F.col(f"{prefix}_term").alias("term")).distinct()), 32)
        return index.join(wanted, "term").select("doc", "item", (F.col("pos") - F.col(f"{prefix}_off")).alias("diag"), f"{prefix}_off")

    pairs = small(materialize(windows.where("b_off is not null").select("item", "a_off", "b_off").distinct()), 24)
    alone = small(materialize(windows.where("b_off is null").select("item", "a_off").distinct()), 24)
    first = lists("a")
    both = first.join(pairs, ["item", "a_off"]).join(lists("b"), ["doc", "item", "diag", "b_off"], "left_semi")
    return both.select("doc", "item", "diag").union(first.join(alone, ["item", "a_off"]).select("doc", "item", "diag")).distinct()


def matches_of(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, n_words, matches) for each row key: every exact occurrence of a window as (item_id, start, length)."""
    items = materialize(read_items(benchmark))
    index = build_index(docs, items)
    windows = materialize(rarest_terms(index, items, window))
    found = diagonals(index, windows).join(items, "item")  # broadcast if the written items are small
    k = F.least("n", F.lit(window))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - k), lambda w: w + F.col("diag") >= 0)
    found = materialize(found.select("doc", F.struct("item_id", "diag", "words", k.alias("k"), starts.alias("starts")).alias("c"))
                        .groupBy("doc").agg(F.collect_list("c").alias("found")))
    # explode of one array keeps its words from being computed anew wherever they are used
    # (the join is a sort-merge one at any size: what is found grows with the texts)
    read = docs.select(row_key().alias("doc"), "text").join(found.hint("merge"), "doc").withColumn("_words", F.explode(F.array(words(F.col("text")))))
    equal = lambda c, w: F.slice("_words", c["diag"] + w + 1, c["k"]) == F.slice(c["words"], w + 1, c["k"])
    matches = F.flatten(F.transform("found", lambda c: F.transform(
        F.filter(c["starts"], lambda w: equal(c, w)),
        lambda w: F.struct(c["item_id"].alias("item_id"), (c["diag"] + w).alias("start"), c["k"].alias("length")))))
    exact = read.select("doc", matches.alias("matches")).where(F.size("matches") > 0).dropDuplicates(["doc"])
    sizes = index.where(F.col("term") == end_term()).groupBy("doc").agg(F.max("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<item_id:string,start:int,length:int>>")
    return sizes.join(exact, "doc", "left").select("doc", "n_words", F.coalesce("matches", none).alias("matches"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words and matches."""
    return (packed(docs, doc=row_key()).join(matches_of(docs, benchmark, window), "doc")
            .select(*unpacked(docs.columns, ("n_words", "matches")), "n_words", "matches"))


def near(index: DataFrame, items: DataFrame, slop: int = 30, terms: int = 8, share: float = 0.75) -> DataFrame:
    """(doc, item, pos): proximity matches, where ``share`` of an item's rarest terms lie within ``slop`` words of one of them, in any order.

    The rarest ``terms`` of those that the index has are taken.  So many may be missing
    that only the rarest of them, one more than may be missing, need to be places ``pos``.
    """
    tf = index.groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    at = items.select("item", F.explode(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))).alias("term"))
    rare = at.join(tf, "term").groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("tf", "term"))), 1, terms).alias("rare"))
    need = F.ceil(F.size("rare") * F.lit(share) - 1e-9).cast("int")
    rare = rare.select("item", need.alias("need"), (F.size("rare") - need).alias("spare"), F.posexplode("rare").alias("rank", "of"))
    rare = materialize(rare.select("item", F.col("of")["term"].alias("term"), "need", (F.col("rank") <= F.col("spare")).alias("first")))
    found = index.join(small(rare, 32), "term").select("doc", "item", "term", "pos", "need", "first")
    enough = found.groupBy("doc", "item").agg(F.count_distinct("term").alias("n"), F.max("need").alias("need")).where("n >= need")
    found = materialize(found.join(enough.select("doc", "item"), ["doc", "item"], "left_semi"))
    # rows meet in buckets of slop words, so frequent terms of long texts aren't paired all with all
    bucket = F.floor(F.col("pos") / max(slop, 1))
    side = found.where("first").select("doc", "item", "pos", F.explode(F.array(*[bucket + d for d in (-1, 0, 1)])).alias("_b")).distinct()
    other = found.select("doc", "item", "term", "need", F.col("pos").alias("_pos"), bucket.alias("_b"))
    return (side.join(other, ["doc", "item", "_b"]).where(F.abs(F.col("pos") - F.col("_pos")) <= slop)
            .groupBy("doc", "item", "pos").agg(F.count_distinct("term").alias("n"), F.max("need").alias("need"))
            .where("n >= need").select("doc", "item", "pos"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches_of(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    got = docs.select("doc_id", row_key().alias("doc")).join(found, "doc")
    hit = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1))))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return got.select("doc_id", "n_words", F.size(hit).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
                      (F.size("matches") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0))),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM p, (SELECT DISTINCT k FROM w) WHERE i + k - 1 <= len(ws)),
m AS (SELECT r, i, k, item FROM g JOIN w USING (k, g)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
x AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""
