"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

The index holds a posting (term, document, position) for every word of every document, whatever the test, and
for each document one posting without a term whose position is its number of words. It is sorted by term in
each part, so a part is a small inverted index of its own documents, no shuffle of the corpus is needed to
build it, and a lookup of few terms skips the pages of all others. A window of a test item is looked up from
its rarest terms: a posting of the rarest one is a candidate where the next rarest stands near it (for exact
phrases: where both lists, shifted by the term's offset in the phrase, agree). What remains is compared word
by word with the text.

Words are runs of digits, letters and characters outside ASCII, A-Z lower-cased. A window is ten consecutive
words of an item; a shorter item is one window. A window is near where all its words stand, in any order,
among ``SPAN`` consecutive words of a document; every exact occurrence is near too.

Edge cases: a null text has no words, as document or item; items without words match nothing; repeated rows
and repeated doc_ids are told apart by their text, equal rows get equal results; null ids are kept; a text is
searched whole whatever its length; an empty table on either side gives no matches; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import let, stash, table, unused

WINDOW = 10
LISTS = 2
#: Consecutive words of a document among which all words of a window must stand to be near.
SPAN = 20
#: More distinct test words than this are joined by shuffle instead of being sent to every task.
MOST_BROADCAST_TERMS = 200_000
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ITEMS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def parts(text: Column) -> Column:
    """The words of a text in their own case; an empty string may stand first and last."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATOR)


def lowered(word: Column) -> Column:
    """A-Z lower-cased, all else unchanged; most words have no capital of any script."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, UPPER, LOWER))


def first_word(words: Column) -> Column:
    """Where the words begin in ``parts``: 1 after a leading separator, else 0."""
    return F.when(words[0] == "", 1).otherwise(0)


def count_words(words: Column) -> Column:
    """How many of ``parts`` are words."""
    n = F.size(words)
    return F.when(n == 1, F.when(words[0] == "", 0).otherwise(1)).otherwise(n - first_word(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0))


def told_apart(docs: DataFrame) -> Column:
    """What tells rows of equal doc_ids apart: a hash of the text where ids repeat or are null, else nothing."""
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    return F.lit(0).cast("long") if n == ids else F.xxhash64("text")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, window_id, phrase, n)`` of every window of every item; the phrase is space-joined."""
    words = F.transform(F.array_remove(parts(F.col("text")), ""), lowered)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at"))
    rows = rows.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("w"))
    return rows.select("item_id", F.xxhash64("w").alias("window_id"), F.array_join("w", " ").alias("phrase"), F.size("w").alias("n"))


def vocabulary(windows: DataFrame) -> DataFrame:
    """``(word, term)`` for every distinct word of the windows; the term is a hash of the word."""
    return windows.select(F.explode(F.split("phrase", " ")).alias("word")).distinct().select("word", F.xxhash64("word").alias("term"))


def _small(side: DataFrame, most: int = MOST_BROADCAST_TERMS) -> DataFrame:
    """``side`` marked for broadcast if it is known to be small, else left to a shuffled join."""
    return F.broadcast(side) if side.count() <= most else side


def build_index(docs: DataFrame, terms: DataFrame | None = None, th: Column | None = None, most_broadcast: int = MOST_BROADCAST_TERMS) -> DataFrame:
    """Postings ``(term, doc_id, th, pos)``, a written table: of every word, or of the words in
    ``terms(word, term)`` only, which is sent to every task if it is known to be small.

    The index of all words also has a posting without a term for each document, at its number of words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (th if th is not None else told_apart(docs)).alias("th"), parts(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "th", first_word(F.col("words")).alias("skip"), count_words(F.col("words")).alias("n"), F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "word"))
    rows = rows.where("word is null or word <> ''").select("doc_id", "th", F.when(F.col("word").isNull(), F.col("n")).otherwise(F.col("pos") - F.col("skip")).alias("pos"), lowered(F.col("word")).alias("word"))
    if terms is None:
        rows = rows.withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    else:
        rows = rows.join(_small(terms, most_broadcast), "word")
    return stash(rows.select("term", "doc_id", "th", "pos").sortWithinPartitions("term", "doc_id", "th", "pos"), "postings")


def lengths(index: DataFrame) -> DataFrame:
    """``(doc_id, th, n_words)`` of every row of the documents, from an index of all words."""
    return index.where("term is null").select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))


def frequencies(index: DataFrame) -> DataFrame:
    """``(term, df)``: the length of each list."""
    return index.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def anchors(windows: DataFrame, index: DataFrame, lists: int = LISTS) -> DataFrame:
    """``(window_id, term, offset, rank, needed)``: the rarest terms of each distinct window.

    Windows with a word that no document has are dropped here.
    """
    distinct = windows.select("window_id", "phrase", "n").distinct()
    words = distinct.select("window_id", "phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    rare = words.join(frequencies(index), "term").groupBy("window_id", "phrase", "n").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("by"))
    rare = rare.where(F.size("by") == F.col("n")).withColumn("by", F.slice("by", 1, lists))
    rare = rare.select("window_id", "phrase", F.size("by").alias("needed"), F.posexplode("by").alias("rank", "one"))
    return rare.select("window_id", "phrase", "needed", "rank", F.col("one.term").alias("term"), F.col("one.offset").alias("offset"))


def candidates(index: DataFrame, anchor: DataFrame, span: int = 0) -> DataFrame:
    """``(doc_id, th, window_id, start)``: where the shifted lists of the rarest terms agree on a start; with
    ``span``, where the next rarest term stands near the rarest one, less than ``span`` positions away."""
    shifted = index.join(_small(anchor.select("window_id", "term", "offset", "rank", "needed")), "term").withColumn("start", F.col("pos") - F.col("offset"))
    if not span:
        mask = F.bit_or(F.pow(F.lit(2), F.col("rank")).cast("int"))
        met = shifted.where("start >= 0").groupBy("doc_id", "th", "window_id", "start").agg(mask.alias("met"), F.max("needed").alias("needed"))
        return met.where(F.col("met") == F.pow(F.lit(2), F.col("needed")).cast("int") - 1).select("doc_id", "th", "window_id", "start")
    # a frame holds the postings of two terms within reach, however long the document
    around = Window.partitionBy("doc_id", "th", "window_id").orderBy("pos").rangeBetween(1 - span, span - 1)
    met = shifted.withColumn("met", (F.col("needed") == 1) | F.max(F.col("rank") == 1).over(around))
    return met.where("rank = 0 and met").select("doc_id", "th", "window_id", "start", F.col("offset"))


def phrase_matches(docs: DataFrame, windows: DataFrame, index: DataFrame, lists: int = LISTS, span: int = 0, th: Column | None = None) -> DataFrame:
    """``(doc_id, th, phrase, start, n)`` for every occurrence of every distinct window, exactly; with
    ``span``, also a row without a start for each distinct window that is near in a document."""
    anchor = stash(anchors(windows, index, lists), "anchors")
    found = stash(candidates(index, anchor, span).distinct(), "candidates")
    phrases = windows.select("window_id", "phrase", "n").distinct()
    longest = windows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    at = ["start", "window_id", *(["offset"] if span else [])]
    by_doc = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*at)).alias("at"))
    # one row a document on either side; equal rows of documents were one in the index
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (th if th is not None else told_apart(docs)).alias("th"), "text").alias("d")
    joined = texts.join(by_doc.alias("c"), F.expr("d.doc_id <=> c.doc_id and d.th = c.th"))

    def cut(w: Column, a: Column) -> Column:
        """The candidate with the words from where its window would start, and all within reach of its term."""
        fields = [a["window_id"].alias("window_id"), a["start"].alias("start")]
        start = F.slice(w, F.greatest(a["start"], F.lit(0)) + 1, F.when(a["start"] >= 0, longest).otherwise(0))
        if span:
            term = a["start"] + a["offset"]
            low = F.greatest(term - (span - 1), F.lit(0))
            fields.append(F.slice(w, low + 1, term + span - low).alias("reach"))
        return F.struct(*fields, start.alias("there"))

    there = let(F.array_remove(parts(F.col("d.text")), ""), lambda w: F.transform("c.at", lambda a: cut(w, a)))
    rows = joined.select("d.doc_id", "d.th", F.explode(there).alias("x"))
    rows = rows.select("doc_id", "th", "x.*").join(_small(phrases), "window_id")
    same = F.array_join(F.transform(F.slice("there", 1, F.col("n")), lowered), " ") == F.col("phrase")
    exact = rows.where(same & (F.col("start") >= 0)).select("doc_id", "th", "phrase", "start", "n")
    if not span:
        return exact.distinct()
    words = F.array_distinct(F.split("phrase", " "))
    low = F.transform("reach", lowered)
    rows = rows.withColumn("low", low).withColumn("near", is_near(F.col("low"), words, span))
    kinds = F.array_compact(F.array(F.when(F.col("near"), F.lit(-1)), F.when(same & (F.col("start") >= 0), F.col("start"))))
    both = rows.select("doc_id", "th", "phrase", "n", F.explode(kinds).alias("start"))
    return both.select("doc_id", "th", "phrase", F.when(F.col("start") >= 0, F.col("start")).alias("start"), "n").distinct()


def is_near(reach: Column, words: Column, span: int) -> Column:
    """Whether some ``span`` consecutive words of ``reach`` have all of ``words``."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(reach) - span + 1, F.lit(1)))
    inside = lambda some: F.size(F.array_except(words, some)) == 0
    return inside(reach) & F.exists(starts, lambda i: inside(F.slice(reach, i, span)))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = 0, index: DataFrame | None = None, th: Column | None = None) -> DataFrame:
    """``(doc_id, th, n_hit, items, n_near)`` of the documents in which a window of an item occurs, or with
    ``span`` is near. An index of the same documents can be given, for one test after another."""
    th = th if th is not None else told_apart(docs)
    windows = stash(item_windows(items, window), "windows")
    index = index if index is not None else build_index(docs, th=th)
    found = stash(phrase_matches(docs, windows, index, span=span, th=th), "matches")
    place = F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("n")).alias("end")))
    near = F.count(F.when(F.col("start").isNull(), 1))
    hits = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(place)).alias("at"), near.alias("n_near"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
    )["n"]
    hits = hits.select("doc_id", "th", covered.cast("long").alias("n_hit"), "n_near")
    of_item = found.where("start is not null").select("doc_id", "th", "phrase").join(windows.select("item_id", "phrase").distinct(), "phrase")
    named = of_item.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    named = named.withColumnRenamed("doc_id", "of").withColumnRenamed("th", "of_th")
    return hits.join(named, F.expr("doc_id <=> of and th = of_th"), "left").select("doc_id", "th", "n_hit", "items", "n_near")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, in which no window of an item occurs."""
    th = told_apart(docs)
    doc, of = unused(docs, "doc", "th")
    hit = contamination(docs, items, th=th).where("n_hit > 0").select(F.col("doc_id").alias(doc), F.col("th").alias(of))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(doc)) & (th == F.col(of)), "left_anti")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, exact and near."""
    docs = table(spark, sf_dir, "documents")
    th = told_apart(docs)
    index = build_index(docs, th=th)
    hit = stash(contamination(docs, table(spark, sf_dir, "benchmark"), span=SPAN, index=index, th=th), "contaminated").alias("h")
    joined = lengths(index).alias("d").join(hit, F.expr("d.doc_id <=> h.doc_id and d.th = h.th"), "left")
    ids = F.sha2(F.array_join("h.items", ","), 256)
    zero = F.lit(0).cast("long")
    return joined.select(
        "d.doc_id", "d.n_words", F.coalesce("h.n_hit", zero).alias("n_hit"), F.coalesce(F.size("h.items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(ids, F.lit(NO_ITEMS)).alias("items_sha256"), (F.coalesce("h.n_hit", zero) > 0).alias("contaminated"), F.coalesce("h.n_near", zero).alias("n_near"),
    )


ORACLE_SQL = r"""
with low as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
item as (select id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from w where kind = 'b' and len(w) > 0),
phrase as (select distinct id, n, array_to_string(w[s : s + n - 1], ' ') as t from item),
size as (select distinct n from phrase),
place as (select id, w, n, unnest(range(1, len(w) - n + 2)) as s from w, size where kind = 'd' and len(w) >= n),
met as (select place.id as doc_id, s, place.n as n, phrase.id as item_id from place join phrase on phrase.n = place.n and phrase.t = array_to_string(w[s : s + place.n - 1], ' ')),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from met) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from met) group by doc_id),
word as (select id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from w where kind = 'd'),
often as (select x, count(*) as df from word group by x),
bag as (select t, list_distinct(string_split(t, ' ')) as b from (select distinct t from phrase)),
rare as (select t, arg_min(x, (coalesce(df, 0), x)) as x from (select t, unnest(b) as x from bag) left join often using (x) group by t),
seen as (select word.id, t, b, list_slice(w.w, greatest(p - 19, 1), p + 19) as r from word join rare using (x) join bag using (t) join w on w.kind = 'd' and w.id = word.id),
close as (select id, t, b, r, unnest(range(1, greatest(len(r) - 19, 1) + 1)) as i from seen where list_has_all(r, b)),
near as (select id, count(distinct t) as n_near from close where list_has_all(list_slice(r, i, i + 19), b) group by id)
select w.id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(n_near, 0) as n_near
from w left join hit on hit.doc_id = w.id left join named on named.doc_id = w.id left join near on near.id = w.id where kind = 'd'
"""
