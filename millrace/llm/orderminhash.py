"""Order MinHash fingerprints, sensitive to edit distance. DataFrame functions only.

The words of a text give overlapping k-mers; each is numbered by how often it has occurred before in the
text, and the pair is hashed. The hash's top bits choose one of ``BINS`` bins, the rest its rank; of every
bin the ``PICKED`` minimal pairs are taken, put back in the order in which they stand in the text, and the
tuple of their k-mers is hashed to the bin's entry. Texts that share many k-mers in another order get other
entries. The likeness of two fingerprints is the share of bins with equal entries among the bins that
either has.

Edge cases: a null text counts as empty and has an empty fingerprint; two empty fingerprints have the
likeness 1; a text of fewer words than k has shorter k-mers, and one of any length that Spark can hold is
fingerprinted whole; documents follow each other by doc_id (nulls last), then by the first bytes and the hash
of the text, and the first follows the last, so a single document follows itself; repeated rows are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import let, table

BINS_LOG2, PICKED = 6, 2
#: A value holds 32 bits of a hash above a position in the text, so that no array of words is too long.
POSITION_BITS = 31
_POSITION = (1 << POSITION_BITS) - 1
_BIN_SHIFT = 63 - BINS_LOG2
_ENTRY_BITS = 26
#: Documents in a block on average at least, blocks at most, and how many keys are drawn for each bound of a block.
BLOCK_ROWS, MOST_BLOCKS, DRAWN = 512, 16_384, 8


def _hash_part(v: Column) -> Column:
    return F.shiftright(v, POSITION_BITS)


def _bin(v: Column) -> Column:
    return F.shiftright(v, _BIN_SHIFT)


def _occurrence(s: Column, v: Column, i: Column, steps: Column) -> Column:
    """How many equal k-mers stand before place ``i`` of the sorted array: found by binary search."""
    lower = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("low"), i.alias("high")),
        lambda a, _: let(
            F.shiftright(a["low"] + a["high"], 1),
            lambda mid: F.when(_hash_part(F.get(s, mid)) < _hash_part(v), F.struct((mid + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), mid.alias("high"))),
        ),
    )["low"]
    again = (i > 0) & (_hash_part(F.get(s, i - 1)) == _hash_part(v))
    return F.when(again, i - lower).otherwise(F.lit(0))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the sorted entries of the bins that ``text`` fills, each with its bin in the top bits."""
    w, h, s, t, c, n = (f"_{x}_{out}" for x in "whstcn")
    df = df.withColumn(w, F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), ""))

    def kmer(x: Column, i: Column) -> Column:
        mixed = F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        return F.shiftleft(F.shiftrightunsigned(mixed, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(i.bitwiseAND(F.lit(_POSITION)).cast("long"))

    # places where no whole k-mer fits are dropped unless none fits at all
    whole = F.slice(w, 1, F.greatest(F.size(w) - 2, F.least(F.size(w), F.lit(1))))
    df = df.withColumn(h, F.transform(whole, kmer))
    df = df.withColumn(s, F.sort_array(h)).drop(w)
    df = df.withColumn(n, F.sequence(F.lit(1), F.length(F.bin(F.size(s)))))

    def ranked(v: Column, i: Column) -> Column:
        mixed = F.xxhash64(_hash_part(v), _occurrence(F.col(s), v, i, F.col(n)))
        high = F.shiftleft(F.shiftrightunsigned(mixed, POSITION_BITS + 1), POSITION_BITS)
        return high.bitwiseOR(v.bitwiseAND(F.lit(_POSITION)))

    df = df.withColumn(t, F.sort_array(F.transform(s, ranked))).drop(s, n)
    df = df.withColumn(c, F.filter(t, lambda v, i: (i < PICKED) | (_bin(F.get(t, i - PICKED)) != _bin(v)))).drop(t)

    def entry(v: Column, i: Column) -> Column:
        one, other = v.bitwiseAND(F.lit(_POSITION)), F.get(c, i - 1).bitwiseAND(F.lit(_POSITION))
        at = lambda p: _hash_part(F.get(h, p.cast("int")))
        pair = (i > 0) & (_bin(F.get(c, i - 1)) == _bin(v))
        tuple_hash = F.when(pair, F.xxhash64(at(F.least(one, other)), at(F.greatest(one, other)))).otherwise(F.xxhash64(at(one)))
        value = F.shiftleft(_bin(v), _ENTRY_BITS).bitwiseOR(F.shiftrightunsigned(tuple_hash, 64 - _ENTRY_BITS))
        last = (i == F.size(c) - 1) | (_bin(F.get(c, i + 1)) != _bin(v))
        return F.when(last, value)

    return df.withColumn(out, F.filter(F.transform(c, entry), lambda x: x.isNotNull())).drop(c, h)


def likeness(a: str, b: str) -> Column:
    """The share of equal entries among the bins that either fingerprint fills."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, _ENTRY_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(entries: str) -> Column:
    """A fingerprint as lowercase hex, eight digits an entry."""
    return F.lower(F.array_join(F.transform(entries, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def _keys(docs: DataFrame) -> DataFrame:
    """Add ``gone``, ``id``, ``head`` and ``th``, by which documents follow each other."""
    head = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return docs.withColumns({"gone": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "head": head, "th": F.xxhash64("text")})


KEY = ("gone", "id", "head", "th")


def bounds(docs: DataFrame, n: int, rows: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> list[tuple[int, ...]]:
    """The keys of the documents with which blocks but the first begin, in order: every ``DRAWN``-th of keys
    drawn by hash. At most about ``DRAWN * MOST_BLOCKS`` keys come to the driver."""
    blocks = min(max(n // rows, 1), most)
    if blocks < 2:
        return []
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(1), *KEY), F.lit(max(n // (blocks * DRAWN), 1))) == 0)
    keys = sorted(tuple(r) for r in drawn.select(*KEY).distinct().collect())
    return keys[DRAWN::DRAWN]


def with_next(docs: DataFrame) -> DataFrame:
    """``(block, guest, doc_id, text, gone, id, head, th)``: documents in blocks of consecutive ones, each
    block with a guest at its end: the document that follows the block's last one.

    Bounds of blocks are keys of documents drawn evenly from all, so that neither gaps between ids nor ids
    shared by many documents make a block large. A document that begins a block is the guest of the block
    before; nothing is joined.
    """
    docs = _keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    n, first = docs.agg(F.count("*"), F.min(F.struct(*KEY))).first()
    cuts = bounds(docs, n)
    block, begins = F.lit(0), F.lit(False)
    if cuts:
        # one constant array for each part of the key; a block is found by binary search
        lists = [F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in range(len(KEY))]
        at = lambda i: F.struct(*[F.get(x, i).alias(k) for x, k in zip(lists, KEY)])
        own = F.struct(*KEY)
        steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
        found = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")),
            lambda a, _: let(
                F.shiftright(a["low"] + a["high"], 1),
                lambda mid: F.when((mid < a["high"]) & (at(mid) <= own), F.struct((mid + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), mid.alias("high"))),
            ),
        )["low"]
        docs = docs.withColumn("block", found)
        block = F.col("block")
        begins = (block > 0) & (at(block - 1) == own)
    place = lambda b, guest: F.struct(b.cast("int").alias("block"), F.lit(guest).alias("guest"))
    is_first = F.struct(*KEY) == F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEY, first or (0, 0, 0, 0))])
    places = F.array_compact(F.array(place(block, 0), F.when(begins, place(block - 1, 1)), F.when(is_first, place(F.lit(len(cuts)), 1))))
    return docs.withColumn("place", F.explode(places)).select("place.block", "place.guest", "doc_id", "text", *KEY)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near both and the next document's are.

    One shuffle of the texts, by block; nothing else is exchanged after it.
    """
    order = Window.partitionBy("block").orderBy("guest", *KEY, "text")
    rows = with_next(docs).withColumn("following", F.lead("text").over(order))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("following", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("following")
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp"), "edited", "edited_fp")
    rows = rows.select("block", "guest", "doc_id", *KEY, "text", "fp", "edited_fp", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    rows = rows.withColumn("next_fp", F.lead("fp").over(order)).where("guest = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
