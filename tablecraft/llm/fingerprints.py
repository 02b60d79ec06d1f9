"""Short fingerprints of documents whose likeness estimates the overlap of their shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.columns import blank_words, hex_sha256, let, lower_az, whole, wide_hash
from tablecraft.llm.storage import cut

SHINGLE = 5
#: Bins of the one permutation, bits that a bin keeps, bins in a 64-bit word.
BINS, BITS = 256, 4
PER_WORD = 64 // BITS
SHIFT = 56  # a hash's eight leading bits choose its bin
#: Bins that an empty bin asks one after the other before it ranks all filled ones.
PROBES = 6
REST = (1 << SHIFT) - 1
MASK = (1 << BITS) - 1
#: The largest hash of each bin, in the order of signed numbers: it stands for an empty bin.
EMPTY = [((b - BINS // 2) << SHIFT) | REST for b in range(BINS)]
ONE_BIT_A_BIN = sum(1 << BITS * k for k in range(PER_WORD))


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of every k consecutive words, A-Z lower-cased; the whole sequence as one where there are fewer; none without words."""

    def of(words: Column) -> Column:
        n = F.size(words)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < k, F.array(F.xxhash64(words)))
            .otherwise(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))
        )

    return let(blank_words(lower_az(whole(text))), of)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each bin, in the order of bins. All hashes are sorted once; an empty bin has its entry of EMPTY."""

    def first_of_bin(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get(ordered, i - 1), SHIFT)))

    return let(F.sort_array(F.concat(hashes, F.array(*[F.lit(e) for e in EMPTY]))), first_of_bin)


def filled(h: Column) -> Column:
    return h.bitwiseAND(F.lit(REST)) != REST


def densified(minima: Column) -> Column:
    """The bits of every bin. A filled bin gives the low bits of its smallest hash. An empty one asks bins in an order of its own, the same
    for all documents, and takes the first filled one's hash; its bits come from that hash and its own number, so that a document of few
    shingles doesn't repeat one value in all bins."""

    def taken(full: Column) -> Column:
        def bits(h: Column, b: Column) -> Column:
            asked = [F.get(minima, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            ranked = F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(b, F.shiftright(x, SHIFT)).alias("r"), x.alias("x"))))["x"]
            other = F.coalesce(*[F.when(filled(a), a) for a in asked], ranked)
            return F.when(filled(h), h.bitwiseAND(F.lit(MASK))).otherwise(F.xxhash64(other, b).bitwiseAND(F.lit(MASK)))

        return F.transform(minima, bits)

    return let(F.filter(minima, filled), taken)


def packed(values: Column) -> Column:
    """Words of 64 bits, PER_WORD bins in each."""

    def word(i: Column) -> Column:
        out = F.get(values, i * PER_WORD)
        for k in range(1, PER_WORD):
            out = out.bitwiseOR(F.shiftleft(F.get(values, i * PER_WORD + k), BITS * k))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), word)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as array<bigint>; missing for a text without words. Equal texts have equal fingerprints."""
    return let(shingle_hashes(text), lambda hashes: F.when(F.size(hashes) > 0, let(bin_minima(hashes), lambda m: let(densified(m), packed))))


def hex_words(words: Column) -> Column:
    """A fingerprint as text, empty for a document without words."""
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """An estimate, 0 to 1, of the overlap (Jaccard) of two documents' shingles: the share of equal bins, less the share that is equal by
    chance with so few bits. Two documents without words are alike, one with and one without words are not."""

    def unequal(x: Column) -> Column:
        half = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(F.lit(ONE_BIT_A_BIN)))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    chance = 1.0 / (1 << BITS)
    share = (1 - apart / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.greatest(share, F.lit(0.0)))


def add_fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (text, ...) with a column fingerprint, in place of one that has this name. It needs no shuffle.

    One-permutation MinHash: each five-word shingle is hashed once, the hash's leading bits choose one of 256 bins, a bin keeps its smallest
    hash, empty bins are filled by optimal densification, and the four low bits of each bin are packed into 16 words.

    Missing and empty texts and texts of blanks have no fingerprint (null). Texts of fewer than five words have one shingle. Repeated rows
    get the same value; whole texts of any length are read."""
    return docs.withColumn("fingerprint", fingerprint(F.col("text")))


def with_next(docs: DataFrame) -> DataFrame:
    """(k1, k2, to1, to2, take, copies) for each different document of `docs` (doc_id, text, k1, k2): the key of the document that it comes
    next to in descending order of ids, and the third of that one's characters. Only ids and lengths are shuffled and range-partitioned;
    what stands first in each range comes after what stands last in the range before."""
    ids = docs.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max(F.char_length("text")).alias("n"), F.count("*").alias("copies"))
    order = (F.desc_nulls_last("doc_id"), F.asc("k1"), F.asc("k2"))
    ordered = cut(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    key = F.struct("k1", "k2")
    heads = ordered.withColumn("at", F.row_number().over(inside)).where("at = 1").select("part", key.alias("head"))  # one row per range
    along = Window.orderBy("part")
    after = F.coalesce(F.lead("head").over(along), F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("part", after.alias("after"))
    chained = ordered.select("k1", "k2", "n", "copies", "part", F.lead(key).over(inside).alias("own")).join(F.broadcast(heads), "part")
    giver = F.coalesce("own", "after")
    return chained.select(
        giver["k1"].alias("k1"), giver["k2"].alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.floor(F.col("n") / 3).cast("int").alias("take"), "copies"
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, next_id for every row of `docs` (doc_id, text, ...).

    The next document is the one that follows in descending order of doc_id; the first one follows the last. The edited text has the last
    third of the code points (rounded down) replaced by the first as many, or all, of the next document. near_edited and near_next are the
    likeness of the document's fingerprint to those of its edited text and of the next document.

    Texts are shuffled once by a 128-bit key of id and text and read from there twice: as the document, and as what it gives to the one
    before it, which is as much as that one needs. Fingerprints are taken before that shuffle.

    Missing texts count as empty. Rows without doc_id come last, and rows of one doc_id in the order of their keys; rows that repeat id and
    text are one document and get the same result each. A document that is alone is its own next. Ids may have any type that can be
    ordered. Other columns of `docs` are not read. An empty table gives an empty result."""
    text = whole(F.col("text")).alias("text")
    keyed = docs.select("doc_id", text).withColumns(dict(zip(("k1", "k2"), wide_hash(F.col("doc_id"), F.col("text")))))
    links = cut(with_next(keyed))
    rows = keyed.withColumn("fp", fingerprint(F.col("text")))
    given = rows.join(links.hint("shuffle_hash"), ["k1", "k2"])
    given = given.select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.expr("left(text, take)").alias("gift"), F.col("fp").alias("next_fp"), F.col("doc_id").alias("next_id")
    )
    if links.where("copies > 1").limit(1).count():  # repeated rows give the same thing
        given = given.dropDuplicates(["k1", "k2"])
    n = F.char_length("text")
    both = rows.hint("merge").join(given, ["k1", "k2"])
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), "gift")
    both = both.select("doc_id", "next_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited_text"))
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return both.select(
        "doc_id", "n_chars", "edited_text", F.col("fp").alias("fingerprint"), "edited_fingerprint",
        likeness(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "next_id",
    )


def op13_fingerprints(docs: DataFrame) -> DataFrame:
    return compare_edited(docs).select(
        "doc_id", "n_chars", hex_sha256(F.col("edited_text")).alias("edited_sha256"), hex_words(F.col("fingerprint")).alias("fingerprint"),
        hex_words(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "next_id",
    )
