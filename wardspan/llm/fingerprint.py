"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct shingle hashes of a text (all of them, if fewer). A word's
hash is the first 52 bits of its md5; a shingle's is a weighted sum of its words' hashes modulo a prime, so that a word
is hashed once and any SQL engine can repeat the numbers. Sketches of parts merge into the sketch of the whole. Two
sketches are compared below the smaller of their last hashes, where both are complete; sketches that hold all shingles
are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.llm.line_dedup import UPPER

K = 128
#: Weights of the words of a shingle: odd, and so small that the weighted sum of 52-bit numbers fits in 63 bits.
WEIGHTS = (3, 7, 31, 127, 251)
WIDTH = len(WEIGHTS)
DIGITS = 13
#: The largest prime below 2 ** 52.
PRIME = (1 << 52) - 47
BLANKS = " \t\n\x0b\x0c\r"
#: Ranges of doc_id for each shuffle partition: small ranges even out over the partitions.
RANGES = 8
#: Hash classes in which the sketches of one group are merged first.
SALTS = 64


def text_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS + UPPER, " " * len(BLANKS) + UPPER.lower())
    return F.array_remove(F.split(plain, " "), "")


def _word_hash(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, DIGITS), 16, 10).cast("long")


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with the value computed once, however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _mixed(hashes: list[Column]) -> Column:
    terms = [h * F.lit(w).cast("long") for h, w in zip(hashes, WEIGHTS, strict=True)]
    return sum(terms[1:], terms[0]) % F.lit(PRIME)


def shingles(text: Column) -> Column:
    """Hashes of all shingles of WIDTH words in order; fewer words are one shingle, no words none."""

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WIDTH), lambda i: _mixed([F.get(hashes, i + j) for j in range(WIDTH)]))
        short = F.array(_mixed([F.coalesce(F.get(hashes, F.lit(j)), F.lit(0).cast("long")) for j in range(WIDTH)]))
        return F.when(F.size(hashes) >= WIDTH, windows).when(F.size(hashes) > 0, short).otherwise(F.array().cast("array<long>"))

    return _bound(F.transform(text_words(text), _word_hash), of)


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles(text))), 1, k)


def as_fingerprint(sketched: Column) -> Column:
    """A sketch as one string of DIGITS hexadecimal digits a hash; texts without words have the empty string."""
    return F.lower(F.array_join(F.transform(sketched, lambda h: F.substring(F.hex(h + (1 << 4 * DIGITS)), 2, DIGITS)), ""))


def from_fingerprint(fingerprint: Column) -> Column:
    """The sketch that `as_fingerprint` wrote."""
    starts = F.sequence(F.lit(0), (F.length(fingerprint) / DIGITS).cast("int") - 1)
    parts = F.transform(starts, lambda i: F.conv(F.substr(fingerprint, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))
    return F.when(F.length(fingerprint) > 0, parts).otherwise(F.array().cast("array<long>"))


def _limit(one: Column, two: Column, k: int) -> Column:
    """The last hash up to which both sketches are complete; null if both hold every shingle."""
    last = [F.when(F.size(s) >= k, F.element_at(s, -1)) for s in (one, two)]
    return F.least(*last)


def _below(sketched: Column, limit: Column) -> Column:
    return F.when(limit.isNull(), F.size(sketched)).otherwise(F.size(F.filter(sketched, lambda h: h <= limit)))


def resemblance(one: Column, two: Column, k: int = K) -> Column:
    """Estimated intersection over union of two shingle sets; 1 for two empty sets."""
    limit = _limit(one, two, k)
    both = F.size(F.array_intersect(one, two))
    whole = _below(one, limit) + _below(two, limit) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both.cast("double") / whole)


def containment(one: Column, two: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second holds; 1 if the first has none below the limit."""
    own = _below(one, _limit(one, two, k))
    return F.when(own == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, two)).cast("double") / own)


def distinct_count(sketched: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range used."""
    share = (F.element_at(sketched, -1).cast("double") + 1) / float(PRIME)
    return F.when(F.size(sketched) < k, F.size(sketched).cast("double")).otherwise((k - 1) / share)


def merge_sketches(rows: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of `by`, equal to that of all its texts together: columns `by` and `column`.

    Hashes are made distinct before the shuffle, cut to k in hash classes and then to k per group, so no task sees more
    than SALTS * k hashes of a group at the end. Null keys form a group of their own. Rows whose sketch is null or empty
    add nothing; a group of only such rows keeps an empty sketch.
    """
    each = rows.select(*by, F.explode_outer(column).alias("hash")).distinct()
    salted = each.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)))
    for keys in ([*by, "salt"], by):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
        # a null hash stands for an empty sketch and sorts first: it takes no place of the k
        salted = salted.withColumn("place", place).where(F.col("place") <= k + 1)
    return salted.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set("hash")), 1, k).alias(column))


def _range_of(value: Column, splits: list[int]) -> Column:
    """How many of the ascending `splits` are at most `value`, by halving."""
    if not splits:
        return F.lit(0)
    bits = len(splits).bit_length()
    padded = F.lit(splits + [(1 << 63) - 1] * ((1 << bits) - 1 - len(splits)))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(padded, low + step - 1) <= value, low + step).otherwise(low))


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Points that cut doc_id into about `ranges` ranges of equally many rows; reads the doc_id column only."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", F.lit(shares), 20 * ranges).alias("at")).first()["at"]
    return sorted(set(found or []))


def with_next(docs: DataFrame, made: dict[str, Column], ranges: int) -> DataFrame:
    """doc_id, text and the columns `made` from them, with next_<name> of the next document by falling doc_id.

    After the last document comes the first. Texts are shuffled once: ranges of doc_id are sorted separately, and the
    first document of each range is sent to the range before it as well. Rows that share a doc_id follow one another by
    text.
    """
    splits = range_bounds(docs, ranges)
    placed = docs.select("doc_id", "text", _range_of(F.col("doc_id"), splits).alias("range"))
    firsts = placed.groupBy("range").agg(F.max("doc_id").alias("first_id"))  # at most len(splits) + 1 rows
    around = Window.orderBy("range")
    before = F.coalesce(F.lead("range").over(around), F.first("range").over(around))
    sent = F.broadcast(firsts.select("first_id", before.alias("before")))
    doubled = placed.join(sent, placed["doc_id"] == sent["first_id"], "left")
    to = F.when(F.col("before").isNull(), F.array("range")).otherwise(F.array("range", "before"))
    rows = doubled.select("doc_id", "text", F.posexplode(to).alias("ghost", "at"))
    dealt = rows.repartition("at").select("*", *[c.alias(name) for name, c in made.items()])
    falling = Window.partitionBy("at").orderBy("ghost", F.col("doc_id").desc(), "text")
    following = [F.lead(c).over(falling).alias(f"next_{c}") for c in ("text", *made)]
    return dealt.select("*", *following).where("ghost = 0").drop("ghost", "at")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last third of code points (rounded down) replaced by the first as many of another text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, k: int = K, ranges: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, one row per row of `docs`.

    Needs doc_id and text, ignores other columns. Returns doc_id, n_chars (code points), edited_text, sketch,
    edited_sketch, fingerprint, edited_fingerprint, near_edited and near_next (`resemblance`), contained (`containment`
    of the text in its edited text), n_shingles_estimate (`distinct_count`). The edited text is `edited_text` with the
    next document by falling doc_id; after the last comes the first, and a single document follows itself. Null text is
    empty; a text without words has an empty fingerprint, which resembles only empty ones (1.0). Rows that share a
    doc_id follow one another by text. Rows without doc_id have a fingerprint, but no next document: what depends on one
    is null. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = sketch(F.col("text"), k)
    known = with_next(docs.where("doc_id IS NOT NULL"), {"sketch": one}, ranges)
    known = known.withColumn("edited_text", edited_text(F.col("text"), F.col("next_text"))).drop("next_text")
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in (("next_sketch", "array<long>"), ("edited_text", "string"))]
    nowhere = docs.where("doc_id IS NULL").select("doc_id", "text", one.alias("sketch"), *unknown)
    rows = known.select(*nowhere.columns).unionAll(nowhere)
    rows = rows.withColumn("edited_sketch", F.when(F.col("edited_text").isNotNull(), sketch(F.col("edited_text"), k)))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        "sketch",
        "edited_sketch",
        as_fingerprint(own).alias("fingerprint"),
        as_fingerprint(edited).alias("edited_fingerprint"),
        F.when(edited.isNotNull(), resemblance(own, edited, k)).alias("near_edited"),
        F.when(following.isNotNull(), resemblance(own, following, k)).alias("near_next"),
        F.when(edited.isNotNull(), containment(own, edited, k)).alias("contained"),
        distinct_count(own, k).alias("n_shingles_estimate"),
    )
