"""Document fingerprints: bottom-k sketches of shingle hashes (operator 7).

The fingerprint of a text is the ``k`` smallest distinct hashes of its shingles of five
words (ASCII white space between words, A-Z as a-z; a text of one to four words has one
shingle). Sketches of parts merge into the sketch of the whole, and from two sketches follow
the resemblance, the containment and the number of distinct shingles, exactly while a text
has at most ``k`` of them. All of it is built-in functions on arrays in the document's own
row; no Python runs on executors.

Edge cases: a null text is the empty text. Two texts without words resemble each other
fully, one without words resembles no other. Documents with the same identifier are
ordered by their text, and a single document is its own successor. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import SHINGLE

K = 128
SPACE = r"[\x20\x09-\x0D]+"
BLOCK_ROWS, MOST_RANGES, DRAWN = 2048, 1 << 14, 100


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all shingles; empty for a text without words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(pair: Column) -> Column:
        h = pair["h"]
        whole = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))
        )
        each = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]))
        return F.when(F.size(h) < width, whole).otherwise(each)

    # one-element array: the words are hashed once, not once for each use
    return F.transform(F.array(F.struct(hashed.alias("h"))), runs)[0]


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct values."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of what two sketches stand for together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""
    joint = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(joint, a), b))
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both / F.size(joint))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    rank = (F.element_at(a, -1) / F.lit(2.0**64)) + 0.5  # place of the k-th smallest hash among all
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(rank, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    similar = resemblance(a, b, k)
    joint = similar / (1 + similar) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """Hexadecimal, 16 digits a hash, smallest first."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``doc_id, sketch``, one row per document."""
    return docs.select(F.col(id_col).alias("doc_id"), bottom(shingles(F.col(text_col)), k).alias("sketch"))


def with_next(rows: DataFrame, order: str, carried: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row with columns ``next_<name>`` of the row that follows it by ``order``; after
    the last comes the first.

    The order is cut into ranges of about ``block_rows`` rows, or into ``MOST_RANGES`` ranges if that would make more (a
    range is sorted by one task, which spills), so what the driver sees of them is bounded. The cuts
    are quantiles of ``order`` over a sample of ``DRAWN`` rows a range; they decide where rows are sorted, not what follows
    what. A row finds its range by bisection. The first row of every range is sent to the range before
    as well; that is the one row the range before lacks. Rows with one and the same ``order`` are in one range.
    """
    total = rows.select(order).count()
    ranges = min(max(total // block_rows, 1), MOST_RANGES)
    cuts = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        share = min(1.0, DRAWN * ranges / total)
        drawn = rows.select(order) if share == 1 else rows.select(order).sample(share, 7)
        cuts = sorted(set(drawn.select(F.percentile_approx(order, F.array(*map(F.lit, at)), ranges * 4)).first()[0] or []))
    spark = rows.sparkSession
    block = F.lit(0)
    if cuts:
        bounds, n_bits = F.array(*map(F.lit, cuts)), len(cuts).bit_length()

        def halve(low: Column, bit: Column) -> Column:
            """``low`` cuts are known to be at or below the value; are ``bit`` more?"""
            return F.when(F.get(bounds, low + bit - 1) <= F.col(order), low + bit).otherwise(low)

        block = F.aggregate(F.array(*[F.lit(1 << b) for b in range(n_bits)[::-1]]), F.lit(0), halve)
    placed = rows.withColumn("_block", F.when(F.col(order).isNull(), 0).otherwise(block).cast("int"))
    n = len(cuts) + 1
    # at most one row per range, MOST_RANGES at most: the identifier its successor range begins with
    filled = sorted(r["_block"] for r in placed.select("_block").distinct().collect())
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    lead = spark.createDataFrame(list(before.items()) or [(0, 0)], "_block int, _before int")
    firsts = placed.groupBy("_block").agg(F.min(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"))).alias("_first"))
    heads = firsts.join(F.broadcast(lead), "_block").select("_block", "_before", F.col("_first.at").alias("_at"))
    ghosts = placed.join(F.broadcast(heads), "_block").where(F.col(order).eqNullSafe(F.col("_at"))).withColumn(
        "_block", F.col("_before")
    ).drop("_before", "_at")
    tie = [c for c in rows.columns if c != order and c in carried]
    both = placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
    inside = Window.partitionBy("_block").orderBy("_ghost", F.asc_nulls_first(order), *tie)
    led = both.repartitionById(n, F.col("_block")).select(
        *rows.columns, "_ghost", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carried]
    )
    return led.where(~F.col("_ghost")).drop("_ghost")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the
    beginning of the next document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", bottom(shingles(F.col("text")), k))
    pairs = with_next(rows, "doc_id", ["text", "sketch"])
    edited = F.concat(
        F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
        F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))"),
    )
    made = pairs.withColumn("edited", edited).withColumn("edited_sketch", bottom(shingles(F.col("edited")), k))
    return made.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
