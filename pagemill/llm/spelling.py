"""Spelling variants: words one edit apart, and the form each variant stands for (operator 12).

The vocabulary is laid out as two tries, of the words and of the words reversed. A node is a 64-bit hash, of the parent's
hash and the letter that leads here. The edge table of a depth holds, per node, the next letter and the one after it, and the words
that end; it comes from the words themselves walking down their own path. The frontier holds states
``(word, position, node, edits)``. Level by level, the states at one depth are joined with the edges of that depth: a
letter that fits goes on, and a state without an edit also tries one inserted, deleted or replaced letter. As edges know two
letters, the join is on node and second letter, and a state that would fail in the next level is not made at all.
A state that has read its whole word with one edit, at a node where a word ends, is a pair of neighbours.

One edit lies in the first half of a word or in the second, so a state starts at the node of
its word's first half (in the other trie: of the reversed second half) and only edits what comes after.
That skips the top of the tries, where every letter goes on everywhere. Among equal edits in a run of equal
letters only the last is tried. Hashes of nodes decide where rows meet only; pairs are checked by edit distance.

Each level is a written table of the states it passed on and the pairs it found, so that a lost executor
costs a level at most. There are as many levels as letters in the longest word, up to ``longest``.
Pairs in which a word is longer come from a join of the hashes of all their one-letter
deletions instead (two words are one replacement apart if they agree after deleting the same place, one insertion apart
if one is a deletion of the other), which costs one row per letter. No pair is left out. The number of neighbours of a word is bounded by
its length and the alphabet, not by the corpus.

Edge cases: a null text has no words; a null identifier counts as the empty text in
the hash that damages words. Repeated rows count as often as they occur. Ties of ``n`` go to the word that
is smaller in code-point order. An empty table, or one without a repeated word, gives an empty result. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import drop_path, drop_stage, mix
from pagemill.operators.staging import shared_folder, stage

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, RATIO, LONGEST = 7, 2, 10, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEAR = "word string, near string, near_n long"


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, damage: int = 0
) -> DataFrame:
    """``word, n``: runs of letters, A-Z in lower case, with at least ``shortest`` letters and
    ``least`` occurrences. With ``damage``, a run loses the letter ``h % length`` if ``damage`` divides
    the crc32 ``h`` of identifier, colon and run."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{shortest},}}+"), F.lit(0))).alias("run"),
    ).select("doc", F.translate("run", _UPPER, _LOWER).alias("word"))
    if damage:
        h = F.crc32(F.concat_ws(":", "doc", "word").cast("binary"))
        at = F.pmod(h, F.char_length("word").cast("long")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.pmod(h, F.lit(damage)) == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.where(F.char_length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _written(df: DataFrame, name: str, by: str) -> tuple[str, DataFrame]:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


_STATE = ["forward", "read", "n", "pos", "edited", "node"]


def _letter(place: Column) -> Column:
    return F.substring("read", place + 1, F.lit(1))


def _begin() -> Column:
    size = F.char_length("read")
    half = F.floor(size / 2).cast("int")
    return F.when(F.col("forward"), half).otherwise(size - half)


def _starts(words: DataFrame) -> DataFrame:
    """Each word as it is read in either trie, at the node before the one from which it may be edited."""
    read = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("forward")).select(
        "forward", F.when(F.col("forward"), F.col("word")).otherwise(F.reverse("word")).alias("read"), "n",
    ).withColumn("pos", F.greatest(_begin() - 1, F.lit(0)))
    head = F.slice(F.split("read", ""), F.lit(1), F.col("pos"))
    node = F.aggregate(head, F.xxhash64(F.lit("root"), "forward"), lambda up, letter: F.xxhash64(up, letter))
    return read.select("forward", "read", "n", "pos", F.lit(False).alias("edited"), node.alias("node"), F.col("pos").alias("begin"))


def _word() -> Column:
    return F.when(F.col("forward"), F.col("read")).otherwise(F.reverse("read"))


def _edges(states: DataFrame) -> DataFrame:
    """``node, first, second, near, near_n``: letters that go on from a node; empty where a word ends,
    which is then ``near``."""
    pos, over = F.col("pos"), F.col("pos") == F.char_length("read")
    return states.where("not edited").select(
        "node", _letter(pos).alias("first"), _letter(pos + 1).alias("second"), F.when(over, _word()).alias("near"),
        F.when(over, F.col("n")).alias("near_n"),
    ).distinct()


def _tries(states: DataFrame) -> DataFrame:
    """What a state looks for among the edges: a second letter, and a first one that ``is`` or ``isnt`` some letter;
    ``next`` is the position after taking the first."""
    pos, here, there = F.col("pos"), _letter(F.col("pos")), _letter(F.col("pos") + 1)
    over, edited, none = pos == F.char_length("read"), F.col("edited"), F.lit(None).cast("string")

    def look(second: Column, is_: Column, isnt: Column, after: Column) -> Column:
        return F.struct(second.alias("second"), is_.alias("is"), isnt.alias("isnt"), after.cast("int").alias("next"))

    onward = look(there, here, none, pos + 1)  # at the end of the word: the edge that says that a word ends
    # of a run of equal letters the last is left out; reading goes on with the letter after it
    cut = ~edited & ~over & (here != there)
    tries = F.array(
        F.when(edited, onward),
        F.when(cut, look(_letter(pos + 2), there, none, pos + 2)),
        F.when(~edited & ~over, look(there, none, here, pos + 1)),
        F.when(~edited, look(here, none, here, pos)),
    )
    ready = states.where(edited | (pos >= _begin()))
    return ready.select("forward", "read", "node", F.explode(tries).alias("t")).where("t is not null").select(
        "forward", "read", "node", "t.*"
    )


def _advanced(states: DataFrame) -> DataFrame:
    """States one level deeper, and pairs: rows with ``near``."""
    node = F.xxhash64("node", "first").alias("node")
    right = (F.col("first") == F.col("is")) | ((F.col("first") != F.col("isnt")) & (F.col("first") != ""))
    moved = _tries(states).join(_edges(states), ["node", "second"]).where(right).select(
        "forward", "read", F.lit(None).cast("long").alias("n"), F.col("next").alias("pos"), F.lit(True).alias("edited"), node,
        "near", "near_n", F.col("near").isNotNull().alias("found"),
    )
    walking = states.where(~F.col("edited") & (F.col("pos") < F.char_length("read"))).withColumn("first", _letter(F.col("pos"))).select(
        "forward", "read", "n", (F.col("pos") + 1).alias("pos"), "edited", node, F.lit(None).cast("string").alias("near"),
        F.lit(None).cast("long").alias("near_n"), F.lit(False).alias("found"),
    )
    return moved.unionByName(walking)


def _near_by_trie(words: DataFrame, deepest: int) -> DataFrame:
    """``word, near, near_n`` among words of at most ``deepest`` letters."""
    spark = words.sparkSession
    start_path, starts = _written(_starts(words), "starts", "begin")
    found, carried, before = [], None, None
    for depth in range(starts.agg(F.min("begin")).first()[0], deepest + 1):
        states = starts.where(F.col("begin") == depth).select(*_STATE)
        if carried is not None:
            states = states.unionByName(carried)
        path, out = _written(_advanced(states), "frontier", "found")
        found.append(out.where("found").select(_word().alias("word"), "near", "near_n"))
        carried = out.where("not found").select(*_STATE)
        if before:
            drop_path(spark, f"{before}/found=false")
        before = path
    drop_path(spark, start_path)
    return reduce(DataFrame.unionByName, found)


_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers have inverses modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each word (place -1) and of the word without each of its letters."""
    for batch in batches:
        for word_id, word in zip(batch["id"].to_pylist(), batch["word"].to_pylist(), strict=True):
            letters = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64))
            terms = letters * np.multiply.accumulate(np.full(len(letters), _STEP))
            before = np.cumsum(terms)
            hashes = np.concatenate([before[-1:], before - terms + (before[-1] - before) * _BACK])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hashes), word_id)), pa.array(np.arange(-1, len(letters))), pa.array(hashes.view(np.int64))],
                names=["id", "place", "hash"],
            )


def _near_by_deletion(words: DataFrame, longest: int) -> DataFrame:
    """``word, near, near_n`` of pairs in which a word has more than ``longest`` letters."""
    words = words.where(F.char_length("word") >= longest).select(F.xxhash64("word").alias("id"), "word", "n")
    rows = stage(words.select("id", "word").mapInArrow(_deletions, "id long, place long, hash long"), "deletions")
    whole, cut = rows.where("place < 0"), rows.where("place >= 0")
    other = F.col("id").alias("other")
    swapped = cut.join(cut.select(other, "place", "hash"), ["place", "hash"]).where("id <> other").select("id", "other")
    longer = cut.join(whole.select(other, "hash"), "hash").select("id", "other").distinct()
    pairs = swapped.distinct().unionByName(longer).unionByName(longer.select(F.col("other").alias("id"), F.col("id").alias("other")))
    a, b = words.select("id", "word"), words.select(other, F.col("word").alias("near"), F.col("n").alias("near_n"))
    either = F.greatest(F.char_length("word"), F.char_length("near")) > longest
    return pairs.join(a, "id").join(b, "other").where(either).select("word", "near", "near_n")


def neighbours(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, near, near_n`` for all pairs of ``words`` (``word, n``) one edit apart, both ways."""
    most = words.agg(F.max(F.char_length("word"))).first()[0]
    if most is None:
        return words.sparkSession.createDataFrame([], _NEAR)
    pairs = _near_by_trie(words.where(F.char_length("word") <= longest), min(most, longest))
    if most > longest:
        pairs = pairs.unionByName(_near_by_deletion(words, longest))
    return pairs.repartition("word").distinct().where(F.levenshtein("word", "near", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: where following forms ends, by pointer jumping (each
    form is ten times as frequent as its word, so chains are short and have no cycles)."""
    labels = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = labels.select(F.col("word").alias("root"), F.col("root").alias("up"))
        after = stage(
            labels.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")),
            "roots",
        )
        drop_stage(labels)
        labels = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return labels


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST,
    ratio: int = RATIO, longest: int = LONGEST, damage: int = 0,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    words = stage(vocabulary(docs, id_col, text_col, shortest, least, damage), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = neighbours(words, longest).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    n = -F.col("best.minus")
    known = stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(n >= F.col("n") * ratio, F.col("best.near")).alias("form"), F.when(n >= F.col("n") * ratio, n).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
