"""Spelling variants: words one edit apart, found over a reduced alphabet.

1. Words are counted over whole texts, summed per task before the shuffle.
2. Letters are dealt to a few symbols of about equal weight.  A word written in
   symbols is its class; classes are far fewer than words.
3. Of every class the full neighbourhood of one edit is generated (each symbol
   left out, replaced, put in) and joined with the classes there are.  Words one
   edit apart lie in such a pair of classes, or in one class.
4. Pairs of words of two such classes are verified on their original letters.

The number of symbols grows with the vocabulary, so that a class holds few words
on average.  Pairs of classes that nevertheless hold many words, and words too
long for a neighbourhood, are joined by hashes of the words with one letter left
out instead of pair by pair; they are verified in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import ASCII_LOWER, ASCII_UPPER, text_rows
from loreloom.llm.shingles import mix, powers
from loreloom.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word is written as its near word if that occurs so many times as often.
RATIO = 2
#: One run of a document in so many loses a letter (see ``variant``); 0: none.
NOISE = 97
LETTERS = "A-Za-zÀ-ÿ"
#: Letters of a word of usual length, by which the number of symbols follows the vocabulary.
USUAL = 10
#: Words from this length on have no neighbourhood generated.
LONG = 40
#: Pairs of words of two classes that are verified one by one.
CLASS_PAIRS = 4096
#: Code points of a text that are cut into words at a time, and words held by a task.
PIECE, HELD = 1 << 20, 500_000
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
_MORE = re.compile(f"[{LETTERS}]*")
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


# Words and their counts.

def runs_of(text: str, least: int) -> Counter:
    """The maximal runs of at least ``least`` letters and how often they occur."""
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")
    if len(text) <= PIECE:
        return Counter(pattern.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        end = _MORE.match(text, min(at + PIECE, len(text))).end()
        found.update(pattern.findall(text, at, end))
        at = end
    return found


def variant(word: str, code: int, noise: int) -> str:
    """The word as a document has it: where ``noise`` divides the checksum of (document, word), without one letter."""
    if not noise or code % noise:
        return word
    at = code % len(word)
    return word[:at] + word[at + 1:]


def count_words(batches: Iterator[pd.DataFrame], least: int, noise: int):
    counts: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            if not text:
                continue
            start = zlib.crc32(f"{doc_id or ''}:".encode())
            for run, n in runs_of(text, least).items():
                word = run.lower() if run.isascii() else run.translate(_LOWER)
                word = variant(word, zlib.crc32(word.encode(), start), noise)
                if len(word) >= least:
                    counts[word] = counts.get(word, 0) + n
            if len(counts) >= HELD:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = {}
    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": object, "n": "int64"})


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE,
) -> DataFrame:
    """(word, n) of the words of all texts with at least ``least_count`` occurrences."""
    rows = text_rows(docs).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(
        lambda batches: count_words(batches, least_length, noise), "word string, n long"
    ).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# The reduced alphabet.

def symbols_for(words: int) -> int:
    """So many symbols that words of ``USUAL`` letters have a class each on average.

    With fewer, classes hold more words to verify; with more, neighbourhoods
    hold more words that do not exist.
    """
    count = 2
    while count ** USUAL < words:
        count += 1
    return count


def letter_symbols(words: DataFrame) -> tuple[str, str]:
    """The letters of the vocabulary and, at the same place, the symbol of each; the most common are dealt first.

    There are as many rows to read as letters in the alphabet.
    """
    total = words.count()
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    letters = sorted(((r["count"], r["letter"]) for r in letters if r["letter"]), key=lambda r: (-r[0], r[1]))
    loads = [0] * min(symbols_for(total), max(len(letters), 1))
    symbols = []
    for weight, _ in letters:
        least = loads.index(min(loads))
        loads[least] += weight
        symbols.append(chr(ord("0") + least))
    return "".join(letter for _, letter in letters), "".join(symbols)


def neighbourhood(word: Column, symbols: str) -> Column:
    """``word`` and all that one edit makes of it over ``symbols``, each once."""
    every = F.array(*[F.lit(s) for s in symbols])
    places = F.sequence(F.lit(1), F.length(word))

    def before(at: Column) -> Column:
        return F.substring(word, F.lit(1), at - 1)

    def after(at: Column) -> Column:
        return F.substring(word, at + 1, F.length(word))

    left_out = F.transform(places, lambda at: F.concat(before(at), after(at)))
    replaced = F.flatten(F.transform(places, lambda at: F.transform(every, lambda s: F.concat(before(at), s, after(at)))))
    put_in = F.flatten(F.transform(
        F.sequence(F.lit(0), F.length(word)),
        lambda at: F.transform(every, lambda s: F.concat(F.substring(word, F.lit(1), at), s, after(at))),
    ))
    return F.array_distinct(F.concat(F.array(word), left_out, replaced, put_in))


def class_pairs(classes: DataFrame, symbols: str) -> DataFrame:
    """(a, b, pairs): classes a <= b within one edit, and how many pairs of words they hold."""
    near = classes.select(F.col("class").alias("a"), F.col("members").alias("of_a"), F.explode(
        neighbourhood(F.col("class"), symbols)).alias("b")).where("a <= b")
    return near.join(classes.select(F.col("class").alias("b"), F.col("members").alias("of_b")), "b").select(
        "a", "b", (F.col("of_a") * F.col("of_b")).alias("pairs")
    )


# Words without a letter, as hashes.

def left_out_hashes(word: str) -> tuple[int, np.ndarray]:
    """A 64-bit hash of ``word`` and those of the word without each of its letters in turn."""
    codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    up = powers(_BASE, len(codes))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * up, dtype=np.uint64)))
    after = (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
    size = np.uint64(len(codes)) * np.uint64(_BASE)
    return int(mix(sums[-1:] + size).view(np.int64)[0]), mix(sums[:-1] + after + size - np.uint64(_BASE)).view(np.int64)


def send_hashes(batches: Iterator[pd.DataFrame]):
    """(id, place, hash): place -1 for the whole word, -2 for each word that one letter less makes, else by place."""
    for batch in batches:
        for word_id, word in zip(batch["id"], batch["word"]):
            whole, less = left_out_hashes(word)
            once = np.unique(less)
            yield pd.DataFrame({
                "id": word_id, "place": np.concatenate(([-1], np.full(len(once), -2), np.arange(len(less)))),
                "hash": np.concatenate((np.array([whole], dtype=np.int64), once, less)),
            })


def pairs_by_hash(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of ``words`` one edit apart once."""
    numbered = cut_lineage(words.withColumn("id", F.monotonically_increasing_id()), "numbered")
    keys = cut_lineage(numbered.select("id", "word").mapInPandas(send_hashes, "id long, place long, hash long"), "hashes")
    a, b = keys.where("place >= 0").alias("a"), keys.where("place >= 0").alias("b")
    same_length = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.place") == F.col("b.place")) & (
        F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    short = keys.where("place = -1").select(F.col("id").alias("a"), "hash")
    longer = keys.where("place = -2").select(F.col("id").alias("b"), "hash")
    met = same_length.union(short.join(longer, "hash").select("a", "b")).distinct()
    left = numbered.select(F.col("id").alias("a"), "word", "n", "class")
    right = numbered.select(
        F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("class").alias("other_class"))
    found = met.join(left, "a").join(right, "b").drop("a", "b")
    return found.mapInPandas(keep_one_edit, found.schema)


def differ_by_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``; in time linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)  # the length of the common prefix lies between
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    if len(a) == len(b):
        return low < len(a) and a[low + 1:] == b[low + 1:]
    return len(b) == len(a) + 1 and a[low:] == b[low + 1:]


def keep_one_edit(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        yield batch[[differ_by_one(a, b) for a, b in zip(batch["word"], batch["other"])]]


def one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of ``words`` (word, n) one edit apart once.

    No pair is dropped: pairs of classes with up to ``CLASS_PAIRS`` pairs of
    words are verified pair by pair, all others and words of ``LONG`` letters on
    are found by hashes.
    """
    letters, symbols = letter_symbols(words)
    alphabet = "".join(sorted(set(symbols)))
    placed = cut_lineage(words.withColumn("class", F.when(
        F.length("word") < LONG, F.translate("word", letters, symbols))), "classed")
    classes = placed.where("class is not null").groupBy("class").agg(F.count("*").alias("members"))
    pairs = cut_lineage(class_pairs(classes, alphabet or "0"), "class-pairs")
    light = pairs.where(F.col("pairs") <= CLASS_PAIRS).select("a", "b")
    right = placed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("class").alias("b"))
    columns = ["word", "n", "other", "other_n"]
    found = light.join(placed.withColumnRenamed("class", "a"), "a").join(right, "b").where(
        (F.col("a") < F.col("b")) | (F.col("word") < F.col("other"))
    ).where(one_edit("word", "other")).select(columns)
    heavy = cut_lineage(pairs.where(F.col("pairs") > CLASS_PAIRS).select("a", "b"), "heavy")
    crowded = heavy.select(F.col("a").alias("class")).union(heavy.select("b")).distinct()
    some = cut_lineage(placed.where(F.length("word") >= LONG - 1).unionByName(
        placed.where(F.length("word") < LONG - 1).join(crowded, "class", "left_semi").select(placed.columns)), "keyed")
    if some.isEmpty():
        return found
    met = cut_lineage(pairs_by_hash(some), "met").withColumns({
        "a": F.least("class", "other_class"), "b": F.greatest("class", "other_class")})
    long = met.where("class is null or other_class is null")
    return found.unionByName(met.where("class is not null and other_class is not null").join(
        heavy, ["a", "b"], "left_semi").select(columns)).unionByName(long.select(columns))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last word that forms lead to.

    A form occurs at least ``RATIO`` times as often as its word, so chains end;
    each round doubles the steps taken.
    """
    steps = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("root").alias("then"))
        moved = cut_lineage(steps.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "steps")
        if moved.where("moved").isEmpty():
            break
        steps = moved.select("word", "root")
    return forms.join(moved.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, ratio: int = RATIO, noise: int = NOISE,
) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n.

    * Words are maximal runs of Latin-1 letters of at least ``least_length`` code
      points, A-Z lower-cased, that occur ``least_count`` times over all texts.
      ``noise`` plants misspellings (see ``variant``); 0 reads texts as they are.
    * Words are near if one inserted, deleted or replaced code point is all they
      differ by.  ``form`` is the near word that occurs most often (``form_n``
      times; ties: the first in code-point order) if that is at least ``ratio``
      times ``n``, else null.  ``root`` is where forms end, the word itself
      without one.
    * Null and empty texts have no words; texts and words of any length are read
      whole.  A null id counts as an empty one; repeated rows are counted as
      often as they stand there.  An empty table gives no rows; other columns
      are not read.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col, least_length, least_count, noise), "vocabulary")
    near = cut_lineage(near_words(words), "near")
    both = near.unionByName(near.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("takes", -F.col("best.n") >= F.col("n") * ratio)
    forms = cut_lineage(chosen.select(
        "word", F.when(F.col("takes"), F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("takes"), -F.col("best.n")).alias("form_n"),
    ), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
