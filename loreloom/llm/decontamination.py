"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Items are put into size classes.  A class has a window of W words and a stride
S with W + S - 1 words of every passage that is similar enough to one of its
items left unchanged (``clean_run``).  Items are fingerprinted at every offset,
documents at every S-th word, so such a passage shares a whole window, and its
fingerprint, with the item.  Fingerprints within ``RADIUS`` bits are found
through RADIUS + 1 tables, one per block of bits: two fingerprints that near
agree in one block at least.  Every hit is aligned, and the document's windows
around it are compared with the item: each shingle weighs as often as it occurs,
and the similarity is the weighted Jaccard measure.  With ``stretch`` the windows
have every length at which the item can be similar enough, else the item's own.

Documents are read once, where they lie, and never shuffled.  Benchmarks are
sent to the tasks in portions of at most ``PORTION`` items, one pass each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_rows
from loreloom.llm.shingles import WordReader, shingle_hashes

WORDS = 5
LEAST = 0.75
RADIUS = 3
WINDOWS = (5, 8, 12, 16, 24, 32)
#: Items that one pass over the documents looks for: about 10 MB of fingerprints.
PORTION = 20_000
#: Window starts that are fingerprinted at a time.
SEGMENT = 1 << 16


def clean_run(n_words: int, k: int, least: float) -> int:
    """Words in a row that stay unchanged, at least, in a passage of ``n_words`` similar by ``least``.

    The passage keeps ``least`` of its shingles; a changed word inside loses k
    of them, one at an end loses one.  A word put in or a part moved loses only
    k - 1, but adds as many at least to the union; with ``least`` of the union
    kept, that costs no less than k lost ones.
    """
    inside, ends = divmod(most_lost(n_words - k + 1, least), k)
    return (n_words - ends - inside) // (inside + 1)


def most_lost(n: int, least: float) -> int:
    """Most of ``n`` shingles that a text similar by ``least`` can lack."""
    return int(n - np.ceil(n * least - 1e-9))


def stride(window: int) -> int:
    return max(1, window // 4)


def window_of(n_words: int, k: int, least: float) -> int:
    run = clean_run(n_words, k, least)
    return max([w for w in WINDOWS if w >= k and w + stride(w) - 1 <= run], default=k)


def fingerprints(shingles: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """SimHash (majority of bits) of windows: for each (sorted starts, size) one print per start.

    Running sums of the bits are made once per segment, for all sizes.  They are
    kept modulo 2^8: a window has fewer shingles than that.
    """
    longest = max((size for _, size in wanted), default=0)
    assert longest < 256
    out = [np.empty(len(starts), dtype=np.uint64) for starts, _ in wanted]
    for low in range(0, len(shingles), SEGMENT):
        part = shingles[low : low + SEGMENT + longest]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(part) + 1, 64), dtype=np.uint8)
        np.cumsum(bits, axis=0, dtype=np.uint8, out=sums[1:])
        for (starts, size), prints in zip(wanted, out):
            begin, end = np.searchsorted(starts, (low, low + SEGMENT))
            here = starts[begin:end] - low
            ones = sums[here + size] - sums[here]
            prints[begin:end] = np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel()
    return out


class Blocks:
    """Multi-index Hamming tables over fingerprints: all within ``radius`` of a query."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.tables = []
        for low, high in zip(cuts, cuts[1:]):
            width = high - low
            value = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
            order = np.argsort(value, kind="stable")
            self.tables.append((low, width, order, value[order]))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) numbers of all pairs within the radius, some more than once."""
        found_q, found_e = [], []
        for low, width, order, values in self.tables:
            wanted = (queries >> np.uint64(low)) & np.uint64((1 << width) - 1)
            first = np.searchsorted(values, wanted, side="left")
            many = np.searchsorted(values, wanted, side="right") - first
            hit = np.flatnonzero(many)
            if not len(hit):
                continue
            query = np.repeat(hit, many[hit])
            step = np.arange(len(query)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
            entry = order[np.repeat(first[hit], many[hit]) + step]
            close = np.bitwise_count(queries[query] ^ self.prints[entry]) <= self.radius
            found_q.append(query[close])
            found_e.append(entry[close])
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_e)


class Portion:
    """Fingerprint tables and counted shingles of some benchmark items."""

    def __init__(self, item_ids: list[int], texts: list[str | None], k: int, least: float, radius: int,
                 stretch: bool = False) -> None:
        self.k, self.least, self.stretch = k, least, stretch
        reader = WordReader()
        self.ids, self.counts, self.lengths = [], [], []
        by_window: dict[int, list] = {}
        for item_id, text in zip(item_ids, texts):
            words = reader.words(text)
            if len(words) < k:
                continue
            shingles = shingle_hashes(words, k)
            number = len(self.ids)
            self.ids.append(item_id)
            self.counts.append(Counter(shingles.tolist()))
            self.lengths.append(len(shingles))
            window = window_of(len(words), k, least)
            size = window - k + 1
            starts = np.arange(len(shingles) - size + 1)
            prints, first = np.unique(fingerprints(shingles, [(starts, size)])[0], return_index=True)
            by_window.setdefault(window, []).append((number, prints, first))
        self.classes = []
        for window, items in sorted(by_window.items()):
            prints = np.concatenate([p for _, p, _ in items])
            item = np.concatenate([np.full(len(p), n) for n, p, _ in items])
            offset = np.concatenate([f for _, _, f in items])
            self.classes.append((window, Blocks(prints, radius), item, offset))

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        other = Counter(shingles.tolist())
        common = (self.counts[item] & other).total()
        return common / (self.lengths[item] + len(shingles) - common)

    def near(self, item: int, text: np.ndarray, at: int) -> tuple[float, int]:
        """Similarity of the window of the item's size at ``at``; if it fails, of the first near it that does not.

        Words put in or left out before the hit move the window by as many
        places as the item can lose shingles, at most.
        """
        size = self.lengths[item]
        moved = most_lost(size, self.least)
        for step in (0, *(sign * d for d in range(1, moved + 1) for sign in (-1, 1))):
            start = at + step
            if 0 <= start < len(text):
                found = self.similarity(item, text[start : start + size])
                if found >= self.least:
                    return found, start
        return 0.0, at

    def stretched(self, item: int, text: np.ndarray, at: int) -> tuple[float, int]:
        """The best window of any length that holds a hit aligned at ``at``, the first of equal ones; 0.0 if none is similar.

        Best windows begin and end with shingles of the item.  A window similar
        by s holds s of the item's shingles at least.
        """
        counts, size = self.counts[item], self.lengths[item]
        longest = int(size / self.least + 1e-9)
        low = max(at - longest, 0)
        part = text[low : max(at + size + longest, 0)].tolist()
        own = [place for place, shingle in enumerate(part) if shingle in counts]
        best, first, end = 0.0, at, 0
        for number, start in enumerate(own):
            while end < len(own) and own[end] < start + longest:
                end += 1
            if end - number < max(self.least, best) * size - 1e-9:
                continue
            seen: Counter = Counter()
            common = 0
            for place in own[number:end]:
                shingle = part[place]
                seen[shingle] += 1
                common += seen[shingle] <= counts[shingle]
                found = common / (size + place - start + 1 - common)
                if found >= self.least and found > best:
                    best, first = found, low + start
            if best == 1.0:
                break
        return best, first

    def matches(self, shingles: np.ndarray, begins: np.ndarray, counts: np.ndarray):
        """(text number, item, similarity, first word) of the best window of each text and item.

        ``begins`` and ``counts`` say where the shingles of each text lie.
        """
        best: dict[tuple[int, int], tuple[float, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        places = []
        for window, *_ in self.classes:
            step = stride(window)
            per_text = np.maximum((counts - (window - self.k + 1)) // step + 1, 0)
            text = np.repeat(np.arange(len(counts)), per_text)
            places.append((text, (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * step))
        wanted = [(begins[text] + local, window - self.k + 1) for (text, local), (window, *_) in zip(places, self.classes)]
        for (_, blocks, item, offset), (text, local), prints in zip(self.classes, places, fingerprints(shingles, wanted)):
            query, entry = blocks.near(prints)
            for q, e in zip(query.tolist(), entry.tolist()):
                t, i = int(text[q]), int(item[e])
                at = int(local[q]) - int(offset[e])
                if not self.stretch:
                    at = min(max(at, 0), int(counts[t]) - 1)
                if (t, i, at) in tried:
                    continue
                tried.add((t, i, at))
                begin = int(begins[t])
                own = shingles[begin : begin + int(counts[t])]
                found, start = self.stretched(i, own, at) if self.stretch else self.near(i, own, at)
                if found > best.get((t, i), (0.0, 0))[0]:
                    best[t, i] = (found, start)
        return [(t, self.ids[i], s, at) for (t, i), (s, at) in sorted(best.items())]


def search(batches: Iterator[pd.DataFrame], portion: Portion):
    reader, k = WordReader(), portion.k
    for batch in batches:
        ids, row, found = batch["doc_id"].tolist(), 0, []
        for words, n_words in reader.groups(batch["text"].tolist()):
            begins = np.cumsum(n_words) - n_words
            counts = np.maximum(n_words - k + 1, 0)
            # Shingles across the ends of texts are computed too and lie in no window.
            shingles = shingle_hashes(words, k) if len(words) >= k else np.zeros(0, np.uint64)
            for t, item, similarity, at in portion.matches(shingles, begins, counts):
                found.append((ids[row + t], item, similarity, at))
            row += len(n_words)
        yield pd.DataFrame(found, columns=["doc_id", "item_id", "similarity", "first_word"]).astype({"item_id": "int64"})


def portions(
    benchmark: DataFrame, item_col: str, item_text_col: str, k: int, least: float, radius: int, size: int,
    stretch: bool = False,
) -> Iterator[Portion]:
    """The benchmark in portions of about ``size`` items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    passes = max(1, -(-items.count() // size))
    for number in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).toPandas()
        yield Portion(part["item_id"].tolist(), part["text"].tolist(), k, least, radius, stretch)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
    k: int = WORDS, least: float = LEAST, radius: int = RADIUS, portion: int = PORTION,
    stretch: bool = False,
) -> DataFrame:
    """One row per (document, item) that match: doc_id, item_id, similarity, first_word.

    * The best window counts, of equal ones the first found: of windows of the
      item's own size, or with ``stretch`` of all lengths, so that words put in
      or left out do not hide a passage that is similar as a whole.  Clean documents
      have no rows; null, empty and short texts match nothing.
    * Items of fewer than ``k`` words, or null, are too short to tell a passage
      by and match nothing.  Items with one text match the same documents.
    * Whole texts are read; repeated rows give repeated matches; null ids stay
      null; empty tables give no rows; other columns are not read.  Item ids
      are integers.
    """
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for wanted in portions(benchmark, item_col, item_text_col, k, least, radius, portion, stretch):
        hits = rows.mapInPandas(
            lambda batches, wanted=wanted: search(batches, wanted),
            "doc_id long, item_id long, similarity double, first_word long",
        )
        found = hits if found is None else found.unionByName(hits)
    return found


def leak_flag(wanted: Portion):
    """A column function: does a text match an item of the portion?"""

    def flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts.reset_index(drop=True)})
            hit = np.zeros(len(texts), dtype=bool)
            for found in search([rows], wanted):
                hit[found["doc_id"].to_numpy(dtype=np.int64)] = True
            yield pd.Series(hit)

    return F.pandas_udf(flags, "boolean")


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, k: int = WORDS, least: float = LEAST, radius: int = RADIUS,
    portion: int = PORTION, stretch: bool = False,
) -> DataFrame:
    """The rows of ``docs`` whose text matches no item, decided where a row lies."""
    for wanted in portions(benchmark, "item_id", "text", k, least, radius, portion, stretch):
        docs = text_rows(docs).where(~leak_flag(wanted)(F.col("text")))
    return docs
