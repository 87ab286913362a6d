"""Jaccard join of word-shingle sets by a grouped prefix join.

1. Documents with equal sets are one class; its smallest id stands for it.
2. A document that links with another shares at least 75 of 100 of its
   shingles with it.  Shingles that one class alone has are found by counting
   them over the whole corpus; classes with too many of those are done.
3. The sets of the others are ordered from rare to frequent shingles.  Two sets
   that link share a shingle of their prefixes.  Classes with equal prefix and
   size are one group, and groups stand in the lists of their prefix shingles.
4. First every group is verified against the leader that most of its lists
   agree on, and the members of a group against its first one.  What no leader
   links chooses again among itself, until a round links nothing new.  What is
   linked becomes one component.
5. Then all pairs of one list that lie in different components and pass the
   bounds by size, position and common leader are expanded to members and
   verified, so no link between components is lost, and links inside a
   component need no pairs.

Shingle counts travel as sorted arrays per (block of documents, range of
hashes), every shingle once per block, so copies and passages that many
documents share are summed before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import components, settings, text_rows
from loreloom.llm.shingles import WordReader, shingle_hashes
from loreloom.session import cut_lineage

WORDS = 5
#: Similarity in hundredths.
LEAST = 75
#: Shingles in a block, about; a block is what one task holds at a time.
BLOCK = 1_000_000
#: Bytes of text whose shingles are counted in one range of hashes, about: ranges grow in number, not in size.
RANGE_BYTES = 24_000_000
DIGEST = 16
#: Runtime filters for joins of any size; the filter itself has at most Spark's maxNumBits.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def least_overlap(n: int, hundredths: int) -> int:
    """Fewest common shingles of a linked set of ``n`` with any other."""
    return -(-hundredths * n // 100)


def pair_overlap(a: Column, b: Column, hundredths: int) -> Column:
    """Fewest common shingles of linked sets of sizes ``a`` and ``b``."""
    return F.ceil(F.lit(hundredths) * (a + b) / F.lit(100 + hundredths))


def blocks_of(batches: Iterator[pd.DataFrame], k: int):
    """(block id, ids, sets) for runs of documents with about BLOCK shingles; sets are sorted and distinct."""
    reader = WordReader()
    block, ids, sets, size = TaskContext.get().partitionId() << 24, [], [], 0
    for batch in batches:
        row = 0
        doc_ids = batch["doc_id"].tolist()
        for hashes, counts in reader.groups(batch["text"].tolist()):
            ends = np.cumsum(counts)
            for start, end in zip(ends - counts, ends):
                sets.append(np.unique(shingle_hashes(hashes[start:end], k)))
                ids.append(doc_ids[row])
                size += len(sets[-1])
                row += 1
                if size >= BLOCK:
                    yield block, ids, sets
                    block, ids, sets, size = block + 1, [], [], 0
    if ids:
        yield block, ids, sets


def bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of 64-bit values starts in sorted ``hashes``, and the end."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, cuts), [len(hashes)]))


# Counting, first pass: which shingles has a class alone?

FIRST_PASS = "bucket int, block long, ids binary, known binary, sizes binary, digests binary, own binary, once binary"


def send_first(batches: Iterator[pd.DataFrame], k: int, buckets: int):
    """Per block: its documents (bucket -1), and per range of hashes the shingles with where they are.

    ``own`` has, per document, the number of its shingles that other classes of
    the block have too; in range rows, how many of ``once`` belong to each.
    ``once`` are hashes that one class of the block has; hashes of several
    classes come once, behind them, as a part of no document.
    """
    for block, ids, sets in blocks_of(batches, k):
        digests = [hashlib.blake2b(s.tobytes(), digest_size=DIGEST).digest() for s in sets]
        first: dict[bytes, int] = {}
        for i, digest in enumerate(digests):
            first.setdefault(digest, i)
        chosen = [i for i in first.values() if len(sets[i])]
        own = np.zeros(len(sets), dtype=np.int64)
        hashes = np.concatenate([sets[i] for i in chosen]) if chosen else np.zeros(0, np.uint64)
        doc = np.repeat(np.array(chosen, dtype=np.int64), [len(sets[i]) for i in chosen])
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True) if len(hashes) else new
        own += np.bincount(doc[~alone], minlength=len(sets))
        edges = bucket_edges(hashes, buckets)
        for b in range(buckets):
            here = slice(edges[b], edges[b + 1])
            mine, many = alone[here], new[here] & ~alone[here]
            by_doc = np.argsort(doc[here][mine], kind="stable")
            low = hashes[here].astype(np.uint32)
            yield pd.DataFrame({
                "bucket": [b], "block": [block], "ids": [None], "known": [None], "sizes": [None], "digests": [None],
                "own": [np.bincount(doc[here][mine], minlength=len(sets)).astype(np.uint32).tobytes()],
                "once": [np.concatenate((low[mine][by_doc], low[many])).tobytes()],
            })
        yield pd.DataFrame({
            "bucket": [-1 - block % buckets], "block": [block],
            "ids": [np.array([0 if i is None or i != i else i for i in ids], dtype=np.int64).tobytes()],
            "known": [np.array([i is not None and i == i for i in ids]).tobytes()],
            "sizes": [np.array([len(s) for s in sets], dtype=np.int64).tobytes()],
            "digests": [b"".join(digests)], "own": [own.tobytes()], "once": [None],
        })


def count_first(rows: pd.DataFrame) -> pd.DataFrame:
    """For one range of hashes: per block, how many of each document's hashes other blocks have too."""
    if rows["bucket"].iloc[0] < 0:
        return rows
    per_doc = [np.frombuffer(data, dtype=np.uint32).astype(np.int64) for data in rows["own"]]
    sent = [np.frombuffer(data, dtype=np.uint32) for data in rows["once"]]
    lengths = [int(counts.sum()) for counts in per_doc]
    # Hashes of several classes of a block stand twice: they are not alone anywhere.
    every = np.concatenate([x[:n] for x, n in zip(sent, lengths)] + [x[n:] for x, n in zip(sent, lengths)] * 2)
    order = np.argsort(every)
    same = every[order[1:]] == every[order[:-1]]
    shared = np.zeros(len(every), dtype=bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    found, at = [], 0
    for counts, n in zip(per_doc, lengths):
        hits = np.concatenate(([0], np.cumsum(shared[at:at + n])))
        ends = np.cumsum(counts)
        found.append((hits[ends] - hits[ends - counts]).astype(np.int64).tobytes())
        at += n
    return rows.assign(own=found, once=None)


def finish_first(rows: pd.DataFrame, hundredths: int) -> pd.DataFrame:
    """Per document of one block: its size, class and whether enough of its shingles are shared."""
    head = rows[rows["bucket"] < 0].iloc[0]
    ids, known = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["known"], bool)
    sizes = np.frombuffer(head["sizes"], np.int64)
    shared = sum(np.frombuffer(data, np.int64) for data in rows["own"])
    needed = -(-hundredths * sizes // 100)
    return pd.DataFrame({
        "doc_id": pd.array(np.where(known, ids, 0), dtype="Int64").copy() if known.all() else pd.array(
            [int(i) if k else None for i, k in zip(ids, known)], dtype="Int64"),
        "n": sizes,
        "digest": [head["digests"][i * DIGEST:(i + 1) * DIGEST] for i in range(len(ids))],
        "open": (sizes > 0) & (shared >= needed),
    })


def profiles(rows: DataFrame, k: int, hundredths: int, buckets: int) -> DataFrame:
    """One row per row of ``rows`` (doc_id, text): doc_id, n, digest, open."""
    return (
        rows.mapInPandas(lambda batches: send_first(batches, k, buckets), FIRST_PASS)
        .groupBy("bucket").applyInPandas(count_first, FIRST_PASS)
        .groupBy("block").applyInPandas(
            lambda part: finish_first(part, hundredths), "doc_id long, n long, digest binary, open boolean"
        )
    )


# Counting, second pass: how often has each shingle been seen among the open classes?

BLOCKS = "block long, ids binary, sizes binary, hashes binary"
COUNTS = "bucket int, block long, keys binary, counts binary"


def pack_blocks(batches: Iterator[pd.DataFrame], k: int):
    for block, ids, sets in blocks_of(batches, k):
        yield pd.DataFrame({
            "block": [block], "ids": [np.array(ids, dtype=np.int64).tobytes()],
            "sizes": [np.array([len(s) for s in sets], dtype=np.int64).tobytes()],
            "hashes": [np.concatenate(sets).tobytes()],
        })


def send_counts(batches: Iterator[pd.DataFrame], buckets: int):
    for batch in batches:
        for block, data in zip(batch["block"], batch["hashes"]):
            keys, counts = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
            edges = bucket_edges(keys, buckets)
            for b in range(buckets):
                here = slice(edges[b], edges[b + 1])
                yield pd.DataFrame({
                    "bucket": [b], "block": [block], "keys": [keys[here].tobytes()],
                    "counts": [counts[here].astype(np.int64).tobytes()],
                })


def sum_counts(rows: pd.DataFrame) -> pd.DataFrame:
    keys = [np.frombuffer(data, np.uint64) for data in rows["keys"]]
    values, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([np.frombuffer(data, np.int64) for data in rows["counts"]])
    totals = np.bincount(place, weights=counts, minlength=len(values)).astype(np.int64)
    found, at = [], 0
    for own in keys:
        found.append(totals[place[at:at + len(own)]].tobytes())
        at += len(own)
    return rows.assign(keys=None, counts=found)


ORDERED = "doc_id long, n long, prefix array<struct<token:long,pos:int>>, prefix_key long, shared binary"


def order_sets(block: pd.DataFrame, counts: pd.DataFrame, hundredths: int) -> pd.DataFrame:
    """Per document: prefix of its set from rare to frequent, and its shared shingles."""
    if not len(block):
        return pd.DataFrame(columns=["doc_id", "n", "prefix", "prefix_key", "shared"])
    head = block.iloc[0]
    hashes, sizes = np.frombuffer(head["hashes"], np.uint64), np.frombuffer(head["sizes"], np.int64)
    keys = np.unique(hashes)
    totals = np.concatenate([np.frombuffer(data, np.int64) for data in counts.sort_values("bucket")["counts"]])
    often = totals[np.searchsorted(keys, hashes)]
    rows, end = [], 0
    for doc_id, n in zip(np.frombuffer(head["ids"], np.int64), sizes):
        start, end = end, end + n
        own, seen = hashes[start:end], often[start:end]
        if not n:
            continue
        length = int(n) - least_overlap(int(n), hundredths) + 1
        first = np.lexsort((own, seen))[:length]
        listed = np.flatnonzero(seen[first] > 1)
        tokens = own[first].view(np.int64)
        key = hashlib.blake2b(tokens.tobytes() + int(n).to_bytes(8, "little"), digest_size=8).digest()
        rows.append((
            int(doc_id), int(n), [{"token": int(tokens[i]), "pos": int(i)} for i in listed],
            int.from_bytes(key, "little", signed=True), own[seen > 1].tobytes(),
        ))
    return pd.DataFrame(rows, columns=["doc_id", "n", "prefix", "prefix_key", "shared"])


def ordered_sets(rows: DataFrame, wanted: DataFrame, k: int, hundredths: int, buckets: int) -> DataFrame:
    """Prefixes and shared shingles of the rows (doc_id, text) whose id is among ``wanted`` (doc_id, n).

    Where the ids are too many to broadcast, Spark's own Bloom filter (of
    bounded size) keeps most other texts out of the shuffle; it filters only
    sides that a predicate makes selective, hence ``n > 0``.
    """
    chosen = rows.join(wanted.where("n > 0").select("doc_id"), "doc_id", "left_semi")
    with settings(rows.sparkSession, BLOOM):
        blocks = cut_lineage(chosen.mapInPandas(lambda batches: pack_blocks(batches, k), BLOCKS), "blocks")
    counts = blocks.mapInPandas(lambda batches: send_counts(batches, buckets), COUNTS).groupBy("bucket").applyInPandas(
        sum_counts, COUNTS
    )
    return cut_lineage(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(
        lambda own, found: order_sets(own, found, hundredths), ORDERED
    ), "ordered")


# Lists, leaders, pairs.

def overlaps(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        common = [
            len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            for a, b in zip(batch["a_shared"], batch["b_shared"])
        ]
        yield batch[["a", "b", "a_n", "b_n"]].assign(overlap=common)


def verified(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The pairs (a, b) with a_n, b_n and the overlap of their sets."""
    def side(name: str) -> DataFrame:
        return ordered.select(
            F.col("doc_id").alias(name), F.col("n").alias(f"{name}_n"), F.col("shared").alias(f"{name}_shared"))

    sets = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return sets.mapInPandas(overlaps, "a long, b long, a_n long, b_n long, overlap long")


def linked(counted: DataFrame, hundredths: int) -> DataFrame:
    """The verified pairs that link."""
    union = F.col("a_n") + F.col("b_n") - F.col("overlap")
    return counted.where(F.lit(100) * F.col("overlap") >= F.lit(hundredths) * union).select("a", "b")


def listed(ordered: DataFrame, hundredths: int) -> DataFrame:
    """Postings (doc_id, n, token, left) that some other member of their list could match.

    ``left`` is how many shingles of the set are not before the token: with the
    token as the first common one, the overlap is at most that.
    """
    postings = ordered.select("doc_id", "n", F.explode("prefix").alias("p")).select(
        "doc_id", "n", "p.token", (F.col("n") - F.col("p.pos")).alias("left")
    )
    sizes = postings.groupBy("token").agg(F.count("*").alias("members"), F.min("n").alias("least_n"))
    partner = F.greatest("least_n", F.ceil(F.col("n") * F.lit(hundredths) / F.lit(100)))
    return postings.join(sizes.where("members > 1"), "token").where(
        F.col("left") >= pair_overlap(F.col("n"), partner, hundredths)
    ).select("doc_id", "n", "token", "left")


def leader_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): each of ``reps`` (doc_id, n, token, band) with the leader that most of its lists name.

    The leader of a list and size band is the member that stands in the longest
    lists: the text that others of a group are copies of has its common shingles
    in front, its copies have their own.  Sizes of a band lie within the factor
    that links allow.
    """
    lists = reps.groupBy("token", "band").agg(F.count("*").alias("members")).where("members > 1")
    placed = reps.join(lists, ["token", "band"])
    central = placed.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    weighed = placed.join(central, "doc_id").withColumn("order", F.struct("weight", -F.col("doc_id")))
    leaders = weighed.groupBy("token", "band").agg(
        F.max("order").alias("first")).select("token", "band", "first.weight", (-F.col("first.col2")).alias("leader"))
    votes = placed.join(leaders, ["token", "band"]).where("doc_id <> leader").groupBy("doc_id", "leader").agg(
        F.count("*").alias("votes"), F.max("weight").alias("weight"))
    return votes.groupBy("doc_id").agg(
        F.max_by("leader", F.struct("votes", "weight", -F.col("leader"))).alias("leader")).toDF("a", "b")


def leader_rounds(groups: DataFrame, postings: DataFrame, ordered: DataFrame, hundredths: int) -> DataFrame:
    """Verified pairs (a, b, a_n, b_n, overlap) of sets with their leaders, until a round links nothing new.

    First members are verified with the first one of their group, and groups
    with leaders.  Sets that no leader has linked yet choose among themselves in
    the next round.
    """
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / hundredths)))).alias("band")
    firsts = groups.where("doc_id = group_id").select("doc_id")
    waiting = cut_lineage(postings.join(firsts, "doc_id", "left_semi").select("doc_id", "n", "token", band), "waiting")
    inside = groups.where("doc_id <> group_id").select(F.col("doc_id").alias("a"), F.col("group_id").alias("b"))
    tried = cut_lineage(verified(leader_pairs(waiting).union(inside), ordered), "tried")
    every = tried
    while True:
        near = linked(tried, hundredths)
        if near.isEmpty():
            return every
        done = cut_lineage(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "led")
        waiting = cut_lineage(waiting.join(done, "doc_id", "left_anti"), "waiting")
        tried = cut_lineage(verified(leader_pairs(waiting), ordered), "tried")
        every = every.union(tried)


def open_pairs(postings: DataFrame, component: DataFrame, led: DataFrame, hundredths: int) -> DataFrame:
    """All pairs (a, b) of a list in different components that size, position and leader allow.

    ``led`` (doc_id, leader, inside, outside): of the shared shingles of a set,
    how many its leader has and how many it has not.  Two sets of one leader
    overlap in at most min(inside) + min(outside).  Parts of components meet
    first, by their best bounds; only the members of those that pass are paired.
    """
    placed = postings.join(led, "doc_id").join(component, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n", "token", "left", "leader", "inside", "outside",
        F.coalesce("component", "doc_id").alias("component"),
    )
    mixed = placed.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high").select("token")
    placed = cut_lineage(placed.join(mixed, "token", "left_semi").withColumns({"n_low": F.col("n"), "n_high": F.col("n")}),
                         "postings")
    part = ["token", "component", "leader"]
    parts = cut_lineage(placed.groupBy(*part).agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"),
        *[F.max(c).alias(c) for c in ("left", "inside", "outside")],
    ), "parts")

    def allowed(a: str, b: str) -> Column:
        need = pair_overlap(F.col(f"{a}.n_low"), F.col(f"{b}.n_low"), hundredths)
        common = F.least(f"{a}.inside", f"{b}.inside") + F.least(f"{a}.outside", f"{b}.outside")
        return (
            (F.col(f"{a}.n_high") * 100 >= F.col(f"{b}.n_low") * hundredths)
            & (F.col(f"{b}.n_high") * 100 >= F.col(f"{a}.n_low") * hundredths)
            & (F.least(f"{a}.left", f"{b}.left") >= need)
            & ((F.col(f"{a}.leader") != F.col(f"{b}.leader")) | (common >= need))
        )

    def member(side: str, of: str) -> Column:
        same = [F.col(f"{side}.{c}") == F.col(f"{of}.{c}") for c in part]
        return same[0] & same[1] & same[2]

    met = parts.alias("pa").join(
        parts.alias("pb"),
        (F.col("pa.token") == F.col("pb.token")) & (F.col("pa.component") < F.col("pb.component")) & allowed("pa", "pb"),
    )
    return (
        met.join(placed.alias("a"), member("a", "pa") & allowed("a", "pb"))
        .join(placed.alias("b"), member("b", "pb") & allowed("a", "b"))
        .select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    )


def join_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, hundredths: int = LEAST
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    * Sets are of distinct shingles of ``k`` words; a shorter text is one
      shingle.  Two documents link when 100 * common >= ``hundredths`` * union,
      computed on 64-bit hashes of the shingles.
    * ``component_id`` is the smallest id reachable by links.  Null and empty
      texts have 0 shingles and their own id.  A null id is in no component
      (null).  Rows with one id are one document: their links are its links.
    * Long texts are read whole; equal texts need no pairs; an empty table
      gives no rows; other columns are not read.  Ids are integers.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    profile = cut_lineage(profiles(rows, k, hundredths, buckets), "profiles")
    classes = cut_lineage(
        profile.where("n > 0").groupBy("digest").agg(
            F.min("doc_id").alias("first"), F.max("open").alias("open"), F.first("n").alias("n")),
        "classes",
    )
    searched = cut_lineage(
        classes.where("open = true and first is not null").select(F.col("first").alias("doc_id"), "n"), "searched")
    ordered = ordered_sets(rows, searched, k, hundredths, buckets)
    groups = ordered.groupBy("n", "prefix_key").agg(F.min("doc_id").alias("group_id"))
    groups = cut_lineage(
        ordered.select("doc_id", "n", "prefix_key").join(groups, ["n", "prefix_key"]).select("doc_id", "group_id"), "groups"
    )
    postings = cut_lineage(listed(ordered, hundredths), "lists")
    tried = leader_rounds(groups, postings, ordered, hundredths)
    near = linked(tried, hundredths)
    all_shared = (F.length("shared") / 8).cast("long")
    led = ordered.select("doc_id", all_shared.alias("all")).join(
        tried.groupBy(F.col("a").alias("doc_id")).agg(F.max(F.struct("overlap", "b")).alias("best")), "doc_id", "left"
    ).select(
        "doc_id", F.coalesce("best.b", "doc_id").alias("leader"), F.coalesce("best.overlap", "all").alias("inside"),
        (F.col("all") - F.coalesce("best.overlap", "all")).alias("outside"),
    )
    apart = cut_lineage(open_pairs(postings, components(near), led, hundredths), "pairs")
    # Rows that share an id but not a text connect their classes.
    members = profile.where("n > 0 and doc_id is not null").join(
        classes.select("digest", "first"), "digest"
    ).select("doc_id", "n", "first")
    same_id = members.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b")
    same_id = members.join(same_id.select("doc_id", "a"), "doc_id").select("a", F.col("first").alias("b"))
    found = components(near.union(linked(verified(apart, ordered), hundredths)).union(same_id))
    placed = profile.join(classes.select("digest", "first"), "digest", "left").select("doc_id", "n", "first")
    own = F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id"))
    return placed.join(found, placed["first"] == found["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")
    )


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies: of each group of linked texts the row with the smallest id.

    * Every row is a document of its own, whether its id is repeated or null, so
      only rows with linked texts are folded.  Null ids come last, then the
      row's number decides.  Texts without words link with nothing and stay.
    * An empty table gives no rows.  Other columns may have any name.
    """
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "rows")
    texts = numbered.select("number", F.col("row.text").alias("text"))
    component = join_classes(texts, id_col="number", **options).select(F.col("doc_id").alias("number"), "component_id")
    placed = cut_lineage(
        component.join(numbered.select("number", F.col("row.doc_id").alias("doc_id")), "number"), "placed")
    first = placed.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")).alias("first"), F.count("*").alias("many")
    ).where("many > 1").select("component_id", F.col("first.number").alias("stays"))
    copies = cut_lineage(placed.join(first, "component_id").where("number <> stays").select("number"), "copies")
    return numbered.join(copies, "number", "left_anti").select("row.*")
