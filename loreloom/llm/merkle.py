"""Merkle manifest of a dataset: one tree per group, leaf coordinates from bitmap ranks.

1. Every row is a leaf: the digest of its fields.
2. The ids of a group are a compressed bitmap: words of 64 bits, only words that
   hold an id are kept.  Partial bitmaps are merged by a bitwise-or aggregate.
3. A directory of popcounts stands over the bitmap: rows before each run of 256
   words, rows before each word of a run.  The coordinate of a leaf is a rank
   query: rows before its word, plus the bits below its own.  Leaves are joined
   with their word and never sorted.
4. ``LEVELS`` levels of the tree are reduced at a time: the nodes of a block meet
   in an array with a slot per coordinate, the root of the block is a node of the
   next round.
5. Proofs come down the same way: a block's path to the root is joined to the
   block and continued to each of its slots.

Ids that several rows of a group have leave the count of rows of a word above its
popcount.  Only the rows of such words are put in order, by (id, leaf).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import running_sums, text_rows
from loreloom.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree that one block reduces; a block has at most 2 ** LEVELS slots.
LEVELS = 10
#: Bits of an id inside a word, and of a word inside a run of the directory.
WORD_BITS, RUN_BITS = 6, 8
#: The word of rows without an id: below that of every id.
NO_ID = -(1 << 60)
#: Equal rows that one row of a table is expanded to at a time.
COPIES = 10_000
#: Blocks in one result batch of a Python worker.
BLOCKS_OUT = 16


# Leaves.

def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def leaves(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
    claimed: Mapping[str, Column] | None = None, claimed_where: Column | None = None,
) -> DataFrame:
    """(id, grp, leaf, claim) for every row of ``docs``; ``claim`` is null unless it differs from ``leaf``.

    ``claim`` is the leaf of the row as somebody claims it to be: with the
    columns ``claimed`` in place of the row's own where ``claimed_where`` holds.
    ``grp`` orders like the group, null first.
    """
    own = [F.col(c) for c in fields]
    claim = F.lit(None).cast("string")
    if claimed:
        claim = F.when(claimed_where, row_digest([claimed.get(c, F.col(c)) for c in fields]))
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("grp"),
        row_digest(own).alias("leaf"), claim.alias("claim"),
    )
    return rows.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim")))


# Coordinates by rank.

def in_words(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "word": F.coalesce(F.shiftright("id", WORD_BITS), F.lit(NO_ID)),
        "bit": F.coalesce(F.col("id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int"),
    })


def directory(rows: DataFrame) -> DataFrame:
    """(grp, word, bits, held, before, n): the bitmap of each group and the rows before each word.

    ``held`` counts the rows of the word, ``n`` the rows of the group.
    """
    words = cut_lineage(in_words(rows).groupBy("grp", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("held")
    ).withColumn("run", F.shiftright("word", RUN_BITS)), "bitmap")
    runs = words.groupBy("grp", "run").agg(F.sum("held").alias("total"))
    runs = cut_lineage(running_sums(runs, ["grp", "run"], {"start": F.col("total")}), "runs")
    groups = runs.groupBy("grp").agg(F.min("start").alias("first"), F.sum("total").alias("n"))
    runs = runs.join(groups, "grp").select("grp", "run", "n", (F.col("start") - F.col("first")).alias("start"))
    # At most 2 ** RUN_BITS words.
    inside = Window.partitionBy("grp", "run").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("inside", F.coalesce(F.sum("held").over(inside), F.lit(0))).join(runs, ["grp", "run"])
    return cut_lineage(placed.select(
        "grp", "word", "bits", "held", (F.col("start") + F.col("inside")).alias("before"), "n"
    ), "directory")


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (id, grp, leaf, claim) with ``position`` in the group, and the group's size ``n``.

    Positions ascend by id, null first; rows that share an id ascend by leaf.
    """
    words = directory(rows)
    popcount = F.bit_count("bits")
    columns = ["id", "grp", "leaf", "claim", "position", "n"]
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    found = in_words(rows).join(words.where(F.col("held") == popcount), ["grp", "word"]).withColumn(
        "position", F.col("before") + below
    ).select(columns)
    shared = words.where(F.col("held") != popcount)
    if shared.isEmpty():
        return found
    order = ["grp", "word", "bit", "leaf", "claim"]
    equal = in_words(rows).join(shared, ["grp", "word"]).groupBy("id", *order, "before", "n").agg(F.count("*").alias("copies"))
    placed = cut_lineage(running_sums(equal, order, {"start": F.col("copies")}), "shared")
    first = placed.groupBy("grp", "word").agg(F.min("start").alias("first"))
    placed = placed.join(first, ["grp", "word"]).withColumn("position", F.col("before") + F.col("start") - F.col("first"))
    # Equal rows come back one by one, in portions, so one hot row is many tasks' work.
    portions = placed.withColumn("portion", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)"))).repartition("position", "portion")
    again = portions.withColumn(
        "copy", F.explode(F.expr(f"sequence(portion, least(portion + {COPIES}, copies) - 1)"))
    ).withColumn("position", F.col("position") + F.col("copy"))
    return found.unionByName(again.select(columns))


# Blocks of slots.

def sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def block_levels(slots: list[str], whole: bool) -> list[list[str]]:
    """The nodes of a block level by level; ``whole`` blocks are a tree, others reduce LEVELS levels."""
    levels = [slots]
    while len(levels[-1]) > 1 or not whole and len(levels) <= LEVELS:
        now = levels[-1]
        levels.append([sha("".join(now[at:at + 2])) for at in range(0, len(now), 2)])
    return levels


def steps_of(levels: list[list[str]], slot: int) -> list[str]:
    """From a slot to the root of its block: ``L`` or ``R`` and the sibling on that side, ``-`` without one."""
    steps = []
    for nodes in levels[:-1]:
        sibling = slot ^ 1
        steps.append("-" if sibling >= len(nodes) else ("L" if slot & 1 else "R") + nodes[sibling])
        slot >>= 1
    return steps


def climb(digest: str, steps: list[str]) -> str:
    for step in steps:
        digest = sha(digest if step == "-" else step[1:] + digest if step[0] == "L" else digest + step[1:])
    return digest


def with_columns(batch: pa.RecordBatch, at: int, new: Mapping[str, list]) -> pa.RecordBatch:
    size = len(next(iter(new.values())))
    names = [*batch.schema.names, *new]
    arrays = [c.slice(at, size) for c in batch.columns]
    arrays += [pa.array(v, pa.list_(pa.string()) if v and isinstance(v[0], list) else pa.string()) for v in new.values()]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def add_roots(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        slots, whole = batch.column("slots"), batch.column("whole").to_pylist()
        for at in range(0, len(batch), BLOCKS_OUT):
            roots = [
                block_levels(slots[i].as_py(), whole[i])[-1][0] for i in range(at, min(at + BLOCKS_OUT, len(batch)))
            ]
            yield with_columns(batch, at, {"digest": roots})


def add_paths(batches: Iterator[pa.RecordBatch]):
    """``paths``: for each slot its steps to the root of everything, comma-joined."""
    for batch in batches:
        slots, whole, above = batch.column("slots"), batch.column("whole").to_pylist(), batch.column("path").to_pylist()
        for at in range(0, len(batch), BLOCKS_OUT):
            paths = []
            for i in range(at, min(at + BLOCKS_OUT, len(batch))):
                levels = block_levels(slots[i].as_py(), whole[i])
                tail = [above[i]] if above[i] else []
                paths.append([",".join(steps_of(levels, s) + tail) for s in range(len(levels[0]))])
            yield with_columns(batch, at, {"paths": paths})


def add_proofs(batches: Iterator[pa.RecordBatch]):
    """``proofs``: digest of the siblings of each slot; ``folded``: the root that its claim (else itself) leads to."""
    for batch in batches:
        slots, claims = batch.column("slots"), batch.column("claims")
        whole, above = batch.column("whole").to_pylist(), batch.column("path").to_pylist()
        for at in range(0, len(batch), BLOCKS_OUT):
            proofs, folded = [], []
            for i in range(at, min(at + BLOCKS_OUT, len(batch))):
                levels = block_levels(slots[i].as_py(), whole[i])
                upper = above[i].split(",") if above[i] else []
                upper_siblings = "".join(step[1:] for step in upper)
                reached: dict[str, str] = {}
                own_proofs, own_folded = [], []
                for slot, claim in enumerate(claims[i].as_py()):
                    steps = steps_of(levels, slot)
                    own_proofs.append(sha("".join([step[1:] for step in steps]) + upper_siblings))
                    # Slots of a block that agree on its root share the way up from there.
                    top = climb(claim or levels[0][slot], steps)
                    if top not in reached:
                        reached[top] = climb(top, upper)
                    own_folded.append(reached[top])
                proofs.append(own_proofs)
                folded.append(own_folded)
            yield with_columns(batch, at, {"proofs": proofs, "folded": folded})


def in_blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """``nodes`` (grp, position, n, digest, carried columns) as one row per block with an array per column."""
    block = F.shiftright("position", LEVELS)
    members = F.array_sort(F.collect_list(F.struct("position", "digest", *carried)))
    rows = nodes.groupBy("grp", block.alias("block"), "n").agg(members.alias("m"))
    return rows.select(
        "grp", F.col("block").alias("position"), "n", (F.col("n") <= 1 << LEVELS).alias("whole"),
        F.col("m.digest").alias("slots"), *[F.col(f"m.{c}").alias(c + "s") for c in carried],
    )


def with_root(blocks: DataFrame) -> DataFrame:
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in blocks.dtypes)
    return blocks.mapInArrow(add_roots, f"{kinds}, digest string")


def reduced(nodes: DataFrame, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of every round, lowest first, and the root (grp, digest) of each group."""
    rounds = []
    while True:
        blocks = cut_lineage(with_root(in_blocks(text_rows(nodes), carried)), "blocks")
        rounds.append(blocks)
        nodes = blocks.select("grp", "position", F.expr(f"(n + {(1 << LEVELS) - 1}) >> {LEVELS}").alias("n"), "digest")
        carried = ()
        most = nodes.agg(F.max("n")).first()[0]
        if most is None or most <= 1:
            return rounds, nodes.select("grp", "digest")


def paths_down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """(grp, position, path, subroot) of the nodes of the lowest of ``rounds``, from ``top`` of the same form."""
    path = top
    for blocks in reversed(rounds):
        own = blocks.select("grp", "position", "whole", "slots").join(path, ["grp", "position"])
        kinds = ", ".join(f"`{name}` {kind}" for name, kind in own.dtypes)
        found = own.mapInArrow(add_paths, f"{kinds}, paths array<string>")
        path = found.select(
            "grp", "subroot", F.col("position").alias("block"), F.posexplode("paths").alias("slot", "path")
        ).select("grp", (F.col("block") * (1 << LEVELS) + F.col("slot")).alias("position"), "path", "subroot")
    return path


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
    claimed: Mapping[str, Column] | None = None, claimed_where: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, grp, leaf, subroot, root, proof, folded_root.

    * ``leaf`` digests the fields of a row: of each, ``-`` if null, else its
      UTF-8 byte count, ``:`` and its text.  In a group, leaves ascend by id;
      every two neighbours become the digest of their digests, a last one alone
      too, until one is left, the ``subroot``.  Subroots in the order of the
      groups (null first, by bytes) give the ``root`` in the same way.
    * ``proof`` digests the siblings of a leaf from its own level up to the root.
      ``folded_root`` is what the leaf and its siblings lead to, with the claimed
      leaf where ``claimed`` columns hold (see ``leaves``): it differs from
      ``root`` exactly for rows that are not what they are claimed to be.
    * Rows without an id come first in their group.  Rows that share an id ascend
      by leaf; equal rows take places side by side.  Long and empty texts are
      digested whole, and extra columns are not read.  An empty table gives no
      rows.
    """
    rows = cut_lineage(leaves(docs, id_col, group_col, fields, claimed, claimed_where), "leaves")
    placed = coordinates(rows).withColumnRenamed("leaf", "digest")
    rounds, subroots = reduced(placed, ["id", "claim"])
    subroots = cut_lineage(running_sums(subroots, ["grp"], {"position": F.lit(1)}), "subroots")
    over = subroots.agg(F.count("*").alias("n"))
    groups = over.first()["n"]
    trees = subroots.select(F.lit("").alias("grp"), "position", F.lit(groups).cast("long").alias("n"), "digest")
    upper, top = reduced(trees)
    found = top.first()
    root = found["digest"] if found else None
    start = top.select("grp", F.lit(0).cast("long").alias("position"), F.lit("").alias("path"), F.col("digest").alias("subroot"))
    ways = paths_down(upper, start).select("position", "path")
    tops = subroots.join(ways, "position").select(
        "grp", F.lit(0).cast("long").alias("position"), "path", F.col("digest").alias("subroot")
    )
    above = paths_down(rounds[1:], tops)
    blocks = rounds[0].select("grp", "position", "whole", "slots", "ids", "claims").join(above, ["grp", "position"])
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in blocks.dtypes)
    proven = blocks.mapInArrow(add_proofs, f"{kinds}, proofs array<string>, folded array<string>")
    return proven.select(
        "grp", "subroot", F.inline(F.arrays_zip("ids", "slots", "proofs", "folded"))
    ).select(
        F.col("ids").alias("id"), F.when(F.col("grp") != "", F.substring("grp", 2, 2147483647)).alias("grp"),
        F.col("slots").alias("leaf"), "subroot", F.lit(root).alias("root"), F.col("proofs").alias("proof"),
        F.col("folded").alias("folded_root"),
    )
