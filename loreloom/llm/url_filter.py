"""URL verdicts: domain rules first, then a character language-model ratio.

Two Markov models of variable order read the characters of accepted and of
rejected URLs (those a rule decides).  A character's probability interpolates
all orders by Witten-Bell: a context counts as much as it has been seen against
the number of different characters seen after it, so unseen contexts fall back
to shorter ones.  A URL's score is the mean difference of its log-probabilities
per character; the threshold is calibrated on labelled URLs that the models
have not seen.

Grams and contexts are counted as they are, in tables that grow with the input.
The distinct grams of the URLs to be scored are joined with these tables, and
the characters with the ratio of their gram; Spark chooses the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import ascii_lower
from loreloom.session import cut_lineage

#: The rules of the registered query: (verdict, host and path prefix).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
PAD, END = "\u0002", "\u0003"
CHUNK = 256
ALPHABET = 256  # of the uniform distribution below order 1
BINS = 2000  # calibration histogram


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    # (?s) is not needed: negated classes match line ends.
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(length, rule, verdict); null without one.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Equal lengths go to the greater rule string.
    """
    fits = []
    for verdict, rule in rules:
        rule_host, slash, rest = rule.partition("/")
        here = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        fits.append(F.when(here, F.struct(
            F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")
        )))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def positions(urls: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    """One row per character (and the end) of ``url``: ``_gram``, the last ``order`` characters up to it.

    Long URLs are first cut into overlapping chunks, so that finding a
    character costs the length of a chunk, not of the URL.
    """
    padded = F.concat(F.lit(PAD * (order - 1)), F.coalesce(F.col("url"), F.lit("")), F.lit(END))
    chunk = F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("_padded") - order) / CHUNK).cast("int")),
        lambda k: F.substring(F.col("_padded"), k * CHUNK + 1, F.lit(CHUNK + order - 1)),
    ))
    at = F.explode(F.sequence(F.lit(1), F.length("_chunk") - (order - 1)))
    return (
        urls.withColumn("_padded", padded)
        .select(*keys, chunk.alias("_chunk"))
        .select(*keys, "_chunk", at.alias("_at"))
        .select(*keys, F.substring(F.col("_chunk"), F.col("_at"), F.lit(order)).alias("_gram"))
    )


def gram_key(gram: Column, slots: int | None) -> Column:
    """What a gram is counted under: itself, or one of ``slots`` hash slots that grams share."""
    return gram if slots is None else F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def fit(labelled: DataFrame, order: int = 5, slots: int | None = None) -> tuple[list[DataFrame], list[DataFrame], tuple]:
    """Gram and context tables per order from ``labelled`` (url, accepted boolean).

    Gram tables: _g<k>, and counts _ga<k>, _gr<k> for accepted and rejected.
    Context tables for order k: _c<k>, counts and numbers of different
    continuations _ca<k>, _ta<k>, _cr<k>, _tr<k>.  At order 1 the context is
    empty; its four numbers are returned last.
    """
    seen = positions(labelled, ["accepted"], order)
    orders = F.array(*[
        F.struct(
            F.lit(k).alias("k"), gram_key(F.right("_gram", F.lit(k)), slots).alias("g"),
            gram_key(F.left(F.right("_gram", F.lit(k)), F.lit(k - 1)), slots).alias("c"),
        )
        for k in range(1, order + 1)
    ])
    counts = cut_lineage(
        seen.select("accepted", F.explode(orders).alias("o")).groupBy("o.k", "o.c", "o.g").agg(
            F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
        )
    )
    by_gram = cut_lineage(counts.groupBy("k", "g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    by_context = cut_lineage(counts.groupBy("k", "c").agg(
        F.sum("a").alias("a"), F.count_if(F.col("a") > 0).alias("ta"),
        F.sum("r").alias("r"), F.count_if(F.col("r") > 0).alias("tr"),
    ))
    grams = [
        by_gram.where(F.col("k") == k).select(
            F.col("g").alias(f"_g{k}"), F.col("a").alias(f"_ga{k}"), F.col("r").alias(f"_gr{k}"))
        for k in range(1, order + 1)
    ]
    contexts = [
        by_context.where(F.col("k") == k).select(
            F.col("c").alias(f"_c{k}"), F.col("a").alias(f"_ca{k}"), F.col("ta").alias(f"_ta{k}"),
            F.col("r").alias(f"_cr{k}"), F.col("tr").alias(f"_tr{k}"))
        for k in range(2, order + 1)
    ]
    root = by_context.where("k = 1").agg(*[F.sum(c) for c in ("a", "ta", "r", "tr")]).first()
    return grams, contexts, tuple(v or 0 for v in root)


def log_ratios(urls: DataFrame, key: str, model: tuple, order: int, slots: int | None = None) -> DataFrame:
    """Per ``key`` of ``urls``: score, the mean log-probability difference per character (end included).

    Ratios are summed as decimals, so that equal URLs have equal scores in any order of their rows.
    """
    grams, contexts, root = model
    characters = positions(urls, [key], order)
    rows = characters.select("_gram").distinct()
    for k in range(1, order + 1):
        rows = rows.withColumn(f"_g{k}", gram_key(F.right("_gram", F.lit(k)), slots))
        rows = rows.join(grams[k - 1], f"_g{k}", "left")
        if k > 1:
            rows = rows.withColumn(f"_c{k}", gram_key(F.left(F.right("_gram", F.lit(k)), F.lit(k - 1)), slots))
            rows = rows.join(contexts[k - 2], f"_c{k}", "left")

    def probability(side: str, root_count: int, root_kinds: int) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(1, order + 1):
            count = F.coalesce(F.col(f"_g{side}{k}"), F.lit(0))
            of = F.lit(root_count) if k == 1 else F.coalesce(F.col(f"_c{side}{k}"), F.lit(0))
            kinds = F.lit(root_kinds) if k == 1 else F.coalesce(F.col(f"_t{side}{k}"), F.lit(0))
            # Only where slots are shared can a count exceed its context's.
            p = F.when(of + kinds > 0, (F.least(count, of) + kinds * p) / (of + kinds)).otherwise(p)
        return p

    ratio = F.log(probability("a", root[0], root[1])) - F.log(probability("r", root[2], root[3]))
    ratios = cut_lineage(rows.select("_gram", ratio.cast("decimal(24,14)").alias("_ratio")), "ratios")
    summed = characters.join(ratios, "_gram").groupBy(key).agg(F.sum("_ratio").alias("_sum"), F.count("*").alias("_n"))
    return summed.select(key, (F.col("_sum").cast("double") / F.col("_n")).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold with the least balanced error over (score, accepted); 0 if a class is missing."""
    low, width = -10.0, 20.0 / BINS
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") - low) / width)))
    bins = scored.groupBy(bin_of.cast("int").alias("bin")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )  # at most BINS rows
    all_a, all_r = bins.agg(F.sum("a"), F.sum("r")).first()
    if not all_a or not all_r:
        return 0.0
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.lit(all_a)
    kept = F.lit(1) - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.lit(all_r)
    best = bins.select("bin", (lost + kept).alias("error")).agg(
        F.min(F.struct("error", "bin")).alias("best")
    ).first()["best"]
    return low + width * best["bin"]


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = 5,
    slots: int | None = None,
    calibration: int = 5,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    * A rule's verdict stands; all other URLs are allowed if their score is at
      least the calibrated threshold.  ``score`` is null where a rule decides.
    * One labelled URL in ``calibration`` (by checksum) calibrates, the others
      train.  Without a class to learn from every other URL is allowed.
    * A null or malformed URL has empty host and path and no rule; the method
      reads it as it is (null as empty).  Long URLs are read whole.  Repeated
      rows give a row each, equal scores included.  Other columns are not read.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns(
        {"host": host, "path": path}
    ).withColumn("_match", rule_match(F.col("host"), F.col("path"), rules))
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    labelled = rows.where("_match is not null").select(
        "_row", "url", (F.col("_match.verdict") == "allow").alias("accepted"),
        (F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(calibration)) == 0).alias("held"),
    )
    model = fit(labelled.where("not held"), order, slots)
    scored = log_ratios(labelled.where("held"), "_row", model, order, slots).join(
        labelled.select("_row", "accepted"), "_row"
    )
    threshold = calibrate(scored)
    scores = log_ratios(rows.where("_match is null"), "_row", model, order, slots)
    passed = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.join(scores, "_row", "left").select(
        "page_id", "host", "path", F.col("_match.rule").alias("rule"),
        F.coalesce(F.col("_match.verdict"), passed).alias("verdict"), "score",
    )
