"""Language mixture of every document by expectation-maximisation.

Fitting counts character trigrams (hashed to ``slots``) per language in a
bounded sample of labelled documents.  Prediction gives every word of a text
its likelihood under each language from the trigrams around its characters, and
sees the text as words drawn from an unknown mixture of languages.  Languages
join the mixture one by one while the likelihood that expectation-maximisation
reaches, less a penalty for each further language, grows.

Texts are read whole, in pieces of at most ``PIECE`` characters; a task holds
one group of documents of about ``GROUP`` characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_rows

SLOTS = 1 << 14
#: Most labelled documents that the model is fitted on, taken by a hash of the id.
SAMPLE_ROWS = 50_000
PIECE = 1 << 20
GROUP = 1 << 20
ROUNDS = 12
#: Cost of each language after the first, in nats per logarithm of the number of words.
PENALTY = 4.0
SMOOTHING = 0.5
UNKNOWN = "und"


#: Unicode has no letters at or above this code point.
LETTER_LIMIT = 0x33480
_tables: dict[str, np.ndarray] = {}


def letters_table() -> np.ndarray:
    """True for the code points that are letters; the last entry stands for all above."""
    if "letters" not in _tables:
        flags = np.fromiter(map(str.isalpha, map(chr, range(LETTER_LIMIT + 1))), dtype=bool, count=LETTER_LIMIT + 1)
        _tables["letters"] = flags
    return _tables["letters"]


def trigrams(text: str, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams around the letters of ``text``, and where each word starts among them.

    Letters are lower-cased; every run of other characters is one boundary.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters_table()[np.minimum(points, LETTER_LIMIT)]
    shown = np.zeros(len(points) + 2, dtype=np.uint64)
    shown[1:-1] = np.where(letter, points, 0)
    inside = np.flatnonzero(letter)
    mixed = (
        shown[inside] * np.uint64(0x9E3779B97F4A7C15)
        + shown[inside + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        + shown[inside + 2] * np.uint64(0x165667B19E3779F9)
    )
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    grams = (mixed >> np.uint64(40)).astype(np.int64) % slots
    starts = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    return grams, starts


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about PIECE characters, cut at blanks where there are any."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + PIECE // 2, at + PIECE)
        cut = at + PIECE if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def count_trigrams(batches, slots: int):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            mine = counts.setdefault(lang, np.zeros(slots, dtype=np.int64))
            for piece in pieces(text or ""):
                mine += np.bincount(trigrams(piece, slots)[0], minlength=slots)
    for lang, mine in counts.items():
        seen = np.flatnonzero(mine)
        yield pd.DataFrame({"lang": lang, "slot": seen.astype(np.int32), "n": mine[seen]})


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    slots: int = SLOTS, sample_rows: int = SAMPLE_ROWS,
) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (slots x languages) from about ``sample_rows`` rows of ``labelled``."""
    rows = text_rows(labelled).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < sample_rows * (1 << 40) // n)
    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(
        lambda batches: count_trigrams(batches, slots), "lang string, slot int, n long"
    ).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most slots rows a language
    langs = sorted(counted["lang"].unique())
    counts = np.zeros((slots, len(langs)))
    counts[counted["slot"], np.searchsorted(langs, counted["lang"])] = counted["n"]
    counts += SMOOTHING
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def word_scores(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of every word under each language, and the number of words of each text."""
    scores, n_words = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for piece in pieces(text):
            grams, starts = trigrams(piece, len(logs))
            if len(starts):
                scores.append(np.add.reduceat(logs[grams], starts, axis=0))
                n_words[i] += len(starts)
    return (np.concatenate(scores) if scores else np.zeros((0, logs.shape[1]), np.float32)), n_words


def mixtures(scores: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Share of each language in each text (rows of zeros for texts without words)."""
    shares = np.zeros((len(n_words), scores.shape[1]))
    full = np.flatnonzero(n_words)
    if not len(full):
        return shares
    sizes = n_words[full]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    scores = scores.astype(np.float64)
    top = scores.max(axis=1)
    alone = np.add.reduceat(scores, starts, axis=0)
    likely = np.exp(scores - top[:, None])
    ceiling = np.add.reduceat(top, starts)
    first = alone.argmax(axis=1)
    rows = np.arange(len(full))
    best = alone[rows, first]
    chosen = np.zeros(alone.shape)
    chosen[rows, first] = 1.0
    # Languages by the share of words they explain, after the first.
    claim = np.add.reduceat(likely / likely.sum(axis=1, keepdims=True), starts, axis=0)
    claim[rows, first] = np.inf
    ranking = np.argsort(-claim, axis=1, kind="stable")
    price = PENALTY * np.log1p(sizes)
    open_ = np.ones(len(full), dtype=bool)
    for k in range(2, alone.shape[1] + 1):
        # No mixture is more likely than each word under its best language.
        open_ &= ceiling - (k - 1) * price > best
        live = np.flatnonzero(open_)
        if not len(live):
            break
        member = np.zeros((len(live), alone.shape[1]), dtype=bool)
        np.put_along_axis(member, ranking[live, :k], True, axis=1)
        theta = member / k
        doc = np.repeat(np.arange(len(live)), sizes[live])
        words = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in live])
        own, at = likely[words], np.concatenate(([0], np.cumsum(sizes[live])[:-1]))
        for _ in range(ROUNDS):
            joint = own * theta[doc]
            joint /= joint.sum(axis=1, keepdims=True) + 1e-300
            theta = np.add.reduceat(joint, at, axis=0) / sizes[live][:, None]
        reached = np.add.reduceat(np.log((own * theta[doc]).sum(axis=1) + 1e-300), at) + ceiling[live]
        reached -= (k - 1) * price[live]
        better = reached > best[live]
        chosen[live[better]], best[live[better]] = theta[better], reached[better]
        open_[live[~better]] = False
    shares[full] = chosen
    return shares


def predict_batches(batches, langs: list[str], logs: np.ndarray):
    def results(ids, held, texts):
        scores, n_words = word_scores(texts, logs)
        shares = mixtures(scores, n_words)
        main = shares.argmax(axis=1)
        return pd.DataFrame({
            "doc_id": ids, "held_out": held,
            "lang_pred": [langs[m] if n else UNKNOWN for m, n in zip(main, n_words)],
            "score": np.minimum(shares.max(axis=1), 1.0),
            "languages": [[langs[j] for j in np.argsort(-s, kind="stable") if s[j] > 0] for s in shares],
        })

    for batch in batches:
        ids, held, texts, size = [], [], [], 0
        for doc_id, flag, text in zip(batch["doc_id"], batch["held_out"], batch["text"]):
            ids.append(doc_id), held.append(flag), texts.append(text or "")
            size += len(texts[-1])
            if size >= GROUP:
                yield results(ids, held, texts)
                ids, held, texts, size = [], [], [], 0
        if ids:
            yield results(ids, held, texts)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, languages.

    * ``languages`` is the selected set, largest share first; ``lang_pred`` is
      its first and ``score`` that language's share of the words.  Equal shares
      go to the smaller code.
    * Null texts and texts without letters get ``und``, score 0 and no
      languages, and so does every text when nothing could be learned.
    * Long texts are read whole; repeated rows give a row each; an empty table
      gives no rows; columns other than id and text are not read.
    """
    langs, logs = model
    rows = text_rows(docs).select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    if not langs:
        return rows.select(
            "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.array().cast("array<string>").alias("languages"),
        )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(
        lambda batches: predict_batches(batches, langs, logs),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>",
    )


def identify(docs: DataFrame, **options) -> DataFrame:
    """``fit`` on the folds that are not held out, then ``predict`` all rows of ``docs``."""
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs, fit(learned, **options))


def kept_documents(docs: DataFrame, least_share: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose main language has at least ``least_share`` of the words.

    Texts without letters go, null ones too.  The decision is made where a row
    lies: nothing is shuffled, and repeated rows are decided alike.  When
    nothing could be learned, no row can be told from another and all stay.
    """
    langs, logs = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()), **options)
    if not langs:
        return docs

    @F.pandas_udf("double")
    def main_share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            ids = pd.Series(range(len(texts)))
            rows = pd.DataFrame({"doc_id": ids, "held_out": False, "text": texts.reset_index(drop=True)})
            yield pd.concat([r["score"] for r in predict_batches([rows], langs, logs)] or [pd.Series(dtype=float)])

    return text_rows(docs).where(main_share(F.col("text")) >= least_share)
