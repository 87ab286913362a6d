import random

import numpy as np
import pandas as pd

from loreloom.llm import language_id
from tests.llm.helpers import documents

SYLLABLES = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "len", "ung"], "cc": ["eau", "ille", "que"]}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(2)
    return [(i, sentence(rng, lang := rng.choice(list(SYLLABLES))), lang, "s") for i in range(n)]


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    extra = [
        (9001, None, None, None), (9002, "", "aa", None), (9003, "123 -- 45 !", "bb", None), (None, "karomi kami", "aa", None),
        (9004, "schlen " * 400_000, "bb", None), (9005, rows[0][1], None, None), (9005, rows[0][1], None, None),
    ]
    got = language_id.identify(documents(spark, rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    held = [by_id[i][0] for i, *_ in rows if by_id[i][0].held_out]
    truth = {i: lang for i, _, lang, _ in rows}
    assert 30 < len(held) < 90
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    for i in (9001, 9002, 9003):
        assert (by_id[i][0].lang_pred, by_id[i][0].score, by_id[i][0].languages) == ("und", 0.0, [])
    assert by_id[9004][0].lang_pred == "bb" and by_id[9004][0].score == 1.0
    assert by_id[None][0].lang_pred == "aa" and by_id[None][0].held_out is False
    assert len(by_id[9005]) == 2 and by_id[9005][0] == by_id[9005][1]


def test_fold_is_crc32_mod_4(spark):
    import zlib
    got = documents(spark, [(i, "x") for i in range(50)]).select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def model():
    rows = pd.DataFrame([(lang, text) for _, text, lang, _ in corpus()], columns=["lang", "text"])
    counted = pd.concat(language_id.count_trigrams([rows], 4096))
    langs = sorted(SYLLABLES)
    counts = np.full((4096, 3), 0.5)
    counts[counted["slot"], np.searchsorted(langs, counted["lang"])] += counted["n"]
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def brute_mixture(scores, members, rounds=2000):
    """Log-likelihood of the best mixture of ``members``, by plain loops."""
    theta = {m: 1 / len(members) for m in members}
    for _ in range(rounds):
        total = dict.fromkeys(members, 0.0)
        for row in scores:
            joint = {m: theta[m] * np.exp(row[m] - row.max()) for m in members}
            whole = sum(joint.values())
            for m in members:
                total[m] += joint[m] / whole
        theta = {m: total[m] / len(scores) for m in members}
    return theta


def test_mixture_of_two_languages():
    langs, logs = model()
    rng = random.Random(4)
    texts = [
        sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 30), sentence(rng, "cc", 50), "", "karo",
        sentence(rng, "aa", 10) + " " + sentence(rng, "bb", 20) + " " + sentence(rng, "cc", 40),
    ]
    scores, n_words = language_id.word_scores(texts, logs)
    shares = language_id.mixtures(scores, n_words)
    assert [list(np.flatnonzero(s)) for s in shares] == [[0, 1], [2], [], [0], [0, 1, 2]]
    first = brute_mixture(scores[: n_words[0]].astype(float), [0, 1], 50)
    assert abs(shares[0][0] - first[0]) < 0.02 and abs(shares[0].sum() - 1) < 1e-9


def test_mixtures_do_not_depend_on_neighbours():
    langs, logs = model()
    rng = random.Random(8)
    texts = [sentence(rng, rng.choice(langs), rng.randint(0, 40)) + sentence(rng, rng.choice(langs), 5) for _ in range(30)]
    together = language_id.mixtures(*language_id.word_scores(texts, logs))
    alone = np.concatenate([language_id.mixtures(*language_id.word_scores([t], logs)) for t in texts])
    assert np.allclose(together, alone)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some words", None, "s")])
    got = language_id.identify(docs).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language_id.kept_documents(docs).count() == 1
    assert language_id.identify(documents(spark, [])).count() == 0


def test_rejected_documents_go(spark):
    rows = corpus() + [(9001, None, "aa", "s"), (9002, "...", "aa", "s"), (None, "karomi kami", "aa", "s")]
    docs = documents(spark, rows)
    kept = language_id.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {9001, 9002}
