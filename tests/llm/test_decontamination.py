import random
from collections import Counter

import numpy as np
import pytest

from loreloom.llm import decontamination as d
from tests.llm.helpers import documents, rows_of, words

BENCH = "item_id long, text string, doc_id string, similarity string"


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], BENCH)


def shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    """Best weighted similarity over all windows of the item's size."""
    found = {}
    for doc_id, text in docs:
        own = shingles(text)
        for i, t in items:
            item = Counter(shingles(t))
            best, n = 0.0, item.total()
            for a in range(len(own) if n else 0):
                window = Counter(own[a:a + n])
                common = (item & window).total()
                best = max(best, common / (n + window.total() - common))
            if best >= 0.75:
                found[doc_id, i] = best
    return found


def corpus():
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([5, 6, 8, 9, 12, 15, 16, 18, 23, 30, 45, 60, 61, 90, 150])]
    items += [(50, None), (51, ""), (52, "too short item"), (53, items[10][1]), (54, items[10][1] + " and more of it")]
    docs = []
    for k, (i, text) in enumerate(items[:15]):
        w = text.split()
        for variant in range(5):
            passage = list(w)
            if variant == 1:
                passage[len(w) // 2] = "changed"
            if variant == 2:
                passage = passage[1:]
            if variant == 3:
                passage.insert(len(w) // 3, "extra")
            if variant == 4:
                passage = [p.upper() for p in passage[: len(w) // 2]]
            docs.append((100 * k + variant, " ".join(words(rng, rng.randint(0, 70)) + passage + words(rng, rng.randint(0, 70)))))
        # Cut off by the end of the document.
        docs.append((100 * k + 9, " ".join(words(rng, 30) + w[: len(w) * 5 // 6])))
    docs += [(5000 + i, " ".join(words(rng, 200))) for i in range(30)]
    docs += [(6000, None), (6001, ""), (6002, "a b"), (6003, items[9][1]), (6003, items[9][1])]
    return docs, items


def test_matches_equal_all_windows(spark):
    docs, items = corpus()
    got = {(r.doc_id, r.item_id): r.similarity for r in d.contaminated(documents(spark, docs).repartition(4), bench(spark, items)).collect()}
    expected = brute(docs, items)
    assert set(got) == set(expected)
    assert len(expected) > 25
    for key, similarity in expected.items():
        assert got[key] >= 0.75 and got[key] <= similarity + 1e-9


def test_portions_find_the_same(spark):
    docs, items = corpus()
    df, b = documents(spark, docs), bench(spark, items)
    whole = rows_of(d.contaminated(df, b), "doc_id", "item_id")
    assert rows_of(d.contaminated(df, b, portion=4), "doc_id", "item_id") == whole


def test_clean_documents_stay(spark):
    docs, items = corpus()
    df = documents(spark, docs + [(None, "nothing to find here at all")])
    clean = d.clean_documents(df, bench(spark, items))
    assert clean.columns == df.columns
    hit = {i for i, _ in brute(docs, items)}
    assert sorted(r.doc_id for r in clean.where("doc_id is not null").collect()) == sorted(i for i, _ in docs if i not in hit)
    assert clean.where("doc_id is null").count() == 1


def test_empty_tables(spark):
    docs, items = corpus()
    assert d.contaminated(documents(spark, []), bench(spark, items)).count() == 0
    assert d.contaminated(documents(spark, docs), bench(spark, [])).count() == 0
    assert d.clean_documents(documents(spark, docs), bench(spark, [])).count() == len(docs)


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 400, dtype=np.uint64)
    queries = prints[:200].copy()
    for q in range(200):
        for bit in rng.choice(64, q % 6, replace=False):
            queries[q] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*map(np.ndarray.tolist, d.Blocks(prints, 3).near(queries))))
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= 3
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


@pytest.mark.parametrize("n", range(5, 200))
def test_similar_passages_keep_a_whole_window(n):
    window = d.window_of(n, 5, 0.75)
    assert window + d.stride(window) - 1 <= max(d.clean_run(n, 5, 0.75), 5)


def test_fingerprints_do_not_depend_on_segments(monkeypatch):
    shingles = np.random.default_rng(2).integers(0, 2**63, 3000, dtype=np.uint64)
    wanted = [(np.arange(0, 2988, 3), 12), (np.arange(1, 2900, 7), 28), (np.zeros(0, np.int64), 4)]
    whole = d.fingerprints(shingles, wanted)
    monkeypatch.setattr(d, "SEGMENT", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, d.fingerprints(shingles, wanted)))
    for (starts, size), prints in zip(wanted, whole):
        for start, got in zip(starts[::50], prints[::50]):
            bits = np.unpackbits(shingles[start:start + size].view(np.uint8).reshape(-1, 8), axis=1)
            assert np.array_equal(np.unpackbits(np.array([got]).view(np.uint8)), bits.sum(axis=0) > size // 2)


def brute_lengths(docs, items):
    """Best weighted similarity over all windows of all lengths."""
    found = {}
    for doc_id, text in docs:
        own = shingles(text)
        for i, t in items:
            item = Counter(shingles(t))
            n, best = item.total(), 0.0
            # Best windows begin with a shingle of the item.
            for a in (a for a in range(len(own)) if own[a] in item):
                window, common = Counter(), 0
                for b in range(a, min(len(own), a + 2 * n)):
                    window[own[b]] += 1
                    common += window[own[b]] <= item[own[b]]
                    best = max(best, common / (n + b - a + 1 - common))
            if best >= 0.75:
                found[doc_id, i] = best
    return found


def edited_corpus():
    """Words put in, left out, moved and cut off, in the middle of documents."""
    rng = random.Random(17)
    items, docs = [], []
    for n in (15, 18, 23, 27, 30, 36, 38, 45, 59, 71):
        w = words(rng, n)
        items.append((n, " ".join(w)))
        cut = n // 2
        passages = [w[:cut] + ["extra"] + w[cut:], w[:cut] + w[cut + 1:], w[: n * 5 // 6], w[n - n * 5 // 6:], w[cut:] + w[:cut],
                    w[: n // 3] + ["one"] + w[n // 3 : 2 * n // 3] + ["two"] + w[2 * n // 3:], w[1 : cut] + ["extra"] + w[cut:-1]]
        docs += [(100 * n + v, " ".join(words(rng, 60) + p + words(rng, 60))) for v, p in enumerate(passages)]
    return docs, items


def test_stretched_windows_equal_all_lengths(spark):
    for docs, items in (edited_corpus(), corpus()):
        got = {(r.doc_id, r.item_id): r.similarity
               for r in d.contaminated(documents(spark, docs).repartition(4), bench(spark, items), stretch=True).collect()}
        expected = brute_lengths(docs, items)
        assert got == pytest.approx(expected) and len(expected) > 25
        hit = {i for i, _ in expected}
        clean = d.clean_documents(documents(spark, docs), bench(spark, items), stretch=True).collect()
        assert sorted(r.doc_id for r in clean) == sorted(i for i, _ in docs if i not in hit)


def test_query_finds_words_put_in_and_left_out(spark, tmp_path):
    import corpus_pipeline
    from loreloom.llm.queries import QUERIES

    docs, items = edited_corpus()
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, items).select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, str(tmp_path)).collect()}
    assert {(3600, 36), (3800, 38), (3601, 36), (3801, 38), (3002, 30), (5902, 59)} <= found
    stays = corpus_pipeline.no_benchmark_passages(spark, documents(spark, docs), str(tmp_path)).select("doc_id").collect()
    assert not {r.doc_id for r in stays} & {i for i, _ in found}
