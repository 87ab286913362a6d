import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loreloom.llm import url_filter

SCHEMA = "page_id long, url string, html string, host string, score string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "h", "s") for i, u in enumerate(urls)], SCHEMA)


URLS = (
    [f"http://site{i}.org/page/{i}" for i in range(40)]
    + [f"https://shop.com/fr/article-{i}" for i in range(40)]
    + [f"http://casino{i % 7}.com/de/bonus{i}?x=1" for i in range(60)]
    + ["https://www.example.org/es/x", "https://a.b.EXAMPLE.org/en/12", "https://example.org/en/2", "http://org", "http://xorg/",
       "http://site77.net/page/7", "http://casino3.net/bonus4", "http://casino3.net/bonus4", None, "", "no scheme", "ftp://u@h:80/p#f", "://a/b",
       "http://éÉ.com/fr/", "http://h.com/fr?x://y", "http://long.net/" + "ab" * 40_000]
)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    return host, rest[cut:end]


def rule_for(host, path):
    fits = []
    for verdict, rule in url_filter.RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in url_filter.judge(pages(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule, verdict = rule_for(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")
    same = [i for i, u in enumerate(URLS) if u == "http://casino3.net/bonus4"]
    assert [got[i].verdict for i in same] == ["block", "block"]
    assert got[URLS.index("http://site77.net/page/7")].verdict == "allow"


class Model:
    """Witten-Bell interpolation by plain dictionaries."""

    def __init__(self, urls, order):
        self.order, self.count, self.after = order, Counter(), defaultdict(set)
        for url in urls:
            s = url_filter.PAD * (order - 1) + url + url_filter.END
            for i in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    gram = s[i - k + 1:i + 1]
                    self.count[gram] += 1
                    self.after[k, gram[:-1]].add(gram)

    def log(self, url):
        s = url_filter.PAD * (self.order - 1) + url + url_filter.END
        total = 0.0
        for i in range(self.order - 1, len(s)):
            p = 1.0 / url_filter.ALPHABET
            for k in range(1, self.order + 1):
                gram = s[i - k + 1:i + 1]
                after = self.after[k, gram[:-1]]
                of = sum(self.count[g] for g in after)
                if after:
                    p = (self.count[gram] + len(after) * p) / (of + len(after))
            total += math.log(p)
        return total


def test_scores_equal_plain_models(spark):
    urls = [u for u in URLS if u and len(u) < 200]
    labelled = [(u, rule_for(*parts(u))[1]) for u in urls]
    train = [(u, v == "allow") for u, v in labelled if v]
    df = spark.createDataFrame(train, "url string, accepted boolean")
    slots = 1 << 26  # no two grams share one
    model = url_filter.fit(df, 3, slots)
    rows = spark.createDataFrame(list(enumerate(urls)), "k int, url string")
    got = {r.k: r.score for r in url_filter.log_ratios(rows, "k", model, 3, slots).collect()}
    good, bad = (Model([u for u, a in train if a == side], 3) for side in (True, False))
    for k, url in enumerate(urls):
        assert got[k] == pytest.approx((good.log(url) - bad.log(url)) / (len(url) + 1), abs=1e-9), url


def test_threshold_has_the_least_error(spark):
    rows = [(x / 10, x >= 3) for x in range(-20, 21)] + [(1.5, False), (-0.5, True)]
    df = spark.createDataFrame(rows, "score double, accepted boolean")
    t = url_filter.calibrate(df)
    assert 0.2 < t < 0.3 + 1e-9
    assert url_filter.calibrate(df.where("accepted")) == 0.0


def test_nothing_to_learn_from(spark):
    got = url_filter.judge(pages(spark, ["http://a.net/x", None])).collect()
    assert [r.verdict for r in got] == ["allow", "allow"]
    assert url_filter.judge(pages(spark, [])).count() == 0


def test_calibration_rows_do_not_train(spark):
    held = [u for u in URLS if u and zlib.crc32(u.encode()) % 5 == 0]
    assert 5 < len(held) < len(URLS) / 2
    assert pages(spark, held).where(F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0).count() == len(held)


def test_models_grow_with_the_grams(spark):
    # More distinct grams than any fixed table of 32,768 slots would keep apart.
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    train = [(f"http://{name()}.org/{name()}", i % 2 == 0) for i in range(1500)]
    urls = [u for u, _ in train[:20]] + [f"http://{name()}.net/{name()}" for _ in range(20)]
    model = url_filter.fit(spark.createDataFrame(train, "url string, accepted boolean"))
    good, bad = (Model([u for u, a in train if a == side], 5) for side in (True, False))
    assert model[0][4].count() == len({g for m in (good, bad) for g in m.count if len(g) == 5}) > 32_768
    rows = spark.createDataFrame(list(enumerate(urls)), "k int, url string")
    got = {r.k: r.score for r in url_filter.log_ratios(rows, "k", model, 5).collect()}
    for k, url in enumerate(urls):
        assert got[k] == pytest.approx((good.log(url) - bad.log(url)) / (len(url) + 1), abs=1e-9), url
