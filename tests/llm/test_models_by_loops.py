"""The language and quality models against plain loops over the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality

MASK = (1 << 32) - 1


def grams(text, buckets):
    """The bucket of each run of three bytes, one at a time."""
    x = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    x = [32 if b < 97 and b != 39 else b for b in x]
    out = []
    for a, b, c in zip(x, x[1:], x[2:]):
        h = (c * 0x9E3779B1 + b * 0x85EBCA77 + a * 0xC2B2AE3D) & MASK
        h ^= h >> 15
        h = h * 0x2C1B3C6D & MASK
        out.append((h >> 12) & (buckets - 1))
    return out


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(12)
    words = {"en": "the and of with this that".split(), "de": "der und die mit nicht ein größe".split(), "fr": "le et les des avec une été".split(), "es": "el y los con una niño".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(1, 15))), k) for i in range(120) for k in [list(words)[i % 4]]]
    mixed = [(500 + i, " ".join(r.choice(words[r.choice(list(words))]) for _ in range(8)), None) for i in range(30)]
    return rows, rows + mixed + [(600, None, "en"), (601, "", "de"), (602, "12 34 ...", None), (603, "Ab", None), (604, "ä", None), (605, "The  AND of it's " * 3000, None)]


def test_language_equals_loops(spark, spoken):
    learned, rows = spoken
    buckets, bits = 1 << 10, 15
    schema = "doc_id long, text string, lang string"
    model = language.fit(spark.createDataFrame(learned, schema), buckets=buckets, bits=bits)
    names = sorted({k for _, _, k in learned})
    n = {k: [0] * buckets for k in names}
    for _, t, k in learned:
        for g in grams(t, buckets):
            n[k][g] += 1
    share = {k: [c / sum(n[k]) for c in n[k]] for k in names}
    code = {k: model.code[i].tolist() for i, k in enumerate(names)}
    assert model.names == names and all(abs(x) == 1 for c in code.values() for x in c)
    assert min(sum(a != b for a, b in zip(code[j], code[k], strict=True)) for j in names for k in names if j < k) >= 5
    eps = 0.5 / buckets / 100
    weight = [[0.0] * bits for _ in range(buckets)]
    for g in range(buckets):
        for b in range(bits):
            side = {s: [share[k][g] for k in names if code[k][b] == s] for s in (1, -1)}
            plus, minus = (sum(side[s]) / max(len(side[s]), 1) + eps for s in (1, -1))
            weight[g][b] = math.log(plus / minus)
    assert np.allclose(model.weights, weight, atol=1e-5)
    trust = [max(min(sum(share[k][g] * weight[g][b] for g in range(buckets)) * code[k][b] for k in names), 0) for b in range(bits)]
    trust = [t / sum(trust) * bits for t in trust]
    assert np.allclose(model.trust, trust, atol=1e-5)

    got = {g.doc_id: g for g in language.predict(spark.createDataFrame(rows, schema), model).collect()}
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        margin = [sum(weight[g][b] for g in grams(text, buckets)) / len(text.encode()) ** 0.5 for b in range(bits)]
        loss = {k: sum(trust[b] * math.log1p(math.exp(-margin[b] * code[k][b])) if margin[b] * code[k][b] > -500 else -trust[b] * margin[b] * code[k][b] for b in range(bits)) for k in names}
        order = sorted(loss.values())
        p = 1 / sum(math.exp(order[0] - x) for x in order)
        second = math.exp(order[0] - order[1]) * p
        assert got[i].score == pytest.approx(p, abs=1e-4)
        assert loss[got[i].lang_pred] == pytest.approx(order[0], abs=1e-4)
        if abs(p - second - 0.5) > 1e-3:
            assert got[i].ambiguous == (p - second < 0.5)


def clip(x, low, high):
    return min(max(x, low), high)


def strength(groups):
    """(sum, number, prior) of groups -> the prior's weight."""
    groups = [g for g in groups if g[1] > 1]
    n = sum(k for _, k, _ in groups)
    most = sum(k * p * (1 - p) for _, k, p in groups)
    if not n or not most:
        return 1.0
    between = max(sum(k * (s / k - p) ** 2 for s, k, p in groups) - sum(p * (1 - p) for _, _, p in groups), 0) / n
    return clip(most / n / between - 1, 1, 1e6) if between else 1e6


def test_quality_equals_loops_over_sites_from_urls(spark):
    r = random.Random(21)
    good, bad = "A clear sentence, with words that differ and end well.".split(), "buy NOW!!! $$$ 999 click >>>".split()
    rows, labels = [], []
    for i in range(160):
        host, folder = f"Host{i % 7}.example", r.choice(["blog", "shop", ""])
        better = r.random() < (0.9 if i % 7 < 3 else 0.2)
        text = " ".join(r.choice(good if better else bad) for _ in range(r.randint(3, 40)))
        url = r.choice([f"https://user@{host}:8080/{folder}/page{i}?q=/x/y#z", f"HTTP://{host.upper()}/{folder}/a/b"]) if i % 20 else r.choice([None, "no url", "mailto:a@b"])
        rows.append((i, url, text))
        if i % 2:
            labels.append((i, int(better)))
    rows += [(300, "https://once.example", None), (301, "https://host1.example/blog/", "")]
    pages = quality.with_site(spark.createDataFrame(rows, "doc_id long, url string, text string").withColumn("HOST", F.lit("x")), "url")

    def site(url):
        if not url or "://" not in url:
            return None, None
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, _, path = rest.partition("/")
        first = [p for p in path.split("/") if p][:1]
        return host.split("@")[-1].split(":")[0].lower(), "/" + "".join(first)

    assert {(p.doc_id, p.host, p.path) for p in pages.collect()} == {(i, *site(u)) for i, u, _ in rows}
    got = {g.doc_id: g for g in quality.classify(pages, spark.createDataFrame(labels, "doc_id long, quality int"), host="host", path="path").collect()}
    assert len(got) == len(rows)
    p = {i: 1 / (1 + math.exp(-g.doc_log_odds)) for i, g in got.items()}
    at = {i: site(u) for i, u, _ in rows}
    rate = clip(sum(p.values()) / len(p), 1e-3, 1 - 1e-3)
    hosts, paths = {}, {}
    for i, (h, q) in at.items():
        for table, key in ((hosts, h), (paths, (h, q))):
            s, n = table.get(key, (0.0, 0))
            table[key] = s + p[i], n + 1
    host_k = strength([(s, n, rate) for s, n in hosts.values()])
    mean = {h: (s + host_k * rate) / (n + host_k) for h, (s, n) in hosts.items()}
    path_k = strength([(s, n, mean[h]) for (h, _), (s, n) in paths.items()])
    for i, g in got.items():
        h, q = at[i]
        (hs, hn), (ps, pn) = hosts[h], paths[h, q]
        host_rate = clip((hs - p[i] + host_k * rate) / (hn - 1 + host_k), 1e-3, 1 - 1e-3)
        path_rate = clip((ps - p[i] + path_k * host_rate) / (pn - 1 + path_k), 1e-3, 1 - 1e-3)
        final = 1 / (1 + math.exp(-(g.doc_log_odds + math.log(path_rate / (1 - path_rate)) - math.log(rate / (1 - rate)))))
        assert (g.host_rate, g.path_rate, g.quality_p) == (pytest.approx(host_rate, rel=1e-6), pytest.approx(path_rate, rel=1e-6), pytest.approx(final, rel=1e-6)) and g.keep == (final >= 0.5 or g.quality_p >= 0.5)
