"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import boilerplate, bpe, contamination, language, licenses, quality, simhash, suffix_tree
from tidemark.llm.batches import texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of river stone été groß niño light under over small 42 x7 cat dog runs far away from here".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(sentence(r, r.randint(1, 30)) for _ in range(r.randint(1, 6))), r.choice(["en", "fr"]), f"src{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "fr", "src1", 3), (None, "the river", "en", "src0", 9), (103, sentence(r, 9000), "en", "src2", 1)]
    rows += [rows[3], rows[3], (104, rows[3][1], "en", "src1", 1), (105, rows[5][1] + " end", "en", "src1", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns named as operators name theirs."""
    names = ["fp", "key", "row", "h", "n_lines", "component_id", "keep", "quality_p", "__text__", "__n__", "__hits__", "ids", "score", "slot", "media"]
    return df.withColumns({n: F.lit("other") for n in names})


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_simhash_components(spark, docs):
    df, rows = docs
    got = simhash.components(clashing(df)).collect()
    assert len(got) == len(rows)
    prints = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows}
    roots = brute_components(list(prints.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            k = roots[prints[r[0], r[1]]]
            least[k] = min(least.get(k, 10**9), r[0])
    expected = collections.Counter((r[0], f"{prints[r[0], r[1]]:016x}", least.get(roots[prints[r[0], r[1]]])) for r in rows)
    assert collections.Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == expected
    assert simhash.components(empty(spark)).count() == 0


@pytest.mark.parametrize(("parts", "bucket", "block"), [(3, 32, 2048), (2, 32, 2048), (3, 2, 3), (5, 1, 2)])
def test_links_are_complete(spark, parts, bucket, block):
    r = random.Random(parts * 10 + bucket)
    base = [r.getrandbits(64) for _ in range(30)]
    near = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base[:6] for _ in range(25)} | set(base)
    prints = sorted(near)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = simhash.links(df, 4, parts, bucket, block).collect()
    pairs = [(f.a % (1 << 64), f.b % (1 << 64)) for f in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    parent = {p: p for p in prints}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[root(a)] = root(b)
    expected = brute_components(prints)
    assert len({root(p) for p in prints}) == len(set(expected.values()))
    assert len(pairs) < 40 * len(prints)


def test_a_link_through_a_crowded_bucket_is_kept(spark):
    bits = lambda *b: sum(1 << k for k in b)
    leader, probe, member = bits(0), bits(21, 22, 42), bits(0, 21, 22, 23, 24, 42, 43)
    assert (leader ^ probe).bit_count() == (probe ^ member).bit_count() == 4 and (leader ^ member).bit_count() == 6
    r = random.Random(8)
    crowd = {leader | bits(*r.sample([*range(30, 42), *range(50, 63)], 3)) for _ in range(80)}
    prints = sorted(crowd | {leader, probe, member})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    parent = {p: p for p in prints}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for f in simhash.links(df).collect():
        parent[root(f.a)] = root(f.b)
    expected = brute_components(prints)
    assert expected[member] == expected[probe] == expected[leader] and root(member) == root(probe) == root(leader)
    assert len({root(p) for p in prints}) == len(set(expected.values()))


def test_one_of_each_keeps_rows_without_id(spark, docs):
    df, rows = docs
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [k.doc_id for k in kept.collect()]
    assert None in ids and 104 not in ids and 3 in ids


# Line dedup


def test_boilerplate(spark):
    rows = [(i, f"head\nline {i}\n\n{' head ' if i % 2 else 'tail'}", "s") for i in range(40)] + [(50, "head", "t"), (51, None, "s"), (52, "", "s"), (53, "head", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("other"))
    got = {r.doc_id: r for r in boilerplate.drop_boilerplate(df, ratio=0.4, least=5).collect()}
    assert got[0].text == "line 0\n" + "\n" + "tail" or got[0].text == "line 0\n"
    assert "head" not in got[1].text and got[1].n_dropped == 2
    assert got[50].text == "head" and got[53].text == "head" and got[51].text is None and got[52].text == ""
    assert boilerplate.drop_boilerplate(empty(spark)).count() == 0


@pytest.mark.parametrize(("pages", "on", "gone"), [(2, 2, False), (3, 3, True), (9, 9, True), (9, 2, False), (50, 5, False), (50, 6, True), (5000, 450, False), (5000, 600, True)])
def test_boilerplate_follows_the_ratio(spark, pages, on, gone):
    df = spark.range(pages).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.when(F.col("id") < on, "\nfooter").otherwise("")).alias("text"), F.lit("s").alias("source"), F.lit(1).alias("__bad__"), F.lit(2).alias("__HOST__"))
    row = boilerplate.drop_boilerplate(df).filter("doc_id = 0").first()
    assert (row.text == "own 0") == gone and row.n_dropped == int(gone) and row["__bad__"] == 1 and row["__HOST__"] == 2


# BPE


def flat(values):
    return texts(pa.array(values, pa.string()))


def test_bpe_equals_tiktoken():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    ours = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(tokens, bpe.PerfectHash(tokens), public_tokenizers.PATTERN)
    assert sorted(codec.table.slots) == list(range(len(tokens)))
    assert all(codec.table.get(tokens[i]) == i for i in range(0, len(tokens), 97)) and codec.table.get(b"no such token at all") is None
    r = random.Random(1)
    parts = [*"aé \n\tsT1²½中😀!'lmrved\u3000\xa0\x00\x1c\x85", "<|endoftext|>", "'re", "'ll", "'s", "  ", "'"]
    cases = ["", "'", "'s", "a's", "'ll", "'r", "x'", "  ", " 's", "\n's", "''s", "'really", *("".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(6000))]
    for c in (codec, bpe.Codec(tokens, codec.table, public_tokenizers.PATTERN + "|(?!)")):  # cut in numpy, and by the pattern
        ids, ends = c.encode(*flat(cases))
        raw, at = c.decode(ids, ends)
        for k, text in enumerate(cases):
            assert ids[ends[k] : ends[k + 1]].tolist() == ours.encode_ordinary(text) and raw[at[k] : at[k + 1]] == text.encode()


def test_bpe_memo_generations(monkeypatch):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(tokens, bpe.PerfectHash(tokens), public_tokenizers.PATTERN)
    text = " ".join(f"w{i}q" for i in range(300))
    want = codec.encode(*flat([text]))[0].tolist()
    monkeypatch.setattr(bpe, "MEMO", 50)
    small = bpe.Codec(tokens, codec.table, public_tokenizers.PATTERN)
    assert all(small.encode(*flat([text]))[0].tolist() == want for _ in range(3)) and len(small.young) <= 50 and len(small.old) <= 50


def test_bpe_merges_in_rounds_equal_tiktoken():
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ours = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(tokens, bpe.PerfectHash(tokens), public_tokenizers.PATTERN, short=12, memo=40)
    r = random.Random(2)
    words = ["", "a", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "é" * 6, "é" * 7, *("".join(r.choice("aeinrstbé中😀") for _ in range(r.randint(1, 20))) for _ in range(3000))]
    cases = words + [" ".join(r.choices(words, k=8)) for _ in range(500)]
    for some in (cases, cases[:7], [""]):
        ids, ends = codec.encode(*flat(some))
        assert [ids[ends[k] : ends[k + 1]].tolist() for k in range(len(some))] == [ours.encode_ordinary(x) for x in some]
    assert len(codec.young) <= 40 and len(codec.old) <= 40
    # A whole token that its merges don't lead to is still one token.
    few = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abcd", b"bcd"]
    want = bpe.Codec(few, bpe.PerfectHash(few), public_tokenizers.PATTERN).encode(*flat(["abcd bcd abcd", "xabcd"]))
    got = bpe.Codec(few, bpe.PerfectHash(few), public_tokenizers.PATTERN, short=12).encode(*flat(["abcd bcd abcd", "xabcd"]))
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist() and 258 in got[0]


def test_bpe_round_trip(spark, docs):
    df, rows = docs
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ours = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    got = bpe.round_trip(clashing(df), path, public_tokenizers.PATTERN).collect()
    expected = collections.Counter()
    for row in rows:
        ids = ours.encode_ordinary(row[1] or "")
        expected[row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(g) for g in got) == expected
    back = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert collections.Counter(bytes(b.decoded) for b in back) == collections.Counter((r[1] or "").encode() for r in rows)
    assert bpe.round_trip(empty(spark), path, public_tokenizers.PATTERN).count() == 0


# Decontamination


def brute_words(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("block", [10**6, 3])
def test_decontamination(spark, docs, block):
    df, rows = docs
    bench = [(1, " ".join(rows[0][1].split()[:14]).upper()), (2, "cat dog runs"), (3, None), (4, "!!"), (10, " ".join(rows[0][1].split()[2:13])), (11, sentence(random.Random(9), 30)), (None, "runs far away")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    windows = {}
    for item, text in bench:
        w = brute_words(text)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add("" if item is None else str(item))
    expected = collections.Counter()
    for row in rows:
        w = brute_words(row[1])
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    items |= windows[tuple(w[p : p + n])]
        expected[row[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    got = contamination.scan(clashing(df), b, block=block).collect()
    assert collections.Counter(tuple(g)[:6] for g in got) == expected
    assert all(g.n_hit == sum(z - a for a, z in zip(g.hit_spans[::2], g.hit_spans[1::2], strict=True)) for g in got)
    kept = contamination.decontaminate(df, b)
    assert kept.columns == df.columns and kept.count() == sum(n for k, n in expected.items() if not k[5])
    cut = contamination.decontaminate(df, b, drop=False).collect()
    assert len(cut) == len(rows)
    assert all(len(brute_words(c.text)) == g.n_words - g.n_hit for c in cut for g in got if c.doc_id == g.doc_id and c.doc_id in (0, 1, 103))
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.scan(df, none).filter("contaminated").count() == 0
    assert contamination.scan(empty(spark), b).count() == 0


# Language


def test_language(spark):
    r = random.Random(2)
    words = {"en": "the and of with this that from have".split(), "de": "der und die mit nicht ein ist das".split(), "fr": "le et les des avec une est dans".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k, "s", 1) for i in range(300) for k in ["en", "de", "fr"][i % 3 : i % 3 + 1]]
    rows += [(900, None, None, None, None), (901, "12 34 !", "en", "s", 1), (902, "", None, None, 0), (None, "the and of", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {g.doc_id: g for g in language.identify(clashing(df)).collect()}
    assert len(got) == len(rows)
    held = [x for x in rows if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 4 == 2 and x[0] < 900]
    assert all(got[x[0]].held_out for x in held) and sum(g.held_out for g in got.values()) >= len(held)
    assert sum(got[x[0]].lang_pred == x[2] for x in held) / len(held) > 0.97
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= g.score <= 1 for g in got.values())
    assert language.identify(empty(spark)).count() == 0
    code = language.codewords(4, 15)
    assert min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) >= 5


def test_margins_do_not_depend_on_neighbours(spark):
    rows = [(i, t, l, "s", 1) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 8)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA).select("lang", "text"))
    one = language.predict(spark.createDataFrame(rows[:1], SCHEMA), model).first()
    many = [g for g in language.predict(spark.createDataFrame(rows, SCHEMA).coalesce(1), model).collect() if g.doc_id == 0]
    assert one.score == pytest.approx(many[0].score, abs=1e-9)


# Quality


def test_quality(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, " ".join(r.choice(WORDS).upper() + "!!" for _ in range(40)) if bad else sentence(r, 40) + ".", "en", f"src{i % 2}", 1))
        if i < 120:
            labels.append((i, int(not bad), 0))
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (502, sentence(r, 8000), "en", "new", 1)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    out = quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {g.doc_id: g for g in out.collect()}
    assert len(got) == len(rows)
    assert all(got[i].keep == (i % 4 != 0) for i in range(240))
    assert all(0 < g.host_rate < 1 and 0 < g.path_rate < 1 for g in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(df, none).count() == len(rows)
    assert quality.classify(empty(spark), none).count() == 0


def test_sparse_hosts_shrink(spark):
    rows = [("big", "a", 0.2)] * 200 + [("mid", "a", 0.9)] * 50 + [("tiny", "a", 0.9)]
    groups, rate = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    post = {g.host: (g.host_s + g.host_k * rate) / (g.host_n + g.host_k) for g in groups.collect()}
    assert abs(post["tiny"] - rate) < abs(post["mid"] - rate)


# Suffix tree


def test_suffix_tree(spark, docs):
    df, rows = docs
    got = suffix_tree.score(clashing(df), p_min=1e-3, divergence=1e-5)
    got = {(g.doc_id, g.n_tokens): g for g in got.collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    counts = collections.Counter()
    for i, t, *_ in rows:
        if i is not None and not held(i):
            counts.update([*split(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    training = df.filter(F.col("doc_id").isNotNull() & ~suffix_tree.held_out(F.col("doc_id")))
    tree = suffix_tree.fit(training, p_min=1e-3, divergence=1e-5)
    index = {c: k for k, c in enumerate(tree.contexts)}
    for i, t, *_ in rows:
        w = [*split(t), b"\n"]
        g = got[i, len(w)]
        assert g.held_out == held(i) and g.train_tokens == n and g.n_known == sum(counts[x] > 0 for x in w)
        assert g.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        text, total = b"\n" + b" ".join(split(t)) + b"\n", 0.0
        for k in range(1, len(text)):
            c = text[max(0, k - tree.depth) : k]
            c = c[c.rfind(b"\n") :] if b"\n" in c else c
            while c not in index:
                c = c[1:]
            total += float(tree.score[index[c], tree.symbol[text[k]]])
        assert g.score == pytest.approx(total, rel=1e-6)
    shares = 10.0 ** tree.score[:, :-1]
    assert (shares.sum(axis=1) < 1.0001).all() and (shares.sum(axis=1) > 0.9).all()
    assert suffix_tree.score(empty(spark)).count() == 0


# Licenses


def test_licenses(spark, docs):
    df, _ = docs
    r = random.Random(8)
    rows, named = [], licenses.templates()
    for i, (name, text) in enumerate(sorted(named.items())):
        rows.append((i, sentence(r, r.randint(0, 70)) + "\n" + text.upper() + "\n" + sentence(r, r.randint(0, 70)), name))
        words = text.split()
        if len(words) > 40:  # some words of a long text changed
            for k in range(0, len(words), 60):
                words[k] = "somethingelse"
            rows.append((i + 100, sentence(r, 20) + " " + " ".join(words), name))
    rows += [(900, "License Apache the under", ""), (901, None, ""), (902, "", ""), (903, sentence(r, 9000), "")]
    got = {g.doc_id: g for g in licenses.scan(clashing(spark.createDataFrame(rows, "doc_id long, text string, want string"))).collect()}
    for i, _, name in rows:
        license = name.partition("/")[0]
        assert license in got[i].licenses.split(","), (name, got[i].licenses)
        assert name or got[i].n_licenses == 0
        if name.startswith(("BSD", "MIT", "ISC")):  # of nested ones only the one that is meant
            assert got[i].licenses == license
    # Against every window, compared in full: what isn't found gave way to another.
    table = licenses.Templates(named)
    for i, text, _ in rows:
        words = brute_words(text)
        found = set()
        for t, name in enumerate(table.names):
            block = 1
            while 2 * block < len(table.shingles[t]):
                block *= 2
            for a in range(0, max(len(words) - 4, 0), block):
                part = words[a : a + 3 * block + 4]
                own = {" ".join(part[k : k + 5]).encode() for k in range(len(part) - 4)}
                if len(own & table.shingles[t]) >= 0.8 * len(table.shingles[t]):
                    found.add(name)
        mine = {m.template for m in got[i].matches}
        assert mine <= found and (not found or mine)
        for name in found - mine:
            t = table.shingles[table.names.index(name)]
            assert any(len(t & table.shingles[table.names.index(o)]) >= 0.8 * min(len(t), len(table.shingles[table.names.index(o)])) for o in mine)
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(df).count() == df.count()


def test_licenses_do_not_hang_on_neighbours():
    """Windows start anew at each text: a text alone and among others has the same matches."""
    r = random.Random(4)
    table = licenses.Templates(licenses.templates())
    cases = [sentence(r, 3), licenses.templates()["MIT/text"].lower(), sentence(r, 700), "", licenses.NOTICES["GPL-3.0/header"].lower(), "a b c d", licenses.templates()["MPL-2.0/text"].lower()]
    alone = [table.find(*flat([c]), 0.8)[0] for c in cases]
    assert table.find(*flat(cases), 0.8) == alone and [bool(x) for x in alone] == [False, True, False, False, True, False, True]


# Near copies at similarity 0.8


def test_near_groups(spark):
    r = random.Random(21)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, family = [], {}
    for k in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(150, 400))]
        for copy in range(r.randint(1, 5)):
            own = list(words)
            if copy:
                own[r.randrange(len(own))] = "changed"  # similarity of 0.93 at least
            rows.append((len(rows), " ".join(own)))
            family[len(rows) - 1] = k
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    least = {}
    for i, k in family.items():
        least[k] = min(least.get(k, 10**9), i)
    for options in ({}, {"bucket": 1, "block": 2}):
        got = simhash.near_groups(df, **options).collect()
        assert len(got) == len(rows)
        assert all(g.component_id == (least[family[g.doc_id]] if g.doc_id in family else 900 if g.doc_id else 0) for g in got)
    assert simhash.near_groups(df.limit(0)).count() == 0



def shingles_of(text):
    words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(x, y):
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def brute_groups(rows):
    """Components of all links of 0.8 or more."""
    sets = [shingles_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and jaccard(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    out = collections.defaultdict(list)
    for i, (name, _) in enumerate(rows):
        out[root(i)].append(name)
    return {name: min(group) for group in out.values() for name in group}


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "block": 8, "group": 12}])
def test_near_groups_equal_brute_force_on_families(spark, options):
    """Families of near copies around a text, short ones among them: the same groups as by all pairs."""
    r = random.Random(31)
    vocabulary = [f"w{k}" for k in range(2000)]
    rows = []
    for n, copies in ((300, 60), (120, 25), (40, 20), (9, 12), (6, 6), (3, 3)):
        words = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(copies):
            own = list(words)
            for _ in range(r.randint(0, max(1, n // 60))):
                own[r.randrange(n)] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 8, 60])))) for k in range(60)]
    rows += [(900, None), (901, " "), (902, rows[70][1].upper()), (903, rows[70][1] + " end")]
    got = {g.doc_id: g.component_id for g in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    want = brute_groups(rows)
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
    sets = {name: shingles_of(t) for name, t in rows}
    for name, least in got.items():  # nothing is grouped but through links of 0.8
        assert name == least or any(jaccard(sets[name], sets[o]) >= 0.8 for o in got if o != name and got[o] == least)


def test_near_groups_recall_and_precision_of_lone_pairs(spark):
    """Pairs at a known similarity, far from all others."""
    r = random.Random(32)
    rows, made = [], []
    for target in (0.6, 0.7, 0.8, 0.82, 0.85, 0.9):
        for k in range(60):
            union = r.choice([25, 60, 200, 600])
            shared = math.ceil(target * union - 1e-9)
            tail = union - shared
            head = [f"{target}x{k}x{i}" for i in range(shared + 4)]
            x, y = (head + [f"{target}{s}{k}x{i}" for i in range(m)] for s, m in (("a", tail // 2), ("b", tail - tail // 2)))
            rows += [(len(rows), " ".join(x)), (len(rows) + 1, " ".join(y))]
            made.append((target, len(rows) - 2, jaccard(shingles_of(rows[-2][1]), shingles_of(rows[-1][1]))))
    got = {g.doc_id: g.component_id for g in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = collections.defaultdict(list)
    for target, i, similarity in made:
        assert (similarity >= 0.8) == (target >= 0.8)
        found[target].append(got[i] == got[i + 1])
    assert not any(found[0.6]) and not any(found[0.7])
    assert all(sum(found[t]) >= 0.95 * len(found[t]) for t in (0.8, 0.82, 0.85, 0.9)), {t: sum(f) for t, f in found.items()}
