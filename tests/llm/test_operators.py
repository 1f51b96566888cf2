"""Brute force, round trips and odd input for the training-data operators."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, collocations, exact_dedup, language_id, lm_scoring, mixing, near_dedup, queries, spelling, topk, toxicity, training_order, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, component_id int, score string, target string, size int, host int"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 0, "x", 1, "y", "z", 2, 3) for r in rows], DOCS)


ODD = [
    (1, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "a"),
    (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "en", "b"), (None, "lonely text without a number", "en", None),
    (6, "word " * 30_000, "en", "a"), (7, "word " * 30_000 + "end", "en", "b"), (8, "a", "de", "b"), (9, "émile ünder 🙂 \0 end", "fr", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


# Exact dedup


def test_chunks_join_to_the_text_and_resynchronise(spark):
    rng = random.Random(3)
    long = "".join(rng.choice(["word ", "Sentence end. ", "line\n", "x" * 50, "🙂"]) for _ in range(3000))
    han = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60_000))
    flat = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789{};=()") for _ in range(80_000))
    texts = [long, "new start " + long, han, "新" + han, flat, "x=1;" + flat, "", "a" * 20_000, "\n" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(exact_dedup.chunks(F.col("text")).alias("c"), "text")
    found = df.collect()
    assert all("".join(r.c).encode("latin-1").decode() == r.text for r in found)
    assert max(len(c) for r in found for c in r.c) <= exact_dedup.MAX_CHUNK
    for k in (0, 2, 4):
        assert len(set(found[k].c) & set(found[k + 1].c)) > len(found[k].c) / 2


def test_exact_groups_of_odd_rows(spark, odd, none):
    found = sorted(rows(exact_dedup.exact_groups(odd)), key=str)
    assert len(found) == len(ODD)
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert {r["keep_id"] for r in by[1]} == {2} and by[1][0]["group_size"] == 3 and not by[1][0]["kept"]
    assert sorted(r["kept"] for r in by[2]) == [False, True]
    assert by[3][0]["keep_id"] == 4 and by[4][0]["kept"] and by[4][0]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[None][0]["kept"] and by[None][0]["keep_id"] is None
    assert by[6][0]["kept"] and by[7][0]["kept"]
    assert exact_dedup.exact_groups(none).count() == 0


def test_dropping_copies_keeps_columns_and_one_row(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, 5, None, 6, 7, 8, 9], key=str)
    assert exact_dedup.drop_copies(none).count() == 0


def test_helper_names_are_the_callers(spark):
    """Columns named like the helpers of any stage come back as they were; an id that reads null is no null."""
    names = ["id", "from", "sha", "row", "copies", "copy", "times", "found", "__id", "__sha"]
    data = [(1, "a b c", "en", "s", *("keep me",) * len(names)), (1, "a b c", "en", "s", *("keep me",) * len(names)), (2, "d e", "en", "s", *("keep me",) * len(names))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for kept in (exact_dedup.drop_copies(df), near_dedup.drop_near_copies(df), mixing.mixed_documents(df)):
        assert kept.columns == df.columns and {r[n] for r in kept.collect() for n in names} == {"keep me"}
    ids = spark.createDataFrame([("null", "x", "", ""), (None, "x", "", ""), (None, "y", "", "")], "doc_id string, text string, lang string, source string")
    assert sorted(map(str, exact_dedup.drop_copies(ids).select("doc_id", "text").collect())) == sorted(["Row(doc_id='null', text='x')", "Row(doc_id=None, text='y')"])



def test_shared_identifiers_are_told_apart(spark, monkeypatch):
    """With a hash that is the same for all chunks, digests decide."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long") if not isinstance(c[0], str) else real(*c))
    found = rows(exact_dedup.exact_groups(docs_of(spark, [(1, "first text", "", ""), (2, "other text", "", ""), (3, "first text", "", "")])))
    assert {r["doc_id"]: r["keep_id"] for r in found} == {1: 3, 2: 2, 3: 3}


# Mixing


def test_targets_fill_up_to_three_epochs(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert found["b"] == 30 and found[None] == 15
    assert sum(found.values()) == pytest.approx(1115)
    assert found["c"] == pytest.approx(3 * found["a"]) or found["a"] == 300


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = random.Random(5)
    data = [(i, "w " * rng.randint(0, 60), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = docs_of(spark, data)
    found = rows(mixing.mix(df))
    assert sorted(map(str, found)) == sorted(map(str, rows(mixing.mix(df.repartition(7)))))
    taken, target = defaultdict(int), {}
    source = {d: s for d, _, _, s in data}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    again = mixing.mixed_documents(df)
    assert again.columns == df.columns and again.count() == sum(r["copies"] for r in found)


def slow_mix(data, weights):
    """data (doc_id, text, lang, source): words taken of each (doc_id, source, text), by one sort of a source's rows."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in data:
        sizes[s] += words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share, open_ = {s: k % 3 + 1 for k, s in enumerate(order)}, list(order)
    total, target = sum(sizes.values()), {}
    while open_:
        left = total - sum(target.values())
        full = [s for s in open_ if left * share[s] / sum(share[x] for x in open_) >= 3 * sizes[s]]
        if not full:
            target |= {s: left * share[s] / sum(share[x] for x in open_) for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        open_ = [s for s in open_ if s not in full]

    def key(r):
        sha = hashlib.sha256((r[1] or "").encode()).hexdigest()
        name = f"null:{sha}" if r[0] is None else str(r[0])
        u = (int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -np.log(u) / weights.get(r[0], mixing.DEFAULT_WEIGHT), r[0] is not None, r[0] or 0, sha

    taken = defaultdict(int)
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, upto = target[s] - whole * sizes[s], 0
        for r in sorted((r for r in data if r[3] == s), key=key):
            n = words(r[1])
            upto += n
            taken[r[0], s, r[1] or ""] += min(whole + (upto - n / 2 <= rest), 3) * n
    return taken


def test_mix_of_repeated_ids_against_one_sort(spark):
    rng = random.Random(11)
    data = [(i % 50, "w " * rng.randint(0, 40), "en", "ab"[i % 2]) for i in range(0, 200)] + [(None, "x y " * (i % 5), "en", "b") for i in range(60)] + [(7, "same text", "en", "c")] * 40 + [(8, "", "en", "d"), (9, "one", "en", "d")]
    df, weights = docs_of(spark, data), {i: 1e-9 if i % 3 else 1.0 for i in range(50)}
    table = spark.createDataFrame(list(weights.items()), "doc_id long, weight double")
    want = slow_mix(data, weights)
    for most in (1, 10, mixing.SORTED):
        found = rows(mixing.mix(df, table, most_rows=most))
        assert len(found) == len(data) and max(r["copies"] for r in found) <= 3
        assert sum(r["taken"] for r in found) == sum(want.values())
    whole = defaultdict(int)
    for r in mixing.mixed_documents(df, table).collect():
        whole[r.doc_id, r.source, r.text] += len(r.text.split())
    assert {k: v for k, v in whole.items() if v} == {k: v for k, v in want.items() if v}


def test_better_documents_come_first(spark):
    df = docs_of(spark, [(i, "one two", "en", "ab"[i % 2]) for i in range(4000)] + [(9999, "w " * 6000, "en", "c")])
    weights = spark.createDataFrame([(i, 1.0 if i % 4 == 0 else 0.1) for i in range(4000)], "doc_id long, weight double")
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(df, weights)) if r["doc_id"] != 9999 and r["doc_id"] % 2 == 0}
    rate = lambda ids: np.mean([taken[i] for i in ids])
    assert rate([i for i in taken if i % 4 == 0]) > rate([i for i in taken if i % 4])


def test_mix_of_odd_rows(odd, none):
    found = rows(mixing.mix(odd))
    assert len(found) == len(ODD) and {r["doc_id"] for r in found if r["size"] == 0} == {3, 4, 5}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# SimHash near-dedup


def slow_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, linked):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(values, 2):
        if linked(a, b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_near_groups_against_brute_force(spark, odd, none):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(80)) for _ in range(6)]
    data = [(i, (b if rng.random() < 0.3 else re.sub(r"^\S+", "Q%d" % rng.randint(0, 9), b, count=1)), "", "") for i, b in enumerate(base * 12)]
    for df, source in ((docs_of(spark, data), data), (odd, ODD)):
        found = rows(near_dedup.near_groups(df))
        assert len(found) == len(source)
        prints = {t: slow_fingerprint(t) for _, t, *_ in source}
        root = slow_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
        least = defaultdict(list)
        for d, t, *_ in source:
            if d is not None:
                least[root[prints[t]]].append(d)
        want = sorted((str(d), f"{prints[t]:016x}", min(least[root[prints[t]]], default=None)) for d, t, *_ in source)
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == want
    assert near_dedup.near_groups(none).count() == 0


def test_crowded_shards_are_searched_in_parts(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    flips = {sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)}
    values = sorted({(centre ^ f) - (1 << 64) * ((centre ^ f) >> 63) for f in flips})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in near_dedup.components(near_dedup.links(df, shard=16)).collect()}
    want = slow_components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert all(found.get(v, v) == want[v] for v in values)
    assert near_dedup.links(df, shard=16).count() < len(values) * 15
    for scheme in near_dedup.SCHEMES[1:]:
        wide = {r.node: r.root for r in near_dedup.components(near_dedup.links(df, scheme=scheme)).collect()}
        assert all(wide.get(v, v) == want[v] for v in values)
    assert [near_dedup.scheme_for(n)[1] for n in (10, 10**8, 10**9, 10**11, 10**13)] == [2, 2, 3, 4, 4]


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(4)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = near_dedup.BKTree()
    for k, v in enumerate(values):
        tree.add(v, k)
    for q in values[:50]:
        assert sorted(k for ks in tree.within(q, 3) for k in ks) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_similar_texts_leave_one(spark, odd, none):
    rng = random.Random(8)
    words = ["w%d" % k for k in range(500)]
    data = []
    for i in range(12):
        text = [rng.choice(words) for _ in range(300)]
        for k in range(5):
            own = list(text)
            for at in rng.sample(range(300), [0, 2, 5, 20, 60][k]):
                own[at] = "new%d" % rng.randint(0, 10**6)
            data.append((i * 10 + k, " ".join(own), "", ""))

    def shingles(t):
        w = t.lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {d: shingles(t) for d, t, *_ in data}
    root = slow_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = near_dedup.drop_near_copies(docs_of(spark, data))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert kept.columns == odd.columns
    # 1 and 2 are equal; 3, 4 and 5 have no words; the repeating text is the same set of shingles but for its end.
    assert sorted((r.doc_id for r in near_dedup.drop_near_copies(odd).collect()), key=str) == sorted([1, 3, None, 6, 7, 8, 9], key=str)
    assert near_dedup.drop_near_copies(none).count() == 0


def test_repeated_lines_do_not_hide_similar_texts(spark):
    rng = random.Random(9)
    data = []
    for i in range(16):
        text = " ".join("w%d" % rng.randint(0, 10**6) for _ in range(300))
        line = " ".join("f%d" % rng.randint(0, 10**6) for _ in range(10))
        other = " ".join("o%d" % rng.randint(0, 10**6) for _ in range(300))
        data += [(10 * i + k, t, "", "") for k, t in enumerate((text, f"{text} " + f"{line} " * 30, f"{text} " + f"{line} " * 100, f"{other} " + f"{line} " * 100))]

    def shingles(t):
        w = t.lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {d: shingles(t) for d, t, *_ in data}
    root = slow_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(root.values())) == 32
    kept = near_dedup.drop_near_copies(docs_of(spark, data))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("apart", [False, True])
def test_sets_decide_beyond_the_radius(apart):
    rng = random.Random(10)
    sets = []
    for _ in range(8):
        base = rng.sample(range(10**6), 40)
        sets += [base, base[:36], base[:32] + rng.sample(range(10**6, 2 * 10**6), 1), base[:20]]
    found = near_dedup.Sets([np.array(sorted(s), np.uint32).tobytes() for s in sets], 0.8)
    places = [(rng.getrandbits(64), k) for k in range(len(sets))]
    members, asked = (places[::2], places[1::2]) if apart else (places, [])
    links = near_dedup.spanning_links(members, asked, 0, found)
    alike = {frozenset(p) for p in combinations(range(len(sets)), 2) if len(set(sets[p[0]]) & set(sets[p[1]])) >= 0.8 * len(set(sets[p[0]]) | set(sets[p[1]]))}
    wanted = {p for p in alike if not apart or sum(p) % 2}
    assert {frozenset(p) for p in links} <= wanted
    together = lambda edges: slow_components(range(len(sets)), lambda a, b: frozenset((a, b)) in edges)
    assert together({frozenset(p) for p in links}) == together(wanted)


# URL filter


def test_urls_are_split_and_rules_fit(spark, none):
    urls = [
        (1, "https://WWW.Example.COM:80/en/70?x=://y"), (2, "x://example.net/de/81#a"), (3, "a/b"), (4, None), (5, "http://notexample.com/en/7"),
        (6, "http://example.net/de/9"), (7, "ftp://sub.org/es/"), (7, "ftp://sub.org/es/"), (8, "http://casino.example.net/de/8?"), (9, "://?"),
    ]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("verdict", F.lit(1)).withColumn("host", F.lit("x"))
    found = {r["page_id"]: r for r in rows(url_filter.judge(df))}
    assert url_filter.judge(df).count() == len(urls)
    assert (found[1]["host"], found[1]["path"], found[1]["rule"]) == ("www.example.com:80", "/en/70", None)
    assert (found[2]["rule"], found[2]["verdict"]) == ("example.net/de/8", "block")
    assert (found[3]["host"], found[3]["path"]) == ("", "") == (found[4]["host"], found[4]["path"])
    assert (found[5]["rule"], found[5]["verdict"]) == ("com/en/", "block")
    assert (found[6]["rule"], found[6]["verdict"]) == ("net/de/", "allow")
    assert (found[7]["rule"], found[7]["verdict"]) == ("org/es/", "block")
    assert found[8]["verdict"] == "block" and found[9]["host"] == ""
    assert url_filter.judge(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("lang").alias("html"))).count() == 0


def test_pages_are_judged_by_their_own_signs(spark):
    """A host's pages differ; its verdict comes from all of them."""
    junk, plain = "<p>of%%% the*** and### in</p>", "<p>Words of a page.</p><p>And of another.</p>"
    pages = [("mixed.pills-shop.org", junk)] * 9 + [("mixed.pills-shop.org", plain)] + [("good.com", plain)] * 30 + [("good.com", "<p>WHAT!! A!! DAY!!</p>"), ("good.com", "<p>a</p><p>a</p>"), ("links.com", "<a href=x>a</a> <a href=y>b</a>"), ("good.com", None)]
    df = spark.createDataFrame([(k, f"http://{h}/x", t) for k, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    bad = [r.bad for r in df.select(url_filter.page_outcomes(F.col("url"), F.col("html"), ["none"]).alias("bad"), "page_id").orderBy("page_id").collect()]
    assert bad == [1] * 9 + [0] + [0] * 30 + [1, 1, 1, 0]
    outcomes = df.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.page_outcomes(F.col("url"), F.col("html"), ["none"]).alias("bad"))
    found = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(df, outcomes, rules=[]))}
    assert {found[k] for k in range(10)} == {"block"} and {found[k] for k in range(10, 42)} == {"allow"}


def test_suffixes_of_several_labels(spark):
    hosts = ["a.b.shop.co.uk", "shop.co.uk", "co.uk", "www.example.com:80", "com", "", "x.y.pref.tokyo.jp"]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("shop.co.uk", "co.uk")] * 2 + [("co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("y.pref.tokyo.jp", "pref.tokyo.jp")]
    bad = [("a%d.shop.co.uk" % k, 1) for k in range(20)] + [("a%d.fine.co.uk" % k, 0) for k in range(20)]
    blocked = {r.host: r.blocked for r in url_filter.reputations(spark.createDataFrame(bad * 5, "host string, bad int")).collect()}
    assert blocked["a1.shop.co.uk"] and not blocked["a1.fine.co.uk"]


def test_hosts_are_shrunk_to_their_parents(spark):
    data = [("bad%d.spam.com" % (i % 5), 1) for i in range(100)] + [("h%d.good.com" % (i % 9), int(i % 50 == 0)) for i in range(300)]
    data += [("new.spam.com", 0), ("new.good.com", 1), ("", 0), ("single", None)]
    found = {r.host: r for r in url_filter.reputations(spark.createDataFrame(data, "host string, bad int")).collect()}
    assert found["bad1.spam.com"].blocked and not found["h1.good.com"].blocked
    assert found["new.spam.com"].mean > 0 and found["new.good.com"].mean < 1 and "single" not in found
    assert all(r.lower <= r.mean for r in found.values())


# BPE


@pytest.fixture(scope="session")
def engine():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (7, 3), (bpe.CHUNK, bpe.OVERLAP)])
def test_ids_are_the_librarys(spark, engine, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["a", "bc", " ", "  ", "\n", "1", "!", "'s", "é", "😀", "    \n", "word" * 3, "x" * 40, "\x1c", "\x85", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["a" * 3000, " " * 2000 + "b", "", None, "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    coded = bpe.encode(df, queries.vocabulary(), chunk=chunk, overlap=overlap)
    found = {r.doc_id: (bytes(r.ids), bytes(r.back)) for r in coded.select("*", bpe.decode(F.col("ids"), queries.vocabulary()).alias("back")).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        assert found[k] == (np.array(engine.encode_ordinary(text or ""), "<u4").tobytes(), (text or "").encode())


def test_bpe_of_odd_rows(odd, none):
    assert bpe.encode(odd, queries.vocabulary()).count() == len(ODD)
    assert bpe.encode(none, queries.vocabulary()).count() == 0


# Top-k


def test_top_k_against_brute_force(spark, none):
    rng = np.random.default_rng(0)
    vectors = [(i, (rng.normal(size=8) if i % 3 else np.ones(8) * 0.5 + (i % 2) / 64).tolist()) for i in range(400)]
    vectors += [(400, None), (420, []), (440, [1.0, None] + [0.0] * 6), (460, [float("nan")] * 8), (480, [float("inf")] * 8), (None, [1.0] * 8), (500, [2.0, 1.0])]
    # Rows that share the id, with the same vector and with others.
    vectors += [(20, vectors[20][1])] * 3 + [(20, vectors[21][1]), (40, vectors[20][1]), (21, vectors[20][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = defaultdict(list)
    for r in rows(topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block=32, chunk=8, pivots=5)):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = [(i, np.floor(64 * np.pad(np.array(v, np.float32), (0, 8 - len(v))).astype(float)).astype(int)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()]
    want = defaultdict(list)
    for at, (q, u) in enumerate(ints):
        if q % 20 == 0:
            best = sorted((-int(u @ v), i) for k, (i, v) in enumerate(ints) if k != at)[:20]
            want[q] += [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in want.items()}
    empty = none.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_few_candidates_and_huge_numbers(spark):
    df = spark.createDataFrame([(0, [1e30, 1e30]), (1, [1e30, -1e30]), (2, [1e30, 1e30])], "vec_id long, embedding array<double>")
    found = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found[0] == (2, (1 << 63) - 1) and found[1][0] == 1


# Training order


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        x = training_order.Permutation(n, "k")(np.arange(n))
        assert sorted(x) == list(range(n))
    assert (training_order.Permutation(1000, "k")(np.arange(1000)) != training_order.Permutation(1000, "l")(np.arange(1000))).any()


def ids_of(spark, data):
    packed = [(d, None if x is None else np.array(x, "<u4").tobytes()) for d, x in data]
    return spark.createDataFrame(packed, "doc_id long, ids binary").withColumn("slot", F.lit("x"))


def test_slots_are_those_of_the_sorted_documents(spark, tmp_path):
    rng = random.Random(13)
    data = [(k, [rng.randint(0, 50_000) for _ in range(rng.choice([0, 1, 63, 64, 65, 300]))]) for k in range(120)] + [(5, [1, 2])] * 2 + [(None, [7] * 70), (9, None), (200, list(range(20_000)))]
    df = ids_of(spark, data)
    sequences = []
    for d, x in sorted(((d, x) for d, x in data if x), key=lambda r: training_order.content_order(r[0], np.array(r[1], "<u4").tobytes())):
        sequences += [(d, k, x[k * 64 : k * 64 + 64]) for k in range(-(-len(x) // 64))]
    slots = training_order.Permutation(len(sequences), "k")(np.arange(len(sequences)))
    want = {int(slot): s for slot, s in zip(slots, sequences, strict=True)}
    for name, own in (("a", df), ("b", df.repartition(7))):
        manifest = training_order.materialise(own, "k", folder=str(tmp_path / name), length=64, shard_records=100, width=2)
        found = rows(training_order.read(manifest))
        assert {r["slot"]: (r["doc_id"], r["seq"], np.frombuffer(r["tokens"], "<u2").tolist()) for r in found} == want and len(found) == len(want)
        assert all(r["byte_offset"] == (r["slot"] - r["shard"] * 100) * (16 + 128) for r in found)
        rest = rows(training_order.read(manifest, 250))
        assert sorted(map(str, rest)) == sorted(str(r) for r in found if r["slot"] >= 250)
    assert training_order.materialise(ids_of(spark, [])).count() == 0
    with pytest.raises(Exception, match="too large"):
        training_order.materialise(ids_of(spark, [(1, [1 << 16])]), width=2)


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().endswith(".data"))


def test_shards_leave_no_shuffle_of_ids(spark, tmp_path):
    """op7 in round 3: ids lay in the encoder's and the shards' shuffles beside documents and shards."""
    rng = np.random.default_rng(7)
    texts = [(k, " ".join(map(str, rng.integers(0, 10**9, 12_000)))) for k in range(8)] + [(k, f"short {k}") for k in range(8, 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).localCheckpoint()
    coder = queries.vocabulary().load()
    raw = sum(len(coder.encode(t)) // 2 for _, t in texts)
    before = shuffle_bytes(spark)
    packed = bpe.encode(df, queries.vocabulary(), then=training_order.packing(width=2))
    # Short texts are encoded and packed by one worker, pieces of long ones are joined without Python.
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "ArrowEvalPython" not in plan
    manifest = training_order.materialise_packed(packed, folder=str(tmp_path / "s"), length=64, shard_records=100, width=2)
    assert shuffle_bytes(spark) - before < raw / 4
    ids = defaultdict(bytes)
    for r in sorted(rows(training_order.read(manifest)), key=lambda r: r["seq"]):
        ids[r["doc_id"]] += np.frombuffer(r["tokens"], "<u2").astype("<u4").tobytes()
    assert ids == {k: coder.encode(t) for k, t in texts}


def test_encoded_documents_read_back(spark, odd, tmp_path):
    coded = bpe.encode(odd, queries.vocabulary())
    found = rows(training_order.read(training_order.materialise(coded, folder=str(tmp_path / "s"), width=2)))
    texts = defaultdict(bytes)
    for r in sorted(found, key=lambda r: r["seq"]):
        if r["doc_id"] != 2:
            texts[r["doc_id"]] += np.frombuffer(r["tokens"], "<u2").astype("<u4").tobytes()
    coder = queries.vocabulary().load()
    assert {d: coder.decode(x).decode() for d, x in texts.items()} == {d: t for d, t, *_ in ODD if t and d != 2}


# Language ID


def test_suffix_automaton_knows_exactly_the_substrings():
    rng = random.Random(6)
    sample = bytes(rng.choice([0, 1, 2, 3]) for _ in range(60))
    goes = language_id.suffix_automaton(sample)

    def holds(word):
        state = 0
        for c in word:
            state = goes[state, c]
            if state < 0:
                return False
        return True

    for _ in range(500):
        word = bytes(rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        assert holds(word) == (word in sample)


def test_phrases_are_longest_matches():
    model = language_id.Model(("x",), "abc", (bytes([1, 2, 3, 1, 2]),))
    parser = language_id.Parser(model)
    text = np.array([1, 2, 3, 1, 2, 2, 3, 3], np.uint8)
    # 12312 | 23 | 3
    assert parser.phrases([text, text[:2], text[:0]]).tolist() == [[3, 1, 0]]


def test_predictions_against_brute_force(spark):
    """Each language's longest match, symbol by symbol, by searching its sample."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    tables = language_id.symbol_tables(model.letters)

    def phrases(text, sample):
        count, match = 1, b""
        for at, c in enumerate(text):
            if at and at % language_id.SEGMENT == 0:
                count, match = count + 1, b""
            longer = match + bytes([c])
            if longer in sample:
                match = longer
            else:
                count, match = count + 1, bytes([c]) if bytes([c]) in sample else b""
        return count

    found = {r["doc_id"]: r for r in rows(language_id.predict(docs, model))}
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        text = language_id.symbols(r.text, tables).tobytes()
        costs = [phrases(text, s) * np.log2(len(s) + 1.0) for s in model.samples]
        own = found[r.doc_id]
        assert own["lang_pred"] == model.languages[int(np.argmin(costs))]
        assert own["score"] == pytest.approx(1 / sum(np.exp(min(costs) - c) for c in costs))
        assert own["evidence"] == pytest.approx(6 * len(text) - min(costs))


def test_scripts_of_many_letters_are_told_apart(spark):
    rng = random.Random(14)
    scripts = {"zh": range(0x4E00, 0x4E00 + 1500), "ja": [*range(0x3041, 0x3097), *range(0x4E00, 0x4E00 + 1500, 3)], "ko": range(0xAC00, 0xAC00 + 1200), "ru": range(0x430, 0x450)}
    words = {n: ["".join(chr(rng.choice(list(r))) for _ in range(rng.randint(1, 4))) for _ in range(400)] for n, r in scripts.items()}
    said = lambda n, k: "，".join(rng.choice(words[n]) for _ in range(k))
    model = language_id.train(docs_of(spark, [(k * 10 + j, said(n, 300), n, "") for j, n in enumerate(words) for k in range(20)]), F.lit(True))
    asked = [(k, said(n, 40), "", n) for k, n in enumerate(list(words) * 10)]
    assert {r["doc_id"]: r["lang_pred"] for r in rows(language_id.predict(docs_of(spark, asked), model))} == {k: n for k, _, _, n in asked}


def test_automata_are_put_together_without_large_copies():
    rng = random.Random(21)
    model = language_id.Model(("x", "y", "z"), "abc", tuple(bytes(rng.randrange(30) for _ in range(5000)) for _ in range(3)))
    tracemalloc.start()
    parser = language_id.Parser(model)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tables = [language_id.suffix_automaton(s) for s in model.samples]
    for table, root in zip(tables, parser.roots[:, 0].tolist(), strict=True):
        own = parser.goes.reshape(-1, language_id.WIDTH)[root : root + len(table)]
        assert ((own >= 0) == (table >= 0)).all() and (own[table >= 0] == table[table >= 0] + root).all()
    assert most < 3.5 * parser.goes.nbytes


def test_languages_of_held_out_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out(F.col("doc_id"))).toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97 and found["score"].between(0, 1).all()
    model = language_id.train(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in rows(language_id.predict(odd, model))}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got and language_id.predict(odd, model).count() == len(ODD)
    assert language_id.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in rows(language_id.predict(odd, language_id.train(none)))} == {"und"}


def test_languages_of_long_texts_are_learnt(spark):
    rng = random.Random(12)
    words = {name: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for name, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "stuvwx"), ("dd", "mnopqr"))}
    said = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    # aa has only long texts, bb only one whose letters come last, cc only copies of a short text, dd nothing but short texts.
    data = [(k, said("aa", 8000), "aa", "") for k in range(4)] + [(10, "7 " * 30_000 + said("bb", 2000), "bb", "")]
    data += [(20, said("cc", 40), "cc", "")] * 2000 + [(100 + k, said("dd", 5), "dd", "") for k in range(2000)]
    docs = docs_of(spark, data)
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ("aa", "bb", "cc", "dd") and max(map(len, model.samples)) <= language_id.SAMPLE_CHARS
    assert [len(s) > 5000 for s in model.samples] == [True, True, False, True]
    found = language_id.predict(docs_of(spark, [(k, said(name, 50), "", "") for k, name in enumerate(words)]), model)
    assert {r["doc_id"]: r["lang_pred"] for r in rows(found)} == dict(enumerate(words))
    assert language_id.train(docs_of(spark, data[:4]), F.lit(True)).languages == ("aa",)


# Toxicity


@pytest.fixture(scope="session")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def test_held_out_toxic_documents(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxic_model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert (found["predicted"] == found["toxic"]).mean() > 0.93 and found["score"].between(0, 1).all()


SAID = ["you are an idiot and a stupid clown said the other man on the hill in the morning", "read the book you fool"]


@pytest.fixture(scope="session")
def restorer(spark):
    counts = toxicity.trigram_counts(docs_of(spark, [(i, SAID[i % 2], "en", "a") for i in range(60)])).toPandas()
    total = np.zeros(toxicity.WIDTH**3, np.int64)
    total[counts["gram"]] = counts["count"]
    return toxicity.Restorer(toxicity.language_model(total))


def test_disguised_words_are_restored(restorer):
    for disguise, word in (
        ("1d10t", "idiot"), ("st00pid", "stupid"), ("b00k", "book"), ("f00l", "fool"), ("st.u.p.i.d", "stupid"), ("st-upid", "stupid"), ("id-iot", "idiot"), ("st upid", "stupid"), ("stuupid", "stupid"),
        ("iddiot", "idiot"), ("i d i o t", "idiot"), ("s t u p i d", "stupid"), ("$tup1d", "stupid"), ("cloooown", "clown"), ("cl0wn", "clown"), ("ST0OPID", "stoopid"), ("i.d.1.o.t", "idiot"),
    ):
        if word in SAID[0] + SAID[1]:
            assert restorer.text(disguise) == word, disguise
            assert restorer.text(f"you are an {disguise}!! and") == f"you are an {word}!! and"
    assert restorer.text("You 1d10t, st00pid st.u.p.i.d cl0wn!!") == "you idiot, stupid stupid clown!!"
    assert restorer.text("tion$$$ and%%% HEING,!! plain") == "tion$$$ and%%% heing,!! plain"
    assert restorer.texts(["", "1d10t", "", "the other man", "st00pid"]) == ["", "idiot", "", "the other man", "stupid"]


def test_disguises_of_common_words_are_mostly_restored(spark, toxic_model):
    """Drawn-out letters, signs and separators put into the frequent words of a corpus."""
    rng = random.Random(15)
    restorer = toxicity._restorer(toxic_model.costs, toxic_model.counts)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("text").limit(300).collect()]
    common = sorted(set(re.findall(r"(?<!\\S)[a-z]{5,9}(?!\\S)", " ".join(texts))))
    signs = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
    right, tried = 0, 0
    for word in rng.sample(common, 300):
        at = rng.randrange(1, len(word) - 1)
        for own in (word[:at] + word[at] * 3 + word[at:][1:], word[:at] + signs.get(word[at], word[at]) + word[at + 1 :], word[:at] + "." + word[at:]):
            right += restorer.text(own) == word
            tried += 1
    assert right > 0.7 * tried


def test_clean_text_stays_as_it_is(spark, toxic_model):
    """Contractions, doubled letters, hyphens; and of the tokens of all documents without a toxic label at least 99.5 in a hundred."""
    words = "you are can't and we go they don't know it's free too see bee worthless dummy well-known coffee book kill l'homme d'accord".split()
    counts = toxic_model.counts | dict.fromkeys(words, 50)
    restorer = toxicity._restorer(toxic_model.costs, counts)
    for text in ("you are can't and", "we can't go and they don't know it's free", "see the bee too", "worthless dummy, well-known (coffee) book!", "l'homme d'accord", "a rock'n'roll free-for-all"):
        assert restorer.text(text) == text
    assert restorer.text("b00k k1ll") == "book kill" and restorer.text("fr33") == "free" and restorer.text("w0rthless") == "worthless"
    restorer = toxicity._restorer(toxic_model.costs, toxic_model.counts)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    same, changed = 0, Counter()
    for r in docs.join(labels.filter("toxic = 0"), "doc_id").select("text").collect():
        before, after = (r.text or "").lower().split(), restorer.text(r.text or "").split()
        gone = Counter(before) - Counter(after)
        changed += gone
        same += len(before) - sum(gone.values())
    assert same > 0.995 * (same + sum(changed.values())), changed.most_common(30)


def test_most_frequent_words(spark):
    """By count, then word, however many words share a count; without words there are none."""
    texts = ["It's it's, (it's) b b b c c c c d d e 1d10t", "", None, "f g h well-known 'b'"]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    counts = Counter(w.strip("'(),") for t in texts for w in (t or "").lower().split() if "1" not in w)
    want = sorted(counts.items(), key=lambda e: (-e[1], e[0]))
    for most in (1, 3, 5, 100):
        assert [tuple(r) for r in toxicity.word_counts(docs, most=most).collect()] == want[:most]
    assert toxicity.word_counts(docs.filter("text = ''")).count() == 0


def test_memory_is_bounded_for_long_tokens(restorer):
    import tracemalloc

    text = "1d10t" * 40_000 + "x" * 200_000
    tracemalloc.start()
    found = restorer.text(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "idiotidiot" in found and peak < 100 * len(text)


def test_segments_are_read_as_the_whole_lattice_is(restorer):
    """Cutting at places with one reading changes nothing: one search over the whole text finds the same."""
    rng = random.Random(16)
    for _ in range(60):
        text = "".join(rng.choice(["idiot", "1d1ot", "the", " ", " ", "st", "upid", "00", "o", "book", "-", "."]) for _ in range(8)).strip()
        begin, end = restorer.segments(toxicity.codes(text))
        columns, done = [], 0
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            columns += [[(c, 0.0)] for c in text[done:b]] + list(toxicity.lattice(text[b:e], False))
            done = e
        columns += [[(c, 0.0)] for c in text[done:]]
        assert restorer.texts([text])[0] == toxicity.viterbi(columns, restorer.model, restorer.symbol) or restorer.spaced(toxicity.codes(text)).size


def test_scores_against_brute_force(spark, toxic_model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r["score"] for r in rows(toxicity.score(docs, toxic_model))}
    restorer = toxicity._restorer(toxic_model.costs, toxic_model.counts)
    for r in docs.collect():
        words = "".join(c if c.isalpha() else " " for c in restorer.text(r.text or "")).split()
        counts = defaultdict(int)
        for word in words:
            for name in [word + "$", *(word[:n] for n in (4, 5, 6) if len(word) > n)]:
                counts[xxhash.xxh32_intdigest(name) >> 10] += 1
        z = toxic_model.bias + toxic_model.length_weight * np.log(1 + len(words)) + sum(toxic_model.weights[toxic_model.index[f]] * np.log(1 + n) for f, n in counts.items() if f in toxic_model.index)
        assert found[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)


def test_viterbi_finds_the_cheapest_path():
    rng = np.random.default_rng(1)
    model = rng.random((64, 64, 64)).astype(np.float32)
    symbol = {c: k + 1 for k, c in enumerate(toxicity.LETTERS)}
    columns = [[("a", 0.1), ("b", 0.4)], [("", 0.3), ("cc", 0.2)], [("d", 0.0), ("e", 0.5), (" ", 0.1)], [("a", 0.2), ("", 0.0)]]

    def cost(path):
        state, total = (0, 0), sum(c for _, c in path)
        for letter in "".join(e for e, _ in path):
            z = 0 if letter == " " else symbol[letter]
            total += model[state[0], state[1], z]
            state = state[1], z
        return total + model[state[0], state[1], 0]

    from itertools import product

    best = min(product(*columns), key=cost)
    assert toxicity.viterbi(columns, model, symbol) == "".join(e for e, _ in best)


def test_toxicity_of_odd_rows(spark, odd, none, toxic_model):
    found = rows(toxicity.score(odd, toxic_model))
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(none, toxic_model).count() == 0
    unfit = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in rows(toxicity.score(odd, unfit))} == {0.0}


# Chat


def test_examples_read_back(spark, none):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", "back\\slash \\| <\\| <"), (1, 3, "assistant", None), (1, 4, "user", "tail"),
        (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, None, "first"), (None, 5, "odd\nrole\\n", "🙂<|"), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    made = chat.examples(df)
    want = defaultdict(list)
    for c, t, role, text in turns:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    got = defaultdict(list)
    for r in rows(made.withColumn("turns", chat.read_back(F.col("formatted")))):
        got[r["conv_id"]].append(r)
    for c, said_of in want.items():
        said_of = [(role, text) for _, _, role, text in sorted(said_of)]
        own = sorted(got[c], key=lambda r: r["example"])
        assert [tuple(t) for t in own[-1]["turns"]] == said_of
        spans = [r["formatted"][r["loss_start"] : r["loss_end"]] for r in own if r["loss_start"] is not None]
        assert [s.replace("\\\\", "\1").replace("\\|", "|").replace("\1", "\\") for s in spans] == [t for role, t in said_of if role == "assistant"]
        for r in own[:-1]:
            assert own[-1]["formatted"].startswith(r["formatted"])
    empty = none.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")
    assert chat.examples(empty).count() == 0


# Collocations

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(pairs, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in pairs:
        for part in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            words = re.findall(r"[^\x20\x09]+", part)
            total[lang or "und"] += len(words)
            for size in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        often = [p for p in f if len(p) > 1 and f[p] >= least]
        around = defaultdict(int)
        for p in often:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], f[p])
        found = []
        for p in often:
            if around[p] < f[p]:
                score, k = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def test_collocations_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(11)
    words = ["A", "b", "émile", "new", "York", "city", "x" * 300, "d."]
    said = [(rng.choice(["en", None, "de"]), " ".join(rng.choices(words, weights=[9, 7, 2, 3, 3, 3, 1, 1], k=rng.randint(0, 60))).replace("b A", rng.choice(["b\tA", "b\nA"]))) for _ in range(120)]
    said += [("en", None), ("en", ""), (None, "new york city " * 40), ("en", "of the of the of the of")]
    df = docs_of(spark, [(k, text, lang, "s") for k, (lang, text) in enumerate(said)])
    for chunk in (collocations.CHUNK_WORDS, 50):
        monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
        found = collocations.collocations(df, least=5, top=40)
        assert sorted(map(tuple, found.collect())) == brute_collocations(said, 5, 40)
    assert sorted(map(tuple, collocations.collocations(odd).collect())) == brute_collocations([(r[2], r[1]) for r in ODD], 100, 2000)
    assert collocations.collocations(none).count() == 0


def test_stripes_are_small_and_leave_no_shuffle(spark):
    """op11 in round 3: stripes of words took several times the input, and stayed. Stripes of rare and of common words."""
    rng = random.Random(3)
    words, weights = ["de", "en", *(f"word{k}" for k in range(298))], [1 / (k + 1) for k in range(300)]
    said = [(rng.choice(["en", "de"]), " ".join(rng.choices(words, weights, k=1000)) + rng.choice(["", ".", " a"])) for _ in range(120)]
    df = docs_of(spark, [(k, text, lang, "s") for k, (lang, text) in enumerate(said)]).repartition(6).localCheckpoint()
    before = shuffle_bytes(spark)
    _, levels = collocations.frequent_phrases(df, 5)
    assert len(levels) == 5 and shuffle_bytes(spark) - before < sum(len(t) for _, t in said) / 10
    assert sorted(map(tuple, collocations.collocations(df, 5, top=300).collect())) == brute_collocations(said, 5, 300)


# Spelling variants


def brute_variants(said, least=3, length=5):
    n = Counter()
    for doc_id, text in said:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    near = {w: set() for w in n}
    for a, b in combinations(sorted(n, key=len), 2):
        cut = [b[:k] + b[k + 1 :] for k in range(len(b))]
        if a in cut if len(a) + 1 == len(b) else len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def test_variants_against_brute_force(spark, odd, none):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ba" * 20, "ab" * 16, "c" * 31, "c" * 32, "c" * 33, "é" * 500, "é" * 250 + "a" + "é" * 249]
    def damaged(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé×") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]])
    said = [(rng.choice([k, None]), " ".join(damaged(w) for w in rng.choices(base, k=80)).replace("a", rng.choice("aA"), 3)) for k in range(80)] + [(1, None), (2, ""), (3, "1234 жжжжж"), (3, "1234 жжжжж")]
    df = docs_of(spark, [(d, text, "en", "s") for d, text in said])
    found = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df).collect())
    assert found == brute_variants(said) and sum(1 for r in found if r[4]) > 50
    assert [r.word for r in spelling.variants(odd).collect()] == [r[0] for r in brute_variants([r[:2] for r in ODD])]
    assert spelling.variants(none).count() == 0


# Language-model scores


def brute_base(said):
    c, out = Counter(), []
    tokens = lambda text: re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWERED)) + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    for d, text in said:
        if not held(d):
            c.update(tokens(text))
    n, v = sum(c.values()), len(c)
    for d, text in said:
        t = tokens(text)
        out.append((d is None, d or 0, len(t), sum(x in c for x in t), n, round(sum(float(np.log10((c[x] + 1) / (n + v + 1))) for x in t), 5)))
    return sorted(out)


def base_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect())


def test_base_scores_and_passes(spark, odd, none, monkeypatch):
    said = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(d, t) for d, t, *_ in ODD]
    df = docs_of(spark, [(d, t, "en", "s") for d, t in said])
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 100_000)
    for order in (2, 3):
        model = lm_scoring.train(df, order)
        once = lm_scoring.score(df, model)
        assert base_rows(once) == brute_base(said)
        assert len(model.runs(150_000)) > 2
        text = lambda x: sorted(str((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))) for r in x.collect())
        assert text(lm_scoring.score(df, model, most=150_000)) == text(once)
        held = [r for r in once.withColumn("held", lm_scoring.held_out(F.col("doc_id"))).collect() if r.held]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score(none, lm_scoring.train(none)).count() == 0
    unlearnt = lm_scoring.score(odd, lm_scoring.train(none)).collect()
    assert {r.doc_id for r in unlearnt} == {r[0] for r in ODD} and all(r.train_tokens == 0 and r.score == r.base_score == 0 for r in unlearnt)


def test_filter_keeps_levels_and_probabilities_sum_to_one_at_most(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(30)]
    said = [" ".join(rng.choices(words, weights=range(1, 31), k=200)) for _ in range(60)]
    model = lm_scoring.train(docs_of(spark, [(7 * k, t, "en", "s") for k, t in enumerate(said)]))
    held = model.gathered(0, model.parts)
    counts = Counter()
    for k, t in enumerate(said):
        if zlib.crc32(str(7 * k).encode()) % 7 != 2:
            t = ["begin", *t.split(), "end"]
            counts.update(zip(t, t[1:], strict=False))
    hash_of = {w: xxhash.xxh64_intdigest(w.encode()) for w in words} | {"begin": lm_scoring.BEGIN, "end": lm_scoring.END}
    names = [*words, "end"]
    for context in ("begin", "w29", "w3"):
        pairs = np.array([x for w in names for x in (hash_of[context], hash_of[w])], np.uint64)
        (_, _), (two, there) = lm_scoring.ngrams(pairs, np.arange(len(pairs)) % 2, 2)
        level = lm_scoring.levels_of(two[there], held)
        want = [int(np.searchsorted(lm_scoring.LEVELS, counts[context, w], side="right")) for w in names]
        assert all(level >= want) and sum(a != b for a, b in zip(level, want, strict=True)) <= 3
        upper = lm_scoring.UPPER[lm_scoring.levels_of(np.array([hash_of[context]], np.uint64), held)[0]]
        assert lm_scoring.LOWER[want].sum() <= upper


# The queries and the pipeline


def test_queries_cover_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    text = lambda df: sorted(map(str, df[sorted(df.columns)].round(6).astype(object).itertuples(index=False, name=None)))
    assert sorted(found.columns) == sorted(want.columns) and text(found) == text(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op12_spelling_variants"}))
def test_query_answers_for_every_document(spark, name):
    """Without SQL the operators are tested by brute force above; the queries are whole and repeat themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()["doc_id"].tolist()
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert set(found["doc_id"]) == set(docs) and ("slot" in found or sorted(found["doc_id"]) == sorted(docs))
    again = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(map(str, found.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


def test_language_stage_of_odd_rows(spark, odd, none):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(17)
    letters = "etaoinshr"
    base = [(100 + k, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(200)), "en", "a") for k in range(30)]
    noise = "".join(chr(rng.randint(0x400, 0x2FFF)) for _ in range(4000))
    df = docs_of(spark, base + [(1, None, "en", "a"), (None, base[0][1], None, "a"), (2, "", None, "a"), (3, "eta", None, "a"), (4, noise, "en", "a"), (5, base[1][1] * 100, None, None)]).withColumn("found", F.lit("own"))
    kept = corpus_pipeline.keep_known_languages(spark, df, SF)
    assert kept.columns == df.columns
    got = {r.doc_id: (r.lang, r.found) for r in kept.collect()}
    assert set(got) == {d for d, *_ in base} | {None, 3, 5} and set(got.values()) == {("en", "own")}
    assert corpus_pipeline.keep_known_languages(spark, none, SF).count() == 0


def test_language_stage_judges_a_text_once(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = corpus_pipeline.keep_known_languages(spark, odd, SF)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= corpus_pipeline.TEXTS_AT_ONCE


def test_pipeline_stages_keep_whole_rows(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [docs.limit(1).withColumn("text", F.lit(t)).withColumn("lang", F.lit(None).cast("string")) for t in ("123 !!", "Ωψ ξζ жщ фы ъэ юя " * 20)]
    known = corpus_pipeline.keep_known_languages(spark, docs.unionByName(junk[0]).unionByName(junk[1]), SF)
    assert known.columns == docs.columns and known.count() == docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == ["doc_id", "n_tokens", "ids"] and whole.count() > 0
    exact = corpus_pipeline.drop_exact_copies(spark, known, SF)
    assert exact.count() == docs.select("text").distinct().count()
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, exact, SF).collect()}
    mixed = {r.doc_id for r in whole.select("doc_id").distinct().collect()}
    assert mixed <= near
