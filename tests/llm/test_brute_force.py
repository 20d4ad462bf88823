"""Operators against plain re-statements of their definitions, and at limits."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from siteloom.llm import chat, fingerprint, jaccard, langid, license, lm, packing, queries, urlfilter
from siteloom.llm.common import sample_limit

from .test_llm import brute

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("n", [1, 4000, 4001, 10**6, 5 * 10**9, 10**11, 10**15])
def test_sample_limit_never_becomes_none(n):
    kept = (sample_limit(4000, n) + (1 << 63) + 1) / (1 << 64) * n
    assert kept == pytest.approx(min(n, 4000), rel=1e-3)


def test_hot_rows_enter_a_sample_once(spark):
    rows = [(7, "der die das und ein " * 5, "de")] * 500 + [(i, f"the and of to {i} in", "en") for i in range(50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert model.languages == ["de", "en"]
    assert [f[0] for f in model.judge(["die und das", "of the in"])] == ["de", "en"]


# packing
def test_ids_are_those_of_the_tokenizer():
    """For every code point, alone, in a word, and among white space."""
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}1  {c}." for c in points[k : k + 4000]) for k in range(0, len(points), 4000)]
    texts += ["x" * 30_000, " " * 30_000 + "y", "it's <|endoftext|> we'll\n\n\tgo", ""]
    for t in texts:
        assert encoder.encode(t) == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_are_a_parameter(spark):
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "a <|endoftext|> b"
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert packing.encoder(path, True).encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [packing.pack(docs, path, text_only=t).first()["doc_tokens"] for t in (False, True)] == [5, len(plain.encode(text).ids) + 1]


# chat
def test_chat_repeats_and_other_columns(spark):
    rows = [(1, 0, "user", "q", "x"), (1, 0, "user", "q", "y"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "a", "x")]
    made = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))).first()
    assert [tuple(t) for t in made["turns"]] == [("user", "q"), ("user", "q"), ("assistant", "a"), ("assistant", "b")]
    assert made["learned"] == "ab" and made["valid"] is False


# fingerprints
def plain_fingerprint(text):
    """Features by counting bytes, windows by loops, filters as sets of bits."""
    data, size = text.encode(), fingerprint.WINDOW
    windows = [data[i : i + size] for i in range(len(data) - size + 1)]
    ranks = []
    for w in windows:
        h = -sum(c / size * math.log2(c / size) for c in Counter(w).values())
        e = min(1000, round(h / math.log2(size) * 1000))
        ranks.append(2000 if e < fingerprint.VOID else 1000 - abs(e - fingerprint.ORDINARY))
    votes = Counter(min(range(i, i + size), key=lambda k: (ranks[k], k)) for i in range(len(windows) - size + 1))
    places = sorted(k for k, v in votes.items() if v >= fingerprint.POPULARITY and ranks[k] < 2000)
    features = list(dict.fromkeys(windows[k] for k in places))
    mask, chain = (1 << 64) - 1, []
    for k, w in enumerate(features):
        h = 0x9E3779B97F4A7C15
        for part in (w[:8], w[8:]):
            h = (h ^ int.from_bytes(part, "little")) * 0xBF58476D1CE4E5B9 & mask
            h ^= h >> 29
        h = h * 0x94D049BB133111EB & mask
        h ^= h >> 32
        if k % fingerprint.FILTER_FEATURES == 0:
            chain.append(set())
        chain[-1] |= {h >> 11 * j & (fingerprint.FILTER_BITS - 1) for j in range(fingerprint.FILTER_HASHES)}
    return chain


def plain_likeness(a, b):
    a, b = sorted((a, b), key=len)
    best = []
    for x in a:
        shares = []
        for y in b:
            least, chance = min(len(x), len(y)), len(x) * len(y) / fingerprint.FILTER_BITS
            floor = chance + 0.1 * (least - chance)
            shares.append(min(1.0, max(0.0, (len(x & y) - floor) / max(least - floor, 1e-6))))
        best.append(max(shares))
    return sum(best) / len(best)


def test_fingerprints_by_brute_force(texts, monkeypatch):
    monkeypatch.setattr(fingerprint, "AT_ONCE", 500)  # chunks of a text agree with the whole
    monkeypatch.setattr(fingerprint, "FILTERS_AT_ONCE", 2)
    some = [t for _, t in texts if t and 200 < len(t.encode()) < 20_000][:12] + ["prose " * 30 + "a" * 400 + "fox jumps over lazy dogs. " * 40]
    made = [fingerprint.Prepared(t) for t in some]
    plain = [plain_fingerprint(t) for t in some]
    for m, p in zip(made, plain, strict=True):
        assert [set(np.flatnonzero(row).tolist()) for row in m.chain] == p
        assert (fingerprint.chain_of(m.name) == m.chain).all()
    for i, j in itertools.combinations(range(len(some)), 2):
        assert fingerprint.likeness(made[i].chain, made[j].chain) == pytest.approx(plain_likeness(plain[i], plain[j]), abs=1e-5)


def test_frequent_ids_are_cut_as_well(spark):
    """A third of the rows without an id, a third of one id: no range holds either whole."""
    ids = [None if i % 3 == 0 else 500 if i % 3 == 1 else i for i in range(900)]
    docs = spark.createDataFrame([(d, f"text number {i} says {i * i}") for i, d in enumerate(ids)], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    dealt, pieces = fingerprint._pieces(rows, 12)
    sizes = [r["count"] for r in dealt.groupBy("piece").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 200 and len(sizes) <= pieces
    got = fingerprint.compare_neighbours(docs, pieces=12).collect()
    order = sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    want = Counter()
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, n = r["text"], len(r["text"])
        want[(r["doc_id"], hashlib.sha256((t[: n - n // 2] + after["text"][: n // 2]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


@pytest.mark.parametrize("first", [1 << 62, -(1 << 62), (1 << 63) - 301, -(1 << 63) + 1, -150])
def test_neighbours_by_large_ids(spark, first):
    """Ids that fall on one double, at the ends of their range, and of both signs."""
    rows = [(first + i, f"text number {i} says {i * i} or so") for i in range(300)]
    got = fingerprint.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), pieces=10).collect()
    want = {}
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        want[d] = hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want


# languages
def test_spans_of_mixed_texts(spark):
    """Halves of two languages in one text: nearly all words get their half's language."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL AND length(text) > 400").fetchall()
    by = {}
    for d, t, lang in rows:
        by.setdefault(lang, []).append(t)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.Identifier(docs.where(~langid.held_out(F.col("doc_id"))))
    hits = words = 0
    for a, b in itertools.permutations(sorted(by), 2):
        first, second = " ".join(by[a][0].split()[:60]), " ".join(by[b][1].split()[:60])
        mixed = spark.createDataFrame([(1, f"{first} {second}")], "doc_id long, text string")
        cut = len(first.split())
        for s in model.spans(mixed).collect():
            for w in range(s["first_word"], s["first_word"] + s["n_words"]):
                hits += s["lang"] == (a if w < cut else b)
                words += 1
    assert hits >= 0.9 * words


# urls
def test_url_rules_as_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", F.lit("x").alias("host"), F.lit(1).alias("rate"), F.lit(2).alias("said"))
    pages = pages.union(pages)  # repeated rows, and columns of the operator's own names
    rows = urlfilter.judge(pages, queries.URL_RULES).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW u AS SELECT page_id, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM '{SF}/pages.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT page_id, host, path, {urlfilter.rules_sql(queries.URL_RULES)} FROM u").fetchall()}
    said = {rule: what for what, rule in queries.URL_RULES}
    assert len(rows) == 2 * len(want)
    for r in rows:
        assert (r["page_id"], r["host"], r["path"], r["rule"]) == want[r["page_id"]]
        assert r["verdict"] == said[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")


def test_undecided_urls_by_held_out_hosts(spark):
    """Trees that never saw a host tell its spam from the rest; a suffix with one verdict isn't all that counts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host = urlfilter.host_of(F.col("url"))
    name = F.regexp_extract(host, r"([^.]+)\.[^.]+\.[^.]+$", 1)
    fold = F.pmod(F.xxhash64(name), F.lit(3)) == 0
    spam = host.rlike("|".join(urlfilter.SPAM_WORDS)).cast("int")
    learned = pages.where(~fold).select("url", spam.alias("block"))
    asked = pages.where(fold).withColumn("want", F.when(spam == 1, "block").otherwise("allow"))
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(asked, [], learned).collect()}
    want = {r["page_id"]: r["want"] for r in asked.collect()}
    right = {v: np.mean([got[k] == v for k in want if want[k] == v]) for v in set(want.values())}
    assert right["allow"] >= 0.9 and right.get("block", 1.0) >= 0.8, right
    shares = urlfilter.judge(pages, queries.URL_RULES).where("rule is null and host like '%.example.net'").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in shares} == {"allow", "block"} or shares[0]["verdict"] == "allow"


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "https://" + "é" * 40_000 + ".net/x"), (4, "https://a.net/" + "9" * 100_000 + "?" + "a=1&" * 5000)]
    made = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()
    assert len(made) == 4 and {r["verdict"] for r in made} <= {"allow", "block"}


# licences
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""


@pytest.fixture(scope="module")
def scanner(spark):
    return license.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licences_known_and_unknown(scanner):
    known = {
        "Eclipse Public License - v 2.0": "epl", "Boost Software License - Version 1.0": "boost", "SPDX-License-Identifier: Apache-2.0": "apache",
        MIT.split("\n")[1]: "mit", MIT.split("\n")[2]: "mit", MIT: "mit", "Released under the ISC License": "isc",
        "You should have received a copy of the GNU General Public License along with this program.": "gpl",
    }
    assert {x: scanner.classify(x)[0] for x in known} == known
    unknown = [
        "Licensed under the EUPL, Version 1.2", "Your rights under the warranty are limited", "Released under the Ruby License",
        "Licensed under the Open Data Commons Open Database License v1.0", "The GNU project began in 1983", "the MIT campus is large", "",
    ]
    assert {scanner.classify(x)[0] for x in unknown} == {"unknown"}


def test_licence_paragraphs(scanner):
    text = f"Plain prose first.\n{MIT}\nmore prose\n\nmore\nAll rights reserved.\n\nLicensed under CC BY 4.0.\nReleased under the MIT License."
    assert [(a, f) for a, f, _, _ in scanner.scan(text)] == [(1, "mit"), (7, "proprietary"), (9, "cc"), (10, "mit")]


def test_licences_by_brute_force(spark, scanner, texts):
    """The query's rows, and every planted statement found where a plain search finds it."""
    plain = {
        "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in license.scan(docs, scanner).collect()}
    for d, t in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
        want = [(i, plain[x.strip()]) for i, x in enumerate((t or "").split("\n")) if x.strip() in plain]
        assert list(zip(rows[d]["first_lines"], rows[d]["families"], strict=True)) == want


# language model
def test_score_by_all_segmentations(spark):
    """log10 P as the sum over every way to cut a text's words and its end."""
    rows = [(i, "a cab at noon") for i in range(30)] + [(30, "cab é")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") < 30
    got = {r["doc_id"]: r["score"] for r in lm.score(made, learn, VOCABULARY).collect()}
    sp, vocabulary = lm._processor(VOCABULARY), lm.Vocabulary(VOCABULARY)
    counts = np.zeros(vocabulary.n, np.int64)
    for w in "a cab at noon".split():
        for i in sp.encode(w):
            counts[i] += 30
    chance = 0.5 * np.exp(lm.Link(vocabulary, counts).logs) + 0.5 * counts / counts.sum()
    end = 31 / (counts.sum() + 32)
    p = {vocabulary.names[i]: chance[i] * (1 - end) for i in range(vocabulary.n) if vocabulary.usable[i]}

    def total(text):
        if not text:
            return 1.0
        ways = sum(p[text[:k]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in p)
        return ways if text[0] in p else ways + math.prod(p[f"<0x{b:02X}>"] for b in text[0].encode()) * total(text[1:])

    for d, t in ((0, "a cab at noon"), (30, "cab é")):
        assert got[d] == pytest.approx(math.log10(end * math.prod(total("▁" + w) for w in t.split())), rel=1e-9)
    alone = {r["doc_id"]: r["score"] for r in lm.score(made, learn, VOCABULARY, share=1.0).collect()}
    assert alone[0] < got[0]


def test_blocks_bound_what_a_task_holds(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    learn = ~lm.held_out(F.col("doc_id"))
    whole = {r["doc_id"]: tuple(r) for r in lm.score(docs, learn, VOCABULARY).collect()}
    block = lm.Block()
    for d, t in texts[:20]:
        block.add(d, True, t or "")
    assert len(block.texts) == 20 and sum(b.num_rows for b in block.rows(1)) == 20 + len(block.number)
    monkeypatch.setattr(lm, "BLOCK_DISTINCT", 50)
    small = list(lm._split(iter([docs.select("doc_id", learn, "text").toArrow().to_batches()[0]])))
    assert len({b for batch in small for b in batch.column(0).to_pylist()}) > 5
    assert len(whole) == len(texts)


# near duplicates
@pytest.mark.parametrize("size", [50, 300, 1000])
def test_trees_prune_sets_that_share_nothing(size):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(512)]
    width = max(1 << (2 * size - 1).bit_length(), 1024)
    tree = jaccard.SignatureTree(np.array([len(s) for s in sets]), np.array([jaccard.bitmap(s, width) for s in sets]), np.arange(512))
    tally = Counter()
    assert list(jaccard.tree_pairs(tree, tree, 90, tally)) == []
    assert tally["pruned"] > 0 and tally["judged"] < 0.5 * 512 * 511 / 2


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(20, 400, 40)]
    sets = []
    for b in base:
        for k in range(5):
            sets.append(np.unique(np.concatenate([b[: len(b) - k * len(b) // 30], rng.integers(0, 1 << 63, k, dtype=np.uint64)])))
    groups = np.arange(len(sets)) // 2
    tree = jaccard.SignatureTree(np.array([len(s) for s in sets]), np.array([jaccard.bitmap(s) for s in sets]), groups)
    found = set(jaccard.tree_pairs(tree, tree, 80))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if groups[i] != groups[j] and jaccard.linked(sets[i], sets[j], 80):
            assert (i, j) in found


def test_blocks_by_ngrams_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 400)
    monkeypatch.setattr(jaccard, "CROWD", 5)
    monkeypatch.setattr(jaccard, "LONG", 40)
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(80)], []
    for k in range(70):
        own = list(base)
        for at in rng.choice(80, int(rng.integers(0, 11)), replace=False):
            own[at] = f"x{at}{k % 5}"
        rows.append((k, " ".join(own[: int(rng.integers(66, 81))])))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard.near_duplicates(made, 3, 80).collect()} == brute(rows, 3, 80)


def near_copies(n, words=120):
    """Texts that differ in two or three words of one text, so they share nearly all n-grams."""
    rng, base = np.random.default_rng(2), [f"w{i}" for i in range(words)]
    for k in range(n):
        own = list(base)
        for at in rng.choice(words, int(rng.integers(1, 4)), replace=False):
            own[at] = f"x{k}_{at}"
        yield k, " ".join(own)


def test_blocks_are_bounded_whatever_sets_share(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    shingles = jaccard.Shingler(5)
    sets = [(k, 1, h.size, int(h[0] >> np.uint64(1)), True, 9) for k, h in ((k, shingles(t)) for k, t in near_copies(1500))]
    sized = spark.createDataFrame(sets, "key long, cluster long, size long, least long, large boolean, class int").repartition(5)
    blocks = jaccard._blocks(sized).groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    assert sum(b["n"] for b in blocks) == 1500 and max(b["n"] for b in blocks) <= 100 and len(blocks) <= 16
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 1000)
    blocks = jaccard._blocks(sized).groupBy("block").agg(F.sum("size").alias("s")).collect()
    assert max(b["s"] for b in blocks) <= 1000 + max(s[2] for s in sets)


def test_near_copies_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    rows = list(near_copies(220))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {tuple(r) for r in jaccard.near_duplicates(made, 5, 80).collect()} == brute(rows, 5, 80)


def test_frequent_ngrams_give_few_edges(spark, monkeypatch):
    """Edges grow with the sets of an n-gram, not with the pairs of its lists."""
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    per_set = []
    for n in (500, 2000):
        sets = [(1, k, k, 100 + k % 30, 100 + k % 30, np.packbits(np.arange(1024) % 7 == k % 7).tobytes()) for k in range(n)]
        rows = spark.createDataFrame(sets, "gram long, local long, key long, size int, reach int, bits binary")
        edges = jaccard._frequent(rows, 80)
        assert edges.groupBy().agg(F.max("need")).first()[0] == 1
        per_set.append(edges.count() / n)
        roots = {r["root"] for r in jaccard.components(edges.select("a", "b")).collect()}
        assert len(roots) == 1
    assert max(per_set) <= 3 and per_set[1] <= 1.05 * per_set[0]


def test_keep_first_leaves_clashing_columns_alone(spark):
    rows = [(1, "a b c d e f g", "mine1", 5), (2, "other words that stand here now", "mine2", 6), (3, "a b c d e f g", "mine3", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string, MARK int")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:2]


def test_keep_first_by_row(spark):
    """An id with two texts: only the near copy goes."""
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t), (7, t), (7, u), (7, u), (None, u), (9, ""), (9, "")]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, t), (7, u), (9, ""), (9, "")])


def test_language_stage_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.collect()
    want = [r["doc_id"] for r, f in zip(rows, model.judge([r["text"] for r in rows]), strict=True) if f[0] != "und" and f[1] >= 0.3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == sorted(want)


def test_license_training_reads_every_line(spark, texts):
    """The n-grams of templates of all ordinary lines, by counting; a long line is several rows."""
    model, words = license.Classifier(), "redistribution of mit sources " * 120
    rows = [*texts, (10**6, words), (10**6 + 1, "plain\nAll rights reserved.\n\nfree of charge")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter()
    for _, text in rows:
        for line in (text or "").split("\n"):
            if line.strip() and not re.search("licen|copyright|rights|permission|warrant", line.lower()):
                own = license.words_of(line)
                for part in [own[i : i + 200] for i in range(0, len(own), 200)] or [[]]:
                    want[zlib.crc32(line.encode()) % 5 == 4, tuple(sorted(model.number[g] for g in license.grams_of(part) if g in model.number))] += 1
    got = {(r["rest"], tuple(r["places"])): r["n"] for r in license.ordinary_lines(made, model).collect()}
    assert got == want and sum(want.values()) > len(rows)
