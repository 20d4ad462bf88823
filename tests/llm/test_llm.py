"""The training-data operators: brute force, round trips and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from siteloom.llm import bpe, chat, fingerprint, jaccard, langid, license, lm, packing, quality, queries, urlfilter

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "one", "en", "s", 3),
    (5, "one", "en", "s", 3),
    (5, "one", "en", "s", 3),
    (None, "a null id with some words of its own", "en", "s", 1),
    (6, "word " * 30_000, "en", "s", 150_000),
    (7, "x" * 60_000, "de", "s", 60_000),
    (8, "é字🙂 mixed\x85text here <|endoftext|>", "fr", "s", 1),
]


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns with clashing names."""
    extra = ("key", "size", "block", "words", "kind", "rep")
    return spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit("x") for n in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# packing -------------------------------------------------------------------
def check_packed(rows, expected):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)  # special tokens' strings are those tokens
    sequences = {}
    found = Counter()
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        found[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    by_doc = {}
    for key, n in found.items():
        by_doc.setdefault(key[0], []).append((key, n))
    ids = {}
    for d, t in expected:
        ids.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        whole = ids[d][0]
        spans = []
        for (_, start, length, crc, total), n in pieces:
            assert total == len(whole) and n == len(ids[d])
            assert zlib.crc32(np.array(whole[start : start + length], "<u4").tobytes()) == crc
            spans.append((start, length))
        spans.sort()
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans]).tolist()][:-1] and sum(n for _, n in spans) == len(whole)
    return sequences


def test_packing(docs, texts):
    rows = packing.pack(docs, JSON).collect()
    sequences = check_packed(rows, texts)
    total = sum(r["length"] for r in rows)
    padding = sum(own[0]["padded_length"] - sum(r["length"] for r in own) for own in sequences.values())
    assert padding < 0.03 * total


def test_packing_odd(odd, empty):
    check_packed(packing.pack(odd, JSON).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack(empty, JSON).count() == 0


def test_differencing_is_near_equal():
    sizes = [(i * 7919) % 511 + 1 for i in range(300)]
    lots = packing.pack_block(sizes, 2048)
    sums = [sum(sizes[i] for i in lot) for lot in lots]
    assert sorted(i for lot in lots for i in lot) == list(range(300))
    assert max(sums) <= 2048 and max(sums) - min(sums) < 64
    assert packing.pack_block([2048, 2048, 1], 2048).__len__() == 3


# chat ------------------------------------------------------------------------
def test_chat_states(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, None, None), (4, 0, "us\ner%0A", "<|x <\\| \\<|"), (None, 1, "user", "q")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: r["valid"] for r in made.collect()} == {1: True, 2: False, 3: False, 4: False, None: False}
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in back[4]["turns"]] == [("us\ner%0A", "<|x <\\| \\<|")]
    assert back[1]["learned"] == "b"
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in made.collect())
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(nothing)).count() == 0


def test_chat_is_native(spark):
    plan = queries.op2_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# fingerprints ----------------------------------------------------------------
def test_fingerprint_neighbours(docs, texts):
    rows = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs).collect()}
    assert len(rows) == len(texts)
    for k, (d, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[d]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.fingerprint(t) and r["edited_fingerprint"] == fingerprint.fingerprint(edited)
    long = [r for r in rows.values() if r["n_chars"] > 1000]
    assert np.median([r["near_edited"] for r in long]) > np.percentile([r["near_next"] for r in long], 75) + 0.1


def test_entropy_by_counting():
    data = np.frombuffer(("the quick brown fox " * 9 + "aaaa" * 20).encode(), np.uint8)
    got = fingerprint.window_entropies(data)
    for i in range(len(got)):
        counts = Counter(data[i : i + fingerprint.WINDOW].tolist()).values()
        h = -sum(c / fingerprint.WINDOW * math.log2(c / fingerprint.WINDOW) for c in counts)
        assert abs(got[i] - h / math.log2(fingerprint.WINDOW) * 1000) <= 1


def test_fingerprint_odd(odd, empty):
    assert fingerprint.compare_neighbours(odd).count() == len(ODD)
    assert fingerprint.compare_neighbours(empty).count() == 0
    same = fingerprint.Prepared("some words that are said")
    assert fingerprint.likeness(same.chain, same.chain) == 1.0
    assert fingerprint.likeness(same.chain, fingerprint.Prepared("").chain) == 0.0


# quality -----------------------------------------------------------------------
def test_quality_counts():
    n, chars, symbols, dup, repeats, failed, removed, kept, clean = quality.judge_text("a b c d e a b c d e x\nq q\nq q\n#1 $", quality.Rules())
    assert (n, symbols, dup, repeats, failed) == (17, 2, 1, 10, True)
    assert quality.judge_text(None, quality.Rules())[5]


def test_quality_keeps_columns(odd, empty):
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert quality.keep(empty).count() == 0
    assert quality.judge(odd).count() == len(ODD)


# bpe ---------------------------------------------------------------------------
def test_bpe_as_the_library(texts):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in [t for _, t in texts] + [r[1] or "" for r in ODD] + ["  a  b\n\n c", "\x1c!a\x1c", "it's 5'll½", "ab" * 3000]:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(997)]
    made = bpe.PerfectHash(keys)
    assert sorted(made.find(k) for k in keys) == list(range(997)) and made.find(b"other") == -1


def test_bpe_odd(odd, empty):
    rows = bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(bytes(r["decoded"]).decode() for r in rows) == Counter(r[1] or "" for r in ODD)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# languages ------------------------------------------------------------------------
def test_language_held_out(docs):
    model = langid.Identifier(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = model.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd(docs, odd, empty):
    model = langid.Identifier(docs)
    rows = model.identify(odd).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert model.identify(empty).count() == 0 and model.spans(odd).count() > 0
    assert model.keep(odd).columns == odd.columns
    assert {r["lang_pred"] for r in langid.Identifier(empty).identify(odd).collect()} == {"und"}


def test_language_without_spaces(spark):
    """Lines without a space are read to their end, in training too."""
    rng = np.random.default_rng(8)
    line = lambda first, n: "".join(chr(first + int(x)) for x in rng.integers(0, 40, n))
    rows = [(i, line(0x4E00, 40) + line(a, 200), lang) for i, (a, lang) in enumerate([(0x5000, "p"), (0x6000, "q")] * 30)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(made)
    assert [f[0] for f in model.judge([line(0x5000, 40) + line(0x6000, 400), line(0x6000, 40) + line(0x5000, 400)])] == ["q", "p"]
    word = ("a" + line(0x5000, 500)).encode()
    whole, parts = langid.word_grams([word]), langid.word_grams(langid.words_of(word.decode()))
    assert Counter(whole[0].tolist()) == Counter(parts[0].tolist())
    at = model.places([langid.words_of(word.decode())])[0]
    assert model.letters[at].sum() == 501


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        scores = rng.normal(0, 10, (6, 3))
        best = max(np.ndindex(*(3,) * 6), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 12 * sum(a != b for a, b in zip(p, p[1:])))
        assert langid.viterbi(scores).tolist() == list(best)


# urls --------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = [
        (1, "https://www.Example.com/en/1"), (2, "http://a.example.com/en/2?x"), (3, "https://x.com/de"), (4, "ftp://b.net/es/#f"),
        (5, "https://net/fr/x"), (6, None), (7, "no host"), (8, "https://example.com"), (9, "https://q.org/en/"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rows = {r["page_id"]: r for r in urlfilter.judge(pages, queries.URL_RULES).collect()}
    assert [rows[i]["rule"] for i in range(1, 10)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None, None, None, None]
    assert (rows[1]["host"], rows[1]["path"], rows[1]["verdict"]) == ("www.example.com", "/en/1", "allow")
    assert (rows[6]["host"], rows[6]["path"]) == ("", "") and all(r["verdict"] in ("allow", "block") for r in rows.values())
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_trees_learn(spark):
    labelled = spark.createDataFrame([(f"https://site{i}.org/{'9' * 12 if i % 2 else 'a/b'}", i % 2) for i in range(400)], "url string, block int")
    pages = spark.createDataFrame([(1, "https://siteA.org/999999999999"), (2, "https://siteB.org/a/b")], "page_id long, url string")
    rows = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, [], labelled).collect()}
    assert rows == {1: "block", 2: "allow"}


# licences ------------------------------------------------------------------------------
def test_license_lines(spark, docs, odd, empty):
    model = license.train(docs)
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary",
        "the license of the driver was taken": "unknown", "plain prose here": "unknown", "": "unknown",
    }
    assert {x: model.classify(x)[0] for x in lines} == lines
    assert license.scan(odd, model).count() == len(ODD) and license.scan(empty, license.train(empty)).count() == 0


# language model -----------------------------------------------------------------------
def test_lm_base_by_counting(docs, texts):
    rows = {r["doc_id"]: r for r in lm.score(docs, ~lm.held_out(F.col("doc_id")), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for d, t in texts}
    counts = Counter(w for d, ws in split.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in split.items():
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = rows[d]
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["n_known"] == sum(counts.get(w, 0) > 0 for w in ws)
        assert (r["n_tokens"], r["train_tokens"]) == (len(ws), n) and r["score"] < 0


def test_lm_counts_pieces_once(spark):
    """Scores don't depend on the number of tasks, and long words are learned from."""
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")

    def scores(rows, tasks):
        made = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
        return {r["doc_id"]: r["score"] for r in lm.score(made, F.col("doc_id") > 0, vocabulary).collect()}

    rows = [(i, "wonderful mornings everywhere") for i in range(40)] + [(40, "Türen öffnen")]
    one, many = scores(rows, 1), scores(rows, 8)
    assert one.keys() == many.keys() and all(one[d] == pytest.approx(many[d], rel=1e-9) for d in one)
    near, far = (scores([(0, "wonderfulwonderful"), (1, part * 1800)], 1)[0] for part in ("wonderful", "zqzqzqzqz"))
    assert near > far


def test_lattice_by_brute_force():
    made = lm.Lattice.__new__(lm.Lattice)
    made.logs = {p: math.log(q) for p, q in {"▁": 0.2, "▁a": 0.1, "a": 0.2, "ab": 0.1, "b": 0.3, "▁ab": 0.05}.items()}
    made.bytes, made.longest = {b: math.log(0.001) for b in range(256)}, 3

    def total(text):
        return 1.0 if not text else sum(math.exp(p) * total(text[len(k) :]) for k, p in made.logs.items() if text.startswith(k))

    for w in ("a", "ab", "abab", "bba"):
        assert made.word(w) == pytest.approx(math.log(total("▁" + w)))
    assert made.word("é") < made.word("a")


def test_lm_odd(odd, empty):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    assert lm.score(odd, F.lit(True), vocabulary).count() == len(ODD)
    assert all(math.isfinite(r["score"]) for r in lm.score(odd, F.lit(False), vocabulary).collect())
    assert lm.score(empty, F.lit(True), vocabulary).count() == 0


# near duplicates ------------------------------------------------------------------------
def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = jaccard.lower_ascii(t or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    union = jaccard.Union()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                union.join(j, i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(union.find(i), []).append(d)
    return {
        (d, len(sets[i]), d if not sets[i] else min((x for x in groups[union.find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)
    }


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard_by_brute_force(spark, texts, n, percent, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = list(texts)
    for k in range(25):  # near copies at and about the limit, of short and long texts
        own = rng.choice(words, 40 if k % 2 else 2000).tolist()
        for c in range(4):
            copy = list(own)
            for at in rng.choice(len(own), int(len(own) * c * 0.012) + c, replace=False):
                copy[at] = "z" + copy[at]
            rows.append((10_000 + 10 * k + c, " ".join(copy)))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in jaccard.near_duplicates(made, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_jaccard_large_clusters(spark, monkeypatch):
    """Blocks of large clusters, joined by samples and by leftovers."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = []
    base = [f"w{i}" for i in range(60)]
    for k in range(60):
        own = list(base)
        for at in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            own[at] = f"x{at}{k % 7}"
        rows.append((k, " ".join(own)))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {tuple(r) for r in jaccard.near_duplicates(made, 3, 80).collect()} == brute(rows, 3, 80)


def test_jaccard_common_gram(spark):
    """More sets than a block, many met in several tasks, that meet at one n-gram only."""
    base = " ".join(f"b{i}" for i in range(92))
    rows = [(i, base + "".join(f" y{i}_{k}" for k in range(10))) for i in range(1, 5001)]
    rows += [(10_000 + i, t) for i, t in rows[::5]] + [(0, base)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = jaccard.near_duplicates(made, 3, 90).groupBy("n_shingles", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(90, 0, 1), (100, 0, 6000)}


def test_jaccard_odd(odd, empty):
    rows = jaccard.near_duplicates(odd, 5, 80).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_first(empty).count() == 0


# pipeline ---------------------------------------------------------------------------------
def test_pipeline_by_brute_force(spark, docs, texts, tmp_path):
    import corpus_pipeline

    now = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, SF)
        made.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now)
    by = dict(texts)
    kept = {d for d, t in texts if quality.judge_text(t, quality.Rules())[7]}
    assert {r["doc_id"] for r in seen[0].collect()} == kept
    known = {r["doc_id"] for r in seen[1].collect()}
    assert known <= kept and len(known) >= 0.98 * len(kept)
    left = [(d, by[d]) for d in sorted(known)]
    assert {r["doc_id"] for r in seen[2].collect()} == {d for d, _, c in brute(left, 5, 80) if d == c}
    check_packed(seen[3].collect(), [(r["doc_id"], r["text"]) for r in seen[2].collect()])
    assert all(s.columns == docs.columns for s in seen[:3])


# sql ------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in made.description].index(c) for c in names]
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in made.fetchall())
