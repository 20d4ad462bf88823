"""Piece encoding against its library, alignment against a direct version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from siteloom.llm import align, piece, queries

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts() -> list[str]:
    rng = random.Random(3)
    plain = list("abcdetin  ▁\n\t.,<>=-_/ér字🙂ACGT0123")
    wide = [(1, 0x2FF), (0x3000, 0x30FF), (0x4E00, 0x4F00), (0x1F300, 0x1F400)]
    made = ["".join(rng.choices(plain, k=rng.randint(1, 60))) for _ in range(400)]
    made += ["".join(rng.choices("etaoins ", k=rng.randint(1, 300))) for _ in range(100)]
    made += ["".join(chr(rng.randint(*rng.choice(wide))) for _ in range(rng.randint(1, 80))) for _ in range(100)]
    made += ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁ b", "▁▁a ▁b", "<s> </s> <unk> <0x0A> <|endoftext|>", "x\x00y"]
    made += [" " * n + "x" for n in (13, 14, 15, 16, 17, 31, 33, 70, 5000)] + [" " * n for n in (15, 16, 17, 100, 4001)]
    made += ["ﬁＡ", "=" * 300, "a" * 1000, "ab" * 500, "�", "word " * 1000, "\U0010ffff ́", "ACGT" * 400, "end.\n\n\nnew line.\r\n"]
    made += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLM0123456789", k=20_000))]
    return made


# pieces ----------------------------------------------------------------------
def test_pieces_equal_the_library():
    own, library = piece.Encoder(MODEL), SentencePieceProcessor(model_file=MODEL)
    for text in odd_texts():
        ids = library.encode(text)
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == library.decode(ids), text[:80]


def test_a_small_memory_changes_nothing():
    own, library = piece.Encoder(MODEL, remember=20, longest=4), SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    for k in range(0, len(texts), 7):
        for group in piece.groups(own, texts[k : k + 7]):
            for words, text in zip(group, texts[k : k + 7], strict=True):
                assert np.frombuffer(b"".join(own.young[w][0] for w in words), "<u4").tolist() == library.encode(text)
    assert max(map(len, own.young)) <= 64


def test_bytes_that_are_no_text():
    own, library = piece.Encoder(MODEL), SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(195, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(1, 9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_one_merge_at_a_time():
    """A pair that arises with a lower rank goes before what is left of the old rank."""
    own = piece.Encoder(MODEL)
    v = own.vocabulary
    number = {"a": 5, "b": 6, "ab": 7, "aba": 8}
    v.symbol_of[[ord("a"), ord("b")]] = [5, 6]
    pairs = {(5, 6): (3, 7), (7, 5): (1, 8)}  # aba comes before ab
    keys = sorted((x * v.n_symbols + y, *found) for (x, y), found in pairs.items())
    v.keys, v.ranks, v.merged = (np.append(c, e) for c, e in zip(map(np.array, zip(*keys, strict=True)), (piece.NONE, piece.NONE, -1), strict=True))
    assert own.merge(["abab", "ababab", "bab"]) == [[number["aba"], 6], [8, 6, 7], [6, 7]]


def digests(rows):
    return {r.doc_id: r for r in rows}


def check_pieces(rows, texts):
    library = SentencePieceProcessor(model_file=MODEL)
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "")
        r = digests(rows)[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_piece_query(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.op13_piece_bpe(spark, SF).collect(), texts)


def test_piece_odd_rows(spark):
    rows = list(enumerate([None, "", *odd_texts()]))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    check_pieces(piece.encode_digests(docs, MODEL).collect(), rows)
    full = piece.encode(docs, MODEL).where("doc_id = 5").first()
    assert np.frombuffer(full.ids, "<u4").tolist() == SentencePieceProcessor(model_file=MODEL).encode(rows[5][1])
    assert full.decoded == rows[5][1].replace("▁", " ")
    assert piece.encode_digests(docs.limit(0), MODEL).count() == 0


# alignment -------------------------------------------------------------------
def directly(rows):
    """The contract, step by step with the libraries and sets of bytes."""
    a_side, b_side = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=MODEL)
    a_side.encode_special_tokens = True
    from siteloom.llm.packing import byte_alphabet

    alphabet, count, made = byte_alphabet(), Counter(), []
    for _, text in rows:
        said = f" {text or ''}"
        a = a_side.encode(said, add_special_tokens=False).ids
        b = b_side.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([i - 3]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != said.encode() or b"".join(b_bytes) != said.encode():
            made.append((0, 0, [], ""))
            continue
        a_of = [k for k, x in enumerate(a_bytes) for _ in x]
        b_of = [k for k, x in enumerate(b_bytes) for _ in x]
        links = sorted(set(zip(a_of, b_of, strict=True)))
        out, i, j = [], 0, 0
        while i < len(a):
            p, q = i + 1, j + 1
            while (x := sum(map(len, a_bytes[:p]))) != (y := sum(map(len, b_bytes[:q]))):
                p, q = (p + 1, q) if x < y else (p, q + 1)
            out.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            i, j = p, q
        pairs = [(a[x], b[y]) for x, y in links]
        count.update(pairs)
        made.append((len(a), len(b), pairs, ";".join(out)))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for (doc_id, _), (n_a, n_b, pairs, out) in zip(rows, made, strict=True):
        sha = hashlib.sha256(out.encode()).hexdigest() if out else ""
        yield (
            doc_id, n_a, n_b, out.count(";") + bool(out), len(pairs),
            sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), sha,
        )


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def odd_docs():
    rows = [(i, t) for i, t in enumerate([None, "", *odd_texts()]) if len(t or "") < 3000]
    return [*rows, *rows[20:60], (None, "no id here"), (None, "no id here"), (7, "twice the id")]


@pytest.mark.parametrize("options", [{}, {"radices": 3, "frame": 5, "fan_in": 2, "block_links": 300}])
def test_alignment_directly(spark, odd_docs, options):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd_docs], DOCS).selectExpr("*", "1 AS block", "2 AS radix", "'x' AS sums")
    assert ordered(align.align(docs.repartition(3), JSON, MODEL, **options).collect()) == ordered(directly(odd_docs))


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows_short = [r for r in rows if len(r[1] or "") < 6000]
    found = queries.op12_token_alignment(spark, SF).collect()
    assert len(found) == len(rows)
    docs = spark.createDataFrame(rows_short, "doc_id long, text string")
    assert ordered(align.align(docs, JSON, MODEL).collect()) == ordered(directly(rows_short))
    encoder = SentencePieceProcessor(model_file=MODEL)
    assert {r.doc_id: r.n_b for r in found} == {i: len(encoder.encode(t or "")) for i, t in rows}


def test_pair_counts_and_groups(spark):
    rows = [(1, "one two three"), (2, "one two"), (3, "zwölf")]
    made = align.Alignment(spark.createDataFrame(rows, "doc_id long, text string"), JSON, MODEL, radices=5, frame=2)
    pairs = {(r.a, r.b): (r["count"], r.best) for r in made.pair_counts().collect()}
    links = {r[0]: r[4] for r in directly(rows)}
    assert sum(n for n, _ in pairs.values()) == sum(links.values())
    for _, b in pairs:
        top = max(n for (_, y), (n, _) in pairs.items() if y == b)
        assert all(best == (n == top) for (_, y), (n, best) in pairs.items() if y == b)
    out = {r.doc_id: r.groups for r in align.groups(spark.createDataFrame(rows, "doc_id long, text string"), JSON, MODEL).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in out.items()} == {r[0]: r[-1] for r in directly(rows)}


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert align.align(empty, JSON, MODEL).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordered(align.align(none, JSON, MODEL).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_block_bounds():
    """A block ends at its links; its frames hold at most ``frame`` pairs, in rising order."""
    made, block = align.Aligner(JSON, MODEL), None
    texts = ["some words that repeat and repeat " * 5] * 40
    block = align.Block(made)
    for k, found in enumerate(made.texts(texts)):
        block.add(k, *found)
    parts = list(block.parts(0, 4, 3))[1:]
    for p in parts:
        codes, _ = align.unpack_pairs(p["first"], p["pairs"])
        assert 0 < len(codes) <= 3 and (np.diff(codes) > 0).all()
    assert block.full(block.links) and not block.full(block.links + 1)
