import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grove.llm import bpe, packing, token_counts, token_store
from grove.llm.tokens import RankEncoder, WordEncoder

PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "b", "don't", "it's", "É", "é", "1", "23", "...", "İ", "Σ", "日本", "😀", "​", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|", '"', "᠎", "﻿", "X", "́", "'s", "word.", "Straße,", "ﬁ"]


@pytest.fixture(scope="module")
def texts(sf_docs):
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [r[0] or "" for r in sf_docs.select("text").collect()] + made + ["", "x" * 3000, "ab" * 900, " " * 500]


@pytest.mark.parametrize("kind, name", [(RankEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_ids_are_the_librarys(texts, kind, name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for text, own, want in zip(texts, kind(public_tokenizers.path(name)).encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own, "<u4").tolist() == want.ids, text


def test_matrix_bpe_is_tiktoken_and_decodes(texts):
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    own = bpe.Bpe(path, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for text, (n, ids, raw) in zip(texts, own.digests(texts), strict=True):
        expected = want.encode_ordinary(text)
        assert ids == ",".join(map(str, expected)) and n == len(expected) and raw == text.encode()
    assert own.encode("some text") == want.encode_ordinary("some text")
    assert own.decode(own.encode("some é text")) == "some é text".encode()
    for raw in (b"ab" * 300, b"hello world" * 60, bytes(range(97, 123)) * 20):  # matrix and heap agree
        assert own.merge_matrix([raw])[0] == own.merge_long(raw)


def test_pair_table_knows_each_pair():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    pairs = bpe.PairTable(ranks)
    some = [(t[:k], t[k:]) for t in list(ranks)[300:3000] for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right = (np.array([ranks[p[i]] for p in some], np.int32) for i in (0, 1))
    assert pairs.look_up(left, right).tolist() == [ranks[a + b] for a, b in some]
    assert pairs.look_up(np.array([50255], np.int32), np.array([50255], np.int32)).tolist() == [-1]


def test_op8_rows(spark, odd_docs, no_docs, as_tables):
    import hashlib

    found = bpe.op8_byte_bpe(spark, as_tables(documents=odd_docs)).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(found) == 9
    for r in found:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.n_tokens for r in found if r.doc_id in (2, 3)} == {0}
    assert bpe.op8_byte_bpe(spark, as_tables(documents=no_docs)).count() == 0
    assert [r.ids for r in bpe.encoded(odd_docs.where("doc_id = 2")).collect()] == [[]]


def lengths_of(rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]


def test_histogram_against_brute_force(spark, sf_docs, no_docs, odd_docs):
    lengths = [len(x) for x in lengths_of(sf_docs.collect())]
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(sf_docs)).cache()
    count = Counter(lengths)
    rows = {r.length: r for r in histogram.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == dict(count)
    for k, r in rows.items():
        assert r.tokens == k * count[k] and r.docs_at_least == sum(x >= k for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= k) and r.truncated_tokens == sum(min(x, k) for x in lengths)
        assert r.share_at_most == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    half = token_counts.quantile(histogram, 0.5).first().length
    assert half == sorted(lengths)[-(-len(lengths) // 2) - 1]
    limits = {r["limit"]: r for r in token_counts.at_limits(histogram, [0, 100, 2048, 10**7]).collect()}
    for k in limits:
        assert limits[k].truncated_tokens == sum(min(x, k) for x in lengths) and limits[k].docs_over == sum(x > k for x in lengths)
    some = token_counts.at_limits(histogram, [lengths[0], lengths[0], max(lengths), -1])
    for r in some.collect():
        assert r.truncated_tokens == sum(min(x, r["limit"]) for x in lengths) and r.docs_over == sum(x > r["limit"] for x in lengths)
    assert some.count() == 3 and "NestedLoop" not in some._jdf.queryExecution().toString()
    empty = token_counts.length_histogram(token_counts.encoded_lengths(no_docs))
    assert [tuple(r) for r in token_counts.at_limits(empty, [5]).collect()] == [(5, 0, 0)]
    assert token_counts.length_histogram(token_counts.encoded_lengths(no_docs)).count() == 0
    odd = token_counts.length_histogram(token_counts.encoded_lengths(odd_docs)).where("length = 0").first()
    assert odd.n_docs == 2


def check_packing(docs, rows, context=packing.CONTEXT):
    ids = {}
    for r, own in zip(docs, lengths_of(docs), strict=True):
        ids.setdefault(r.doc_id, []).append([*own, packing.END])
    pieces, where = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        where.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(x) for own in ids.values() for x in own)
    for doc, own in ids.items():
        want = sorted((s, len(x[s : s + context]), zlib.crc32(np.array(x[s : s + context], "<u4").tobytes()), len(x)) for x in own for s in range(0, len(x), context))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc]) == want
    assert sorted(where) == list(range(len(where)))
    for own in where.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= context
    return sum(r.length for r in rows) / (context * len(where)) if where else 1


def test_packing(spark, sf_docs, odd_docs, no_docs):
    assert check_packing(sf_docs.collect(), packing.pack(sf_docs).collect()) > 0.97
    check_packing(odd_docs.collect(), packing.pack(odd_docs).collect())
    assert packing.pack(no_docs).count() == 0
    old, packing.RANKED_ROWS = packing.RANKED_ROWS, 3  # many buckets of ranks
    try:
        many = sf_docs.select("doc_id", "text").unionByName(spark.range(1000, 1400).selectExpr("id doc_id", "'the same text' text"))
        check_packing(many.collect(), packing.pack(many).collect())
    finally:
        packing.RANKED_ROWS = old


def test_sequences_hold_the_ids(sf_docs):
    placed = packing.place(packing.cut(packing.pieces(sf_docs, with_ids=True)))
    lengths = {r.sequence_id: r.n for r in placed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    got = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(placed).collect()}
    assert got == lengths


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    for _ in range(200):
        context = rng.choice([7, 16, 64])
        histogram = {rng.randint(1, context): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        placed = Counter()
        for pattern, packs in packing.shortest_pack_first(histogram, context):
            assert packs > 0 and sum(length * k for length, k in pattern) <= context
            for length, k in pattern:
                placed[length] += k * packs
        assert placed == Counter(histogram)
    with pytest.raises(ValueError):
        packing.shortest_pack_first({9: 1}, 8)


def test_shortest_pack_first_copy_by_copy():
    def totals(histogram, context):
        packs = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                room = [k for k, total in enumerate(packs) if total + length <= context]
                if room:
                    packs[min(room, key=lambda k: packs[k])] += length
                else:
                    packs.append(length)
        return sorted(packs)

    rng = random.Random(16)
    assert packing.shortest_pack_first({1100: 2, 400: 2}) == [(((1100, 1), (400, 1)), 2)]
    for _ in range(500):
        context = rng.choice([7, 16, 64])
        histogram = {rng.randint(1, context): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        found = packing.shortest_pack_first(histogram, context)
        assert sorted(sum(length * k for length, k in pattern) for pattern, packs in found for _ in range(packs)) == totals(histogram, context)


def test_added_tokens_are_the_librarys(spark):
    hard = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|endoftext|>" * 3, "x<|endoftext|", "<|ENDOFTEXT|>", "é<|endoftext|>\n<|startoftext|> 's"]
    docs = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for kind, name in ((RankEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = [e.ids for e in library.encode_batch(hard, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in kind(public_tokenizers.path(name)).encode(hard)] == want
    check_packing(docs.collect(), packing.pack(docs).collect())


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 100, 5000):
        keys = token_store.keys_of(rng.choice(10**9, n, replace=False).tolist(), [0] * n)
        index = token_store.PerfectHash.load(token_store.PerfectHash.of(keys).dump())
        assert sorted(index.slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        token_store.PerfectHash.of(np.array([1, 1], np.uint64))


def stored(docs):
    library = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    rows = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, out = 0, []
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, token_store.END]
        out.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("range_docs, shard_docs", [(4096, 4096), (7, 3), (1, 4096)])
def test_token_store(spark, sf_docs, odd_docs, no_docs, tmp_path, monkeypatch, range_docs, shard_docs):
    monkeypatch.setattr(token_store, "RANGE_DOCS", range_docs)
    monkeypatch.setattr(token_store, "SHARD_DOCS", shard_docs)
    for k, docs in enumerate((sf_docs, odd_docs, no_docs)):
        path = f"{tmp_path}/{k}"
        token_store.write(docs, path)
        found = [tuple(r) for r in token_store.read(spark, path).collect()]
        assert sorted(found, key=lambda r: r[1]) == stored(docs.collect())
    for doc in [*range(0, 200, 37), None]:  # one shard of one file, whatever the store holds
        k = 1 if doc is None else 0
        assert token_store.shard_of(spark, f"{tmp_path}/{k}", doc).count() == 1 and len(token_store.shard_of(spark, f"{tmp_path}/{k}", doc).inputFiles()) == 1
        start, length = next((a, n) for d, a, n, _ in stored((sf_docs, odd_docs)[k].collect()) if d == doc)
        assert len(token_store.get(spark, f"{tmp_path}/{k}", doc)) == length
    assert token_store.shard_of(spark, f"{tmp_path}/2", 1).count() == 0
    assert token_store.get(spark, f"{tmp_path}/1", 1, 1).tolist() == token_store.get(spark, f"{tmp_path}/1", 1).tolist()
    assert token_store.get(spark, f"{tmp_path}/1", 1, 2) is None and token_store.get(spark, f"{tmp_path}/0", 10**6) is None
