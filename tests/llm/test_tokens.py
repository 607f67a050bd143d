"""Byte-pair encoding against the library, counts against a plain sum, packing against a plain best fit."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paydrift.llm import bpe, lengths, packing

from .data import documents, none, odd, rows_of, texts

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_and_decoding_equal_the_library(spark):
    for frame, rows in ((odd(spark), texts()), (documents(spark), rows_of("documents", "doc_id, text"))):
        found = bpe.decode(bpe.encode(frame)).select("doc_id", "n_tokens", "ids", "decoded").collect()
        want = sorted((str(d), library(t), t or "") for d, t in rows)
        assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in found) == want
        assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in found)
    assert bpe.decode(bpe.encode(none(spark))).count() == 0


def test_random_strings_of_all_scripts():
    own, rng = bpe.Encoder(bpe.read_model(bpe.tokenizer_path())), random.Random(1)
    pools = ["abc  \n\t'sdm", "éñ中文　\xa0\x1c\x85​", "0123²½Ⅳ٣", "\U0001f600\U0001f3fd‍́", "!?*#$--==  ", "they'll I'm we've 're", "<|endoftext|>"]
    for _ in range(1500):
        s = "".join(rng.choice([rng.choice(p), p, chr(rng.randrange(32, 0x3000))]) for p in rng.choices(pools, k=rng.randrange(20)))
        ids = own.encode_batch([s])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library(s), repr(s)
        assert own.decode(ids) == LIBRARY.decode(library(s), skip_special_tokens=False)


def test_lengths_and_limits(spark):
    rows = [len(library(t)) for _, t in texts()]
    hist = lengths.histogram(odd(spark))
    sums = lengths.suffix_sums(hist)
    found = {r["n_tokens"]: r for r in sums.collect()}
    assert sorted(found) == sorted(set(rows))
    for n, r in found.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == (rows.count(n), sum(x >= n for x in rows), sum(x for x in rows if x >= n), sum(min(x, n) for x in rows))
    cut = {r["context"]: (r["tokens"], r["docs_cut"]) for r in lengths.truncated(sums, [1, 64, 1 << 30]).collect()}
    assert cut == {c: (sum(min(x, c) for x in rows), sum(x > c for x in rows)) for c in (1, 64, 1 << 30)}
    half = lengths.quantiles(sums, [0.5, 1.0]).collect()
    assert {r["share"]: r["n_tokens"] for r in half} == {0.5: sorted(rows)[(len(rows) + 1) // 2 - 1], 1.0: max(rows)}
    assert lengths.suffix_sums(lengths.histogram(none(spark))).count() == 0


def test_best_fit_decreasing_leaves_the_rooms_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        context = rng.choice([1, 2, 7, 16, 100, 2048])
        sizes = [rng.randint(1, context) for _ in range(rng.randrange(120))]
        rooms = []
        for n in sorted(sizes, reverse=True):
            fits = [r for r in range(len(rooms)) if rooms[r] >= n]
            if fits:
                rooms[min(fits, key=lambda r: rooms[r])] -= n
            else:
                rooms.append(context - n)
        rows = packing.best_fit(sizes, context)
        assert sorted(context - sum(sizes[p] for p in r) for r in rows) == sorted(rooms)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))


def test_packed_rows_give_every_document_back(spark):
    for context, block in ((64, 500), (2048, packing.BLOCK_TOKENS)):
        coded = packing.token_ids(odd(spark).select("doc_id", "text"))
        rows = packing.pack(coded, context, 7, block).collect()
        parts = {}
        for r in rows:
            ids, at, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
            assert len(ids) == context and cu[-1] == r["n_tokens"] <= context and all(ids[cu[-1]:] == 7)
            for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:]):
                assert at[a:b].tolist() == list(range(b - a))
                parts.setdefault(d, []).append((s, ids[a:b].tolist()))
        want = {}
        for r in coded.collect():
            want.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
        assert {d: sorted(x for _, p in v for x in p) for d, v in parts.items()} == {d: sorted(v) for d, v in want.items() if v}
        for d in (7, 13):
            assert [x for _, p in sorted(parts[d]) for x in p] == want[d]
        assert len({r["pack_id"] for r in rows}) == len(rows)
    assert packing.pack(packing.token_ids(none(spark).select("doc_id", "text"))).count() == 0
