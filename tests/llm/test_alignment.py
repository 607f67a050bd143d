"""Token alignment against a plain alignment of two lists of token bytes."""

import collections
import hashlib
import random

import numpy as np

import __spark_entry__ as entry
from paydrift.llm import token_alignment as alignment
from paydrift.llm.bpe import byte_letters, read_model, tokenizer_path

from .data import none, odd, rows_of, texts


def tokens(text, a, b):
    """(id, bytes) of A and B, with the libraries' own pieces."""
    letters = byte_letters()
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return one, two


def brute(rows):
    import sentencepiece
    import tokenizers
    a = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out, count = [], collections.Counter()
    for doc_id, text in rows:
        one, two = tokens(text, a, b) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(x for _, x in one) != raw or b"".join(x for _, x in two) != raw:
            one, two = [], []
        groups, links, i, j, mine, other, at = [], [], 0, 0, [], [], [0, 0]
        while i < len(one) or j < len(two):
            if at[0] <= at[1]:
                at[0] += len(one[i][1])
                mine.append(one[i][0])
                i += 1
            else:
                at[1] += len(two[j][1])
                other.append(two[j][0])
                j += 1
            if at[0] == at[1]:
                groups.append((mine, other))
                links.append((mine[-1], other[-1]))
                mine, other = [], []
        count.update(links)
        out.append((doc_id, len(one), len(two), groups, links))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    rows = []
    for doc_id, n_a, n_b, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((str(doc_id), n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), text))
    return sorted(rows)


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def found(frame, **how):
    return sorted((str(r["doc_id"]), *(r[c] for c in NAMES)) for r in alignment.alignment(frame, **how).collect())


def test_alignment_equals_brute_force(spark):
    rows = texts() + [(30, "<|endoftext|> <s> </s> <unk> <0x0A>"), (31, "a\x00b"), (32, "ﬁ ＡＢ"), (33, "▁ x"), (34, "\n\n\ttab  "), (35, "😀 mixed 12345 x"), (36, "�")]
    frame = odd(spark).select("doc_id", "text").union(spark.createDataFrame(rows[len(texts()):], "doc_id long, text string"))
    want = brute(rows)
    assert found(frame) == want and any(r[1] == 0 for r in want if r[0] == "33")
    # pieces of the merge of any size give the same groups
    assert found(frame, piece=7) == want
    assert found(odd(spark)) == brute(texts())
    assert found(none(spark)) == []


def test_query_equals_brute_force_on_the_table(spark):
    rows = rows_of("documents", "doc_id, text", "/root/testdata/sf0.01")
    got = entry.queries()["op13_token_alignment"](spark, "/root/testdata/sf0.01")
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)]
    assert sorted((str(r["doc_id"]), *(r[c] for c in (*NAMES[:-1], "groups_sha256"))) for r in got.collect()) == want


def test_pieces_of_a_merge():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(60), rng.randrange(50)))) for _ in range(2))
        want = np.intersect1d(a, b)
        for piece in (1, 2, 5, 1000):
            i, j = alignment.overlaps(a, b, piece)
            assert (a[i] == want).all() and (b[j] == want).all() and len(i) == len(want)
            at_a, at_b = alignment.diagonals(a, b, piece)
            assert (np.diff(at_a + at_b) <= piece).all() and at_a[-1] == len(a) and at_b[-1] == len(b)


def test_vocabulary_is_read_whole():
    pair = alignment.Pair(read_model(tokenizer_path("byte_bpe_50k.json")), read_model(tokenizer_path("piece_bpe_32k.model")))
    assert len(pair.bytes_a) == 50_257 and len(pair.bytes_b) == 32_000 and all(pair.bytes_b)
