"""Packed rows written as an id matrix and read back hold every document's ids, in order."""

import numpy as np
from pyspark.sql import functions as F

from paydrift.llm import bpe, packing

from .data import odd


def test_matrix_is_read_back_whole(spark, tmp_path):
    coded = packing.token_ids(odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"))
    packing.write_packed(packing.pack(coded, context=128), str(tmp_path / "packed"))
    pieces: dict[int, list[tuple[int, bytes]]] = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, at = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4")
        assert len(ids) == len(at) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] and len(r["cu_seqlens"]) == r["n_segments"] + 1
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (at[a:b] == np.arange(b - a)).all()
            pieces.setdefault(d, []).append((s, ids[a:b].tobytes()))
    whole = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {d: bytes(x) for d, x in whole.items() if x}


def test_ids_are_those_of_the_encoder_but_for_special_strings(spark):
    rows = odd(spark).where("not coalesce(text, '') like '%<|endoftext|>%'").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a = {(r["text"]): bytes(r["ids"]) for r in packing.token_ids(rows).collect()}
    b = {(r["text"]): bytes(r["ids"]) for r in bpe.encode(rows).collect()}
    assert a == b
