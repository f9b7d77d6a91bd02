import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe, packing
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, ids int, lang string"
ODD = [
    "", None, " \n\t ", "Hello, world's BEST 123!", "don't we'll 'tis", "ΑΣ ΣΑΣ İstanbul Ŕ́ ﬁ", "<|endoftext|>a<|startoftext|>'s", "a\x1cb\x85c\u3000d",
    "ab" * 400 + " " + "thethe" * 50, "x" * 5000, "漢字かな😀👩‍👩", "same", "same", "%%%&&& a,b. c!!", "\x00\x7f",
]


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(bpe.default_path())


def rows(spark):
    return spark.createDataFrame([(i, t, 7, "en") for i, t in enumerate(ODD)] + [(0, ODD[0], 7, "en"), (None, "null key", 1, "x")], SCHEMA)


def test_encodes_and_decodes_as_the_library(spark, known):
    found = bpe.bpe_decode(bpe.bpe_encode(rows(spark))).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        text = "null key" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        ids = known.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["text"] == known.decode(ids, skip_special_tokens=False)


def test_random_texts(known):
    random.seed(3)
    letters = "aAbÉßΣς ’'stre\t\n\x1c\xa0\u0301ñ1٣字😀_-.,!"
    codec = bpe.codec(bpe.default_path())
    for _ in range(1500):
        text = "".join(random.choices(letters, k=random.randint(0, 30)))
        assert codec.encode(text) == known.encode(text, add_special_tokens=False).ids


def test_scan_and_heap_agree(known):
    codec = bpe.codec(bpe.default_path())
    for word in ("international", "th" * 60, "aeiou" * 30):
        parts = [codec.inner[b] for b in word.encode()]
        assert codec.merged(list(parts)) == codec.merged_long(list(parts))


def test_query(spark, known):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in bpe.op1_bpe(spark, DATA).collect():
        ids = known.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.bpe_decode(bpe.bpe_encode(spark.createDataFrame([], SCHEMA))).count() == 0
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def checked(found, ids):
    """Every id of every document once, sums right, sequences gapless; returns the padding."""
    by, seqs = {}, {}
    for r in found:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for (doc, _), parts in by.items():
        copies = ids.count(doc) if isinstance(ids, list) else 1
        raw, done = ids[doc], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
            done += r["length"]
        assert done % (len(raw) // 4) == 0 and done and copies
    fill = []
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
        fill.append(at)
    return sum(packing.CAPACITY - f for f in fill if f & (f - 1)), sum(fill)


def test_packs_everything_once(spark):
    codec = bpe.codec(bpe.default_path())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r["doc_id"]: np.array([*codec.encode(r["text"] or ""), 1], "<u4").tobytes() for r in docs.collect()}
    found = packing.op2_packing(spark, DATA).collect()
    padding, total = checked(found, ids)
    assert total == sum(len(x) // 4 for x in ids.values())
    assert padding <= 0.01 * total


def test_packs_odd_rows(spark):
    codec = bpe.codec(bpe.default_path())
    found = packing.pack(rows(spark)).collect()
    texts = [*(t or "" for t in ODD), ODD[0] or "", "null key"]
    assert sum(r["length"] for r in found) == sum(len(codec.encode(t)) + 1 for t in texts)


def test_plan_is_exact_for_any_histogram():
    random.seed(1)
    for _ in range(4):
        want = {random.randint(1, 2048): random.randint(1, 300) for _ in range(25)}
        whole, parts = packing.plan(want)
        got, fill = {}, {}
        for k, lo, hi, copies, seq, off in whole:
            for r in range(lo, hi + 1):
                got[k, r] = got.get((k, r), 0) + k
                s = seq + (r - lo) // copies
                fill[s] = fill.get(s, 0) + k
        for k, r, _, n, s, _ in parts:
            got[k, r] = got.get((k, r), 0) + n
            fill[s] = fill.get(s, 0) + n
        assert got == {(k, r): k for k, n in want.items() for r in range(n)}
        assert max(fill.values()) <= 2048
