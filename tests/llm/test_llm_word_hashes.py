"""Words and word sequences that a polynomial hash modulo 2**64 mixes up."""
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("limnos.llm.queries")

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from limnos.llm import jaccard, lm, merkle, packing, repeats
from limnos.llm.common import importable
from limnos.llm.words import Words, _windows, byte_hashes, sequence_hashes


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 2048, 4096)]


def test_hashes_depend_on_the_sequence_alone():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 200, 2000)]
    raw, size = np.frombuffer(b" ".join(words), np.uint8), np.array([len(w) for w in words])
    end = np.cumsum(size + 1) - 1
    h, seen = byte_hashes(raw, end - size, end), {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert Words(pa.array(["", words[5].decode(), None])).hashes()[0] == h[5]
    v = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    for k in (1, 2, 3, 4, 5, 7, 13):
        w = _windows(v, k)
        assert len(w) == 4000 - k + 1 and w[10] == _windows(v[10:10 + k], k)[0] and len(np.unique(w)) == len(w)
    assert sequence_hashes(v, np.array([0, 10, 700]), np.array([10, 600, 4000]))[1] == sequence_hashes(v[10:600], np.array([0]), np.array([590]))[0]


def test_operators_tell_such_words_apart(spark):
    importable(spark)
    a, b = PAIRS[0]
    texts = [a, b, f"{a} end", f"{b} end"] + [x for p in PAIRS[1:] for x in p]
    line = " ".join(f"w{i}" for i in range(12))
    texts += [f"{line} {a} tail", f"{line} {b} tail"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["component_id"] for r in jaccard.components(docs).collect()} == set(range(len(texts)))  # op2: none of them link
    assert len(set(merkle.fingerprints(texts))) == len(texts)  # op6
    removed = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()}  # op10: no window of 13 words occurs twice
    assert set(removed.values()) == {0}
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {}
    for r in packing.pack(docs, path).collect():  # op3: each word has its own ids
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for d, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert sum(n for _, n, _ in got[d]) == len(ids)
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in got[d])
    scored = lm.score(docs.withColumn("held_out", F.col("doc_id") % 2 == 1)).collect()  # op7: base columns
    train = Counter(w for i, t in enumerate(texts) if i % 2 == 0 for w in [*re.findall(r"[^\x20\x09-\x0d]+", t.lower()), None])
    for r in scored:
        words = [*re.findall(r"[^\x20\x09-\x0d]+", texts[r["doc_id"]].lower()), None]
        assert r["n_known"] == sum(train[w] > 0 for w in words)
        scale = train.total() + 0.1 * (len(train) + 1)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 0.1) / scale) for w in words))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(lm, "_PIECE", 1 << 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 10 == 0).alias("held_out"))
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in lm.score(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and all(got[1][d] == pytest.approx(x, rel=1e-6) for d, x in got[0].items())


def test_words_are_encoded_together():
    """Many words to a text, with the ids that each has alone, marks and special tokens included."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(4)
    words = list(dict.fromkeys("".join(rng.choice(list("abcdé'S!7-"), 9)) for _ in range(9000)))
    odd = ["<|endoftext|>", "x<|startoftext|>y", "\u0301x", "\u00ad", "\u0130", "a\u3000", "\u3000", "\u2028b", "日本語", "\ufeff", "it's", "\0"]
    tok = Tokenizer.from_file(path)

    class Counted:
        texts = 0

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return tok.encode_batch_fast(texts, **more)
    for extra, most in ((odd, 100), ([*odd, "\x01", "a\x01b", "\x01\x01"], 5000)):
        encoder = packing.WordIds(path)
        encoder.tokenizer = Counted()
        ids, borders = encoder.encode(pa.array([" ".join(words), None, "\n".join(extra), " ".join(extra[::-1])]))
        for text, a, z in zip((words, [], extra, extra[::-1]), borders[:-1], borders[1:], strict=True):
            assert ids[a:z].tolist() == [i for w in text for i in tok.encode(w, add_special_tokens=False).ids] == tok.encode(" ".join(text), add_special_tokens=False).ids
        assert encoder.tokenizer.texts < most
