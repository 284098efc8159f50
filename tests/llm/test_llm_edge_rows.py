"""Unknown and malformed parts, clashing column names, many secrets in one
text, empty tables, and registered queries as they are written."""

import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("limnos.llm.queries")

from limnos.llm import chat, common, jaccard, mixing, secrets
from limnos.llm.common import free, importable, materialize
from limnos.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_unknown_and_malformed_parts():
    parts = [None, "plain <|", 7, ["x"], {"text": None}, {"type": "video", "ref": "v.mp4"}, {"type": ["image"]}, {"type": "visit"},
             {"type": "audio", "seconds": -3}, {"type": "audio", "seconds": "soon"}, {"type": "audio", "seconds": float("nan")},
             {"type": "image", "width": 1e300, "height": None}, {"type": "document", "pages": -2}, {"type": "text", "text": "\ud800"}]
    text, a, z, refs, n = chat.format_turn("user", parts)
    assert text[a:z] == ('plain <\\|7["x"]<|unknown:0|><|unknown:1|><|unknown:2|><|audio:3|><|audio:4|><|audio:5|><|image:6|><|document:7|>?')
    assert refs[:3] == ["unknown:video:v.mp4", 'unknown:["image"]:', "unknown:visit:"]
    assert n == 2 + 1 + 1 + -(-2 ** 31 // 28) * 1 + 256 + 1
    text.encode()


def test_parts_column(spark):
    importable(spark)
    rows = [(1, 0, "user", "t", json.dumps([{"type": "text", "text": "a"}, {"type": "image", "ref": "r"}])), (1, 1, "assistant", "t", None),
            (1, 2, "user", "t", "{not json"), (1, 3, "user", "t", '{"text": "one"}'), (1, 4, "user", "t", "null"), (1, 5, "user", None, "[]"),
            (1, 6, "user", "t", "[" * 100000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string")
    got = {r["turn"]: r for r in chat.format_turns(turns.withColumn("formatted", F.lit("other"))).collect()}
    bodies = [chat.parse(got[i]["formatted"])[0][1] for i in range(1, 6)]
    assert bodies == ["t", "{not json", "one", "t", ""] and "a<|image:0|>" in got[0]["formatted"] and got[0]["attachments"] == ["image:r"]
    assert chat.parse(got[6]["formatted"])[0][1] == "[" * 100000
    none = turns.filter("false")
    assert chat.format_turns(none).count() == 0 and chat.conversation_digests(chat.format_turns(none)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_chat_query(spark):
    got = {r["conv_id"]: r for r in QUERIES["op5_chat_formatting"](spark, SF).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    want = {-1: [("user", said), ("assistant", said)]}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    for r in sorted((r for r in rows), key=lambda r: (r["turn"] is None, r["turn"], r["text"] or "")):
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_mix_keeps_columns_of_any_name(spark):
    importable(spark)
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (i % 7)), 5, 77, 9, "r", 3, 4) for i in range(60)]
    names = ["__row", "__range", "__part", "__rest", "__id", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, `__row` int, `__range` int, `__part` int, `__rest` string, `__id` int, `a.b` int")
    docs = materialize(docs, "clash")
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.word_sizes(docs)).collect()}
    wide = mixing.mix(mixing.word_sizes(docs, ["doc_id", "source", *[f"`{n}`" if "." in n else n for n in names[:-1]]]))
    assert wide.columns == ["doc_id", "source", *names[:-1], "size", "source_size", "target", "taken"]
    for r in wide.collect():
        assert r["taken"] == plain[r["doc_id"]] and [r[n] for n in names[:-1]] == [5, 77, 9, "r", 3]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        assert [r[n] for n in names] == [5, 77, 9, "r", 3, 4]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {d: n for d, n in plain.items() if n}
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and sorted(clean.collect()) == sorted(docs.collect())
    assert mixing.mixed_documents(materialize(docs.filter("false"), "none")).count() == 0
    assert free(["A", "a_"], "a") == "a__"


def test_many_hex_runs_in_one_text(spark):
    text = "é ".join(f"{i:040x}" + "日" for i in range(3000)) + " deadbeef" * 4
    spans = next(secrets.scan_batch(__import__("pyarrow").array([text])))
    assert spans == [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{32,}", text)]


def test_near_duplicates_keep_columns_of_any_name(spark):
    import corpus_pipeline
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 5, 1), (2, long + " end", 6, 2), (None, "another text of its own here", 7, 3), (3, None, 8, 4), (4, " ", 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__row` int, `a.b` int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["__row"], r["a.b"]) for r in kept.collect()) == [(5, 1), (7, 3), (8, 4), (9, 5)]


def test_near_duplicate_workers_get_bounded_batches(spark, monkeypatch):
    importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda *a: seen.append(spark.conf.get(key)) or verified(*a))
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "of its own"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert seen and set(seen) == {str(jaccard.BATCH_BYTES)} and spark.conf.get(key, None) is None

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes], "pool": [pa.default_memory_pool().backend_name]})
    wide = spark.range(0, 500, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))

    def run():
        return wide.mapInArrow(sizes, "rows long, bytes long, pool string").collect()
    with common.batches_of(spark, 1 << 16):
        small = run()
    assert sum(r["rows"] for r in small) == 500 and max(r["bytes"] for r in small) < 1 << 17 and {r["pool"] for r in small} == {"system"}
    spark.conf.set(key, str(1 << 18))  # a session's own bound stays
    try:
        with common.batches_of(spark, 1 << 16):
            assert max(r["bytes"] for r in run()) > 1 << 17
        assert spark.conf.get(key) == str(1 << 18)
    finally:
        spark.conf.unset(key)
    with pytest.raises(ZeroDivisionError), common.batches_of(spark, 1 << 16):
        raise ZeroDivisionError
    assert spark.conf.get(key, None) is None
