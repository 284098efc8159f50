"""Training-data operators against brute force on small tables with nulls,
empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("limnos.llm.queries")

import public_tokenizers
from tokenizers import Tokenizer

from limnos.llm import chat, covertree, jaccard, langid, lm, merkle, mixing, packing, repeats, secrets
from limnos.llm.common import importable
from limnos.llm.components import connected

WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = "the quick brown fox jumps over the lazy dog while seven small cats watch from a tall red fence near the old mill".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__range` int, size string, target string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}é" for i in range(400)]
    out = [None, "", " \t\n", "One", "one", "!!! ---", " ".join(BASE), "  ".join(BASE).upper()]
    for i in range(25):  # near copies
        w = [*BASE, *BASE[::-1], *[words[k] for k in range(60)]]
        w[int(rng.integers(len(w)))] = f"edit{i}"
        out.append(" ".join(w) + ".\n")
    for _ in range(25):
        out.append(". ".join(" ".join(rng.choice(words, 12)) for _ in range(int(rng.integers(1, 12)))) + "\n\n")
    out.append(" ".join(rng.choice(words, 30000)))  # very long
    out += [out[10], out[10], " ".join(BASE + ["tail"] * 30 + BASE)]
    return out


def table(spark, rows=None):
    importable(spark)
    if rows is None:
        rows = list(enumerate(texts()))
        rows += [rows[6], (None, " ".join(BASE)), (None, None)]
    data = [(d, t, "en" if d and d % 2 else None, None if d == 5 else f"s{(d or 0) % 4}", len(t or ""), 1, "x", "y") for d, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3), rows


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(50, i) for i in range(60, 90)] + [(7, 7), (90, 50), (50, 90)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 41)}, 50: 50, **{i: 50 for i in range(60, 91)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_vectors(spark):
    importable(spark)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    vectors = [b + rng.normal(size=8) * s for b in base[:12] for s in (0, 0.05, 0.3, 0.5)] + list(base) + [base[0]] * 5
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [math.nan] * 8), (904, [None] * 8), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[0][1]), (907, [1e-200] * 8), (908, [1e200] * 8)]
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    def cos(a, b):
        if any(x is None or not x or len(x) != len(a) or any(v is None or not math.isfinite(v) for v in x) or not any(x) for x in (a, b)):
            return -1
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    n, parent = len(rows), list(range(len(rows)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if rows[i][1] is not None and rows[j][1] is not None and cos(rows[i][1], rows[j][1]) >= 0.95:
                links[i] += 1
                links[j] += 1
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(parent, i)] = min(least.get(find(parent, i), 10**9), rows[i][0])
    want = sorted((str(rows[i][0]), links[i], least.get(find(parent, i)), least.get(find(parent, i)) == rows[i][0]) for i in range(n))
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(parent, i)] = min(least.get(find(parent, i), 10**9), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(parent, i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("long", [64, 4])
def test_jaccard(spark, monkeypatch, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    docs, rows = table(spark)
    if long == 4:  # lists of the near copies are long: meetings and comparisons inside lists
        measured = jaccard._measure(docs, 4, lists := jaccard._Lists(2))
        monkeypatch.setattr(jaccard, "_long_lists", lambda m, s: np.sort(np.concatenate([np.unique(lists.name(x)) for x in [named(rows)]])))
        del measured
    got = jaccard.components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows)


def named(rows):
    """Shingles of at least four distinct texts."""
    import pyarrow as pa

    from limnos.llm.words import Words, shingle_sets
    count = Counter(x for s in shingle_sets(Words(pa.array(sorted({t for _, t in rows if t})), lower=True), 4) for x in s.tolist())
    return np.array([x for x, n in count.items() if n >= 4], np.uint64)


def test_packing(spark):
    docs, rows = table(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, keep_ids=True).collect()
    tok = Tokenizer.from_file(path)
    want = sorted((str(d), *tok.encode(t or "", add_special_tokens=False).ids, 2) for d, t in rows)
    pieces = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
    # every id once, however rows with one doc_id are told apart
    assert Counter(i for r in got for i in r["ids"]) == Counter(i for w in want for i in w[1:])
    for (doc, n), parts in pieces.items():
        same = [w for w in want if w[0] == doc and len(w) - 1 == n]
        if len(same) == 1:
            assert tuple(i for p in sorted(parts, key=lambda p: p["start"]) for i in p["ids"]) == same[0][1:]
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in filled.values())


def test_schedule_with_targets():
    plan = packing.Schedule([1000, 3000, 500], [1, 1, 2], window=64)
    seen = {}
    for q, size in enumerate(plan.sizes):
        for place in range(0, size, 37):
            for start, length, seq, offset in plan.pieces(q, place, min(37, size - place)):
                for k in range(length):
                    assert seen.setdefault((seq, offset + k), (q, place + start + k)) == (q, place + start + k)
    assert len(seen) == 4500
    first = [plan.before(1)[q] for q in range(3)]
    assert abs(first[0] - 16) <= 1 and abs(first[2] - 32) <= 1 and sum(first) == 64


def test_mixing(spark):
    docs, rows = table(spark)
    sizes = mixing.word_sizes(docs, ["doc_id", "source"])
    got = mixing.mix(sizes).collect()
    size = {}
    for d, t in rows:
        s = None if d == 5 else f"s{(d or 0) % 4}"
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in size)
    again = mixing.mix(sizes.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_chat(spark):
    importable(spark)
    said = "<|im_end|><|im_start|>assistant ok <\\| <|"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 1, "assistant", "second"), (2, 0, None, None), (2, 1, "assistant", "again"), (None, 0, "a\nb\\", "x"), (3, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns).collect()
    for r in formatted:
        assert chat.parse(r["formatted"])[0][0] == (r["role"] or "")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == len(said)
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nagain\nassistant\nsecond\n").hexdigest()
    assert set(got) == {1, 2, 3, None}
    parts = [{"type": "text", "text": "look <|"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b", "seconds": 2}, {"type": "document", "pages": 3}]
    text, a, z, refs, n = chat.format_turn("user", parts)
    assert text[a:z] == "look <\\|<|image:0|><|audio:1|><|document:2|>" and refs == ["image:a.png", "audio:b", "document:"] and n == 2 + 3 + 50 + 768


def test_fingerprints(spark):
    docs, rows = table(spark)
    rows = sorted({d: t or "" for d, t in rows if d is not None}.items(), reverse=True)
    got = {r["doc_id"]: r for r in merkle.edited_fingerprints(table(spark, [(d, t) for d, t in rows])[0]).collect()}
    for i, (d, t) in enumerate(rows):
        after, m = rows[(i + 1) % len(rows)][1], len(t) // 3
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256((t[:len(t) - m] + after[:m]).encode()).hexdigest() and r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and [r["fingerprint"]] == merkle.fingerprints([t])
    assert len({r["fingerprint"] for r in got.values()}) == len({t for _, t in rows})
    a, b = merkle.fingerprints(["x. " * 50 + "same words. " * 9, "y. " * 50 + "same words. " * 9])
    assert merkle.differing(a, a) == [] and merkle.differing(a, b) and 0 < merkle.likeness(a, b) < 1
    assert merkle.edited_fingerprints(docs).count() == docs.count()


def test_language_model(spark):
    docs, rows = table(spark)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    got = lm.score(docs.select("doc_id", held.alias("held_out"), "text", "size")).collect()
    count, tokens = Counter(), [(d, [*WORD.findall(low(t or "")), "\n"]) for d, t in rows]
    for d, w in tokens:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for d, w in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_bits_sum_to_one():
    """All bytes after one context have probability 1 together."""
    text, length = lm._closed(np.frombuffer(b"abcabd", np.uint8), np.array([3, 3]))
    tables = lm.count_tables(text, length, np.array([2.0, 1.0])).astype(np.float32).transpose(0, 2, 1)
    centre = (np.arange(33) - 16) / 2.0
    model = lm.Model(np.ascontiguousarray(tables), np.full((lm._GATES, len(lm.ORDERS) + 1), 0.3), np.tile(centre, (lm._GATES, 1)), np.array([0, 0, 1.0]), 1, 4, 3, np.array([1]), np.array([3]))
    every = np.arange(256, dtype=np.uint8)
    raw = np.stack([np.full(256, 97, np.uint8), np.full(256, 98, np.uint8), every], axis=1).ravel()
    scores = model.word_scores(raw, np.full(256, 3)) - model.word_scores(np.frombuffer(b"ab", np.uint8), np.array([2]))
    assert math.isclose((10 ** scores).sum(), 1.0, rel_tol=1e-6)


def test_secrets(spark):
    good = "ghp_" + (body := "aB3" * 10) + secrets.base62_crc(body)
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    samples = ['é PassWord = "abcdefgh12"', "token:short api_key='x12345678' secret==nothere", "AKIA" + "Z" * 12 + " AKIAAKIA", "f" * 31 + "g" + "0a" * 16, good, bad,
               "passwordtoken: abcdefghij", "password password: 12345678", None, "", "日本 secret: ααα secret: abcdefgh\n" * 3, "x" * 200000 + " passwd=longlong1"]
    docs, rows = table(spark, [(i, t) for i, t in enumerate(samples)])
    rules = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32))
    got = {r["doc_id"]: r for r in secrets.secret_spans(docs).collect()}
    for d, t in rows:
        spans = sorted(((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(rules) for m in p.finditer(t or "") if ok(m)))
        listed = ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (t, got[d])
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == tuple(sum(s[3] == k for s in spans) for k, _, _ in rules)
    assert got[4]["spans"] == "github:0:40" and "github" not in got[5]["spans"]
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[4]["text"] == "[GITHUB]" and clean[4]["n_chars"] == 8 and clean[8]["text"] is None and clean[5]["text"] == bad


def test_language_id(spark):
    rng = np.random.default_rng(5)
    parts = {"en": "the ing tion and er wh", "de": "sch ung der keit ein ü", "fr": "eau que ée les ou ç", "es": "ción ñ los ado que ez"}
    rows = [(i, lang, " ".join("".join(rng.choice(parts[lang].split(), 3)) for _ in range(int(rng.integers(3, 60))))) for i, lang in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "en", ""), (902, None, "123 !!"), (903, None, "THE ANDING WHER TION")], "doc_id long, lang string, text string")
    importable(spark)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs.filter("doc_id % 4 < 4 AND doc_id < 160"))).collect()}
    held = [r for r in rows if r[0] >= 160]
    assert sum(got[i]["lang_pred"] == lang for i, lang, _ in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.predict(docs, langid.fit(docs.filter("false"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_repeats(spark):
    docs, rows = table(spark)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect())
    last = 10**9
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            x = tuple(w[i:i + 13])
            first[x] = min(first.get(x, last), last if d is None else d)
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < (last if d is None else d):
                keep[i:i + 13] = [False] * 13
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        want.append((str(d), len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("operator", [
    lambda d: jaccard.components(d), lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: mixing.mix(mixing.word_sizes(d)),
    lambda d: merkle.edited_fingerprints(d), lambda d: lm.score(d.select("doc_id", "text", F.lit(False).alias("held_out"))), lambda d: secrets.secret_spans(d), lambda d: repeats.remove_repeats(d)])
def test_empty_tables(spark, operator):
    importable(spark)
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, kept = rows, {}
    from limnos.llm.common import materialize
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "packing":
            assert docs.columns == rows.columns
        kept[name] = docs
    texts_ = [(r["doc_id"], r["text"]) for r in kept["language_id"].collect()]
    least = {c for _, n, c in brute_components(texts_)}
    assert {str(r["doc_id"]) for r in kept["ngram_jaccard"].collect()} == least
    assert kept["secret_scan"].count() == len(least)
    assert not any(r["spans"] and "hex" in r["spans"] for r in secrets.secret_spans(kept["secret_scan"]).collect())
    words = sum(len(WORD.findall(r["text"])) for r in kept["secret_scan"].collect())
    mixed = sum(len(WORD.findall(r["text"])) for r in kept["source_mixing"].collect())
    assert abs(mixed - 1.5 * words) <= 20
    assert docs.agg(F.sum("length")).first()[0] == sum(x[0] for x in docs.select("doc_tokens", "doc_id", "start").filter("start = 0").select("doc_tokens").collect())


CORPUS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    importable(spark)
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], CORPUS).repartition(3)


def test_pipeline_near_duplicates_share_80_percent_of_5_words(spark):
    import corpus_pipeline
    rng = np.random.default_rng(11)

    def edited(words, n):
        return [f"edit{i}" if i % 30 == 15 and i // 30 < n else w for i, w in enumerate(words)]
    cut, five, six = ([f"w{x}" for x in rng.integers(10**6, size=n)] for n in (104, 230, 230))
    rows = [(1, cut), (2, cut[:86]), (3, five), (4, edited(five, 5)), (5, six), (6, edited(six, 6))]
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in rows}
    likeness = [len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in (1, 3, 5)]
    assert 0.8 <= likeness[0] < 0.85 and 0.8 <= likeness[1] < 0.85 and likeness[2] < 0.8
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus(spark, [(d, " ".join(w)) for d, w in rows]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6]


def test_pipeline_keeps_a_row_of_each_component(spark):
    """Null and repeated doc_ids: one row a component, none lost."""
    import corpus_pipeline
    rng = np.random.default_rng(12)
    a, b, c, d, e, f = (" ".join(f"w{x}" for x in rng.integers(10**6, size=90)) for _ in range(6))
    rows = [(None, a), (None, b), (None, a + " tail"), (None, None), (None, " "), (7, c), (7, d), (7, d), (3, c + " tail"), (8, e), (None, e), (8, f), (9, ""), (9, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    first = [x for x in ((None, a), (None, a + " tail")) if got.pop(x, 0) == 1]
    assert len(first) == 1
    assert got == Counter([(None, b), (None, None), (None, " "), (3, c + " tail"), (7, d), (8, e), (8, f), (9, ""), (9, "")])


def test_language_of_few_texts_with_many_copies(spark):
    importable(spark)
    few = ["der schnelle braune fuchs springt", "über den faulen hund und weiter", "sieben kleine katzen sehen zu"]
    many = [f"the quick brown fox number {i} jumps over it" for i in range(600)]
    rows = [(t, "de") for t in few for _ in range(4000)] + [(t, "en") for t in many]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = langid.fit(docs)
    assert model.members == {"germanic": ["de", "en"]}
    got = langid.predict(docs.distinct(), model).collect()
    assert {r["text"] for r in got if r["lang_pred"] == "de"} == set(few)


def test_templated_documents_need_no_long_list(spark, monkeypatch):
    """44 shared shingles and 8 of their own: short lists decide, so nobody
    takes a long one."""
    importable(spark)
    rng = np.random.default_rng(13)
    template = [f"t{i}" for i in range(47)]
    rows = [(i, " ".join([*template, *(f"u{x}" for x in rng.integers(10**9, size=8))])) for i in range(300)]
    docs, _ = table(spark, rows + [(400, rows[7][1] + " more")])
    posts, post = [], jaccard._post
    monkeypatch.setattr(jaccard, "_post", lambda *a: posts.append(post(*a)) or posts[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()}
    assert got == {**{i: i for i in range(300)}, 400: 7}
    assert posts[0].filter("kind = 1 AND length(shingles) > 0").count() == 0


@pytest.mark.parametrize("longest", [1 << 20, 3])
def test_long_lists_in_blocks(spark, monkeypatch, longest):
    """Sets of a list compared in blocks of four; with three long lists kept
    apart the others are still not merged pair by pair."""
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "LONG_LISTS", longest)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "MEETINGS", 0)
    docs, rows = table(spark)
    merged, dealt, merge, deal = [], [], jaccard._merged, jaccard._dealt
    monkeypatch.setattr(jaccard, "_merged", lambda *a: merged.append(merge(*a)) or merged[-1])
    monkeypatch.setattr(jaccard, "_dealt", lambda *a: dealt.append(deal(*a)) or dealt[-1])
    got = jaccard.components(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows)
    assert len(merged) == (2 if longest == 3 else 1)
    assert max(r["count"] for r in dealt[0].groupBy("block").count().collect()) < 25


def test_language_model_learns_from_all(spark, monkeypatch):
    """Weights from every training word, class centres from every training text."""
    importable(spark)
    rng = np.random.default_rng(8)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "αβγδ", "ежзи"]
    rows = [(i, " ".join("".join(rng.choice(list(alphabets[i % 6]), 6)) for _ in range(4))) for i in range(4200)]
    for name, value in (("LEARN", 64), ("SEQUENCE", 1 << 10), ("_PIECE", 1 << 14)):
        monkeypatch.setattr(lm, name, value, raising=False)
    stages, write = {}, lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, name: stages.setdefault(name, write(df, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 10 == 0)
    assert lm.score(docs).count() == len(rows)
    train = [t for i, t in rows if i % 10]
    assert stages["trained"].agg(F.sum("n")).first()[0] == len({w for t in train for w in t.split()})
    centres = lm._classes(docs.filter("not held_out").select("text"))
    letters = {c for t in train for c in t if c.isascii() and c != " "}
    root = {c: np.array([math.sqrt(t.count(c) / max(1, len(t.replace(" ", "").encode()))) for t in train]) for c in letters}
    own = [next(i for i, a in enumerate(alphabets) if t[0] in a) for t in train]
    for k, alphabet in enumerate(alphabets[:4]):  # the class that holds an alphabet's texts has their mean
        near = [c for c in centres if sum(c[ord(x) - 97] for x in alphabet) > 0.5]
        size = sum(o == k for o in own)
        assert near and size
        if len(near) == 1:
            assert [near[0][ord(x) - 97] for x in alphabet] == pytest.approx([root[x].sum() / size for x in alphabet], abs=1e-5)


def test_language_model_reads_over_words(spark):
    """A text is likelier than its words in another order, however they are cut into rows and texts."""
    importable(spark)
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]

    def chain():  # a word is followed by one of two
        at, out = int(rng.integers(40)), []
        for _ in range(60):
            out.append(vocabulary[at])
            at = (3 * at + int(rng.integers(2))) % 40
        return out
    train, held = [chain() for _ in range(300)], [chain() for _ in range(20)]
    rows = [(i, " ".join(w), False) for i, w in enumerate(train)]
    for i, w in enumerate(held):
        rows += [(1000 + i, " ".join(w), True), (2000 + i, " ".join(rng.permutation(w).tolist()), True), (3000 + i, "\n ".join(w).upper(), True)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    for i in range(20):
        assert got[1000 + i]["score"] > got[2000 + i]["score"] + 3
        assert got[1000 + i]["score"] == pytest.approx(got[3000 + i]["score"], rel=1e-9)
        assert got[1000 + i]["base_score"] == pytest.approx(got[2000 + i]["base_score"], rel=1e-9)


def test_contexts_hold_the_bytes_before(monkeypatch):
    """Contexts and counts against brute force, with zero bytes, long words, copies and empty texts."""
    texts = [b"the cat sat ", b"", b"a ", b"the cat \0\0 b ", b"x" * 300 + b" y ", b"the cat sat ", b"\0\0\0\0\0\0\0\0 ", b"the dog sat "]
    text, length = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    contexts = lm._contexts(*lm._windows(text, length))
    before = [(t, i) for t in texts for i in range(len(t))]
    for order, context in zip(lm.ORDERS, contexts, strict=True):
        said = [t[:i].rsplit(b" ", 1)[-1] if order is None else t[max(0, i - order):i] for t, i in before]
        assert len(set(zip(said, context.tolist(), strict=True))) == len(set(said)) == len(set(context.tolist()))
    weight = np.array([1.0, 2, 1, 3, 1, 1, 2, 1])
    want = np.zeros((len(lm.ORDERS), 2, 1 << lm.SLOT_BITS))
    for _, node, bit in lm._bits(text):
        for k, context in enumerate(contexts):
            np.add.at(want[k], (bit, lm._slots(context, node)), np.repeat(weight, length))
    assert np.array_equal(lm.count_tables(text, length, weight), want)
    whole = lm._windows(text, length)
    for most in (1, 4, 7, 40):  # long texts are looked at in parts
        monkeypatch.setattr(lm, "_SLICE", most)
        parts = list(lm._parts(text, length))
        assert len(parts) > 2 and [p[0].start for p in parts[1:]] == [p[0].stop for p in parts[:-1]]
        assert all(np.array_equal(np.concatenate([p[1 + i] for p in parts]), whole[i]) for i in (0, 1))


def test_bytes_of_texts_sum_to_one():
    """All bytes after one context over words have probability 1 together, and equal texts equal scores."""
    rng = np.random.default_rng(3)
    text = np.frombuffer(" ".join(rng.choice(["ab", "cab", "b"], 500)).encode() + b" ", np.uint8)
    length = np.array([len(text)])
    tables = lm.count_tables(text, length, np.ones(1)).astype(np.float32).transpose(0, 2, 1)
    centre, ways = (np.arange(33) - 16) / 2.0, np.array([0, 0, 1.0])
    model = lm.Model(np.ascontiguousarray(tables), np.full((lm._GATES, len(lm.ORDERS) + 1), 1 / 6), np.tile(centre, (lm._GATES, 1)), ways, 1, 4, 3, np.array([1]), np.array([3]))
    weights, cells, met = lm.learn(model, text, length)
    ones, every = cells.reshape(2, lm._GATES, 33)
    assert every.sum() == pytest.approx(8 * len(text)) and ones.sum() == pytest.approx(np.unpackbits(text).sum()) and len(met) == len(text)
    model = lm.Model(model.tables, weights, model.refine, ways, 1, 4, 3, np.array([1]), np.array([3]))
    raw = np.frombuffer(b"".join(b"cab b " + bytes([i]) for i in range(256)), np.uint8)
    scores = model.byte_scores(raw, np.full(256, 7)).reshape(256, 7)
    assert (10 ** scores[:, -1]).sum() == pytest.approx(1, rel=1e-9) and np.ptp(scores[:, :-1], axis=0).max() == 0
