"""Hard negatives, quality classifier and fill-in-middle against brute force,
held-out accuracy and exact round trips."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("limnos.llm.queries")

from limnos.llm import fim, negatives, quality
from limnos.llm.common import importable
from limnos.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def test_skip_list_offsets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5, 64, 3000):
        widths = rng.integers(1, 9, n)
        units = fim.SkipList(widths)
        sums = np.concatenate([[0], np.cumsum(widths)])
        assert [units.offset(r) for r in range(n + 1)] == sums.tolist()
    assert len(units.lanes) > 3  # 3,000 units have express lanes


def fim_rows():
    texts = [None, "", " ", "one", " lead", "tail \n", "a<P>b c d", "x <S> y", "no <M>", "é ü 漢字 😀 end\t ", "<P", "S> <", "a b " * 20000, "word"]
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(list("ab é\n\t<PSM>"), int(rng.integers(1, 60)))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (3, "one"), (None, "some words here"), (-7, "some words here")]


def fim_expected(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(tokens), "plain", None, None, text
    lo, hi = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(seed=1, rate=100, spm=0), fim.Plan(seed=2, rate=100, spm=100)])
def test_fill_in_middle_brute_force(spark, plan):
    importable(spark)
    rows = fim_rows()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, form string, output string").repartition(3)
    made = fim.fill_in_middle(docs, plan)
    got = sorted((tuple(r) for r in made.collect()), key=key)
    assert got == sorted((fim_expected(d, t, plan.seed, plan.rate, plan.spm) for d, t in rows), key=key)
    back = {r["restored_sha256"] for r in fim.digests(made).collect()}
    assert back == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert fim.fill_in_middle(docs.limit(0), plan).count() == 0


def test_fill_in_middle_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE["op13_fill_in_middle"]).fetchall()
    got = QUERIES["op13_fill_in_middle"](spark, SF)
    names = [c[0] for c in con.description]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want, key=key)


def test_vertical_scan_exact():
    rng = np.random.default_rng(8)
    for dims in (0, 1, 7, 64):
        rows = rng.integers(-40, 40, (500, dims))
        rows[100:140] = rows[0]  # ties
        anchor = rng.integers(-40, 40, dims)
        score = rows @ anchor
        columns = np.ascontiguousarray(rows.T.astype(np.int32))
        least = columns.min(axis=1, initial=99).astype(np.int64)
        most = columns.max(axis=1, initial=-99).astype(np.int64)
        candidates = np.flatnonzero(rng.random(500) < 0.8)
        windows = [(-(1 << 62), 1 << 62), (-50, 300), (0, 0), (10, 5)]
        for (a, z), (at, found) in zip(windows, negatives.vertical_scan(columns, least, most, anchor.astype(np.int64), candidates, windows, 10), strict=True):
            inside = [i for i in candidates if a <= score[i] <= z]
            tenth = sorted((score[i] for i in inside), reverse=True)[9] if len(inside) > 9 else -math.inf
            assert set(at.tolist()) >= {i for i in inside if score[i] >= tenth}
            assert set(at.tolist()) <= set(inside)
            assert found.tolist() == score[at].tolist()


def test_vertical_scan_prunes():
    """Rows far below the first k leave before the last column is read."""
    rng = np.random.default_rng(1)
    anchor = (300 / np.arange(1, 65) ** 1.5).astype(np.int64)
    columns = rng.integers(-100, 100, (64, 20000)).astype(np.int32)
    columns[:4, :20] = 99

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, at):
            out = super().__getitem__(at)
            Counting.read += np.size(out)
            return np.asarray(out)
    found = negatives.vertical_scan(columns.view(Counting), columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64), anchor, np.arange(20000), [(-(1 << 62), 1 << 62)], 10)
    assert sorted(found[0][1].tolist()) == sorted((anchor @ columns).tolist())[-10:]
    assert Counting.read < columns.size // 2


def mined(rows, scale=256, positives=5, k=10, lo=30, hi=90):
    ok = []
    for i, (vid, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) or scale * abs(x) + 1 >= 2 ** 31 / math.sqrt(len(v)) for x in v):
            continue
        ok.append((i, vid, label, [math.floor(scale * x) for x in v]))
    last = (1 << 63)
    out = []
    for i, vid, label, v in ok:
        if vid is None or vid % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), last if d is None else d, j, same == label, d) for j, d, same, w in ok if j != i and len(w) == len(v))
        for p in [s for s in scored if s[3]][:positives]:
            some = [s for s in scored if not s[3] and -lo * p[0] <= -100 * s[0] <= -hi * p[0]][:k]
            out += [(vid, p[4], r, s[4], -p[0], -s[0]) for r, s in enumerate(some, 1)]
    return sorted(out, key=key)


def test_hard_negatives_brute_force(spark):
    importable(spark)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), (rng.normal(size=8) / 3).tolist()) for i in range(400)]
    rows += [(i, 1, rows[100][2]) for i in range(400, 460)]  # a hot group of equal rows
    rows += [rows[100], rows[200], (300, 2, rows[300][2]), (None, 0, rows[3][2]), (None, 1, rows[4][2]), (None, 1, rows[4][2])]
    rows += [(500, None, rows[0][2]), (600, 1, None), (700, 1, [1.0, None]), (800, 1, [math.nan] * 8), (900, 2, [math.inf] * 8), (1000, 1, [1e30] * 8)]
    rows += [(1100, 0, [1.0, 2.0]), (1101, 1, [0.5, 1.0]), (1102, 0, [1.0, 1.5]), (1200, 0, []), (1201, 0, []), (1202, 1, []), (1300, 9, [0.0] * 8)]
    rows += [(1400 + i, -1, [-0.1 * i] * 8) for i in range(8)]
    df = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "vec_id long, label int, embedding array<double>, score int, `__row` int").repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == mined(rows)
    few = negatives.mine(df, F.col("vec_id") % 100 == 0, positives=2, k=3, percent=(50, 100))
    assert sorted((tuple(r) for r in few.collect()), key=key) == mined(rows, positives=2, k=3, lo=50, hi=100)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negatives_query(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op11_bond_negatives"](spark, SF)
    assert sorted((tuple(r) for r in got.collect()), key=key) == mined(rows)


def slow_score(model, text):
    """The network, position by position."""
    w, raw = model.weights, (text or "").encode()
    count = max(1, -(-(len(raw) + quality.WIDTH - 1) // quality.STEP))
    padded = raw + b"\0" * (count * quality.STEP + quality.WIDTH - 1 - len(raw))
    blocks = []
    for b in range(count):
        seen = []
        for p in range(b * quality.STEP, (b + 1) * quality.STEP):
            if padded[p]:
                x = np.concatenate([quality.CODES[c] for c in padded[p:p + quality.WIDTH]])
                seen.append(np.maximum(x @ w["filters"] + w["filters_bias"], 0))
        seen = np.array(seen or [np.zeros(quality.FILTERS)])
        blocks.append((seen.max(axis=0), seen.sum(axis=0) / max(quality.LEAST, len(seen))))
    chunks = [(np.maximum(a[0], b[0]), (a[1] + b[1]) / 2) for a, b in zip(blocks, blocks[1:])] or blocks
    hidden = [np.maximum(np.concatenate(c) @ w["hidden"] + w["hidden_bias"], 0) for c in chunks]
    return 1 / (1 + math.exp(-(np.max(hidden, axis=0) @ w["out"] + w["out_bias"])[0]))


def quality_model(seed=3):
    rng = np.random.default_rng(seed)
    n = quality.WIDTH * quality.CODES.shape[1]
    shapes = {"filters": (n, quality.FILTERS), "filters_bias": (quality.FILTERS,), "hidden": (2 * quality.FILTERS, quality.HIDDEN),
              "hidden_bias": (quality.HIDDEN,), "out": (quality.HIDDEN, 1), "out_bias": (1,)}
    return quality.Model({k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()})


def test_quality_scores_whole_texts():
    model = quality_model()
    texts = [None, "", "a", "ü" * 300, "short text.", "x" * 251, "x" * 252, "y " * 700, "nul\0byte", "Some words, MORE words! " * 60 + "end"]
    got = model.score(pa.array(texts), model.tables())
    np.testing.assert_allclose(got, [slow_score(model, t) for t in texts], atol=1e-5)
    # what stands at the end of a long text counts, and neighbours don't
    long = "plain words " * 20000
    a, b, c = model.score(pa.array([long, long + "### $$$ %%% " * 40, long]), model.tables())
    assert a == c != b


def test_quality_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (3, 200, 700, 1300)] + [b""]
    label, weight = np.array([1, 0, 1, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0, 1.0])
    w = {k: v.astype(np.float64) for k, v in quality_model(9).weights.items()}

    def loss(w):
        p = np.array([slow_score(quality.Model(w), t.decode()) for t in texts])
        return -np.mean(weight * np.log(np.where(label == 1, p, 1 - p)))
    found = quality._gradients(w, texts, label, weight)
    for name, at in (("filters", (17, 3)), ("filters", (40, 9)), ("filters_bias", (2,)), ("hidden", (5, 4)), ("hidden", (20, 7)), ("hidden_bias", (3,)), ("out", (6, 0)), ("out_bias", (0,))):
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert found[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.05, abs=2e-5)


def test_quality_edge_tables(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "good text", 5.0), (1, "good text", 5.0), (2, None, 1.0), (None, "x", 2.0), (3, "bad", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 0), (3, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels).constant == 1.0  # one class only
    none = quality.fit(docs, labels.limit(0))
    got = quality.predict(docs, none)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    assert {(r["score"], r["predicted"]) for r in got.collect()} == {(0.5, 1)}
    model = quality.fit(docs, labels.unionByName(spark.createDataFrame([(3, 0)], "doc_id long, quality int")))
    assert model.constant is None
    rows = quality.predict(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.predict(docs.limit(0), model).count() == 0


def test_quality_query_held_out(spark):
    import zlib
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_quality_cnn"](spark, sf).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows} == docs
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    quality_of = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], quality_of[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality_of]
    assert np.mean([p == q for p, q in held]) >= 0.93
    assert np.mean([p for p, q in held if q == 1]) >= 0.97
