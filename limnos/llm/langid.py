"""Language identification: family first, then one-versus-one linear support
vector machines between the languages of that family.

Features are relative frequencies of hashed 1- to 3-byte strings of the
lower-cased whole text. A bounded sample of labelled rows fits the machines
on the driver; scoring reads every text whole and in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.words import text_bytes

SLOT_BITS = 16
ORDERS = (1, 2, 3)
#: labelled rows per language that the machines are fitted on, at most
SAMPLE = 400
#: texts above this many characters stand behind the shorter ones in the sample
SAMPLE_CHARS = 20_000
_SCALE = 20.0
_BLOCK = 1 << 19
_SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

#: families of language codes; any other label is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"={lang}")


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, each text with two spaces behind it, so that no
    3-byte string begins in one text and ends in the next."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    return text_bytes(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("  ", pa.large_string())))


def _slots(raw: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the slot of the string that starts at each byte but the
    last two."""
    value = np.zeros(len(raw) - 2, np.uint32)
    for order, salt in zip(ORDERS, _SALTS, strict=True):
        value = (value << np.uint32(8)) | raw[order - 1:len(raw) - 3 + order]
        mixed = (value + np.uint32(salt)) * np.uint32(0x2C1B3C6D)
        yield (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x297A2D39) >> np.uint32(32 - SLOT_BITS)


def _frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw, _ = _padded(pa.array([text]))
    raw = np.concatenate([raw, np.zeros(2, np.uint8)])
    slots, n = np.unique(np.concatenate(list(_slots(raw))), return_counts=True)
    return slots, n * (_SCALE / max(1, len(raw) - 2))


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, epochs: int = 12, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine by stochastic subgradients of the hinge
    loss (step 1 / (reg t)); the average over the last half is returned."""
    rng = np.random.default_rng(7)
    w, scale, bias = np.zeros(1 << SLOT_BITS), 1.0, 0.0
    total, total_bias, kept, t = np.zeros_like(w), 0.0, 0, 0
    cost = {s: len(sign) / (2.0 * max(1, (sign == s).sum())) for s in (-1, 1)}
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            step = 1.0 / (reg * (t + 100))
            slots, x = rows[i]
            margin = sign[i] * (scale * (w[slots] @ x) + bias)
            scale *= 1.0 - step * reg
            if margin < 1:
                w[slots] += step * cost[sign[i]] * sign[i] * x / scale
                bias += 0.1 * cost[sign[i]] * sign[i] / np.sqrt(t)
        if epoch >= epochs // 2:
            total += scale * w
            total_bias += bias
            kept += 1
    return total / kept, total_bias / kept


@dataclass
class Model:
    """families: names; members: languages by family; weights: a column for
    each family (if there are several), then for each pair in a family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Decision values, a row for each text."""
        raw, borders = _padded(texts)
        raw = np.concatenate([raw, np.zeros(2, np.uint8)])
        total = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        for lo in range(0, len(raw) - 2, _BLOCK):
            hi = min(lo + _BLOCK, len(raw) - 2)
            first = int(np.searchsorted(borders, lo, side="right")) - 1
            last = int(np.searchsorted(borders, hi, side="left"))
            cuts = np.maximum(borders[first:last], lo) - lo
            for slots in _slots(raw[lo:hi + 2]):
                total[first:last] += np.add.reduceat(self.weights[slots], cuts, axis=0)
        return total * (_SCALE / np.diff(borders))[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        if not self.members or not len(texts):
            return ["und"] * len(texts), [0.0] * len(texts)
        margins = self.margins(texts) if self.weights.shape[1] else np.zeros((len(texts), 0))
        n = len(self.families) if len(self.families) > 1 else 0
        best = margins[:, :n].argmax(axis=1) if n else np.zeros(len(texts), int)
        sure = 1 / (1 + np.exp(-np.clip(4 * margins[np.arange(len(texts)), best], -30, 30))) if n else np.ones(len(texts))
        out, score = [], []
        for i in range(len(texts)):
            if not letters[i]:
                out.append("und")
                score.append(0.0)
                continue
            family = self.families[best[i]]
            votes = dict.fromkeys(self.members[family], 0.0)
            closest = dict.fromkeys(votes, np.inf)
            for k, (f, a, b) in enumerate(self.pairs):
                if f == family:
                    m = margins[i, n + k]
                    votes[a if m > 0 else b] += 1
                    closest[a], closest[b] = min(closest[a], m), min(closest[b], -m)
            lang = max(votes, key=lambda x: (votes[x], closest[x], x))
            out.append(lang)
            score.append(float(sure[i] * (1 / (1 + np.exp(-min(30.0, 4 * closest[lang]))) if len(votes) > 1 else 1.0)))
        return out, score


def fit(labelled: DataFrame, per_lang: int = SAMPLE) -> Model:
    """Fits on at most ``per_lang`` distinct texts of each value of ``lang``
    (text and lang not null), chosen by a hash of the text; shorter texts
    first. A language with fewer texts gives all of them."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    key = F.xxhash64("text")
    # copies are many rows of one text, so texts are counted, not rows
    texts = rows.select("lang", key.alias("key")).distinct()
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return Model([], {}, [], np.zeros((0, 0)), np.zeros(0))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 3 * per_lang / n))).otherwise(share)
    # copies of a text share a hash, so only one of them goes on
    thin = rows.filter((F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))) < share).distinct()
    order = Window.partitionBy("lang").orderBy(F.length("text") > SAMPLE_CHARS, key, "text")
    sample = thin.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per_lang).orderBy("lang", "__n").collect()
    langs = sorted({r["lang"] for r in sample})
    x = {lang: [_frequencies(r["text"]) for r in sample if r["lang"] == lang] for lang in langs}
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    columns, pairs = [], []
    everything = [(f, v) for f in families for lang in members[f] for v in x[lang]]
    if len(families) > 1:
        for f in families:
            columns.append(_svm([v for _, v in everything], np.array([1 if g == f else -1 for g, _ in everything])))
    for f in families:
        for a, b in combinations(members[f], 2):
            pairs.append((f, a, b))
            columns.append(_svm(x[a] + x[b], np.array([1] * len(x[a]) + [-1] * len(x[b]))))
    weights = np.stack([c[0] for c in columns], axis=1).astype(np.float32) if columns else np.zeros((1 << SLOT_BITS, 0), np.float32)
    return Model(families, members, pairs, weights, np.array([c[1] for c in columns]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). A text that is null or has
    no letter is ``und`` with score 0, as is all if nothing was learned; a
    single learned language has score 1. Only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*cols).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)
    return docs.select(*cols).mapInArrow(run, schema)
