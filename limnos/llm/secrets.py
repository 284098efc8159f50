"""Secret scans: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over all keywords reads each text once; patterns
run only anchored at its hits. Long hexadecimal runs have no keyword and are
found as runs of bytes. Kinds whose tokens carry a checksum are kept only
where it holds. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from limnos.llm.common import numbered
from limnos.llm.words import text_bytes

BASE_KINDS = ("assign", "access", "hex")
#: order of kinds that start at one place
KINDS = (*BASE_KINDS, "github", "npm", "jwt")

_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(payload: str, width: int = 6) -> str:
    """CRC-32 of the payload as base-62 digits, the checksum at the end of
    GitHub's and npm's tokens."""
    n, out = zlib.crc32(payload.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(width, "0")


def _crc_holds(m: re.Match) -> bool:
    body = m[0][4:]
    return base62_crc(body[:-6]) == body[-6:]


def _jwt_holds(m: re.Match) -> bool:
    """Both leading parts decode to JSON objects; the first names an algorithm."""
    try:
        head, claims = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in m[0].split(".")[:2])
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(claims, dict)


#: keyword in lower case -> kind
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
             "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
             "npm_": "npm", "eyj": "jwt"}
#: kind -> its pattern, what must hold of a match
_RULES = {"assign": (_ASSIGN, lambda m: len(m[1]) >= 8), "access": (_ACCESS, lambda m: len(m[0]) >= 16),
          "github": (_GITHUB, _crc_holds), "npm": (_NPM, _crc_holds), "jwt": (_JWT, _jwt_holds)}
_HEX_LEAST = 32


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _hex_runs(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of runs of [0-9a-f], cut at document borders, long enough."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ((raw >= 0x30) & (raw <= 0x39)) | ((raw >= 0x61) & (raw <= 0x66))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    cut = np.unique(borders[1:-1])
    cut = cut[inside[cut] & inside[cut + 1]]
    start, end = np.sort(np.concatenate([edges[0::2], cut])), np.sort(np.concatenate([edges[1::2], cut]))
    long = end - start >= _HEX_LEAST
    return start[long], end[long]


def scan_batch(texts: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text, by start, then kind."""
    raw, borders = text_bytes(texts)
    hex_start, hex_end = _hex_runs(raw, borders)
    first = np.searchsorted(hex_start, borders)
    machine = _automaton()
    data = raw.tobytes()
    for i in range(len(borders) - 1):
        body = data[borders[i]:borders[i + 1]]
        # bytes.lower() changes A-Z only; one character a byte keeps offsets
        hits = list(machine.iter(body.lower().decode("latin-1")))
        spans = []
        runs = range(first[i], first[i + 1])
        if hits or len(runs):
            text = body.decode()
            plain = len(text) == len(body)

            # runs come in order, so each decodes only what lies behind the last
            last_byte = last_char = 0
            for r in runs:
                a, z = int(hex_start[r] - borders[i]), int(hex_end[r] - borders[i])
                last_char += a - last_byte if plain else len(body[last_byte:a].decode())
                spans.append(("hex", last_char, last_char + z - a))
                last_byte, last_char = z, last_char + z - a
            done = dict.fromkeys(_RULES, 0)
            where = sorted((end + 1 - length, kind) for end, (kind, length) in hits)
            last_byte = last_char = 0
            for byte, kind in where:
                last_char += byte - last_byte if plain else len(body[last_byte:byte].decode())
                last_byte = byte
                pattern, holds = _RULES[kind]
                if last_char >= done[kind] and (m := pattern.match(text, last_char)):
                    done[kind] = m.end()  # a match that fails its test still takes its place
                    if holds(m):
                        spans.append((kind, m.start(), m.end()))
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        yield spans


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the secrets of each whole text: counts of the base kinds,
    base_sha256 over the base spans' list, spans with all kinds.

    Base kinds match leftmost without overlap within a kind, and matches too
    short are dropped. The method adds tokens with a right checksum (github,
    npm) and decodable JSON web tokens (jwt). Null and empty texts have no spans;
    repeated rows give repeated results, an empty table none; a text of any
    length is scanned whole, in one pass; other columns are not read.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for spans in scan_batch(b.column("text")):
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append([*[sum(s[0] == k for s in base) for k in BASE_KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)])
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    schema = docs.select("doc_id").schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    return docs.select("doc_id", "text").mapInArrow(scan, schema.add("base_sha256", "string").add("spans", "string"))


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans joined, under the first one's kind."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[KIND]``; n_chars,
    where there is one, follows. Texts without a secret stay as they are: null
    and empty ones too. Rows, repeated ones included, and other columns stay."""
    cols = docs.columns
    text = cols.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            changed = {}
            for i, spans in enumerate(scan_batch(b.column(text))):
                if spans:
                    parts, end = [], 0
                    for kind, a, z in merged(spans):
                        parts += [texts[i][end:a], f"[{kind.upper()}]"]
                        end = z
                    changed[i] = "".join([*parts, texts[i][end:]])
            out = dict(zip(cols, b.columns, strict=True))
            if changed:
                out["text"] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], out["text"].type)
                if "n_chars" in out:
                    n = out["n_chars"].to_pylist()
                    out["n_chars"] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(n)], out["n_chars"].type)
            yield pa.RecordBatch.from_pydict(out)
    return numbered(docs).mapInArrow(clean, docs.schema)
