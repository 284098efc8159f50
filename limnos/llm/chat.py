"""Chat formatting: typed content parts flattened by a visitor into a template.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside
texts are escaped: ``<`` followed by any number of backslashes and ``|`` gets
one more backslash, which reading takes away again, so no text can open or
close a turn or pose as a placeholder. Images, audio and documents become
placeholders that count as many tokens as the model spends on them.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.common import partitions

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_WORD = re.compile("[^\x20\x09-\x0D]+")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: backslash and line feed are escaped as well."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def _said(value) -> str:
    """A value of a part as text; halves of surrogate pairs, which JSON may
    hold alone, become ``?``."""
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _size(value, least: int) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        return least
    return min(max(number, least), 2.0 ** 31) if math.isfinite(number) else least


def _parts(content, text: str | None) -> list:
    """The parts of a row: an array, JSON text of one (or of a single part),
    else the row's text. Text that is no JSON is one text part."""
    if isinstance(content, str):
        try:
            content = json.loads(content)
        except (ValueError, RecursionError):
            content = [{"type": "text", "text": content}]
    if content is None:
        return [{"type": "text", "text": text}]
    return content if isinstance(content, list) else [content]


@dataclass
class Flattener:
    """Visitor over content parts; collects text, attachments and tokens.

    A part is a mapping with ``type`` and, by type, ``text``; ``ref`` with
    ``width``/``height`` (image, a token per started 28 x 28 patch), ``seconds``
    (audio, 25 tokens a second) or ``pages`` (document, 256 tokens a page).

    Defined cases: a part without a type is text; a null part says nothing;
    text outside a mapping is a text part, any other value a text part of its
    JSON; an unknown type becomes a placeholder ``unknown`` of no tokens whose
    reference names the type; sizes that are missing, no number, not finite or
    not above 0 count as the least size (audio: 0 s, others: 1), those above
    2^31 as 2^31.
    """

    patch: int = 28
    audio_rate: int = 25
    page_tokens: int = 256
    text: list[str] = field(default_factory=list)
    attachments: list[str] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part) -> None:
        if part is None:
            return
        if not isinstance(part, dict):
            part = {"text": part}
        kind = part.get("type") or "text"
        known = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        (known.get(kind, self.visit_unknown) if isinstance(kind, str) else self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = _said(part.get("text"))
        self.text.append(escape(text))
        self.tokens += len(_WORD.findall(text))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.text.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append(f"{kind}:{_said(part.get('ref'))}")
        self.tokens += tokens

    def visit_image(self, part: dict) -> None:
        tiles = [math.ceil(_size(part.get(side), 1) / self.patch) for side in ("width", "height")]
        self._attach("image", part, tiles[0] * tiles[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(_size(part.get("seconds"), 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, math.ceil(_size(part.get("pages"), 1)) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        self._attach("unknown", {"ref": f"{_said(part['type'])}:{_said(part.get('ref'))}"}, 0)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[str], int]:
    """A turn's formatted text, the range of its content in it, attachment
    references in order, expanded tokens."""
    f = Flattener()
    for p in parts:
        f.visit(p)
    head, body = f"{START}{escape_role(role)}\n", "".join(f.text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body), f.attachments, f.tokens


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role of each row with ``formatted``, the loss mask's
    range in it (``loss_start``, ``loss_end``; empty unless the role is
    assistant), ``attachments`` and expanded ``tokens``.

    Content is the column ``parts`` (an array of structs, or JSON text of one)
    where there is one and it isn't null, else ``text`` as one text part;
    ``Flattener`` says what unknown and malformed parts become. A
    null text is an empty one, a null role an empty role; every row is a turn,
    repeated ones too; no rows give none; other columns are not read.
    """
    has_parts = "parts" in turns.columns
    schema = (turns.select("conv_id", "turn", "role").schema.add("formatted", "string").add("loss_start", "long")
              .add("loss_end", "long").add("attachments", T.ArrayType(T.StringType())).add("tokens", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            parts = b.column("parts").to_pylist() if has_parts else [None] * len(texts)
            rows = []
            for role, text, p in zip(roles, texts, parts, strict=True):
                done, a, z, refs, n = format_turn(role or "", _parts(p, text))
                rows.append((done, a, z if role == "assistant" else a, refs, n))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "turn", "role")], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], schema.names)
    return turns.select("conv_id", "turn", "role", "text", *(["parts"] if has_parts else [])).mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``format_turns``' rows: turns
    are taken by turn (null last), then text, and parsed from the formatted
    text. Rows arrive sorted and are hashed as they pass, so that memory holds
    one batch however long a conversation is. A null conv_id is one
    conversation; no rows give none."""
    schema = formatted.select("conv_id").schema
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)
    ids = formatted.select("conv_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close():
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*done, strict=True)) or [()] * 6
            types = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.names)
            done.clear()
            return out
        for b in batches:
            for conv, text, a, z in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")], strict=True):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                lost = unescape(text[a:z])
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += len(text)
            yield flush()
        if state is not None:
            close()
            yield flush()
    n = partitions(formatted)
    dealt = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition(n, "conv_id")
    return dealt.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "formatted").mapInArrow(run, schema)
