"""Chat formatting by token-level assembly.

Each turn is three segments, encoded separately, between reserved ids that no text can produce: a turn's start, its role, the
mark between role and text, the text, the turn's end. The loss mask is a prefix sum: +1 behind the mark of an assistant's turn,
-1 at its end. Strings in a text that look like control strings are escaped with a backslash before they are encoded, so the
decoded text is unambiguous as well, and unescaping gives the text back.

Turns are encoded where they are read; only then are the turns of a conversation brought together in order, and they are
streamed, so a conversation of any number of turns takes the memory of one.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's file splits text; control strings, in the order of their reserved ids.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROL = ("### ", ": ", "</turn>\n")
ASSISTANT = "assistant"
_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
#: Characters from which on a text is cut, at the next place where the pattern cuts it as well: its ids are those of the whole.
PART = 20_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
LIMIT = 64 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Tokens:
    """An encoder with reserved ids for CONTROL behind those of the vocabulary."""

    _made: dict[int, Tokens] = {}

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.base = max(table.values()) + 1
        self.encoder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of(cls, sent) -> Tokens:
        """One encoder for each worker and vocabulary."""
        key = hash(sent.value)
        if key not in cls._made:
            cls._made[key] = cls(sent.value)
        return cls._made[key]

    def encode(self, text: str) -> list[int]:
        out, a = [], 0
        while a < len(text):
            cut = _CUT.search(text, a + PART) if len(text) > a + PART else None
            z = cut.start() if cut else len(text)
            out += self.encoder.encode_ordinary(text[a:z])
            a = z
        return out

    def decode(self, ids) -> str:
        """Ordinary ids only; parts that were cut between characters join up, since bytes are joined first."""
        return self.encoder.decode_bytes(list(ids)).decode("utf-8")

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn, and the steps whose prefix sum is its loss mask."""
        r, t = self.encode(_ESCAPE_ROLE.sub(r"\\\g<0>", role)), self.encode(escape(text))
        ids = np.array([self.base, *r, self.base + 1, *t, self.base + 2], np.int32)
        step = np.zeros(len(ids), np.int8)
        if role == ASSISTANT and len(t):
            step[len(r) + 2], step[-1] = 1, -1
        return ids, step

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        mark = np.flatnonzero(ids == self.base + 1)
        if ids[0] != self.base or ids[-1] != self.base + 2 or len(mark) != 1:
            raise ValueError("not a turn")
        return unescape(self.decode(ids[1 : mark[0]])), unescape(self.decode(ids[mark[0] + 1 : -1]))

    def render(self, ids: np.ndarray) -> str:
        """The formatted string of any ids."""
        out, a = [], 0
        for z in [*np.flatnonzero(ids >= self.base).tolist(), len(ids)]:
            out.append(self.decode(ids[a:z]))
            if z < len(ids):
                out.append(CONTROL[int(ids[z]) - self.base])
            a = z + 1
        return "".join(out)


def _encode(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    tokens = Tokens.of(ranks)
    for b in batches:
        for a in range(0, len(b), 512):
            part = b.slice(a, 512)
            rows = [tokens.turn(r or "", t or "") for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
            # a mask is the running sum of its steps
            masks = [np.cumsum(s).astype(bool) for _, s in rows]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("conv_id", "turn", "role", "text")], pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=["conv_id", "turn", "role", "text", "ids", "loss"])


def vocabulary(spark, path: str):
    """The tokenizer's file, sent to executors: a few megabytes, and checked."""
    if os.path.getsize(path) > LIMIT:
        raise ValueError(f"{path} is larger than {LIMIT} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def format_turns(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, turn, role, text, ids array<int>, loss array<boolean>): each turn's token ids and loss mask.

    A conversation's tokens are those of its turns, by turn (ties by role, then text; nulls first). Null roles and texts are
    empty; an empty text has no token under the mask. Repeated rows are turns of their own. Null conversations are one. Other
    columns are ignored. Empty table: no rows. Texts of any length are encoded whole.
    """
    base = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    kind = dict(base.dtypes)
    return base.mapInArrow(partial(_encode, ranks=vocabulary(turns.sparkSession, tokenizer)), f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string, ids array<int>, loss array<boolean>")


def _digest(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    """Digests of conversations, read back from tokens and masks; rows come by conversation, in order."""
    tokens = Tokens.of(ranks)
    now, state, out = None, None, []

    def done():
        n, turns, chars, loss, formatted, count = state
        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count))

    def flushed():
        kinds = (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        rows = list(zip(*out, strict=True)) or [()] * 7
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    conv_type = pa.int64()
    for b in batches:
        conv_type = b.column(0).type
        for i in range(len(b)):
            conv = b.column(0)[i].as_py()
            if state is None or conv != now:
                if state is not None:
                    done()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            ids, loss = (np.asarray(b.column(c)[i].values) for c in (1, 2))
            role, text = tokens.read(ids)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            trained = unescape(tokens.decode(ids[loss]))
            state[2] += len(trained)
            state[3].update(trained.encode())
            state[4] += len(tokens.render(ids))
            state[5] += len(ids)
        if len(out) >= 1000:
            yield flushed()
    if state is not None:
        done()
    yield flushed()


def digests(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each conversation of format_turns(): sizes and digests of what its tokens and masks say.

    A digest of all turns in order is one task's work for each conversation, however long; its turns stream through it."""
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss")
    return rows.mapInArrow(partial(_digest, ranks=vocabulary(formatted.sparkSession, tokenizer)), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


#: The conversation that the contract adds.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations as they are read back from their tokens. Nulls, ties and repeats: as in format_turns()."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    return digests(format_turns(turns)).drop("n_tokens")


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(14 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
