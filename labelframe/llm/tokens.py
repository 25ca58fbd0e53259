"""Operator 3: token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

``Engine`` gives the ids of a byte-level BPE tokenizer file exactly as the library ``tokenizers`` does. Texts within
Latin-1 go through the same vocabulary in ``tiktoken``, which is some times faster and gives equal ids there: within Latin-1 both libraries' Unicode tables
agree. Other texts go to the library itself, as do texts with words of more than ``LONGEST_WORD`` characters (merging takes time by the square of a word's length in ``tiktoken``) or
runs of a thousand white spaces (its pattern looks ahead from each of them, down to the end of its stack).

``Engine.encode_long`` hands chunks to the library. Neighbouring chunks overlap, and offsets (the running
sums of the tokens' byte lengths) place their tokens. They are spliced at a position p between two characters of different kinds: letter, digit, mark, ASCII white space, but for white space before another kind
and an apostrophe before a letter. There p is stable: each alternative of the pre-tokenizer's pattern takes characters of one kind, after one space or apostrophe at most, so p ends a
pre-token whatever stands around it, and merges never cross pre-tokens; positions inside a special token's string are left out; hence the ids of the whole are those before p and those after
it. Letters and marks are those of ranges that all Unicode tables know. If the overlap holds no such position that is a token boundary of both chunks, it is widened, at last to the whole chunk, and then the chunk
grows: only a run without any such position (a word of tens of thousands of letters, one pre-token) goes to the library whole, since its merges depend on all of it.

Defined results: a null text counts as empty (no bytes, no tokens); every row is counted by itself, repeated ones and those with a null id too; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import table, text_or_empty

CHUNK, OVERLAP, LONGEST_WORD = 1 << 16, 256, 2000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Engine:
    """Ids of byte-level BPE. ``ranks_path`` (same vocabulary as ranks) is optional."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.n_bytes = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
        for token, i in vocab.items():  # each character stands for a byte
            self.n_bytes[i] = len(token)
        for token, i in special.items():
            self.n_bytes[i] = len(token.encode())
        self.special, self.fast = frozenset(special), None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` in one piece, without tokens added around it."""
        if self.fast is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                if len(text) <= LONGEST_WORD or (max(map(len, text.split()), default=0) <= LONGEST_WORD and not _GAP.search(text)):
                    return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def stable(self, text: str, start: int, end: int) -> Iterator[int]:
        """Stable positions with ``start`` < p < ``end``, the last first."""
        for p in [m.start() for m in _STABLE.finditer(text, start + 1, end)][::-1]:
            if not any(t in text[max(0, p - len(t) + 1) : p + len(t) - 1] for t in self.special):
                yield p

    def encode_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ids of ``text``, no more than about a chunk of it encoded at once where it has stable positions."""
        out, begin, size = [], 0, chunk
        ids = self.encode(text[:size])  # of text[begin:end], or spliced from the chunk before
        end = min(len(text), size)
        while end < len(text):
            ends = np.cumsum(self.n_bytes[ids])
            wide, splice = min(overlap, end - begin), None
            while splice is None:
                start = end - wide
                nxt_end = min(len(text), start + size)
                if nxt_end <= end:
                    nxt_end = min(len(text), end + size)
                nxt = self.encode(text[start:nxt_end])
                nxt_starts = np.cumsum(self.n_bytes[nxt]) - self.n_bytes[nxt]
                for p in self.stable(text, start, end):
                    left, right = len(text[begin:p].encode()), len(text[start:p].encode())
                    i, j = np.searchsorted(ends, left), np.searchsorted(nxt_starts, right)
                    if i < len(ends) and ends[i] == left and j < len(nxt) and nxt_starts[j] == right:
                        splice = i + 1, j, p
                        break
                if splice is None and start == begin:
                    break
                wide = min(2 * wide, end - begin)
            if splice is None:  # no stable position at all: a longer chunk
                size *= 2
                end = min(len(text), begin + size)
                ids = self.encode(text[begin:end])
            else:
                out.append(ids[: splice[0]])
                ids, begin, end = nxt[splice[1] :], splice[2], nxt_end
        return np.concatenate([*out, ids]) if out else ids

    def ids(self, text: str, chunk: int = CHUNK) -> np.ndarray:
        return self.encode(text) if len(text) <= chunk else self.encode_long(text, chunk)


_GAP = re.compile(r"\s{1000}")
#: Letters, and marks but the apostrophe, as ranges of characters that are such in every Unicode table.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-Яа-яא-תء-غक-हก-ฮぁ-ゖァ-ヺ一-龥가-힣"
MARKS = re.escape(string.punctuation.replace("'", "")) + "、。，！？；：「」『』（）《》…—–“”«»"
_STABLE = re.compile(rf"(?<=[{LETTERS}])(?=[0-9'{MARKS} \t\n\r])|(?<=[0-9])(?=[{LETTERS}'{MARKS} \t\n\r])|(?<=['{MARKS}])(?=[0-9 \t\n\r])|(?<=[{MARKS}])(?=[{LETTERS}])")


@lru_cache(maxsize=4)
def engine(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Engine:
    """One engine for each Python worker."""
    return Engine(json_path, ranks_path, pattern)


def default_engine() -> tuple[str, str, str]:
    """Arguments of ``engine`` for the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, tokenizer: tuple, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row's whole text; ``tokenizer``: the arguments of ``engine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = engine(*tokenizer)
        for batch in batches:
            counts = pa.array([len(encoder.ids(x.as_py(), chunk)) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=[id_col, "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_engine())
