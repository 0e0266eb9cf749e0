"""Token counts with the tokenizers library, in Arrow functions that return lengths only.

Texts are cut at safe boundaries into pieces of about ``PIECE_BYTES`` of UTF-8 and encoded in calls of at most ``CALL_BYTES``, so a call's
memory is bounded by bytes, not rows. A boundary is safe behind a letter that something other than a letter follows: in the
byte-level pattern a run of letters, with a space before it, is always a pre-token that ends there; merges never leave a pre-token;
and the pattern never looks back. So the pieces' lengths add up to the text's. Letters are those of ``_LETTERS``, scripts with cases or
without; what may follow is white space, digits and punctuation. No boundary lies within or beside a special token's
string. A text without such a place, one run of letters or of blanks, is a single pre-token or nearly so, and is encoded whole. One map, no shuffle.

Null or empty text: 0 bytes, 0 tokens; an empty table gives an empty result. Each row is counted by itself; repeated rows, and rows of one
or no id, give each its own result. There are no ties.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import slices

PIECE_BYTES, CALL_BYTES = 1 << 15, 1 << 19
#: Letters of every Unicode version: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0904-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SAFE = re.compile(f"(?<=[{_LETTERS}])(?=[\\x20-\\x40\\x5b-\\x60\\x7b-\\x7e\\t\\n\\r\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b\u300c\u300d\u0964])")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def _special(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def pieces(text: str, path: str, size: int = PIECE_BYTES) -> Iterator[str]:
    """The text in pieces of ``size`` bytes of UTF-8 or a little more, where it has safe boundaries."""
    n_bytes = len(text.encode())
    step = max(1, size * len(text) // max(1, n_bytes))  # characters of a piece
    special, at, seek = _special(path), 0, step
    while n_bytes > size and len(text) - at > step and (m := _SAFE.search(text, seek)):
        cut = m.start()
        near = text[max(0, cut - 64) : cut + 64]
        if any(s in near for s in special):
            seek = cut + 1
            continue
        yield text[at:cut]
        at, seek = cut, cut + step
    yield text[at:]


def count_batch(texts: list[str | None], path: str) -> list[int]:
    tokenizer, out = _tokenizer(path), [0] * len(texts)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for i, e in zip(owners, tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            out[i] += len(e.ids)
        parts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in pieces(text, path) if text else ():
            n_bytes = len(part.encode())
            if parts and held + n_bytes > CALL_BYTES:
                flush()
                held = 0
            parts.append(part)
            owners.append(i)
            held += n_bytes
    if parts:
        flush()
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text), with the tokenizer file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = pa.array(count_batch(b.column("text").to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
