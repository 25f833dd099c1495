"""Token counts of sections: whole documents are encoded once, tokens are attributed by their spans."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, small_batches, texts_of

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict[str, tuple] = {}
#: White space as the pattern reads it, in runs that its matcher cannot take back step by step.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def _encoding(ranks: bytes, pattern: str):
    """The encoder and the bytes of each token; built once in a worker."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, k in table.items():
            sizes[k] = len(token)
        _ENCODINGS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes
    return _ENCODINGS[key]


def encode(encoder, text: str, pattern: str = PATTERN) -> list[int]:
    """Token numbers of a whole text.

    The pattern takes a run of white space but its last character, or all of it at the
    end of a text, as one piece.  Its matcher keeps a step of the stack for each
    character, so with the standard pattern long runs are cut out here and encoded as
    the piece that they are; the tokens are the same.
    """
    out: list[int] = []
    at = 0
    for m in _BLANKS.finditer(text) if pattern == PATTERN else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoder.encode_ordinary(text[at : m.start()])
        out += encoder._encode_single_piece(text[m.start() : end].encode())
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def line_sections(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the lines with their line breaks; an empty text has none."""
    out, at = [], 0
    while at < len(text):
        end = text.find(b"\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def attribute(token_ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, boundary-crossing tokens) of each section, by an interval join of sorted spans.

    A token belongs to the section that holds most of its bytes, of equal shares to
    the earlier one; it crosses if it has bytes in more than one section, and then
    counts as crossing where it belongs.  Sections are sorted and do not overlap; a
    token outside all of them belongs to none.
    """
    n = len(sections)
    tokens, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(token_ends):
        return tokens, crossing
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(sections[:, 1], starts, "right")  # the first section that ends after the token begins
    last = np.searchsorted(sections[:, 0], token_ends, "left") - 1  # the last that begins before it ends
    inside = first == last
    tokens += np.bincount(first[inside], minlength=n)
    for i in np.flatnonzero(first < last).tolist():
        own = np.arange(first[i], last[i] + 1)
        share = np.minimum(sections[own, 1], token_ends[i]) - np.maximum(sections[own, 0], starts[i])
        k = own[int(share.argmax())]
        tokens[k] += 1
        crossing[k] += 1
    return tokens, crossing


def count_sections(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN, sections=line_sections) -> DataFrame:
    """Per document and section ``doc_id``, ``section`` (from 0), ``n_bytes``, ``n_tokens``, ``n_crossing`` and ``doc_tokens``.

    The whole text is encoded once with a byte-level vocabulary, so that token spans
    are running sums of token sizes and the counts of all sections of a text add up
    to ``doc_tokens`` where the sections cover it, as lines do.  A null or empty text
    gives one row with null section and zeros.  Repeated rows keep their rows.  The
    vocabulary file (under a megabyte) is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, kind) for c in ("_bytes", "_tokens", "_crossing")], T.StructField("doc_tokens", T.LongType())])

    def run(parts):
        encoder, sizes = _encoding(shared.value, pattern)
        for b in batches(parts):
            out: list[tuple] = []
            for text in texts_of(b.column("text")):
                text = text or b""
                ids = encode(encoder, text.decode("utf-8", "replace"), pattern)
                spans = np.array(sections(text), np.int64).reshape(-1, 2)
                tokens, crossing = attribute(np.cumsum(sizes[ids]), spans)
                out.append((spans[:, 1] - spans[:, 0], tokens, crossing, len(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in range(3)], pa.array([o[3] for o in out], pa.int64())], names=schema.names)

    counted = docs.select("doc_id", "text").mapInArrow(run, schema)
    each = counted.select("doc_id", "doc_tokens", F.posexplode_outer(F.arrays_zip("_bytes", "_tokens", "_crossing")).alias("section", "s"))
    return each.select("doc_id", F.col("section").cast("long").alias("section"), *[F.coalesce(F.col(f"s._{c}"), F.lit(0)).cast("long").alias(f"n_{c}") for c in ("bytes", "tokens", "crossing")], "doc_tokens")
