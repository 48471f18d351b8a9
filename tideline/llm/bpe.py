"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, whole_text

#: A text is cut between any other character and white space. No match of the splitting
#: pattern spans such a place, and none looks ahead over it.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
PIECE = 1 << 16
#: What the pattern's \\s stands for. A run of it that something follows is one match up to its last
#: character, which begins the next match; at the end of a text all of it is one match.
SPACES = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str, pattern: str, size: int = PIECE) -> np.ndarray:
    """Token ids (unsigned 32-bit) of a whole text, special tokens being ordinary text.

    Long runs of white space, on which the library's matcher runs out of its stack, are matched
    here and merged by the library as the one match that they are.
    """
    enc, parts, at = encoding(path, pattern), [], 0
    for run in SPACES.finditer(text):
        parts += [enc.encode_to_numpy(x, disallowed_special=()) for x in pieces(text[at : run.start()], size)]
        at = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(np.array(enc._encode_single_piece(text[run.start() : at]), np.uint32))
    parts += [enc.encode_to_numpy(x, disallowed_special=()) for x in pieces(text[at:], size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(ids.tolist())


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the token ids (array of long) of every whole text; null text encodes as empty."""
    path, pattern = (path, pattern) if path and pattern else rank_file()

    def run(batches):
        for b in batches:
            ids = [encode(t.decode("utf-8", "replace"), path, pattern).astype(np.int64) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every whole text; one narrow pass, one row per input row.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (decoded bytes). Null and empty texts give 0 tokens and the digest of
    nothing. Repeated rows repeat their result; other columns are ignored. Long texts are cut
    at places that no match spans; runs of one kind of character need none.
    """
    path, pattern = (path, pattern) if path and pattern else rank_file()

    def run(batches):
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for raw in as_bytes(b.column(1)):
                ids = encode(raw.decode("utf-8", "replace"), path, pattern)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, DIGESTS)
