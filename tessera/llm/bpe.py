"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts over ``LONG`` characters are pre-split by a regular expression at safe
boundaries: between a character that is no white space and one that is. No
match of the pre-tokenizing pattern reaches over such a place (its letters,
numbers and symbols never take white space except one space in front, and
only white space runs look ahead), so the parts give the ids of the whole.

Cases: null texts are empty; empty texts have no ids and decode to no bytes;
equal rows stay separate rows; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import texts_of

#: Code points from which a text is cut, and about how many a part has.
LONG, PART = 200_000, 100_000
BOUNDARY = regex.compile(r"(?<=\S)(?=\s)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken rank file, or of the vocabulary of a byte-level BPE in a tokenizers JSON file."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {x["id"] for x in spec.get("added_tokens", [])}
        return {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a tokenizers JSON file adds to its vocabulary."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str, with_added: bool = False):
    """One encoding for each Python worker; every executor reads the file from its own installed copy."""
    import tiktoken

    added = added_tokens(path) if with_added and path.endswith(".json") else {}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens=added)


def parts(text: str, long: int = LONG, part: int = PART) -> Iterator[str]:
    """Cut a long text at the first safe boundary after each ``part`` characters."""
    at = 0
    while len(text) - at > long:
        found = BOUNDARY.search(text, at + part)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def encode_text(encoding, text: str, with_added: bool = False) -> list[int]:
    """The ids of a text; added tokens that it spells out (they hold no white space) have their own only where asked for."""
    ids_of = (lambda t: encoding.encode(t, allowed_special="all")) if with_added else encoding.encode_ordinary
    if len(text) <= LONG:
        return ids_of(text)
    ids: list[int] = []
    for piece in parts(text):
        ids += ids_of(piece)
    return ids


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode_text(encoding, t) for t in texts_of(b, text)], pa.list_(pa.int32()))], [key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary): the raw bytes, which need not be whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoding.decode_bytes(x or []) for x in b.column(1).to_pylist()], pa.binary())], [key, "decoded"])

    rows = encoded.select(key, ids)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() and decode() in one pass that keeps only digests: (key, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(path, pattern)
        decimal = np.array([str(i) for i in range(encoding.max_token_value + 1)], dtype=object).tolist()
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in texts_of(b, text):
                ids = encode_text(encoding, t)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
