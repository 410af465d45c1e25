"""Byte-level BPE with tiktoken: encode whole texts, decode to raw bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import json

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_texts, table

#: A match never runs from a character other than white space into a space, so a text may be cut there.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
#: White space as the pattern has it (Unicode's property); a run of over LONG_SPACE characters is matched here, as its backtracking has a limit.
LONG_SPACE = 65_536
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}+" % LONG_SPACE)


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file (``base64 rank`` lines) or of a JSON vocabulary of the same kind."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(map(to_byte.__getitem__, token)): rank for token, rank in vocab.items()}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The strings that a JSON vocabulary takes whole, wherever they stand, and their ids; a rank file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


def encode_with_added(text: str | None, enc: tiktoken.Encoding, added: dict[str, int]) -> np.ndarray:
    """The ids of a whole text, in which each string of added has its own id; what is between is encoded as by ``encode``."""
    if not text or not any(a in text for a in added):
        return encode(text, enc)
    parts = regex.split("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return np.concatenate([np.array([added[p]], np.uint32) if k % 2 else encode(p, enc) for k, p in enumerate(parts)])


def _encode_in_pieces(text: str, enc: tiktoken.Encoding, piece: int) -> list[np.ndarray]:
    parts, at = [], 0
    while at < len(text):
        cut = _SAFE.search(text, at + piece) if len(text) - at > piece else None
        end = cut.start() if cut else len(text)
        parts.append(enc.encode_to_numpy(text[at:end], disallowed_special=()))
        at = end
    return parts


def encode(text: str | None, enc: tiktoken.Encoding, piece: int = 1 << 16) -> np.ndarray:
    """The ids of a whole text, special tokens' strings being ordinary text.

    Texts longer than ``piece`` characters are cut at the first safe boundary after each ``piece``;
    a stretch without one stays whole. Of a run of over LONG_SPACE white-space characters all but the last are one match (all, at
    the end of the text), which is encoded by itself. NULL and the empty text have no ids.
    """
    text = text or ""
    if len(text) <= piece:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for run in _SPACES.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += _encode_in_pieces(text[at : run.start()], enc, piece)
        parts.append(np.array(enc._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
        at = end
    return np.concatenate([np.empty(0, np.uint32), *parts, *_encode_in_pieces(text[at:], enc, piece)])


def encode_texts(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with ``to``, an array of ids, in place of its text column; other columns pass unchanged."""

    def each(texts: list) -> tuple:
        enc = encoding(path)
        return None, [[encode(t, enc) for t in texts]]

    return map_texts(docs, text, f"{to} array<bigint>", each)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """rows with ``to``, the raw bytes that the ids stand for, in place of ids (NULL: no bytes).

    Bytes need not be UTF-8: cut id sequences decode to cut characters.
    """

    def each(batch: list) -> tuple:
        enc = encoding(path)
        return None, [[enc.decode_bytes(x or []) for x in batch]]

    return map_texts(rows.withColumn(ids, F.coalesce(ids, F.array().cast("array<bigint>"))), ids, f"{to} binary", each)


def roundtrip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` for every row of docs.

    The digests are of the ids in decimal, joined by one space, and of the bytes that they decode
    to. NULL counts as empty: no ids, digests of nothing. Keys may be NULL or repeat; other columns
    of docs are not read. Empty input, empty result.
    """

    def each(texts: list) -> tuple:
        enc = encoding(path)
        decimal = [str(k) for k in range(enc.n_vocab)]
        counts, coded, decoded = [], [], []
        for t in texts:
            ids = encode(t, enc).tolist()
            counts.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return None, [counts, coded, decoded]

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_texts(rows, "t", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", each).withColumnRenamed("k", key)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
