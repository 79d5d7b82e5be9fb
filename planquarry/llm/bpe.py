"""BPE encoding and decoding with a distinct-word table.

Every batch of documents is split into words; each word that the table lacks is encoded once, and the
ids are joined back to the documents by position. Decoding looks every id up in an id-to-piece table,
whose size is the vocabulary's. The word table belongs to a Python worker, is bounded in bytes, and
is only a table: it decides nothing about results.

A table over the whole corpus, joined by shuffle, moves every (block, word) pair and the texts; see the
README for why it is kept per worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import frugal, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that a worker's word table holds, by estimate, before it starts anew; an entry costs ENTRY besides its word.
TABLE_BYTES = 192 << 20
ENTRY = 160


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; a full path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(tokenizer, prefix: str):
    """Ids of many words, each encoded alone by the library."""
    return lambda words: [e.ids for e in tokenizer.encode_batch_fast([prefix + w for w in words], add_special_tokens=False)]


#: How byte-level vocabularies of this kind cut text into words: a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of these signs are their own NFC form and are cut alike by both regular-expression libraries.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


def _part_encoder(path: str, tokenizer):
    """As `_encoder`, for a lower-casing tokenizer with word ends: plain words are cut into the pre-tokenizer's parts,
    each distinct part is encoded once, many in one call, and the ids are split after the pieces that end a word."""
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
    suffix = spec["model"]["end_of_word_suffix"]
    ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
    for piece, i in spec["model"]["vocab"].items():
        ends[i] = piece.endswith(suffix)
    spec |= {"normalizer": None, "added_tokens": []}
    spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    bare = Tokenizer.from_str(json.dumps(spec))
    whole = _encoder(tokenizer, "")

    def encode(words: list[str]) -> list[list[int]]:
        # Most words are letters only and so are one part.
        found: list = [None] * len(words)
        table: dict = {}
        cut_up, rest = [], []
        for k, w in enumerate(words):
            if not _PLAIN.fullmatch(w) or "<|" in w:
                rest.append(k)
                continue
            w = w.lower()
            if w.isalpha():
                found[k] = w
                table[w] = ()
            else:
                parts = cut(w)
                cut_up.append((k, parts))
                for x in parts:
                    table[x] = ()
        names = list(table)
        calls = [" ".join(names[i : i + 500]) for i in range(0, len(names), 500)]
        ids = [i for e in bare.encode_batch_fast(calls, add_special_tokens=False) for i in e.ids]
        stops = (np.flatnonzero(ends[np.array(ids, np.int64)]) + 1).tolist() if ids else []
        if len(stops) != len(names):
            return whole(words)
        at = 0
        for name, stop in zip(names, stops):
            table[name] = ids[at:stop]
            at = stop
        found = [w and table[w] for w in found]
        for k, parts in cut_up:
            found[k] = [i for x in parts for i in table[x]]
        for k, one in zip(rest, whole([words[k] for k in rest])):
            found[k] = one
        return found

    return encode


#: Text of these signs is cut alike by the libraries' regular-expression engines.
_SIMPLE = re.compile("[\\n -~\u00a1-\u024f]*")


def _byte_encoder(path: str, tokenizer, prefix: str):
    """As `_encoder`, for a byte-level BPE whose ids are in merge order: simple words go to a faster library
    that gets the same pieces as ranks."""
    import tiktoken

    look = pieces(path)
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    plain = {x: i for i, x in enumerate(look) if x.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding(path, pat_str=WORD_PATTERN, mergeable_ranks=plain, special_tokens={}).encode_ordinary
    whole = _encoder(tokenizer, prefix)

    def encode(words: list[str]) -> list[list[int]]:
        found = [fast(prefix + w) if _SIMPLE.fullmatch(w) and "<|" not in w else None for w in words]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(rest, whole([words[k] for k in rest])):
            found[k] = ids
        return found

    return encode


class WordTable(dict):
    """word (UTF-8 bytes) -> row of a table of id lists. A missing word is noted, and encoded with others of its batch."""

    def __init__(self, path: str, prefix: str = "", parts: bool = False):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode = _part_encoder(path, self.tokenizer) if parts else _byte_encoder(path, self.tokenizer, prefix)
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.rows, self.used, self.held = 0, 0, 0
        self.starts, self.lengths = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.flat = np.empty(4096, np.int32)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = self.rows + len(self.pending)
        self.pending.append(word)
        self.held += len(word) + ENTRY
        return row

    def _encode_pending(self) -> None:
        found = self.encode([w.decode("utf-8") for w in self.pending])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        end, size = self.rows + len(found), int(lengths.sum())
        while end > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        while self.used + size > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.lengths[self.rows : end] = lengths
        self.starts[self.rows : end] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + size] = np.fromiter(chain.from_iterable(found), np.int32, size)
        self.rows, self.used, self.pending = end, self.used + size, []

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids end to end, and how many each has."""
        if self.held > TABLE_BYTES:
            self._empty()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            self._encode_pending()
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[rows] - ends + lengths, lengths)], lengths

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_TABLES: dict = {}


def word_table(path: str, prefix: str = "", parts: bool = False) -> WordTable:
    if (path, prefix, parts) not in _TABLES:
        _TABLES[path, prefix, parts] = WordTable(path, prefix, parts)
    return _TABLES[path, prefix, parts]


#: A cut before a space is a word boundary unless white space stands on both sides of it.
_WIDE_GAP = re.compile(r"\s \s|\s $|^ $")


def encode_byte_level(texts: list[str], path: str, per: int = 64) -> Iterator[np.ndarray]:
    """Ids of each text for a byte-level BPE whose words take one leading space.

    Words are the text's parts between single spaces, each with the space before it. Texts with
    wide gaps (white space on both sides of a space) or with special strings go to the library whole.
    """
    spaced, first = word_table(path, " "), word_table(path)
    special = [t.content for t in first.tokenizer.get_added_tokens_decoder().values()]
    for at in range(0, len(texts), per):
        heads, words, counts, wholes = [], [], [], {}
        for k, text in enumerate(texts[at : at + per]):
            if _WIDE_GAP.search(text) or any(s in text for s in special):
                wholes[k] = np.array(first.whole(text), np.int32)
                parts = [b""]
            else:
                parts = text.encode("utf-8").split(b" ")
            heads.append(parts[0])
            words += parts[1:]
            counts.append(len(parts) - 1)
        head_ids, head_lengths = first.lookup(heads)
        ids, lengths = spaced.lookup(words)
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        head_ends = np.append(0, np.cumsum(head_lengths))
        for k in range(len(heads)):
            if k in wholes:
                yield wholes[k]
            else:
                yield np.concatenate([head_ids[head_ends[k] : head_ends[k + 1]], ids[ends[k] : ends[k + 1]]])


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table of a byte-level vocabulary: the bytes of every id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Byte-level vocabularies write printable bytes as themselves and the others, in order, from code point 256.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    to_byte = {chr(b): b for b in plain}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * (max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), 0) + 1)
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def encode(docs: DataFrame, path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, ids array<int>) of whole texts; null text is empty, empty text has no ids, repeated rows stay."""

    @frugal

    def run(batches):
        for b in batches:
            ids = list(encode_byte_level(b.column(1).fill_null("").to_pylist(), path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [row_id, "ids"])

    kind = dict(docs.dtypes)[row_id]
    return docs.select(row_id, text).mapInArrow(run, f"`{row_id}` {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, row_id: str = "doc_id") -> DataFrame:
    """(row_id, text) of id lists, through the id-to-piece table."""

    @frugal

    def run(batches):
        look = pieces(path)
        for b in batches:
            texts = [b"".join(map(look.__getitem__, x or ())).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [row_id, "text"])

    kind = dict(rows.dtypes)[row_id]
    return rows.select(row_id, "ids").mapInArrow(run, f"`{row_id}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Encode, then decode, in one pass: (row_id, n_tokens, ids_sha256, decoded_sha256)."""

    @frugal

    def run(batches):
        look = pieces(path)
        signs = [b"%d," % i for i in range(len(look))]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for found in encode_byte_level(b.column(1).fill_null("").to_pylist(), path):
                ids = found.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b"".join(map(signs.__getitem__, ids))[:-1]).hexdigest())
                decoded = b"".join(map(look.__getitem__, ids)).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [row_id, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)[row_id]
    return docs.select(row_id, text).mapInArrow(run, f"`{row_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded text of all `documents`. Null and empty texts have no ids, very long texts are encoded whole,
    repeated rows stay, an empty table gives no rows."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {"op6_bpe": op6_bpe}
