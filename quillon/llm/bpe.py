"""Byte-level BPE: encoding through a sentencepiece model serialised straight from a rank file, and decoding back.

The rank file maps byte strings to ranks.  ``serialise`` writes a sentencepiece BPE model for it: each piece is the byte
string under the printable byte mapping, scored by its negative rank, at the index that equals its rank; normalisation is
the identity.  Merging the best-scored pair first, leftmost on ties, is then merging the lowest rank first, so the ids
are the ranks.  Pre-tokens (matches of the pattern) are encoded separately; a bounded memo keeps chunks seen before.

Edge cases: a null or empty text gives no ids and decodes to no bytes; repeated rows and ids are encoded one by one; text
of any length is one row and is cut into pre-tokens first, so no merge runs over more than a pre-token; an empty table gives
no rows; other columns, of any names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkMemo, space_chunks
from .common import documents, id_text, slices


def byte_letters() -> list[str]:
    """Printable bytes stand for themselves, the others for the code points from 256 up, in byte order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    assert sorted(ranked) == list(range(len(ranked))), "ranks must be dense"
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: int as varint, float as 32 bits, bytes as a length-delimited value."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto.  The id after the last rank is the unknown piece, which byte pieces never reach."""
    letters = byte_letters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        name = "".join(letters[b] for b in piece).encode()
        out += _field(1, _field(1, name) + _field(2, -float(rank)))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    bpe, identity = 2, b"identity"
    out += _field(2, _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)))
    out += _field(3, _field(1, identity) + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Encodes whole slices of texts: chunks between single spaces through a memo, odd texts by their pre-tokens.

    ``encode_words`` takes a list of pre-tokens and returns the ids of each.
    """

    def __init__(self, encode_words, pattern: str, specials: dict[str, int] | None = None):
        import regex

        self.encode_words, self.find = encode_words, regex.compile(pattern).findall
        self.specials = specials or {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if specials else None
        self.memo = ChunkMemo(self._learn)

    def _pre_tokens(self, text: str) -> list[str]:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        if self.cut and any(x in text for x in self.specials):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.specials else self.find(part))]
        return self.find(text)

    def _learn(self, chunks: list[str], heads: list[bool]):
        parts = [self._pre_tokens(c if head else " " + c) for c, head in zip(chunks, heads, strict=True)]
        words = list(set().union(*parts))
        known = {}
        if self.specials:
            known = {w: [i] for w, i in self.specials.items()}
            words = [w for w in words if w not in known]
        known.update(zip(words, self.encode_words(words), strict=True))
        ids = [[i for w in part for i in known[w]] if len(part) != 1 else known[part[0]] for part in parts]
        return [len(x) for x in ids], [i for x in ids for i in x]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a slice (see ``common.slices``)."""
        starts, ends, first, odd = space_chunks(buf, offsets)
        heads = np.zeros(len(starts) + 1, dtype=bool)
        heads[first[:-1][np.diff(first) > 0]] = True
        start, size = self.memo.find(buf, starts, ends, heads[:-1])
        flat = self.memo.gather(start, size)
        bounds = np.concatenate([[0], np.cumsum(size)])[first]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for row in np.flatnonzero(odd).tolist():
            text = buf[offsets[row] : offsets[row + 1]].tobytes().decode()
            _, ids = self._learn([text], [True])
            out[row] = np.asarray(ids, dtype=np.uint32)
        return out


class Codec:
    """Encoding through the serialised model, decoding by the inverse table."""

    def __init__(self, pieces: list[bytes], pattern: str):
        import sentencepiece

        self.pieces = pieces
        self.names = [str(i) for i in range(len(pieces) + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
        self.table = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.encoder = Encoder(self._encode_words, pattern)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        return self.model.encode([w.encode().decode("latin-1").translate(self.table) for w in words], num_threads=1)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, ``with_ids``, the ids (array<int>).

    Each worker builds the model from the rank file once; the file must be readable there under the same path.
    """

    def run(batches):
        # made for each task: a memo kept by the worker would take memory from the operators that follow
        codec = Codec(load_ranks(path), pattern)
        names = codec.names
        for batch in batches:
            counts, hashes, back, every = [], [], [], []
            for packed in (x for _, buf, offsets in slices(batch, "text") for x in codec.encoder.encode(buf, offsets)):
                ids = packed.tolist()
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    every.append(packed.astype(np.int32))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(every, pa.list_(pa.int32())))
                columns.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE: dict[str, str] = {}
