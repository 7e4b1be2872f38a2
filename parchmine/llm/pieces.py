"""SentencePiece encoding that keeps offsets: normalisation with alignment, segmentation, spans, decoding."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece as spm
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import table

SPACE = "▁"


class CharsMap:
    """A compiled character map: a double-array trie whose values point into a block of zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest mapped prefix of data at `at` and its replacement; (0, None) if there is none."""
        if not self.units:
            return 0, None
        found, value = 0, 0
        node = _offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return (found, self.texts[value : self.texts.index(b"\0", value)]) if found else (0, None)


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map, self.dummy_prefix, self.squeeze = CharsMap(charsmap), dummy_prefix, squeeze
        self.space = SPACE.encode() if escape else b" "

    @property
    def plain(self) -> bool:
        """Whether only spaces change, and a dummy prefix comes first."""
        return not self.map.units and self.dummy_prefix and not self.squeeze and len(self.space) == 3

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        used, text = self.map.longest(data, at)
        return (text, used) if used else (data[at : at + _width(data[at])], min(_width(data[at]), len(data) - at))

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each of them, and their end, the byte of the source that it stems from."""
        data, out, align, at = text.encode(), bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and self._next(data, at)[0] == b" ":
                at += self._next(data, at)[1]
        if at >= len(data):
            return b"", [at]
        if self.dummy_prefix:
            out += self.space
            align += [at] * len(self.space)
        after_space = self.squeeze
        while at < len(data):
            piece, used = self._next(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                new = piece.replace(b" ", self.space)
                out += new
                align += range(at, at + used) if new == data[at : at + used] else [at] * len(new)
                after_space = self.squeeze and piece.endswith(b" ")
            at += used
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = align[-len(self.space)]
                del align[-len(self.space) :]
        return bytes(out), [*align, at]

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """What a call returns, with the alignment as an array; a plain normaliser aligns all bytes at once."""
        if not self.plain or not text:
            out, align = self(text)
            return out, np.array(align)
        data, n = text.encode(), len(self.space)
        source = np.frombuffer(data, np.uint8)
        align = np.repeat(np.arange(len(source)), np.where(source == 32, n, 1))
        return self.space + data.replace(b" ", self.space), np.concatenate((np.zeros(n, align.dtype), align, [len(source)]))


class PieceCodec:
    """Encodes and decodes exactly as the library does with the model, and gives each piece its bytes of the source.

    The library segments; normalisation with its alignment, spans and digests are made here. Where the model's
    normaliser only marks spaces (`plain`), each span is held against its piece besides.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            raw = f.read()
        self.sp = spm.SentencePieceProcessor(model_proto=raw)
        spec = proto.ModelProto.FromString(raw).normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        n = self.sp.get_piece_size()
        texts = [self.sp.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(n)])
        self.bytes = [bytes([int(t[3:5], 16)]) if b else t.encode() for t, b in zip(texts, self.is_byte)]
        self.lengths = np.array([len(b) for b in self.bytes])
        self.newline = self.sp.piece_to_id("<0x0A>")
        self.plain = self.normalizer.plain and bool(self.is_byte.any())  # then nothing is unknown
        self.decimals = [b"%d" % i for i in range(n)]
        self.decoded = [b.replace(SPACE.encode(), b" ") for b in self.bytes]

    def encode(self, text: str | None) -> list[int]:
        return self.sp.encode(text) if text else []

    def digest(self, text: str | None) -> tuple[int, str, str, int]:
        """Tokens, SHA-256 of their ids and of the decoded text, and the bytes of the source that their spans cover."""
        text = text or ""
        ids = self.encode(text)
        decoded = b"".join([self.decoded[i] for i in ids])[1:] if self.plain else self.sp.decode(ids).encode()  # without the dummy prefix
        return len(ids), hashlib.sha256(b",".join([self.decimals[i] for i in ids])).hexdigest(), hashlib.sha256(decoded).hexdigest(), self.covered(text, ids)

    def covered(self, text: str, ids: list[int]) -> int:
        """Bytes of the source in the spans of its ids; where only spaces change, a span counts if its bytes are its piece's."""
        if not ids:
            return 0
        normal, align = self.normalizer.aligned(text)
        ends = self._ends(ids)
        widths = np.diff(align[ends])
        if self.plain:
            pieces = b"".join([self.bytes[i] for i in ids])
            if pieces != normal:
                raise ValueError("the pieces aren't the normalised text")
            prefix = len(self.normalizer.space)
            source, made = np.frombuffer(text.encode(), np.uint8)[align[prefix:-1]], np.frombuffer(pieces, np.uint8)[prefix:]
            wrong = np.flatnonzero((source != made) & (source != 32))
            widths[np.searchsorted(ends, wrong + prefix, "right") - 1] = 0
        return int(widths.sum())

    def _ends(self, ids: list[int]) -> np.ndarray:
        """Where the pieces begin in the normalised text, and where the last one ends."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece; begin and end are bytes of the source text in UTF-8."""
        ids = self.encode(text)
        if not ids:
            return []
        at = self.normalizer.aligned(text)[1][self._ends(ids)].tolist()
        return list(zip(ids, at, at[1:]))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


DIGEST = StructType(
    [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("covered_bytes", LongType())]
)


def encode_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes (source bytes that the spans cover) of each row.

    A null text counts as empty: no tokens, digests of the empty string. Other columns are ignored. The model's path
    must be readable on the executors; texts of any length are encoded whole.
    """

    @pandas_udf(DIGEST)
    def digests(texts: pd.Series) -> pd.DataFrame:
        c = codec(model or default_model())
        return pd.DataFrame([c.digest(t) for t in texts], columns=DIGEST.names)

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")


def encode_spans(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and pieces, an array of (id, begin, end) in bytes of the source text; empty for null or empty texts."""
    piece = StructType([StructField("id", IntegerType()), StructField("begin", LongType()), StructField("end", LongType())])

    @pandas_udf(ArrayType(piece))
    def pieces(texts: pd.Series) -> pd.Series:
        c = codec(model or default_model())
        return pd.Series([[dict(zip(("id", "begin", "end"), p)) for p in c.spans(t)] for t in texts])

    return docs.select("doc_id", pieces("text").alias("pieces"))


def op6_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
