"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character, and none holds a line feed, so no merge
crosses the end of a marked word or a line feed. A text is therefore cut into marked words, each distinct one is
segmented once by the library and kept in a table, and ids and decoded texts are joined back by position.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relomap.llm.common import lean, text_of, tune

#: The library's white-space marker.
MARK = chr(0x2581)
_CHUNK = re.compile(rf"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n+")
#: Characters of keys that a worker's table may hold; a full table starts anew.
TABLE_CHARS = 8_000_000


class ChunkCodec:
    """Encodes and decodes texts exactly as the library does, one table entry per distinct chunk."""

    def __init__(self, path: str) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: dict[str, tuple[bytes, bytes, str]] = {}
        self.held = 0
        self.lead = self.sp.encode("\n")
        self.mark = self.sp.piece_to_id(MARK)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        #: Whether the cuts are safe with this vocabulary; if not, texts are encoded whole.
        self.safe = (
            not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
            and self.mark != self.sp.unk_id()
            and self.lead[:1] == [self.mark]
            and self.sp.encode(f" a  b\t c {MARK}") == self.sp.encode(f"{MARK}a{MARK}{MARK}b\t{MARK}c{MARK} ")
        )

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, after the marker that the library puts before it."""
        return _CHUNK.findall(" " + text) if text else []

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The library's own leading marker stands for the first one of a marked chunk."""
        marked = [c[0] in (" ", MARK) for c in chunks]
        ids = self.sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        return [(i if len(c) > 1 else [self.mark]) if m else i[len(self.lead) :] for i, c, m in zip(ids, chunks, marked, strict=True)]

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Bring all chunks of texts into the table, the new ones in one call; returns each text's chunks."""
        if not self.safe:
            return [[] for _ in texts]
        if self.held > TABLE_CHARS:
            self.table.clear()
            self.held = 0
        cuts = [self.chunks(t) for t in texts]
        new = [c for c in dict.fromkeys(chain.from_iterable(cuts)) if c not in self.table]
        ids = self._segment(new) if new else []
        for c, i, text in zip(new, ids, self.sp.decode(ids, num_threads=1) if new else [], strict=True):
            decoded = " " + text if c[0] in (" ", MARK) else text
            self.table[c] = (array("i", i).tobytes(), ",".join(map(str, i)).encode(), decoded)
        self.held += sum(map(len, new)) + 16 * len(new)
        return cuts

    def entries(self, text: str, cut: list[str] | None = None) -> list[tuple[bytes, bytes, str]]:
        """For each chunk: ids as 32-bit integers, ids as decimals, decoded text."""
        cut = self.chunks(text) if cut is None else cut
        try:
            return list(map(self.table.__getitem__, cut))
        except KeyError:
            self.prepare([text])
            return list(map(self.table.__getitem__, cut))

    def encode(self, text: str) -> np.ndarray:
        if not self.safe:
            return np.array(self.sp.encode(text), dtype=np.int32)
        return np.frombuffer(b"".join(e[0] for e in self.entries(text)), dtype="<i4")

    def decode(self, text: str) -> str:
        """The decoded text of a text's ids."""
        if not self.safe:
            return self.sp.decode(self.sp.encode(text))
        return "".join(e[2] for e in self.entries(text))[1:]

    def digest(self, text: str, cut: list[str] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text."""
        if self.safe:
            found = self.entries(text, cut)
            joined, decoded = b",".join([e[1] for e in found]), "".join([e[2] for e in found])[1:]
        else:
            ids = self.sp.encode(text)
            joined, decoded = ",".join(map(str, ids)).encode(), self.sp.decode(ids)
        n = joined.count(b",") + 1 if joined else 0
        return n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again: ``doc_id``, ``ids``, ``decoded``.

    With ``digests`` the workers return ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of these in their place.

    Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; a text of any
    length is encoded whole; rows with null or repeated ids are rows as any other; an empty table gives an empty result;
    other columns are ignored.
    """
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts = codec.prepare(texts)
            if digests:
                cols = list(zip(*map(codec.digest, texts, cuts), strict=True)) or [(), (), ()]
                arrays, names = [pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                arrays, names = [pa.array([codec.encode(t) for t in texts], type=pa.list_(pa.int32())), pa.array([codec.decode(t) for t in texts], type=pa.string())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, {schema}")


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids as the library does: ``doc_id``, ``text``. A null array or a null id in it counts as absent."""
    tune(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [sp.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    ids = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return encoded.select(F.col(id_col).alias("doc_id"), ids.alias("ids")).mapInArrow(lean(run), f"doc_id {kind}, text string")
