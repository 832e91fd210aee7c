"""Token ids in the fewest bits that hold the vocabulary.

Ids of a document are packed little-endian, least bit first, in blocks of
``BLOCK`` ids.  Every block starts at a byte, so a block or a single id can be
read without its predecessors, and unpacking is numpy throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .vocabulary import FOLDER, load

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 1024


def width_of(size: int) -> int:
    """Bits for ids below ``size``, one at least."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits (57 at most), least bit first; the last byte is filled with zeros."""
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    raw = ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8]
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack(payload: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes: id k lies in the bytes from bit k * width on."""
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)])
    bit = np.arange(n, dtype=np.int64) * width
    byte = bit >> 3
    out = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def block_bytes(width: int, block: int = BLOCK) -> int:
    """Bytes from one block's start to the next."""
    return -(-block * width // 8)


def pack_blocks(ids: np.ndarray, width: int, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """(payload, the byte at which each block starts)."""
    offsets = list(range(0, -(-len(ids) // block) * block_bytes(width, block), block_bytes(width, block)))
    if block * width % 8 == 0:
        return pack(ids, width), offsets
    return b"".join(pack(ids[k : k + block], width) for k in range(0, len(ids), block)), offsets


def read_ids(payload: bytes, offsets: list[int], width: int, n: int, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """Ids start:stop of a document of n, touching only the blocks that hold them."""
    start, stop = max(0, min(start, n)), max(0, min(stop, n))
    out = []
    for b in range(start // block, -(-stop // block)):
        have = min(block, n - b * block)
        part = unpack(payload[offsets[b] : offsets[b] + block_bytes(width, block)], width, have)
        out.append(part[max(0, start - b * block) : max(0, stop - b * block)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def file_position(docs: DataFrame):
    """Where each row lies in the files that docs is read from, as one number in the order of the files' numbers and rows; null if it is not read from numbered files.

    A file that Spark writes has its partition's number (part-00007-...) and,
    if that is cut, a count (-c001) in its name.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long")
    where = number(r"^part-(\d+)-") * (1 << 40) + F.coalesce(number(r"-c(\d+)[.]"), F.lit(0)) * (1 << 32) + F.col("_metadata.row_index")
    try:
        docs.select(where).schema  # noqa: B018
    except AnalysisException:
        return F.lit(None).cast("long")
    return where


def packed_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = FOLDER, block: int = BLOCK) -> DataFrame:
    """(doc_id, position, n_tokens, bit_width, block_offsets, payload) for every row, without a shuffle.

    ``position`` is the row's place in the files that docs is read from (null
    for a table that is not), so the order in which a mixed corpus was written
    is the order of position.

    A null or empty text has no token, no block and an empty payload; a very
    long one has its ids in as many blocks as it needs.  A null id stays null.
    Rows that repeat are packed each.  Other columns, whatever their names,
    are not read.  An empty table gives no row.
    """

    def work(keys: pa.Array, texts: list) -> dict:
        v = load(vocabulary, folder)
        width = width_of(v.size)
        coded = v.encode([t or "" for t in texts])
        made = [pack_blocks(np.array(x, np.uint64), width, block) for x in coded]
        return {"doc_id": keys.field(0), "position": keys.field(1), "n_tokens": [len(x) for x in coded], "bit_width": [width] * len(coded), "block_offsets": [x for _, x in made], "payload": [x for x, _ in made]}

    keyed = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), file_position(docs).alias("position")).alias("key"), F.col(text_col).alias("text"))
    return map_texts(keyed, "key", "text", work, "doc_id long, position long, n_tokens long, bit_width int, block_offsets array<long>, payload binary")
