"""A blocked Bloom filter of bounded size, for dropping rows early that an exact join would drop later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mix

#: Bytes of a filter block: eight 32-bit words, one bit set in each.
BLOCK_BYTES = 32
BITS_PER_ENTRY = 16
MAX_FILTER_BYTES = 16 << 20
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def _block(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)


def _masks(h: np.ndarray) -> np.ndarray:
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.uint32(1) << ((low[:, None] * _SALTS[None, :]) >> np.uint32(27))


class BlockedBloom:
    """A split-block Bloom filter over 64-bit hashes, held as an array of eight words per block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def blocks_for(entries: int, limit: int = MAX_FILTER_BYTES) -> int:
        """Blocks for so many entries; never more than ``limit`` bytes, beyond which false positives grow."""
        return int(max(1, min(-(-entries * BITS_PER_ENTRY // (BLOCK_BYTES * 8)), limit // BLOCK_BYTES)))

    @staticmethod
    def build(hashes: DataFrame, n_blocks: int) -> BlockedBloom:
        """From one column of hashes; each task folds its hashes into a partial filter of bounded size."""

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, seen = np.zeros((n_blocks, 8), np.uint32), False
            for batch in batches:
                h = mix(np.asarray(batch.column(0)).view(np.uint64))
                np.bitwise_or.at(words, _block(h, n_blocks), _masks(h))
                seen |= len(h) > 0
            if seen:
                used = np.flatnonzero(words.any(axis=1))
                packed = words.view(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(packed[used, i]) for i in range(4))], ["block", "w0", "w1", "w2", "w3"])

        parts = hashes.mapInArrow(fold, "block bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
        rows = parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))).toArrow()
        words = np.zeros((n_blocks, 4), np.int64)
        at = np.asarray(rows.column("block"))
        for i in range(4):
            words[at, i] = np.asarray(rows.column(f"w{i}"))
        return BlockedBloom(words.view(np.uint32).reshape(n_blocks, 8))

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = mix(hashes.view(np.uint64))
        masks = _masks(h)
        return ((self.words[_block(h, len(self.words))] & masks) == masks).all(axis=1)


def filter_of(keys: DataFrame, limit: int = MAX_FILTER_BYTES):
    """A broadcast filter of one column of 64-bit hashes."""
    n = keys.count()
    return keys.sparkSession.sparkContext.broadcast(BlockedBloom.build(keys, BlockedBloom.blocks_for(n, limit)).words)
