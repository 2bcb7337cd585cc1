"""Canonical length-limited Huffman codes, and blocks of ids that are coded with them, for numpy."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: A block begins with: ids, bits, ids a checkpoint. Bit offsets of the checkpoints follow, then the coded bits.
_HEAD = struct.Struct("<qqi")
#: Ids that are coded in one step.
CACHED = 1 << 14


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The code length of each id, `limit` bits at most, 0 where its count is 0; no other lengths within the
    limit code the counts in fewer bits (package-merge: each round pairs off the cheapest sums of the round before, and the
    cheapest 2n - 2 of the last tell how often each id is taken)."""
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    out = np.zeros(len(counts), np.int32)
    if n < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    own = counts[used].astype(np.int64)
    merged, rounds = own, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        rounds.append(order < n)
    take, length = 2 * n - 2, np.zeros(n, np.int32)
    for single in reversed(rounds):
        ids = int(single[:take].sum())
        length[:ids] += 1
        take = 2 * (take - ids)
    out[used] = length
    return out


@dataclass(frozen=True)
class Code:
    """A canonical code: ids in the order of (length, id) have rising codes, so that lengths say it all."""

    length: np.ndarray
    code: np.ndarray
    limit: int
    next_id: np.ndarray  # by the next `limit` bits
    next_length: np.ndarray  # 0: no id has these bits

    @staticmethod
    def of(length: np.ndarray, limit: int) -> Code:
        order = np.lexsort((np.arange(len(length)), length))
        order = order[length[order] > 0]
        span = 1 << (limit - length[order].astype(np.int64))
        first = np.cumsum(span) - span
        code = np.zeros(len(length), np.uint64)
        code[order] = (first >> (limit - length[order])).astype(np.uint64)
        next_id, next_length = np.zeros(1 << limit, np.int32), np.zeros(1 << limit, np.int32)
        next_id[: span.sum()] = np.repeat(order, span)
        next_length[: span.sum()] = np.repeat(length[order], span)
        return Code(length.astype(np.int64), code, limit, next_id, next_length)

    def write(self, ids: np.ndarray, every: int) -> bytes:
        """A block of ids, with the bit offset of each `every`-th one."""
        size = int(self.length[ids].sum())
        words, marks, bits = np.zeros((size + 31) // 32 + 1, np.uint64), [], 0
        for some in range(0, len(ids), CACHED):  # what a step works on stays in the processor's cache
            own = ids[some : some + CACHED]
            length = self.length[own]
            at = np.cumsum(length)
            at += bits - length
            # each code lies in one 32-bit word or in two; codes do not overlap, so words are sums
            value = self.code[own] << (64 - length - (at & 31)).view(np.uint64)
            word = at >> 5
            first = np.flatnonzero(np.diff(word, prepend=-1))
            word = word[first]
            words[word] += np.add.reduceat(value >> np.uint64(32), first)
            words[word + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
            marks.append(at[-some % every :: every])
            bits = int(at[-1] + length[-1])
        marks = np.concatenate(marks) if marks else np.zeros(0)
        return _HEAD.pack(len(ids), bits, every) + marks.astype("<u4").tobytes() + words[:-1].astype(">u4").tobytes()

    def read(self, block: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The block's ids from begin to end: only checkpoints that cover them are decoded, all at the same time, an
        id of each in a step."""
        n, bits, every = _HEAD.unpack_from(block)
        end = n if end is None else min(end, n)
        if begin >= end:
            return np.zeros(0, np.int32)
        marks = -(-n // every)
        at = np.frombuffer(block, "<u4", marks, _HEAD.size).astype(np.int64)[begin // every : -(-end // every)]
        words = np.frombuffer(block, ">u4", (bits + 31) // 32, _HEAD.size + 4 * marks).astype(np.uint64)
        words = np.append(words, np.zeros(2, np.uint64))
        wide = (words[:-1] << np.uint64(32)) | words[1:]
        steps = min(every, n - begin // every * every)
        out = np.empty((steps, len(at)), np.int32)
        mask, room = np.uint64((1 << self.limit) - 1), 64 - self.limit
        for k in range(steps):
            key = (wide[np.minimum(at >> 5, len(wide) - 1)] >> (room - (at & 31)).astype(np.uint64)) & mask
            out[k] = self.next_id[key]
            step = self.next_length[key]
            if not step.all() and (at[step == 0] < bits).any():
                raise ValueError("these bits are no code of this table")
            at += step
        whole = out.T.ravel()
        skip = begin - begin // every * every
        return whole[skip : skip + end - begin]


def crc_join(first: int, second: int, size: int) -> int:
    """The crc32 of two byte strings one after the other, from theirs and the second's size: appending a zero
    byte is linear over bits, and so is its power."""
    def times(a: int, b: int) -> int:
        out = 0
        for _ in range(32):
            if a & 0x80000000:
                out ^= b
            a = (a << 1) & 0xFFFFFFFF
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    shift, power = 0x80000000, 0x00800000  # x^0 and x^8, lowest power in the highest bit
    while size:
        if size & 1:
            shift = times(shift, power)
        power = times(power, power)
        size >>= 1
    return times(first, shift) ^ second
