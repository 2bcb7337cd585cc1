"""Column functions over binary descriptors held as arrays of 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def descriptor(vector: Column, pairs: list[tuple[int, int]]) -> Column:
    """Bit k of the result is vector[p_k] < vector[q_k]; words of 64 bits, the last filled with 0."""
    at, to = F.array(*[F.lit(p) for p, _ in pairs]), F.array(*[F.lit(q) for _, q in pairs])

    def word(start: int) -> Column:
        def add(word: Column, k: Column) -> Column:
            less = F.get(vector, F.get(at, k + F.lit(start))) < F.get(vector, F.get(to, k + F.lit(start)))
            return word.bitwiseOR(F.call_function("shiftleft", F.coalesce(less, F.lit(False)).cast("bigint"), k))

        last = min(64, len(pairs) - start) - 1
        return F.aggregate(F.sequence(F.lit(0), F.lit(last)), F.lit(0).cast("bigint"), add)

    return F.array(*[word(start) for start in range(0, len(pairs), 64)])


def hamming(a: Column, b: Column, words: int = 4) -> Column:
    """Differing bits of two descriptors of `words` words."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def substring_key(words: Column, table: int, bits: int) -> Column:
    """Bits [table * bits, (table + 1) * bits) of a descriptor; they may cross a word's end."""
    at = table * bits
    word, shift = divmod(at, 64)
    key = F.shiftrightunsigned(F.get(words, F.lit(word)), shift)
    if shift + bits > 64:
        key = key.bitwiseOR(F.shiftleft(F.get(words, F.lit(word + 1)), 64 - shift))
    return key.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def substring_keys(words: Column, tables: int, bits: int) -> Column:
    """Array of struct(table_id, key), one for each hash table."""
    return F.array(*[F.struct(F.lit(t).alias("table_id"), substring_key(words, t, bits).alias("key")) for t in range(tables)])


def neighbour_keys(key: Column, bits: int, depth: int) -> Column:
    """All keys that differ from `key` in at most `depth` bits, itself included, without repeats."""
    keys = F.array(key)
    for _ in range(depth):
        flips = F.transform(
            keys, lambda k: F.array(*[k.bitwiseXOR(F.lit(1 << i).cast("bigint")) for i in range(bits)])
        )
        keys = F.array_distinct(F.concat(keys, F.flatten(flips)))
    return keys


def similarity(distance: Column, covariance: float = 900.0, floor: float = 10.0) -> Column:
    """exp(-max(floor, distance)^2 / covariance)."""
    d = F.greatest(distance.cast("double"), F.lit(floor))
    return F.exp(-(d * d) / F.lit(covariance))


def cell_hash(cx: Column, cy: Column, cz: Column, primes: tuple[int, int, int] = (73856093, 19349663, 83492791)) -> Column:
    """XOR of the coordinates times three primes, as a 64-bit number."""
    a, b, c = (x.cast("bigint") * F.lit(p).cast("bigint") for x, p in zip((cx, cy, cz), primes, strict=True))
    return a.bitwiseXOR(b).bitwiseXOR(c)
