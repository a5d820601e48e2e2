"""Which datastore a (subject, predicate) goes to, and the arithmetic of ranks and datastores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .encoding import little_endian

WORD = 0xFFFFFFFF


def _bytes(c: Column) -> Column:
    """Unsigned bytes as array<bigint>; [] for an empty value."""
    b = c.cast("binary")
    each = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(F.length(b) > 0, each).otherwise(F.array().cast("array<bigint>"))


def _word_bytes(kind: str, size: int):
    def run(values: pd.Series) -> pd.Series:
        flat = values.to_numpy(kind).tobytes()
        return pd.Series([flat[size * i : size * (i + 1)] for i in range(len(values))])

    return lambda c: F.pandas_udf(run, "binary")(c)


def machine_bytes(c: Column, kind: str) -> Column:
    """The bytes of a native value as a machine word, lowest first; of any other type, the value's own bytes. Null stays null."""
    if kind in ("INT32", "UINT32", "INT64", "UINT64"):
        return F.when(c.isNotNull(), little_endian(c, 4 if kind.endswith("32") else 8))
    if kind in ("FLOAT", "DOUBLE"):
        return F.when(c.isNotNull(), (_word_bytes("<f4", 4) if kind == "FLOAT" else _word_bytes("<f8", 8))(F.coalesce(c.cast(kind.lower()), F.lit(0.0).cast(kind.lower()))))
    return c.cast("binary")


def _fold(values: Column, seed, step) -> Column:
    return F.aggregate(values, F.lit(seed).cast("long") if isinstance(seed, int) else seed, lambda h, x: step(h, x).bitwiseAND(F.lit(WORD)))


def _shl(h: Column, n: int) -> Column:
    return F.shiftleft(h, n)


def _shr(h: Column, n: int) -> Column:
    return F.shiftright(h, n)


def byte_sum(s: Column, p: Column) -> Column:
    return F.aggregate(F.concat(_bytes(s), _bytes(p)), F.lit(0).cast("long"), lambda h, x: h + x)


def times_33(s: Column, p: Column) -> Column:
    """Bernstein's: times 33, plus each byte."""
    return _fold(F.concat(_bytes(s), _bytes(p)), 0, lambda h, x: h * 33 + x)


def shift_add_xor(s: Column, p: Column) -> Column:
    return _fold(F.concat(_bytes(s), _bytes(p)), 0, lambda h, x: h.bitwiseXOR((_shl(h, 5) + _shr(h, 2) + x).bitwiseAND(F.lit(WORD))))


def fnv_1a(s: Column, p: Column) -> Column:
    return _fold(F.concat(_bytes(s), _bytes(p)), 2166136261, lambda h, x: h.bitwiseXOR(x) * 16777619)


def one_at_a_time(s: Column, p: Column) -> Column:
    """Jenkins's, with its last mixing after the subject and again after the predicate."""

    def part(values, seed):
        def step(h, x):
            h = (h + x).bitwiseAND(F.lit(WORD))
            h = (h + _shl(h, 10)).bitwiseAND(F.lit(WORD))
            return h.bitwiseXOR(_shr(h, 6))

        def end(h):
            h = (h + _shl(h, 3)).bitwiseAND(F.lit(WORD))
            h = h.bitwiseXOR(_shr(h, 11))
            return (h + _shl(h, 15)).bitwiseAND(F.lit(WORD))

        start = F.lit(seed).cast("long") if isinstance(seed, int) else seed
        return F.aggregate(values, start, step, end)

    return part(_bytes(p), part(_bytes(s), 0))


def _padded(values: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, filled with zeros to one more than the longest's whole units; and their lengths."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    width = (int(sizes.max(initial=0)) // unit + 1) * unit
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), sizes


#: Shifts of Jenkins's mixing, three rounds: right, left, right. These, the golden ratio 0x9E3779B9, Hsieh's shifts and both
#: seeds below are fixed values of the published hashes.
JENKINS_SHIFTS = ((13, 8, 13), (12, 16, 5), (3, 10, 15))


def _jenkins(values: list[bytes], h: np.ndarray) -> np.ndarray:
    """Bob Jenkins's hash of 12-byte units over all rows at once; ``h`` is each row's hash so far."""
    rows, sizes = _padded(values, 12)
    words = rows.reshape(len(values), -1, 3, 4).view("<u4")[..., 0].astype(np.uint32)
    state = [np.full(len(values), 0x9E3779B9, np.uint32), np.full(len(values), 0x9E3779B9, np.uint32), h.astype(np.uint32)]
    whole = sizes // 12
    for k in range(words.shape[1]):
        live, last = k <= whole, k == whole
        a, b, c = (x.copy() for x in state)
        w = words[:, k]
        a += w[:, 0]
        b += w[:, 1]
        # The last unit's third word leaves its lowest byte to the length.
        c += np.where(last, (w[:, 2] << np.uint32(8)) + sizes.astype(np.uint32), w[:, 2])
        for right, left, right2 in JENKINS_SHIFTS:
            a = (a - b - c) ^ (c >> np.uint32(right))
            b = (b - c - a) ^ (a << np.uint32(left))
            c = (c - a - b) ^ (b >> np.uint32(right2))
        state = [np.where(live, new, old) for new, old in zip((a, b, c), state, strict=True)]
    return state[2]


def _hsieh(values: list[bytes], h: np.ndarray) -> np.ndarray:
    """Paul Hsieh's hash of 4-byte units over all rows at once."""
    rows, sizes = _padded(values, 4)
    halves = rows.reshape(len(values), -1, 2, 2).view("<u2")[..., 0].astype(np.uint32)
    u = np.uint32
    h, whole, rest = h.astype(np.uint32), sizes // 4, sizes % 4
    for k in range(halves.shape[1]):
        x = h + halves[:, k, 0]
        x = (x << u(16)) ^ ((halves[:, k, 1] << u(11)) ^ x)
        h = np.where(k < whole, x + (x >> u(11)), h)
    tail = rows.reshape(len(values), -1, 4)[np.arange(len(values)), whole].astype(np.uint32)
    low = tail[:, 0] + (tail[:, 1] << u(8))
    three = h + low
    three = (three ^ (three << u(16))) ^ (tail[:, 2] << u(18))
    two = (h + low) ^ ((h + low) << u(11))
    one = (h + tail[:, 0]) ^ ((h + tail[:, 0]) << u(10))
    h = np.select([rest == 3, rest == 2, rest == 1], [three + (three >> u(11)), two + (two >> u(17)), one + (one >> u(1))], h)
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h = h ^ (h << u(left))
        h = h + (h >> u(right))
    return h


def _batched(f, seed: int):
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, p in parts:
            with np.errstate(over="ignore"):
                h = f([bytes(x or b"") for x in s], np.full(len(s), seed, np.uint32))
                yield pd.Series(f([bytes(x or b"") for x in p], h).astype(np.int64))

    return lambda s, p: F.pandas_udf(run, "long")(s.cast("binary"), p.cast("binary"))


jenkins = _batched(_jenkins, 0xFEEDBEEF)
hsieh = _batched(_hsieh, 0xCAFEBABE)

#: Hash functions by name; each gives an unsigned 32-bit value (the sum: any size) of (s, p).
HASHES = {
    "SUM_MOD_DATASTORES": byte_sum,
    "UTHASH_BER": times_33,
    "UTHASH_SAX": shift_add_xor,
    "UTHASH_FNV": fnv_1a,
    "UTHASH_OAT": one_at_a_time,
    "UTHASH_JEN": jenkins,
    "UTHASH_SFH": hsieh,
    "XXHASH64": lambda s, p: F.xxhash64(s, p),
}


def datastore(name_or_function, s: Column, p: Column, n: int, rank: Column | None = None, s_type: str = "BYTE", p_type: str = "BYTE") -> Column:
    """The datastore (0 to n - 1) of a key by a named hash or by a function of (s, p).

    Parts of a native type (see encoding.TYPES) hash by their machine word's bytes; without a type, by their text's.
    """
    if name_or_function == "DATASTORE_0":
        return F.lit(0)
    if name_or_function == "RANK_MOD_DATASTORES":
        return F.pmod(F.spark_partition_id() if rank is None else rank, F.lit(n)).cast("int")
    f = HASHES[name_or_function] if isinstance(name_or_function, str) else name_or_function
    s, p = (c if kind == "BYTE" else machine_bytes(c, kind) for c, kind in ((s, s_type), (p, p_type)))
    return F.pmod(f(s, p), F.lit(n)).cast("int")


def is_server(rank: Column, size: Column, client: int, server: int) -> Column:
    """1 where a rank is a range server, 0 where not, -1 where it is no rank."""
    if client <= 0 or server <= 0:
        return F.lit(-1)
    return F.when((rank < 0) | (rank >= size), -1).when(rank % client < server, 1).otherwise(0)


def server_rank(id_: Column, size: Column, client: int, server: int) -> Column:
    """The rank of a range server's id; -1 where there is none."""
    if client <= 0 or server <= 0:
        return F.lit(-1)
    rank = id_ if server >= client else (F.floor(id_ / server) * client + id_ % server).cast("int")
    return F.when((id_ < 0) | (rank >= size), -1).otherwise(rank)


def server_id(rank: Column, size: Column, client: int, server: int) -> Column:
    """The range server's id of a rank; -1 where the rank is none."""
    if client <= 0 or server <= 0:
        return F.lit(-1)
    id_ = rank if server >= client else (F.floor(rank / client) * server + rank % client).cast("int")
    return F.when((rank < 0) | (rank >= size) | ((rank % client >= server) if server < client else F.lit(False)), -1).otherwise(id_)


def datastore_rank(id_: Column, size: Column, client: int, server: int, per_server: int) -> Column:
    if per_server <= 0:
        return F.lit(-1)
    return F.when(id_ < 0, -1).otherwise(server_rank(F.floor(id_ / per_server).cast("int"), size, client, server))


def datastore_id(rank: Column, offset: Column, size: Column, client: int, server: int, per_server: int) -> Column:
    at = server_id(rank, size, client, server)
    return F.when((at < 0) | (offset < 0) | (offset >= per_server), -1).otherwise(at * per_server + offset)


def server_count(size: Column, client: int, server: int) -> Column:
    if client <= server:
        return size
    return (F.floor(size / client) * server + F.least(size % client, F.lit(server))).cast("int")
