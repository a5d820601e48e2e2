"""Repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes when a string of SPAN bytes that covers it also starts anywhere else. Texts are not compared as wholes: each
string of SPAN bytes belongs to an anchor, the smallest hash of GRAM bytes in it, and equal strings have equal anchors.
Around an anchor lies a segment, all strings that belong to it. Segments are counted by kind (their digest) before anything
moves; of every kind that has several, two go, with each other kind of its anchor that can share a string with another, into
a bucket of bounded size, and a Burrows-Wheeler transform of the bucket tells, by backward extension in breadth, which of
their strings repeat. Digests only choose what is sent; bytes decide. Segments overlap; where neighbours in one text meet
neighbours in another (or the same), they go as one stretch. An anchor with very many kinds of segments is first split by
longer and longer common cores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, per_text, scratch, small_batches

SPAN, GRAM = 200, 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(29).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)
#: Bytes of segments in a bucket, kinds of segments an anchor may bring into one, and what its strings may be apart from a core of a split.
BUCKET_BYTES, KINDS, STEPS = 3 << 18, 2500, (42, 21, 10, 5, 2, 1)
#: Each string holds one of CORES cores, which have SPAN - CORE_STEP bytes and start a multiple of CORE_STEP bytes before its anchor.
CORES, CORE_STEP = 4, (SPAN - GRAM) // 4
#: A stretch ends where its first text passes a multiple of this many bytes.
STRETCH = 1 << 13
#: A text is read in parts of this many bytes, overlapping by SPAN - 1; parts are hashed together up to about so many bytes.
PART, TOGETHER = 1 << 22, 1 << 17


def _longer(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice the length, from hashes of ``step`` bytes."""
    x = h[:-step] * _M1
    x += h[step:]
    x ^= x >> np.uint64(29)
    x *= _M2
    return x


def anchors(parts: list[bytes], named: bool = True) -> tuple[np.ndarray, ...]:
    """Of byte strings (SPAN bytes at least each): hash of each anchor, and if ``named`` the number of its part, its place there, first
    and last window start it holds, digest of the segment, and 16 bits of a digest of each core (0: no window of the segment has it).

    Every window of SPAN bytes belongs to the leftmost smallest hash of GRAM bytes in it, which depends on the window
    alone: two equal windows belong to anchors of equal hash, at the same distance, and agree in a core.
    """
    b = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h, size = _BYTE[b], 1
    while size < GRAM:
        h = _longer(h, size)
        size *= 2
    hashes = h
    key = (h & ~_LOW) | np.arange(h.size, dtype=np.uint64)
    width, size = SPAN - GRAM + 1, 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: key.size - (width - size)], key[width - size :])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], key.size] - 1
    at = (key[first] & _LOW).astype(np.int64)
    # Windows across two parts belong to no one.
    part = np.searchsorted(starts, at, side="right") - 1
    first, last = np.maximum(first, starts[part]), np.minimum(last, ends[part] - SPAN)
    inside = first <= last
    part, at, first, last = part[inside], at[inside], first[inside], last[inside]
    if not named:
        return (hashes[at],)
    g, size = hashes, GRAM
    while size < 128:
        g = _longer(g, size)
        size *= 2
    end = last + SPAN
    d = (g[first] * _M1 + g[(first + end - 128) // 2]) * _M2
    d ^= d >> np.uint64(31)
    d = (d * _M1 + g[end - 128] + ((at - first) * 512 + (end - at)).astype(np.uint64)) * _M2
    d ^= d >> np.uint64(32)
    cores = np.zeros(at.size, np.uint64)
    for k in range(CORES):
        lo = at - k * CORE_STEP
        has = (lo >= first) & (lo - CORE_STEP <= last)
        lo = lo[has]
        x = (g[lo] * _M1 + g[lo + SPAN - CORE_STEP - 128]) * _M2 >> np.uint64(48)
        cores[has] |= np.maximum(x, np.uint64(1)) << np.uint64(16 * k)
    at0 = starts[part]
    return hashes[at], part, at - at0, first - at0, last - at0, d, cores


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of a byte array in the order of their next ``depth`` bytes (or more), by ranks of two or three times the length."""
    n = t.size
    key, size = np.zeros(n, np.uint64), 8
    for k in range(min(8, n)):
        key[: n - k] |= t[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    bits = n.bit_length()
    times = 3 if 3 * bits < 64 else 2  # so many ranks fit into a key
    while size < depth:
        rank = np.zeros(n + (times - 1) * size, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        # Only ranks that several places share are sorted on.
        alone = new & np.r_[new[1:], True]
        at = np.flatnonzero(~alone)
        place = order[at]
        key = rank[place]
        for k in range(1, times):
            key = key << bits | rank[place + k * size]
        step = np.argsort(key)
        order[at] = place[step]
        sorted_key = key[step]
        new[at] = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        size *= times
    return order


def repeated_starts(segments: list[bytes], span: int = SPAN) -> list[np.ndarray]:
    """For each segment: the starts of its strings of ``span`` bytes that start anywhere else too, in any segment.

    Segments may not hold the byte 255 (no UTF-8 text does): it ends each of them. Breadth first, all strings of one
    length at a time, intervals of the suffix order are extended by each byte that precedes their suffixes. The first
    interval to end at a place shows how much the suffixes on either side share. Places that no string shorter than
    ``span`` ends at are left: there the two suffixes share ``span`` bytes.
    """
    t = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    n = t.size
    order = suffix_order(t, span)
    before = t[order - 1]
    to = np.empty(n, np.int64)  # the place of the suffix that starts one byte earlier
    to[np.argsort(before, kind="stable")] = np.arange(n)
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(span):
        if not lo.size:
            break
        one = hi - lo == 1
        single = lo[one]
        single = to[single[before[single] != 255]]
        lows, highs = [single], [single + 1]
        lo, hi = lo[~one], hi[~one]
        if lo.size:
            sizes = hi - lo
            owner = np.repeat(np.arange(lo.size), sizes)
            idx = np.arange(owner.size) + np.repeat(lo - np.cumsum(sizes) + sizes, sizes)
            key = owner << 8 | before[idx]
            edge = np.flatnonzero(key[1:] != key[:-1])
            first, last = np.r_[0, edge + 1], np.r_[edge, key.size - 1]
            run = key[first]
            by = np.argsort(run, kind="stable")
            run, first, last = run[by], first[by], last[by]
            head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            tail = np.r_[head[1:], run.size] - 1
            good = (run[head] & 255) != 255
            lows.append(to[idx[first[head[good]]]])
            highs.append(to[idx[last[tail[good]]]] + 1)
        lo, hi = np.concatenate(lows), np.concatenate(highs)
        fresh = ~parted[hi]
        lo, hi = lo[fresh], hi[fresh]
        parted[hi] = True
    shared = ~parted[:-1] | ~parted[1:]
    places = np.sort(order[shared])
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes + 1) - 1
    owner = np.searchsorted(ends, places, side="left")
    valid = places + span <= ends[owner]
    places, owner = places[valid] - (ends - sizes)[owner[valid]], owner[valid]
    return np.split(places, np.cumsum(np.bincount(owner, minlength=len(segments)))[:-1])


def _keyed(docs: DataFrame) -> DataFrame:
    """uid, text, and doc_id where it differs: uid is doc_id where that is unique and never null, else a number given once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, m = rows.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == m:
        return rows.withColumnRenamed("doc_id", "uid")
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()))


def _anchor_rows(rows: DataFrame, named: bool = True) -> DataFrame:
    """h; if ``named``: uid, pos, back (of the segment's first byte from the anchor), fwd (of its last string's start from its first), d, cores."""
    small_batches(rows.sparkSession)
    kinds = {"h": pa.int64()} | ({"uid": pa.int64(), "pos": pa.int64(), "back": pa.int16(), "fwd": pa.int16(), "d": pa.int64(), "cores": pa.int64()} if named else {})

    def made(parts):
        h, *more = anchors([p for _, _, p in parts], named)
        if not named:
            return [h.view(np.int64)]
        part, at, first, last, d, cores = more
        uid, lo = (np.array(x, np.int64)[part] for x in ([p[0] for p in parts], [p[1] for p in parts]))
        return [h.view(np.int64), uid, at + lo, at - first, last - first, d.view(np.int64), cores.view(np.int64)]

    def run(batches):
        for batch in batches:
            out, parts, size = [], [], 0
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = text.encode()
                for lo in range(0, len(b) - SPAN + 1, PART - SPAN + 1):
                    parts.append((uid, lo, b[lo : lo + PART]))
                    size += len(parts[-1][2])
                    if size >= TOGETHER:
                        out.append(made(parts))
                        parts, size = [], 0
            if parts:
                out.append(made(parts))
            arrays = [pa.array(np.concatenate(x)).cast(k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)] if out else [pa.array([], k) for k in kinds.values()]
            yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return rows.select("uid", "text").mapInArrow(run, "h long" + (", uid long, pos long, back short, fwd short, d long, cores long" if named else ""))


def _packed(rows: DataFrame) -> DataFrame:
    """uid and the text's bytes, compressed before they are dealt out."""

    def setup():
        c = zstandard.ZstdCompressor(level=3)
        return lambda texts: ([c.compress(t.encode()) for t in texts],)

    return per_text(rows, "text", ["uid"], setup, "z binary")


def _kinds(members: DataFrame) -> DataFrame:
    """h, d, x, y: the first and the last segment of each kind, of those kinds that can share a string with another segment.

    A kind with one segment can only where it agrees with another kind of its anchor in a core.
    """
    row = F.struct("uid", "pos", "back", "fwd")
    kinds = cut(members.groupBy("h", "d").agg(F.min(row).alias("x"), F.max(row).alias("y"), F.min("cores").alias("cores")))
    core = [F.shiftrightunsigned("cores", 16 * k).bitwiseAND(F.lit(65535)) for k in range(CORES)]
    cores = kinds.select("h", "d", (F.col("x") == F.col("y")).alias("alone"), F.posexplode(F.array(*core)).alias("k", "core")).filter("core != 0")
    shared = cores.groupBy("h", "k", "core").count().filter("count > 1").select("h", "k", "core")
    near = cores.filter("alone").join(shared, ["h", "k", "core"]).select("h", "d").distinct()
    kinds = kinds.select("h", "d", "x", "y")
    return kinds.filter("x != y").unionByName(kinds.filter("x = y").join(near, ["h", "d"], "left_semi"))


def _wanted(kinds: DataFrame) -> DataFrame:
    """uid, g, d, lo, n, back, own: the bytes to send, each a segment (own is null) or a stretch of them.

    An anchor that has two segments to send is a pair of places. Pairs of the same texts whose segments follow each other in
    both make two stretches, one in each; ``own`` lists h, d and last start in the stretch of their segments. No string is in two of them.
    """
    rows = cut(kinds.select("h", "d", F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).select("h", "d", "z.*", (F.col("z.pos") - F.col("z.back")).alias("lo")))
    row = F.struct("uid", "lo", (F.col("lo") + F.col("fwd")).alias("hi"), "d")
    anchor = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("x"), F.max(row).alias("y")))
    many = rows.join(anchor.filter("n > 2").select("h"), "h", "left_semi")
    single = many.select("uid", F.col("h").alias("g"), "d", "lo", (F.col("fwd") + SPAN).cast("int").alias("n"), F.col("back").cast("int").alias("back"), F.lit(None).cast("array<struct<h:bigint,d:bigint,last:int>>").alias("own"))
    pairs = anchor.filter("n = 2").select("h", "x", "y", F.col("x.uid").alias("xu"), F.col("y.uid").alias("yu"), F.col("x.lo").alias("lo"))
    by = Window.partitionBy("xu", "yu").orderBy("lo")
    follows = (F.col("lo") == F.lag("x.hi").over(by) + 1) & (F.col("y.lo") == F.lag("y.hi").over(by) + 1) & (F.floor(F.col("lo") / STRETCH) == F.floor(F.lag("lo").over(by) / STRETCH))
    pairs = pairs.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("k", F.sum("new").over(by))
    sides = pairs.select("xu", "yu", "k", "h", F.posexplode(F.array("x", "y")).alias("side", "z")).select("xu", "yu", "k", "side", F.struct("z.lo", "z.hi", "h", "z.d").alias("z"))
    made = sides.groupBy("xu", "yu", "k", "side").agg(F.array_sort(F.collect_list("z")).alias("own"), F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"))  # of one stretch
    stretch = made.select(
        F.when(F.col("side") == 0, F.col("xu")).otherwise(F.col("yu")).alias("uid"),
        F.xxhash64("xu", "yu", "k").alias("g"),
        F.col("side").cast("long").alias("d"),
        "lo",
        (F.col("hi") - F.col("lo") + SPAN).cast("int").alias("n"),
        F.lit(0).alias("back"),
        F.transform("own", lambda z: F.struct(z["h"].alias("h"), z["d"].alias("d"), (z["hi"] - F.col("lo")).cast("int").alias("last"))).alias("own"),
    )
    return single.unionByName(stretch)


def _segments(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, d, back, seg, and hs, ds, lasts (from own; null for a segment): the bytes that ``wanted`` names."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("g", "d", "lo", "n", "back", F.col("own.h").alias("hs"), F.col("own.d").alias("ds"), F.col("own.last").alias("lasts"))).alias("p"))  # of one text
    small_batches(rows.sparkSession)
    kinds = {"g": pa.int64(), "d": pa.int64(), "back": pa.int32(), "hs": pa.list_(pa.int64()), "ds": pa.list_(pa.int64()), "lasts": pa.list_(pa.int32())}

    def run(batches):
        un = zstandard.ZstdDecompressor()
        for batch in batches:
            asked = batch.column("p")
            flat, sizes = asked.flatten(), np.diff(asked.offsets.to_numpy())
            lo, n = (flat.field(c).to_numpy() for c in ("lo", "n"))
            seg, at = [], 0
            for z, size in zip(batch.column("z").to_pylist(), sizes.tolist(), strict=True):
                b = un.decompress(z)
                seg += [b[i : i + k] for i, k in zip(lo[at : at + size].tolist(), n[at : at + size].tolist(), strict=True)]
                at += size
            yield pa.RecordBatch.from_arrays([*(flat.field(c).cast(k) for c, k in kinds.items()), pa.array(seg, pa.binary())], [*kinds, "seg"])

    return _packed(rows).join(lists, "uid").mapInArrow(run, "g long, d long, back int, hs array<long>, ds array<long>, lasts array<int>, seg binary")


def _dealt(items: DataFrame, size: int):
    """``items`` of ``size`` bytes in all, grouped by bucket."""
    return items.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(max(1, -(-size // BUCKET_BYTES))))).groupBy("bucket")


def _in_buckets(items: DataFrame, size: int) -> DataFrame:
    """g, d, a, b: the first and last start of a repeated string in each kind of segment that has one."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(pdf["seg"].tolist())
        has = np.array([len(x) > 0 for x in found], bool)
        return pdf.loc[has, ["g", "d"]].assign(a=[int(x[0]) for x in found if len(x)], b=[int(x[-1]) for x in found if len(x)])

    found = _dealt(items, size).applyInPandas(solve, "g long, d long, a int, b int")
    return found.groupBy("g", "d").agg(F.min("a").alias("a"), F.max("b").alias("b"))  # of two of a kind


def _in_stretches(items: DataFrame) -> DataFrame:
    """g, d, a, b as of ``_in_buckets``, of the segments that stretches (g, hs, ds, lasts, seg) consist of."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], [], []]
        for x, h, d, last in zip(repeated_starts(pdf["seg"].tolist()), pdf["hs"], pdf["ds"], pdf["lasts"], strict=True):
            first = np.r_[0, last[:-1] + 1]
            i, j = np.searchsorted(x, first), np.searchsorted(x, last, side="right")
            has = i < j
            for to, v in zip(out, (h[has], d[has], x[i[has]] - first[has], x[j[has] - 1] - first[has]), strict=True):
                to.append(v)
        return pd.DataFrame(dict(zip("gdab", map(np.concatenate, out), strict=True)))

    size = items.agg(F.sum(F.length("seg"))).first()[0] or 0
    found = _dealt(items.select("g", "hs", "ds", "lasts", "seg"), size).applyInPandas(solve, "g long, d long, a int, b int")
    return found.groupBy("g", "d").agg(F.min("a").alias("a"), F.max("b").alias("b"))  # of two of a kind


def _split(items: DataFrame, step: int) -> DataFrame:
    """Segments by their cores of SPAN - step bytes: g, d (of the parts), back, seg, off (in the whole), pg, pd (of the whole)."""
    small_batches(items.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for g, d, back, seg in zip(*(batch.column(c).to_pylist() for c in ("g", "d", "back", "seg")), strict=True):
                last = len(seg) - SPAN
                for o in range((back - last) // step * step, back + 1, step):
                    lo, hi = max(0, back - o - step + 1), min(last, back - o)
                    if lo <= hi:
                        core, part = seg[back - o : back - o + SPAN - step], seg[lo : hi + SPAN]
                        name = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little", signed=True)
                        rows.append((name(g, o, core), name(part, back - o - lo), back - o - lo, part, lo, g, d))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["g", "d", "back", "seg", "off", "pg", "pd"])

    return items.mapInArrow(run, "g long, d long, back int, seg binary, off int, pg long, pd long")


def _two(rows: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """keys..., of...: the first and the last row of each kind, or its one row; ``of`` starts with what tells its rows apart."""
    ends = rows.groupBy(*keys).agg(F.min(F.struct(*of)).alias("x"), F.max(F.struct(*of)).alias("y"))
    return ends.select(*keys, F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).select(*keys, "z.*")


def _resolve(items: DataFrame, level: int = 0) -> DataFrame:
    """g, d, a, b of ``items`` (g, d, back, seg; one or two of each kind)."""
    groups = cut(items.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.length("seg")).alias("size")).filter("kinds > 1"))
    hot = groups.filter(F.col("kinds") > KINDS).select("g")
    if level == len(STEPS) or hot.isEmpty():
        size = groups.agg(F.sum("size")).first()[0] or 0
        return _in_buckets(items.join(groups.select("g"), "g"), size)
    cool = groups.filter(F.col("kinds") <= KINDS)
    done = _in_buckets(items.join(cool.select("g"), "g"), cool.agg(F.sum("size")).first()[0] or 0)
    parts = cut(_split(items.join(hot, "g"), STEPS[level]).withColumn("own", F.monotonically_increasing_id()))
    found = cut(_resolve(cut(_two(parts, ["g", "d"], ["own", "back", "seg"])).select("g", "d", "back", "seg"), level + 1))
    whole = parts.select("g", "d", "off", "pg", "pd").join(found, ["g", "d"]).groupBy("pg", "pd").agg(F.min(F.col("off") + F.col("a")).alias("a"), F.max(F.col("off") + F.col("b")).alias("b"))
    return done.unionByName(whole.select(F.col("pg").alias("g"), F.col("pd").alias("d"), "a", "b"))


def _spans(rows: DataFrame) -> DataFrame:
    """uid, p: array of (s, e), the byte ranges that repeated strings cover in each text that has any."""
    often = cut(_anchor_rows(rows, named=False).groupBy("h").count().filter("count > 1").select("h"))
    members = cut(_anchor_rows(rows).join(often, "h"))
    with scratch(rows.sparkSession) as keep:
        items = cut(_segments(rows, _wanted(_kinds(members))))
        found = _resolve(items.filter("hs is null").select("g", "d", "back", "seg")).unionByName(_in_stretches(items.filter("hs is not null")))
        found = cut(found.select(F.col("g").alias("h"), "d", "a", "b"))
        keep(found)
    start = F.col("pos") - F.col("back")
    placed = members.join(found, ["h", "d"]).select("uid", (start + F.col("a")).alias("s"), (start + F.col("b") + SPAN).alias("e"))
    return placed.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("p"))  # of one text


def without_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``texts`` kept, the remaining bytes): one row per row of ``docs``.

    Null text counts as empty; texts under SPAN bytes keep all; a repeated row is a document of its own, so its strings
    repeat; doc_id may be null; other columns are ignored; an empty table gives an empty result.
    """
    rows = _keyed(docs)
    with scratch(docs.sparkSession) as keep:
        spans = cut(_spans(rows))
        keep(spans)
    small_batches(docs.sparkSession)

    def run(batches):
        un = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for z, p in zip(batch.column("z").to_pylist(), batch.column("p").to_pylist(), strict=True):
                b = un.decompress(z)
                merged: list[list[int]] = []
                for x in p or ():
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(b[at:s])
                    at = e
                kept = b"".join([*kept, b[at:]])
                for to, v in zip(out, (len(b), len(b) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if texts else None), strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    made = _packed(rows).join(spans, "uid", "left").mapInArrow(run, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    made = made.join(rows.select("uid", "doc_id"), "uid") if "doc_id" in rows.columns else made.withColumnRenamed("uid", "doc_id")
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else []))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes out of text (bytes of characters cut apart go too) and n_chars, if there, counted anew.

    Every row stays, and every column; rows whose doc_id is null or not unique are told apart by a number of their own.
    """
    n, m = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    rows = docs.withColumn("_uid", F.col("doc_id")) if n == m else cut(docs.withColumn("_uid", F.monotonically_increasing_id()))
    kept = without_repeats(rows.select(F.col("_uid").alias("doc_id"), "text"), texts=True).filter("n_removed > 0")

    def setup():
        return lambda xs: ([x.decode("utf-8", "ignore") for x in xs],)

    new = per_text(kept.select(F.col("doc_id").alias("_uid"), "kept"), "kept", ["_uid"], setup, "_new string").withColumn("_cut", F.lit(True))
    out = rows.join(new, "_uid", "left").withColumn("text", F.when(F.col("_cut"), F.col("_new")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
