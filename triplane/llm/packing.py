"""Best-fit packing by a grouping genetic algorithm on distributed islands.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by a hash into shards of bounded size. Each
shard is solved on several islands: a solution is a set of bins, crossover injects whole well-filled bins of one
parent into the other, removes what is then doubled, and best-fits the displaced pieces. Each round the best solution
of an island migrates to the next one. Between rounds of shards, bins that are not well filled are dissolved and their
pieces dealt anew, so that no shard keeps its own waste.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text

CAPACITY, END_ID = 1024, 2
#: Pieces of a shard on average; islands of a shard; rounds with a migration; rounds of shards. Then, of an island: solutions, most generations a round,
#: generations without a better solution that end a round, and the fill from which a bin is well filled.
SHARD, ISLANDS, MIGRATIONS, DEALS = 3000, 2, 2, 2
POPULATION, GENERATIONS, STALE, WELL_FILLED = 4, 40, 12, 0.985


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from a text to its ids, as the tokenizers library gives them for a byte-level BPE file.

    The vocabulary and special tokens come from the file; tiktoken runs the merges, several times as fast.
    """
    import json

    import public_tokenizers
    import tiktoken

    from .bpe import byte_letters

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter = spec["pre_tokenizer"]
    if splitter["type"] != "ByteLevel" or not splitter["use_regex"] or splitter["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path}: only byte-level files with the usual pattern and no normaliser are read here")
    vocab, code = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(code[c] for c in token): i for token, i in vocab.items() if token not in special}
    enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: enc.encode(text, allowed_special="all", disallowed_special=())


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's pieces; null text counts as empty (one id, the end)."""

    def setup():
        ids_of = tokenizer(path)

        def cut_up(texts):
            out = []
            for t in texts:
                ids = np.array([*ids_of(t), end_id], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                out.append([{"piece": k, "start": s, "length": len(part := ids[s : first if k == 0 else s + capacity]), "ids_crc32": zlib.crc32(part.tobytes())} for k, s in enumerate(starts)])
            return (out,)

        return cut_up

    listed = per_text(docs, "text", ["doc_id"], setup, "p array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    return listed.select("doc_id", F.inline("p"))


class Bins:
    """Bins of one solution; a bin is a list of item numbers. Lists are shared between solutions and never changed in place."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None, loads: list[int] | None = None):
        self.sizes, self.capacity, self.bins = sizes, capacity, bins or []
        self.loads = [sum(sizes[i] for i in b) for b in self.bins] if loads is None else loads

    def add(self, items) -> None:
        """Best fit: each item goes to the fullest bin that has room, or to a new bin."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for k, load in enumerate(self.loads):
            if load < self.capacity:
                room[self.capacity - load].append(k)
                mask |= 1 << (self.capacity - load)
        for i in items:
            size = self.sizes[i]
            fit = mask >> size
            if fit:
                r = size + (fit & -fit).bit_length() - 1
                k = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
                self.bins[k] = [*self.bins[k], i]
                self.loads[k] += size
            else:
                r, k = self.capacity, len(self.bins)
                self.bins.append([i])
                self.loads.append(size)
            left = r - size
            if left:
                room[left].append(k)
                mask |= 1 << left

    def swap_in(self, items) -> list[int]:
        """Items, largest first, take the place of smaller ones where that fills a bin to the brim; what is left outside."""
        wanted: dict[int, list[tuple[int, int]]] = {}
        for k, (b, load) in enumerate(zip(self.bins, self.loads, strict=True)):
            if load < self.capacity:
                for i in b:
                    wanted.setdefault(self.sizes[i] + self.capacity - load, []).append((k, i))
        heap, left = [(-self.sizes[i], i) for i in items], []
        heapq.heapify(heap)
        while heap:
            j = heapq.heappop(heap)[1]
            places = wanted.get(self.sizes[j], ())
            while places:
                k, i = places.pop()
                if self.loads[k] < self.capacity:
                    self.bins[k] = [j if x == i else x for x in self.bins[k]]
                    self.loads[k] = self.capacity
                    heapq.heappush(heap, (-self.sizes[i], i))
                    break
            else:
                left.append(j)
        return left

    def worth(self) -> tuple:
        """Fewer bins first, then the larger sum of squared fills: one bin full and one empty beat two half full."""
        return len(self.bins), -sum(x * x for x in self.loads)


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """A child of ``a`` with whole well-filled bins of ``b``.

    Some well-filled bins of ``b`` are injected as they are. Bins of ``a`` that hold one of their documents go, as do some
    that are not full. What that displaces is swapped in where it fills a bin, and best-fitted otherwise, in an
    order that is by size or nearly so.
    """
    share, gone = rng.choice((0.1, 0.3)), rng.choice((0.2, 0.6))
    dice = rng.random(len(b.bins)).tolist()
    put = [k for k, load in enumerate(b.loads) if load >= WELL_FILLED * b.capacity and dice[k] < share]
    taken = {i for k in put for i in b.bins[k]}
    keep, loads, displaced, dice = [], [], [], rng.random(len(a.bins)).tolist()
    for bin_, load, die in zip(a.bins, a.loads, dice, strict=True):
        if taken.isdisjoint(bin_) and (load == a.capacity or die >= gone):
            keep.append(bin_)
            loads.append(load)
        else:
            displaced.extend(i for i in bin_ if i not in taken)
    child = Bins(a.sizes, a.capacity, keep + [b.bins[k] for k in put], loads + [b.loads[k] for k in put])
    left, noise = child.swap_in(displaced), rng.choice((0.0, 0.0, 0.1, 0.3)) * a.capacity
    child.add([i for _, i in sorted((-a.sizes[i] - noise * x, i) for i, x in zip(left, rng.random(len(left)).tolist(), strict=True))])
    return child


def evolve(sizes: list[int], capacity: int, seed: int, known: list[Bins], generations: int = GENERATIONS) -> Bins:
    """The best solution after some generations; ``known`` solutions join the first population.

    The first parent is best fit by falling size; the others are best fits in random-key orders, each further from
    that order. Ends early at the floor, the least count that the sizes' sum allows, and when STALE generations in a
    row bring no better solution.
    """
    rng = np.random.default_rng(seed)
    people = list(known)
    while len(people) < POPULATION:
        new, noise = Bins(sizes, capacity), rng.random(len(sizes)) * (capacity * 0.15 * len(people))
        new.add(sorted(range(len(sizes)), key=(-np.array(sizes) - noise).tolist().__getitem__))
        people.append(new)
    floor, stale = -(-sum(sizes) // capacity), 0
    people.sort(key=Bins.worth)
    for _ in range(generations):
        if len(people[0].bins) <= floor or stale == STALE:
            break
        best = people[0].worth()
        mate = 1 + int(rng.integers(len(people) - 1))
        people += [crossover(people[0], people[mate], rng), crossover(people[mate], people[0], rng)]
        people = sorted({x.worth(): x for x in reversed(people)}.values(), key=Bins.worth)[:POPULATION]
        if len(people) < 2:
            people *= 2
        stale = 0 if people[0].worth() < best else stale + 1
    return people[0]


def _islands(items: DataFrame, capacity: int, islands: int, migrations: int, seed: int) -> DataFrame:
    """``items`` (uid, length, shard) with bin: the number of a bin within its shard, by the shard's best island."""
    found = items.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("own", F.lit(-1)).withColumn("elite", F.lit(-1))
    form = "uid long, length long, shard long, island int, own int"

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes, known = pdf["length"].tolist(), []
        for name in ("own", "elite"):
            if (pdf[name] >= 0).all():
                by = pdf.groupby(name, sort=True).indices
                known.append(Bins(sizes, capacity, [list(map(int, v)) for v in by.values()]))
        best = evolve(sizes, capacity, hash((seed, *map(int, key), len(known))) & 0x7FFFFFFF, known)
        own = np.empty(len(pdf), np.int32)
        for k, b in enumerate(best.bins):
            own[b] = k
        return pdf[["uid", "length", "shard", "island"]].assign(own=own)

    for k in range(migrations):
        found = cut(found.groupBy("shard", "island").applyInPandas(solve, form))
        if k < migrations - 1:
            moved = found.select("uid", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("own").alias("elite"))
            found = found.join(moved, ["uid", "island"])
    best = found.groupBy("shard", "island").agg((F.max("own") + 1).alias("n")).groupBy("shard").agg(F.min(F.struct("n", "island"))["island"].alias("island"))
    return found.join(best, ["shard", "island"]).select("uid", "length", "shard", F.col("own").alias("bin"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, migrations: int = MIGRATIONS, deals: int = DEALS) -> DataFrame:
    """``pieces`` (with a column length, 1 to ``capacity``) with sequence_id and offset; lengths in a sequence add to at most ``capacity``.

    Ties and repeated rows are pieces of their own; other columns stay; an empty table gives an empty result.
    """
    given = pieces.drop("sequence_id", "offset")
    rows = cut(given.select(F.struct("*").alias("row"), F.col("length"), F.monotonically_increasing_id().alias("uid")))
    open_ = rows.filter(F.col("length") < capacity).select("uid", "length")
    done = [rows.filter(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    for deal in range(deals):
        n = open_.count()
        if not n:
            break
        shards = max(1, round(n / shard))
        dealt = open_.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(deal)), F.lit(shards)))
        packed = _islands(dealt, capacity, islands, migrations, deal)
        in_bin = packed.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("x"), F.sum("length").alias("load"))  # at most ``capacity`` pieces
        in_bin = cut(in_bin.select("x", (F.col("load") >= WELL_FILLED * capacity).alias("full")))
        last = deal == deals - 1 or shards == 1
        kept = in_bin if last else in_bin.filter("full")
        before = F.transform("x", lambda p, i: F.struct(p["uid"].alias("uid"), F.aggregate(F.slice("x", 1, i), F.lit(0).cast("long"), lambda s, q: s + q["length"]).alias("offset")))
        done.append(kept.select(F.col("x")[0]["uid"].alias("sequence_id"), F.explode(before).alias("p")).select("p.uid", "sequence_id", "p.offset"))
        if last:
            break
        open_ = cut(in_bin.filter("NOT full").select(F.inline("x")))
    places = done[0]
    for x in done[1:]:
        places = places.unionByName(x)
    return rows.join(places, "uid").select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of ``docs``.

    Null and empty texts are one piece of one id. Repeated rows are documents of their own; other columns are ignored.
    """
    return pack(pieces_of(docs, path, capacity), capacity)
