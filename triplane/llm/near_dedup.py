"""Near duplicates by an inverted join over MinHash signature coordinates.

Each document's set of word shingles gets a signature. Documents are posted under every (coordinate, value) pair.
Two sets of the wanted similarity agree in at least MATCHES of the coordinates (but for a chance of about 3e-6), so
postings that nobody shares are skipped, a document with fewer shared postings than that leaves at once, and of the
rest only a prefix, the rarest postings, is merged into candidates: two documents with MATCHES postings in common meet in
it. Candidates whose signatures agree often enough are confirmed on their full sets.

Documents of equal sets are one class from the start. Each class is first compared with two hubs, of the heaviest classes
of its lists the one that most classes may match and the one whose signature agrees most, so that a group of copies costs
twice as many checks as it has members at most. What then lies in one list with several components has to be held
against each other. Of classes compared with the same hub the two differences from it are known, and
sets are similar just where their differences share enough: that is a join on the rarest shingles of the differences,
again by prefixes, and needs no pair for two members whose edits are their own. The few pairs of a list that have no
hub in common are checked one by one. Nothing else is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text, scratch, small_batches
from .components import components

WORDS, SIMILAR = 5, 75
COORDINATES, MATCHES = 64, 32
#: Coordinates in which a class and the chief hub of a list agree at least to be compared.
NEAR_HUB = 20
#: Bytes of a text that are hashed at once; longer words are hashed by themselves.
BLOCK = 1 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BLANKS = [bytes([c]) for c in np.flatnonzero(_SPACE)]
_R = np.random.default_rng(17)
_MUL, _ADD = (_R.integers(1, 1 << 63, COORDINATES // 2, np.uint64) | np.uint64(1)), _R.integers(1, 1 << 63, COORDINATES // 2, np.uint64)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case; a long text is read in blocks that end between words."""
    data = data.translate(LOWER)
    if len(data) <= BLOCK:
        return _block_hashes(data)
    out, lo, n = [], 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            cut_at = max(data.rfind(c, lo, hi) for c in _BLANKS)
            if cut_at < 0:  # a word longer than a block
                hi = min((k for k in (data.find(c, hi) for c in _BLANKS) if k >= 0), default=n)
                out.append(np.frombuffer(hashlib.blake2b(data[lo:hi], digest_size=8).digest(), np.uint64))
                lo = hi
                continue
            hi = cut_at + 1
        out.append(_block_hashes(data[lo:hi]))
        lo = hi
    return np.concatenate(out)


def _block_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.zeros(0, np.uint64)
    # A polynomial of the bytes, taken as differences of running sums with an odd factor's inverse powers.
    n = b.size
    power = _powers(n)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:n])])
    poly = (run[ends] - run[starts]) * _inverses(n)[starts]
    second = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIXED[b] * _powers2(n)[:n])])
    poly2 = (second[ends] - second[starts]) * _inverses2(n)[starts]
    return _mix(poly * _P1 + _mix(poly2) + (ends - starts).astype(np.uint64))


_F1, _F2 = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_TABLES: dict[int, np.ndarray] = {}
_MIXED = _mix(np.arange(1, 257, dtype=np.uint64) * _P1)


def _table(factor: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of a factor, modulo 2**64; kept, and doubled up to BLOCK when a longer text comes."""
    have = _TABLES.get(factor)
    if have is None or have.size < n:
        have = np.ones(1, np.uint64) if have is None else have
        step = pow(factor, have.size, 1 << 64)
        while have.size < n:
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step % (1 << 64)
        _TABLES[factor] = have
    return have


def _powers(n):
    return _table(_F1, n)


def _inverses(n):
    return _table(pow(_F1, -1, 1 << 64), n)


def _powers2(n):
    return _table(_F2, n)


def _inverses2(n):
    return _table(pow(_F2, -1, 1 << 64), n)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles of WORDS words; of all words as one where there are fewer; none without words."""
    w = word_hashes(text.encode())
    if not w.size:
        return w
    if w.size < WORDS:
        h = np.full(1, w.size, np.uint64)
        for x in w:
            h = _mix(h * _P1 + x)
        return h
    h = w[: w.size - WORDS + 1].copy()
    for k in range(1, WORDS):
        h = _mix(h * _P1 + w[k : w.size - WORDS + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest of each coordinate's permutation of the set; each product of 64 bits gives two of 32, its halves."""
    out, half = np.full((2, COORDINATES // 2), 0xFFFFFFFF, np.uint64), np.uint64(32)
    for k in range(0, s.size, 2048):  # parts of a long set, eight products at once
        part = s[k : k + 2048]
        for lo in range(0, COORDINATES // 2, 8):
            both = part * _MUL[lo : lo + 8, None]
            both += _ADD[lo : lo + 8, None]
            out[0, lo : lo + 8] = np.minimum(out[0, lo : lo + 8], both.min(1) >> half)
            both <<= half
            out[1, lo : lo + 8] = np.minimum(out[1, lo : lo + 8], both.min(1) >> half)
    return out.astype(np.uint32).ravel().view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, x (hash of the text), n_shingles, d1, d2 (digest of the set, null when empty), sig of each row of ``docs``."""

    def setup():
        def of(texts):
            n, d1, d2, sig = [], [], [], []
            for t in texts:
                s = shingle_set(t)
                n.append(s.size)
                if s.size:
                    d1.append(int(_mix(s * _P3).sum().view(np.int64)))
                    d2.append(int(np.bitwise_xor.reduce(_mix(s + _P1)).view(np.int64)))
                    sig.append(signature(s))
                else:
                    d1.append(None), d2.append(None), sig.append(None)
            return n, d1, d2, sig

        return of

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("x"))
    return per_text(rows, "text", ["doc_id", "x"], setup, "n_shingles long, d1 long, d2 long, sig array<int>")


def _matches(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _sized(a, b):
    """Whether two sets' sizes allow the similarity."""
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, near, far, delta of the pairs (a, b), on their full sets; ``texts``: rep, text. A hub's pairs are dealt by a salt.

    delta: the shingles that just one of the two has; far: 100 for each that b lacks, SIMILAR for each that a lacks;
    near: what the hub's size allows. The two are similar enough just where far <= near.
    """
    small_batches(pairs.sparkSession)
    # Each text is sent once to every part it is needed in: pairs are dealt by their hub and a salt of about 64 members.
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = cut(pairs.join(counts, "a").withColumn("part", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 64).cast("long")))).select("part", "a", "b"))
    need = salted.select("part", F.col("a").alias("rep"), F.lit(None).cast("long").alias("hub")).distinct().unionByName(salted.select("part", F.col("b").alias("rep"), F.col("a").alias("hub")))
    rows = need.join(texts, "rep")

    def similar(batches):
        hubs: dict = {}
        waiting = None
        for batch in batches:
            a, b, near, far, delta = [], [], [], [], []
            for part, rep, hub, text in zip(*(batch.column(c).to_pylist() for c in ("part", "rep", "hub", "text")), strict=True):
                if part != waiting:
                    hubs, waiting = {}, part
                s = shingle_set(text)
                if hub is None:
                    hubs[rep] = s
                else:
                    h = hubs[hub]
                    lacks, beside = np.setdiff1d(h, s, assume_unique=True), np.setdiff1d(s, h, assume_unique=True)
                    a.append(hub), b.append(rep), near.append((100 - SIMILAR) * h.size), far.append(100 * lacks.size + SIMILAR * beside.size)
                    delta.append(np.concatenate([lacks, beside]).view(np.int64))
            kinds = {"a": pa.int64(), "b": pa.int64(), "near": pa.int64(), "far": pa.int64(), "delta": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((a, b, near, far, delta), kinds.values(), strict=True)], list(kinds))

    # Sorted so that a part's hub comes before its members: one hub's set is held at a time.
    dealt = rows.repartition("part").sortWithinPartitions("part", F.col("hub").asc_nulls_first())
    return dealt.mapInArrow(similar, "a long, b long, near long, far long, delta array<long>")


def _listed(posts: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., p, e of classes that have at least MATCHES postings (c, v, n): all, the rarest first, and the prefix of them, one of which a match must hold."""
    each = posts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "c", "v"))).alias("p")).filter(F.size("p") >= MATCHES)  # COORDINATES at most
    return each.withColumn("e", F.slice("p", 1, F.size("p") - MATCHES + 1))


def _agreeing(pairs: DataFrame, info: DataFrame, least: int) -> DataFrame:
    """a, b, na, nb (sizes), m: of the pairs (a, b), those whose signatures agree in ``least`` coordinates or more, m. ``info``: rep, n_shingles, sig."""
    side = lambda k: info.select(F.col("rep").alias(k), F.col("n_shingles").alias("n" + k), F.col("sig").alias("s" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("m", _matches("sa", "sb"))
    return both.filter(F.col("m") >= least).select("a", "b", "na", "nb", "m")


def _to_hubs(prefix: DataFrame, info: DataFrame) -> DataFrame:
    """a, b: each class b of ``prefix`` (c, v, rep, weight) and two of the hubs, its lists' heaviest classes, that it may match.

    One is the hub that most classes may match, the other the one that agrees with b in most coordinates.
    """
    hubs = prefix.groupBy("c", "v").agg(F.max(F.struct("weight", (-F.col("rep")).alias("a")))["a"].alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("c", "v", (-F.col("a")).alias("a"))
    met = prefix.select("c", "v", F.col("rep").alias("b")).join(hubs, ["c", "v"]).filter("a <> b").select("a", "b").distinct()
    may = cut(_agreeing(met, info, MATCHES).filter(_sized(F.col("na"), F.col("nb"))).select("a", "b", "m"))
    members = may.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    low = (-F.col("a")).alias("a")
    best = may.join(members, "a").groupBy("b").agg(F.array_distinct(F.array(-F.max(F.struct("n", low))["a"], -F.max(F.struct("m", "n", low))["a"])).alias("a"))
    return cut(best.select(F.explode("a").alias("a"), "b"))


def _family_links(tests: DataFrame, place: DataFrame) -> DataFrame:
    """a, b: links across components between classes compared with the same hub. ``tests``: see _compared; ``place``: rep, root.

    Sets x and y that differ from their hub by dx and dy are similar just where (100 + SIMILAR) * |dx & dy| is at least
    far(x) + far(y) - near. So pairs meet only in a prefix, the rarest shingles, of differences, one of which is such a
    share's. At least one of two components' classes is not linked with the hub: that one looks for the other.
    """
    rows = tests.join(place.select(F.col("rep").alias("b"), "root"), "b")
    groups = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.first("near").alias("m"))
    groups = cut(groups.filter("n > 1 AND high > m").select("a", "low"))
    rows = cut(rows.join(groups, "a"))
    each = rows.select("a", "b", "root", F.explode("delta").alias("t"))
    shared = each.groupBy("a", "t").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("a", "t", "n")
    listed = each.join(shared, ["a", "t"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("p"))  # of one difference
    away = F.col("far") > F.col("near")
    share = lambda over: F.greatest(F.ceil(over / F.lit(100 + SIMILAR)), F.lit(1))
    least = share(F.when(away, F.col("far") + F.col("low") - F.col("near")).otherwise(F.col("far") + 1)).cast("int")
    kept = rows.drop("delta").join(listed, ["a", "b"]).withColumn("size", F.size("p")).withColumn("least", least).filter("size >= least")
    posts = kept.withColumn("away", away).select("a", "b", "root", "near", "far", "away", "size", F.posexplode(F.slice("p", F.lit(1), F.col("size") - F.col("least") + 1)).alias("at", "x"))
    posts = cut(posts.select("*", F.col("x.t").alias("t")).drop("x"))
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    (bx, by), (fx, fy), (rx, ry) = of("b"), of("far"), of("root")
    least = share(fx + fy - F.col("x.near"))
    within = (F.col("x.at") <= F.col("x.size") - least) & (F.col("y.at") <= F.col("y.size") - least)
    met = (F.col("x.a") == F.col("y.a")) & (F.col("x.t") == F.col("y.t")) & (rx != ry) & (~F.col("y.away") | (bx < by)) & within
    pairs = posts.filter("away").alias("x").join(posts.alias("y"), met).select("x.a", bx.alias("bx"), by.alias("by")).distinct()
    side = lambda k: rows.select("a", "near", F.col("b").alias("b" + k), F.col("far").alias("f" + k), F.col("delta").alias("d" + k))
    both = pairs.join(side("x"), ["a", "bx"]).join(side("y").drop("near"), ["a", "by"])
    linked = both.filter((100 + SIMILAR) * F.size(F.array_intersect("dx", "dy")) >= F.col("fx") + F.col("fy") - F.col("near"))
    return cut(linked.select(F.col("bx").alias("a"), F.col("by").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``; component_id is the smallest doc_id linked.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows of one doc_id
    that have shingles are linked with each other, whatever their texts; a null doc_id stays by itself, component_id
    null. Other columns are ignored; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        made, found = _components_of(docs)
        keep(made, found)
    out = made.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of ``docs``, and d1, d2, n_shingles, component_id of each class of equal sets; both written."""
    made = cut(signatures(docs))
    live = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is named by a number of its own, since rows of one doc_id may be of several classes.
    first_of = live.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "x")).alias("first"), F.first("sig").alias("sig"))
    classes = cut(first_of.withColumn("rep", F.monotonically_increasing_id()))
    posts = classes.select("rep", "n_shingles", F.posexplode("sig").alias("c", "v"))
    lists = posts.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = posts.join(lists, ["c", "v"])
    listed = cut(_listed(shared, ["rep", "n_shingles"]))
    prefix = listed.withColumn("weight", F.aggregate("e", F.lit(0).cast("long"), lambda t, x: t + x.n)).select("rep", "weight", F.explode("e").alias("x")).select("x.c", "x.v", "rep", "weight")
    info = classes.select("rep", "n_shingles", "sig")
    wanted = listed.select("rep")
    at = classes.join(wanted, "rep").select("rep", F.col("first.doc_id").alias("_id"), F.col("first.x").alias("_x"))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_x"), F.coalesce("text", F.lit("")).alias("text"))
    texts = cut(rows.join(at, ["_id", "_x"]).select("rep", "text").dropDuplicates(["rep"]))

    tests = cut(_compared(_to_hubs(prefix, info), texts))
    linked = tests.filter("far <= near").select("a", "b")
    # Rows of one doc_id are linked.
    key = F.struct("d1", "d2", "n_shingles")
    mixed = live.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).filter("lo <> hi").select("doc_id")
    texts_of = live.join(mixed, "doc_id").select("doc_id", "d1", "d2", "n_shingles").distinct().join(classes.select("d1", "d2", "n_shingles", F.col("rep").alias("b")), ["d1", "d2", "n_shingles"])
    texts_of = cut(texts_of.select("doc_id", "b"))
    linked = linked.unionByName(texts_of.join(texts_of.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b").filter("a <> b"))
    roots = components(linked)

    # What one component has to itself can match no other one, as with postings that nobody shares. So only lists of
    # several components count, each class needs MATCHES of them, and the rarest (by components) are merged.
    place = cut(wanted.join(roots, F.col("rep") == F.col("node"), "full").select(F.coalesce("rep", "node").alias("rep"), F.coalesce("root", "rep").alias("root")))
    placed = cut(listed.select("rep", "n_shingles", F.explode("p").alias("x")).select("x.c", "x.v", "rep", "n_shingles").join(place, "rep"))
    open_lists = placed.select("c", "v", "root").distinct().groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = cut(_listed(placed.join(open_lists, ["c", "v"]), ["rep", "n_shingles", "root"]).drop("p"))
    with_c = lambda v, c: F.shiftleft(v, 6).bitwiseOR(c)  # noqa: E731  COORDINATES is 64
    keyed = many.withColumn("keys", F.transform("e", lambda x: with_c(x.v.cast("long"), x.c.cast("long")))).drop("e")
    slots = keyed.select(F.explode("keys").alias("key"), "rep")

    # The hub that most classes of a list know; the others are compared with it, but for those far from it.
    knows = tests.select(F.col("b").alias("rep"), F.col("a").alias("hub")).unionByName(tests.select(F.col("a").alias("rep"), F.col("a").alias("hub")).distinct())
    chief = slots.join(knows, "rep").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    chief = cut(chief)
    strangers = slots.join(chief, "key").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    strangers = strangers.join(knows.select(F.col("hub").alias("a"), F.col("rep").alias("b")), ["a", "b"], "left_anti")
    asked = cut(_agreeing(strangers, info, NEAR_HUB).select("a", "b"))
    if not asked.isEmpty():
        tests = tests.unionByName(cut(_compared(asked, texts)))
    more = _family_links(tests, many.select("rep", "root")).unionByName(tests.filter("far <= near").select("a", "b"))

    # Pairs of a list without a hub in common: one of them at least does not know the list's hub.
    knows = tests.select(F.col("b").alias("rep"), F.col("a").alias("hub")).unionByName(tests.select(F.col("a").alias("rep"), F.col("a").alias("hub")).distinct())
    hubs = knows.groupBy("rep").agg(F.collect_set("hub").alias("hubs"))  # as many as a class has postings at most
    values = info.select("rep", F.transform("sig", with_c).alias("values"))  # the lowest 26 bits: never too few in common
    full = keyed.join(values, "rep").join(hubs, "rep", "left").withColumn("hubs", F.coalesce("hubs", F.array().cast("array<long>")))
    sized = full.withColumn("key", F.explode("keys")).join(chief, "key", "left").withColumn("out", ~F.coalesce(F.array_contains("hubs", F.col("hub")), F.lit(False)))
    sized = cut(sized.drop("hub"))
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    once = (F.col("x.rep") != F.col("y.rep")) & (~F.col("y.out") | (F.col("x.rep") < F.col("y.rep"))) & (F.array_min(F.array_intersect(*of("keys"))) == F.col("x.key"))
    may = once & (F.col("x.root") != F.col("y.root")) & _sized(*of("n_shingles")) & ~F.arrays_overlap(*of("hubs")) & (F.size(F.array_intersect(*of("values"))) >= MATCHES)
    pairs = sized.filter("out").alias("x").join(sized.alias("y"), (F.col("x.key") == F.col("y.key")) & may)
    pairs = cut(pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")))
    if not pairs.isEmpty():
        more = more.unionByName(_compared(pairs, texts).filter("far <= near").select("a", "b"))

    # Links between components join them.
    root_of = lambda k: place.select(F.col("rep").alias(k), F.col("root").alias("r" + k))
    across = cut(more.join(root_of("a"), "a").join(root_of("b"), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not across.isEmpty():
        wider = components(across).select(F.col("node").alias("root"), F.col("root").alias("wide"))
        place = place.join(wider, "root", "left").select("rep", F.coalesce("wide", "root").alias("root"))
    least = classes.select("rep", F.col("first.doc_id").alias("least"))
    named = cut(place.join(least, "rep").select(F.col("rep").alias("node"), "root", "least"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    found = classes.select("d1", "d2", "n_shingles", "rep", F.col("first.doc_id").alias("least")).join(named, F.col("rep") == F.col("node"), "left")
    return made, cut(found.select("d1", "d2", "n_shingles", F.coalesce("component_id", "least").alias("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, the one of the smallest doc_id, of each group of near duplicates; the columns stay.

    Rows without words stay, as do those of a null doc_id; of rows that share the smallest doc_id all stay. An empty
    table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        drop = cut(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct())
        keep(drop)
    return docs.join(drop, "doc_id", "left_anti")
