"""Document fingerprints from closed syncmers, with DataFrame operations alone.

A text is cut into short pieces: up to PIECE signs of a word, or one sign of a script that is written without spaces.
A window of K pieces is chosen when the smallest of its inner substrings of S pieces lies at its first or last place:
the choice depends on the window alone, so equal passages choose equal windows wherever they stand. Marks before the first
and after the last piece give short texts windows too: of any K - S windows in a row one at least is chosen, so every
text with a piece has one. A fingerprint is the M smallest hashes of chosen windows, a sample that likeness can be told from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Pieces of a window, of an inner substring, and hashes of a fingerprint.
K, S, M = 5, 2, 64
#: Signs of a piece at most; scripts without spaces, whose signs are pieces each.
PIECE = 4
ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
PIECES = rf"([{ALONE}]|[^\x20\x09-\x0D{ALONE}]{{1,{PIECE}}})"
#: Bytes of texts that one part holds on average, and most parts.
PART_BYTES, PARTS = 1 << 20, 50_000


def _let(value: Column, f) -> Column:
    """f(value), with ``value`` computed once for a row."""
    return F.transform(F.array(value), f)[0]


def _hashes(text: Column) -> Column:
    """Hashes of a text's pieces between marks; [] for a text without pieces."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(1)), lambda w: F.xxhash64(w))
    marks = lambda n: F.array(*[F.lit(i).cast("long") for i in range(n)])
    return _let(pieces, lambda h: F.when(F.size(h) > 0, F.concat(marks(K - 1), h, marks(K - S - 1))).otherwise(h))


def _inner(h: Column) -> Column:
    """Hash of each substring of S = 2 pieces, by its first piece; the last has no partner and stays out of windows."""
    return F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _chosen(h: Column, f) -> Column:
    """f(place, hash) of each chosen window; [] for texts without pieces."""

    def windows(s):
        def one(i):
            edge = F.least(F.get(s, i), F.get(s, i + K - S))
            within = F.least(F.get(s, i + 1), F.get(s, i + 2))
            return F.when(edge <= within, f(i, F.xxhash64(F.get(s, i), F.get(s, i + 2), F.get(h, i + K - 1)).bitwiseAND(F.lit(0xFFFFFFFF))))

        return F.when(F.size(h) >= K, F.transform(F.sequence(F.lit(0), F.size(h) - K), one))

    return F.array_compact(F.coalesce(_let(_inner(h), windows), F.array()))


def sketch(text: Column) -> Column:
    """The M smallest distinct hashes of chosen windows, in order; of a text without pieces, the hash of its white space."""

    def of(h):
        chosen = F.slice(F.sort_array(F.array_distinct(_chosen(h, lambda _, x: x))), 1, M)
        return _let(chosen, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))))

    return _let(_hashes(text), of)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (number of a window's first piece, marks included), hash: the chosen windows of each text, for positional matching.

    Texts without pieces (null, empty, white space) have none; rows of null or repeated doc_id each give theirs.
    """
    marks = _let(_hashes(F.coalesce("text", F.lit(""))), lambda h: _chosen(h, lambda i, x: F.struct(i.alias("place"), x.alias("hash"))))
    return docs.select("doc_id", F.inline(marks))


def shown(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the M smallest hashes of either sketch that both have: 1 for equal ones."""
    return _let(F.slice(F.sort_array(F.array_union(a, b)), 1, M), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def _bounds(rows: DataFrame) -> list[int]:
    """Ascending ids at which parts of about PART_BYTES start, PARTS of them at most: quantiles of ``d``."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(PARTS, -(-size // PART_BYTES))
    if parts < 2:
        return []
    found = rows.agg(F.percentile_approx("d", [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return sorted(set(found or []))


def _part(bounds: list[int]) -> Column:
    """Number of the part of ``d``: how many bounds it reaches. Looked up in two steps, a stretch of bounds and a bound in it."""
    if not bounds:
        return F.lit(0)
    width = round(len(bounds) ** 0.5)
    many = F.array(*map(F.lit, bounds)) if len(bounds) < 2000 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    reached = lambda some: F.size(F.filter(some, lambda b: b <= F.col("d")))
    stretches = F.array(*[F.lit(b) for b in bounds[::width]])
    at = lambda k: F.when(k > 0, (k - 1) * width + reached(F.slice(many, (k - 1) * width + 1, F.lit(width)))).otherwise(0)
    return F.when(F.col("d").isNull(), 0).otherwise(_let(reached(stretches), at))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of ``docs``.

    The edited text: the last floor(n_chars/2) code points replaced by the first as many of the next document. Null
    text counts as empty. The next document is by ascending doc_id (nulls first), then a hash of the text; rows equal
    in doc_id and text are one document here, and each gets its row; a single document follows itself; other
    columns are ignored; an empty table gives an empty result.

    Texts move once, to parts of consecutive ids, each with the first document of the part after it as its last row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("x", F.xxhash64("text")).withColumn("part", _part(_bounds(rows)).cast("int"))
    keys = cut(rows.groupBy("d", "x", "part").agg(F.count(F.lit(1)).alias("n")))
    repeated = not keys.filter("n > 1").isEmpty()
    if repeated:
        rows = rows.dropDuplicates(["d", "x"])
    # The first document of each part goes to the part before it as well; the first of all to the last part.
    firsts = keys.groupBy("part").agg(F.min(F.struct("d", "x")).alias("first"))  # a row for each part
    to = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    firsts = cut(firsts.select("first", to.alias("to")))
    heads = rows.join(F.broadcast(firsts.select(F.col("first.d").alias("fd"), F.col("first.x").alias("fx"), "to")), F.col("d").eqNullSafe(F.col("fd")) & (F.col("x") == F.col("fx")))  # PARTS rows at most
    form = lambda df, part, own: df.select("d", "x", "text", sketch(F.col("text")).alias("sk"), F.col(part).alias("part"), F.lit(own).alias("own"))
    every = form(rows, "part", True).unionByName(form(heads, "to", False))
    order = Window.partitionBy("part").orderBy(F.desc("own"), "d", "x")
    pairs = every.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sk").over(order).alias("next_sk")).filter("own")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = pairs.select(F.col("d").alias("doc_id"), "x", n.cast("long").alias("n_chars"), "sk", "next_sk", edited.alias("e"))
    out = out.select("doc_id", "x", "n_chars", "sk", "next_sk", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("e")).alias("esk"))
    out = out.select(
        "doc_id", "x", "n_chars", "edited_sha256", shown(F.col("sk")).alias("fingerprint"), shown(F.col("esk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("esk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
    if repeated:  # as many rows as the table has
        again = keys.filter("n > 1").select(F.col("d").alias("rd"), F.col("x").alias("rx"), "n")
        out = out.join(again, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("x") == F.col("rx")), "left")
        out = out.withColumn("one", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n").cast("int"), F.lit(1))))).drop("rd", "rx", "n", "one")
    return out.drop("x")
