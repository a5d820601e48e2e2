"""Order-preserving text forms of numbers, and byte keys of (subject, predicate)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default signs: below and above the digits in byte order.
NEG, POS = "/", ":"
DIGITS, NINES = "0123456789", "9876543210"
#: Ordinals of the data types, fixed values of the stored format.
TYPES = {"INVALID": 0, "INT32": 1, "INT64": 2, "UINT32": 3, "UINT64": 4, "FLOAT": 5, "DOUBLE": 6, "BYTE": 7, "POINTER": 8}


def _flip(c: Column) -> Column:
    return F.translate(c, DIGITS, NINES)


def encode_int(v: Column, neg: str = NEG, pos: str = POS) -> Column:
    """Text whose byte order is the numeric order: a sign for each level of lengths, lengths, digits (of nines' complement below zero)."""
    shown = v.cast("decimal(38,0)").cast("string")
    digits = F.regexp_replace(shown, "^-", "")
    one = F.length(digits).cast("string")
    two = F.length(one).cast("string")
    levels = F.when(F.length(digits) == 1, 1).when(F.length(one) == 1, 2).otherwise(3)
    body = F.when(levels == 1, digits).when(levels == 2, F.concat(one, digits)).otherwise(F.concat(two, one, digits))
    below = shown.startswith("-")
    return F.when(digits == "0", F.lit("0")).otherwise(F.concat(F.repeat(F.when(below, F.lit(neg)).otherwise(F.lit(pos)), levels), F.when(below, _flip(body)).otherwise(body)))


def decode_int(e: Column, neg: str = NEG, pos: str = POS) -> Column:
    """The number of an encoded integer, as decimal(38,0); null where the text is no such encoding."""
    first = F.substring(e, 1, 1)
    ok = F.rlike(e, F.lit(rf"^(\Q{neg}\E+|\Q{pos}\E+)[0-9]+$"))
    body = F.regexp_replace(e, rf"^(\Q{neg}\E+|\Q{pos}\E+)", "")
    levels = F.length(e) - F.length(body)
    plain = F.when(first == neg, _flip(body)).otherwise(body)
    skip = F.when(levels == 1, 0).when(levels == 2, 1).otherwise(1 + F.try_to_number(F.substring(plain, 1, 1), F.lit("9")).cast("int"))
    digits = F.substring(plain, skip + 1, F.length(plain))
    value = digits.try_cast("decimal(38,0)")
    return F.when(e == "0", F.lit(0).cast("decimal(38,0)")).when(ok, F.when(first == neg, -value).otherwise(value))


def _fraction(magnitude: Column, precision: int) -> Column:
    """The digits of a value in [0, 1) to a precision."""
    return F.regexp_extract(F.format_string(f"%.{precision}f", magnitude), r"\.(\d+)$", 1)


def encode_small(v: Column, precision: int, neg: str = NEG, pos: str = POS) -> Column:
    """A value between -1 and 1: sign, digits, and the other sign to close it."""
    digits = F.regexp_replace(_fraction(F.abs(v), precision), "0+$", "")
    return F.when(v == 0, F.lit("0")).when(v < 0, F.concat(F.lit(neg), _flip(digits), F.lit(pos))).otherwise(F.concat(F.lit(pos), digits, F.lit(neg)))


def encode_large(v: Column, precision: int, neg: str = NEG, pos: str = POS) -> Column:
    """Any value as an encoded whole part, digits of the fraction, and the other sign."""
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    digits = _fraction(F.abs(v) - F.abs(whole), precision)
    return F.when(v == 0, F.lit("0")).when(v < 0, F.concat(encode_int(whole, neg, pos), _flip(digits), F.lit(pos))).otherwise(F.concat(encode_int(whole, neg, pos), digits, F.lit(neg)))


def _closed(e: Column, neg: str, pos: str) -> Column:
    """Whether an encoding of three signs or more opens with a sign and closes with the other."""
    return F.rlike(e, F.lit(rf"^(\Q{neg}\E.+\Q{pos}\E|\Q{pos}\E.+\Q{neg}\E)$"))


def decode_small(e: Column, neg: str = NEG, pos: str = POS) -> Column:
    """The value of an encoded value between -1 and 1, as double; null where the text is no such encoding."""
    below, digits = F.substring(e, 1, 1) == neg, F.substring(e, F.lit(2), F.length(e) - 2)
    value = F.concat(F.lit("0."), F.when(below, _flip(digits)).otherwise(digits)).try_cast("double")
    ok = _closed(e, neg, pos) & F.rlike(digits, F.lit("^[0-9]+$"))
    return F.when(e == "0", F.lit(0.0)).when(ok, F.when(below, -value).otherwise(value))


def decode_large(e: Column, neg: str = NEG, pos: str = POS) -> Column:
    """The value of an encoded value with a whole part, as double; null where the text is no such encoding.

    The whole part ends where its lengths say; the digits after it are the fraction's. A whole part of 0 has no sign,
    so the closing sign tells which side of zero the value lies on.
    """
    signs = F.regexp_extract(e, rf"^(\Q{neg}\E+|\Q{pos}\E+)", 1)
    zero = F.substring(e, 1, 1) == "0"
    below = F.when(zero, F.substring(e, -1, 1) == pos).otherwise(F.substring(e, 1, 1) == neg)
    body = F.substring(e, F.length(signs) + 1, F.length(e) - F.length(signs) - 1)
    plain = F.when(below, F.when(zero, F.concat(F.lit("0"), _flip(F.substring(body, 2, 1 << 20)))).otherwise(_flip(body))).otherwise(body)
    digit = F.substring(plain, 1, 1).try_cast("int")
    size = F.when(F.length(signs) <= 1, 1).when(F.length(signs) == 2, digit).otherwise(F.substring(plain, F.lit(2), digit).try_cast("int"))
    at = F.when(F.length(signs) <= 1, 0).when(F.length(signs) == 2, 1).otherwise(1 + digit)
    value = F.concat(F.substring(plain, at + 1, size), F.lit("."), F.substring(plain, at + size + 1, F.length(plain))).try_cast("double")
    closed = _closed(e, neg, pos) | F.rlike(e, F.lit(rf"^0[0-9]+(\Q{neg}\E|\Q{pos}\E)$"))
    ok = closed & F.rlike(body, F.lit("^[0-9]+$")) & (F.length(plain) >= at + size)
    return F.when(e == "0", F.lit(0.0)).when(ok, F.when(below, -value).otherwise(value))


def strict(decode, e: Column, *signs: str) -> Column:
    """``decode`` (one of the decoders above) of ``e``; a text that is no such encoding is an error, not null. Null stays null."""
    value = decode(e, *signs)
    return F.when(value.isNotNull() | e.isNull(), value).otherwise(F.raise_error(F.concat(F.lit("no such encoding: '"), e, F.lit("'"))))


def encode_float(v: Column, precision: int, neg: str = NEG, pos: str = POS) -> Column:
    """Sign, encoded power of ten (negated below zero), mantissa digits, and the other sign. Lossy beyond ``precision`` digits."""
    v = v.cast("double")
    power = F.lit(1) + F.round(F.log10(F.abs(v))).cast("int")
    digits = _fraction(F.abs(v) * F.pow(F.lit(10.0), -power), precision)
    power_text = encode_int(F.when(v < 0, -power).otherwise(power), neg, pos)
    return (
        F.when(v == 0, F.lit("0"))
        .when(v < 0, F.concat(F.lit(neg), power_text, _flip(digits), F.lit(pos)))
        .otherwise(F.concat(F.lit(pos), power_text, digits, F.lit(neg)))
    )


def decode_float(e: Column, neg: str = NEG, pos: str = POS) -> Column:
    """The value of an encoded float, as double; null where the text is no such encoding."""
    below = F.substring(e, 1, 1) == neg
    # Sign, the power's signs, the rest of the power and the mantissa, the closing sign. The power has at most three
    # digits: one sign and one digit, or two signs, their number and the digits.
    part = lambda i: F.regexp_extract(e, rf"^[\Q{neg}{pos}\E]([\Q{neg}{pos}\E]*)(\d+)[\Q{neg}{pos}\E]$", i)
    signs, digits = part(1), part(2)
    flipped, level = signs.startswith(neg), F.length(signs)
    long = F.substring(digits, 1, 1).isin("3", "6")
    skip = F.when(level == 2, 1).otherwise(0)
    size = F.when(level < 2, 1).when(long, 3).otherwise(2)
    shown = F.substring(digits, skip + 1, size)
    power = F.when(flipped, -_flip(shown).try_cast("int")).otherwise(shown.try_cast("int"))
    rest = F.substring(digits, skip + size + 1, F.length(digits))
    mantissa = F.concat(F.lit("0."), F.when(below, _flip(rest)).otherwise(rest)).try_cast("double")
    value = mantissa * F.pow(F.lit(10.0), F.when(below, -power).otherwise(power))
    closed = F.substring(e, 1, 1) != F.substring(e, -1, 1)
    return F.when(e == "0", F.lit(0.0)).when(closed & (digits != ""), F.when(below, -value).otherwise(value))


def little_endian(v: Column, size: int = 8) -> Column:
    """A whole number's ``size`` bytes, lowest first."""
    shown = F.lpad(F.hex(v.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(shown, 15 - 2 * i, 2) for i in range(size))))


def from_little_endian(b: Column) -> Column:
    """The number of eight bytes, lowest first."""
    shown = F.hex(b)
    return F.conv(F.concat(*(F.substring(shown, 15 - 2 * i, 2) for i in range(8))), 16, -10).cast("long")


def encode_key(s: Column, p: Column, s_type: str = "BYTE", p_type: str = "BYTE") -> Column:
    """Key bytes: subject, predicate, the byte 255, both lengths (8 bytes each, lowest first), both types."""
    s, p = s.cast("binary"), p.cast("binary")
    tail = F.unhex(F.lit(f"{TYPES[s_type]:02X}{TYPES[p_type]:02X}"))
    return F.concat(s, p, F.unhex(F.lit("FF")), little_endian(F.length(s)), little_endian(F.length(p)), tail)


def decode_key(key: Column) -> Column:
    """struct(s, p, s_type, p_type) of key bytes, read from their end."""
    n = F.length(key)
    s_len, p_len = from_little_endian(F.substring(key, n - 17, F.lit(8))).cast("int"), from_little_endian(F.substring(key, n - 9, F.lit(8))).cast("int")
    type_at = lambda at: F.conv(F.hex(F.substring(key, at, F.lit(1))), 16, 10).cast("int")
    return F.struct(F.substring(key, F.lit(1), s_len).alias("s"), F.substring(key, s_len + 1, p_len).alias("p"), type_at(n - 1).alias("s_type"), type_at(n).alias("p_type"))
