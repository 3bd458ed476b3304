"""Small value expressions: ids, times, pooled vectors, hashed token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base-32 alphabet of time-ordered ids, and the id range of hashed tokens.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
FIRST_ID, ID_RANGE, MOST_IDS, OPEN_ID, CLOSE_ID = 1000, 29522, 510, 101, 102


def _base32(n: Column, digits: int) -> Column:
    alphabet = F.lit(CROCKFORD)
    parts = [F.substring(alphabet, (F.pmod(F.shiftrightunsigned(n, 5 * k), F.lit(32)) + 1).cast("int"), F.lit(1)) for k in reversed(range(digits))]
    return F.concat(*parts)


def ordered_id(prefix: str, at: Column, *keys: Column) -> Column:
    """A prefixed 26-digit id whose first ten digits are the milliseconds of ``at``; the rest is a hash of the keys.

    It sorts by time and is the same again for the same row, unlike a random one.
    """
    low, high = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    return F.concat(F.lit(f"{prefix}-"), _base32(F.unix_millis(at), 10), _base32(low, 8), _base32(high, 8))


def from_epoch_ns(ns: Column) -> Column:
    """A timestamp from nanoseconds, to the microsecond; null for zero and less."""
    return F.when(ns > 0, F.timestamp_micros(F.floor(ns / 1000)))


def relative_time(at: Column, now: Column) -> Column:
    """``just now``, or whole minutes, hours, days, months of 30 or years of 365 days ago or ahead."""
    ms = F.unix_millis(now) - F.unix_millis(at)
    size, out = F.abs(ms), F.lit("just now")
    for label, unit in (("minute", 60), ("hour", 3600), ("day", 86400), ("month", 2592000), ("year", 31536000)):
        n = F.floor(size / (unit * 1000))
        words = F.concat(n.cast("string"), F.lit(f" {label}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(n >= 1, F.when(ms < 0, F.concat(F.lit("in "), words)).otherwise(F.concat(words, F.lit(" ago")))).otherwise(out)
    return out


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is not 0, zeros if none is."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    size = F.size(F.element_at(vectors, 1))
    zero = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def hashed_ids(text: Column) -> Column:
    """Token ids by string hash: 31-based over code points in 32 bits, without sign, into the id range; 512 at most."""
    words = F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, MOST_IDS)
    wrap = lambda x: F.pmod(x, F.lit(1 << 32))
    code = lambda w: F.aggregate(F.filter(F.split(w, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: wrap(acc * 31 + F.ascii(c)))
    ids = F.transform(words, lambda w: (F.pmod(F.pmod(code(w), F.lit(1 << 31)), F.lit(ID_RANGE)) + FIRST_ID).cast("int"))
    return F.concat(F.array(F.lit(OPEN_ID)), ids, F.array(F.lit(CLOSE_ID)))
