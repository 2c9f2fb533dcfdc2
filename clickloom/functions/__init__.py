"""Scalar expressions: labels and bins, strings, dates, arrays and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.config import COHORTS, EVENT_CODES, UNKNOWN

# Bin edges and labels of the reports. An upper edge of None is the open last bin.
PRICE_BINS = ((0, "<=0"), (1, "0-1"), (10, "1-10"), (50, "10-50"), (100, "50-100"), (500, "100-500"),
              (1000, "500-1k"), (5000, "1k-5k"), (10000, "5k-10k"), (None, ">10k"))
USER_BINS = ((1, "1"), (4, "2-4"), (9, "5-9"), (19, "10-19"), (49, "20-49"), (99, "50-99"), (499, "100-499"),
             (999, "500-999"), (4999, "1k-5k"), (9999, "5k-10k"), (None, ">10k"))
USER_BINS_SHORT = ((5, "1-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (500, "101-500"),
                   (None, "500+"))
PER_DAY_BINS = ((10, "1-10"), (50, "11-50"), (100, "51-100"), (200, "101-200"), (500, "201-500"),
                (1000, "501-1k"), (None, ">1k"))
ITEM_BINS = ((1, "1"), (4, "2-4"), (9, "5-9"), (19, "10-19"), (99, "20-99"), (499, "100-499"),
             (4999, "500-4999"), (49999, "5k-50k"), (None, ">50k"))
ITEM_BINS_SHORT = ((1, "1"), (3, "2-3"), (5, "4-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (None, "100+"))
SESSION_BINS = ((1, "1 (single event)"), (3, "2-3"), (5, "4-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"),
                (100, "51-100"), (None, ">100"))
SESSION_BINS_SHORT = ((1, "1"), (3, "2-3"), (5, "4-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (None, "50+"))
PURCHASE_BINS = ((0, "0"), (1, "1"), (3, "2-3"), (9, "4-9"), (19, "10-19"), (None, "20+"))
PRICE_LEVELS = (10, 50, 100, 200, 500, 1000, 2000)
SHARE_CUTS = ((0.5, "<50%"), (0.7, "50-70%"), (0.85, "70-85%"), (1.0, ">85%"))
SPREAD_CUTS = ((0.5, "very_consistent"), (1.0, "consistent"), (2.0, "mixed"), (4.0, "random"))
ACRONYMS = ("lg", "hp", "aeg", "tcl", "bmw", "kia", "cpu", "ssd", "led", "rgb", "usb", "hdmi", "tv", "jbl", "msn")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_most_label(c: Column | str, bins: Sequence) -> Column:
    """Label of the first bin whose upper edge is >= the value (the last bin is open)."""
    c, out = col(c), None
    for upper, label in bins:
        if upper is None:
            return out.otherwise(label)
        out = F.when(c <= upper, label) if out is None else out.when(c <= upper, label)
    return out


def bin_order(c: Column | str, bins: Sequence) -> Column:
    """Position of a label in its bin list, for sorting a report."""
    return F.array_position(F.array(*[F.lit(label) for _, label in bins]), col(c))


def price_label(c: Column | str) -> Column:
    c = col(c)
    out = F.when(c.isNull(), "NULL").when(c <= 0, "<=0")
    for upper, label in PRICE_BINS[1:]:
        out = out.otherwise(label) if upper is None else out.when(c < upper, label)
    return out


def price_level(c: Column | str) -> Column:
    """Log-spaced price level 0..7."""
    c, out = col(c), None
    for level, upper in enumerate(PRICE_LEVELS):
        out = F.when(c < upper, level) if out is None else out.when(c < upper, level)
    return out.otherwise(len(PRICE_LEVELS))


def cohort(c: Column | str) -> Column:
    """cold / medium / warm by number of training interactions; null below the first cohort."""
    c, out = col(c), None
    for name, low, high in COHORTS:
        inside = c >= low if high is None else c.between(low, high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def event_code(c: Column | str) -> Column:
    """Numeric event type; unknown types give null."""
    c, out = col(c), None
    for name, code in EVENT_CODES.items():
        out = F.when(c == name, code) if out is None else out.when(c == name, code)
    return out.cast("long")


def part_of(c: Column | str, i: int) -> Column:
    """i-th dot-separated segment, null when absent."""
    return F.get(F.split(col(c), "[.]"), F.lit(i))


def brand_title(c: Column | str) -> Column:
    """Title-case each word, upper-case known acronyms; empty gives 'Unknown'."""
    c = F.trim(F.lower(F.coalesce(col(c), F.lit(""))))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    named = F.transform(words, lambda w: F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w)))
    return F.when(c == "", "Unknown").otherwise(F.array_join(named, " "))


def leading_int(c: Column | str) -> Column:
    """Number before the dash of a bin label, null when there is none."""
    return F.get(F.split(col(c), "-"), F.lit(0)).try_cast("int")


def month_of(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part, whole) * 100, digits)


def n_rows() -> Column:
    return F.count(F.lit(1))


def is_type(name: str) -> Column:
    return F.col("event_type") == name


def count_type(name: str) -> Column:
    return F.count_if(F.coalesce(is_type(name), F.lit(False)))


def known(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(UNKNOWN))


def tail(arr: Column | str, n: int | Column) -> Column:
    """Last n elements (all of them when shorter)."""
    arr, n = col(arr), F.lit(n) if isinstance(n, int) else n
    return F.slice(arr, F.greatest(F.size(arr) - n, F.lit(0)) + 1, F.greatest(n, F.lit(0)))


def left_pad(arr: Column | str, n: int, fill: int = 0) -> Column:
    """Fixed length n: the last n elements, zeros in front when shorter."""
    kept = tail(arr, n)
    return F.concat(F.array_repeat(F.lit(fill).cast("long"), F.lit(n) - F.size(kept)), kept)


def init(arr: Column | str) -> Column:
    """All but the last element."""
    return F.slice(col(arr), 1, F.greatest(F.size(col(arr)) - 1, F.lit(0)))


def drop_adjacent_repeats(arr: Column | str) -> Column:
    arr = col(arr)
    return F.filter(arr, lambda x, i: (i == 0) | (x != F.get(arr, i - 1)))


def dot(a: Column | str, b: Column | str) -> Column:
    terms = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def mean_vector(c: Column | str) -> Column:
    """Element-wise mean of a group's vectors; combines before the shuffle, one buffer of sums a group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(col(c), lambda x: x.cast("double")))))


def sum_vector(c: Column | str) -> Column:
    """Element-wise sum of a group's vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(F.transform(col(c), lambda x: x.cast("double")))))


def distinct_by_bitmap(df, keys, number: str, name: str):
    """(keys, name): different values of a non-negative long per key, counted in bitmaps of 32,768 values each.

    Bitmaps of a key merge before the shuffle, whatever the number of rows, and stay 4 KiB each.
    """
    bits = df.groupBy(*keys, F.bitmap_bucket_number(F.col(number)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias("_bits"))
    return bits.groupBy(*keys).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def unit(a: Column | str) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    length = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    # The length is spread over an array so that it is computed once per vector, not per element.
    return F.zip_with(col(a), F.array_repeat(length, F.size(col(a))), lambda x, n: x.cast("double") / n)


def text_list(arr: Column | str) -> Column:
    """Comma-joined text of an array, for reports and comparisons."""
    return F.array_join(F.transform(col(arr), lambda x: x.cast("string")), ",")


def time_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
