"""Column expressions with the study's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def loose_bool(c) -> Column:
    """True for the texts 1, true, yes and y in any case; Spark's own cast takes more."""
    return F.coalesce(F.lower(F.trim(col(c))).isin("1", "true", "yes", "y"), F.lit(False))


def loose_number(c) -> Column:
    """Null for blank or null, else a double; other texts raise."""
    t = F.trim(col(c))
    return F.when((t == "") | (F.lower(t) == "null"), None).otherwise(t.cast("double"))


def loose_int(c) -> Column:
    return loose_number(c).cast("int")


def ratio(a, b) -> Column:
    """a / b, NaN for an empty denominator."""
    return F.when(col(b) == 0, F.lit(float("nan"))).otherwise(col(a).cast("double") / col(b))


def ratio_or_zero(a, b) -> Column:
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(col(a).cast("double") / col(b))


def steady_mean(c, order: str | None = None) -> Column:
    """The mean of a group's numbers, summed from the least to the largest, or along the column ``order``: rows in any order give
    the same double, so equal means tie.  For groups that a row can hold, such as the frames of a video.
    """
    if order:
        placed = F.struct(col(order).alias("place"), col(c).alias("x"))
        own = F.sort_array(F.collect_list(F.when(col(c).isNotNull(), placed)))["x"]
    else:
        own = F.sort_array(F.collect_list(col(c)))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(own) > 0, total / F.size(own))


def parent_path(c) -> Column:
    return F.regexp_extract(col(c), "^(.*)/[^/]+$", 1)


def parent_name(c) -> Column:
    return F.element_at(F.split(col(c), "/"), -2)


def stem(c) -> Column:
    return F.regexp_extract(col(c), r"([^/]+?)(\.[^./]*)?$", 1)


def first_part(c) -> Column:
    return F.element_at(F.split(col(c), "/"), 1)


def forward_slashes(c) -> Column:
    """Backslashes to slashes, a leading ./ removed."""
    return F.regexp_replace(F.replace(col(c), F.lit("\\"), F.lit("/")), r"^\./", "")


def safe_name(c) -> Column:
    """Runs of characters outside [A-Za-z0-9_.-] to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def without_media_suffix(c) -> Column:
    return F.regexp_replace(col(c), r"(?i)\.(mp4|avi|mov|mkv)$", "")


def pair_key(a, b) -> Column:
    """A key that doesn't depend on the order of the two."""
    return F.concat_ws("_", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def clean_list(c, sep: str = ";") -> Column:
    """Trimmed non-empty parts."""
    return F.filter(F.transform(F.split(col(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def midpoints(n, budget: int) -> Column:
    """(2 p + 1) n div (2 budget) for p below budget: the middles of equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda p: F.floor((2 * p + 1) * col(n) / (2 * budget)).cast("int"))


def half_up(x) -> Column:
    """Rounded half up, 1 at least."""
    return F.greatest(F.lit(1), F.floor(col(x) + 0.5).cast("int"))


def next_up(x) -> Column:
    """The next larger double."""
    return F.expr(f"cast(reflect('java.lang.Math', 'nextUp', {x}) as double)")


def class_probability(a, b) -> Column:
    """Softmax probability of the second of two logits."""
    return 1 / (1 + F.exp(col(a) - col(b)))


def stream_seed(seed: int, name) -> Column:
    """The first eight bytes of sha256("seed::name") as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("::", F.lit(str(seed)), col(name)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def draw(n, *parts) -> Column:
    """A reproducible number below n from the md5 of the parts: the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("::", *(col(p).cast("string") for p in parts))), 1, 8), 16, 10).cast("long"), col(n))


def is_sha256(c) -> Column:
    return col(c).rlike("^[0-9a-f]{64}$")


def sorted_distinct(c) -> Column:
    """Whether an array is strictly ascending."""
    return F.array_sort(F.array_distinct(col(c))) == col(c)
