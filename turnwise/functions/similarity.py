"""n-grams, bags and cosines of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(items: Column, n: int) -> Column:
    """Contiguous n-grams, joined by a space; none if there are fewer items."""
    if n == 1:
        return items
    places = F.sequence(F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(1)))
    made = F.transform(places, lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, made).otherwise(F.array().cast("array<string>"))


def lacking(items: Column, shared: Column, key: str = "key") -> Column:
    """The structs of an array whose key is not in shared, repeats kept."""
    return F.filter(items, lambda x: ~F.array_contains(shared, x[key]))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two string arrays; 0 if either is empty.  Both are sorted together and
    read once, so the work grows with their length and not with its square, and no row is moved."""
    marked = lambda items, s: F.transform(items, lambda x: F.struct(x.alias("g"), F.lit(s).alias("s")))
    both = F.sort_array(F.concat(marked(a, 1), marked(b, 2)))
    number = F.lit(0).cast("long")
    zero = F.struct(F.lit(None).cast("string").alias("g"), *[number.alias(n) for n in ("a", "b", "ab", "aa", "bb")])

    def closed(t):
        return t["ab"] + t["a"] * t["b"], t["aa"] + t["a"] * t["a"], t["bb"] + t["b"] * t["b"]

    def step(t, x):
        one, two = (F.when(x["s"] == s, 1).otherwise(0).cast("long") for s in (1, 2))
        ab, aa, bb = closed(t)
        go_on = F.struct(t["g"].alias("g"), (t["a"] + one).alias("a"), (t["b"] + two).alias("b"), t["ab"].alias("ab"), t["aa"].alias("aa"), t["bb"].alias("bb"))
        start = F.struct(x["g"].alias("g"), one.alias("a"), two.alias("b"), ab.alias("ab"), aa.alias("aa"), bb.alias("bb"))
        return F.when(t["g"] == x["g"], go_on).otherwise(start)

    def finish(t):
        ab, aa, bb = closed(t)
        return F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(ab / (F.sqrt(aa.cast("double")) * F.sqrt(bb.cast("double"))))

    return F.aggregate(both, zero, step, finish)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is null or empty, 0 if either has no length."""
    add = lambda acc, x: acc + x
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, add)
    na, nb = (F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, add)) for v in (a, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0), None).when((na == 0) | (nb == 0), zero).otherwise(dot / (na * nb))


def strict_mean(columns: list[Column]) -> Column:
    """Mean that is null if any is null."""
    return sum(columns[1:], columns[0]) / len(columns)


def present_mean(columns: list[Column]) -> Column:
    """Mean of those that are not null; null if none is."""
    n = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(n > 0, total / n)
