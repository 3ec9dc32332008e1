"""Distance and similarity metrics.

Every metric has a Column builder, which keeps the work inside whole-stage code generation: with a known dimension
the sum over components is unrolled into one arithmetic expression, else it is a higher-order function.  The
metrics that rank vectors also have a NumPy block kernel for the Arrow paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this dimension sums are unrolled; longer expressions would leave compiled code.
UNROLL_MAX = 256
#: Machine epsilon of 32-bit floats, the smoothing of the divergence.
EPSILON = 1.1920928955078125e-07

Pairwise = Callable[[Column, Column], Column]


class Pair:
    """Two vectors and the sums over their components.  ``b`` may be a list of numbers: a constant vector, whose
    components go into the unrolled expression as they are."""

    def __init__(self, a: Column, b: Column | list[float], dim: int | None, unroll: int = UNROLL_MAX):
        self.constant = None if isinstance(b, Column) else [float(x) for x in b]
        if self.constant is not None and dim is None:
            dim = len(self.constant)
        self.dim = dim if dim is not None and dim <= unroll else None
        # unrolled components are cast one by one, whole arrays only for higher-order functions
        whole = F.array(*map(F.lit, self.constant)) if self.constant is not None else b
        self.a, self.b = (a, whole) if self.dim is not None else (a.cast("array<double>"), whole.cast("array<double>"))

    def sum(self, f: Pairwise) -> Column:
        if self.dim is None:
            return F.aggregate(F.zip_with(self.a, self.b, f), F.lit(0.0), lambda s, x: s + x)
        if self.dim == 0:
            return F.lit(0.0)
        right = [F.lit(x) for x in self.constant] if self.constant is not None else [self.b[i].cast("double") for i in range(self.dim)]
        return reduce(lambda s, x: s + x, (f(self.a[i].cast("double"), right[i]) for i in range(self.dim)))

    def checked(self, value: Column) -> Column:
        """Null if a vector is null; an error if they differ in size or hold a null."""
        wrong = F.raise_error(F.lit("vectors must have the same dimension"))
        hole = F.raise_error(F.lit("vectors must not contain NULL"))
        if self.constant is not None:
            null, size = self.a.isNull(), F.size(self.a) == len(self.constant)
            if self.dim is not None and self.dim != len(self.constant):
                size = F.lit(False)
        elif self.dim is None:
            null, size = self.a.isNull() | self.b.isNull(), F.size(self.a) == F.size(self.b)
        else:
            null, size = self.a.isNull() | self.b.isNull(), (F.size(self.a) == self.dim) & (F.size(self.b) == self.dim)
        return F.when(null, F.lit(None).cast("double")).when(~size, wrong.cast("double")).otherwise(F.coalesce(value, hole.cast("double")))

    @property
    def dot(self) -> Column:
        return self.sum(lambda x, y: x * y)

    @property
    def norms(self) -> tuple[Column, Column]:
        return F.sqrt(self.sum(lambda x, y: x * x)), F.sqrt(self.sum(lambda x, y: y * y))


NAN = float("nan")


def _l2sq(p: Pair) -> Column:
    return p.sum(lambda x, y: (x - y) * (x - y))


def _cosine(p: Pair) -> Column:
    na, nb = p.norms
    # a zero vector has no direction: not a number, like the host engine's SQL function
    return F.when((na == 0) | (nb == 0), F.lit(NAN)).otherwise(p.dot / (na * nb))


def _cosine_index(p: Pair) -> Column:
    na, nb = p.norms
    return F.when((na == 0) & (nb == 0), F.lit(0.0)).when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - p.dot / (na * nb))


def _pearson(p: Pair) -> Column:
    n = F.size(p.a).cast("double") if p.dim is None else F.lit(float(p.dim))
    sa, sb = p.sum(lambda x, y: x), p.sum(lambda x, y: y)
    qa, qb = p.sum(lambda x, y: x * x), p.sum(lambda x, y: y * y)
    spread = (n * qa - sa * sa) * (n * qb - sb * sb)
    return F.when((n <= 1) | (spread <= 0), F.lit(0.0)).otherwise(1 - (n * p.dot - sa * sb) / F.sqrt(spread))


def _divergence(p: Pair) -> Column:
    def term(x: Column, y: Column) -> Column:
        middle = (x + y) / 2 + EPSILON
        return x * F.ln((x + EPSILON) / middle) + y * F.ln((y + EPSILON) / middle)

    return p.sum(term) / 2


def _kullback(p: Pair) -> Column:
    return p.sum(lambda x, y: x * F.ln((x + EPSILON) / (y + EPSILON)))


def _haversine(p: Pair) -> Column:
    la, lb = F.radians(p.a[0]), F.radians(p.b[0])
    dlat, dlon = lb - la, F.radians(p.b[1]) - F.radians(p.a[1])
    x = F.pow(F.sin(dlat / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(x, F.lit(1.0))))


_DENSE: dict[str, Callable[[Pair], Column]] = {
    "l2": lambda p: F.sqrt(_l2sq(p)),
    "l2sq": _l2sq,
    "inner_product": lambda p: p.dot,
    "negative_inner_product": lambda p: -p.dot,
    "ip": lambda p: 1 - p.dot,
    "cosine_similarity": _cosine,
    "cosine_distance": lambda p: 1 - _cosine(p),
    "cosine": _cosine_index,
    "pearson": _pearson,
    "divergence": _divergence,
    "kullback_leibler": _kullback,
    "haversine": _haversine,
}

#: Other spellings of a metric.
ALIASES = {
    "euclidean_sq": "l2sq", "inner": "ip", "dot": "ip", "cos": "cosine", "angular": "cosine",
    "js": "divergence", "jensen_shannon": "divergence", "kl": "kullback_leibler", "dice": "sorensen",
}


def _bits(a: Column, b: Column, f: Pairwise) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed words."""
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y))


def tanimoto(a: Column, b: Column) -> Column:
    union = _bits(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - _bits(a, b, lambda x, y: x.bitwiseAND(y)) / union)


def sorensen(a: Column, b: Column) -> Column:
    ones = _bits(a, b, lambda x, y: x.bitwiseAND(x)) + _bits(a, b, lambda x, y: y.bitwiseAND(y))
    return F.when(ones == 0, F.lit(0.0)).otherwise(1 - 2 * _bits(a, b, lambda x, y: x.bitwiseAND(y)) / ones)


def jaccard(a: Column, b: Column) -> Column:
    """Distance of two arrays read as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


_BINARY = {"hamming": hamming, "tanimoto": tanimoto, "sorensen": sorensen, "jaccard": jaccard}


def complex_dot(a: Column, b: Column, dim: int | None = None, conjugate: bool = False) -> Column:
    """(re, im) of the product sum of interleaved complex vectors; ``conjugate`` turns the first one around."""
    half = F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1)
    sign = -1.0 if conjugate else 1.0
    at = lambda v, i, o: v[2 * i + o].cast("double")
    add = lambda f: F.aggregate(F.transform(half, f), F.lit(0.0), lambda s, x: s + x)
    re = add(lambda i: at(a, i, 0) * at(b, i, 0) - sign * at(a, i, 1) * at(b, i, 1))
    im = add(lambda i: at(a, i, 0) * at(b, i, 1) + sign * at(a, i, 1) * at(b, i, 0))
    return F.struct(re.alias("re"), im.alias("im"))


def to_i8(v: Column) -> Column:
    """Components times 100, cut to whole numbers within -100 and 100."""
    return F.transform(v, lambda x: F.greatest(F.lit(-100), F.least(F.lit(100), (x.cast("float") * F.lit(100.0).cast("float")).cast("int"))).cast("byte"))


def to_bits(v: Column) -> Column:
    """Positive components as set bits, the first one in the highest bit, in 64-bit words."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))

    def word(w: Column) -> Column:
        part = F.slice(v, w * 64 + 1, F.lit(64))
        return F.aggregate(F.zip_with(part, F.sequence(F.lit(0), F.size(part) - 1), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(words, word)


def from_bits(words: Column, dim: int) -> Column:
    """0 and 1 components of packed words."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.call_function("shiftrightunsigned", F.element_at(words, (i / 64).cast("int") + 1), F.lit(63) - i % 64).bitwiseAND(F.lit(1).cast("long")).cast("float"))


def canonical(name: str) -> str:
    low = name.lower()
    low = ALIASES.get(low, low)
    if low not in _DENSE and low not in _BINARY:
        raise ValueError(f"Unknown metric: {name}")
    return low


def distance(metric: str | Callable[[Column, Column], Column], a: Column, b: Column | list[float], dim: int | None = None) -> Column:
    """The value of a metric, by name, alias or as a caller's own function of two columns; ``b`` may be a constant."""
    if callable(metric):
        return metric(a, b)
    name = canonical(metric)
    if name in _BINARY:
        return _BINARY[name](a, b)
    # several sums over a long vector would outgrow compiled code; a constant's norm costs nothing
    wide = name == "pearson" or name.startswith("cosine") and isinstance(b, Column)
    pair = Pair(a, b, dim, unroll=UNROLL_MAX // 5 if wide else UNROLL_MAX)
    return pair.checked(_DENSE[name](pair))


def constant_distance(metric: str, column: str, query: list[float]) -> Column:
    """A ranking metric against a constant vector, parsed from one text: building it term by term costs more than a
    small query takes to run."""
    query = [float(x) for x in query]
    if not 0 < len(query) <= UNROLL_MAX or not np.isfinite(query).all():
        return distance(metric, F.col(column), query)
    name = f"`{column}`"
    each = [f"cast({name}[{i}] AS DOUBLE)" for i in range(len(query))]
    constant = [f"({x!r}D)" for x in query]
    dot = " + ".join(f"{x} * {c}" for x, c in zip(each, constant, strict=True))
    if metric == "l2":
        value = "sqrt(" + " + ".join(f"({x} - {c}) * ({x} - {c})" for x, c in zip(each, constant, strict=True)) + ")"
    elif metric in ("inner_product", "negative_inner_product"):
        value = f"-({dot})" if metric == "negative_inner_product" else dot
    else:
        norm, own = "sqrt(" + " + ".join(f"{x} * {x}" for x in each) + ")", float(np.sqrt(sum(x * x for x in query)))
        value = f"CASE WHEN {norm} = 0 OR {own!r}D = 0 THEN double('NaN') ELSE ({dot}) / ({norm} * {own!r}D) END"
        value = f"1 - ({value})" if metric == "cosine_distance" else value
    wrong, hole = (f"cast(raise_error('vectors must {text}') AS DOUBLE)" for text in ("have the same dimension", "not contain NULL"))
    return F.expr(f"CASE WHEN {name} IS NULL THEN cast(NULL AS DOUBLE) WHEN size({name}) <> {len(query)} THEN {wrong} ELSE coalesce({value}, {hole}) END")


def cosine_i8(a: Column, b: Column, dim: int | None = None) -> Column:
    """Cosine distance of byte vectors; 0 where the product sum is 0."""
    p = Pair(a, b, dim)
    na, nb = p.norms
    return F.when(p.dot == 0, F.lit(0.0)).otherwise(1 - p.dot / (na * nb))


@dataclass(frozen=True)
class Ranking:
    """A metric that ranks: ``value`` what is shown, ``descending`` whether large is near, ``block`` its kernel."""

    value: str
    descending: bool
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _block_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0))


def _block_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :])


#: Ranking metrics of the kNN operators.  ``distance`` forms rank ascending.
RANKINGS = {
    "l2": Ranking("l2", False, _block_l2),
    "cosine_distance": Ranking("cosine_distance", False, lambda q, x: 1 - _block_cosine(q, x)),
    "negative_inner_product": Ranking("negative_inner_product", False, lambda q, x: -(q @ x.T)),
    "cosine_similarity": Ranking("cosine_similarity", True, _block_cosine),
    "inner_product": Ranking("inner_product", True, lambda q, x: q @ x.T),
}

#: What an index metric ranks by: the user-visible distance of each.
INDEX_METRICS = {"l2sq": "l2", "cosine": "cosine_distance", "ip": "negative_inner_product"}


def exact_pairs(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of single pairs (rows of q and x), component by component, so equal vectors get equal values."""
    add = lambda m: np.ascontiguousarray(m.T).sum(axis=0)
    if metric == "l2":
        return np.sqrt(add((q - x) ** 2))
    dot = add(q * x)
    if metric == "inner_product":
        return dot
    if metric == "negative_inner_product":
        return -dot
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = dot / (np.sqrt(add(q * q)) * np.sqrt(add(x * x)))
    return cosine if metric == "cosine_similarity" else 1 - cosine
