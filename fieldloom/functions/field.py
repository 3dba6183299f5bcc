"""Arithmetic of prime fields as columns.

For primes under 2^31 every function is a Catalyst expression over BIGINT, as products fit in 62 bits. For larger
primes, elements travel as decimal strings and Arrow UDFs compute with Python integers, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 257
#: The order of the scalar field of the BN254 curve.
BN254 = 21888242871839275222246405745257275088548364400416034343698204186575808495617


def col(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


class Field:
    """The integers modulo a prime under 2^31. Arguments are columns, names or integers; zero has no inverse: null."""

    def __init__(self, p: int = SMALL) -> None:
        if not 1 < p < 2**31:
            raise ValueError("a prime under 2^31 is needed; BigField takes larger ones")
        self.p, self.bits = p, p.bit_length()

    def canon(self, a) -> Column:
        return F.pmod(col(a).cast("long"), F.lit(self.p).cast("long"))

    def add(self, a, b) -> Column:
        return self.canon(self.canon(a) + self.canon(b))

    def sub(self, a, b) -> Column:
        return self.canon(self.canon(a) - self.canon(b))

    def mul(self, a, b) -> Column:
        return self.canon(self.canon(a) * self.canon(b))

    def neg(self, a) -> Column:
        return self.canon(-self.canon(a))

    def pow(self, a, n) -> Column:
        """a to the power of n >= 0, by squaring over the bits of n (61 at most)."""
        bits = F.transform(F.sequence(F.lit(60), F.lit(0)), lambda i: F.getbit(col(n).cast("long"), i.cast("int")))
        return F.aggregate(bits, F.lit(1).cast("long"), lambda acc, bit: F.when(bit == 1, self.mul(self.mul(acc, acc), a)).otherwise(self.mul(acc, acc)))

    def inv(self, a) -> Column:
        """A table for primes up to 4096; beyond, Fermat's little theorem with the exponent's bits fixed in the plan."""
        x = self.canon(a)
        if self.p <= 4096:
            table = F.lit([0, *(pow(i, -1, self.p) for i in range(1, self.p))])
            return F.when(x != 0, F.get(table, x.cast("int")).cast("long"))
        bits = F.array(*(F.lit(b == "1") for b in bin(self.p - 2)[2:]))
        power = F.aggregate(bits, F.lit(1).cast("long"), lambda acc, bit: F.when(bit, self.mul(self.mul(acc, acc), x)).otherwise(self.mul(acc, acc)))
        return F.when(x != 0, power)

    def div(self, a, b) -> Column:
        return self.mul(a, self.inv(b))

    def idiv(self, a, b) -> Column:
        d = self.canon(b)
        return F.when(d != 0, F.floor((self.canon(a) - F.pmod(self.canon(a), F.when(d != 0, d))) / F.when(d != 0, d)).cast("long"))

    def mod(self, a, b) -> Column:
        d = self.canon(b)
        return F.when(d != 0, F.pmod(self.canon(a), F.when(d != 0, d)))

    def signed(self, a) -> Column:
        """The representative in (-p/2, p/2]."""
        x = self.canon(a)
        return F.when(x >= self.p // 2 + 1, x - self.p).otherwise(x)

    def is_negative(self, a) -> Column:
        return self.canon(a) > self.p // 2

    def complement(self, a, width: int = 256) -> Column:
        """All ``width`` low bits flipped, then reduced; 0 <= a < 2^width."""
        return self.canon(F.lit((2**width - 1) % self.p) - self.canon(a))

    def _mask(self) -> int:
        return (1 << self.bits) - 1

    def shift_left(self, a, k) -> Column:
        """By k up to p/2, within the prime's bits; above p/2 it shifts right by p - k."""
        x, n = self.canon(a), self.canon(k)
        mask = F.lit(self._mask()).cast("long")
        left = lambda m: F.when(m >= self.bits, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, m.cast("int")).bitwiseAND(mask))
        right = lambda m: F.when(m >= self.bits, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", x, m.cast("int")))
        return self.canon(F.when(n <= self.p // 2, left(n)).otherwise(right(F.lit(self.p) - n)))

    def shift_right(self, a, k) -> Column:
        return self.shift_left(a, self.neg(k))

    def bit_and(self, a, b) -> Column:
        return self.canon(self.canon(a).bitwiseAND(self.canon(b)))

    def bit_or(self, a, b) -> Column:
        return self.canon(self.canon(a).bitwiseOR(self.canon(b)))

    def bit_xor(self, a, b) -> Column:
        return self.canon(self.canon(a).bitwiseXOR(self.canon(b)))

    def as_bool(self, a) -> Column:
        return (self.canon(a) != 0).cast("long")

    def not_(self, a) -> Column:
        return (self.canon(a) == 0).cast("long")

    def and_(self, a, b) -> Column:
        return self.as_bool(a) * self.as_bool(b)

    def or_(self, a, b) -> Column:
        return F.greatest(self.as_bool(a), self.as_bool(b))

    def compare(self, op: str, a, b) -> Column:
        """1 or 0; ``op`` compares signed representatives."""
        x, y = self.signed(a), self.signed(b)
        return {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op].cast("long")

    def sum(self, a) -> Column:
        """Aggregate: the terms are reduced before they are added."""
        return self.canon(F.sum(self.canon(a)))


class BigField:
    """The integers modulo any prime; elements are decimal strings, negative ones included. Null where undefined."""

    def __init__(self, p: int = BN254) -> None:
        self.p = p

    def _of(self, name: str, f: Callable[..., int | None], *args) -> Column:
        p = self.p

        @F.arrow_udf("string")
        def compute(*cols: pa.Array) -> pa.Array:
            rows = zip(*(c.to_pylist() for c in cols), strict=True)
            out = [None if None in r else f(*(int(x) % p for x in r)) for r in rows]
            return pa.array([None if x is None else str(x % p) for x in out], pa.string())

        return compute(*(col(a).cast("string") if not isinstance(a, int) else F.lit(str(a)) for a in args))

    def canon(self, a) -> Column:
        return self._of("canon", lambda x: x, a)

    def add(self, a, b) -> Column:
        return self._of("add", lambda x, y: x + y, a, b)

    def sub(self, a, b) -> Column:
        return self._of("sub", lambda x, y: x - y, a, b)

    def mul(self, a, b) -> Column:
        return self._of("mul", lambda x, y: x * y, a, b)

    def neg(self, a) -> Column:
        return self._of("neg", lambda x: -x, a)

    def inv(self, a) -> Column:
        p = self.p
        return self._of("inv", lambda x: pow(x, -1, p) if x else None, a)

    def div(self, a, b) -> Column:
        p = self.p
        return self._of("div", lambda x, y: x * pow(y, -1, p) if y else None, a, b)

    def idiv(self, a, b) -> Column:
        return self._of("idiv", lambda x, y: x // y if y else None, a, b)

    def mod(self, a, b) -> Column:
        return self._of("mod", lambda x, y: x % y if y else None, a, b)

    def pow(self, a, n) -> Column:
        p = self.p
        return self._of("pow", lambda x, y: pow(x, y, p), a, n)

    def signed(self, a) -> Column:
        p = self.p

        @F.arrow_udf("string")
        def compute(values: pa.Array) -> pa.Array:
            reduced = [None if x is None else int(x) % p for x in values.to_pylist()]
            return pa.array([None if x is None else str(x - p if x > p // 2 else x) for x in reduced], pa.string())

        return compute(col(a).cast("string"))

    def complement(self, a, width: int = 256) -> Column:
        return self._of("complement", lambda x: (1 << width) - 1 - x, a)

    def bit_and(self, a, b) -> Column:
        return self._of("and", lambda x, y: x & y, a, b)

    def bit_or(self, a, b) -> Column:
        return self._of("or", lambda x, y: x | y, a, b)

    def bit_xor(self, a, b) -> Column:
        return self._of("xor", lambda x, y: x ^ y, a, b)

    def shift_left(self, a, k) -> Column:
        p = self.p
        mask = (1 << p.bit_length()) - 1
        cut = lambda n: min(n, p.bit_length() + 1)
        return self._of("shl", lambda x, n: (x << cut(n)) & mask if n <= p // 2 else x >> cut(p - n), a, k)

    def shift_right(self, a, k) -> Column:
        return self.shift_left(a, self.neg(k))
