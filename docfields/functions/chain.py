"""Chains: the value found for a term is searched as the next term, for up to `n` hops.

The hops run inside the row (an `aggregate` over hop numbers), so neither the plan nor the number of
copies of the page text grows with `n`.
"""

from pyspark.sql import Column, functions as F

from docfields.fixed import SNIPPET_WIDTH
from docfields.functions.casing import fold
from docfields.functions.search import Patterns, let, search_term

CHAIN_TYPE = "array<struct<term:string,value:string>>"


def check_hops(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"n must be a non-negative integer, got {n!r}")
    return n


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def start(hit: Column) -> Column:
    """The chain of a first hit (`struct<key, value>`): one hop, or none if key or value is empty."""
    hop = F.struct(hit["key"].alias("term"), hit["value"].alias("value"))
    return F.when(_filled(hit["key"]) & _filled(hit["value"]), F.array(hop)).otherwise(
        F.array().cast(CHAIN_TYPE)
    )


def extend(chain_: Column, text: Column, low: Column, n: int, patterns: Patterns | None = None,
           full_numbers: bool = False, word_boundary: bool = False, width: int = SNIPPET_WIDTH) -> Column:
    """Follow a one-hop chain up to `n` hops; it ends early at the first hop that finds nothing."""
    if n < 2:
        return chain_

    def step(acc: Column, hop_no: Column) -> Column:
        def follow(last: Column) -> Column:
            hit = search_term(text, last["value"], patterns, low, full_numbers, word_boundary, width)
            return F.concat(acc, let(hit, start))

        alive = F.size(acc) == hop_no
        return F.when(alive, let(F.get(acc, hop_no - 1), follow)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), chain_, step)


def chain(text: Column, term: Column | str, n: int, patterns: Patterns | None = None,
          low: Column | None = None, full_numbers: bool = False,
          word_boundary: bool = False) -> Column:
    """All hops from `term` as `array<struct<term, value>>`; empty if the first search fails.

    `n = 0` is a single search and gives the same hop as `n = 1`.
    """
    check_hops(n)

    def hops(low_: Column) -> Column:
        hit = search_term(text, term, patterns, low_, full_numbers, word_boundary)
        return extend(let(hit, start), text, low_, n, patterns, full_numbers, word_boundary)

    return let(fold(text) if low is None else low, hops)


def chain_value(chain_: Column, term: Column | str, n: int) -> Column:
    """`(initial term, last value)` of a chain as `struct<key, value>`, both NULL for an empty one.

    With `n = 0` the key is the spelling found.
    """
    initial = F.lit(term) if isinstance(term, str) else term
    key = initial if check_hops(n) else F.get(chain_, F.lit(0))["term"]
    some = F.size(chain_) > 0
    return F.struct(
        F.when(some, key).alias("key"),
        F.when(some, F.try_element_at(chain_, F.lit(-1))["value"]).alias("value"),
    )


def chain_trace(chain_: Column) -> Column:
    """`(last hop's term, last hop's value)` as `struct<key, value>`."""
    last = F.try_element_at(chain_, F.lit(-1))
    return F.struct(last["term"].alias("key"), last["value"].alias("value"))


def chain_path(chain_: Column) -> Column:
    """`term:value -> term:value -> …`; NULL for an empty chain."""
    hops = F.transform(chain_, lambda h: F.concat(h["term"], F.lit(":"), h["value"]))
    return F.when(F.size(chain_) > 0, F.array_join(hops, " -> "))
