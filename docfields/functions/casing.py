"""Case folding that keeps positions.

Literal labels are looked up by plain byte search on folded text instead of by a case-insensitive
regular expression: much cheaper per character, no pattern to compile for labels that come from data,
and the position found is valid in the original text because folding never changes the length.
"""

from pyspark.sql import Column, functions as F


def _irregular_letters() -> dict[str, str]:
    """Letters that ignore-case matching equates with another lower-case letter.

    Two letters are equal when their upper-case forms have the same lower-case form, as in `ſ` and
    `s`. Lower-casing alone misses these, depends on context for the capital sigma and lengthens the
    dotted capital I.
    """
    found = {"Σ": "σ", "İ": "i"}
    for cp in range(0x80, 0x10000):
        letter = chr(cp)
        upper = letter.upper()
        if len(upper) == 1 and len(upper.lower()) == 1 and letter.lower() != upper.lower():
            found[letter] = upper.lower()
    return found


IRREGULAR = _irregular_letters()
_FROM, _TO = "".join(IRREGULAR), "".join(IRREGULAR.values())
# Nearly all text is settled by the first, cheap range test.
_ANY_CANDIDATE = "[\u00b5\u0130-\uffff]"
_ANY_IRREGULAR = f"[{_FROM}]"


def fold(c: Column) -> Column:
    irregular = c.rlike(_ANY_CANDIDATE) & c.rlike(_ANY_IRREGULAR)
    return F.lower(F.when(irregular, F.translate(c, _FROM, _TO)).otherwise(c))


def fold_str(text: str) -> str:
    return text.translate(str.maketrans(IRREGULAR)).lower()
