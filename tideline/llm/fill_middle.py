"""Fill-in-middle transformation of texts by a constant-memory two-pass matcher.

A unit is a match of a pattern, found from left to right. The first pass counts the units of a
text; the second advances a lazy match iterator to the two ranks at which the text is cut. No
list of units exists at any time, whatever the length of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, whole_text

#: The marks of prefix, suffix and middle, and one code point as a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"

COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def counted(unit: re.Pattern, text: str) -> int:
    """How many units a text has; each match is dropped before the next is sought."""
    n = count()
    deque(zip(unit.finditer(text), n), maxlen=0)  # the counter is not advanced where the matches end
    return next(n)


def ends(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the units of ranks ``low`` <= ``high`` end (rank 0: the start of the text), by one run of the matcher."""
    matches = unit.finditer(text)
    first = 0 if low == 0 else next(islice(matches, low - 1, None)).end()
    return first, first if high == low else next(islice(matches, high - low - 1, None)).end()


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of the SHA-256 of the seed and the decimal id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))  # type: ignore[return-value]


def rearranged(text: str, doc_id: int | None, unit: re.Pattern, seed: str = "1", plain: int = 10, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain) and the transformed text."""
    n = counted(unit, text)
    a, b, keep, order = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or keep % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = a % (n + 1), b % (n + 1)
    first, second = ends(unit, text, min(a, b), max(a, b))
    if order % 100 < suffix_first:
        return n, "spm", first, second - first, "".join((SUFFIX, text[second:], PREFIX, text[:first], MIDDLE, text[first:second]))
    return n, "psm", first, second - first, "".join((PREFIX, text[:first], SUFFIX, text[second:], MIDDLE, text[first:second]))


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1", plain: int = 10, suffix_first: int = 20, slice_bytes: int = 1 << 24
) -> DataFrame:
    """Every whole text cut into prefix, middle and suffix and put together in another order.

    Returns doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code
    points, null if plain) and output, one row per input row in one narrow pass. The ranks, the
    ``plain`` percent that stay as they are and the ``suffix_first`` percent of the others
    that begin with the suffix are drawn from ``seed`` and the id. Text before the first, between
    and behind the units belongs to the part that it stands in. Texts that hold a mark stay plain,
    so that an output and its form always give back the text (``restored``).

    Null and empty texts are plain with 0 units. Null ids share one draw; repeated rows repeat
    their result; other columns are ignored. Bytes that are no UTF-8 become U+FFFD.
    Results leave in slices of about ``slice_bytes``.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:5], pa.Array.from_buffers(pa.string(), len(rows), arrays[5].buffers())], names=[c.split()[0] for c in COLUMNS.split(", ")])

    def run(batches):
        pattern = re.compile(unit)
        for b in batches:
            rows, held = [], 0
            for doc_id, raw in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                *out, text = rearranged(raw.decode("utf-8", "replace"), doc_id, pattern, seed, plain, suffix_first)
                rows.append((doc_id, *out, text.encode()))
                held += len(raw)
                if held > slice_bytes:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A text with a mark stays plain, and no mark can begin within another, so that the first
    mark of each kind is the one that was put in.
    """

    def parts(second: str, swap: bool) -> Column:
        at = F.instr(output, second)
        end = F.instr(output, MIDDLE)
        one = F.substring(output, F.lit(len(PREFIX) + 1), at - len(PREFIX) - 1)
        two = F.substring(output, at + len(second), end - at - len(second))
        rest = F.substring(output, end + len(MIDDLE), F.char_length(output))
        return F.concat(two, rest, one) if swap else F.concat(one, rest, two)

    return F.when(form == "psm", parts(SUFFIX, False)).when(form == "spm", parts(PREFIX, True)).otherwise(output)
