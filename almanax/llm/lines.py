"""Column functions on words and lines that the native text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that end a word: \\x20 and \\x09-\\x0D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def has_word(line: Column) -> Column:
    return F.translate(line, SPACES, "") != ""


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """64-bit hash of a line without outer white space and with letters lower-cased."""
    return F.xxhash64(F.lower(F.btrim(line, F.lit(SPACES))))


#: A line is boilerplate of a host if more than one in so many of the host's distinct pages hold it.
ONE_IN = 10
#: Square of the normal quantile of the test by which the share has to exceed 1 / ONE_IN: one-sided, about 95%. 0 is the plain share.
Z_SQUARED = 2.7


def is_boilerplate(pages: Column, host_pages: Column, one_in: int = ONE_IN, z_squared: float = Z_SQUARED) -> Column:
    """Whether a line on so many of a host's pages is boilerplate, two at least, by a share that few pages can't show by chance.

    The share's lower confidence bound (a one-sided score test) has to exceed 1 / one_in. Pages are distinct texts. The test has
    no cut-off: 2 of 6 pages pass, as do 3 of 12 and 116 of 1,000. Squares are of doubles: they are exact to some 10^8 pages and
    right to 15 digits beyond, where those of 64-bit numbers would overflow.
    """
    over = (one_in * pages - host_pages).cast("double")
    return (pages >= 2) & (over > 0) & (10.0 * over * over > round(10 * z_squared, 6) * (one_in - 1) * host_pages.cast("double"))
