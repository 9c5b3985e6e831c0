"""Column functions on text that the operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words of four letters and more, from general knowledge of the language.
STOPWORDS = (
    "about above after again against along also although always among around because been before behind below between both could does down during each either else even ever every from "
    "have here however into itself just less like many might more most much must near neither never none once only other over rather same several shall should since some such than that "
    "their them then there these they this those though through thus together toward under until upon very were what when where whether which while whom whose will with within without would your"
).split()
QUERY_STOPWORDS = "a an and any are as at be by can did do does for from how in is it of on or say says that the this to under was what when where which who why with".split()


def squeezed(text: Column) -> Column:
    """Ligatures opened, blanks squeezed, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), r"\s+", " "))


def lines(text: Column) -> Column:
    """The lines of a text that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def words(text: Column, pattern: str = "[a-z0-9]{3,}") -> Column:
    """Lower-case matches of ``pattern``."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def topical_terms(text: Column, limit: int, pattern: str = "[a-z]{4,}") -> Column:
    """The first ``limit`` different words of a text that aren't stop words."""
    return F.slice(F.array_except(words(text, pattern), F.array(*map(F.lit, STOPWORDS))), 1, limit)


def query_terms(query: Column) -> Column:
    """The different words of a query that aren't stop words, sorted."""
    return F.array_sort(F.array_except(words(query, "[a-z]{2,}"), F.array(*map(F.lit, QUERY_STOPWORDS))))


def sentences(text: Column) -> Column:
    """A text cut after sentence ends."""
    return F.filter(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column) -> Column:
    """Lower case with every run of other characters as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_label(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The label of the first rule that holds: an ordered rule table."""
    c = F.lit(default)
    for label, holds in reversed(rules):
        c = F.when(holds, F.lit(label)).otherwise(c)
    return c


def labels(rules: list[tuple[str, Column]]) -> Column:
    """The labels of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(holds, F.lit(label)) for label, holds in rules]), lambda x: x.isNotNull())


def any_of(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether a text holds any of the terms."""
    c = F.lit(False)
    for t in terms:
        c = c | text.contains(t)
    return c


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
