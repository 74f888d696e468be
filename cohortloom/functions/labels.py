"""Codes to labels, bands, collapsed levels and level ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom import vocab
from cohortloom.functions.predicates import matches
from cohortloom.functions.text import paste


def first_match(rules: Iterable[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    """Value of the first rule whose test is true (NULL counts as false)."""
    pairs = [(test, v if isinstance(v, Column) else F.lit(v)) for test, v in rules]
    chain = F.when(*pairs[0])
    for test, value in pairs[1:]:
        chain = chain.when(test, value)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return chain.otherwise(fallback)


def race_label(race: Column, ethnicity: Column) -> Column:
    """Group label; the ethnicity code is tested before the race code."""
    rules = [(ethnicity == vocab.HISPANIC_CODE, vocab.HISPANIC)]
    rules += [(race == code, label) for code, label in vocab.RACE_LABELS.items()]
    return first_match(rules, vocab.UNKNOWN_RACE)


def band(value: Column, bands: Sequence[tuple[int, int | None, str]] = tuple(vocab.AGE_BANDS)) -> Column:
    """Label of the closed range the value falls in, NULL outside all of them."""
    return first_match(
        ((value >= low) if high is None else value.between(low, high), label)
        for low, high, label in bands)


def keep_or_other(value: Column, kept: Sequence[str] = tuple(vocab.SEX_KEPT), other: str = "Other") -> Column:
    """The value when listed, otherwise ``other`` (also for NULL)."""
    return F.when(value.isin(list(kept)), value).otherwise(F.lit(other))


def collapse(value: Column, mapping: Mapping[str, Sequence[str]]) -> Column:
    """New level for each list of old levels; an unlisted value becomes NULL."""
    return first_match((value.isin(list(old)), new) for new, old in mapping.items())


def category_by_id(question_id: Column, answer: Column,
                   prefixes: Mapping[int, str] = vocab.PREFIX_BY_ID) -> Column:
    """``<prefix> <answer>`` chosen by question id; ``Other`` for any other question."""
    return first_match(
        ((question_id == code, paste(prefix, answer)) for code, prefix in prefixes.items()), "Other")


def category_by_wording(question: Column, answer: Column,
                        prefixes: Mapping[str, str] = vocab.PREFIX_BY_WORDING) -> Column:
    """``<prefix> <answer>`` chosen by question wording; prefix ``Other:`` when none fits."""
    return first_match(
        ((matches(question, text), paste(prefix, answer)) for text, prefix in prefixes.items()),
        paste("Other:", answer))


@dataclass(frozen=True)
class LevelsBy:
    """A level list for each value of another column, for tables of several questions."""

    column: str
    lists: Mapping[int | str, Sequence[str]]

    def each(self, make: Callable[[Sequence[str]], Column]) -> Column:
        """``make`` of the list that belongs to the row; NULL where none does."""
        return first_match((F.col(self.column) == key, make(levels)) for key, levels in self.lists.items())


Levels = Sequence[str] | LevelsBy


def level_rank(value: Column, levels: Levels) -> Column:
    """Position in the level list starting at 1; NULL when missing or unlisted."""
    if isinstance(levels, LevelsBy):
        return levels.each(lambda own: level_rank(value, own))
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), value).cast("int")
    return F.when(value.isin(list(levels)), position)


def as_level(value: Column, levels: Levels) -> Column:
    """The value when it is one of the levels, else NULL."""
    if isinstance(levels, LevelsBy):
        return levels.each(lambda own: as_level(value, own))
    return F.when(value.isin(list(levels)), value)


def level_count(levels: Levels) -> Column:
    """How many levels the list has."""
    if isinstance(levels, LevelsBy):
        return F.coalesce(levels.each(lambda own: F.lit(len(own))), F.lit(0))
    return F.lit(len(levels))


def drinking_outcome(lifetime: Column, frequency: Column) -> Column:
    """Regression outcome: abstainers of either kind, else the frequency answer, else NULL."""
    return first_match([
        (lifetime == vocab.LIFETIME_NO, vocab.NONDRINKER),
        (frequency == vocab.PAST_YEAR_NEVER, vocab.NONDRINKER),
    ], frequency)
