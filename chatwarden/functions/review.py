"""Column functions behind the review queue."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chatwarden.functions import fixed_values as fixed


def priority_label(priority: Column) -> Column:
    """Shown label; NULL for an unknown priority."""
    known = F.create_map(*[F.lit(x) for pair in fixed.PRIORITY_LABELS.items() for x in pair])
    return F.try_element_at(known, priority)


def violations_text(violations: Column) -> Column:
    return F.array_join(violations, ", ")


def chat_line(author: Column, text: Column) -> Column:
    """First five characters of the author, then the message."""
    return F.concat(F.substring(author, 1, 5), F.lit(": "), text)


def is_highlighted(text: Column, terms: Column) -> Column:
    """Some listed term occurs in the text, case-sensitively."""
    return F.coalesce(F.exists(terms, lambda term: F.contains(text, term)), F.lit(False))


def cultural_note(region: Column) -> Column:
    """The region's note. The table has one entry, so it is part of the plan."""
    notes = F.create_map(*[F.lit(x) for pair in fixed.REGION_NOTES.items() for x in pair])
    return F.coalesce(F.try_element_at(notes, region), F.lit(fixed.NO_REGION_NOTE))


def assessment_or_pending(assessment: Column) -> Column:
    """``pending`` until an assessment has arrived."""
    return F.when(F.coalesce(assessment, F.lit("")) == "", "pending").otherwise(assessment)


def account_label(player: Column) -> Column:
    return F.concat(player, F.lit("'s Account"))


def confirmation(action: Column) -> Column:
    classified = F.concat(F.lit(fixed.CLASSIFY_PREFIX), action, F.lit("."))
    return F.when(action == fixed.IGNORE_ACTION, fixed.IGNORE_TEXT).otherwise(classified)


def review_date(text: Column) -> Column:
    """``4.04.2021`` or ``10.02.2023`` as a date; the text itself is kept too."""
    return F.to_date(text, "d.MM.yyyy")
