"""Wording of generated documents: repeated phrases, numbers and dates in words, required fields, kinship."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits in words, what separates a phrase from its repetition and how long one is, replacements after that in their
# order, fields that a complaint needs, and what stands for a value that is not known.
DIGITS = "〇一二三四五六七八九"
SEPARATORS, SHORTEST, LONGEST = "。；，", 2, 8
TIDIED = ((r"术后。*术后", "术后"), (r"。{2,}", "。"), (r"。，", "，"), (r"，。", "，"), (r"，\s*，", "，"))
REQUIRED = ("case_type", "plaintiffs", "defendants", "adm_info", "medical_process", "result", "court")
UNKNOWN = ("[待补充]", "[未知]", "null", "None", "undefined")
PLACEHOLDER = "________"
OF_PATIENT = "患者本人"


def without_repeats(text: Column) -> Column:
    """text without a phrase of two to eight characters that is repeated after a separator, and without doubled signs.

    A phrase is bounded, so the back-reference looks at a bounded number of characters at each place.
    """
    out = F.regexp_replace(text, rf"([^\n]{{{SHORTEST},{LONGEST}}}?)[{SEPARATORS}]\1", "$1")
    for pattern, instead in TIDIED:
        out = F.regexp_replace(out, pattern, instead)
    return out


def number_in_words(n: Column) -> Column:
    """A whole number below 40 in words, others in digits."""
    below = [*DIGITS]
    words = [*below, "十", *[f"十{d}" for d in below[1:]], "二十", *[f"二十{d}" for d in below[1:]], "三十", *[f"三十{d}" for d in below[1:]]]
    return F.coalesce(F.get(F.array(*map(F.lit, words)), F.when(n >= 0, n).cast("int")), n.cast("string"))


def date_in_words(date: Column) -> Column:
    """A date (2023年4月5日 at the start of a text) in words; a text without one, or with an X in it, as it is."""
    pattern = r"^(\d{4})年(\d{1,2})月(\d{1,2})日"
    part = lambda g: F.regexp_extract(date, pattern, g)
    year = F.translate(part(1), "0123456789", DIGITS)
    number = lambda g: number_in_words(part(g).try_cast("int"))
    return F.when(date.rlike(pattern) & ~date.contains("X"), F.concat(year, F.lit("年"), number(2), F.lit("月"), number(3), F.lit("日"))).otherwise(date)


def first_missing(data: Column, required: Sequence[str] = REQUIRED) -> Column:
    """The first required field that a JSON object has no key for; null if all are there. What is no object lacks the first."""
    keys = F.coalesce(F.json_object_keys(data), F.array().cast("array<string>"))
    return F.get(F.filter(F.array(*map(F.lit, required)), lambda k: ~F.array_contains(keys, k)), F.lit(0))


def known(value: Column, otherwise: str = PLACEHOLDER) -> Column:
    """A value without white space around it, or what stands for one that is not known."""
    v = F.trim(value)
    return F.when(value.isNull() | (value == "") | v.isin(*UNKNOWN), otherwise).otherwise(v)


def kinship(relationship: Column, died: Column, patient: Column) -> Column:
    """How a plaintiff is related to the patient, as a complaint says it; empty for the patient."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(relationship, F.lit("")), "^系", ""), "^患者", "")
    said = F.when(F.coalesce(relationship, F.lit("")) == OF_PATIENT, "").otherwise(bare)
    return F.when(said == "", "").when(died, F.concat(F.lit("系死者"), F.coalesce(patient, F.lit("")), F.lit("之"), said)).otherwise(F.concat(F.lit("系患者"), said))
