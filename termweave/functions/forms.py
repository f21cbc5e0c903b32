"""Release and dosage form of a text, and how two texts agree in them.

Reading a text is one Arrow function over its distinct values, not a chain of expressions, which the optimiser would copy
into every later use. All comparisons of two texts are expressions on what was read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DOSAGE_FORMS, FORM_WORDS, RELEASES, STOP_WORDS
from .text import BRACKETED, unbracketed, unpunctuated

#: Abbreviations by which a release is told when no name is found, in order of precedence.
PRECEDENCE = ("gastro_resistant", "delayed_release", "extended_release", "immediate_release")


def _clean(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[()\[\]{},;:/\\]+", " ", name.strip().lower()))


_ABBREVIATED = {r: re.compile(r"\b(?:" + "|".join(short) + r")\b", re.IGNORECASE) for r, (short, _, _, _) in RELEASES.items()}
_RELEASE_NAMES = [(_clean(alias), r) for r, (_, names, _, _) in RELEASES.items() for alias in names]
#: Names of forms, long ones first, with their words if they have several.
_FORM_NAMES = sorted({_clean(alias): form for form, (_, _, names, _) in DOSAGE_FORMS.items() for alias in names}.items(), key=lambda x: -len(x[0]))
_FORM_PARTS = [(alias, frozenset(alias.split(" ")) if " " in alias else None, form) for alias, form in _FORM_NAMES]


def release_of(text: str) -> str | None:
    """The canonical release: enteric abbreviations, then names in order, then abbreviations by precedence."""
    if _ABBREVIATED["gastro_resistant"].search(text):
        return "gastro_resistant"
    clean = _clean(text)
    named = next((r for alias, r in _RELEASE_NAMES if alias in clean), None)
    return named or next((r for r in PRECEDENCE if _ABBREVIATED[r].search(text)), None)


def form_of(text: str) -> str | None:
    """The canonical dosage form: the longest name that the text contains, or whose words it has."""
    clean = _clean(text)
    words = set(clean.split(" "))
    return next((form for alias, parts, form in _FORM_PARTS if alias in clean or (parts and parts <= words)), None)


def read(text: str | None, ignore_bracketed: bool = False) -> tuple[str | None, str | None]:
    """Release and dosage form."""
    raw = re.sub(BRACKETED, " ", text or "") if ignore_bracketed else text or ""
    return release_of(raw), form_of(raw)


def told(text: Column, ignore_bracketed: bool = False) -> Column:
    """struct<release: string, form: string> of a text; either is null if the text tells none."""

    @F.arrow_udf("struct<release: string, form: string>")
    def both(texts: pa.Array) -> pa.Array:
        rows = [read(t, ignore_bracketed) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["release", "form"])

    return both(text)


def release(text: Column, ignore_bracketed: bool = False) -> Column:
    return told(text, ignore_bracketed)["release"]


def dosage_form(text: Column, ignore_bracketed: bool = False) -> Column:
    return told(text, ignore_bracketed)["form"]


def _looked_up(key: Column, table: dict[str, str | None]) -> Column:
    some = {k: v for k, v in table.items() if v is not None}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in some.items() for x in kv]), key)


def release_abbreviation(canonical: Column) -> Column:
    return _looked_up(canonical, {k: v[2] for k, v in RELEASES.items()})


def release_label(canonical: Column) -> Column:
    return _looked_up(canonical, {k: v[3] for k, v in RELEASES.items()})


def form_label(canonical: Column) -> Column:
    return _looked_up(canonical, {k: v[3] for k, v in DOSAGE_FORMS.items()})


def form_route(canonical: Column) -> Column:
    return _looked_up(canonical, {k: v[0] for k, v in DOSAGE_FORMS.items()})


def us_style(text: Column, ignore_bracketed: bool = False) -> Column:
    """A struct of the text's form and release with their labels in the United States."""
    raw = F.coalesce(text, F.lit(""))
    raw = unbracketed(raw) if ignore_bracketed else raw
    both, clean = told(raw), unpunctuated(raw)
    r, f = both["release"], both["form"]
    enteric = F.coalesce(r == "gastro_resistant", F.lit(False)) | F.contains(clean, F.lit("enteric")) | F.contains(clean, F.lit("gastro resistant"))
    return F.struct(
        raw.alias("input"), f.alias("canonical_dosage_form"), r.alias("canonical_release"), release_abbreviation(r).alias("us_release_abbr"),
        F.nullif(F.concat_ws(" ", release_label(r), form_label(f)), F.lit("")).alias("us_combined_label"),
        enteric.alias("enteric_or_gastro_resistant"),
        F.coalesce(r.isin("delayed_release", "gastro_resistant", "extended_release"), F.lit(False)).alias("modified_release"),
    )


def release_score(query_release: Column, candidate_release: Column) -> Column:
    same = release_abbreviation(query_release) == release_abbreviation(candidate_release)
    q, c = query_release.isNotNull(), candidate_release.isNotNull()
    return F.when(~q & ~c, 0.0).when(~q, -0.2).when(~c, -0.4).when(same, 0.4).otherwise(-0.4)


def release_form_score(query_release: Column, candidate_release: Column, query_form: Column, candidate_form: Column) -> Column:
    return F.when((query_release != candidate_release) | (query_form != candidate_form), -1.0).otherwise(0.0)


def form_route_score(query_form: Column, candidate_form: Column) -> Column:
    loose = F.lit("powder_unspecified")
    return (
        F.when(F.coalesce(query_form == loose, F.lit(False)) | F.coalesce(candidate_form == loose, F.lit(False)), 0.5)
        .when(query_form.isNull() & candidate_form.isNotNull(), -0.5)
        .when(query_form.isNull() | candidate_form.isNull(), 0.0)
        .when(query_form == candidate_form, 1.0)
        .when(form_route(query_form) == form_route(candidate_form), 0.5)
        .otherwise(-1.0)
    )


def simple_words(text: str) -> list[str]:
    """Words of an ASCII text for similarity: without bracketed parts, stop words and numbers, forms canonical."""
    text = re.sub(r"\[[^\]]+\]", " ", text)
    return [FORM_WORDS.get(w, w) for w in re.split(r"[^a-z0-9]+", text) if w and w not in STOP_WORDS and not w.isdigit()]


_RELEASE_WORDS = {r: [short.lower(), *simple_words(label.lower())] for r, (_, _, short, label) in RELEASES.items()}
_FORM_LABEL_WORDS = {f: simple_words(label.lower()) for f, (_, _, _, label) in DOSAGE_FORMS.items()}


def label_words(text: str, ignore_bracketed: bool = False) -> list[str]:
    """The words by which a text's release and form stand in its word list: abbreviation, then the words of the labels."""
    r, f = read(text, ignore_bracketed)
    return [*_RELEASE_WORDS.get(r, ()), *_FORM_LABEL_WORDS.get(f, ())]
