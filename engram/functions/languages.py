"""What the compilers look for in a language. A language is data: lists that its operators take as parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.lexicons import VERB_SETS


@dataclass(frozen=True)
class Language:
    """Lists of a language; empty ones find nothing. patterns are (key, mark, mode, other) as people.profiles takes them."""

    name: str
    titles: Sequence[str] = ()
    markers: Sequence[str] = ()
    stop_names: Sequence[str] = ()
    boilerplate: Sequence[str] = ()
    patterns: Sequence[tuple[str, str, str, str | None]] = ()
    verbs: dict[str, Sequence[str]] = field(default_factory=dict)

    def of(self, kind: str) -> Sequence[str]:
        """Verbs of a set: strong, action, hostile or friendly."""
        return self.verbs.get(kind, ())


def with_lexicon(language: Language, lexicon: DataFrame, sets: Sequence[str] = tuple(VERB_SETS), most: int = 10_000) -> Language:
    """The language with the verbs and titles of a lexicon (operators.lexicon.registry) added to its own, lower case, sorted.

    They become parameters of expressions, so there may be `most` of them at most: ValueError. Larger lexicons are for
    operators.lexicon, which takes them as tables.
    """
    own = lexicon.where(F.col("language") == language.name)
    forms = F.explode(F.transform(F.concat(F.array("lemma"), F.coalesce("forms", F.array().cast("array<string>"))), lambda f: F.lower(f)))
    rows = own.select(forms.alias("form"), (F.col("class") == "title").alias("title"), *sets).where("form <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} forms of {language.name}")
    verbs = {k: sorted({*language.of(k), *(r["form"] for r in rows if r[k])}) for k in sets}
    raw = own.where("class = 'title'").select(F.explode(F.concat(F.array("lemma"), F.coalesce("forms", F.array().cast("array<string>")))).alias("form")).distinct().limit(most + 1).collect()
    return replace(language, verbs=verbs, titles=sorted({*language.titles, *(r["form"] for r in raw if r["form"])}))


#: Languages by name; callers put their own in.
LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> Language:
    LANGUAGES[language.name] = language
    return language
