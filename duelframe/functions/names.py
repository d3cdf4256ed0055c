"""Names in texts: an alias catalogue, one automaton over all aliases, and what it finds and replaces.

The automaton is compiled once for each task. It reads a text once, whatever the number of aliases, and reports every alias that ends at a
position; of those that stand at word boundaries the leftmost are taken, of equal starts the longest, without overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import text as tx

# How the aliases of a base name become those of its forms.
EVOLVED = ("{}进化", "进化{}", "觉醒{}", "{}觉醒", "evo {}", "evolved {}")
HERO = ("英雄{}", "{}英雄", "hero {}")
_PLAIN = re.compile(r"[a-z0-9 .'-]+\Z")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class SharedAlias(ValueError):
    """Aliases that stand for more than one name."""


def catalogue(given: DataFrame) -> DataFrame:
    """(alias, name, at): all aliases of the names in ``given`` (name, alias, at), normalised, each once at its first place.

    Every name is its own alias; a name that ends in Evolution, or begins with Hero, has the aliases of its base in the forms of ``EVOLVED`` and ``HERO``. An alias with blanks also
    stands without them. Null and blank aliases are left out.
    """
    own = given.groupBy("name").agg(F.max("at").alias("_last")).select("name", F.lower("name").alias("alias"), (F.col("_last") + 0.25).alias("at"))
    base = given.where("alias IS NOT NULL").select("name", "alias", F.col("at").cast("double").alias("at")).unionByName(own)

    def forms(named: Column, stem: Column, templates: tuple[str, ...]) -> DataFrame:
        made = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t.split("{}")[0]).alias("before"), F.lit(t.split("{}")[1]).alias("after")) for i, t in enumerate(templates)]))
        targets = given.select("name").distinct().where(named).select("name", stem.alias("_stem"))
        rows = base.withColumnRenamed("name", "_stem").join(targets, "_stem").select("name", "alias", "at", made.alias("t"))
        return rows.select("name", F.concat("t.before", "alias", "t.after").alias("alias"), (F.col("at") + 1000 + F.col("t.i") / 100).alias("at"))

    name = F.col("name")
    words = F.array(F.concat(F.lower(F.regexp_replace("name", " Evolution$", "")), F.lit(" evolution")))
    english = given.select("name").distinct().where(name.endswith(" Evolution")).select("name", F.explode(words).alias("alias"), F.lit(2000.0).alias("at"))
    every = base.unionByName(forms(name.endswith(" Evolution"), F.regexp_replace("name", " Evolution$", ""), EVOLVED)).unionByName(forms(name.startswith("Hero "), F.regexp_replace("name", "^Hero ", ""), HERO)).unionByName(english)
    normal = every.select("name", tx.normal_alias(F.col("alias")).alias("alias"), "at")
    both = normal.unionByName(normal.select("name", F.regexp_replace("alias", " ", "").alias("alias"), (F.col("at") + 0.125).alias("at"))).where("alias <> ''")
    return both.groupBy("alias", "name").agg(F.min("at").alias("at"))


def shared_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, names) of aliases with several names."""
    return aliases.groupBy("alias").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


def unshared(aliases: DataFrame, keep_first: bool = False) -> dict[str, str]:
    """alias -> name of a catalogue, which is configuration and small enough for every task; shared aliases raise, or stay with the name that has them first."""
    if not keep_first and (bad := shared_aliases(aliases).limit(5).collect()):
        raise SharedAlias("; ".join(f"{r.alias}: {', '.join(r.names)}" for r in bad))
    first = Window.partitionBy("alias").orderBy("at", "name")
    rows = aliases.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("alias", "name")
    return {r.alias: r.name for r in rows.collect()}


class Automaton:
    """All aliases in one Aho-Corasick automaton; an alias of plain letters, digits and blanks stands only between others than these."""

    def __init__(self, names: dict[str, str], everywhere: bool = False):
        self.tree = ahocorasick.Automaton()
        for alias, name in names.items():
            self.tree.add_word(alias, (len(alias), name, everywhere or bool(_PLAIN.match(alias))))
        self.size = len(names)
        if names:
            self.tree.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of all aliases in a text, by start, longest first, then by name."""
        if not self.size:
            return []
        out = []
        for last, (size, name, bounded) in self.tree.iter(text):
            start, end = last + 1 - size, last + 1
            if not bounded or ((not start or text[start - 1] not in _WORD) and (end == len(text) or text[end] not in _WORD)):
                out.append((start, end, name))
        return sorted(out, key=lambda m: (m[0], -m[1], m[2]))

    def chosen(self, text: str, once: bool) -> list[tuple[int, int, str]]:
        """Matches without overlap; ``once`` leaves out further ones of a name that was taken."""
        out, reach, seen = [], 0, set()
        for start, end, name in self.matches(text):
            if start >= reach and not (once and name in seen):
                out.append((start, end, name))
                reach = end
                seen.add(name)
        return out

    def resolve(self, text: str | None) -> list[str]:
        normal = re.sub(r"\s+", " ", re.sub(r"[._-]+", " ", (text or "").lower())).strip()
        return [name for *_, name in self.chosen(normal, once=True)]

    def replace(self, text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        low = text.lower()
        # a letter whose lower case is longer would move what follows
        low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for start, end, name in self.chosen(low, once=False):
            out += [text[at:start], name]
            at = end
        return "".join([*out, text[at:]])


def resolve_names(names: dict[str, str]):
    """Pandas UDF: distinct names whose aliases occur in a text, in its order; null has none."""

    @F.pandas_udf("array<string>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(names)
        for series in batches:
            yield series.map(automaton.resolve)

    return udf


def replace_names(displayed: dict[str, str]):
    """Pandas UDF: a text with every name, whatever its case, replaced by what is displayed for it; null stays null."""

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton({k.lower(): v for k, v in displayed.items()}, everywhere=True)
        for series in batches:
            yield series.map(automaton.replace)

    return udf


def plain_answer(text: Column, labels: dict[str, str]) -> Column:
    """A text without markup: heading marks and emphasis go, list stars become dashes, section lines that ``labels`` knows (lower case, without colon) get its label."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")

    def line(x: Column) -> Column:
        bare = F.trim(F.regexp_replace(x, r"^\s*#{1,6}\s*", ""))
        label = F.try_element_at(known, F.lower(F.trim(F.regexp_replace(bare, "[:：]+$", ""))))
        return F.coalesce(label, F.when(bare != F.trim(x), bare).otherwise(x))

    lines = F.array_join(F.transform(F.split(text, r"\r\n|[\n\r]"), line), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"(?m)^\s*\*\s+", "- "), r"\*|__", ""))
