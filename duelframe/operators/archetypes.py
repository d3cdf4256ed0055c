"""Rule-based classification of baskets as one column expression per rule; no join, no UDF."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "other"


@dataclass(frozen=True)
class Rule:
    """Anchors of which one must be present, requirements, and weights that add up in the order given."""

    name: str
    family: str
    anchors: tuple[str, ...]
    required_all: tuple[str, ...] = ()
    required_any: tuple[str, ...] = ()
    supports: dict[str, float] = field(default_factory=dict)
    blockers: dict[str, float] = field(default_factory=dict)
    features: dict[str, float] = field(default_factory=dict)
    priority: int = 0
    least: float = 5.5


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    features: dict[str, tuple[str, ...]]
    strategic: tuple[str, ...]
    size: int = 8

    def score(self, deck: Column, rule: Rule) -> Column:
        """Score of a rule, null where it does not apply."""
        def hits(names: tuple[str, ...]) -> Column:
            return F.size(F.array_intersect(deck, F.array(*map(F.lit, names))))

        def has(name: str) -> Column:
            return F.array_contains(deck, name)

        total = F.lit(5.5) + 0.4 * (hits(rule.anchors) - 1)
        applies = hits(rule.anchors) > 0
        if rule.required_all:
            total, applies = total + 1.5, applies & (hits(rule.required_all) == len(rule.required_all))
        if rule.required_any:
            total, applies = total + 0.8, applies & (hits(rule.required_any) > 0)
        for name, weight in rule.supports.items():
            total = total + F.when(has(name), weight).otherwise(0.0)
        for name, weight in rule.blockers.items():
            total = total - F.when(has(name), weight).otherwise(0.0)
        for name, weight in rule.features.items():
            total = total + F.least(hits(self.features[name]), F.lit(4)) * weight
        return F.when(applies & (total >= rule.least), total)

    def classify(self, deck: Column) -> Column:
        """struct(name, family, confidence, score): the best rule by score, priority and order of the rules.

        A basket of the wrong size, with four strategic anchors, without a rule, or with three anchors and two families almost level is ``other``.
        """
        found = F.filter(
            F.array(*[
                F.struct(
                    self.score(deck, r).alias("score"), F.lit(r.priority).alias("priority"), F.lit(-i).alias("at"),
                    F.lit(r.name).alias("name"), F.lit(r.family).alias("family"), F.lit(r.least).alias("least"),
                )
                for i, r in enumerate(self.rules)
            ]),
            lambda x: x["score"].isNotNull(),
        )
        seen = F.size(F.array_intersect(deck, F.array(*map(F.lit, self.strategic))))
        whole = (F.size(deck) == self.size) & (F.size(F.array_distinct(deck)) == self.size)

        def best(state: Column) -> Column:
            ranked, seen, whole = state["ranked"], state["seen"], state["whole"]
            top, second = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
            margin = top["score"] - F.coalesce(second["score"], F.lit(0.0))
            level = second.isNotNull() & (seen >= 3) & (margin < 0.65) & (second["family"] != top["family"])
            sure = F.least(F.lit(0.99), 0.58 + F.greatest(F.lit(0.0), top["score"] - top["least"]) * 0.045 + F.least(F.lit(4.0), margin) * 0.055)
            good = whole & (seen < 4) & top.isNotNull() & ~F.coalesce(level, F.lit(False))
            return F.struct(
                F.when(good, top["name"]).otherwise(OTHER).alias("name"), F.when(good, top["family"]).otherwise(OTHER).alias("family"),
                F.when(good, F.round(sure, 3)).otherwise(0.0).alias("confidence"), F.when(good, F.round(top["score"], 3)).otherwise(0.0).alias("score"),
            )

        # the rules are scored once: the rest reads them as a lambda's variable instead of repeating their expressions
        state = F.struct(F.reverse(F.array_sort(found)).alias("ranked"), seen.alias("seen"), whole.alias("whole"))
        return F.transform(F.array(state), best)[0]

    def family_of(self, name: Column) -> Column:
        known = F.create_map(*[x for r in self.rules for x in (F.lit(r.name), F.lit(r.family))])
        return F.coalesce(F.try_element_at(known, name), F.lit(OTHER))
