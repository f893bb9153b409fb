"""Rules fixed in advance that turn intervals and counts into one verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators.screen import first_reason


def verdict(low: Column, high: Column, enough_signs: Column) -> Column:
    """support above zero with enough signs, exclude below zero, else unresolved."""
    return F.when((low > 0) & enough_signs, "support").when(high < 0, "exclude").otherwise("unresolved")


def equivalent(low: Column, high: Column, band: float) -> Column:
    """Whether an interval lies inside -band..band."""
    return (low > -band) & (high < band)


def all_pass(gates: dict[str, Column]) -> list[Column]:
    """Named gates as columns, and whether all of them hold; an undefined gate does not."""
    named = [F.coalesce(c, F.lit(False)).alias(n) for n, c in gates.items()]
    whole = F.lit(True)
    for c in gates.values():
        whole = whole & F.coalesce(c, F.lit(False))
    return [*named, whole.alias("all_pass")]


def least(value: str, name: str, allowed: Column | None = None) -> Column:
    """Aggregate: the name with the least value, the first by name of equal ones; only of rows that are allowed, where that is
    given, and null where none is."""
    row = F.struct(value, name)
    return F.min(row if allowed is None else F.when(allowed, row))[name]


def greedy(costs: list[tuple[str, float]], budget: float) -> list[str]:
    """Names taken in order while the budget lasts; one that does not fit is passed over. On the driver: few, and in order."""
    out = []
    for name, cost in costs:
        if cost <= budget:
            out.append(name)
            budget -= cost
    return out


def ladder(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The outcome of the first rule that holds; one that is undefined does not hold."""
    return first_reason(rules, otherwise)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def branches(rules: list[tuple[str, Column]], otherwise: str, arms: dict[str, list[str]], added: list[tuple[Column, str]], stops: set[str]) -> Column:
    """(branch, arms, reasons, stop): the first rule that holds names the branch, the branch its arms; where it doesn't stop
    everything, arms are added whose condition holds. All rules that hold are the reasons."""
    branch = ladder(rules, otherwise)
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    stop = branch.isin(*stops) if stops else F.lit(False)
    asked = reduce(lambda below, b: F.when(branch == b, names(arms[b])).otherwise(below), arms, names([]))
    for condition, arm in added:
        asked = F.when(~stop & F.coalesce(condition, F.lit(False)), F.array_union(asked, names([arm]))).otherwise(asked)
    return F.struct(branch.alias("branch"), asked.alias("arms"), reasons(rules).alias("reasons"), stop.alias("stop"))


def holds_for(arms: Column, condition, *names: str) -> Column:
    """Whether a condition holds for one of the named arms of an array, or of all arms without names; an absent arm is none."""
    return F.exists(arms, lambda a: (a["arm"].isin(*names) if names else F.lit(True)) & F.coalesce(condition(a), F.lit(False)))


def ranked(arms: Column, condition, by: str) -> Column:
    """The names of the arms for which a condition holds, that with the greatest value first, equal ones by name."""
    held = F.filter(arms, lambda a: F.coalesce(condition(a), F.lit(False)))
    return F.transform(F.sort_array(F.transform(held, lambda a: F.struct((-a[by]).alias("k"), a["arm"].alias("arm")))), lambda x: x["arm"])


def hypotheses(arm: Column, rules: dict[str, tuple[list[str], Column]]) -> list[Column]:
    """A flag for each hypothesis, null for arms that it says nothing about."""
    return [F.when(arm.isin(*names), F.coalesce(c, F.lit(False))).alias(h) for h, (names, c) in rules.items()]


def dose(effect: Column, low: Column, high: Column, least: float, corroborated: Column, affordable: Column, floor: Column) -> Column:
    """Increase where a material effect holds elsewhere, is affordable and above the floor; keep where it is worse or open."""
    material = (effect >= least) & (low > 0)
    return F.when(material & corroborated & affordable & floor, "increase").when(high < 0, "keep_worse").otherwise("keep_inconclusive")


def robustness(variants: Column, original: str, gain_low: float, share: float, at_least: int) -> Column:
    """One of four verdicts from an array of variants (variant, sane, mean, low): all sane variants but the original must gain,
    by a share of the original's gain; variants that are not sane do not count."""
    of = F.get(F.filter(variants, lambda v: v["variant"] == original), F.lit(0))
    sane = F.filter(variants, lambda v: (v["variant"] != original) & v["sane"])
    hold = F.forall(sane, lambda v: (v["low"] > gain_low) & (v["mean"] >= share * of["mean"]))
    open_ = (of["low"] <= gain_low) | (F.size(sane) < at_least)
    return F.when(~F.coalesce(of["sane"], F.lit(False)), "harness_invalid").when(open_, "inconclusive").when(hold, "robust").otherwise("not_robust")


def gap_closed(arm: Column, low: Column, high: Column, tolerance: float) -> Column:
    """The share of the gap between two references that an arm closes, null where there is none above the tolerance."""
    return F.when(F.abs(high - low) > tolerance, (arm - low) / (high - low))
