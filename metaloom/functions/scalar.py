"""Column functions: units, potencies, verdicts, identifiers, dates and text rules. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanomoles per unit.
NM_PER_UNIT = {"pM": 1e-3, "nM": 1.0, "uM": 1e3, "mM": 1e6, "M": 1e9}
ACTIVE_NM = 10_000.0
#: A verdict reads the first of these fields that is present; the pX transform has an order of its own.
POTENCY_ORDER = ("ec50_nm", "ic50_nm", "ki_nm", "kd_nm")


def to_nm(value: Column, unit: Column) -> Column:
    """A concentration in nM; an unknown unit gives null. "logM" is a power of ten in M."""
    out = F.when(unit == "logM", F.pow(F.lit(10.0), value) * 1e9)
    for u, k in NM_PER_UNIT.items():
        out = out.when(unit == u, value * k)
    return out


def first_present(fields: list[Column]) -> Column:
    return F.coalesce(*fields)


def relation_verdict(value: Column, relation: Column, cut: float = ACTIVE_NM) -> Column:
    """True active, false inactive, null undecided. No relation reads as "="; bounds are inclusive."""
    rel = F.coalesce(relation, F.lit("="))
    return (
        F.when(value.isNull(), F.lit(None).cast("boolean"))
        .when(rel.isin("=", "~"), value <= cut)
        .when(rel.isin(">", ">="), F.when(value >= cut, F.lit(False)))
        .when(rel.isin("<", "<="), F.when(value <= cut, F.lit(True)))
    )


def contested(fields: list[Column], relation: Column, cut: float = ACTIVE_NM) -> Column:
    """Whether the fields' own verdicts disagree."""
    return F.size(F.array_distinct(F.array_compact(F.array(*[relation_verdict(f, relation, cut) for f in fields])))) > 1


def imputed_decides(value: Column, relation: Column, imputed: Column, cut: float = ACTIVE_NM) -> Column:
    """Whether an imputed "=" decides: its verdict would differ if the relation were ">"."""
    as_is, other = relation_verdict(value, relation, cut), relation_verdict(value, F.lit(">"), cut)
    return F.coalesce(imputed, F.lit(False)) & ~as_is.eqNullSafe(other)


def classify(fields: list[Column], relation: Column, imputed: Column, cut: float = ACTIVE_NM) -> Column:
    """The verdict of a measurement: null where fields contest each other or an imputed relation decides."""
    value = first_present(fields)
    return F.when(contested(fields, relation, cut) | imputed_decides(value, relation, imputed, cut), F.lit(None).cast("boolean")).otherwise(relation_verdict(value, relation, cut))


def p_value_of(nm: Column, relation: Column | None = None) -> Column:
    """pX = 9 - log10(nM); censored or non-positive values give null."""
    ok = nm > 0
    if relation is not None:
        ok = ok & F.coalesce(relation, F.lit("=")).isin("=", "~")
    return F.when(ok, 9 - F.log10(nm))


def selectivity(cc50: Column, ec50: Column) -> Column:
    return F.when((cc50 > 0) & (ec50 > 0), cc50 / ec50)


def edge_year(date: Column) -> Column:
    """The year of an ISO date or bare year; empty, non-numeric and the 1970 placeholder give null."""
    y = F.when(date.rlike(r"^[0-9]{4}"), F.substring(date, 1, 4).try_cast("int"))
    return F.when(y != 1970, y)


def is_date_or_year(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9]{4}$") | (x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull()), F.lit(False))


def author_year(text: Column) -> Column:
    """A year in round brackets, 1980 to 2030."""
    y = F.regexp_extract(text, r"\(([0-9]{4})\)", 1).try_cast("int")
    return F.when(y.between(1980, 2030), y)


def source_slug(name: Column) -> Column:
    """A source's name as an infores identifier."""
    return F.concat(F.lit("infores:"), F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""))


def curie(x: Column) -> Column:
    """(prefix, local) of an identifier; both null where it is none."""
    pattern = r"^([A-Za-z][A-Za-z0-9_.]*):(\S+)$"
    ok = x.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(x, pattern, 1)).alias("prefix"), F.when(ok, F.regexp_extract(x, pattern, 2)).alias("local"))


def skeleton(key: Column) -> Column:
    """The grouping part of a structure key: its first 14 characters."""
    return F.substring(F.regexp_replace(key, r"^[A-Za-z]+:", ""), 1, 14)


def same_rule(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit("identical_key")).when(skeleton(a) == skeleton(b), F.lit("shared_skeleton"))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that a lower-cased text matches."""
    low, out = F.lower(text), None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), F.lit(label)) if out is None else out.when(low.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def all_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all patterns that a text matches, in rule order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(label)) for p, label in rules]))


def computed_only(sources: Column, computed: list[str]) -> Column:
    """Whether a "|"-separated source list is not empty and lies within the computed sources."""
    have = F.filter(F.split(F.coalesce(sources, F.lit("")), r"\|"), lambda x: x != "")
    return (F.size(have) > 0) & (F.size(F.array_except(have, F.array(*map(F.lit, computed)))) == 0)


def mentions(text: Column, name: str) -> Column:
    """Whether a name occurs that no letter or digit touches."""
    escaped = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in name.lower())
    return F.lower(text).rlike(f"(?<![a-z0-9]){escaped}(?![a-z0-9])")


def suggestions(word: Column, names: Column, most: int = 2) -> Column:
    """The names within an edit distance of a word, nearest first."""
    near = F.filter(names, lambda n: F.levenshtein(F.lower(n), F.lower(word)) <= most)
    return F.transform(F.array_sort(F.transform(near, lambda n: F.struct(F.levenshtein(F.lower(n), F.lower(word)).alias("d"), n.alias("n")))), lambda x: x["n"])


def phase_tier(phase: Column) -> Column:
    return F.when(phase >= 4, F.lit("approved")).when(phase >= 1, F.lit("clinical")).otherwise(F.lit("research"))


def edge_sentence(subject: Column, predicate: Column, obj: Column, edge_id: Column) -> Column:
    """An edge as a sentence that cites it."""
    return F.concat(F.concat_ws(" ", subject, F.lower(F.regexp_replace(predicate, "_", " ")), obj), F.lit(" ["), edge_id, F.lit("]."))
