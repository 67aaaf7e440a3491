"""Column functions that read what curators and column headers write: ordered rules, the first that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that sources use.
CELLULAR, SURROGATE, LIVE, PLAQUE = r"\bcells?\b|vero|huh|cytopath", r"replicon|reporter|luciferase|pseudo", r"antiviral|infected|viral (?:load|titer|yield)", r"plaque"
BIOCHEMICAL = r"recombinant|enzym|fret|purified|binding"
REPLICATES = r"^\d+\s*(?:of|/)\s*\d+"
DEPENDENCY, RESTRICTION, BOTH = "decreased resistance to virus", "increased resistance to virus", "increased or decreased resistance to virus"
RESISTANCE = "resistance to virus"
METHODS = (("activation", "activation"), ("interference", "interference"), ("overexpression", "activation"), ("knockout", "knockout"), ("knockdown", "knockdown"))


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern found in the text, else null."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def first_contained(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The label of the first entry of which a spelling occurs in the lower-case text (a cell line, a method), else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for label, spellings in reversed(rules):
        hit = F.lit(False)
        for s in spellings:
            hit = hit | low.contains(s)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def assay_readout(description: Column, code: Column) -> Column:
    """struct(place, kind): cells, protein or unclear, and the assay's kind; with nothing said either way the type code decides."""
    d = F.lower(F.coalesce(description, F.lit("")))
    bio, surrogate = d.rlike(BIOCHEMICAL), d.rlike(SURROGATE)
    cell = surrogate | d.rlike(LIVE) | d.rlike(CELLULAR)
    place = F.when(cell & bio, "unclear").when(cell, "cells").otherwise("protein")
    kind = (
        F.when(cell & bio, "other").when(cell & d.rlike(PLAQUE), "plaque_reduction").when(cell & surrogate, "reporter").when(cell, "cell_based_antiviral")
        .when(bio, "biochemical").when(F.upper(F.coalesce(code, F.lit("B"))) == "B", "binding").otherwise("biochemical")
    )
    return F.struct(place.alias("place"), kind.alias("kind"))


def curator_note(comment: Column) -> Column:
    """struct(verdict, outside): the verdict a curator states, null unless stated, and whether the value lies outside the dose series."""
    s = F.lower(F.trim(F.coalesce(comment, F.lit(""))))
    verdict = F.when(s.rlike(REPLICATES), F.lit(None)).when(s.startswith("active"), "active").when((s == "inactive") | s.startswith("not active") | s.contains("failed to show") | s.contains("no activity"), "inactive")
    return F.struct(verdict.cast("string").alias("verdict"), s.contains("falls outside the dose series").alias("outside"))


def polarity_mode(rationale: Column, score_type: Column, signed: list[str]) -> Column:
    """struct(mode, direction): one direction for a whole screen, by the sign of each gene's score, or unresolvable."""
    x = F.lower(F.trim(F.coalesce(rationale, F.lit(""))))
    mode = F.when(x.isin(DEPENDENCY, RESTRICTION), "screen_level").when((x == BOTH) & F.trim(F.coalesce(score_type, F.lit(""))).isin(*signed), "signed").otherwise("unresolvable")
    return F.struct(mode.alias("mode"), F.when(x == DEPENDENCY, "dependency").when(x == RESTRICTION, "restriction").alias("direction"))


def eligible_screen(rationale: Column) -> Column:
    return F.lower(F.trim(F.coalesce(rationale, F.lit("")))).contains(RESISTANCE)


def screen_type(methodology: Column) -> Column:
    return F.coalesce(first_contained(methodology, [(label, [key]) for key, label in METHODS]), F.lit("other"))


def direction_of_action(kind: Column, action: Column, kinds: dict[str, str], actions: dict[str, str]) -> Column:
    """The direction that the type states; an action of another direction makes it unknown, but for modulators."""
    look = lambda col, table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(F.trim(F.coalesce(col, F.lit("")))))
    t, a = look(kind, kinds), look(action, actions)
    return F.when(t.isNull(), "unknown").when(t == "modulator", "modulator").when(a.isNotNull() & (a != t), "unknown").otherwise(t)


def unit_of_name(name: str, default: str = "uM") -> str:
    """The unit that a column's own name states."""
    plain = "".join(c for c in name.lower() if c.isalnum())
    if plain.startswith(("lac50", "logac50")):
        return "logM"
    return next((unit for end, unit in (("nm", "nM"), ("um", "uM"), ("m", "M")) if plain.endswith(end)), default)


_TO_NM = {"nM": 1.0, "uM": 1e3, "M": 1e9}


def top_concentration(columns: list[str], units: str | None = None, low: float = 1.0, high: float = 1e7) -> Column:
    """The highest positive concentration of a row in nM; a column without a unit needs ``units``, and a top outside the plausible range raises."""
    each = []
    for c in columns:
        unit = unit_of_name(c, "") or units
        if unit not in _TO_NM:
            raise ValueError(f"concentration column {c!r} states no unit and none was given")
        x = F.col(f"`{c}`").cast("double")
        each.append(F.when(x > 0, x * _TO_NM[unit]))
    top = F.greatest(*each) if len(each) > 1 else each[0]
    return F.when(top.between(low, high) | top.isNull(), top).otherwise(F.raise_error(F.concat(F.lit("implausible top concentration in nM: "), top.cast("string"))).cast("double"))


def substance_of(sample: Column) -> Column:
    """A sample's substance: the lot suffix dropped."""
    return F.regexp_replace(F.trim(sample), r"-\d{2}$", "")


def year_in_parentheses(author: Column) -> Column:
    """The year of "Name (2019)" as a date text, else the placeholder."""
    y = F.regexp_extract(F.coalesce(author, F.lit("")), r"\((\d{4})\)", 1)
    return F.when(y != "", F.concat(y, F.lit("-01-01"))).otherwise("1970-01-01")


def motif_positions(sequence: Column, motif: str, width: int) -> Column:
    """The 1-based places at which a motif of fixed width begins, overlapping ones too."""
    places = F.sequence(F.lit(1), F.greatest(F.length(sequence) - width + 1, F.lit(1)))
    return F.filter(places, lambda i: F.substring(sequence, i, F.lit(width)).rlike(f"^(?:{motif})$"))


def pick_domain(names: Column, wanted: Column) -> Column:
    """struct(index, reason): the only name that equals the wanted one but for case; else why there is none."""
    low = F.transform(names, F.lower)
    hits = F.size(F.filter(low, lambda x: x == F.lower(wanted)))
    return F.struct(F.when(hits == 1, F.array_position(low, F.lower(wanted))).cast("int").alias("index"), F.when(hits == 0, "no such domain").when(hits > 1, "ambiguous").alias("reason"))


def catalytic_type(nucleophile: Column, residues: Column) -> Column:
    """The stated nucleophile's type; else cysteine or serine where just one of them occurs with histidine; none of it is "none", unknown stays null."""
    c, s, h = (F.array_contains(residues, x) for x in ("C", "S", "H"))
    return F.when(nucleophile.isNotNull(), nucleophile).when(residues.isNull(), F.lit(None)).when(h & c & ~s, "C").when(h & s & ~c, "S").when(F.size(residues) == 0, "none").otherwise("unknown")
