"""Typed retrieval over a graph: names, routes, evidence, triage; guards that refuse; verification of answers.

Row work is DataFrame work with a limit and a stated order (top-k reports); rules over a question or an
answer are driver-side text rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import edge_sentence
from . import rank


@dataclass
class Result:
    ok: bool
    kind: str
    data: list = field(default_factory=list)
    verbalised: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    edge_ids: list[str] = field(default_factory=list)
    note: str = ""


def resolve(names: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """(id, name, match): the exact name if there is one, else names that contain the text, shortest first."""
    low = text.lower()
    hits = names.where(F.lower("name").contains(low)).withColumn("match", F.when(F.lower("name") == low, "exact").otherwise("part"))
    exact = hits.where("match = 'exact'")
    part = hits.where("match = 'part'").join(F.broadcast(exact.agg((F.count("*") == 0).alias("none"))), F.col("none"))
    return exact.unionByName(part.select(*exact.columns)).orderBy(F.length("name"), "name", "id").limit(limit)


def evidence(edges: DataFrame, subject: str, obj: str | None = None, predicate: str | None = None, limit: int = 25) -> DataFrame:
    x = edges.where(F.col("subject") == subject)
    x = x.where(F.col("object") == obj) if obj else x
    x = x.where(F.col("predicate") == predicate) if predicate else x
    return x.orderBy("predicate", "object", "qualifier", "year").limit(limit)


def sentences(edges: DataFrame, edge_id: Column) -> DataFrame:
    return edges.select(edge_id.alias("edge_id"), edge_sentence(F.col("subject"), F.col("predicate"), F.col("object"), edge_id).alias("sentence"))


def triage(compounds: DataFrame, direct: DataFrame, selectivity: DataFrame) -> DataFrame:
    """(id, direct, si, potency): compounds in order of no direct route last, unknown selectivity last, then high selectivity and low potency value."""
    d = direct.groupBy("id").agg(F.min("nm").alias("potency"), F.count("*").alias("n"))
    x = compounds.join(d, "id", "left").join(selectivity, "id", "left").select("id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("direct"), "si", "potency")
    return x.orderBy(F.desc("direct"), F.col("si").isNull(), F.desc_nulls_last("si"), F.asc_nulls_last("potency"), "id")


def shared_groups(members: DataFrame, targets: DataFrame, marked: DataFrame, universe: int, cap: int) -> DataFrame:
    """(group, size, targets, hits, expected, ratio, eligible): groups of up to ``cap`` members that hold a target, with their marked members against the base rate."""
    size = members.groupBy("group").agg(F.count_distinct("id").alias("size")).where(F.col("size") <= cap)
    t = members.join(targets.select("id").distinct(), "id", "left_semi").groupBy("group").agg(F.count_distinct("id").alias("targets"))
    m = members.join(marked.select("id").distinct(), "id", "left_semi").groupBy("group").agg(F.count_distinct("id").alias("hits"))
    base = marked.agg((F.count_distinct("id") / F.lit(universe)).alias("rate"))
    x = size.join(t, "group").join(m, "group", "left").join(F.broadcast(base)).select("group", "size", "targets", F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("size") * F.col("rate")).alias("expected"))
    return x.withColumn("ratio", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected"))).withColumn("eligible", F.col("expected") >= 1)


def virus_pathways(factors: DataFrame, members: DataFrame, universe: DataFrame, cap: int) -> DataFrame:
    """(group, size, hits, expected, ratio): groups of up to ``cap`` members that hold a factor, with what their size leads one to expect.

    Chosen by holding a factor, so there is no tail probability; the ratio of densities is a lead, not a finding.
    """
    deps = factors.select("id").distinct()
    inside = members.join(universe.select("id").distinct(), "id", "left_semi").select("group", "id").distinct()
    size = inside.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") <= cap)
    hits = inside.join(deps, "id", "left_semi").groupBy("group").agg(F.count("*").alias("hits"))
    base = universe.select("id").distinct().join(deps.withColumn("d", F.lit(1)), "id", "left").agg((F.count("d") / F.count("*")).alias("density"))  # one row
    x = size.join(hits, "group").join(F.broadcast(base)).select("group", "size", "hits", (F.col("size") * F.col("density")).alias("expected"))
    return x.withColumn("ratio", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")))


def best_potency(edges: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., potency, field): the least value of the first field, in order of preference, that any edge has; not the least of all."""
    least = edges.groupBy(*keys).agg(*[F.min(f).alias(f) for f in fields])
    name = F.coalesce(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields])
    return least.select(*keys, F.coalesce(*fields).cast("double").alias("potency"), name.alias("field")).where("field is not null")


def selectivity_notes(pairs: DataFrame, keys: list[str], cautioned: list[str]) -> DataFrame:
    """(keys..., si_min, si_max, n, spread, caution): selectivity as a range over studies; the caution names cell lines on the list."""
    own = pairs.groupBy(*keys).agg(F.min("si").alias("si_min"), F.max("si").alias("si_max"), F.count("si").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("cell").isin(*cautioned), F.col("cell")))), "|").alias("caution"))
    return own.where("n > 0").withColumn("spread", F.when(F.col("si_min") > 0, F.col("si_max") / F.col("si_min"))).select(*keys, "si_min", "si_max", "n", "spread", F.nullif("caution", F.lit("")).alias("caution"))


def shortlist(candidates: DataFrame, tier: str, score: str, n: int) -> DataFrame:
    """candidates with ``position``: the best of each tier by score, ties to the smaller id, with how many the tier has."""
    ranked = rank.top_k(candidates, [tier], [F.desc_nulls_last(score), F.asc("id")], n)
    return ranked.join(candidates.groupBy(tier).agg(F.count("*").alias("in_tier")), tier)


# ---------------------------------------------------------------- questions

KINDS: list[tuple[str, str]] = [
    (r"\b(discover|invent|design|find me a new|novel)\b", "prospecting"),
    (r"\b(compare|versus|vs\.?)\b", "compare"),
    (r"\b(rank|triage|prioriti[sz]e|order these)\b", "triage"),
    (r"\b(shortlist|candidates?)\b", "shortlist"),
    (r"\bpathways?\b", "pathways"),
    (r"\b(evidence|source|citation|reference)s?\b", "evidence"),
    (r"\b(neighbou?rs?|connected|linked)\b", "neighbours"),
    (r"\b(why|explain|how)\b", "explain"),
    (r"\b(what is|who is|describe|profile)\b", "profile"),
]


def classify_question(text: str) -> str:
    low = text.lower()
    return next((kind for pattern, kind in KINDS if re.search(pattern, low)), "unknown")


@dataclass(frozen=True)
class Verdict:
    allowed: bool
    reason: str = ""
    caveats: tuple[str, ...] = ()


def guard(kind: str, routes: dict[str, int], caveats: dict[str, Callable[[dict], bool]] | None = None) -> Verdict:
    """Refuses prospecting and kinds that need a route where there is none; attaches the caveats whose test holds."""
    if kind == "prospecting":
        return Verdict(False, "the graph records what was measured; it does not propose new compounds")
    if kind in ("explain", "pathways", "triage", "shortlist") and not sum(routes.values()):
        return Verdict(False, "no route of the graph leads there")
    return Verdict(True, "", tuple(k for k, test in (caveats or {}).items() if test(routes)))


_ORDINALS = {"first": 0, "second": 1, "third": 2, "fourth": 3, "fifth": 4, "last": -1}


def follow_up(text: str, previous: list[str]) -> str | None:
    """The entity that a follow-up question means: an ordinal of the last list, or the only one."""
    low = text.lower()
    for word, i in _ORDINALS.items():
        if re.search(rf"\b{word}\b", low) and previous and -len(previous) <= i < len(previous):
            return previous[i]
    return previous[0] if len(previous) == 1 and re.search(r"\b(it|that|this|its)\b", low) else None


# ---------------------------------------------------------------- answers

_ID = re.compile(r"\bE[0-9a-f]{1,16}\b")
_NUMBER = re.compile(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.]*\w)")


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\[])", text) if s.strip()]


def verify(answer: str, facts: list[str], edge_ids: list[str], caveats: list[str] = ()) -> list[str]:
    """What is wrong with an answer: unknown ids, uncited sentences, dropped caveats, stray numbers, truncation, nothing left."""
    out, known = [], set(edge_ids)
    cited = set(_ID.findall(answer))
    out += [f"unknown id {i}" for i in sorted(cited - known)]
    out += [f"uncited: {s[:60]}" for s in split_sentences(answer) if not _ID.search(s) and not any(c.lower() in s.lower() for c in caveats)]
    out += [f"dropped caveat {c}" for c in caveats if c.lower() not in answer.lower()]
    supplied = set(_NUMBER.findall(" ".join(facts)))
    out += [f"stray number {n}" for n in sorted(set(_NUMBER.findall(_ID.sub("", answer))) - supplied)]
    if answer and answer.rstrip()[-1:] not in ".!?]":
        out.append("truncated")
    if not answer.strip():
        out.append("empty")
    return out


def answer(question: str, facts: list[str], edge_ids: list[str], caveats: list[str], model: Callable[[str], str] | None = None, check: Callable[[str, list[str]], list[str]] | None = None) -> Result:
    """The facts as they are without a model; with one its text if it verifies, asked once more if caveats were dropped."""
    if model is None:
        return Result(True, "facts", facts, facts, list(caveats), edge_ids)
    prompt = "\n".join([question, *facts, *caveats])
    text = model(prompt)
    problems = verify(text, facts, edge_ids, caveats)
    if any(p.startswith("dropped caveat") for p in problems):
        text = model(prompt + "\nKeep every caveat.")
        problems = verify(text, facts, edge_ids, caveats)
    problems += check(text, facts) if check else []
    return Result(not problems, "answer" if not problems else "refused", facts, [text] if not problems else facts, [*caveats, *problems], edge_ids)
