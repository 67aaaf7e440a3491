"""Personal data: fixed shapes as seeds, and bootstrapped contextual extraction around them.

Seeds are the spans of the base shapes (email, ip, card, phone), and the words that announce a secret
(``SECRET_NAMES``) are seed patterns of a fifth kind. Every seed and every other stretch of a kind's loose
shape has lexical patterns: the word and the two words before it, the word and the two words after it.
Spark scores the pattern-instance graph: a pattern's confidence for a kind is its instances' mean belief
(known ones count, unknown and other kinds' do not); an instance's belief is that one of its sides is
right, each side as sure as its most confident pattern. Only patterns of ``MIN_CONFIDENCE`` that are
supported by ``MIN_SEEDS`` distinct instances count. Instances found join the known ones, so their other
contexts become patterns in the next round, until nothing changes or for ``ROUNDS`` rounds. An instance is
its value without separators, so a known value is recognised in a form that the base shapes miss.

Edge cases: a null text is empty; a text of any length takes time in proportion to it; offsets count code
points, ends are exclusive; found spans never overlap base spans; rows that repeat an id are rows of their
own; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces, quoted, strings

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 5, 5, 0.8

# The words that announce a secret.
SECRET_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "private_key", "bearer")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT, _AT = re.compile(r"[0-9@]"), re.compile(r"[\[(]at[\])]")
_LOOSE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+"
    r"|(?<![A-Za-z0-9_])[+(]?[0-9](?:[().:/\x20-]{0,2}[0-9])++(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"
)
_WORDS = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>,.;:!?*$%&#|"


def _local_start(text: str, at: int, low: int) -> int:
    """Where the longest run of local-part characters that ends before ``at`` begins, not before ``low``."""
    s = at
    while s > low and (c := text[s - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
        s -= 1
    return s


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, low)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base shapes, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not (first := _HINT.search(text)):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text, first.start()) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text, first.start()):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_kinds(token: str) -> int:
    """Bits of the kinds whose loose shape a stretch has."""
    digits, letters = sum("0" <= c <= "9" for c in token), sum(c.isalpha() for c in token)
    rest = {c for c in token if not "0" <= c <= "9"}
    email = "@" in token[1:-1] or "at" in token and bool(_AT.search(token))
    ip = digits >= 4 and len(rest) == 1 and rest <= set(".:") and 3 <= len(re.findall("[.:]", token)) <= 7
    card = 12 <= digits <= 19 and rest <= set("-. ")
    phone = 7 <= digits <= 15 and rest <= set("-().+/ ") and not ip
    secret = not email and len(token) >= 16 and digits >= 4 and letters >= 4
    return email | ip << 1 | card << 2 | phone << 3 | secret << 4


def instance(value: str) -> int:
    """The hash of a value without separators, letters in lower case."""
    bare = _AT.sub("@", re.sub(r"[\[(]dot[\])]", ".", value.lower()))
    bare = bare.replace(" ", "") if "@" in bare else "".join(c for c in bare if c.isalnum())
    return xxhash.xxh64_intdigest(bare.encode()) >> 1


def _word(raw: str) -> str:
    return raw.lower().strip(_EDGE) or raw.lower()


def patterns(text: str, words: list[tuple[int, int]], starts: list[int], s: int, e: int) -> list[str]:
    """The lexical patterns around a stretch: one and two words before it, one and two after it; ^ and $ where the text ends."""
    i, j = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
    before, after = text[words[i][0] : s].strip(_EDGE), text[e : words[j][1]].strip(_EDGE)
    left = ["^", "^", *(_word(text[a:b]) for a, b in words[max(0, i - 2) : i]), *([before.lower()] if before else [])]
    right = [*([after.lower()] if after else []), *(_word(text[a:b]) for a, b in words[j + 1 : j + 3]), "$", "$"]
    return [f"1< {left[-1]}", f"2< {left[-2]} {left[-1]}", f"1> {right[0]}", f"2> {right[0]} {right[1]}"]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[str], int]]:
    """(kind number or -1, loose kinds, start, end, patterns, instance) of seeds and of other stretches of a loose shape."""
    if not _HINT.search(text) and not _AT.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    found = [(k, 0, s, e) for k, s, e in base]
    i = 0
    for m in _LOOSE.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i == len(taken) or taken[i][0] >= e) and (kinds := loose_kinds(m[0])):
            found.append((-1, kinds, s, e))
    if not found:
        return []
    words = [m.span() for m in _WORDS.finditer(text)]
    starts = [a for a, _ in words]
    return [(k, kinds, s, e, patterns(text, words, starts, s, e), instance(text[s:e])) for k, kinds, s, e in found]


def span_text(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: base spans and candidates of every row; no text goes on."""
    kind = docs.schema[id_col].dataType.simpleString()
    cand = pa.list_(pa.struct([("k", pa.int32()), ("loose", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("patterns", pa.list_(pa.string())), ("inst", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = strings(b, text_col)
            base = [base_spans(t) for t in texts]
            found = [[{"k": k, "loose": m, "s": s, "e": e, "patterns": p, "inst": v} for k, m, s, e, p, v in candidates(t, x)] for t, x in zip(texts, base)]
            yield pa.RecordBatch.from_pydict(
                {id_col: b.column(id_col), "text_hash": b.column("text_hash")}
                | {f"n_{name}": pa.array([sum(k == i for k, _, _ in x) for x in base], pa.int64()) for i, name in enumerate(BASE_KINDS)}
                | {"base": pa.array([span_text(x) for x in base]), "cands": pa.array(found, cand)}
            )

    rows = docs.select(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), text_col)
    counts = ", ".join(f"n_{x} bigint" for x in BASE_KINDS)
    return rows.mapInArrow(run, f"{id_col} {kind}, text_hash bigint, {counts}, base string, cands array<struct<k int, loose int, s int, e int, patterns array<string>, inst bigint>>")


def _bit(kind: Column) -> Column:
    return F.pow(F.lit(2), kind).cast("int")


def score_patterns(cands: DataFrame, scratch: Scratch, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """cands(k, loose, pattern, inst) to the trusted patterns (pattern, kind, confidence) and the known instances (inst, kind, belief), written.

    The graph has distinct instances only, and sums per pattern come before any join.
    """
    nodes = scratch.save(cands.groupBy("pattern", "inst").agg(F.max("k").alias("k"), F.max("loose").alias("loose")))
    size = scratch.save(nodes.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds))
    given = scratch.spark.createDataFrame([(p, KINDS.index("secret"), 1.0) for name in SECRET_NAMES for p in (f"1< {name}", f"2< {name} =", f"2< {name} is")], "pattern string, kind int, confidence double")
    known = scratch.save(nodes.where("k >= 0").select("inst", F.col("k").alias("kind"), F.lit(1.0).alias("belief")).dropDuplicates())
    seeds, sums, trust = known, None, None
    for _ in range(rounds):
        support = nodes.select("pattern", "inst").join(known, "inst").groupBy("pattern", "kind").agg(F.sum("belief").alias("belief"), F.count("*").alias("support"))
        scored = support.where(F.col("support") >= min_seeds).join(size, "pattern").select("pattern", "kind", (F.col("belief") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= min_confidence)
        new = scratch.save(scored.unionByName(given).groupBy("pattern", "kind").agg(F.max("confidence").alias("confidence")))
        if trust is not None:
            scratch.drop(trust)
        trust = new
        met = nodes.where("k < 0").join(trust, "pattern").where(F.col("loose").bitwiseAND(_bit(F.col("kind"))) > 0)
        side = met.groupBy("inst", "kind", F.substring("pattern", 2, 1).alias("side")).agg(F.max("confidence").alias("sure"))
        sure = side.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))))).alias("belief"))
        best = sure.groupBy("inst").agg(F.max(F.struct("belief", (-F.col("kind")).alias("order"))).alias("best")).select("inst", (-F.col("best.order")).alias("kind"), F.col("best.belief").alias("belief"))
        grown = scratch.save(seeds.unionByName(best.join(seeds.select("inst"), "inst", "left_anti")))
        if known is not seeds:
            scratch.drop(known)
        known, before = grown, sums
        sums = known.agg(F.count("*"), F.round(F.sum("belief"), 6)).first()
        if sums == before:
            break
    scratch.drop(nodes, size)
    return trust, known


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, text_hash, the counts and text of base spans, ``found`` (spans the method adds) and ``spans`` (all)."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.save(scan(docs, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    links = each.select("k", "loose", F.explode("patterns").alias("pattern"), "inst")
    trust, values = score_patterns(links, scratch)
    new = each.where("k < 0").select("row", "s", "e", "loose", F.explode("patterns").alias("pattern")).join(trust, "pattern").select("row", "s", "e", "loose", "kind", "confidence")
    known = each.where("k < 0").select("row", "s", "e", "loose", "inst").join(values, "inst").select("row", "s", "e", "loose", "kind", F.col("belief").alias("confidence"))
    new = new.unionByName(known).where(F.col("loose").bitwiseAND(_bit(F.col("kind"))) > 0)
    new = new.groupBy("row", "s", "e").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("best"))
    span = F.struct((-F.col("best.order")).alias("kind"), "s", "e")
    new = scratch.save(new.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("new")))
    scratch.drop(trust, values)
    names = F.array(*map(F.lit, KINDS))
    as_text = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    parsed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct((F.array_position(names, F.substring_index(x, ":", 1)) - 1).cast("int").alias("kind"), F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e")))
    added = F.coalesce("new", F.array().cast("array<struct<kind:int,s:int,e:int>>"))
    out = rows.join(new, "row", "left")
    spans = F.when(F.size(added) == 0, F.col("base")).otherwise(F.array_join(F.transform(F.sort_array(F.concat(parsed, added)), as_text), ","))
    return out.select(id_col, "text_hash", *[f"n_{k}" for k in BASE_KINDS], "base", F.size(added).cast("long").alias("n_found"), F.array_join(F.transform(added, as_text), ",").alias("found"), spans.alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of overlapping spans the first, then the longest, counts."""
    spans = find(docs, id_col=id_col, text_col=text_col, scratch=scratch).where("spans <> ''").select(F.col(id_col).alias("i"), F.col("text_hash").alias("h"), "spans").dropDuplicates(["i", "h"]).alias("s")
    own = lambda c: F.col(f"d.{quoted(c)}")
    joined = docs.alias("d").join(spans, own(id_col).eqNullSafe(F.col("s.i")) & (F.xxhash64(F.coalesce(own(text_col), F.lit(""))) == F.col("s.h")), "left")

    @F.pandas_udf("string")
    def blank(text, marks):
        return text.combine(marks, lambda t, m: t if not isinstance(m, str) or t is None else redact_text(t, m))

    clean = F.when(F.col("s.spans").isNull(), own(text_col)).otherwise(blank(own(text_col), F.col("s.spans")))
    return joined.select(*[(clean if c == text_col else own(c)).alias(c) for c in docs.columns])


def redact_text(text: str, spans: str) -> str:
    marks = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, k in marks:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = -e
    return "".join([*out, text[at:]])

