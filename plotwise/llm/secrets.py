"""Secret scans through a trigram inverted index, in DataFrame functions only.

For every rule a Boolean trigram query is derived from its regular expression:
an OR of sets of trigrams that any match must contain in lower case. The index
holds a posting (trigram, document) for each trigram some query asks for.
Intersecting the postings of a set gives the candidates of its rule; only they
are verified by the regular expression itself. A rule without a mandatory
trigram scans every text.

Postings are dealt by (set, document), never by trigram, so a trigram that
most documents hold is no hot key. Texts travel once, to meet their candidate
rules.

A null text is empty; null ids form one posting key and are verified as one
group, each row on its own text. Rows that share an id are candidates
together, and each is verified by itself. Rows without a span are kept with
counts 0 and an empty string; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from plotwise.functions.text import bind

try:
    from re import _constants as sre, _parser
except ImportError:  # older interpreters keep them at top level
    import sre_constants as sre
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` are spans if capture `group` (0: all) has `least` code points."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base kinds, in their listed order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Published token shapes; all of them open with a fixed word.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
WIDEST = 32
PAGE = 1024


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of AND-sets of lower-case trigrams that every match contains; [] if there is none.

    The expression is read as pieces that are either a small set of possible
    strings or unknown. Strings of neighbouring known pieces are multiplied
    out; an unknown piece ends the run, and each run demands its trigrams.
    """

    def strings(items) -> list[set[str] | None]:
        out: list[set[str] | None] = []
        for op, arg in items:
            if op is sre.LITERAL:
                out.append({chr(arg).lower()})
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= WIDEST:
                out.append({chr(a).lower() for _, a in arg})
            elif op is sre.SUBPATTERN:
                out += strings(arg[3])
            elif op is sre.BRANCH:
                alternatives = [strings(x) for x in arg[1]]
                whole = [joined(x) for x in alternatives]
                out.append(set().union(*whole) if all(w is not None for w in whole) else None)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, sub = arg
                one = joined(strings(sub))
                if one is not None and high != sre.MAXREPEAT and len(one) ** int(high) <= WIDEST and high <= 4:
                    out.append({"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)})
                else:
                    # What must come is known, what follows is not.
                    out += ([one] if low and one is not None else []) + [None]
            elif op is not sre.AT:
                out.append(None)
        return out

    def joined(pieces) -> set[str] | None:
        got = {""}
        for p in pieces:
            if p is None or len(got) * len(p) > WIDEST:
                return None
            got = {a + b for a in got for b in p}
        return got

    def demands(known: set[str]) -> list[frozenset[str]]:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in known]
        return [] if any(not s for s in sets) else sets

    query: list[frozenset[str]] = []
    run: set[str] = {""}
    for piece in [*strings(_parser.parse(pattern)), None]:
        grown = joined([run, piece]) if piece is not None else None
        if grown is not None:
            run = grown
            continue
        if (sets := demands(run)) and (not query or len(sets) * len(query) <= WIDEST):
            query = [a | b for a in query or [frozenset()] for b in sets]
        run = piece if piece is not None else {""}
    # A set that holds another set asks for more than the OR needs.
    return sorted({s for s in query if not any(t < s for t in query)}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id") -> DataFrame:
    """(trigram, key), one row for each of `trigrams` that a text holds."""
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(key, F.lower("text").alias("low")).select(key, F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """(key, kinds): the rules whose trigram query a document satisfies."""
    sets = [(r.kind, i, sorted(s)) for r in rules for i, s in enumerate(trigram_query(r.pattern))]
    asked = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("nth"), F.lit(t).alias("trigram"), F.lit(1 << j).cast("long").alias("bit"), F.lit((1 << len(s)) - 1).cast("long").alias("all")) for k, i, s in sets for j, t in enumerate(s)]
    # One row for each trigram of each rule's sets.
    query = docs.sparkSession.range(1).select(F.inline(F.array(*asked)))
    index = postings(docs, sorted({t for _, _, s in sets for t in s}), key)
    hits = index.join(F.broadcast(query), "trigram").groupBy("kind", "nth", "all", key).agg(F.bit_or("bit").alias("got")).where("got = all")
    return hits.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def running(values: Column, op) -> Column:
    """Running sum, maximum or other associative `op` of an array.

    Each of log2(n) levels joins every entry with the one 2^level before it, so
    no step copies what earlier ones have gathered.
    """
    levels = F.sequence(F.lit(0), F.log2(F.greatest(F.size(values), F.lit(1))).cast("int"))

    def level(a: Column, d: Column) -> Column:
        return F.transform(a, lambda x, i: op(x, F.coalesce(F.get(a, i - F.pow(F.lit(2), d).cast("int")), F.lit(0))))

    return F.aggregate(levels, values, level)


def spans(rule: Rule, text: Column) -> Column:
    """Array of (start, end) of the rule's leftmost non-overlapping matches that are long enough.

    The gaps between matches and the matches themselves give all positions,
    in code points.
    """
    rx = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    tested = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    # The text behind the last match is a gap without a match.
    sizes = F.zip_with(F.arrays_zip(F.transform(found, F.length).alias("m"), F.transform(tested, F.length).alias("t")), F.transform(gaps, F.length), lambda x, g: F.struct(x["m"].alias("m"), x["t"].alias("t"), g.alias("g")))

    def placed(rows: Column) -> Column:
        def at(ends: Column) -> Column:
            return F.zip_with(rows, ends, lambda r, e: F.struct((e - r["m"]).alias("start"), e.alias("end"), r["t"].alias("t")))

        ends = running(F.transform(rows, lambda r: r["g"] + r["m"]), lambda x, y: x + y)
        return F.transform(F.filter(bind(ends, at), lambda s: s["t"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return bind(F.filter(sizes, lambda s: s["m"].isNotNull()), placed)


def scan_pattern(rule: Rule) -> Rule:
    """The same rule, asking for its length at once where the pattern is fixed letters and one `[set]+`: runs are maximal either way."""
    if rule.group or not rule.pattern.endswith("]+") or rule.pattern.count("[") != 1:
        return rule
    return Rule(rule.kind, rule.pattern[:-1] + "{%d,}" % (rule.least - rule.pattern.index("[")), 1)


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """docs with `_found`: array of (start, rank, kind, end) by start, then rule order."""
    with_query = [r for r in rules if trigram_query(r.pattern)]
    cand = candidates(docs, with_query, key).select(F.col(key).alias("_key"), F.col("kinds").alias("_kinds"))
    joined = docs.join(cand, docs[key].eqNullSafe(cand["_key"]), "left").drop("_key")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def found(rank: int, rule: Rule) -> Column:
        got = F.transform(spans(scan_pattern(rule), text), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))
        # Rules without a query scan every text; positions are worked out only where something is found.
        hit = F.array_contains("_kinds", rule.kind) if rule in with_query else F.lit(True)
        return F.when(hit & F.regexp_like(text, F.lit(scan_pattern(rule).pattern)), got).otherwise(none)

    parts = [found(*x) for x in enumerate(rules)]
    return joined.withColumn("_found", F.array_sort(F.concat(*parts))).drop("_kinds")


def text_of(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans."""
    names = [r.kind for r in BASE]
    f = scan(docs.select("doc_id", "text"), rules)
    base = F.filter("_found", lambda s: s["kind"].isin(*names))

    def count(kind: str) -> Column:
        return F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in names]
    return f.select("doc_id", *n, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("_found")).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mask: str = "[{}]") -> DataFrame:
    """docs with every span replaced by its kind; overlapping spans become the mask of the first one.

    The text is cut into blocks of PAGE code points, so what stands between two
    spans is read from its own blocks and not from the start of the text.
    """
    f = scan(docs, rules)

    def between(pages: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PAGE).cast("int")
        some = F.array_join(F.slice(pages, first + 1, F.floor((end - 1) / PAGE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(some, start - first * PAGE + 1, end - start)).otherwise(F.lit(""))

    def written(pages: Column) -> Column:
        def pieces(tops: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                top = F.coalesce(F.get(tops, i - 1), F.lit(0))
                name = F.format_string(mask.replace("{}", "%s"), s["kind"])
                return F.when(s["start"] >= top, F.concat(between(pages, top, s["start"]), name)).otherwise(F.lit(""))

            rest = between(pages, F.element_at(tops, -1), F.length("text"))
            return F.concat(F.array_join(F.transform("_found", piece), ""), rest)

        return bind(running(F.transform("_found", lambda s: s["end"]), F.greatest), pieces)

    out = bind(F.regexp_extract_all(F.col("text"), F.lit("(?s).{1,%d}" % PAGE), F.lit(0)), written)
    changed = F.when(F.size("_found") > 0, out).otherwise(F.col("text"))
    return f.withColumn("text", changed).select(*docs.columns)
