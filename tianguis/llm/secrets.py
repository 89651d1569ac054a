"""Secret scans through a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold. The postings of
those trigrams name the documents that can match at all; only there the expression itself is run. A rule that has no
mandatory trigram is run on every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tianguis.llm.common import counted, saved

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Strings that are followed exactly while a query is derived.
EXACT = 64
#: Matches whose places are added up in one array; long lists are put together from such parts.
PART = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# The patterns and least lengths of the kinds every scan reports.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds.
MORE = (
    # with the key: up to the END mark, or headers and base64 lines where that is missing
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
        r"(?:[^-]*(?:-[^-]+){0,40}-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?:\s{0,8}[A-Za-z][A-Za-z-]{2,30}:\x20[^\r\n]{1,200}){0,8}(?:\s{0,8}[A-Za-z0-9+/=\\]{16,}){0,400}(?:\s{1,8}[A-Za-z0-9+/]{1,15}={1,2})?)",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

#: A Boolean query: every clause must hold; a clause holds if all trigrams of one of its sets are there.
Query = list[list[frozenset[str]]]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _exact(items, any_case: bool) -> set[str] | None:
    """All (lower-case) strings the items can match, or None if they are too many."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            nxt = {chr(arg).lower()}
        elif op is sre.IN:
            if any(o is not sre.LITERAL and o is not sre.RANGE for o, _ in arg):
                return None
            codes = {c for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], min(a[1], a[0] + EXACT) + 1))}
            nxt = {chr(c).lower() for c in codes}
            if len(nxt) > 8:
                return None
        elif op is sre.SUBPATTERN:
            nxt = _exact(arg[3], any_case)
        elif op is sre.BRANCH:
            parts = [_exact(b, any_case) for b in arg[1]]
            nxt = None if any(p is None for p in parts) else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _exact(inner, any_case)
            if one is None or high is sre.MAXREPEAT or high > 5:
                return None
            nxt, grown = set(), {""}
            for n in range(high + 1):
                nxt |= grown if n >= low else set()
                grown = {a + b for a in grown for b in one}
                if len(grown) > EXACT:
                    return None
        elif op is sre.AT:
            nxt = {""}
        else:
            return None
        if nxt is None:
            return None
        out = {a + b for a in out for b in nxt}
        if len(out) > EXACT:
            return None
    return out


def _clauses(items, any_case: bool) -> Query:
    """Clauses of a sequence: the longest stretches whose strings are all known, and the clauses inside the rest."""
    query: Query = []
    known = {""}

    def close():
        if known and min(map(len, known)) >= 3:
            sets = {_trigrams(s) for s in known}
            query.append(sorted((s for s in sets if not any(other < s for other in sets)), key=sorted))

    for item in items:
        exact = _exact([item], any_case)
        joined = {a + b for a in known for b in exact} if exact is not None else None
        if joined is not None and len(joined) <= EXACT:
            known = joined
            continue
        close()
        op, arg = item
        if exact is not None:
            known = exact
            continue
        known = {""}
        if op is sre.SUBPATTERN:
            query += _clauses(arg[3], any_case)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            inner = _exact(arg[2], any_case)
            if inner is not None and len(inner) <= 2:
                known = {s * arg[0] for s in inner}
                close()
                known = {""}
            elif inner is None:
                query += _clauses(arg[2], any_case)
    close()
    return query


def trigram_query(rule: Rule) -> Query:
    """Clauses over lower-case trigrams that every match of the rule fulfils; empty if none is mandatory."""
    return _clauses(list(sre_parse.parse(rule.pattern)), rule.any_case)


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def _seen(trigrams: list[str]) -> str:
    """An expression that finds every place of the trigrams, also overlapping ones, by their first character."""
    first: dict[str, list[str]] = {}
    for t in trigrams:
        first.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(f"{_literal(c)}(?:{'|'.join(map(_literal, rest))})" for c, rest in sorted(first.items())) + "))"


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id and text of each row with a hash of the text; null text is empty. Other columns stay aside."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def postings(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, doc_id, text_hash): where each trigram that the rules ask for occurs, once per document."""
    wanted = sorted({t for r in rules for clause in trigram_query(r) for some in clause for t in some})
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_seen(wanted)), F.lit(1)))
    return _keyed(documents).select(F.explode(found).alias("trigram"), "doc_id", "text_hash")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_hash, kinds): the rules whose trigram queries hold, from the intersected postings.

    A document's set holds at most as many trigrams as the rules name.
    """
    asked = [r for r in rules if trigram_query(r)]
    there = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("there"))

    def holds(rule: Rule) -> Column:
        def one(some):
            return F.size(F.array_intersect("there", F.array(*map(F.lit, sorted(some))))) == len(some)

        return reduce(Column.__and__, (reduce(Column.__or__, map(one, clause)) for clause in trigram_query(rule)))

    kinds = F.array_compact(F.array(*[F.when(holds(r), F.lit(r.kind)) for r in asked]))
    return there.select("doc_id", "text_hash", kinds.alias("kinds")).where(F.size("kinds") > 0)


_SPANS = "array<struct<start:long,kind_no:int,end:long,kind:string>>"


def _places(text: Column, rule: Rule, number: int) -> Column:
    """Spans of the rule's matches: lengths of what lies between and of the matches themselves, added up."""
    pattern = F.lit(rule.java)
    parts = F.arrays_zip(
        F.split(text, rule.java, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("core"),
    )
    sized = F.transform(
        F.filter(parts, lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), F.length(x["core"]).alias("core")),
    )
    cut = F.transform(F.array(sized), lambda s: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(s) - 1) / PART), F.lit(0))).cast("array<int>"), lambda c: F.slice(s, c * PART + 1, PART)
    ))[0]
    none = F.array().cast(_SPANS)

    def add(a, x):
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), (start + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(x["core"] >= rule.least, F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct((start + x["hit"]).alias("at"), out.alias("out"))

    def add_part(a, part):
        inner = F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), add)
        return F.transform(F.array(inner), lambda z: F.struct(z["at"].alias("at"), F.concat(a["out"], F.array(z["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    return F.aggregate(cut, start, add_part, lambda a: F.flatten(a["out"]))


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``spans`` of each row with text and kinds, sorted by start and then by the rules' order."""
    none = F.array().cast(_SPANS)
    columns = []
    for number, rule in enumerate(rules):
        if trigram_query(rule):
            ask = F.array_contains("kinds", rule.kind)
        else:
            # nothing is mandatory: one plain search through the whole text, the places only where it finds something
            ask = F.col("text").rlike(f"{rule.pattern.removesuffix('+')}{{{rule.least},}}" if rule.pattern.endswith("]+") else rule.java)
        columns.append(F.when(F.coalesce(ask, F.lit(False)), _places(F.col("text"), rule, number)).otherwise(none))
    return rows.withColumn("spans", F.array_sort(F.concat(*columns)))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, text, spans) for every row: spans as array of (start, kind_no, end, kind), in code points, end exclusive.

    A null text is an empty one, a null doc_id is carried along. Matches of a kind are leftmost and do not overlap; those
    whose group is too short are dropped after matching. Repeated rows stay repeated rows; other columns play no part; an
    empty table gives no rows. Candidates are joined on id and hash of the text, so copies under other ids are spread, and
    a hash met by two texts costs a search and changes no span.
    """
    keyed = _keyed(documents)
    named = candidates(saved(postings(documents, rules), "postings"), rules)
    named = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kinds")
    joined = keyed.join(named, keyed["doc_id"].eqNullSafe(named["_id"]) & (keyed["text_hash"] == named["_hash"]), "left")
    return _with_spans(joined.select("doc_id", "text", "kinds"), rules).select("doc_id", "text", "spans")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and hash of the base kinds, all spans as a string."""
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == number)).cast("long")

    names = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return scan(documents).select("doc_id", *names, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _masked(text: Column, spans: Column, sign: str) -> Column:
    """``text`` with every span overwritten character by character, overlapping spans taken together."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a, s):
        begin, end = F.greatest(s["start"], a["at"]), F.greatest(s["end"], a["at"])
        kept = F.substring(text, (a["at"] + 1).cast("int"), (begin - a["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(kept, F.repeat(F.lit(sign), (end - begin).cast("int")))).alias("out"))

    def finish(a):
        return F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))

    return F.aggregate(spans, start, add, finish)


def masked(documents: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, sign: str = "*") -> DataFrame:
    """``documents``, every secret overwritten with ``sign``: all rows, all columns, texts of unchanged length.

    A null text stays null. Rows are told apart by doc_id and text: a null id is an id like any other, repeated rows are all
    overwritten alike. Other columns pass through whatever their names are; an empty table gives no rows.
    """
    columns = documents.columns
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).withColumn("text", text)
    named = counted(candidates(saved(postings(documents, rules), "postings"), rules), "candidates")
    named = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kinds")
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    found = _with_spans(packed.join(named, same, "left").select("_row", "text", "kinds"), rules)
    clean = F.when(F.col("_row.text").isNull() | (F.size("spans") == 0), F.col("_row.text")).otherwise(_masked(F.col("text"), F.col("spans"), sign))
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns])
