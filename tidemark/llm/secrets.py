"""Secret scans over a trigram index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived
that every match satisfies.  The index is partitioned by document: a row's
postings are a bitmap over the trigrams that the rules ask for, so that the
intersection of posting lists is an AND of bitmaps and nothing is shuffled.
Only documents that satisfy a rule's query are verified with its expression;
rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, fresh_names

ANY = ("any",)
MAX_STRINGS = 32
WORD_BITS = 62
BLOCK = 256
SPANS = "array<struct<start:bigint,ord:int,stop:bigint,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is valid in Python and Java; a match counts if its whole
    text has ``least`` code points, or if group ``group`` has."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
    # to the END line; without one, over the whole lines of base64 that follow
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|(?:[\x20\x09-\x0D]*+[A-Za-z0-9+/=]{40,}+)*+)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("login", r"""[a-z][a-z0-9+.-]{1,15}://[^/\x20\x09-\x0D:@"'<>]++:[^/\x20\x09-\x0D:@"'<>]++@"""),
]


# -- from a regular expression to a Boolean query over trigrams ---------------------
@dataclass(frozen=True)
class Info:
    """What is known of the strings a part matches: ``exact`` (all of them, or
    None), their possible ``heads`` and ``tails``, and a query they satisfy."""

    exact: frozenset[str] | None
    heads: frozenset[str]
    tails: frozenset[str]
    query: tuple


def conj(a: tuple, b: tuple) -> tuple:
    if a == ANY or a == b:
        return b
    if b == ANY:
        return a
    parts = [x for q in (a, b) for x in (q[1] if q[0] == "and" else (q,))]
    return ("and", tuple(dict.fromkeys(parts)))


def disj(queries: list[tuple]) -> tuple:
    if not queries or ANY in queries:
        return ANY
    parts = list(dict.fromkeys(x for q in queries for x in (q[1] if q[0] == "or" else (q,))))
    needs = lambda q: set(q[1]) if q[0] == "and" else {q}
    parts = [q for q in parts if not any(needs(p) < needs(q) for p in parts)]  # a weaker one covers it
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def grams(text: str) -> tuple:
    """Every trigram of a string must be there; shorter strings tell nothing."""
    q = ANY
    for i in range(len(text) - 2):
        q = conj(q, ("gram", text[i : i + 3]))
    return q


def of_set(strings: frozenset[str]) -> tuple:
    return disj([grams(s) for s in sorted(strings)])


def literal(strings: frozenset[str]) -> Info:
    return Info(strings, strings, strings, ANY)


NOTHING_KNOWN = Info(None, frozenset([""]), frozenset([""]), ANY)


def join(a: Info, b: Info) -> Info:
    """Information on a followed by b."""
    query = conj(a.query, b.query)
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_STRINGS:
        both = frozenset(x + y for x in a.exact for y in b.exact)
        return Info(both, both, both, query)
    # trigrams across the seam, and of exact parts that end here
    if len(a.tails) * len(b.heads) <= MAX_STRINGS:
        query = conj(query, of_set(frozenset(x + y for x in a.tails for y in b.heads)))
    else:
        query = conj(conj(query, of_set(a.tails)), of_set(b.heads))
    heads = frozenset(x + y for x in a.exact for y in b.heads) if a.exact is not None and len(a.exact) * len(b.heads) <= MAX_STRINGS else a.heads
    tails = frozenset(x + y for x in a.tails for y in b.exact) if b.exact is not None and len(a.tails) * len(b.exact) <= MAX_STRINGS else b.tails
    return Info(None, heads, tails, query)


def either(parts: list[Info]) -> Info:
    exact = None
    if all(p.exact is not None for p in parts):
        exact = frozenset(itertools.chain.from_iterable(p.exact for p in parts))
        if len(exact) > MAX_STRINGS:
            exact = None
    whole = lambda p: conj(p.query, of_set(p.exact)) if p.exact is not None else p.query
    query = ANY if exact is not None else disj([whole(p) for p in parts])
    merge = lambda sets: found if len(found := frozenset(itertools.chain.from_iterable(sets))) <= MAX_STRINGS else frozenset([""])
    return Info(exact, merge([p.heads for p in parts]), merge([p.tails for p in parts]), query)


def analyse(items) -> Info:
    """Walk a parsed expression; letters are folded to lower case, so the
    query holds whatever the case."""
    info = literal(frozenset([""]))
    for op, arg in items:
        if op is sre.LITERAL:
            part = literal(frozenset([chr(arg).lower()]))
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL and chars is not None:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and chars is not None and value[1] - value[0] < 8:
                    chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
                else:
                    chars = None
            part = literal(frozenset(chars)) if chars and len(chars) <= 8 else NOTHING_KNOWN
        elif op is sre.SUBPATTERN:
            part = analyse(arg[3])
        elif op is sre.BRANCH:
            part = either([analyse(b) for b in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = analyse(inner)
            if (low, high) == (0, 1):
                part = either([literal(frozenset([""])), one])
            elif low == high and low <= 4:
                part = literal(frozenset([""]))
                for _ in range(low):
                    part = join(part, one)
            elif low:
                part = Info(None, one.heads, one.tails, conj(one.query, of_set(one.exact) if one.exact is not None else ANY))
            else:
                part = NOTHING_KNOWN
        elif op is sre.AT:
            part = literal(frozenset([""]))
        else:
            part = NOTHING_KNOWN
        info = join(info, part)
    return info


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query of a pattern; ANY where nothing is mandatory."""
    info = analyse(sre_parser.parse(pattern))
    return conj(info.query, of_set(info.exact) if info.exact is not None else conj(of_set(info.heads), of_set(info.tails)))


def query_grams(q: tuple) -> set[str]:
    if q[0] == "gram":
        return {q[1]}
    return set().union(*(query_grams(x) for x in q[1])) if q[0] in ("and", "or") else set()


# -- the index ------------------------------------------------------------------
class Index:
    """Dictionary of the trigrams that the rules' queries mention, and the
    columns that hold a row's posting bitmap."""

    def __init__(self, rules: list[Rule], columns: list[str] | None = None):
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.grams = sorted(set().union(*(query_grams(q) for q in self.queries.values())))
        self.at = {g: i for i, g in enumerate(self.grams)}
        self.words = (len(self.grams) + WORD_BITS - 1) // WORD_BITS
        self.columns = columns or [f"_postings{w}" for w in range(self.words)]

    def add(self, df: DataFrame, text: str) -> DataFrame:
        """Posting bitmaps of every row."""
        folded = fresh_names(df, "folded")[0]
        df = df.withColumn(folded, F.lower(F.col(text)))
        for w, name in enumerate(self.columns):
            bits = F.lit(0).cast("bigint")
            for i, g in enumerate(self.grams[w * WORD_BITS : (w + 1) * WORD_BITS]):
                bits = bits + F.when(F.contains(F.col(folded), F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            df = df.withColumn(name, bits)
        return df.drop(folded)

    def _masks(self, names: set[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for g in names:
            column = self.columns[self.at[g] // WORD_BITS]
            out[column] = out.get(column, 0) | 1 << self.at[g] % WORD_BITS
        return out

    def candidate(self, q: tuple) -> Column:
        """A query over the bitmaps: an AND of trigrams is one mask a word."""
        if q == ANY:
            return F.lit(True)
        if q[0] == "or":
            found = F.lit(False)
            for x in q[1]:
                found = found | self.candidate(x)
            return found
        parts = [q] if q[0] == "gram" else list(q[1])
        found = F.lit(True)
        for column, mask in self._masks({p[1] for p in parts if p[0] == "gram"}).items():
            found = found & (F.col(column).bitwiseAND(F.lit(mask)) == mask)
        for p in parts:
            if p[0] != "gram":
                found = found & self.candidate(p)
        return found

    def postings(self, df: DataFrame, text: str, row: str) -> DataFrame:
        """(gram, row): the posting lists written out, for inspection."""
        each = [F.when(F.col(self.columns[i // WORD_BITS]).bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0, F.lit(g)) for g, i in self.at.items()]
        return self.add(df.select(row, text), text).select(F.explode(F.array_compact(F.array(*each))).alias("gram"), row)


# -- verification ------------------------------------------------------------------
def once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: an array of one element
    stands for a local variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def placed(pieces: Column, order: int, kind: str) -> Column:
    """Spans of pieces (gap, size, counts): every start is the sum of all gaps
    and sizes before it.  Sums run within blocks of BLOCK pieces and over the
    blocks, so that no list grows by one copy a finding."""
    entry = "struct<start:bigint,stop:bigint,counts:boolean>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        made = F.struct(start.alias("start"), (start + p["size"]).alias("stop"), p["counts"].alias("counts"))
        return F.struct((start + p["size"]).alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    zero = F.lit(0).cast("bigint")
    own = lambda block: F.aggregate(block, F.struct(zero.alias("at"), F.array().cast(f"array<{entry}>").alias("out")), step)
    last = F.floor((F.size(pieces) - 1) / BLOCK)
    blocks = F.transform(F.sequence(zero, last), lambda b: own(F.slice(pieces, (b * BLOCK + 1).cast("int"), BLOCK)))

    def joined(found: Column) -> Column:
        before = F.aggregate(
            found,
            F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        moved = lambda x, low: F.transform(
            F.filter(x["out"], lambda e: e["counts"]),
            lambda e: F.struct((e["start"] + low).alias("start"), F.lit(order).alias("ord"), (e["stop"] + low).alias("stop"), F.lit(kind).alias("kind")),
        )
        return F.flatten(F.zip_with(found, before, moved))

    # sequence(0, -1) counts down, hence the guard
    return F.when(F.size(pieces) > 0, once(blocks, joined)).otherwise(F.array().cast(SPANS))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct(start, ord, stop, kind)> of a rule's matches, leftmost and
    without overlap, in code points.

    Start positions are running sums over the pieces between matches and the
    matches themselves; matches that are too short are dropped afterwards, so
    they still use up their text.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)

    def piece(hit: Column, gap: Column) -> Column:
        measured = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
        return F.struct(gap.cast("bigint").alias("gap"), F.char_length(hit).cast("bigint").alias("size"), (F.char_length(measured) >= rule.least).alias("counts"))

    pieces = once(matches, lambda m: F.zip_with(m, F.slice(gaps, 1, F.size(m)), piece))
    return once(pieces, lambda p: placed(p, order, rule.kind))


def quick_test(rule: Rule) -> str:
    """An expression that every counting match satisfies and that fails fast."""
    return r"[0-9a-f]{24}" if rule.kind == "hex" else rule.pattern


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``spans``: all findings by start, then by rule order.

    A null text is read as empty and has none; texts may be of any length and
    hold any number of findings.  Rows are independent: no shuffle, repeated
    rows give repeated results.  All columns of ``docs`` stay as they are; if
    one is named ``spans``, the result's name gets an underscore in front
    (``common.free_name``)."""
    rules = rules or RULES
    text, *columns = fresh_names(docs, "text", *(f"postings{w}" for w in range(Index(rules).words)))
    index = Index(rules, columns)
    df = index.add(docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))), text)
    empty = F.array().cast(SPANS)
    found = [F.when(index.candidate(index.queries[r.kind]) & F.col(text).rlike(quick_test(r)), rule_spans(F.col(text), r, i)).otherwise(empty) for i, r in enumerate(rules)]
    return df.withColumn(free_name(docs, "spans"), F.array_sort(F.flatten(F.array(*found)))).drop(text, *columns)


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(count, base), F.sha2(written(own).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
