"""Line dedup with an edit-distance join, in DataFrame functions only.

Lines are compared without the white space at their ends.  A line is dropped
if an equal line, or one within EDITS edits, comes earlier in the corpus (by
doc_id, then line).  The join finds near pairs as follows: every distinct line
is cut into EDITS + 1 segments; two lines within EDITS edits share one of the
shorter line's segments, at nearly the same place.  Segments are indexed under
(length of the line, segment number, content); a line probes the index of
every length from its own down to EDITS shorter, with the few substrings that
the position and length differences allow.  Meetings are verified by a banded
bit-parallel edit distance.

Pairs are not listed for their own sake: a line only needs one earlier match.
In every bucket it is first compared with the bucket's earliest members; only
lines that found no match are then compared with all earlier ones.  Where a
bucket is crowded (thousands of lines that begin alike), these lines are
compared under keys that take in pieces all over the line instead.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted
from tidemark.session import materialise, scope

EDITS = 2
MIN_CHARS = 20
#: The query and the pipeline take lines from these lengths on.  An equal line
#: needs no join, so every line with a word counts.  Below 8 code points two
#: edits turn words into other words ('Le.' into 'As.'), not into near copies.
EXACT_FROM = 1
NEAR_FROM = 8
CROWD = 64
SPREAD = 4
FILTER_LOG = 24
FILTER_BITS = 1 << FILTER_LOG
#: Groups of characters whose counts are compared before texts are.
GROUPS = ("ae", "io", "un", "rt", "sl", "hd", "cm ", "gbpfy", "0123456789", ".,;:-")
TRIM = "\x20\t\n\x0b\x0c\r"


# -- banded bit-parallel edit distance ------------------------------------------------
def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else more than
    ``edits`` (or null if the lengths differ by more).

    A band of 2 * edits + 1 diagonals lies in one machine word: bit t of
    column j is row j - edits + t.  The vertical differences are kept as two
    bit vectors; one addition carries along the column.  ``score`` follows the
    band's lowest row, and the last column's differences lead back from there
    to the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    flip = lambda x: x.bitwiseXOR(F.lit(full))
    both = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.char_length(a).alias("m"), F.char_length(b).alias("n"))

    def run(s: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            char = F.get(s["b"], j - 1)
            eq = F.lit(0).cast("bigint")
            for t in range(width):
                row = j - edits + t - 1
                eq = eq + F.when((row >= 0) & (F.get(s["a"], row) == char), F.lit(1 << t)).otherwise(F.lit(0)).cast("bigint")

            def tail(x: Column) -> Column:
                vp, vn, e = x["vp"], x["vn"], x["eq"]
                d0 = (e.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(full))
                return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), x["score"].alias("score"))

            def close(x: Column) -> Column:
                d0, vp, vn = x["d0"], x["vp"], x["vn"]
                hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                return F.struct(
                    hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                    (x["score"] + 1 - F.shiftright(d0, 2 * edits).bitwiseAND(F.lit(1))).alias("score"),
                )

            first = F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["score"].alias("score"), eq.alias("eq"))
            # arrays of one element stand for local variables: each is computed once
            moved = F.get(F.transform(F.transform(F.array(first), tail), close), F.lit(0))
            # no value in the band is less than score - 2 * edits
            return F.when(acc["score"] > 3 * edits, acc).otherwise(moved)

        start = F.struct(F.lit(full ^ ((1 << edits) - 1)).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(edits).cast("bigint").alias("score"))
        end = F.aggregate(F.sequence(F.lit(1), s["n"]), start, step)
        # rows m + 1 .. n + edits of the last column are bits m - n + edits .. 2 * edits - 1
        low = (s["m"] - s["n"] + edits).cast("int")
        rows = F.lit((1 << (2 * edits)) - 1).cast("bigint").bitwiseAND(F.lit(full) - F.call_function("shiftleft", F.lit(1).cast("bigint"), low) + 1)
        below = lambda x: F.bit_count(rows.bitwiseAND(x))
        return F.get(F.transform(F.array(end), lambda x: (x["score"] - below(x["vp"]) + below(x["vn"])).cast("int")), F.lit(0))

    close_enough = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    trivial = F.when(F.char_length(b) == 0, F.char_length(a)).when(F.char_length(a) == 0, F.char_length(b))
    return F.when(close_enough, F.coalesce(trivial, F.get(F.transform(F.array(both), run), F.lit(0))))


# -- segments and probes ----------------------------------------------------------
def places(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(d, i, x): for lines d characters shorter, segment i is looked for x
    places after its own place in the shorter line.

    With |x| <= i and |x - d| <= edits - i, the edits before and after the
    segment fit; other places need not be probed.  (0, i, 0) is the line's
    own entry.
    """
    return [(d, i, x) for d in range(edits + 1) for i in range(edits + 1) for x in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def segment_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """h, key, own of every line (h, line): index entries (own) and probes.

    A line of length t has segments of t div (edits + 1) characters; the last
    t mod (edits + 1) ones are one longer.  Places are exploded first, so one
    short expression is compiled for all of them.  Lines have edits + 1
    characters at least, so every place lies inside the line.
    """
    n = edits + 1
    table = F.array(*(F.struct(F.lit(d).alias("_d"), F.lit(i).alias("_i"), F.lit(x).alias("_x")) for d, i, x in places(edits)))
    # four bytes a code point: any place is found without counting characters
    each = let(lines.select("h", "line"), _n=F.char_length("line"), _u=F.encode("line", "UTF-32")).select("h", "_u", "_n", F.inline(table))
    t = "(_n - _d)"
    size = f"cast({t} div {n} as int)"
    longer = f"({n} - {t} % {n})"  # the first of the longer segments
    at = f"({size} * _i + greatest(0, _i - {longer}) + _x)"
    key = F.xxhash64("_i", F.expr(t), F.expr(f"substring(_u, 4 * {at} + 1, 4 * ({size} + if(_i >= {longer}, 1, 0)))"))
    return each.select("h", key.alias("key"), F.expr("_d = 0 AND _x = 0").alias("own"))


def spread_places(edits: int = EDITS) -> list[tuple[int, int, tuple[int, ...]]]:
    """(d, g, x): for lines d characters shorter, the places by which the
    chunks of group g are moved.

    A line is cut into SPREAD * (edits + 1) chunks, dealt in turn to
    edits + 1 groups.  Two lines within ``edits`` edits agree in all chunks of
    one group, moved by no more than the edits before, between and after them
    allow: the moves' steps, the last one up to d included, sum up to at most
    ``edits``."""
    moves = [x for x in itertools.product(range(-edits, edits + 1), repeat=SPREAD)]
    steps = lambda x, d: sum(abs(b - a) for a, b in itertools.pairwise((0, *x, d)))
    return [(d, g, x) for d in range(edits + 1) for x in moves if steps(x, d) <= edits for g in range(edits + 1)]


def spread_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """key, own and all columns but the line of every line, as
    ``segment_keys``, but a key is a whole group of chunks all over the line: lines that have a long passage in
    common and differ elsewhere share none.  Chunks are where a line of the
    shorter length has them; a move beyond a line's end shortens the chunk, and
    the key then only fails to match or is verified."""
    n = SPREAD * (edits + 1)
    table = F.array(*(F.struct(F.lit(d).alias("_d"), F.lit(g).alias("_g"), F.array(*map(F.lit, x)).alias("_x")) for d, g, x in spread_places(edits)))
    held = [c for c in lines.columns if c != "line"]
    each = let(lines, _n=F.char_length("line"), _u=F.encode("line", "UTF-32")).select(*held, "_u", "_n", F.inline(table))
    t = "(_n - _d)"
    start = lambda c: f"cast(({c}) * {t} div {n} as int)"
    chunk = []
    for k in range(SPREAD):
        low, high = start(f"_g + {k * (edits + 1)}"), start(f"_g + {k * (edits + 1)} + 1")
        at = f"greatest(0, {low} + _x[{k}])"
        chunk += [F.expr(f"substring(_u, 4 * {at} + 1, 4 * ({high} - {low}))")]
    key = F.xxhash64(F.lit(SPREAD), "_g", F.expr(t), *chunk)
    own = F.expr("_d = 0 AND forall(_x, x -> x = 0)")
    return each.select(*held, key.alias("key"), own.alias("own"))


# -- the job ------------------------------------------------------------------------
ROW = ("_d", "_t")


def second_hash(line: str) -> Column:
    """With ``h`` the 128 bits on which lines are told apart."""
    return F.xxhash64(F.lit(7), line)


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with its row's name: doc_id (null sorts first) and a hash of
    the text, so that rows that share a doc_id stay apart.  Rows equal in both
    are one row to all that follows."""
    return docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("_t", F.xxhash64(F.col("text").cast("string")))


def let(df: DataFrame, **named: Column) -> DataFrame:
    """``df`` with computed columns that later expressions refer to.  A plain
    projection would be merged into them, and its work repeated at each use; a
    generator of one row is not."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in named.items())))))


def lines_of(docs: DataFrame, shortest: int) -> DataFrame:
    """_d, _t, pos, line (trimmed), h of the lines that count: ``shortest``
    code points at least."""
    each = with_row(docs).select(*ROW, F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "_l"))
    lines = let(each, line=F.trim(F.col("_l"), F.lit(TRIM))).where(F.char_length("line") >= shortest)
    return let(lines, h=F.xxhash64("line")).select(*ROW, "pos", "line", "h")


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` (a hash) may be in ``wanted``: a bit table of
    FILTER_BITS bits, 64 to a row, drops most others before the join that
    decides.  Its size is bounded whatever the number of hashes."""
    word, bit = F.shiftrightunsigned(column, 64 - FILTER_LOG + 6), F.shiftrightunsigned(column, 64 - FILTER_LOG).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = wanted.groupBy(word.alias("_w")).agg(F.bit_or(one).alias("_bits"))
    joined = rows.join(F.broadcast(bits), word == F.col("_w"))  # at most FILTER_BITS / 64 rows of 16 bytes
    return joined.where(F.col("_bits").bitwiseAND(one) != 0).select(*rows.columns)


def verified(pairs: DataFrame, texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h, g) of later lines that are within ``edits`` edits of the earlier one
    of their pair (h, other)."""
    left = texts.select("h", "g", F.col("line").alias("_a"))
    right = texts.select(F.col("h").alias("other"), F.col("line").alias("_b"))
    joined = pairs.join(left, "h").join(right, "other")
    return joined.where(edit_distance(F.col("_a"), F.col("_b"), edits) <= edits).select("h", "g").distinct()


def char_counts(line: Column) -> dict[str, Column]:
    """How often some groups of characters occur in a line.  An edit changes
    the sum of all counts' differences by two at most."""
    size = F.char_length(line)
    return {f"_c{i}": size - F.char_length(F.translate(line, g, "")) for i, g in enumerate(GROUPS)}


def alike(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether character counts allow ``edits`` edits."""
    apart = F.lit(0)
    for i in range(len(GROUPS)):
        apart = apart + F.abs(F.col(f"{a}_c{i}") - F.col(f"{b}_c{i}"))
    return apart <= 2 * edits


def near_copies(lines: DataFrame, firsts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h, g) of distinct lines that have an earlier line within ``edits`` edits.

    lines: h, line of any number of copies; firsts: h, g, first (place of the
    first copy).  A line is h and g together; should two lines share h, the
    smaller one is compared and the other stays.  Keys are made twice: once to
    count, map-side, which buckets two lines share, and once to keep the rows
    of those buckets alone.  Pairs whose character counts differ too much are
    not formed.

    In every bucket all lines are first compared with its earliest members.
    Those without a match are compared with all earlier ones of the bucket if
    it has at most CROWD members; lines of larger ones are compared under
    their spread keys."""
    keyed = segment_keys(lines.select("h", "line"), edits)
    shared = keyed.groupBy("key").agg(F.max("own").alias("_any"), F.min("h").alias("_l"), F.max("h").alias("_u")).where("_any and _l < _u").select("key")
    shared = materialise(shared, "line-buckets")
    members = likely(keyed, shared, "key").groupBy("key", "h").agg(F.max("own").alias("own")).join(shared, "key")
    members = materialise(members, "line-shared")
    ids = materialise(members.select("h").distinct(), "line-ids")
    # an inner join, for Spark would move a semi join below the bit table
    texts = likely(lines, ids, "h").join(ids, "h").groupBy("h").agg(F.min("line").alias("line"))
    texts = materialise(texts.select("h", second_hash("line").alias("g"), "line"), "line-texts")
    place = likely(firsts.select("h", "g", "first"), ids, "h")
    facts = let(texts, **char_counts(F.col("line"))).drop("line").join(place, ["h", "g"]).drop("g")
    facts = materialise(facts, "line-facts")
    counts = [f"_c{i}" for i in range(len(GROUPS))]
    placed = materialise(members.join(facts, "h"), "line-members")
    # the earliest entry and the earliest member of every bucket
    each = F.struct("first", "h", *counts)
    hubs = placed.groupBy("key").agg(F.min(F.when(F.col("own"), each)).alias("_o"), F.min(each).alias("_p"), F.count(F.lit(1)).alias("_n"))
    facts_of = lambda side: (F.col(f"{side}.first").alias(f"{side}f"), F.col(f"{side}.h").alias(f"{side}h"), *(F.col(f"{side}.{c}").alias(f"{side}{c}") for c in counts))
    hubs = materialise(hubs.where("_o is not null").select("key", "_n", *facts_of("_o"), *facts_of("_p")), "line-hubs")
    at = placed.join(hubs, "key")
    by_entry = at.where((F.col("_of") < F.col("first")) & alike("", "_o", edits)).select("h", F.col("_oh").alias("other"))
    by_probe = at.where(F.col("own") & (F.col("_pf") < F.col("first")) & alike("", "_p", edits)).select("h", F.col("_ph").alias("other"))
    found = materialise(verified(by_entry.unionByName(by_probe).distinct(), texts, edits), "line-found")
    # lines without a match yet, against all earlier members of their buckets
    rest = placed.join(found, "h", "left_anti").join(hubs.select("key", "_oh", "_ph", "_n"), "key")
    rest = materialise(rest.where(F.col("h") != F.col("_ph")), "line-rest")
    others = (F.col("other") != F.col("_oh")) & (F.col("other") != F.col("_ph"))
    small = earlier_pairs(rest.where(F.col("_n") <= CROWD).drop("_n"), placed, others, edits)
    crowds = materialise(rest.where(F.col("_n") > CROWD).select("key").distinct(), "line-crowds")
    if crowds.isEmpty():
        pairs = small
    else:
        inside = placed.join(crowds, "key").select("h").distinct()
        open_ = rest.where(F.col("_n") > CROWD).select("h", F.lit(True).alias("open")).distinct()
        # facts are joined to lines, not to the keys that are made of them
        again = texts.select("h", "line").join(inside, "h").join(facts, "h").join(open_, "h", "left")
        again = materialise(spread_keys(again, edits), "line-spread")
        pairs = small.union(earlier_pairs(again.where("open"), again, F.lit(True), edits))
    return found.unionByName(verified(pairs.distinct(), texts, edits)).distinct()


def earlier_pairs(rest: DataFrame, members: DataFrame, also: Column, edits: int) -> DataFrame:
    """(h, other): lines of ``rest`` with all earlier members of their buckets
    that one of the two owns and that their character counts allow."""
    counts = [f"_c{i}" for i in range(len(GROUPS))]
    other = members.select(F.col("key").alias("_key"), F.col("h").alias("other"), F.col("first").alias("_f"), F.col("own").alias("_own"), *(F.col(c).alias(f"_x{c}") for c in counts))
    earlier = (F.col("key") == F.col("_key")) & (F.col("_f") < F.col("first")) & (F.col("own") | F.col("_own"))
    return rest.join(other, earlier & also & alike("", "_x", edits)).select("h", "other").distinct()


def decisions(docs: DataFrame, exact_from: int, near_from: int, edits: int = EDITS) -> DataFrame:
    """_d, _t, pos, exact of every line that goes: ``exact`` if an equal line
    came earlier, else a near one did.  Equal lines have ``exact_from`` code
    points at least, near ones ``near_from`` (not less than edits + 1)."""
    if near_from <= edits:
        raise ValueError("lines of near_from code points have a segment for each edit and one more")
    lines = lines_of(docs, exact_from)
    # equality is decided on 128 bits of hash
    known = materialise(lines.select("h", second_hash("line").alias("g"), *ROW, "pos"), "line-places")
    place = F.struct(*ROW, "pos")
    firsts = materialise(known.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("_last")), "line-firsts")
    near = materialise(near_copies(lines.where(F.char_length("line") >= near_from).select("h", "line"), firsts, edits), "line-near")
    repeated = materialise(firsts.where("first <> _last").select("h", "g", "first"), "line-repeated")
    exact = likely(known, repeated, "h").join(repeated, ["h", "g"]).where(place > F.col("first")).select(*ROW, "pos", F.lit(True).alias("exact"))
    fresh = likely(firsts, near, "h").join(near, ["h", "g"]).select("first.*", F.lit(False).alias("exact"))
    return exact.unionByName(fresh)


def marked(docs: DataFrame, exact_from: int, near_from: int, edits: int = EDITS) -> DataFrame:
    """_row (all columns of ``docs``), _text, _exact, _near: positions of the
    lines that go."""
    with scope(docs.sparkSession) as keep:
        at = lambda exact: F.sort_array(F.collect_set(F.when(F.col("exact") == exact, F.col("pos"))))
        per = decisions(docs.select("doc_id", "text"), exact_from, near_from, edits).groupBy(*ROW).agg(at(True).alias("_exact"), at(False).alias("_near"))
        per = keep(per, "line-drops")
    empty = F.array().cast("array<int>")
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    joined = with_row(held).join(per, list(ROW), "left")
    return joined.select("_row", F.col("text").alias("_text"), F.coalesce("_exact", empty).alias("_exact"), F.coalesce("_near", empty).alias("_near"))


def cleaned_text() -> Column:
    """The text without the lines in _exact and _near; null stays null.  What
    lies between two such lines is one slice, so a text is one pass however
    many lines it loses."""
    gone = F.array_sort(F.array_distinct(F.concat("_exact", "_near")))

    def between(lines: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines)))
        return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))

    kept = F.get(F.transform(F.array(F.split("_text", "\n")), between), F.lit(0))
    return F.when(F.size("_exact") + F.size("_near") > 0, F.array_join(kept, "\n")).otherwise(F.col("_text"))


def dedup_lines(docs: DataFrame, exact_from: int = MIN_CHARS, near_from: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """``docs`` with repeated lines taken out; rows that lose lines and have
    no word left go, all other rows stay.  ``edits`` may be up to 30 (the band
    is one machine word), but keys a line grow with about its cube, those of
    crowded lines with its fourth power.

    The first line by doc_id (null first), then text hash and place, stays;
    rows equal in doc_id and text are one row to the comparison and keep the
    same lines.  Null and empty texts stay as they are; texts and lines may be
    of any length.  Other columns stay as they are, whatever their names, but
    ``n_chars``, which is counted again."""
    done = let(marked(docs, exact_from, near_from, edits), _clean=cleaned_text())
    lost = F.size("_exact") + F.size("_near") > 0
    blank = F.trim(F.col("_clean"), F.lit(TRIM)) == ""
    out = done.where(~(lost & F.coalesce(blank, F.lit(True))))
    types, columns = dict(docs.dtypes), []
    for c in docs.columns:
        own = F.col(f"_row.{quoted(c)}")
        if c == "text":
            own = F.col("_clean")
        elif c == "n_chars":
            own = F.when(F.col("_clean").isNull(), own).otherwise(F.char_length("_clean").cast(types[c]))
        columns.append(own.alias(c))
    return out.select(*columns)


def report(docs: DataFrame, exact_from: int = MIN_CHARS, near_from: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, n_chars_kept, kept_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = marked(docs, exact_from, near_from, edits)
    text = F.coalesce(cleaned_text(), F.lit(""))
    return done.select(
        "_row.doc_id", F.coalesce(F.size(F.split("_text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"), F.size("_exact").cast("bigint").alias("n_exact"), F.size("_near").cast("bigint").alias("n_near"),
        F.char_length(text).cast("bigint").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
