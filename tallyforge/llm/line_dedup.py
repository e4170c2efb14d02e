"""Line dedup by a segment-partition edit join (operator 2), in DataFrame functions only.

Lines are normalised (white space squeezed and trimmed) and go by a 128-bit hash. Each distinct line is cut into
(threshold + 1) segments, of which one at least stands unchanged, at nearly the same place, in any line within the
threshold; segments are indexed by their text, number and the line's length. A line probes, for each length it can
reach, only the substrings at the places that the edits left and right of a segment allow.

A candidate pair must also share all but threshold of PIECES equal pieces, each within threshold places (an edit spoils
one piece at most): this drops most false pairs before the verification, which is an edit distance in which one integer
holds the band of a column and is updated by a few bit operations. It looks at the earliest candidate of each line
first, and at the others only of lines for which that one fails. A line is first compared with the earliest line of
each segment only, as copies of one text are mostly near that, and with the others if it was not found there.

Segments that more than HOT lines share are not joined line by line: their lines are gathered in blocks of at most about
HOT lines, blocks are paired, and lines not yet found are compared inside a pair of blocks, each up to the first earlier
line that is near it; a segment shared by n lines costs n * n / HOT**2 pairs of blocks.

A line is dropped if an equal line comes earlier, or if a line within the threshold first occurs earlier. Lines first
occur in order of doc_id (null last); of lines that first occur in the same document the smaller text comes earlier.

Lines of fewer than min_chars characters are dropped as equal only, and of fewer than equal_chars not at all; empty lines
are always kept. The registered op2_line_dedup drops equal lines of any length and near ones from 20 characters;
op2_all_lines drops near ones from the shortest that has threshold + 1 segments.

Defined cases: null and empty texts have no lines to drop; rows with the
same id each keep their first occurrence of a line; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, text_of, work_table

THRESHOLD, MIN_CHARS = 2, 20

#: Lines of one segment that are joined line by line, and about the lines of a block beyond that.
HOT = 64
PIECES = 8
#: Largest step in finding a common beginning or end.
TRIM = 1 << 13
#: A list of hashes of so many rows at most is broadcast (16 bytes each); a longer one is joined by a shuffle.
LOOKED_UP = 1_000_000


def normalised_lines(text: Column) -> Column:
    """All lines, white space squeezed and trimmed; patterns run only over texts that need them."""
    for c in ("\t", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(c), F.lit(" "))
    text = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.split(F.trim(text), "\n", -1)


def segment(line: Column, length: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of a line of the given length; the last segments are longer by one."""
    parts = threshold + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    size = base + F.when(longer > parts - 1 - i, 1).otherwise(0)
    return F.lit(i) * base + F.greatest(F.lit(0), longer - (parts - i)), size


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """How much shorter the other line is, the number of its segment, and how far that may lie off its place.

    For a line shorter by d, segment i may lie off its place by at most i (edits left of it) and, counted from the right,
    by at most threshold - i. With nothing shorter and no shift this is the line's own segment, its key in the index.
    """
    return [
        (d, i, off)
        for d in range(threshold + 1)
        for i in range(threshold + 1)
        for off in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1)
    ]


def with_tails(lines: DataFrame, threshold: int) -> DataFrame:
    """Adds for each segment but the first the rest of the line (tail<i>) from where any of its probes can begin (from<i>).

    Letters are found by counting from a string's beginning, so that probes of later segments read much less of a tail.
    """
    parts, n = threshold + 1, F.col("n")
    for i in range(1, parts):
        begin = F.greatest(F.lit(0), F.lit(i) * F.floor((n - threshold) / parts) - threshold).cast("int")
        lines = lines.withColumn(f"from{i}", begin)
    for i in range(1, parts):
        before, at = (F.col(f"tail{i - 1}"), F.col(f"from{i - 1}")) if i > 1 else (F.col("line"), F.lit(0))
        lines = lines.withColumn(f"tail{i}", F.substring(before, F.col(f"from{i}") - at + 1, n))
    return lines


def probe_keys(threshold: int) -> list[Column]:
    """Keys of the substrings that can be a segment of a line of at most this length within the threshold; over with_tails()."""
    keys, line, length = [], F.col("line"), F.col("n")
    for d, i, off in probes(threshold):
        other = length - d
        start, size = segment(line, other, i, threshold)
        tail, begin = (F.col(f"tail{i}"), F.col(f"from{i}")) if i else (line, F.lit(0))
        keys.append(F.xxhash64(F.substring(tail, start + (off + 1) - begin, size), F.lit(i), other))
    return keys


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings (lengths differing by at most the threshold) is at most the threshold.

    Bit k of a column's integers stands for row (column - threshold + k) of the distance matrix; the band moves down one
    row with each column. vp and vn say where the distance grows or shrinks by one from a row to the next, and the
    distance is followed along the diagonal that ends in the matrix's last cell. Letters that both strings share at their
    beginning and end are left out first, as they do not change the distance.
    """
    # bound as one element of an array, so that a step's result is named and computed once
    both = _bound(F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("most")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _shared(x, 0).alias("p")))
    both = _bound(both, lambda x: F.struct(F.substring(x["a"], x["p"] + 1, F.length(x["a"])).alias("a"), F.substring(x["b"], x["p"] + 1, F.length(x["b"])).alias("b")))
    both = _bound(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.least(F.length(x["a"]), F.length(x["b"])).alias("most")))
    both = _bound(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _shared(x, 1).alias("p")))
    both = _bound(both, lambda x: F.struct(F.substring(x["a"], F.lit(1), F.length(x["a"]) - x["p"]).alias("a"), F.substring(x["b"], F.lit(1), F.length(x["b"]) - x["p"]).alias("b")))
    letters = lambda x: F.struct(F.split(x["a"], "").alias("rows"), F.split(x["b"], "").alias("cols"), F.length(x["a"]).alias("m"), F.length(x["b"]).alias("n"))
    return _bound(_bound(both, letters), lambda x: F.when((x["m"] == 0) | (x["n"] == 0), x["m"] + x["n"] <= threshold).otherwise(_within(x["rows"], x["cols"], x["m"], x["n"], threshold)))


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shared(x: Column, end: int) -> Column:
    """How many letters two strings share at their beginning (end 0) or end (end 1), found by halving steps; below 2 * TRIM."""

    def step(done: Column, size: Column) -> Column:
        if end:
            same = F.substring(x["a"], F.length(x["a"]) - done - size + 1, size) == F.substring(x["b"], F.length(x["b"]) - done - size + 1, size)
        else:
            same = F.substring(x["a"], done + 1, size) == F.substring(x["b"], done + 1, size)
        return done + F.when((done + size <= x["most"]) & same, size).otherwise(0)

    sizes = [F.lit(1 << k) for k in range(TRIM.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*sizes), F.lit(0), step)


def _within(rows: Column, cols: Column, m: Column, n: Column, threshold: int) -> Column:
    """within() for letters: the band's lowest row is followed down its diagonal to the last row, then along that to the last column."""
    width = 2 * threshold + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    def step(acc: Column, j: Column) -> Column:
        letter = F.get(cols, j - 1)
        eq = F.lit(0).cast("long")
        for k in range(width):
            row = j - threshold + k
            eq = eq + F.when((row >= 1) & (F.get(rows, row - 1) == letter), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        return F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), eq.alias("x"), j.alias("j"))

    def move(acc: Column) -> Column:
        vp, vn, x, j = acc["vp"], acc["vn"], acc["x"], acc["j"]
        d0 = (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(full)
        hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(full)).bitwiseAND(full)
        hn = d0.bitwiseAND(vp)
        down = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
        bit = F.greatest(F.lit(0), F.lit(width - 1) - (j - (m - threshold)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
        along = F.when(hp.bitwiseAND(mask) != 0, 1).when(hn.bitwiseAND(mask) != 0, -1).otherwise(0)
        moved = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(moved.bitwiseOR(hp).bitwiseXOR(full)).bitwiseAND(full).alias("vp"),
            moved.bitwiseAND(hp).alias("vn"),
            (acc["d"] + F.when(j <= m - threshold, down).otherwise(along)).cast("int").alias("d"),
            F.lit(0).cast("long").alias("x"),
            j.alias("j"),
        )

    first = F.struct(
        F.lit(full & ~((1 << threshold) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
        F.least(m, F.lit(threshold)).cast("int").alias("d"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("int").alias("j"),
    )
    # the inner aggregate over one element names the step's result, so that it is computed once
    end = F.aggregate(
        F.sequence(F.lit(1), n), first, lambda acc, j: F.element_at(F.transform(F.array(step(acc, j)), lambda s: move(s)), 1)
    )
    return end["d"] <= threshold


def shares_pieces(a: Column, b: Column, threshold: int) -> Column:
    """Whether all but threshold of the PIECES pieces of a stand in b within threshold places: true for all pairs within the threshold."""
    size = F.floor(F.length(a) / PIECES).cast("int")
    found = []
    for i in range(PIECES):
        piece = F.substring(a, size * i + 1, size)
        around = F.substring(b, F.greatest(F.lit(1), size * i + (1 - threshold)), size + F.least(F.lit(2 * threshold), size * i + threshold))
        found.append(F.when(F.contains(around, piece), 1).otherwise(0))
    return (F.abs(F.length(a) - F.length(b)) <= threshold) & (reduce(Column.__add__, found) >= PIECES - threshold)


def looked_up(df: DataFrame) -> DataFrame:
    """A work table as a broadcast side, if its rows are few enough."""
    return F.broadcast(df) if df.count() <= LOOKED_UP else df


def occurrences(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> d1, d2 (hash of the row), doc_id, at, line, n (length), h, g (hash of the line), one row per non-empty line."""
    rows = docs.select("doc_id", text_of().alias("text"))
    lines = F.filter(F.transform(normalised_lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"), F.length(x).alias("n"))), lambda x: x["n"] > 0)
    rows = rows.select(F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("d2"), "doc_id", F.inline(lines))
    return rows.select("d1", "d2", "doc_id", "at", "line", "n", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(7)).alias("g"))


def before(first: Column, line: Column, first2: Column, line2: Column) -> Column:
    """Whether a line that first occurs in document first comes before another: nulls last, then the text."""
    return F.when(first.eqNullSafe(first2), line < line2).otherwise(F.coalesce(first2.isNull() | (first < first2), F.lit(False)))


def near_lines(docs: DataFrame, lines: DataFrame, keyed: DataFrame, threshold: int) -> DataFrame:
    """keyed (h, g, first, n, probe: a line's keys), a row for each distinct line -> a work table of h, g of lines within the threshold of one that comes earlier.

    Two rounds: of the earliest lines of the segments that a line probes, the pivots, it is first compared with the
    earliest; then the lines that were not found, and only they, with the other pivots and the other lines of segments
    that several lines have. docs gives the texts of candidates, and only theirs; lines (d1, h) says where they stand.
    """
    own = [i for i, (d, _, off) in enumerate(probes(threshold)) if d == 0 and off == 0]
    index = keyed.select("h", "first", F.explode(F.array(*[F.col("probe")[i] for i in own])).alias("key"))
    probe = keyed.select(F.col("h").alias("other"), F.explode("probe").alias("k"))
    pivots = index.groupBy("key").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "h")).alias("pivot"), F.count(F.lit(1)).alias("n_lines"))
    pivots = work_table(pivots.select("key", "pivot", F.col("pivot.h").alias("h"), "n_lines"), "lines_pivots")
    met = probe.join(pivots, (F.col("k") == F.col("key")) & (F.col("h") != F.col("other"))).select("other", "pivot")
    met = work_table(met.distinct(), "lines_met")
    first_pairs = met.groupBy("other").agg(F.min("pivot").alias("pivot")).select(F.col("other").alias("a"), F.col("pivot.h").alias("b"))
    first_pairs = work_table(first_pairs, "lines_pairs")
    shared = work_table(pivots.filter("n_lines > 1").select(F.col("key").alias("shared"), "n_lines"), "lines_shared")
    keys = index.select(F.col("h").alias("other"), F.col("key").alias("k"), F.lit(True).alias("indexed")).unionByName(probe.withColumn("indexed", F.lit(False)))
    keys = work_table(keys.join(looked_up(shared), F.col("k") == F.col("shared")).drop("shared"), "lines_keys")

    wanted = met.select(F.explode(F.array("other", "pivot.h")).alias("w")).unionByName(keys.select(F.col("other").alias("w")))
    wanted = work_table(wanted.distinct(), "lines_wanted")
    holders = work_table(lines.join(looked_up(wanted), F.col("h") == F.col("w"), "left_semi").select(F.col("d1").alias("holder")).distinct(), "lines_holders")
    docs = docs.join(looked_up(holders), F.xxhash64("doc_id", text_of()) == F.col("holder"), "left_semi")
    texts = occurrences(docs).select("h", "g", "line").join(looked_up(wanted), F.col("h") == F.col("w"), "left_semi")
    texts = texts.groupBy("h", "g").agg(F.first("line").alias("line")).join(keyed.select("h", "g", "first"), ["h", "g"])
    texts = work_table(texts, "lines_texts")

    found = _verified(_candidates(first_pairs, texts, threshold), threshold)
    marked = found.withColumn("open", F.lit(False))
    texts2 = work_table(texts.join(marked, ["h", "g"], "left").fillna(True, ["open"]), "lines_texts")
    open_ = texts2.filter("open").select(F.col("h").alias("still")).distinct()
    few = keys.filter(F.col("n_lines") <= HOT)
    left, right = few.filter("indexed").select(F.col("other").alias("x"), "k"), few.filter("not indexed").select(F.col("other").alias("y"), "k")
    open_left, open_right = (side.join(open_, F.col(name) == F.col("still"), "left_semi") for side, name in ((left, "x"), (right, "y")))
    pairs = open_left.join(right, "k").unionByName(left.join(open_right, "k").select("k", "x", "y")).select("x", "y")
    pairs = pairs.unionByName(met.join(open_, F.col("other") == F.col("still"), "left_semi").select(F.col("other").alias("x"), F.col("pivot.h").alias("y")))
    pairs = pairs.unionByName(met.join(open_, F.col("pivot.h") == F.col("still"), "left_semi").select(F.col("other").alias("x"), F.col("pivot.h").alias("y")))
    pairs = pairs.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = work_table(pairs, "lines_pairs")
    rest = _candidates(pairs, texts, threshold).join(found.select(F.col("h").alias("fh"), F.col("g").alias("fg")), (F.col("late.h") == F.col("fh")) & (F.col("late.g") == F.col("fg")), "left_anti")
    in_blocks = near_in_blocks(keys.filter(F.col("n_lines") > HOT), texts2, threshold)
    out = work_table(found.unionByName(_verified(rest, threshold)).unionByName(in_blocks).distinct(), "lines_near")
    discard(pairs, texts2)
    discard(pivots, met, first_pairs, shared, keys, wanted, holders, texts, found)
    return out


def _candidates(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of lines (a, b) -> (late: h, g, line; early: first, line) of those that share enough pieces."""

    def side(names: str) -> DataFrame:
        return texts.select(*[F.col(c).alias(n) for c, n in zip(("h", "g", "first", "line"), names.split(), strict=True)])

    both = pairs.join(side("a ag a_first a_line"), "a").join(side("b bg b_first b_line"), "b").filter(shares_pieces(F.col("a_line"), F.col("b_line"), threshold))
    a_first = before(F.col("a_first"), F.col("a_line"), F.col("b_first"), F.col("b_line"))
    early = F.when(a_first, F.struct(F.col("a_first").alias("first"), F.col("a_line").alias("line"))).otherwise(F.struct(F.col("b_first").alias("first"), F.col("b_line").alias("line")))
    late = F.when(a_first, F.struct(F.col("b").alias("h"), F.col("bg").alias("g"), F.col("b_line").alias("line"))).otherwise(
        F.struct(F.col("a").alias("h"), F.col("ag").alias("g"), F.col("a_line").alias("line"))
    )
    return both.select(late.alias("late"), early.alias("early"))


def _verified(candidates: DataFrame, threshold: int) -> DataFrame:
    """The h, g of the late lines that are within the threshold of an early one; the earliest of each is tried first."""
    candidates = candidates.select("late.h", "late.g", F.col("late.line").alias("line"), F.struct(F.col("early.first").isNull().alias("none"), "early.first", "early.line").alias("early"))
    candidates = work_table(candidates, "lines_candidates")
    tried = candidates.groupBy("h", "g").agg(F.min("early").alias("early"), F.first("line").alias("line"))
    tried = work_table(tried.select("h", "g", F.col("early.line").alias("early"), within(F.col("early.line"), F.col("line"), threshold).alias("near")), "lines_tried")
    left = candidates.join(tried.filter("not near").select("h", "g", F.col("early").alias("done")), ["h", "g"]).filter("early.line != done")
    left = left.select("h", "g", "line", F.col("early.line").alias("early")).distinct().filter(within(F.col("early"), F.col("line"), threshold))
    found = work_table(tried.filter("near").select("h", "g").unionByName(left.select("h", "g").distinct()), "lines_found")
    discard(candidates, tried)
    return found


def near_in_blocks(keys: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The h, g of lines within the threshold of an earlier one with which they share a hot segment, compared block by block."""
    sized = keys.withColumn("block", F.pmod(F.xxhash64("other", F.lit(3)), F.ceil(F.col("n_lines") / HOT)))
    sized = sized.join(texts, F.col("other") == F.col("h")).withColumn("own", F.struct("first", "line", "h", "g", "open"))
    blocks = sized.groupBy("k", "block", "indexed").agg(F.collect_list("own").alias("own"))
    pairs = blocks.filter("indexed").select("k", F.col("block").alias("block1"), F.col("own").alias("left")).join(
        blocks.filter("not indexed").select("k", F.col("block").alias("block2"), F.col("own").alias("right")), "k"
    )

    # a pair shares its segment in one direction only (the shorter line is the indexed one), so both orders of age are looked at
    def is_near(y: Column, x: Column) -> Column:
        return before(x["first"], x["line"], y["first"], y["line"]) & shares_pieces(x["line"], y["line"], threshold) & within(x["line"], y["line"], threshold)

    def found(mine: str, others: str) -> DataFrame:
        near = F.filter(mine, lambda y: y["open"] & F.exists(others, lambda x: is_near(y, x)))
        return pairs.select(F.explode(near).alias("c")).select("c.h", "c.g")

    return found("right", "left").unionByName(found("left", "right")).distinct()


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, equal_chars: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, n_lines, equal_lines, near_lines: one row for each row of docs.

    text is what is left of the text as it was, without the dropped lines; equal_lines and near_lines are the numbers
    (from 1) of the lines dropped as equal, as near; n_lines counts the lines before.
    """
    shortest = max(threshold + 1, min_chars)
    lines = with_tails(occurrences(docs).filter(F.col("n") >= min(shortest, max(1, equal_chars))), threshold)
    lines = work_table(lines.select("d1", "d2", "doc_id", "at", "h", "g", "n", F.array(*probe_keys(threshold)).alias("probe")), "lines_all")
    each = [F.first(F.col("probe")[i], ignorenulls=True).alias(f"p{i}") for i in range(len(probes(threshold)))]
    distinct = lines.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"), *each)
    distinct = work_table(distinct.select("h", "g", "first", "n", "times", F.array(*[f"p{i}" for i in range(len(each))]).alias("probe")), "lines_distinct")
    bare = work_table(lines.select("d1", "d2", "doc_id", "at", "h", "g"), "lines_bare")
    discard(lines)
    lines = bare
    near = near_lines(docs, lines, distinct.filter(F.col("n") >= shortest), threshold)

    # only lines that occur again, or are near an earlier one, can be dropped
    marked = distinct.filter((F.col("times") > 1) & (F.col("n") >= equal_chars)).select("h", "g", "first", F.lit(False).alias("near"))
    marked = marked.join(near, ["h", "g"], "left_anti").unionByName(near.select("h", "g", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("first"), F.lit(True).alias("near")))
    marked = work_table(marked, "lines_marked")
    where = lines.join(looked_up(marked), ["h", "g"])
    # rows equal in id and text have the same hash and lose the same lines; their line numbers count once
    where = where.groupBy("d1", "d2", "doc_id", "h", "g", "first", "near").agg(F.sort_array(F.collect_set("at")).alias("at"))
    nothing = F.array().cast("array<int>")
    again = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.slice("at", F.lit(2), F.size("at"))).otherwise(F.col("at"))
    where = where.select("d1", "d2", F.when(F.col("near"), nothing).otherwise(again).alias("equal"), F.when(F.col("near"), F.col("at")).otherwise(nothing).alias("close"))
    dropped = where.filter((F.size("equal") > 0) | (F.size("close") > 0)).groupBy("d1", "d2").agg(
        F.sort_array(F.flatten(F.collect_list("equal"))).alias("equal_lines"), F.sort_array(F.flatten(F.collect_list("close"))).alias("near_lines")
    )
    dropped = work_table(dropped, "lines_dropped")
    discard(lines, distinct, near, marked)
    rows = docs.select("doc_id", text_of().alias("text")).withColumns({"d1": F.xxhash64("doc_id", "text"), "d2": F.xxhash64(F.lit(1), "text", "doc_id")})
    raw = F.split("text", "\n", -1)
    rows = rows.withColumn("n_lines", (F.size(raw) - F.when(F.col("text") == "", 1).otherwise(0)).cast("long"))
    out = rows.join(looked_up(dropped), ["d1", "d2"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("equal_lines", "near_lines")})
    gone = F.concat("equal_lines", "near_lines")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(raw)), gone), lambda i: F.element_at(raw, i)), "\n")
    return out.select("doc_id", F.when(F.size(gone) > 0, left).otherwise(F.col("text")).alias("text"), "n_lines", "equal_lines", "near_lines")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, equal_chars: int = 1) -> DataFrame:
    """The digest of deduplicated(): doc_id, n_lines, n_equal and n_near (lines dropped as equal, as near)."""
    out = deduplicated(docs, threshold, min_chars, equal_chars)
    return out.select("doc_id", "n_lines", F.size("equal_lines").cast("long").alias("n_equal"), F.size("near_lines").cast("long").alias("n_near"))
