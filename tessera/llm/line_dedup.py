"""Line dedup by a segment-partition edit join (native DataFrame operators only).

Texts are split at line feeds.  Equal lines are one node from the start: a line is hashed where
it is read, and nodes, not texts, are shuffled.  Two different lines are linked when their edit
distance is at most what the shorter one allows: ``TAU`` edits from ``LONG_CHARS`` characters
on, one edit from ``SHORT_CHARS`` on (two edits would make most short lines alike), none below.
A line of length l that allows t edits is cut into t + 1 even segments; a line within t edits
holds at least one of them unchanged, near its place, so each line probes, for every length
it could be linked with, only the substrings that can be such a segment.  What meets, and
agrees in its letter counts (tested within the join, so that a group of near copies does not
come out as all its pairs), is verified by a banded bit-parallel edit distance: one bit for
each diagonal of the band and one word for each number of edits.  The classes are the links'
connected components.

A line's id is the 64-bit hash of its text: among n different lines n^2 / 2^65 pairs can be
expected to share one (0.03 in a thousand million), and would count as copies.

Defined results: null texts have no lines, empty texts one empty line; lines that allow no
edits are linked to equal lines only; repeated rows of a doc_id have lines of their own; a
null doc_id is carried, and owns a line only if no other does; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, durable

TAU = 2
LONG_CHARS, SHORT_CHARS = 20, 8
COUNTED = "acdehilnorst"
#: Bits of the packed letter counts that mark a line of fewer than LONG_CHARS characters, and a probe of its own length.
SHORT_BIT = 3 * len(COUNTED)
SAME_BIT = SHORT_BIT + 1
BROADCAST_PAIRS = 1_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, line)."""
    return docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def probe_places(tau: int) -> list[tuple[int, int, int]]:
    """(less, i, shift) of the substrings that may be segment i of a line ``less`` characters shorter."""
    return [
        (less, i, shift)
        for less in range(tau + 1)
        for i in range(tau + 1)
        for shift in range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)
    ]


#: All places; those of one edit are among those of more.
PLACES = probe_places(TAU)
#: The places of a line's own segments, by which it is found.
OWN = [PLACES.index((0, i, 0)) for i in range(TAU + 1)]


def place_key(less: int, i: int, shift: int) -> str:
    """SQL of the key of segment i of a line ``less`` characters shorter, ``shift`` characters from its place.

    Of k even segments the last ones are longer.  NULL if no line of that length has this place.
    """
    n = f"(chars - {less})"

    def key(tau: int) -> str:
        k = tau + 1
        begin = f"{i} * ({n} div {k}) + greatest(0, {i - k} + {n} % {k}) + {1 + shift}"
        size = f"{n} div {k} + if({i - k} + {n} % {k} >= 0, 1, 0)"
        return f"xxhash64({n}, {i}, substring(line, cast({begin} as int), cast({size} as int)))"

    short = f"when {n} >= {SHORT_CHARS} then {key(1)}" if (less, i, shift) in probe_places(1) else ""
    return f"case when {n} >= {LONG_CHARS} then {key(TAU)} {short} end"


def edits_within(a: str, b: str, tau: int) -> Column:
    """Whether the string columns ``a`` and ``b`` are at most tau edits apart.

    Banded bit-parallel recurrence: after i characters of a, bit d + tau of word e says that
    a's first i and b's first i + d characters are at most e edits apart.  A step keeps what
    matches on its diagonal and adds, from the word below, a substitution (same bit), a
    deletion (bit to the right) and an insertion (new word below, bit to the left).  Once the
    last word is empty, nothing can revive and the steps are skipped.
    """
    full = (1 << (2 * tau + 1)) - 1
    same = " | ".join(f"if(p.a[i - 1] = get(p.b, i - 1 + {d}), {1 << (d + tau)}, 0)" for d in range(-tau, tau + 1))
    words = ["(s.w0 & x)"]
    for e in range(1, tau + 1):
        words.append(f"((s.w{e} & x) | s.w{e - 1} | shiftright(s.w{e - 1}, 1) | (shiftleft({words[-1]}, 1) & {full}))")
    start = ", ".join(f"'w{e}', {sum(1 << (d + tau) for d in range(e + 1))}" for e in range(tau + 1))
    step = ", ".join(f"'w{e}', {w}" for e, w in enumerate(words))
    gap = "(size(p.b) - size(p.a))"
    chars = "if({0} = '', cast(array() as array<string>), split({0}, ''))"
    # The one-element array binds the characters once; a plain column would be split anew at each step.
    return F.expr(f"""
    transform(array(named_struct('a', {chars.format(a)}, 'b', {chars.format(b)})), p ->
    case when abs({gap}) > {tau} then false
         when size(p.a) = 0 then true
         else aggregate(
           sequence(1, size(p.a)), named_struct({start}),
           (s, i) -> if(s.w{tau} = 0, s, transform(array({same}), x -> named_struct({step}))[0]),
           s -> (shiftright(s.w{tau}, {gap} + {tau}) & 1) = 1) end)[0]""")


def letter_counts() -> Column:
    """Counts of twelve frequent letters, modulo 8, packed into a long; above them SHORT_BIT."""
    size = F.octet_length("line")
    packed = F.when(F.col("chars") < LONG_CHARS, F.lit(1 << SHORT_BIT)).otherwise(F.lit(0).cast("long"))
    for i, letter in enumerate(COUNTED):
        n = (size - F.octet_length(F.replace(F.col("line"), F.lit(letter), F.lit("")))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(7)), 3 * i))
    return packed


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the differences of the packed counts; an edit changes it by two at most."""
    total = F.lit(0)
    for i in range(len(COUNTED)):
        gap = F.pmod(F.shiftrightunsigned(a, 3 * i).bitwiseAND(F.lit(7)) - F.shiftrightunsigned(b, 3 * i).bitwiseAND(F.lit(7)), F.lit(8))
        total = total + F.least(gap, 8 - gap)
    return total


def allowed_edits(chars: Column) -> Column:
    """Edits that a line of so many characters allows."""
    return F.when(chars >= LONG_CHARS, TAU).when(chars >= SHORT_CHARS, 1).otherwise(0)


def line_id() -> Column:
    return F.xxhash64("line")


def line_keys(docs: DataFrame) -> DataFrame:
    """Rows (node, counts, k0, k1, ...): each different line once, with the keys of all its places."""
    lines = lines_of(docs).select("line", F.length("line").alias("chars")).filter(F.col("chars") >= SHORT_CHARS)
    told = lines.select("line", "chars", F.inline(F.array(F.struct(line_id().alias("node"), letter_counts().alias("counts")))))
    # One inline each: the JVM compiles only methods of limited size, and an operator is one method.
    named = [F.expr(place_key(*p)).alias(f"k{j}") for j, p in enumerate(PLACES)]
    for some in (named[:4], named[4:8], named[8:]):
        told = told.select("*", F.inline(F.array(F.struct(*some))))
    keyed = told.drop("line", "chars")
    # What is computed from equal lines is equal; minima of longs are combined before the shuffle.
    return keyed.groupBy("node").agg(*[F.min(c).alias(c) for c in keyed.columns if c != "node"])


def candidates(docs: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids of different lines that share a segment where it could be."""
    keyed = line_keys(docs)
    # Both sides explode the same array, so that the lines are read, keyed and shuffled once.
    places = [F.struct(F.col(f"k{j}").alias("key"), F.lit(j in OWN).alias("own"), F.lit(0 if less else 1 << SAME_BIT).cast("long").alias("same")) for j, (less, _, _) in enumerate(PLACES)]
    each = keyed.select("node", "counts", F.explode(F.array(*places)).alias("p")).filter("p.key is not null")
    stored = each.filter("p.own").select(F.col("p.key").alias("key"), F.col("node").alias("a"), F.col("counts").alias("na"))
    probes = each.select(F.col("p.key").alias("pkey"), F.col("node").alias("b"), F.col("counts").bitwiseOR(F.col("p.same")).alias("nb"))
    bit = lambda c, at: F.shiftrightunsigned(c, at).bitwiseAND(F.lit(1)) == 1
    most = F.when(bit("na", SHORT_BIT), 2).otherwise(2 * TAU)
    # Two lines of one length probe each other: one of the two finds is enough.
    once = F.when(bit("nb", SAME_BIT), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    met = probes.join(stored, (F.col("pkey") == F.col("key")) & once & (counts_apart(F.col("na"), F.col("nb")) <= most))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of different lines that are at most the allowed edits apart."""
    pairs = durable(candidates(docs))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if pairs.count() <= BROADCAST_PAIRS:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    text = lines_of(docs).select(line_id().alias("node"), "line").join(wanted, "node", "left_semi").distinct()
    text = durable(text)
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("line").alias("la")), "a")
    both = both.join(text.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
    edits = allowed_edits(F.least(F.length("la"), F.length("lb")))
    near = reduce(lambda out, t: F.when(edits == t, edits_within("la", "lb", t)).otherwise(out), range(1, TAU + 1), F.lit(False))
    return both.filter(near).select("a", "b")


def line_classes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, class_id, class_doc, n_links, n_copies, keep), one for each line.

    ``class_id`` is the smallest 64-bit id of the class's lines, ``class_doc`` the smallest
    doc_id with one of them, ``n_links`` the different lines linked to this one, ``n_copies``
    the rows with this line; ``keep`` marks the class's first line in class_doc.  Only lines
    with copies or links are looked up; each of the others is its own class.
    """
    edges = durable(links(docs))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = degree.join(components(edges), "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("root"))
    rows = lines_of(docs).select("doc_id", "line_no", line_id().alias("node"))
    # doc_id and line_no as one number, whose minimum needs no sort; without a doc_id the smallest line_no.
    wide = F.lit(1 << 31).cast("decimal(20,0)")
    place = F.col("doc_id").cast("decimal(20,0)") * wide + F.col("line_no")
    info = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min(place.cast("decimal(38,0)")).alias("place"), F.min("line_no").alias("low"))
    info = info.join(linked, "node", "left").filter("copies > 1 or n_links is not null")
    info = durable(info.select("node", "copies", "place", "low", F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    first = durable(info.groupBy("class_id").agg(F.min("place").alias("place"), F.min("low").alias("low")))
    info = info.select("node", "copies", "class_id", "n_links").join(first, "class_id")
    inside = F.pmod("place", wide)
    owner = info.select(
        "node", "copies", "class_id", "n_links", ((F.col("place") - inside).cast("decimal(38,0)") / wide).cast("long").alias("class_doc"),
        F.coalesce(inside.cast("int"), F.col("low")).alias("first_line"), F.lit(True).alias("known"))
    seen = rows.join(owner, "node", "left")
    known = F.coalesce("known", F.lit(False))
    keep = ~known | (F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("first_line")))
    return seen.select(
        "doc_id", F.col("line_no").cast("int").alias("line_no"), F.coalesce("class_id", "node").alias("class_id"),
        F.when(known, F.col("class_doc")).otherwise(F.col("doc_id")).alias("class_doc"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), keep.alias("keep"))
