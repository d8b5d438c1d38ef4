"""Line deduplication with an edit-distance join, in DataFrame functions only.

Exact repeats meet by hash. Near repeats are found by segments (Li et al., "Pass-Join: A Partition-based Method for
Similarity Joins", 2011): of the ``edits`` + 1 segments of a line one stays untouched by ``edits`` edits, so probes
with the substrings that length and shift admit meet every pair. Most lines share no segment with another one and leave
first; the others meet where their letter counts allow it. Candidates are verified by Hyyroe's banded
bit-parallel edit distance (2003).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hash128, quoted, sized, stored, table, text_key

EDITS = 2
#: Characters from which lines are compared for edits; shorter ones only match exactly.
LEAST_NEAR = 24
#: Distinct lines that may share a segment before its pairs must share a segment of what is left of them, too.
HOT_LINES = 32
#: Letters whose counts tell lines apart that share a segment, 12 to a number.
LETTERS = "etaonirshdlucmfwygpbvk ."


def _base(n: Column, edits: int) -> Column:
    """Smallest length of the lengths that are cut like ``n``: 4 of them (2 for one edit, 8 for more) below 64, else 16."""
    return n - F.when(n < 64, n % (2 if edits == 1 else 4 if edits <= 4 else 8)).otherwise(n % 16)


def _segment(n: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """1-based start and size of segment ``i`` (1-based) of lines of ``n`` characters; the last ones are longer."""
    parts = edits + 1
    base, extra = F.floor(n / parts).cast("int"), n % parts
    return base * (i - 1) + F.greatest(F.lit(0), i - 1 - parts + extra) + 1, base + F.when(i > parts - extra, 1).otherwise(0)


def _choices(edits: int, probe: bool, lower: int) -> list[Column]:
    """Segments and shifts that one line has keys for. Of ``edits`` + 1 segments some i-th is untouched with at most i - 1
    edits before it and as many as there are segments after it behind it, so the former half is counted from the start
    of the line and the latter from its end: how much longer the probe is then makes no difference to the place."""
    chosen = []
    for i in range(1, edits + 2):
        left, right = i - 1, edits + 1 - i
        near, far = (right, left) if left > right else (left, right)
        # the longer line is the probe: counted from the start it may be ahead by more than it may be behind
        low, high = (-near, min(near, far + edits)) if left <= right else (max(-near, -far - edits), near)
        chosen += [F.struct(F.lit(lower).alias("lower"), F.lit(i).alias("i"), F.lit(left > right).alias("behind"), F.lit(shift).alias("shift")) for shift in (range(low, high + 1) if probe else (0,))]
    return chosen


def _keyed(lines: DataFrame, edits: int, name: str, probe: bool, whole: bool = False) -> DataFrame:
    """(hash as ``name``, key) of every segment of every line, or of every substring that can equal a segment of a line
    at most ``edits`` shorter (multi-match-aware).

    Lines of nearly equal lengths are cut alike (``_base``), with what is over left out between the segments that are
    counted from the start and from the end, so a probe needs more keys only where shorter lines are cut otherwise. Each
    row takes one choice of segment and shift from a literal table, which keeps the generated code small enough to be
    compiled. ``lines`` has h1, line and size; where it has a ``profile``, that and ``size`` come along. With ``whole``, so
    does what a line has besides the segment, as ``rest``, and whether this is a segment of the line itself, as ``own``.
    """
    own, lower = _base(F.col("size"), edits), _base(F.col("size") - edits, edits)
    chosen = F.array(*_choices(edits, probe, 0))
    if probe:
        chosen = F.when(own == lower, chosen).otherwise(F.array(*_choices(edits, probe, 0), *_choices(edits, probe, 1)))
    seen = ["size", "profile"] if "profile" in lines.columns else []
    held = ["line", *(seen or ["size"])]
    each = lines.select(F.col("h1").alias(name), *held, F.explode(chosen).alias("c"))
    each = each.withColumn("n", F.when(F.col("c.lower") == 1, lower).otherwise(own))
    start, long = _segment(F.col("n"), F.col("c.i"), edits)
    start = start + F.col("c.shift") + F.when(F.col("c.behind"), F.col("size") - F.col("n")).otherwise(0)
    placed = each.select(name, *held, "n", F.col("c.i").alias("i"), start.alias("start"), long.alias("long"), F.expr("c.lower = 0 AND c.shift = 0").alias("own"))
    rest = F.concat(F.col("line").substr(F.lit(1), F.col("start") - 1), F.col("line").substr(F.col("start") + F.col("long"), F.col("size")))
    return placed.where("start >= 1 AND start + long - 1 <= size").select(
        name, F.xxhash64("n", "i", F.col("line").substr(F.col("start"), F.col("long"))).alias("key"), *[rest.alias("rest"), "own"] * whole, *(F.col(c).alias(f"{c}_{name}") for c in seen)
    )


def _sharing(lines: DataFrame, edits: int) -> DataFrame:
    """The lines that share a key with another one, with their letter counts. All later steps are over these alone.

    Each probe asks whether there is another line, so no pair is made here, however many lines share a key.
    """
    index = _keyed(lines, edits, "b", False)
    asking = stored(_keyed(lines, edits, "a", True).join(index.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("a") != F.col("b")), "left_semi"))
    asked = index.join(sized(asking.select("key").distinct()), "key", "left_semi")
    needed = sized(asking.select(F.col("a").alias("h1")).unionAll(asked.select("b")).distinct())
    return stored(lines.join(needed, "h1", "left_semi").withColumn("profile", profile(F.col("line"))))


def _met(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs of hashes of lines that share a key and whose lengths and letter counts allow it, each once.

    A segment that more than ``HOT_LINES`` lines share would make a candidate of any two of them. If they are within
    the edits around it, so is what is left of them without it, by which such lines meet (``_near``), so that boilerplate
    makes no pairs by itself.
    """
    if "profile" not in lines.columns:
        lines = lines.withColumn("profile", profile(F.col("line")))
    keyed = _keyed(lines, edits, "b", False)
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_LINES).select("key"))
    none = hot.isEmpty()
    met = _allowed(_keyed(lines, edits, "a", True).join(keyed if none else keyed.join(hot, "key", "left_anti"), "key"), edits)
    each = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if none:
        return each(met)
    shared = _keyed(lines, edits, "h1", True, True).join(hot, "key", "left_semi")
    rests = shared.select("h1", F.col("key").alias("under"), F.col("rest").alias("line"), F.length("rest").alias("size"), F.col("profile_h1").alias("profile"), "own")
    return each(met.unionAll(_near(rests, edits)))


def _allowed(met: DataFrame, edits: int, less: int = 0) -> DataFrame:
    """(a, b) of which the probe a is at most ``edits`` longer or ``less`` shorter, with letter counts alike."""
    more = F.col("size_a") - F.col("size_b")
    return met.where("a <> b").where(more.between(-less, edits) & _profiles_agree(F.col("profile_a"), F.col("profile_b"), 2 * edits - F.abs(more))).select("a", "b")


def _near(rows: DataFrame, edits: int, less: int = 0) -> DataFrame:
    """(a, b) of probes and what they look for, if their strings under one key may be within ``edits`` edits and the probe
    is at most ``less`` shorter; none that are is missed.

    ``rows`` has h1, under, line, size, profile and ``own``, which marks the rows that probes look for; all rows are
    probes. Where more than ``HOT_LINES`` such are under a key, its lines are halved: two of them agree in their first half
    and meet by the rest under its key, or in their last half, or have edits in both, so fewer than ``edits`` in each
    (``_on_both_sides``). A line that has its edits in one place stays on one way down, so what there is at a level does
    not grow with the depth. Strings of less than a class of lengths (``_base``) are not halved: they all meet.
    """
    small, opened, rows = None, None, rows.withColumn("whole", F.lit(False))
    while True:
        rows = stored(rows)
        asked = F.when(F.col("own"), F.col("size"))
        groups = rows.groupBy("under").agg(F.count_if("own").alias("there"), F.min(asked).alias("least"), F.max(asked).alias("most"), (F.min("h1") < F.max("h1")).alias("several"))
        rows = stored(rows.join(groups.where("several AND there > 0").drop("several"), "under"))
        meet = F.col("whole") | (F.col("there") <= HOT_LINES)
        ended, hot = rows.where(meet), rows.where(~meet)
        small = ended if small is None else small.unionByName(ended)
        if hot.isEmpty():
            break
        opened = hot if opened is None else opened.unionByName(hot)
        rows = _halved(hot, edits, less)
    side = lambda held, h: held.select("under", F.col("h1").alias(h), F.col("size").alias(f"size_{h}"), F.col("profile").alias(f"profile_{h}"))
    pairs = _allowed(side(small, "a").join(side(small.where("own"), "b"), "under"), edits, less)
    return stored((pairs if opened is None or edits == 1 else pairs.unionAll(_on_both_sides(opened, edits, less))).distinct())


def _cut_like(rows: DataFrame, edits: int, less: int, choices: list[dict]) -> DataFrame:
    """Every row with each of the choices ``c``, cut like the lines that it may be near to, as far as lines of such lengths
    are asked for under its key; ``n`` is the length whose cuts it takes, and ``own`` stays where that is its own."""
    own = _base(F.col("size"), edits)
    lengths = F.array_distinct(F.array(own, *(_base(F.col("size") + more, edits) for more in (-edits, less))))
    there = F.filter(lengths, lambda n: n.between(_base(F.col("least"), edits), _base(F.col("most"), edits)))
    made = lambda n: F.array(*(F.struct(n.alias("n"), *(F.lit(v).alias(k) for k, v in c.items())) for c in choices))
    each = rows.withColumn("c", F.explode(F.flatten(F.transform(there, made))))
    return each.withColumn("n", F.col("c.n")).withColumn("own", F.col("own") & (F.col("n") == own))


def _halved(rows: DataFrame, edits: int, less: int) -> DataFrame:
    """What lines have besides their first and their last half, each under its key."""
    each = _cut_like(rows, edits, less, [{"tail": False}, {"tail": True}]).where("n > 0 OR NOT c.tail").withColumn("long", F.floor(F.col("n") / 2).cast("int")).where("long <= size")
    tail, line, left = F.col("c.tail"), F.col("line"), (F.col("size") - F.col("long")).cast("int")
    half = F.when(tail, line.substr(left + 1, F.col("long"))).otherwise(line.substr(F.lit(1), F.col("long")))
    rest = F.when(tail, line.substr(F.lit(1), left)).otherwise(line.substr(F.col("long") + 1, left))
    return each.select("h1", F.xxhash64("under", "n", tail, half).alias("under"), rest.alias("line"), left.alias("size"), "profile", "own", (F.col("n") == 0).alias("whole"))


def _on_both_sides(rows: DataFrame, edits: int, less: int) -> DataFrame:
    """(a, b) of ``rows`` under one key that have fewer than ``edits`` edits before the last half, and as few in it.

    The last halves are compared by themselves, each once however many lines have it, then what stands before them in
    the lines whose last half is near another one. A probe may be cut before or behind by the edits.
    """
    each = _cut_like(rows, edits, less, [{"shift": s} for s in range(1 - edits, edits)]).withColumn("own", F.col("own") & (F.col("c.shift") == 0))
    each = each.withColumn("at", F.col("size") - F.floor(F.col("n") / 2).cast("int") - F.col("c.shift")).where("n > 0 AND at BETWEEN 0 AND size")
    before, behind = F.col("line").substr(F.lit(1), F.col("at")), F.col("line").substr(F.col("at") + 1, F.col("size"))
    key = lambda side, *more: F.xxhash64("under", "n", F.lit(side), *more)
    probes = stored(each.select(
        "h1", "size", "profile", "own", before.alias("x"), behind.alias("y"), key("x").alias("under_x"), key("y").alias("under_y"),
        key("x", before).alias("id_x"), key("y", behind).alias("id_y"),
    ))
    index = probes.where("own").select("h1", "size", "profile", "x", "under_x", F.col("id_x").alias("to_x"), F.col("id_y").alias("to_y"))
    last = _strings(probes.select(F.col("id_y").alias("h1"), F.col("under_y").alias("under"), F.col("y").alias("line"), "own"), edits - 1)
    probes = stored(probes.join(last.select(F.col("a").alias("id_y"), F.col("b").alias("to_y")), "id_y"))
    index = stored(index.join(last.select(F.col("b").alias("to_y")).distinct(), "to_y", "left_semi"))
    firsts = probes.select("id_x", "under_x", "x", F.lit(False)).unionAll(index.select("to_x", "under_x", "x", F.lit(True)))
    first = _strings(firsts.toDF("h1", "under", "line", "own"), edits - 1)
    side = lambda held, h, *more: held.select(F.col("h1").alias(h), F.col("size").alias(f"size_{h}"), F.col("profile").alias(f"profile_{h}"), *more)
    asking = side(probes, "a", "id_x", "to_y").join(first.select(F.col("a").alias("id_x"), F.col("b").alias("to_x")), "id_x")
    return _allowed(asking.join(side(index, "b", "to_x", "to_y"), ["to_x", "to_y"]), edits, less)


def _strings(rows: DataFrame, edits: int) -> DataFrame:
    """(a, b) of different strings under one key, of which b is marked ``own``, that are within ``edits`` edits."""
    each = rows.groupBy("h1", "under", "line").agg(F.bool_or("own").alias("own"))
    each = stored(each.withColumn("size", F.length("line")).withColumn("profile", profile(F.col("line"))))
    line = lambda h: each.select(F.col("h1").alias(h), F.col("line").alias(f"line_{h}"))
    found = _near(each, edits, edits).join(line("a"), "a").join(line("b"), "b")
    return stored(found.where(F.levenshtein("line_a", "line_b", edits) >= 0).select("a", "b"))


def profile(line: Column) -> Column:
    """Counts of frequent letters modulo 32, five bits each."""
    size = F.octet_length(line)
    numbers = []
    for letters in (LETTERS[:12], LETTERS[12:]):
        bits = F.lit(0).cast("long")
        for k, letter in enumerate(letters):
            count = (size - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).cast("long")
            bits = bits.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(31).cast("long")), 5 * k))
        numbers.append(bits)
    return F.struct(*(x.alias(f"p{k}") for k, x in enumerate(numbers)))


def _profiles_agree(a: Column, b: Column, most: Column) -> Column:
    """Whether the letter counts differ by at most ``most`` in sum. An edit changes one count by one, or replaces a letter
    and changes two; of lines that differ in length by d, d edits are of the first kind. So no pair within the distance fails."""
    total = F.lit(0).cast("long")
    for part in ("p0", "p1"):
        for k in range(12):
            d = (F.shiftright(a[part], 5 * k) - F.shiftright(b[part], 5 * k)).bitwiseAND(F.lit(31).cast("long"))
            total = total + F.least(d, F.lit(32).cast("long") - d)
    return total <= most


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: from large powers of two to small ones, a step is taken if it still fits."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(26, -1, -1)))
    fits = lambda at, step: (at + step <= n) & (a.substr(at + 1, step) == b.substr(at + 1, step))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(fits(at, step), step).otherwise(0))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """:func:`banded_distance` of what is left between a common prefix and a common suffix.

    A margin of ``edits`` + 1 characters stays on both sides, since the band needs them.
    """

    def cut(x: Column) -> Column:
        at = F.greatest(_common_prefix(x["a"], x["b"]) - (edits + 1), F.lit(0))
        return _let(at, lambda k: F.struct(F.reverse(x["a"].substr(k + 1, F.length(x["a"]))).alias("a"), F.reverse(x["b"].substr(k + 1, F.length(x["b"]))).alias("b")))

    return _let(_let(_let(F.struct(a.alias("a"), b.alias("b")), cut), cut), lambda x: banded_distance(x["a"], x["b"], edits))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings of more than ``edits`` characters, exact up to ``edits`` and above it otherwise.

    One word of 2 * ``edits`` + 1 bits slides down the diagonal band with each character of ``b``: bit t stands for
    row j + t - ``edits``. The score follows the band's lowest diagonal until it meets the last row, then that row.
    """
    w = 2 * edits + 1
    if w > 61:
        raise ValueError("the band is wider than a word")
    ones = (1 << w) - 1
    state = "struct<vp:bigint,vn:bigint,d:int>"

    def fold(a: Column, b: Column) -> Column:
        m = F.size(a)
        flip = lambda x: x.bitwiseXOR(F.lit(ones))

        def step(s: Column, j: Column) -> Column:
            vp, vn, d = s["vp"], s["vn"], s["d"]

            def match(c: Column) -> Column:
                bits = F.lit(0).cast("long")
                for t in range(w):
                    bits = bits + F.when(F.get(a, j + (t - edits)) == c, F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long"))
                return bits

            def column(x: Column) -> Column:
                zero = ((x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(ones))).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)
                return _let(zero, lambda d0: _let(F.struct(vn.bitwiseOR(flip(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn")), lambda h: close(d0, h)))

            def close(d0: Column, h: Column) -> Column:
                down = F.shiftright(d0, 1)
                bit = F.lit(w - 2) - (j - (m - edits))
                side = lambda x: F.call_function("shiftright", x, bit).bitwiseAND(F.lit(1)).cast("int")
                score = F.when(j < m - edits, d + 1 - F.shiftright(d0, w - 1).cast("int")).otherwise(d + side(h["hp"]) - side(h["hn"]))
                return F.struct(h["hn"].bitwiseOR(flip(down.bitwiseOR(h["hp"]))).alias("vp"), down.bitwiseAND(h["hp"]).alias("vn"), score.alias("d")).cast(state)

            return _let(_let(F.get(b, j), match), column)

        first = F.struct(F.lit((ones << (w - edits - 1)) & ones).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("d")).cast(state)
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), first, step, lambda s: s["d"])

    within = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(within, _let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda x: fold(x["a"], x["b"]))).otherwise(edits + 1)


def _pieces_agree(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` of twice as many pieces of ``a`` stand in ``b`` near their place.

    An edit touches one piece and moves the others by one at most, so no pair within the distance fails; it spares
    the verification of pairs that share one segment by chance.
    """
    n, parts = F.length(a), 2 * (edits + 1)
    size = F.floor(n / parts).cast("int")
    there = F.lit(0)
    for k in range(parts):
        start = size * k + 1
        near = b.substr(F.greatest(start - edits, F.lit(1)), size + 2 * edits)
        there = there + F.when(near.contains(a.substr(start, size)), 1).otherwise(0)
    return there >= parts - edits


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: its row's key (doc_id, th), position, trimmed text and 128-bit hash."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "raw"))
    trimmed = lines.select("doc_id", "th", "pos", F.btrim("raw", F.lit(" \t\r")).alias("line")).where("line <> ''")
    h1, h2 = hash128("line")
    return trimmed.select("doc_id", "th", "pos", "line", h1.alias("h1"), h2.alias("h2"))


def places(docs: DataFrame) -> DataFrame:
    """Hash, number of occurrences and first place by (doc_id, text key, position) of every line, without its text."""
    return stored(occurrences(docs).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n")))


def first_lines(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Every line with its text, where it stands first. Texts are read again instead of shuffled: only lines that come
    more than once must be looked up."""
    often = sized(placed.where("n > 1").select("h1", "h2", "first"))
    here = F.struct("doc_id", "th", "pos")
    found = occurrences(docs).join(often, ["h1", "h2"], "left").where(F.col("first").isNull() | here.eqNullSafe(F.col("first")))
    return found.select("h1", "h2", "line", F.length("line").alias("size"), here.alias("first"))


def edit_join(lines: DataFrame, edits: int = EDITS, least: int = LEAST_NEAR) -> DataFrame:
    """Pairs of distinct lines within ``edits`` edits: the hashes and first places of both, and the distance.

    ``lines`` has h1, h2, line, size and first. Keys carry one hash of the line, and a line that meets another by a
    collision is verified like any candidate. Texts are fetched for candidates only.
    """
    if least <= 2 * (edits + 1) or edits > 7:
        raise ValueError("lines this short have segments of a letter, or the band is wider than a byte")
    long = stored(lines.where(F.col("size") >= least))
    shared = _sharing(long, edits)
    pairs = checkpointed(_met(shared, edits))
    needed = sized(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    texts = checkpointed(shared.join(needed, "h1", "left_semi").dropDuplicates(["h1", "h2"]))
    side = lambda h: texts.select(F.col("h1").alias(h), F.struct("h1", "h2", "first", "line").alias(f"of_{h}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("of_a.line"), F.col("of_b.line")
    checked = both.where((F.abs(F.length(a) - F.length(b)) <= edits) & _pieces_agree(a, b, edits))
    # a generator is not copied into filters, so every distance is computed once
    near = F.explode(F.filter(F.array(edit_distance(a, b, edits)), lambda d: d <= edits))
    return checked.select(F.struct("of_a.h1", "of_a.h2", "of_a.first").alias("x"), F.struct("of_b.h1", "of_b.h2", "of_b.first").alias("y"), near.alias("distance"))


def verdicts(docs: DataFrame, edits: int = EDITS, least: int = LEAST_NEAR) -> DataFrame:
    """What happens to a document's lines, for documents where anything does: (doc_id, th), counts and ``removed``.

    A line goes if it occurred before, or if a line within ``edits`` edits of it occurred before it did. Rows that
    share doc_id and text are one document; a null doc_id sorts first.
    """
    placed = places(docs)
    links = edit_join(first_lines(docs, placed), edits, least)
    ends = links.select(F.explode(F.array(F.struct("x.h1", "x.h2", (F.col("x.first") > F.col("y.first")).alias("late")), F.struct("y.h1", "y.h2", (F.col("y.first") > F.col("x.first")).alias("late")))).alias("e")).select("e.*")
    near = ends.groupBy("h1", "h2").agg(F.count("*").alias("links"), F.max("late").alias("late"))
    known = sized(
        placed.join(near, ["h1", "h2"], "left").where("n > 1 OR links IS NOT NULL")
        .select("h1", "h2", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("late", F.lit(False)).alias("late"))
    )
    again = ~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first"))
    return (
        occurrences(docs).select("doc_id", "th", "pos", "h1", "h2").join(known, ["h1", "h2"]).distinct()
        .groupBy("doc_id", "th")
        .agg(
            F.count_if(again).alias("n_repeated"), F.count_if(~again & F.col("late")).alias("n_near"), F.sum("links").alias("n_links"),
            F.sort_array(F.collect_list(F.when(again | F.col("late"), F.col("pos")))).alias("removed"),
        )
    )


def deduplicate(docs: DataFrame, edits: int = EDITS, least: int = LEAST_NEAR) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the removed lines gone from ``text``; every row stays.

    Blank lines stay. A null text stays null; a text of which all lines go is empty. An empty table stays empty. Texts
    and lines of any length are read whole, and repeated rows lose the same lines. Other columns may have any name.
    """
    found = verdicts(docs.select("doc_id", "text"), edits, least).select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "removed")
    held = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), text_key(F.col("text")).alias("th"))
    joined = held.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    split = F.struct(F.split("text", "\n").alias("lines"), gone.alias("gone"))
    stays = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
    kept = _let(split, lambda x: F.array_join(F.transform(stays(x), lambda i: F.get(x["lines"], i)), "\n"))
    text = F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))
    return joined.select(*((text if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def report(docs: DataFrame, edits: int = EDITS, least: int = LEAST_NEAR) -> DataFrame:
    """A row per document: lines that are not blank, repeats, near repeats, links of its lines, positions removed.

    Null and empty texts have no lines; repeated rows have a row each; an empty table gives no rows.
    """
    zero = lambda c: F.coalesce(f"found.{c}", F.lit(0)).cast("long").alias(c)
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != "")).cast("long")
    counted = docs.select("doc_id", text_key(F.col("text")).alias("key"), n.alias("n_lines"))
    found = verdicts(docs.select("doc_id", "text"), edits, least)
    found = found.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), F.struct("n_repeated", "n_near", "n_links", "removed").alias("found"))
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_th")), "left").select(
        "doc_id", "n_lines", zero("n_repeated"), zero("n_near"), zero("n_links"),
        F.coalesce("found.removed", F.array().cast("array<int>")).alias("removed"),
    )


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication finds in every document; null and empty texts have no lines, an empty table no rows."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lines": op5_lines}
SQL = {
    "op5_lines": f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
o AS (
  SELECT doc_id, p - 1 AS pos, trim(l[p], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM s)
),
o2 AS (SELECT * FROM o WHERE line <> ''),
d AS (SELECT line, min(ROW(doc_id, pos)) AS first, length(line) AS n FROM o2 GROUP BY line),
pairs AS (
  SELECT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb FROM d a JOIN d b
  ON a.n BETWEEN b.n - {EDITS} AND b.n + {EDITS} AND a.first < b.first
  WHERE a.n >= {LEAST_NEAR} AND b.n >= {LEAST_NEAR} AND levenshtein(a.line, b.line) <= {EDITS}
),
near AS (
  SELECT line, count(*) AS links, max(late) AS late
  FROM (SELECT a AS line, 0 AS late FROM pairs UNION ALL SELECT b, 1 FROM pairs) GROUP BY line
),
v AS (
  SELECT o2.doc_id, o2.pos, ROW(o2.doc_id, o2.pos) <> d.first AS again, coalesce(late, 0) = 1 AS late, coalesce(links, 0) AS links
  FROM o2 JOIN d USING (line) LEFT JOIN near USING (line)
)
SELECT s.doc_id, count(v.pos) AS n_lines, count(*) FILTER (again) AS n_repeated, count(*) FILTER (late AND NOT again) AS n_near,
       CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links,
       coalesce(list(CAST(v.pos AS INTEGER) ORDER BY v.pos) FILTER (again OR late), []) AS removed
FROM s LEFT JOIN v USING (doc_id) GROUP BY s.doc_id
"""
}
