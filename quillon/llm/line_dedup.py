"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Distinct lines within ``max_edits`` edits of each other are linked. A line is cut into ``max_edits`` + 1 segments;
if two lines are that close, at least one segment of the shorter stands unchanged in the longer, and the
positions where it can stand follow from the lengths (the multi-match rule: shifts of at most i - 1 seen
from the left and ``max_edits`` + 1 - i from the right). Segments are indexed by their text, number and the line's
length; every line probes the lengths at most ``max_edits`` below its own. Candidates are verified by a banded
bit-parallel edit distance: after the common prefix and suffix are cut off, one mask per number of errors holds
the reachable diagonals of the band, and each letter updates all diagonals at once.

Linked lines form classes. A class seen more than ``max_copies`` times in the corpus loses all its occurrences but
the first (by document id, then line number). Lines shorter than ``min_chars``, whose segments would be too short to
tell lines apart, are classes of equal lines from ``min_exact`` characters on, and are left alone without it; blank
ones always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._common import maybe_among, stash, table
from quillon.llm.components import connected_components
from quillon.llm.quality import let

MAX_EDITS, MIN_CHARS, MAX_COPIES = 2, 32, 1
#: Shortest line that the query and the pipeline take out where it is repeated exactly.
MIN_EXACT = 1
#: Letters whose counts, two bits each, are a line's sketch.
SKETCH_LETTERS = "enatisrohldc"
#: Letters after which the band of a candidate is looked at first.
FIRST_LOOK = 16
#: Lines of a key that every probe is compared with in the first round.
FIRST_OF_KEY = 16
#: Longs that mark the neighbouring letters of a line under a crowded key.
TWO_WORDS = 4


def _segment(length: Column, number: Column, parts: int) -> tuple[Column, Column]:
    """First position (from 1) and length of a segment; the last ones take the remainder."""
    base, longer = F.floor(length / parts).cast("int"), length % parts
    before = F.greatest(F.lit(0), number - 1 - (F.lit(parts) - longer))
    size = base + (number > F.lit(parts) - longer).cast("int")
    return F.lit(1) + base * (number - 1) + before, size


def probe_places(max_edits: int) -> list[tuple[int, int, int]]:
    """Where a line probes: the segment's number, by how much the line it belongs to is shorter, and the segment's shift."""
    parts = max_edits + 1
    found = []
    for shorter in range(max_edits + 1):
        for number in range(1, parts + 1):
            low = max(-(number - 1), shorter - (parts - number))
            high = min(number - 1, shorter + (parts - number))
            found += [(number, shorter, shift) for shift in range(low, high + 1)]
    return found


def index_places(max_edits: int) -> list[tuple[int, int, int]]:
    """Where a line is indexed: its own segments, where they stand."""
    return [(number, 0, 0) for number in range(1, max_edits + 2)]


def wide_letters(line: Column) -> Column:
    """A line with four bytes for every letter, so that cutting a segment costs nothing."""
    return F.encode(line, "UTF-32")


def _width(wide: Column) -> Column:
    """Number of letters."""
    return (F.octet_length(wide) / 4).cast("int")


def _key(wide: Column, length: Column, number: Column, shorter: Column, shift: Column, max_edits: int) -> Column:
    """Key of a segment of a line ``shorter`` letters shorter than this one."""
    of = length - shorter
    start, size = _segment(of, number, max_edits + 1)
    return F.xxhash64(F.substring(wide, (start + shift - 1) * 4 + 1, size * 4), number, of)


def keyed(wide: DataFrame, places: list[tuple[int, int, int]], max_edits: int) -> DataFrame:
    """``id, key`` for every line (``id, wide``) at every place.

    The places are a small table that every line meets: one short expression for all of them is compiled, where an array
    of keys that is exploded is worked out by the interpreter.
    """
    names = ("number", "shorter", "shift")
    row = (F.col("id") + 1).cast("int")
    table_ = wide.sparkSession.range(len(places), numPartitions=1).select(
        *[F.element_at(F.array(*[F.lit(p[i]) for p in places]), row).alias(c) for i, c in enumerate(names)]
    )
    # the second use of the letters, for their number, has them made once a line and not once a place
    met = wide.withColumn("length", _width(F.col("wide"))).crossJoin(F.broadcast(table_))
    return met.select("id", _key(F.col("wide"), F.col("length"), *[F.col(c) for c in names], max_edits).alias("key"))


def with_sketch(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``lines`` with ``sketch``: counts of twelve letters, two bits each; an edit changes two of the counts by one at most.

    Each letter is counted by taking it out of what the letters before it left, which is shorter every time.
    """
    sketch, rest, own = F.lit(0).cast("long"), line_col, lines.columns
    for i, letter in enumerate(SKETCH_LETTERS):
        lines = lines.withColumn(f"__left_{i}", F.replace(F.col(rest), F.lit(letter), F.lit("")))
        n = F.octet_length(rest) - F.octet_length(f"__left_{i}")
        sketch = sketch.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(3)).cast("long"), 2 * i))
        rest = f"__left_{i}"
    return lines.select(*own, sketch.alias("sketch"))


def sketches_allow(x: Column, y: Column, max_edits: int) -> Column:
    """False only if the letter counts rule out ``max_edits`` edits (differences are taken around 4)."""
    total = F.lit(0).cast("long")
    for i in range(len(SKETCH_LETTERS)):
        part = lambda v, i=i: F.shiftright(v, 2 * i).bitwiseAND(F.lit(3).cast("long"))
        gap = F.abs(part(x) - part(y))
        total = total + F.least(gap, 4 - gap)
    return total <= 2 * max_edits


def _common(a: Column, b: Column, most: Column, part) -> Column:
    """Length of the longest common ``part`` (prefix or suffix), at most ``most``, by bisection."""
    start = F.struct(F.lit(0).alias("low"), most.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        equal = part(a, middle) == part(b, middle)
        return F.struct(
            F.when(equal, middle).otherwise(s["low"]).alias("low"),
            F.when(equal, s["high"]).otherwise(middle - 1).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(most + 2)).cast("int"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two strings are at most ``max_edits`` edits apart (banded, bit-parallel over the diagonals)."""
    k, full = max_edits, (1 << (2 * max_edits + 1)) - 1

    def band(x: Column, y: Column) -> Column:
        """Diagonals reached at the end of x: bit d of mask e says that x up to here matches y up to here + d - k
        with e errors; the last mask is returned."""

        def state(masks: list[Column]) -> Column:
            return F.struct(*[m.cast("int").alias(f"e{i}") for i, m in enumerate(masks)])

        def left(m: Column) -> Column:
            return F.shiftleft(m, 1).bitwiseAND(F.lit(full))

        start = [F.lit(1 << k)]
        for e in range(1, k + 1):
            start.append(F.lit(sum(1 << d for d in range(k, k + e + 1))))

        def step(s: Column, i: Column) -> Column:
            letter, match = F.get(x, i), F.lit(0)
            for d in range(2 * k + 1):
                same = F.get(y, i + (d - k)) == letter
                match = match + F.when(same, 1 << d).otherwise(0)
            old = [s[f"e{e}"] for e in range(k + 1)]
            new = [old[0].bitwiseAND(match)]
            for e in range(1, k + 1):
                changed = old[e - 1].bitwiseOR(F.shiftright(old[e - 1], 1))  # replaced; extra letter in x
                new.append(old[e].bitwiseAND(match).bitwiseOR(changed).bitwiseOR(left(new[e - 1])))
            alive = old[0].bitwiseOR(old[k]) != 0
            return F.when(alive, state(new)).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), state(start), step, lambda s: s[f"e{k}"])

    def letters(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")

    def lists(s: Column, t: Column) -> Column:
        return F.struct(letters(s).alias("x"), letters(t).alias("y"))

    def verdict(v: Column) -> Column:
        """On what is left between the common ends."""
        x, y = v["x"], v["y"]

        def at_end(w: Column) -> Column:
            return F.getbit(band(w["x"], w["y"]), F.size(w["y"]) - F.size(w["x"]) + k) == 1

        # most candidates part within a few letters of their first difference
        look = let(lists(F.left(x, F.lit(FIRST_LOOK)), F.left(y, F.lit(FIRST_LOOK + k))), lambda w: band(w["x"], w["y"]) != 0)
        return (
            F.when(F.abs(F.length(x) - F.length(y)) > k, F.lit(False))
            .when(F.length(x) == 0, F.length(y) <= k)
            .when((F.length(x) > FIRST_LOOK) & ~look, F.lit(False))
            .otherwise(let(lists(x, y), at_end))
        )

    def cut_tail(v: Column) -> Column:
        most = F.least(F.length(v["x"]), F.length(v["y"]))
        tail = _common(v["x"], v["y"], most, lambda s, n: F.right(s, n))
        shorter = lambda s, n: F.left(s, F.length(s) - n)
        return let(let(tail, lambda n: F.struct(shorter(v["x"], n).alias("x"), shorter(v["y"], n).alias("y"))), verdict)

    head = _common(a, b, F.least(F.length(a), F.length(b)), lambda s, n: F.left(s, n))
    after = lambda s, n: F.substring(s, n + 1, F.length(s))
    return let(let(head, lambda n: F.struct(after(a, n).alias("x"), after(b, n).alias("y"))), cut_tail)


def words_allow(x: Column, y: Column, max_edits: int) -> Column:
    """False only if :func:`word_marks` rule out ``max_edits`` edits: an edit cuts, joins or changes a word, which turns
    three bits at most."""
    return F.bit_count(x.bitwiseXOR(y)) <= 3 * max_edits


def word_marks(line: Column) -> Column:
    """64 bits: which of 64 classes of words stand in a line an odd number of times."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda marks, w: marks.bitwiseXOR(bit(w)))


def twos_allow(x: Column, y: Column, max_edits: int) -> Column:
    """False only if :func:`two_marks` rule out ``max_edits`` edits: an edit takes out two pairs of neighbouring letters at most
    and brings in two, which turns four bits at most."""
    turned = [F.bit_count(x[f"m{i}"].bitwiseXOR(y[f"m{i}"])) for i in range(TWO_WORDS)]
    return sum(turned[1:], turned[0]) <= 4 * max_edits


def two_marks(wide: Column) -> Column:
    """64 bits each in ``TWO_WORDS`` fields: which classes of neighbouring letters stand in a line (:func:`wide_letters`) an odd
    number of times."""
    places = F.filter(F.sequence(F.lit(0), _width(wide) - 1), lambda i: i < _width(wide) - 1)
    spots = F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(8))), F.lit(64 * TWO_WORDS)).cast("int"))
    bit = lambda spot: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)))

    def marks(found: Column, i: int) -> Column:
        own = F.filter(found, lambda spot: F.floor(spot / 64) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, spot: m.bitwiseXOR(bit(spot)))

    return let(spots, lambda found: F.struct(*[marks(found, i).alias(f"m{i}") for i in range(TWO_WORDS)]))


def _ends(pairs: DataFrame) -> DataFrame:
    """Every ``id`` that stands in the pairs ``a, b``, once."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _lines_of(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of these ``id``."""
    return lines.where(maybe_among(ids, F.col("id"))).join(ids.hint("merge"), "id", "left_semi")


def _verified(pairs: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """The pairs ``a, b`` whose lines are within ``max_edits`` edits."""
    texts = lines.where(maybe_among(_ends(pairs), F.col("id")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")).hint("merge"), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")).hint("merge"), "b")
    # few bytes but much work: dealt out anew, so that small partitions are not merged into a few tasks
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, "a", "b")
    return both.where(within_edits(F.col("x"), F.col("y"), max_edits)).select("a", "b")


def _crowded_pairs(own: DataFrame, crowded: DataFrame, max_edits: int, first: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of lines of different roots that meet under a crowded key (``id, key``: who probes with which) and that their marks
    do not tell apart; with ``first``, probes meet that many lines of each key only. Marks are compared where lines meet."""
    marks = ("id", "sketch", "words", "twos", "root")
    named = lambda side: own.select(*[F.col(c).alias(f"{c}_{side}") for c in marks]).hint("merge")
    probing = crowded.withColumnRenamed("id", "id_b").join(named("b"), "id_b")
    indexed = own.select(F.explode("keys").alias("key"), F.col("id").alias("id_a"))
    indexed = indexed.join(crowded.select("key").distinct().hint("merge"), "key", "left_semi")
    if first is not None:
        place = F.row_number().over(Window.partitionBy("key").orderBy("id_a"))
        indexed = indexed.withColumn("place", place).where(F.col("place") <= first).drop("place")
    indexed = indexed.join(named("a"), "id_a")
    met = probing.join(
        indexed.hint("merge"),
        (probing["key"] == indexed["key"])
        & (F.col("root_a") != F.col("root_b"))
        & words_allow(F.col("words_a"), F.col("words_b"), max_edits)
        & sketches_allow(F.col("sketch_a"), F.col("sketch_b"), max_edits)
        & twos_allow(F.col("twos_a"), F.col("twos_b"), max_edits),
    )
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _crowded_links(lines: DataFrame, crowded: DataFrame, links: DataFrame, max_edits: int) -> DataFrame:
    """Links under the crowded keys (``id, key``: who probes with which): with the first lines of each key, then between lines that
    these and the other ``links`` leave in different components."""
    found = with_sketch(_lines_of(crowded.select("id").distinct(), lines)).withColumn("wide", wide_letters(F.col("line")))
    length = _width(F.col("wide"))
    keys = [_key(F.col("wide"), length, *[F.lit(x) for x in place], max_edits) for place in index_places(max_edits)]
    own = found.select(
        "id",
        "line",
        "sketch",
        word_marks(F.col("line")).alias("words"),
        two_marks(F.col("wide")).alias("twos"),
        F.array(*keys).alias("keys"),
    )
    own = stash(own, "crowded-lines")
    texts = own.select("id", "line")
    pairs = _crowded_pairs(own.withColumn("root", F.col("id")), crowded, max_edits, FIRST_OF_KEY)
    near = stash(_verified(stash(pairs, "crowded-first"), texts, max_edits), "crowded-links")
    roots = connected_components(links.unionByName(near))
    own = own.join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    pairs = stash(_crowded_pairs(own, crowded, max_edits), "crowded-pairs")
    return near.unionByName(_verified(pairs, texts, max_edits))


def linked_lines(lines: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """Links ``a, b`` (ids) between the distinct lines (``id, line``) that are within ``max_edits`` edits: the
    components are those of all such pairs.

    Under keys of ``FIRST_OF_KEY`` lines at most, every probe meets them all. The lines of crowded keys are marked first, and told
    apart by their marks where they meet: every probe with the first ``FIRST_OF_KEY`` lines of its key, and then with the
    others of components that this has left apart; so a large group of near-equal lines is one component after a number of
    links in proportion to its lines, and lines that share no more than a key make no row. Ids are taken to be
    distinct and not null; null lines are linked with nothing.
    """
    lines = lines.select("id", "line")
    wide = lines.select("id", wide_letters(F.col("line")).alias("wide"))
    indexed = keyed(wide, index_places(max_edits), max_edits).withColumnRenamed("id", "a")
    one = Window.partitionBy("key")
    indexed = indexed.withColumn("place", F.row_number().over(one.orderBy("a"))).where(F.col("place") <= FIRST_OF_KEY + 1)
    crowded = F.col("place") > FIRST_OF_KEY  # one such line a crowded key, all that is left of it; it tells who probes with the key
    indexed = indexed.withColumn("n", F.count("*").over(one)).where(crowded | (F.col("n") <= FIRST_OF_KEY)).drop("n")
    probing = keyed(wide, probe_places(max_edits), max_edits).select(F.col("key").alias("probe"), F.col("id").alias("b"))
    met = probing.join(indexed.hint("merge"), (F.col("probe") == F.col("key")) & (crowded | (F.col("a") != F.col("b"))))
    met = met.select(
        F.when(crowded, F.col("b")).otherwise(F.least("a", "b")).alias("a"),
        F.when(crowded, F.col("b")).otherwise(F.greatest("a", "b")).alias("b"),
        F.when(crowded, F.col("key")).alias("key"),
    )
    met = stash(met.distinct(), "line-pairs")
    pairs = met.where(F.col("key").isNull()).select("a", "b")
    # few lines meet another one: letters are counted in these only, once a line
    texts = stash(with_sketch(_lines_of(_ends(pairs), lines)), "met-lines")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")).hint("merge")
    near = sketches_allow(F.col("sketch_a"), F.col("sketch_b"), max_edits)
    pairs = stash(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), "near-pairs")
    links = stash(_verified(pairs, texts, max_edits), "line-links")
    probes = met.where(F.col("key").isNotNull()).select(F.col("a").alias("id"), "key")
    if probes.isEmpty():
        return links
    return links.unionByName(_crowded_links(lines, probes, links, max_edits)).distinct()


def repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    max_copies: int = MAX_COPIES,
    min_exact: int | None = None,
) -> DataFrame:
    """Lines to remove, per document row that has any: ``row_id, row_hash, removed`` (line numbers from 0).

    Rows of one id are one document in this: each keeps its first line of a class that begins with that id. Rows without an
    id come last, and among themselves by a hash of the text. Null texts have no lines.
    """
    if min_chars <= max_edits:
        raise ValueError("min_chars must exceed max_edits: every segment needs a letter")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # hashed before its lines are taken apart: once a text, not once a line
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text).alias("row_hash"), text.alias("whole"))
    found = rows.select("row_id", "row_hash", F.posexplode_outer(F.split("whole", "\n")).alias("at", "line"))
    size = F.length("line")
    taken = size >= min_chars
    if min_exact is not None:
        taken = taken | ((size >= min_exact) & F.col("line").rlike(r"\S"))
    found = found.where(taken)
    marks = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2")]
    unnamed = F.min(F.when(F.col("row_id").isNull(), F.col("row_hash")))
    distinct = found.groupBy("line").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"), unnamed.alias("first_hash"))
    distinct = stash(distinct.withColumn("id", F.monotonically_increasing_id()), "lines")
    edited = distinct.where(F.length("line") >= min_chars).select("id", "line")
    roots = connected_components(linked_lines(edited, max_edits))
    known = distinct.select("id", "n", "first_id", "first_hash", *marks)
    named = known.join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id"))
    # only classes that are linked or frequent can pass max_copies, but each is counted in full
    sizes = named.groupBy("root").agg(F.sum("n").alias("copies"), F.min("first_id").alias("class_first"), F.min("first_hash").alias("class_hash"))
    heavy = named.join(sizes.where(F.col("copies") > max_copies), "root").select("h1", "h2", "root", "class_first", "class_hash")
    heavy = stash(heavy, "repeated-lines")
    spots = found.select("row_id", "row_hash", "at", *marks)
    spots = spots.where(maybe_among(heavy.select("h1").distinct(), F.col("h1")))
    # a class without any id begins in the row of the least text hash
    first = F.coalesce(F.col("row_id") == F.col("class_first"), F.col("class_first").isNull() & (F.col("row_hash") == F.col("class_hash")))
    hits = spots.join(heavy.hint("merge"), ["h1", "h2"]).select("row_id", "row_hash", "at", F.when(first, F.col("root")).alias("own"))
    per_row = hits.groupBy("row_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("own", "at"))).alias("hits"))

    def spare(h: Column) -> Column:
        """Line numbers without the first of each class that begins in this document (sorted by class)."""
        again = lambda x, i: F.get(h, i - 1)["own"] == x["own"]
        kept = F.filter(h, lambda x, i: x["own"].isNull() | F.coalesce(again(x, i), F.lit(False)))
        return F.transform(kept, lambda x: x["at"])

    return per_row.select("row_id", "row_hash", let(F.col("hits"), spare).alias("removed")).where(F.size("removed") > 0)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and ``n_lines_removed`` appended.

    Every row stays, in its columns; a null text stays null; an empty text, or one with short lines only, stays as
    it is; a text whose lines are all repeated becomes empty. Rows with the same id and text are treated alike.
    A column that is already called ``n_lines_removed`` is replaced.
    """
    plain = [c for c in docs.columns if c != "n_lines_removed"]
    docs = docs.select(*plain)
    removed = stash(repeated_lines(docs, id_col=id_col, text_col=text_col, **rule), "removed-lines")
    touched = maybe_among(removed.select("row_id").distinct(), F.col(id_col)) | F.col(id_col).isNull()
    part = docs.where(touched)
    # own names, which no column of the documents has
    own = {c: f"__quillon_{c}" for c in removed.columns}
    removed = removed.withColumnsRenamed(own)
    gone = F.col(own["removed"])
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col(own["row_id"])) & (hashed == F.col(own["row_hash"]))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    changed = part.join(removed.hint("merge"), same, "left").select(
        *[F.when(gone.isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in plain],
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_lines_removed"),
    )
    rest = docs.where(~F.coalesce(touched, F.lit(True))).withColumn("n_lines_removed", F.lit(0).cast("long"))
    return rest.unionByName(changed)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs, min_exact=MIN_EXACT).select(
        "doc_id",
        "n_lines_removed",
        F.length(text).cast("long").alias("n_chars_kept"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
