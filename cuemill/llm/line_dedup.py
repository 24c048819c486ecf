"""Line dedup: an exact set-similarity join of the lines of all documents, in DataFrame functions.

A line is a set of words (lower case, split at ASCII white space). Words are ordered by rarity: by how often
their hash bucket occurs in the corpus (``BUCKETS`` counts, the only thing that reaches the driver),
then by hash. Lines with equal sets are one set, of which only the first occurrence can stay. Sets
whose rarest words meet (prefix filter) are paired unless their sizes, the places of the word or
digests of the sets rule a Jaccard similarity of 4/5 out (length, positional and bitmap
filters). The words themselves then decide. A line goes if any earlier line is as similar as that,
whether or not that line stays itself. Earlier means a smaller (doc_id, digest of the text, line).

Of a set, one thin row for each of its rarest words is shuffled: the word, the set's document and 64-bit
name, its size and the word's place in one number, and two digests. Hot lines collapse before that, hot words are split by classes of size of which only neighbours can be alike, and
no group is gathered. Filters of ``FILTER_BITS`` bits, of fixed size, keep rows that cannot matter out
of the last joins; they never decide anything.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.shared import drop_finished_shuffles, keep

BUCKETS = 1 << 18
FILTER_BITS = 1 << 20
#: Rows, of at most about 100 bytes, that are broadcast to a join; more are shuffled.
MOST_BROADCAST = 400_000
#: White space within a line, but for the plain space.
SPACES = "\t\x0b\f\r"
#: Occurrences in the corpus from which a word is hot, as a power of two.
HOT = 20
#: Of a set's prefix, the words by which it is first held against other sets: the least one in each of these orders of their hashes.
#: The rarest words would not do, as they are what a near copy has changed.
ORDERS = [0, 0x5A5A5A5A, 0x3C6699C3, -0x69696A]
#: How many of the earliest sets of each of these words.
LEADERS = 4
#: The large join is done for so many parts of the words in turn, so that only a part's rows take disk.
PASSES = 2
#: A line's place: its document, a digest of the document's text, its number.
PLACE = ["doc_id", "twin", "line"]
#: What lines with equal sets have in common.
SET = ["sig", "n", "d0", "d1"]


def _plain(text: Column) -> Column:
    """In lower case, with plain spaces within lines. Rarely has a text other ones, which is cheap to see."""
    lower = F.lower(text)
    rare = F.contains(text, F.lit(SPACES[0]))
    for c in SPACES[1:]:
        rare = rare | F.contains(text, F.lit(c))
    return F.when(rare, F.translate(lower, SPACES, " " * len(SPACES))).otherwise(lower)


def _words(line: Column) -> Column:
    """The words of a plain line, and empty ones where spaces meet."""
    return F.split(line, " ")


def _literal(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _rarity(docs: DataFrame) -> Column:
    """For each bucket of word hashes a class that grows with its count, in a constant array."""
    bucket = F.xxhash64("word").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")
    k, inside = F.shiftright("bucket", 3).alias("k"), F.col("bucket").bitwiseAND(7)
    words = _words(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")))
    # Eight buckets are one row: four times fewer rows to find and to shuffle than with a row for each.
    counts = docs.select(F.explode(words).alias("word")).select(bucket).groupBy(k).agg(*[F.count_if(inside == j).alias(f"c{j}") for j in range(8)])
    each = [F.least(F.lit(127), F.floor(4 * F.log2(F.greatest(F.col(f"c{j}"), F.lit(1))))).cast("long") for j in range(8)]
    packed = functools.reduce(Column.bitwiseOR, [F.shiftleft(c, 8 * j) for j, c in enumerate(each)])
    classes = [0] * BUCKETS
    for row in counts.select("k", packed.alias("classes")).collect():
        classes[8 * row.k : 8 * row.k + 8] = row.classes.to_bytes(8, "little")
    return _literal(classes, "bigint")


def _filter(rows: DataFrame, hashed: Column) -> Column:
    """A condition on the same expression, true for every row here and false for most others."""
    place = hashed.bitwiseAND(FILTER_BITS - 1)
    bits = rows.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    table = [0] * (FILTER_BITS // 64)
    for row in bits.collect():
        table[row[0]] = row[1]
    word = F.get(_literal(table, "bigint"), F.shiftright(place, 6).cast("int"))
    return F.getbit(word, place.bitwiseAND(63).cast("int")) == 1


def _small(kept: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small."""
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def _once(column: Column) -> Column:
    """The same column, computed once a row however often it is used later: Spark doesn't merge it into its uses."""
    return F.explode(F.array(column))


def _lines(docs: DataFrame, rarity: Column) -> DataFrame:
    """One row per line with a word: its place, its set's name, size and digests, and its prefix, rarest first."""

    def rank(word: Column) -> Column:
        """Its class, then its hash; never null, so that Spark sorts plain numbers."""
        h = F.xxhash64(word)
        known = F.coalesce(F.get(rarity, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(known, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    ranked = F.sort_array(F.array_remove(F.array_distinct(F.transform(_words(F.col("words")), rank)), rank(F.lit(""))))
    return (
        docs.select("doc_id", "twin", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "words"))
        .where(F.btrim("words") != "")
        .select(*PLACE, _once(ranked).alias("ranked"))
        .select(
            *PLACE,
            F.xxhash64("ranked").alias("sig"),
            F.size("ranked").alias("n"),
            # Each word turns one of 128 bits; of two sets, the differing bits are at most the words they do not share.
            F.expr("aggregate(ranked, 0L, (a, h) -> a ^ shiftleft(1L, cast(h & 63 as int)))").alias("d0"),
            F.expr("aggregate(ranked, 0L, (a, h) -> a ^ shiftleft(shiftrightunsigned(h, 6) & 1L, cast(h & 63 as int)))").alias("d1"),
            # The last bit of a word says whether it is hot.
            F.expr(f"transform(slice(ranked, 1, if(size(ranked) > 3, size(ranked) div 5 + 1, 0)), h -> if(h >= {4 * HOT << 56}L, hash(h) | 1, hash(h) & -2))").alias("prefix"),
        )
        .withColumn("d0", F.col("d0").bitwiseXOR(F.col("d1")))
    )


# Of two sets with n and m words, 4/5 alike means that 9 times the common ones is at least 4 (n + m).
_DIFFER = "bit_count(a.d0 ^ b.d0) + bit_count(a.d1 ^ b.d1)"
_N, _M = "shiftright(a.size_at, 32)", "shiftright(b.size_at, 32)"
_AT, _BT = "(a.size_at & 2147483647)", "(b.size_at & 2147483647)"
_SIZES = f"5 * least({_N}, {_M}) >= 4 * greatest({_N}, {_M})"
_POSSIBLE = f"9 * ({_DIFFER}) <= {_N} + {_M} and 9 * (least({_AT}, {_BT}) + least({_N} - {_AT}, {_M} - {_BT})) >= 4 * ({_N} + {_M})"


def _size_class() -> Column:
    """Sets of which one is at most 5/4 as large as the other are in the same class or in neighbouring ones."""
    return F.floor(F.log("n") / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")


#: Marks a set that is known to go, in the number that holds size and place.
_SETTLED = "2147483648"


def _size_at(settled: Column | None = None) -> Column:
    both = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return (both if settled is None else both.bitwiseOR(F.when(settled, F.expr(_SETTLED + "L")).otherwise(0))).alias("size_at")


def _leaders(sets: DataFrame) -> DataFrame:
    """(sa, sb): for each set b the nearest, by digests, of the earliest sets of about its size with one of its words."""
    least = lambda c: F.array_min(F.transform("prefix", lambda h: h.bitwiseXOR(F.lit(c)))).bitwiseXOR(F.lit(c))
    # Two classes of size are one key, and every second word pairs the classes the other way: sets of neighbouring classes meet by half of their words.
    words = F.when(F.size("prefix") > 0, F.array_distinct(F.array(*[2 * least(c).cast("long") + k % 2 for k, c in enumerate(ORDERS)])))
    # Any of a set's places may be the word's: no pair is ruled out by it.
    rows = sets.select("doc_id", *SET, F.lit(0).alias("at"), F.explode(words).alias("word"))
    both = F.shiftright(_size_class() + F.pmod("word", F.lit(2)).cast("int"), 1)
    rows = rows.select(F.xxhash64("word", both).alias("key"), "doc_id", "sig", _size_at(), "d0", "d1")
    own = F.struct("doc_id", "sig", "size_at", "d0", "d1")
    sofar = Window.partitionBy("key").orderBy("doc_id", "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.select(own.alias("b"), *[F.nth_value(own, k).over(sofar).alias(f"a{k}") for k in range(1, LEADERS + 1)])
    of = lambda text, k: F.expr(text.replace("a.", f"a{k}."))
    near = [F.when(of(f"a.sig != b.sig and {_SIZES} and {_POSSIBLE}", k), F.struct(of(_DIFFER, k).alias("apart"), of("a.sig", k).alias("sa"))) for k in range(1, LEADERS + 1)]
    # Most sets have none, and the least of structs is found by sorting: those go before it.
    later = met.where("a1.sig != b.sig").select(F.col("b.sig").alias("sb"), F.least(*near).alias("near")).where("near is not null")
    nearest = later.groupBy("sb").agg(F.min("near").alias("best"))
    return nearest.select("best.sa", "sb")


def _others(sets: DataFrame, part: int) -> DataFrame:
    """(sa, sb): all pairs of sets that may be alike by a part of the words, unless the later one is settled."""
    rows = sets.select("doc_id", *SET, "settled", F.posexplode("prefix").alias("at", "word")).where(F.pmod(F.shiftright("word", 1), F.lit(PASSES)) == part)
    # A hot word's row goes under its class of size, and as a visitor under the next one.
    hot = F.col("word").bitwiseAND(1) == 1
    visits = F.explode(F.when(hot, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("visit")
    dealt = rows.select("*", visits).select(
        F.when(hot, F.hash("word", _size_class() + F.col("visit"))).otherwise(F.col("word")).alias("word"),
        "doc_id",
        "sig",
        _size_at(F.col("settled")),
        "d0",
        "d1",
    )
    # Of two sets that are alike, the smaller one has a common word in its first ninth, the larger one in its first fifth.
    # Said of both sides (sizes are positive), as Spark then shuffles the rows once for both.
    a, b, ninth = dealt.alias("a"), dealt.alias("b"), f"9 * {_AT} <= greatest({_N}, {_N} - {_M})"
    ordered = f"{_N} <= {_M} and ({_N} < {_M} or a.sig < b.sig)"
    # Within a document the lines decide which is earlier, and are looked up later.
    settled = [f"a.doc_id > b.doc_id and a.size_at & {_SETTLED}L != 0", f"b.doc_id > a.doc_id and b.size_at & {_SETTLED}L != 0", f"a.size_at & b.size_at & {_SETTLED}L != 0"]
    met = a.join(b, F.expr(f"a.word = b.word and {ordered} and {ninth} and {_SIZES} and {_POSSIBLE} and not ({' or '.join(settled)})"))
    return met.select(F.col("a.sig").alias("sa"), F.col("b.sig").alias("sb")).distinct()


def _alike(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places of the later set of each of the pairs that are alike by their words."""
    sides = keep(pairs.select(F.col("sa").alias("s")).union(pairs.select("sb")).distinct(), "line-sides")
    needed = keep(sets.select("sig", *PLACE).join(_small(sides), F.col("sig") == F.col("s"), "left_semi"), "line-places")
    maybe = docs.where(_filter(needed, F.xxhash64("doc_id", "twin")))
    lines = maybe.select("doc_id", "twin", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "words")).where(_filter(needed, F.xxhash64(*PLACE)))
    # Rows alike in identifier and text give a place more than once, with the same words.
    known = keep(lines.join(_small(needed), PLACE).select("sig", *PLACE, F.array_remove(F.array_distinct(_words(F.col("words"))), "").alias("words")), "line-words")
    side = lambda x: known.select(F.col("sig").alias(f"s{x}"), F.struct(*PLACE).alias(f"place_{x}"), F.col("words").alias(f"words_{x}"))
    both = side("a").join(_small(pairs), "sa").join(side("b"), "sb")
    alike = both.where("place_a != place_b and 9 * size(array_intersect(words_a, words_b)) >= 4 * (size(words_a) + size(words_b))")
    later = F.greatest("place_a", "place_b")
    return keep(alike.select(later.alias("p")).select("p.*").distinct(), "alike-lines")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, removed): numbers, from 0, of the lines of docs (doc_id, twin, text) that go.

    Near copies are mostly like the first of them. So each set is first held against the earliest set
    that shares one of its rarest words, and pairs of which this settles both are left out of the join
    of all.
    """
    lines = keep(_lines(docs, _rarity(docs)), "lines")
    grouped = lines.groupBy(*SET).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("times"), F.first("prefix").alias("prefix"))
    sets = keep(grouped.select("first.*", *SET, "times", "prefix"), "line-sets")
    settled = _alike(docs, sets, keep(_leaders(sets), "line-leaders"))
    drop_finished_shuffles(docs.sparkSession)
    flagged = sets.join(_small(settled).withColumn("settled", F.lit(True)), PLACE, "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    pairs = None
    for part in range(PASSES):
        found = keep(_others(flagged, part), "line-pairs")
        pairs = found if pairs is None else pairs.union(found)
        drop_finished_shuffles(docs.sparkSession)
    pairs = keep(pairs.distinct(), "line-pairs")
    removed = keep(settled.union(_alike(docs, sets, pairs)).distinct(), "removed-sets")
    fate = sets.select(*PLACE, *SET, "times").join(_small(removed).withColumn("gone", F.lit(True)), PLACE, "left").where("gone or times > 1")
    marked = keep(fate.select(*SET, F.struct(*PLACE).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")), "line-fates")
    gone = lines.select(*PLACE, *SET).join(_small(marked), SET).where("gone or struct(doc_id, twin, line) > first")
    return gone.groupBy("doc_id", "twin").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with removed lines left out of the text, and n_lines and n_removed added.

    Lines end at newlines. Lines with no word stay. A document that loses all its lines has an empty
    text; a null text stays null, with no lines. Rows alike in identifier and text are one document:
    they lose the same lines, and none to each other. A null identifier comes first. Texts of
    any length are read whole; of lines that tie in place none goes for the other. Columns of any name
    are kept, but for those named n_lines or n_removed, whose place the counts take; an empty table
    gives no rows.
    """
    # 128 bits of the text, and whether the identifier is null: its stand-in may be another row's identifier.
    twin = F.unhex(F.md5(F.concat(F.when(docs[id_col].isNull(), "n").otherwise("i"), F.coalesce(docs[text_col], F.lit(""))).cast("binary")))
    doc_id = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    work = docs.select(doc_id.alias("doc_id"), twin.alias("twin"), docs[text_col].alias("text"), F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"))
    removed = keep(removed_lines(work.select("doc_id", "twin", "text")), "removed-lines")
    n_gone = removed.agg(F.sum(F.size("removed"))).first()[0] or 0
    removed = removed.select(F.col("doc_id").alias("r_doc"), F.col("twin").alias("r_twin"), "removed")
    same = (F.col("doc_id") == F.col("r_doc")) & (F.col("twin") == F.col("r_twin"))

    def out(text: Column, n_removed: Column) -> list[Column]:
        columns = [(text if c == text_col else F.col("row")[f"c{k}"]).alias(c) for k, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
        return [*columns, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed")]

    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: F.array_contains("removed", k) == F.lit(False)), "\n")
    cut = out(F.when(F.col("removed").isNull(), F.col("text")).otherwise(left), F.coalesce(F.size("removed"), F.lit(0)))
    if n_gone <= 4 * MOST_BROADCAST:  # documents are no more than lines, so this bounds the rows too
        return work.join(F.broadcast(removed), same, "left").select(*cut)
    touched = _filter(removed.withColumnsRenamed({"r_doc": "doc_id", "r_twin": "twin"}), F.xxhash64("doc_id", "twin"))
    return work.where(~touched).select(*out(F.col("text"), F.lit(0))).union(work.where(touched).join(removed, same, "left").select(*cut))
