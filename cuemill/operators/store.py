"""The store of transcripts as a table: identities, file names without collisions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.operators.corpus import is_meeting_file, with_frontmatter
from cuemill.operators.ordered import AT, PART, island_numbers, neighbours, places, ranged
from cuemill.sources.shared import keep

NUMBERED = r"(?s)\A(.*)-([1-9][0-9]{0,30})\.md\z"


def identity_of(path: Column, values: Column) -> Column:
    """struct<identity_kind, identity> of a file: its url, else a meeting's title, else both null."""
    url, title = F.nullif(values["url"], F.lit("")), F.nullif(values["title"], F.lit(""))
    meeting = is_meeting_file(path, values) & title.isNotNull()
    return F.struct(F.when(url.isNotNull(), "url").when(meeting, "title").alias("identity_kind"), F.coalesce(url, F.when(meeting, title)).alias("identity"))


def file_identity(files: DataFrame) -> DataFrame:
    """Adds identity_kind and identity to files (path, text); a block need not be whole or readable."""
    found = with_frontmatter(files).withColumn("_identity", identity_of(F.col("path"), F.col("frontmatter.values")))
    return found.select(*files.columns, "_identity.identity_kind", "_identity.identity")


def latest_per_identity(transcripts: DataFrame, *ties: str) -> DataFrame:
    """The last fetched transcript of each identity; of equally late ones the first by the named columns."""
    order = Window.partitionBy("identity_kind", "identity").orderBy(F.desc("fetched"), *ties)
    return transcripts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def name_head(name: Column) -> Column:
    """All names that a slug can be given start with it, so those that can meet start alike up to the first hyphen."""
    return F.substring_index(F.regexp_replace(name, r"\.md\z", ""), "-", 1)


def _suffixed() -> Column:
    return F.concat("slug", F.lit("-"), "collision_id")


def _candidate(k: Column) -> Column:
    """The k-th name that a transcript can be given: its slug, with its collision id, and with a number from 2 on."""
    return F.concat(F.when(k == 0, F.col("slug")).when(k == 1, _suffixed()).otherwise(F.concat(_suffixed(), F.lit("-"), k.cast("string"))), F.lit(".md"))


def _asked(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Claims with the name that they ask for, and given: whether it is theirs so far.

    A name that somebody has a file under is for others only after its owner's own turn in the batch;
    of those that may have it, the earliest is given it.
    """
    asked = claims.withColumn("name", _candidate(F.col("k"))).join(held, ["folder", "name"], "left")
    may = F.col("owner").isNull() | (F.col("owner") == F.col("own")) | F.coalesce(F.col("turn") > F.col("owner_turn"), F.lit(False))
    asked = keep(asked.withColumn("may", may).drop("owner", "owner_turn"), "names")
    first = asked.where("may").groupBy("folder", "name").agg(F.min(F.struct("turn", "own"))["own"].alias("earliest"))
    return asked.join(first, ["folder", "name"], "left").withColumn("given", F.coalesce(F.col("may") & (F.col("own") == F.col("earliest")), F.lit(False))).drop("may", "earliest")


def _spread(down: DataFrame, held: DataFrame) -> DataFrame:
    """Of claims that were turned down at their slug, each a k further on among those of the same slug and collision id.

    The n-th of them asks for the n-th name under which nobody has a file for good (held). Both are counted in range
    partitions: neither the claims nor the files of one slug are ever one task's.
    """
    family = F.struct("folder", _suffixed().alias("stem"))
    claims = places(ranged(down.withColumn("family", family), "family", "turn", "own"), "family", "n")
    stem = F.regexp_replace("name", r"\.md\z", "")
    numbered = F.col("name").rlike(NUMBERED)
    number = F.regexp_extract("name", NUMBERED, 2).cast("decimal(38,0)")
    files = held.select("folder", stem.alias("stem"), F.lit(1).cast("long").alias("b"))
    files = files.union(held.where(numbered & (number >= 2) & (number < 10**12)).select("folder", F.regexp_extract("name", NUMBERED, 1), number.cast("long")))
    ours = claims.select("family").distinct()
    blocked = files.select(F.struct("folder", "stem").alias("family"), "b").distinct().join(ours, "family", "left_semi")
    blocked = places(ranged(blocked, "family", "b"), "family", "i")
    # Before the i-th of the blocked numbers b there are b - i free ones: the n-th claim steps over those with b - i < n.
    both = claims.select("family", F.col("n").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("i"), F.struct(*claims.columns).alias("claim"))
    both = both.unionByName(blocked.select("family", (F.col("b") - F.col("i")).alias("at"), F.lit(1).alias("side"), F.col("i").cast("long").alias("i"), F.lit(None).cast(both.schema["claim"].dataType).alias("claim")))
    swept = neighbours(ranged(both, "family", "at", "side", "i"), "family", {"skipped": F.col("i")}).where("side = 0")
    k = F.col("claim.n") + F.coalesce("skipped_before", F.lit(0))
    return swept.select(*[F.col(f"claim.{c}").alias(c) for c in down.columns if c != "k"], k.cast("long").alias("k")).select(*down.columns)


def _given(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Claims (folder, own, slug, collision_id, turn), one for each owner in a folder, with the name that each is given.

    held: (folder, name, owner). All ask at once, the earliest is given a name, the others go on, until
    nobody is turned down: as one after the other, as a name goes to the earliest of those who may have it,
    whoever asks first.
    """
    turns = claims.select("folder", F.col("own").alias("owner"), F.col("turn").alias("owner_turn"))
    held = keep(held.join(turns, ["folder", "owner"], "left").groupBy("folder", "name").agg(F.min_by(F.struct("owner", "owner_turn"), "owner").alias("o")).select("folder", "name", "o.*"), "held")
    holders = held.select("folder", F.col("owner").alias("own")).distinct().withColumn("holds", F.lit(True))
    claims = claims.join(holders, ["folder", "own"], "left").withColumn("holds", F.coalesce("holds", F.lit(False))).withColumn("k", F.lit(0).cast("long"))
    while True:
        asked = keep(_asked(claims, held), "names")
        down = asked.where("not given").drop("name", "given")
        if down.isEmpty():
            return asked.drop("k", "holds", "given")
        stay = asked.where("given").drop("name", "given")
        at_slug = (F.col("k") == 0) & ~F.col("holds")
        step = down.where(~at_slug).withColumn("k", F.col("k") + 1)
        claims = keep(stay.unionByName(step).unionByName(_spread(down.where(at_slug), held.where("owner_turn is null"))), "claims")


def _segments(claims: DataFrame) -> DataFrame:
    """Adds segment: stretches of a folder's turns in which no owner asks twice, each opened by one who asks again."""
    nth = F.row_number().over(Window.partitionBy("folder", "own").orderBy("turn", "slug", "collision_id"))
    placed = ranged(claims.withColumn("again", nth > 1), "folder", "turn", "own", "slug", "collision_id")
    return island_numbers(placed, "folder", F.col("again") | F.col("before").isNull(), ["own"], "segment").drop("again", AT, PART)


def resolve_filenames(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(channel_folder, identity_kind, identity, slug, collision_id, fetched, filename).

    incoming lacks the filename; existing is (channel_folder, filename, identity_kind, identity). A
    transcript takes the first name that is free, its own, or held by a file without an identity, in
    order of fetched and identity; taking another name than it had, it frees that one for those after
    it. Names are asked for in rounds of joins. Those who are turned down at a slug are dealt the free
    names of it at once; transcripts that have files go on name by name. Where an identity asks again in
    a folder, those before it are named first: there is a pass for each time in the folder with most.
    """
    keys, names = ["channel_folder", "head"], ["channel_folder", "identity_kind", "identity", "slug", "collision_id", "fetched"]
    own = F.to_json(F.struct("identity_kind", "identity"))
    # Names that can meet start alike up to the first hyphen.
    turn = F.struct(F.col("fetched").isNull().alias("a"), "fetched", F.col("identity_kind").isNull().alias("b"), "identity_kind", F.col("identity").isNull().alias("c"), "identity", "slug").alias("turn")
    new = incoming.select(*names).withColumn("head", name_head(F.col("slug")))
    claim = [F.struct(*keys).alias("folder"), own.alias("own"), F.col("slug"), F.col("collision_id"), turn]
    claims = keep(new.select(*claim).distinct(), "claims")
    old = existing.where("identity_kind is not null").withColumn("head", name_head(F.col("filename")))
    held = old.select(F.struct(*keys).alias("folder"), F.col("filename").alias("name"), own.alias("owner"))
    last = 0
    if not claims.groupBy("folder", "own").count().where("count > 1").isEmpty():
        claims = keep(_segments(claims), "claims")
        last = claims.agg(F.max("segment")).first()[0]
    told = None
    for segment in range(last + 1):
        now = claims if last == 0 else claims.where(F.col("segment") == segment).drop("segment")
        given = _given(now, held)
        told = given if told is None else told.unionByName(given)
        if segment < last:
            moved = given.select("folder", F.col("own").alias("owner"))
            held = keep(held.join(moved, ["folder", "owner"], "left_anti").unionByName(given.select("folder", "name", F.col("own").alias("owner"))), "held")
    found = told.select(F.struct("folder", "own", "slug", "collision_id", "turn").alias("_claim"), F.col("name").alias("filename"))
    asking = new.select(*names, F.struct(*claim).alias("_claim"))
    return asking.join(found, "_claim").select(*names, "filename")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after incoming: (channel_folder, filename, identity_kind, identity, ...) of both sides.

    An incoming transcript replaces every copy of its identity, wherever it is filed, and whatever
    holds its file name without an identity. A video never replaces a meeting, nor the reverse.
    """
    by_name = ["channel_folder", "filename"]
    kept = existing.join(incoming.select("identity_kind", "identity").where("identity_kind is not null").distinct(), ["identity_kind", "identity"], "left_anti")
    taken = incoming.select(*by_name).distinct()
    kept = kept.join(taken, by_name, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming, allowMissingColumns=True)
