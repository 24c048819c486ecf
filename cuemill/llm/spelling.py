"""Spelling variants: words one edit apart, found by a frontier of states over a relational trie.

The trie is a table of edges (node, character, child). A state is (word, position, node, edits): so
many characters of the word read, at that node, with that many edits. Round by round the states are
joined with the edges: a character that is the word's own goes on, another one is a replacement or
an insertion, and a state with an edit only follows the rest of its word. A state with one edit that
ends where a word ends is a neighbour. A deletion is the insertion of the other word.

Edits in the second half of a word are looked for in the trie of the words, those in the first half
in the trie of the words reversed, so that no state branches near a root, where all words meet. An
edge tells which characters can follow it, and where a single word lies below it, which: states are
dropped or settled at once, and there are as many rounds as words share characters past their half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import keep

#: Fixed values.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISSPELT, LEAST_LETTERS, LEAST_TIMES, OUTWEIGHS = 199, 6, 5, 5
FORWARD, BACKWARD = 0, 1


def _lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Where nothing else has a lower case, the usual function, which is faster, does the same."""
    return F.when(text.rlike("[^\\x00-\\x7F\\u00DF-\\u00FF]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(id, run): the lower-cased runs of letters of whole texts that are long enough to give a word. A null text has none."""
    return docs.select(docs[id_col].alias("id"), F.explode(F.regexp_extract_all(_lowered(docs[text_col]), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))


def misspelt(run: Column, doc_id: Column, every: int = MISSPELT) -> Column:
    """The run, without one of its letters where the checksum of document and run says so. A null id is an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words of a column `word` that are long and frequent enough."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def _node(side: Column, prefix: Column) -> Column:
    """The node of a prefix. Two prefixes that should meet in one number share their edges; words found over it are held against the table at the end."""
    return F.xxhash64(side, prefix)


def _bit(text: Column, place: Column) -> Column:
    """A bit for the character at a place, from 1; of different characters mostly a different one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(F.substring(text, place, F.lit(1))).bitwiseAND(F.lit(63)))


def _sides(words: DataFrame) -> DataFrame:
    """(side, word, half): each word, and each word reversed, with how many characters lie before the edits to look for there."""
    half = F.floor(F.length("word") / 2).cast("int")
    forward = words.select(F.lit(FORWARD).alias("side"), "word", half.alias("half"))
    return forward.unionByName(words.select(F.lit(BACKWARD).alias("side"), F.reverse("word").alias("word"), (F.length("word") - half).alias("half")))


def edges(words: DataFrame, least: int) -> DataFrame:
    """(node, char, child, below, follow, ends, only) of both tries, from the depth on where edits begin.

    below: words below the child; follow: bits of the characters that go on from it; ends: whether a
    word ends there; only: the node of a word below it, for where it is the only one. A node with a
    single word below it has no edges: who comes there is settled on the way.
    """
    length, place = F.length("word"), F.col("depth") + 1
    rows = _sides(words).select("side", "word", F.explode(F.sequence(F.lit(least), length)).alias("depth"))
    rows = rows.select(
        _node(F.col("side"), F.substring("word", F.lit(1), F.col("depth"))).alias("node"),
        F.substring("word", place, F.lit(1)).alias("char"),  # empty where the word ends
        F.when(F.col("depth") < length, _node(F.col("side"), F.substring("word", F.lit(1), place))).alias("child"),
        F.when(place < length, _bit(F.col("word"), place + 1)).otherwise(0).alias("follow"),
        (place == length).alias("ends"),
        _node(F.col("side"), F.col("word")).alias("only"),
    )
    one = rows.groupBy("node", "char").agg(F.max("child").alias("child"), F.count(F.lit(1)).alias("below"), F.bit_or("follow").alias("follow"), F.max("ends").alias("ends"), F.max("only").alias("only"))
    shared = one.groupBy("node").agg(F.sum("below").alias("words")).where("words > 1").select("node")
    return one.where("char != ''").join(shared, "node")


def _advance(states: DataFrame, trie: DataFrame) -> DataFrame:
    """States (side, word, position, node, edits, found) one edge on, with done where a neighbour is found: that is `found`.

    found is the word that the state spells so far and will if it goes on without another edit.
    """
    depth = F.col("position") + F.length("found") - F.length("word")
    cut = lambda column, start, *length: F.substring(F.col(column), start, length[0] if length else F.length(column))
    own, rest, before = cut("word", F.col("position") + 1, F.lit(1)), cut("word", F.col("position") + 1), cut("word", F.lit(1), F.col("position"))
    step = lambda found, ahead, edits: F.struct(found.alias("found"), (F.col("position") + ahead).alias("position"), F.lit(edits).alias("edits"))
    exact, char = F.col("edits") == 0, F.col("char")
    goes_on = F.when(~exact, step(F.col("found"), 1, 1)).when(char == own, step(F.col("found"), 1, 0))
    inserted = F.when(exact & (char != own), step(F.concat(before, char, rest), 0, 1))
    # Of two words that differ by a replacement, the one with the smaller character finds the other.
    replaced = F.when(exact & (own != "") & (char > own), step(F.concat(before, char, cut("word", F.col("position") + 2)), 1, 1))
    met = states.withColumn("depth", depth).join(trie.withColumnRenamed("node", "at"), F.col("node") == F.col("at"))
    met = met.where(exact | (char == cut("found", F.col("depth") + 1, F.lit(1))))
    moved = met.select("side", "word", "child", "below", "follow", "ends", "only", (F.col("depth") + 1).alias("depth"), F.explode(F.array(goes_on, inserted, replaced)).alias("s")).where("s is not null")
    moved = moved.select("side", "word", F.col("child").alias("node"), "below", "follow", "ends", "only", "depth", "s.*")
    spelt = F.col("depth") == F.length("found")
    follows = F.col("follow").bitwiseAND(_bit(F.col("found"), F.col("depth") + 1)) != 0
    alone = F.col("below") == 1
    done = (F.col("edits") == 1) & F.when(spelt, F.col("ends")).otherwise(alone & (F.col("only") == _node(F.col("side"), F.col("found"))))
    alive = ~alone & ((F.col("edits") == 0) | (~spelt & follows))
    return moved.where(done | alive).select("side", "word", "position", "node", "edits", "found", done.alias("done"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): words of a table (word, ...), none twice, that differ by one inserted, deleted or replaced code point; both ways round."""
    least = words.agg(F.min(F.floor(F.length("word") / 2))).first()[0]
    if least is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    trie = keep(edges(words, int(least)), "edges")
    states = _sides(words).select("side", "word", F.col("half").alias("position"), _node(F.col("side"), F.substring("word", F.lit(1), F.col("half"))).alias("node"), F.lit(0).alias("edits"), F.col("word").alias("found"))
    pairs = None
    while pairs is None or not states.isEmpty():
        moved = keep(_advance(states, trie), "frontier")
        found = moved.where("done").select("side", "word", "found")
        pairs = found if pairs is None else pairs.unionByName(found)
        states = moved.where("not done").drop("done")
    turned = lambda c: F.when(F.col("side") == BACKWARD, F.reverse(c)).otherwise(F.col(c))
    ends = pairs.select(turned("word").alias("a"), turned("found").alias("b"))
    both = keep(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    # A word that is not there would be two prefixes of one number.
    return both.join(words.select(F.col("word").alias("b")), "b").join(words.select(F.col("word").alias("a")), "a").select(F.col("a").alias("word"), F.col("b").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form): from form to form to the last. Each round doubles the steps."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ones = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = keep(now.join(next_ones, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def group_variants(words: DataFrame, outweighs: int = OUTWEIGHS) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of words (word, n), none of them twice or null.

    A word's form is its most frequent near word (of equally frequent ones the first in code-point
    order) if that is so many times as frequent; its root is the last of its form's forms. Words of
    any length are read whole; no words give no rows; other columns of the table are left out.
    """
    words = keep(words.select("word", "n"), "words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * outweighs
    told = keep(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(told.where("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`group_variants` of the words of documents, some of them misspelt by rule.

    Null and empty texts have no words, texts of any length are read whole, repeated rows count each
    by itself, and columns of other names do not matter.
    """
    found = runs(docs, id_col, text_col)
    return group_variants(vocabulary(found.select(misspelt(F.col("run"), F.col("id")).alias("word"))))
