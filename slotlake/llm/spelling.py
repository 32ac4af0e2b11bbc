"""Spelling variants: words of a corpus one edit apart, and the common form each leads to.

A relational trie frontier finds the neighbours. A state is (text, position, node, edits): so much of a word is read,
and that node of a trie of all words is reached, with none or one edit. States without an edit walk the path of
their own word, so the edges of a level are an aggregate of them: per node and next letter, the longest
prefix that all words share from there. Level by level the states are joined with the level's edges, and a
state with one edit that ends where a word ends is a neighbour. An edge may hold many letters, so very long
words need few levels.

Every word is in the trie twice, as it is and mirrored, and takes its edit in the second half only, where a
node has few edges. Of two words of different length the longer one finds the shorter, so no state inserts. Edges of
upper levels are few and reach every task by broadcast, if Catalyst finds them small; below, nodes are
many and shared by few words, and both sides are shuffled. The loop ends when no state is left.

A null text has no words. Equal rows count each. No rows give no words. A null id is written as nothing where the id
counts. Other columns of the documents are left behind.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.llm.common import freeze, keyed_text

#: Letters of a word, in UTF-8 with A to Z in lower case; different words a task holds before it hands them on.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
HELD = 1 << 19


def misspelt(run: bytes, h: int) -> bytes:
    """Without one of its letters, the one that ``h`` falls on."""
    letters = run.decode()
    place = h % len(letters)
    return (letters[:place] + letters[place + 1:]).encode()


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, noise: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: words of at least ``shortest`` letters that occur at least ``least`` times.

    With ``noise``, a word of a document loses a letter where ``noise`` divides the CRC-32 of ``id:word``.
    Words are counted in each task first.
    """
    def run(batches):
        counts: Counter[bytes] = Counter()

        def table():
            out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()),
                                              "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                key = zlib.crc32(b"%s:" % ("" if doc_id.as_py() is None else str(doc_id.as_py())).encode())
                for word, n in Counter(RUN.findall(text.as_py().encode().lower())).items():
                    if noise and (h := zlib.crc32(word, key)) % noise == 0:
                        word = misspelt(word, h)
                    # a letter beyond ASCII has two bytes, the first of them C3
                    if len(word) - word.count(b"\xc3") >= shortest:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield table()
        yield table()

    counted = keyed_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _shared(a: Column, b: Column) -> Column:
    """Length of the longest prefix of two texts, by halving."""
    most = F.least(F.length(a), F.length(b))
    longer = lambda n, step: F.when(
        (n + step <= most) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), F.lit(0), longer)


def _edges(states: DataFrame) -> DataFrame:
    """Edges of the nodes that words have reached: ``node``, ``head``, ``label``, and whether a word ends behind it."""
    rest = F.col("text").substr(F.col("position") + 1, F.length("text"))
    groups = states.where("edits = 0").select("node", rest.alias("rest")).groupBy("node", F.substring("rest", 1, 1).alias("head"))
    ends = groups.agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    # the first and the last of them in order share what all of them share
    shared = F.when(F.col("low") == F.col("high"), F.length("low")).otherwise(_shared(F.col("low"), F.col("high")))
    return ends.withColumn("label", F.col("low").substr(F.lit(1), shared)).select(
        "node", "head", "label", (F.col("label") == F.col("low")).alias("ends"))


def _next_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States behind the edges: each letter as it is, or, if none was, one of them replaced or left out."""
    s, e = states.drop("ends").alias("s"), edges.alias("e")
    length = F.length("label")
    read = lambda more: F.col("text").substr(F.col("position") + 1, length + more)
    moved = lambda more, edits: [F.col("text"), (F.col("position") + length + more).alias("position"),
                                 F.concat("e.node", "label").alias("node"), edits.cast("int").alias("edits"), F.col("ends")]
    head = F.col("text").substr(F.col("position") + 1, F.lit(1))
    same = s.join(e, (F.col("s.node") == F.col("e.node")) & (head == F.col("head")) & (read(F.lit(0)) == F.col("label")))
    # words carry a sign of their direction in front; a mirrored word leaves the middle letter to the other
    half = F.floor((F.length("text") - 1 + F.when(F.col("text").startswith("<"), 1).otherwise(0)) / 2)
    late = F.col("position") - 1 + length >= half
    other = s.where("s.edits = 0").join(e, (F.col("s.node") == F.col("e.node")) & late)
    more = F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda m: (
        F.length(read(m)) == length + m) & (F.levenshtein(read(m), F.col("label"), 1) == 1)))
    edited = other.select("*", more.alias("more")).select(*moved(F.col("more"), F.lit(1)))
    return same.select(*moved(F.lit(0), F.col("edits"))).unionByName(edited)


def _word(text: str) -> Column:
    plain = F.expr(f"substring({text}, 2)")
    return F.when(F.col(text).startswith("<"), F.reverse(plain)).otherwise(plain)


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``near``: all pairs of different words of the column ``word`` one edit apart, in both orders."""
    start = words.where("word <> ''").select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("text"))
    states = freeze(start.select("text", F.lit(1).alias("position"), F.substring("text", 1, 1).alias("node"),
                                 F.lit(0).alias("edits"), F.lit(False).alias("ends")), "frontier")
    left = F.length("text") - F.col("position")
    found = None
    while not states.where(left > 0).isEmpty():
        open_states = states.where(left > 0)
        states = freeze(_next_level(open_states, freeze(_edges(open_states), "edges")), "frontier")
        # one edit and nothing left, or a last letter that is left out
        pairs = states.where(F.col("ends") & (left + F.col("edits") == 1)).select(_word("text").alias("word"), _word("node").alias("near"))
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = words.select("word", F.col("word").alias("near")).limit(0)
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every row of ``words`` (``word``, ``n``), words being distinct.

    The form is the neighbour that occurs most (of several the smallest), if ``ratio`` times as often; the root is
    where forms of forms end. Each step of the search for roots doubles the way that all words have gone.
    """
    words = freeze(words.select("word", "n"), "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    forms = words.join(best, "word", "left")
    often = F.col("near_n") >= ratio * F.col("n")
    forms = freeze(forms.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("near")).alias("form"),
                                F.when(often, F.col("near_n")).alias("form_n")), "forms")
    roots, left = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), True
    while left:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = freeze(roots.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        left = not roots.where("moved").isEmpty()
    return forms.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
