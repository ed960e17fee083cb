"""Spelling variants: words one edit apart, found through one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols.  If two words differ by one edit, so do their reduced forms, or these are alike.  The
full one-edit neighbourhood of a reduced word is therefore joined with the reduced vocabulary, and every pair found is
verified on the words themselves.  With 8 symbols the neighbourhood of a word of 9 letters has some 150 forms instead of
some 600 over the letters of the texts.  Each pair is needed from one end only, so a word generates its own form, all
deletions, and the replacements by a larger symbol; insertions and the other replacements are the same pairs seen from the
other word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import shuffle_tasks, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
SYMBOLS = 8
DROP_ONE_IN = 31


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """Written table ``word, n``: runs of letters of whole texts, A-Z lower-cased, at least ``min_length`` long and ``min_count`` frequent.

    Of every run whose crc32 of ``<doc_id>:<run>`` is divisible by ``drop_one_in`` the code point at crc32 % length goes.
    Shorter runs cannot give such a word, so they are not extracted at all.
    """
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1)))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run"))
    lower = found.select(F.translate("run", UPPER, LOWER).alias("run"), "doc")
    marked = lower.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = marked.withColumn("at", at).select(F.when(F.col("h") % drop_one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    # the length is tested after writing: as a filter below the aggregate it would compute every word twice
    return written(counted, "spelling_words").filter(F.length("word") >= min_length)


def symbol_of(letter: int, symbols: int = SYMBOLS) -> int:
    """The symbol of a code point, by a multiplicative hash."""
    return (letter * 2654435761 >> 8) % symbols


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """A word of letters over the reduced alphabet (digits)."""
    letters = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
    return F.translate(word, "".join(map(chr, letters)), "".join(str(symbol_of(c, symbols)) for c in letters))


def neighbourhood(form: str, symbols: int = SYMBOLS) -> Column:
    """Array of distinct reduced forms: the form itself, its deletions, its replacements by larger symbols."""
    deleted = f"transform(sequence(1, length({form})), i -> concat(substring({form}, 1, i - 1), substring({form}, i + 1)))"
    replaced = (f"flatten(transform(sequence(1, length({form})), i -> transform(filter(sequence(1, {symbols - 1}), s -> s > int(substring({form}, i, 1))), "
                f"s -> concat(substring({form}, 1, i - 1), string(s), substring({form}, i + 1)))))")
    return F.expr(f"array_distinct(concat(array({form}), {deleted}, {replaced}))")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``a, an, b, bn``: every unordered pair of words (``word, n``) one inserted, deleted or replaced code point apart, once.

    Neighbours and vocabulary meet under a 64-bit hash of the reduced form; the edit distance on the words decides inside
    the join, so only true pairs leave it.  A frequent form is one key; Spark splits its partition where it is skewed.  The
    vocabulary is the side that tasks hold, a partition each; the neighbourhoods, some 50 times as many, stream past it.
    """
    forms = words.withColumn("form", reduced(F.col("word"), symbols))
    # a small file of words makes very many neighbours: spread it first
    left = forms.repartition(shuffle_tasks(words.sparkSession), "word").select(F.col("word").alias("a"), F.col("n").alias("an"), "form", F.explode(neighbourhood("form", symbols)).alias("near"))
    left = left.select("a", "an", F.xxhash64("near").alias("key"), (F.col("near") == F.col("form")).alias("own"))
    right = forms.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.xxhash64("form").alias("key")).hint("shuffle_hash")
    # words with the same form meet in both orders
    once = ~F.col("own") | (F.col("a") < F.col("b"))
    return left.join(right, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for a table ``word, form``: follow forms to the last.

    Each step at least multiplies n by the wanted ratio, so chains are short; following goes by doubling, one written
    table a round, until no row moves.
    """
    current = written(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        nxt = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = current.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        current = written(moved, "spelling_roots")
        if current.filter("moved").isEmpty():
            return current.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, drop_one_in: int = DROP_ONE_IN,
                      symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts (``doc_id, text``).

    Near words differ by exactly one code point inserted, deleted or replaced.  ``form`` is the near word of largest n (ties:
    the smallest in code-point order) if that n is at least ``ratio`` (above 1) times the word's own, else null; ``form_n``
    its n; ``root`` the end of the chain of forms, the word itself without one; ``n_near`` the number of near words.  Null
    texts have no words, a null doc_id counts as an empty one, repeated rows count each.  An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, or forms could follow each other in a circle")
    words = word_counts(docs, min_length, min_count, drop_one_in)
    pairs = near_pairs(words, symbols)
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("bn").alias("m"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("an").alias("m"), F.col("a").alias("other")))).alias("e")
    best = pairs.select(ends).groupBy("e.word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("e.m")).alias("less"), F.col("e.other").alias("other"))).alias("best"))
    judged = words.join(best, "word", "left").withColumn("enough", -F.col("best.less") >= ratio * F.col("n"))
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                   F.when(F.col("enough"), F.col("best.other")).alias("form"), F.when(F.col("enough"), -F.col("best.less")).alias("form_n")),
                     "spelling_forms")
    chains = roots(judged.filter("form is not null").select("word", "form"))
    return judged.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
