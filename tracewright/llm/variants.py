"""Spelling variants: words at one edit's distance, found through an index of variable-length grams.

Grams that occur in few words stay short; frequent ones are extended, so that no list below the longest size is long. A
word is the sequence of its longest grams that no other holds. An edit at a given place can change only the grams over
that place and those behind it that a longer gram could now cover; all other grams of both words must be the same, at the
same distance from the nearer end. So the lists of exactly these grams are intersected, place by place, and what meets
there is compared as text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths of grams, over words with a mark at either end.
SHORT, LONG = 2, 4
#: A gram is extended if more words than this hold it; and at most so many grams are told to the tasks.
FREQUENT, MOST = 32, 100_000
START, END = "\x02", "\x03"


def letter_runs(text: str = "text") -> Column:
    """Maximal runs of letters, A-Z in lower case; null: none."""
    return F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))


def drop_letter(word: Column, at: Column) -> Column:
    """word without its code point number `at`, from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2, F.length(word)))


def count_words(runs: DataFrame, word: str = "word", min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least min_length code points that occur at least min_count times; null words don't count.

    Counts are combined before the shuffle, so a very common word is one row a task.
    """
    long = runs.select(F.col(f"`{word}`").alias("word")).where(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, most: int = MOST, longest: int = LONG) -> frozenset[str]:
    """Grams shorter than `longest` that more than `frequent` words hold, or so many that at most `most` grams remain.

    Every prefix of such a gram is one too. All other grams that a word may be parted into follow from these.
    """
    marked = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("w"))
    of = lambda q: F.transform(F.sequence(F.lit(1), F.length("w") - q + 1), lambda i: F.substr(F.col("w"), i, F.lit(q)))
    sizes = [of(q) for q in range(SHORT, longest)]
    if not sizes:
        return frozenset()
    counts = materialize(marked.select(F.explode(F.array_distinct(F.concat(*sizes))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "variant-grams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # of counts over total / most there are fewer than most
    return frozenset(r["gram"] for r in counts.where(F.col("n") > max(frequent, total // most)).select("gram").toLocalIterator())


def decompose(word: str, hot: frozenset[str], longest: int = LONG) -> list[tuple[int, int]]:
    """(first, last) place of the grams of a marked word: the longest at each place, without those inside an earlier one."""
    out, n, reach = [], len(word), -1
    for p in range(n - SHORT + 1):
        e = p + SHORT
        while e < n and e - p < longest and word[p:e] in hot:
            e += 1
        if e - 1 > reach:
            reach = e - 1
            out.append((p, reach))
    return out


def suffixes(hot: frozenset[str]) -> frozenset[str]:
    """What a frequent gram that begins further left can end with."""
    return frozenset(g[i:] for g in hot for i in range(1, len(g)))


def kept_grams(word: str, grams: list[tuple[int, int]], at: int, behind: int, ends: frozenset[str]) -> list[tuple[int, int]]:
    """The grams that no edit between the places at and behind changes: word[:at] and word[behind:] stay as they are.

    Grams before the edit depend on nothing behind them. One behind it vanishes only if a gram from before could reach
    its end, that is if some frequent gram ends with all that lies between the edit and its last letter.
    """
    return [(p, e) for p, e in grams if e < at or (p >= behind and word[behind:e] not in ends)]


def affected_bound(word: str, hot: frozenset[str], longest: int = LONG) -> int:
    """The most grams of a word that one edit can change; two words an edit apart share all others of either."""
    marked = START + word + END
    grams, ends = decompose(marked, hot, longest), suffixes(hot)
    spans = [(i, i + 1) for i in range(1, len(word) + 1)] + [(i, i) for i in range(1, len(word) + 2)]
    return max(len(grams) - len(kept_grams(marked, grams, i, j, ends)) for i, j in spans)


def index_keys(word: str, hot: frozenset[str], ends: frozenset[str], longest: int = LONG) -> Iterator[tuple[str, int, int]]:
    """(kind, place, key) of every single edit of word: a key stands for the grams that the edit leaves as they are.

    Kinds: s replaces the letter at place, d deletes it (of equal neighbours the first), i inserts one before it. The two
    words of a replacement share an s key, those of the others an i key of the shorter and a d key of the longer.
    """
    marked, n = START + word + END, len(word)
    grams = decompose(marked, hot, longest)
    edits = [("s", "s", i, i + 1, n) for i in range(1, n + 1)] + [("i", "x", i, i, n) for i in range(1, n + 2)]
    edits += [("d", "x", i, i + 1, n - 1) for i in range(1, n + 1) if marked[i] != marked[i - 1]]
    for kind, side, at, behind, shorter in edits:
        kept = kept_grams(marked, grams, at, behind, ends)
        told = [side, str(shorter), str(at)] + [f"{p if e < at else p - behind}{'<' if e < at else '>'}{marked[p:e + 1]}" for p, e in kept]
        yield kind, at, int.from_bytes(hashlib.blake2b("\x01".join(told).encode(), digest_size=8).digest(), "little", signed=True)


def near_pairs(words: DataFrame, frequent: int = FREQUENT, most: int = MOST, longest: int = LONG) -> DataFrame:
    """(a, a_n, b, b_n) of all words of (word, n) that differ by one inserted, deleted or replaced code point; each pair once.

    A pair meets at the one place of its edit, so none is found twice. Words are distinct and not null.
    """
    hot = gram_dictionary(words, frequent, most, longest)
    ends = suffixes(hot)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, at, key, w, n) for w, n in zip(part["word"], part["n"]) for k, at, key in index_keys(w, hot, ends, longest)]
            yield pd.DataFrame(rows, columns=["kind", "at", "key", "word", "n"])
        release()

    # words are few bytes, so Spark would read them in few tasks
    dealt = words.select("word", "n").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    index = materialize(dealt.mapInPandas(work, "kind string, at int, key long, word string, n long"), "variant-index")
    side = lambda kind, x: index.where(F.col("kind") == kind).select("key", *[F.col(c).alias(f"{x}{c}") for c in ("at", "word", "n")])
    before = lambda w, at: F.substr(F.col(w), F.lit(1), F.col(at) - 1)
    behind = lambda w, at, skip: F.substr(F.col(w), F.col(at) + skip, F.length(w))
    same = (F.col("a_at") == F.col("b_at")) & (before("a_word", "a_at") == before("b_word", "b_at"))
    replaced = side("s", "a_").join(side("s", "b_"), "key").where(same & (F.col("a_word") < F.col("b_word")) & (behind("a_word", "a_at", 1) == behind("b_word", "b_at", 1)))
    inserted = side("i", "a_").join(side("d", "b_"), "key").where(same & (behind("a_word", "a_at", 0) == behind("b_word", "b_at", 1)))
    both = [F.col(c).alias(o) for c, o in (("a_word", "a"), ("a_n", "a_n"), ("b_word", "b"), ("b_n", "b_n"))]
    return replaced.select(both).unionByName(inserted.select(both))


def group_variants(words: DataFrame, ratio: int = 5, frequent: int = FREQUENT, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n).

    form is the near word of largest n (ties: the first by code point), if its n is at least `ratio` times the word's;
    root is where forms lead to in the end, the word itself if it has none. Forms grow by the ratio, so chains are short.
    No words: no rows. Columns other than word and n don't matter.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1")
    words = materialize(words.select("word", "n"), "variant-words")
    pairs = near_pairs(words, frequent, most)
    met = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("b_n").alias("o_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("a_n").alias("o_n")))).alias("x")).select("x.*")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("m"), F.col("o").alias("o"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("ok", F.coalesce(-F.col("best.m") >= F.col("n") * ratio, F.lit(False)))
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("best.o")).alias("form"), F.when(F.col("ok"), -F.col("best.m")).alias("form_n")), "variant-forms")
    step = materialize(known.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if not step.where("moved").limit(1).count():
            break
        step = step.drop("moved")
    return known.join(step.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(docs: DataFrame) -> DataFrame:
    """(word) of the letter runs of documents; one distinct run of a document in 199 has lost a letter, by its checksum."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(letter_runs()).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    hashed = runs.where(F.length("run") >= 6).select("run", h.alias("h"))
    return hashed.select(F.when(F.col("h") % 199 == 0, drop_letter(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run")).alias("word"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_variants(count_words(misspelt(docs)))


def _crc_table() -> list[int]:
    """Entry i: the checksum's state after one byte i, without the inversions before and after."""
    return [zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)]


SQL = r"""
WITH r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT d, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY d, run),
b AS (SELECT run, c, list_transform(range(0, strlen(d || ':' || run)), lambda i: CAST('0x' || substr(hex(d || ':' || run), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM u),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda x, y: xor(x >> 8, ({table})[(xor(x, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM b),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
p AS (SELECT a.word, b.word AS o, b.n AS o_n FROM s a JOIN s b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT s.word, w.word, w.n FROM s JOIN w ON s.rest = w.word UNION SELECT w.word, s.word, s.n FROM s JOIN w ON s.rest = w.word),
g AS (SELECT word, count(*) AS n_near, max(o_n) AS m FROM p GROUP BY word),
f AS (SELECT g.word, min(p.o) AS form FROM g JOIN p ON g.word = p.word AND g.m = p.o_n GROUP BY g.word),
k AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN form END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
      FROM w LEFT JOIN g ON w.word = g.word LEFT JOIN f ON w.word = f.word),
c AS (SELECT word, word AS root, 0 AS steps FROM k UNION ALL SELECT c.word, k.form, steps + 1 FROM c JOIN k ON c.root = k.word WHERE k.form IS NOT NULL)
SELECT k.word, k.form, e.root, k.n, CAST(k.n_near AS BIGINT) AS n_near, CAST(k.form_n AS BIGINT) AS form_n
FROM k JOIN (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word) e ON k.word = e.word
"""


def sql() -> str:
    text = SQL.replace("{upper}", UPPER).replace("{lower}", LOWER).replace("{table}", str(_crc_table())).strip()
    return text.replace("WITH r", "WITH RECURSIVE r", 1)
