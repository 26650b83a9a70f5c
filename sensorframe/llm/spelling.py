r"""Spelling variants: words one edit apart, found over a reduced alphabet.

The vocabulary is counted over whole texts.  Letters are hashed to a few symbols (by their place in the order of
frequency among the vocabulary, dealt to and fro, so that symbols are about equally frequent).  Two words one edit
apart have reduced words that are equal or one edit apart.  So every reduced word's full neighbourhood (itself, all
deletions, all replacements and all insertions of a symbol) is looked up among the reduced words of the vocabulary, and
the words met are verified by their edit distance.  The number of symbols follows the size of the vocabulary, so the
words that share a reduced word stay few.

Words over ``LONGEST`` letters would have neighbourhoods as large as themselves, squared.  For two of them one edit
apart, the first or the last ``HALF`` letters agree; they are looked up by these, and verified all the same.

Each task counts its words before anything is shuffled, so a word that every document holds is a few rows.  Forms are
followed by pointer doubling over stored tables.  All work on the vocabulary is done by joins; the driver gets the
letters (at most 122) and counts.

Words: maximal runs of ``[A-Za-zÀ-ÿ]``, with only A-Z lower-cased.  Where ``slips`` divides the unsigned
CRC-32 ``h`` of ``<doc_id>:<run>``, the run's letter ``h % length`` is left out.

Defined results: null and empty texts hold no words; a null ``doc_id`` counts as an empty string.  Every row counts,
repeated ones too.  A word without a near word has ``n_near`` 0, no form, and is its own root.  Of near words with
equal counts the smallest in code-point order is the form.  An empty table, or one without frequent words, returns
nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize, texts_of

LEAST_LETTERS, LEAST_COUNT, RATIO, SLIPS = 6, 5, 5, 199
LONGEST, HALF = 64, 32
WORDS_HELD = 100_000
# Symbols of reduced words; any distinct characters do.
SYMBOLS = "0123456789abcdef"


def _counts(letters: int, slips: int):
    """Per task, the words of at least ``letters`` letters with their counts."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            held = [(w, n) for w, n in total.items() if n and len(w) >= letters]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.string()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                found = run_of.findall(text.lower().decode("utf-8", "replace")) if text else None
                if not found:
                    continue
                total.update(found)
                counts = Counter(found)
                words = list(counts)
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for word, raw in zip(words, " ".join(words).encode().split(b" "), strict=True):
                    h = crc32(raw, start)
                    if not h % slips:
                        at, n = h % len(word), counts[word]
                        total[word] -= n
                        total[word[:at] + word[at + 1 :]] += n
                if len(total) > WORDS_HELD:
                    yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """``word, n`` of the words of ``docs`` (``doc_id``, ``text``) that are long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(_counts(letters, slips), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def symbols_for(words: int) -> int:
    """How many symbols keep the words that share a reduced word of eight letters few."""
    return min(len(SYMBOLS), max(4, -int(-((words / 8) ** 0.125) // 1)))


def reduction(words: DataFrame, symbols: int) -> tuple[str, str]:
    """Letters of the vocabulary, and the symbol of each, for ``translate``."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    found = [r.letter for r in letters.orderBy(F.desc("n"), "letter").collect()]
    order = SYMBOLS[:symbols] + SYMBOLS[:symbols][::-1]
    return "".join(found), "".join(order[i % len(order)] for i in range(len(found)))


def neighbourhood(word: Column, symbols: str) -> Column:
    """Hashes of a word over ``symbols`` and of all words one edit from it."""
    some = F.array(*(F.lit(s) for s in symbols))
    size = F.length(word)

    def changed(i: Column, skip: int) -> Column:
        """The word with each symbol put before its letter ``i``, of which ``skip`` are left out."""
        head, tail = F.substring(word, F.lit(1), i - 1), F.substring(word, i + skip, size)
        return F.transform(some, lambda s: F.xxhash64(F.concat(head, s, tail)))

    deleted = F.transform(F.sequence(F.lit(1), size), lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size))))
    replaced = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: changed(i, 1)))
    inserted = F.flatten(F.transform(F.sequence(F.lit(1), size + 1), lambda i: changed(i, 0)))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), deleted, replaced, inserted))


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """Pairs ``word, n, near, near_n`` one edit apart, in both directions, of stored ``words`` (``word``, ``n``)."""
    symbols = symbols or symbols_for(words.count())
    letters, signs = reduction(words, symbols)
    size = F.length("word")
    reduced = words.withColumn("reduced", F.translate("word", letters, signs))
    short, other = reduced.where(size <= LONGEST + 1), [F.col("word").alias("near"), F.col("n").alias("near_n")]
    asks = short.select("word", "n", F.explode(neighbourhood(F.col("reduced"), SYMBOLS[:symbols])).alias("code"))
    held = short.select(F.xxhash64("reduced").alias("code"), *other)
    one_edit = F.levenshtein("word", "near", 1) == 1
    columns = ["word", "n", "near", "near_n"]
    pairs = asks.join(held, "code").where(one_edit & (F.least(F.length("word"), F.length("near")) <= LONGEST)).select(*columns)
    long, head = words.where(size > LONGEST), F.substring("word", 1, HALF)
    for end in (head, F.substring("word", -HALF, HALF)):
        found = long.select("word", "n", end.alias("end")).join(long.select(end.alias("end"), *other), "end").where(one_edit)
        pairs = pairs.union((found if end is head else found.where(head != F.substring("near", 1, HALF))).select(*columns))
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form; a form is more frequent than its word, so chains end."""
    now = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(
    docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, slips: int = SLIPS, symbols: int | None = None
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every frequent word of ``docs``."""
    words = materialize(vocabulary(docs, letters, least, slips), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    far = -F.col("best.n") >= ratio * F.col("n")
    forms = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SPELLING_SQL = r"""
    WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
    counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS c FROM runs GROUP BY doc_id, run),
    coded AS (SELECT run, c, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))) AS bytes FROM counted),
    hashed AS (SELECT run, c, xor(4294967295, list_reduce(bytes, lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)]))) AS h FROM coded, tab),
    slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, c FROM hashed),
    words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.less
      UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.less),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
        CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
    chain AS (SELECT word, word AS last FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.last AS root FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.last AND e.form IS NULL"""
