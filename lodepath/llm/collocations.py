"""Phrase collocations by PCY and DHP: buckets of the next length are counted while a length is counted exactly.

Pass k reads the texts once. It counts phrases of k words exactly, but only those that can be frequent: their bucket was full in
the pass before (PCY), and both phrases of k - 1 words in them are frequent (Apriori). In the same pass the phrases of k + 1
words, whose two halves passed the filter, are hashed into buckets for the next one (DHP). What reaches the driver and is
broadcast are two bitmaps of fixed size, whatever the input; filters that let too much through cost time and no result,
as counting is by the phrases themselves. Bucket counters stop at the threshold, so a byte holds each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, discard, stored, trimmed
from lodepath.llm.words import coded_words

#: A phrase is frequent from LEAST occurrences on; phrases have up to LONGEST words; TOP phrases of each language are listed.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of a bucket's number and of a place in the bitmap of frequent phrases: 16 MB of counters in a task, 2 MB and 8 MB broadcast.
BUCKET_BITS, FREQUENT_BITS = 24, 26
#: Bytes of counters or bitmap in a row of a shuffle, and of text that a task counts at once.
BLOCK, CHUNK = 1 << 13, 8 << 20
#: Parts that rank each language's phrases before its best meet.
PARTS = 64

_BYTES = {**{c: 10 for c in b".,;:!?\x0a\x0b\x0c\x0d"}, 9: 32, **{c: c + 32 for c in range(65, 91)}}
#: Lower-cases A-Z, makes every end of a piece a line feed and every other gap a space.
TABLE = bytes(_BYTES.get(c, c) for c in range(256))
PARTIAL = "lang string, phrase string, n long, block int, bytes binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def joined(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last and of the last."""
    return mixed(head * np.uint64(0x9E3779B97F4A7C15) + last)


def word_hashes(words: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], np.uint64)


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def place(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Phrases:
    """The phrases of some texts: hashes by length, and which lie within a piece."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        words, self.codes, at, line, starts = coded_words(texts, TABLE)
        self.words = words.to_pylist()
        self.piece = np.searchsorted(np.flatnonzero(line == 10), starts)
        self.langs, lang = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.empty(0, object), np.empty(0, np.int64))
        self.lang = np.repeat(lang, np.diff(at))
        by_word, by_lang = word_hashes(self.words, self.langs.tolist())
        self.one = mixed(by_word[self.codes] ^ by_lang[self.lang]) if len(self.codes) else np.empty(0, np.uint64)

    def hashes(self, k: int) -> np.ndarray:
        h = self.one
        for j in range(1, k):
            h = joined(h[:-1], self.one[j:])
        return h

    def inside(self, k: int) -> np.ndarray:
        n = max(len(self.codes) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def counts(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """Exact counts of the phrases of k words that begin at `at`; a phrase is known by its words, not by a hash."""
        size = max(len(self.words), 1)
        key, first = self.lang[at] * size + self.codes[at], None
        for j in range(1, k):
            key = np.unique(key, return_inverse=True)[1] * size + self.codes[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        columns = [self.codes[at + j].tolist() for j in range(k)]
        text = [b" ".join(x) for x in zip(*[[self.words[c] for c in column] for column in columns])]
        phrases = pa.array(text, pa.binary()).cast(pa.string())
        langs = pa.array(self.langs[self.lang[at]].tolist(), pa.string())
        return pa.RecordBatch.from_arrays([langs, phrases, pa.array(n), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["lang", "phrase", "n", "block", "bytes"])


def blocks(line: np.ndarray) -> pa.RecordBatch:
    """The blocks of an array of bytes that aren't all zero."""
    rows = line.reshape(-1, BLOCK)
    some = np.flatnonzero(rows.any(axis=1))
    nulls = [pa.nulls(len(some), t) for t in (pa.string(), pa.string(), pa.int64())]
    return pa.RecordBatch.from_arrays([*nulls, pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["lang", "phrase", "n", "block", "bytes"])


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages, a bounded number of bytes at a time; a text is never cut."""
    texts, langs, n = [], [], 0
    for b in batches:
        for text, lang in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
            texts.append(text)
            langs.append(lang)
            n += len(text)
            if n >= size:
                yield texts, langs
                texts, langs, n = [], [], 0
    if texts:
        yield texts, langs


def counted(texts: DataFrame, k: int, maps, least: int, longest: int) -> DataFrame:
    """Pass k: partial counts of phrases of k words, and blocks of the bucket counters of those of k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BUCKET_BITS, np.uint8 if least < 256 else np.uint32) if k < longest else None
        for some, langs in chunks(batches):
            p = Phrases(some, langs)
            ok = p.inside(k)
            if k > 1:
                buckets, frequent = maps.value
                h = p.hashes(k - 1)
                known = has(frequent, place(h, FREQUENT_BITS))
                ok &= known[:-1] & known[1:]
                at = np.flatnonzero(ok)
                ok[at] = has(buckets, bucket(joined(h[at], p.one[at + k - 1]), BUCKET_BITS))
            at = np.flatnonzero(ok)
            if len(at):
                yield p.counts(at, k)
            if full is not None and len(ok) > 1:
                longer = np.flatnonzero(ok[:-1] & ok[1:] & p.inside(k + 1))
                h = p.one[longer]
                for j in range(1, k + 1):
                    h = joined(h, p.one[longer + j])
                some, n = np.unique(bucket(h, BUCKET_BITS), return_counts=True)
                full[some] = np.minimum(full[some] + n, least)
        if full is not None:
            yield blocks(full.view(np.uint8))

    return texts.mapInArrow(trimmed(run), PARTIAL)


def gathered(rows: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], end: Callable[[np.ndarray], np.ndarray]) -> dict[int, bytes]:
    """Merge blocks of one number from all tasks, as they stream by, and bring them to the driver: their number and size are fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new = np.frombuffer(data, np.uint8)
                found[n] = merge(found[n], new) if n in found else new
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([end(x).tobytes() for x in found.values()], pa.binary())], names=["block", "bytes"])

    made = rows.select("block", "bytes").repartition("block").mapInArrow(trimmed(run), "block int, bytes binary")
    return {r.block: bytes(r.bytes) for r in made.collect()}


def full_buckets(partial: DataFrame, least: int) -> np.ndarray:
    """Bitmap of the buckets that hold `least` phrases or more."""
    kind = np.uint8 if least < 256 else np.uint32
    add = lambda a, b: np.minimum(a.view(kind).astype(np.int64) + b.view(kind), least).astype(kind).view(np.uint8)
    found = gathered(partial.where("block IS NOT NULL"), add, lambda x: np.packbits(x.view(kind) >= least, bitorder="little"))
    per = BLOCK // np.dtype(kind).itemsize // 8
    out = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    for n, data in found.items():
        out[n * per : (n + 1) * per] = np.frombuffer(data, np.uint8)
    return out


def frequent_map(frequent: DataFrame) -> np.ndarray:
    """Bitmap of the places of frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FREQUENT_BITS - 3, np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            p = Phrases(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist())
            k = len(p.codes) // b.num_rows
            h = p.one[::k]
            for j in range(1, k):
                h = joined(h, p.one[j::k])
            at = place(h, FREQUENT_BITS)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield blocks(bits)

    found = gathered(frequent.select("phrase", "lang").mapInArrow(trimmed(run), PARTIAL), np.bitwise_or, lambda x: x)
    out = np.zeros(1 << FREQUENT_BITS - 3, np.uint8)
    for n, data in found.items():
        out[n * BLOCK : (n + 1) * BLOCK] = np.frombuffer(data, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words that occur `least` times or more, and (lang, n): all words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    found, totals, maps = [], None, None
    for k in range(1, longest + 1):
        partial = stored(counted(texts, k, maps, least, longest), f"phrases{k}")
        counts = partial.where("block IS NULL")
        if totals is None:
            totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        found.append(stored(frequent.select("lang", "phrase", F.lit(k).alias("words"), "f"), f"frequent{k}"))
        if k < longest:
            maps = spark.sparkContext.broadcast((full_buckets(partial, least), frequent_map(found[-1])))
        discard(partial)
        if found[-1].isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, totals


def score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)), exactly: decimals of 38 digits hold the products."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), exact(l) * exact(r)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 words or more is cut in two where floor(1000 a n / (l r)) is least (of equal ones at the first word), and goes if
    a longer frequent phrase around it is as frequent: it suffices to look at phrases of one word more, as counts never
    rise along the way to a longer one. The score is at most 10 n.

    Nulls: a null text is empty, a null language is `und`. Empty texts have no words. Long texts are read whole. Ties go by count, then by
    phrase in byte order. Repeated rows count as often as they come. An empty table gives an empty result. Other columns
    are not read.
    """
    frequent, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    phrases = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ", -1)
    longer = phrases.where("words > 2").select("lang", "a", F.explode(F.array(*[F.array_join(F.slice(word, F.lit(s), F.col("words") - 1), " ") for s in (1, 2)])).alias("phrase"))
    whole = phrases.join(longer, ["lang", "phrase", "a"], "left_anti")
    cut = whole.select("*", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " "))
    part = frequent.where(F.col("words") < longest)
    cut = cut.drop("w", "words").join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    cut = cut.withColumn("score", score("a", "n", "l", "r"))
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB's form of op11: every phrase of every length is counted.
SQL = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
lists AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, k AS words, array_to_string(w[i : i + k - 1], ' ') AS phrase
          FROM starts CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
phrases AS (SELECT lang, phrase, words, f AS a, w FROM frequent WHERE words > 1),
within AS (SELECT DISTINCT lang, a, array_to_string(w[i : j], ' ') AS phrase
           FROM phrases, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)) AS s(i, j)
           WHERE j <= words AND j - i + 1 < words),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : words], ' ') AS y
         FROM (SELECT *, unnest(range(1, words)) AS k FROM phrases p
               WHERE NOT EXISTS (SELECT 1 FROM within i WHERE i.lang = p.lang AND i.phrase = p.phrase AND i.a >= p.a))),
scored AS (
    SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.k, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
