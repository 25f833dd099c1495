"""Phrase collocation mining with broadcast double-array tries.

A pass over the texts counts words and writes them as codes, so that later passes read
numbers.  Phrases grow word by word: a trie of the candidates of k words is advanced at
all positions of a chunk at once, level by level; where it accepts, and the next
position accepts too, the next word makes a candidate of k + 1 words (its first and its
last k words are candidates), kept if its tallies reach the least count.  At last the
tries of all candidates run over all positions; accepting states are counted by bincount
and summed over tasks and shards.  A shard holds a bounded number of phrases, so that
no broadcast grows with the corpus; more candidates mean more shards.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import batches, small_batches, texts_of

LEAST = 100
LONGEST = 5
TOP = 2000
CHUNK = 16_000  # positions of a stored row (at most 65,531: its words have 16-bit places); some hundred rows are in memory at once
SHARD = 200_000  # phrases of a broadcast trie
CACHE = 200_000  # words that a task counts before it hands their counts on
WORDS = 1 << 18  # words that a task encodes at once, and those of one text more
TALLIES = 1 << 21  # extensions or accepted phrases that a task sums up at once
ROWS = 1 << 16  # sums that travel at once
PROBES = 300_000  # cells that are looked at for a node before it goes to the end
BLOCK = 4096  # counts that travel in one row
PARTS = 64  # parts of a language that are ranked apart before the last ranking

#: A-Z lower-cased; what ends a piece becomes a full stop, which stands in no word.
_NORMAL = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CODES = "lang string, own int, uniq binary, idx binary, word string, h bigint, count bigint"


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order, and a full stop between pieces."""
    return (text or b"").translate(_NORMAL).replace(b".", b" . ").split()


class _Counter:
    """Slots, hashes and counts of the words of one language in a task; slot 0 is the end of a piece."""

    def __init__(self, seed: int):
        self.seed = seed
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {b".": 0}
        self.hashes: list[int] = [0]
        self.counts = np.zeros(1, np.int64)

    def slots(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            if w not in self.slot:
                self.slot[w] = len(self.hashes)
                self.hashes.append((xxhash.xxh3_64_intdigest(w, self.seed) & (2**63 - 1)) or 1)
            out[i] = self.slot[w]
        more = np.bincount(out, minlength=len(self.hashes))
        more[: len(self.counts)] += self.counts
        self.counts = more
        return out

    def rows(self, lang: str) -> pa.RecordBatch:
        words = [w.decode() for w in self.slot][1:]
        n = len(words)
        none = pa.nulls(n, pa.binary())
        out = pa.RecordBatch.from_arrays([
            pa.array([lang] * n, pa.string()), pa.nulls(n, pa.int32()), none, none, pa.array(words, pa.string()), pa.array(self.hashes[1:], pa.int64()), pa.array(self.counts[1:]),
        ], names=["lang", "own", "uniq", "idx", "word", "h", "count"])
        self.clear()
        return out


def _chunks(lang: str, slots: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Stored rows: ``own`` positions and a few words more, as distinct hashes and 16-bit places among them."""
    own, uniq, idx = [], [], []
    for start in range(0, len(slots), CHUNK):
        part = slots[start : start + CHUNK + LONGEST - 1]
        used = np.flatnonzero(np.bincount(part))
        place = np.zeros(used[-1] + 1, np.uint16)
        place[used] = np.arange(len(used))
        own.append(min(CHUNK, len(slots) - start))
        uniq.append(hashes[used].tobytes())
        idx.append(place[part].tobytes())
    n = len(own)
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * n, pa.string()), pa.array(own, pa.int32()), pa.array(uniq, pa.binary()), pa.array(idx, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
    ], names=["lang", "own", "uniq", "idx", "word", "h", "count"])


def _encoded(docs: DataFrame, seed: int) -> DataFrame:
    """One pass over the texts: rows of codes, and rows of word counts."""

    def run(parts):
        counters: dict[str, _Counter] = {}
        for b in batches(parts):
            by_lang: dict[str, list[bytes]] = {}

            def chunks(lang, by_lang=by_lang):
                own = counters.setdefault(lang, _Counter(seed))
                slots = own.slots(by_lang.pop(lang))
                return _chunks(lang, slots, np.array(own.hashes, np.int64))

            for lang, text in zip(b.column("lang").to_pylist(), texts_of(b.column("text"))):
                words = by_lang.setdefault(lang, [])
                words.extend(tokens(text))
                words.append(b".")
                if len(words) > WORDS:
                    yield chunks(lang)
            for lang in list(by_lang):
                yield chunks(lang)
            if sum(len(c.hashes) for c in counters.values()) > CACHE:
                yield from (c.rows(lang) for lang, c in counters.items())
                counters.clear()
        yield from (c.rows(lang) for lang, c in counters.items())

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _CODES)


@dataclass
class Trie:
    """A double-array trie over word codes: from state s the word c leads to base[s] + c, if check there is s."""

    vocabulary: np.ndarray  # sorted hashes; a word's code is its place from 1
    roots: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray  # the phrase that a state accepts, or -1
    ids: np.ndarray  # of the phrases

    @classmethod
    def build(cls, langs: list[str], words: list[np.ndarray], ids: np.ndarray) -> Trie:
        vocabulary = np.unique(np.concatenate(words))
        names = sorted(set(langs))
        number = {name: k for k, name in enumerate(names)}
        depth = max(map(len, words))
        grid = np.zeros((len(words), depth + 1), np.int64)  # the language, then codes; 0 after the end
        grid[:, 0] = [number[x] for x in langs]
        size = np.array([len(w) for w in words])
        grid[:, 1:][np.arange(depth) < size[:, None]] = np.searchsorted(vocabulary, np.concatenate(words)) + 1
        order = np.lexsort(grid.T[::-1])
        grid, size, ids = grid[order], size[order], ids[order]
        # nodes level by level: a row begins one where its path differs from the row's before
        node, count = np.searchsorted(np.unique(grid[:, 0]), grid[:, 0]), len(names)
        parents, codes, phrase = [np.full(count, -1)], [np.zeros(count, np.int64)], {}
        fresh = np.zeros(len(grid), bool)
        fresh[0] = True
        fresh[1:] = grid[1:, 0] != grid[:-1, 0]
        at = node
        for level in range(1, depth + 1):
            fresh = fresh.copy()
            fresh[1:] |= grid[1:, level] != grid[:-1, level]
            live = size >= level
            begins = np.flatnonzero(fresh & live)
            new = count + np.cumsum(fresh & live) - 1
            parents.append(at[begins])
            codes.append(grid[begins, level])
            at = np.where(live, new, at)
            for row in np.flatnonzero(size == level).tolist():
                phrase[int(at[row])] = row
            count += len(begins)
        parent, code = np.concatenate(parents), np.concatenate(codes)
        base, cells = _placed(parent, code, len(names), len(vocabulary) + 1)
        length = int(max(cells.max(), base.max())) + len(vocabulary) + 2
        out = cls(vocabulary, number, np.zeros(length, np.int32), np.full(length, -1, np.int32), np.full(length, -1, np.int32), ids)
        out.base[cells] = base
        child = np.flatnonzero(parent >= 0)
        out.check[cells[child]] = cells[parent[child]]
        out.phrase[cells[list(phrase)]] = list(phrase.values())
        return out

    def advance(self, lang: str, uniq: np.ndarray, idx: np.ndarray, starts: int):
        """Level by level: (positions, states) where words from a position lead to a state."""
        if (root := self.roots.get(lang)) is None:
            return
        at = np.minimum(np.searchsorted(self.vocabulary, uniq), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == uniq, at + 1, 0).astype(np.int32)
        codes = np.concatenate([code[idx], np.zeros(LONGEST, np.int32)])
        position = np.flatnonzero(codes[:starts])
        state = np.full(len(position), root, np.int32)
        for level in range(LONGEST):
            to = self.base[state] + codes[position + level]
            good = self.check[to] == state
            position, state = position[good], to[good]
            if not len(position):
                return
            yield position, state


def _placed(parent: np.ndarray, code: np.ndarray, roots: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, cell) of each node, so that all children lie at their parent's base plus their code, no two in one cell.

    Nodes with more children are placed first, where a free cell fits the first child
    and all others, or behind all cells so far; single children then take what is free.  Roots are the first cells.
    """
    n = len(parent)
    base, cell = np.zeros(n, np.int64), np.arange(n)
    children = np.arange(roots, n)
    order = children[np.argsort(parent[children], kind="stable")]  # codes of a parent stay sorted
    owners, first, sizes = np.unique(parent[order], return_index=True, return_counts=True)
    free = np.ones(2 * n + 4 * width, bool)
    free[:width] = False  # roots, and bases below 0
    low = high = width
    for k in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
        own = order[first[k] : first[k] + sizes[k]]
        step = code[own] - code[own[0]]
        look, tried = low, 0
        while True:
            if tried * len(own) > PROBES:
                fits = high  # nothing lies behind it
                if fits + width > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                break
            if look + 4096 + width > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            open_ = np.flatnonzero(free[look : look + 4096]) + look
            if look == low and len(open_) < 200:
                low += 4096
            fits = None
            for some in range(0, len(open_), 64):
                tried += 64
                good = free[open_[some : some + 64, None] + step].all(1)
                if good.any():
                    fits = open_[some + int(good.argmax())]
                    break
            if fits is not None:
                break
            look += 4096
        cell[own] = fits + step
        free[cell[own]] = False
        high = max(high, int(cell[own[-1]]) + 1)
        base[owners[k]] = fits - code[own[0]]
    single = np.flatnonzero(sizes == 1)
    while free.sum() < len(single):
        free = np.concatenate([free, np.ones(len(free), bool)])
    cells = np.flatnonzero(free)[: len(single)]
    own = order[first[single]]
    cell[own] = cells
    base[owners[single]] = cells - code[own]
    return base, cell


def _shards(phrases: DataFrame):
    """Tries of at most about SHARD phrases each, one after the other, and how many there are."""
    count = phrases.count()
    shards = -(-count // SHARD)
    for k in range(shards):
        rows = phrases.where(F.pmod(F.xxhash64("lang", "words"), F.lit(shards)) == k).select("lang", "words", "id").toArrow()
        if rows.num_rows:
            words = rows.column("words").combine_chunks()
            flat, ends = np.asarray(words.flatten()), np.cumsum(np.asarray(words.value_lengths()))
            yield Trie.build(rows.column("lang").to_pylist(), np.split(flat, ends[:-1]), np.asarray(rows.column("id"))), shards


def _chunk_rows(parts):
    for b in batches(parts):
        uniq, idx = b.column("uniq"), b.column("idx")
        for i, (lang, own) in enumerate(zip(b.column("lang").to_pylist(), b.column("own").to_pylist())):  # views, no copies
            yield lang, own, np.frombuffer(uniq[i].as_buffer(), np.int64), np.frombuffer(idx[i].as_buffer(), np.uint16)


def _extensions(codes: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """(id, h, count): words h that follow phrases of k words where the last k of all k + 1 are a phrase, too.

    With more than one shard a task knows only whether the first k are a phrase.
    """
    spark = codes.sparkSession
    found = []
    for trie, shards in _shards(phrases):
        shared = spark.sparkContext.broadcast(trie)

        def run(parts, shared=shared, alone=shards == 1):
            trie, names, held, size = shared.value, {}, [], 0

            def rows():
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                hashes = np.fromiter(names, np.int64, len(names))
                for start in range(0, len(keys), ROWS):
                    key, count = keys[start : start + ROWS], counts[start : start + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(trie.ids[key >> 32]), pa.array(hashes[key & 0xFFFFFFFF]), pa.array(count)], names=["id", "h", "count"])

            for lang, own, uniq, idx in _chunk_rows(parts):
                last = [x for x in trie.advance(lang, uniq, idx, own + 1)][k - 1 : k]
                if not last:
                    continue
                position, phrase = last[0][0], trie.phrase[last[0][1]].astype(np.int64)
                padded = np.concatenate([idx, np.zeros(LONGEST, np.uint16)])
                follows = (position < own) & (position + k < len(idx)) & (uniq[padded[position + k]] != 0)
                if alone:
                    accepted = np.zeros(len(idx) + LONGEST + 1, bool)
                    accepted[position] = True
                    follows &= accepted[position + 1]
                place = padded[position[follows] + k]
                used = np.flatnonzero(np.bincount(place))
                number = np.zeros(len(uniq), np.int64)
                number[used] = [names.setdefault(h, len(names)) for h in uniq[used].tolist()]
                held.append(phrase[follows] << 32 | number[place])
                size += len(held[-1])
                if size > TALLIES:
                    yield from rows()
                    held, size, names = [], 0, {}
            if size:
                yield from rows()

        found.append(materialize(codes.mapInArrow(run, "id bigint, h bigint, count bigint")))
        shared.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.groupBy("id", "h").agg(F.sum("count").alias("count"))


def _counts(codes: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, a): occurrences of phrases of any length, shard by shard.

    A task counts all phrases of a shard; blocks of its counts are summed as they come.
    """
    spark = codes.sparkSession
    found = []
    for trie, _ in _shards(phrases):
        shared = spark.sparkContext.broadcast(trie)

        def run(parts, shared=shared):
            trie = shared.value
            total, held, size = np.zeros(len(trie.ids), np.int64), [], 0
            for lang, own, uniq, idx in _chunk_rows(parts):
                for _, state in trie.advance(lang, uniq, idx, own):
                    phrase = trie.phrase[state]
                    held.append(phrase[phrase >= 0])
                    size += len(held[-1])
                if size > TALLIES:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
            if size:
                total += np.bincount(np.concatenate(held), minlength=len(total))
            blocks = [total[k : k + BLOCK] for k in range(0, len(trie.ids), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

        def add(parts, shared=shared):
            ids, totals = shared.value.ids, {}
            for b in batches(parts):
                for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                    totals[block] = np.frombuffer(counts, np.int64) + totals.get(block, 0)
            for block, total in totals.items():
                own = ids[block * BLOCK : block * BLOCK + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[: len(own)])], names=["id", "a"])

        tasks = codes.mapInArrow(run, "block int, counts binary")
        found.append(materialize(tasks.repartition("block").mapInArrow(add, "id bigint, a bigint")))
        shared.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def count_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, size, a): word totals, and all phrases of 1 to LONGEST words that occur ``least`` times or more.

    ``docs`` has ``text`` and ``lang`` (null counts as ``und``); null texts are empty.
    Repeated rows count each time.  Codes are 63-bit hashes of words; should two words
    of the corpus share one, another seed is taken, so counts are exact.
    """
    small_batches(docs.sparkSession)
    for seed in range(8):
        coded = materialize(_encoded(docs, seed))
        words = materialize(coded.where("word is not null").groupBy("lang", "word", "h").agg(F.sum("count").alias("a")))
        if words.groupBy("h").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).where("lo <> hi").isEmpty():
            break
    codes = coded.where("own is not null").select("lang", "own", "uniq", "idx")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = materialize(words.where(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id()))
    level = frequent.select("lang", F.col("word").alias("phrase"), F.array("h").alias("words"), "id")
    grown = []
    for k in range(1, LONGEST):
        if level.isEmpty():
            break
        more = _extensions(codes, level, k).where(F.col("count") >= least)
        follow = frequent.select(F.col("lang").alias("_lang"), F.col("h").alias("_h"), F.col("word").alias("_word"))
        named = more.join(level, "id").join(follow, (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h")))
        level = materialize(named.select("lang", F.concat_ws(" ", "phrase", "_word").alias("phrase"), F.concat("words", F.array("h")).alias("words"), (F.monotonically_increasing_id() * 8 + k + 1).alias("id")))
        grown.append(level)
    out = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "a")
    candidates = None
    for level in grown:
        candidates = level if candidates is None else candidates.unionAll(level)
    if candidates is None or candidates.isEmpty():
        return totals, out
    counted = candidates.join(_counts(codes, candidates), "id").where(F.col("a") >= least)
    return totals, out.unionAll(counted.select("lang", "phrase", F.size("words").alias("size"), "a"))


def lowest_cut(a: int, n: int, cuts: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the cut (k, l, r) that scores least; Python's integers have no bound."""
    score, _, left, right = min((1000 * a * n // (left * right), k, left, right) for k, left, right in cuts)
    return score, left, right


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    Phrases of 2 to LONGEST words within a piece that occur ``least`` times or more and
    in no longer such phrase as often.  A longer phrase that holds one as often has a
    part one word longer than it that does too, so only those are looked at.  The score
    of a cut is floor(1000 * a * n / (l * r)), l and r the counts of its parts; the
    lowest counts, ties to the first.  Texts without words and empty tables give no rows.
    """
    totals, counted = count_phrases(docs, least)
    counted = materialize(counted)
    long = counted.where("size > 1")
    split = long.select("lang", "phrase", "size", "a", F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    inner = split.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("_longer"))
    held = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = split.join(held, ["lang", "phrase"], "left").where("_longer is null or _longer < a")
    cuts = kept.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    left = counted.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r"))
    ready = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts")).join(totals, "lang")

    def score(parts):
        for b in batches(parts):
            best = [lowest_cut(a, n, [(c["k"], c["l"], c["r"]) for c in cuts]) for a, n, cuts in zip(b.column("a").to_pylist(), b.column("n").to_pylist(), b.column("cuts").to_pylist())]
            got = [pa.array(list(x), pa.int64()) for x in zip(*best)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("phrase"), b.column("a"), got[1], got[2], b.column("n"), got[0]], names=["lang", "phrase", "a", "l", "r", "n", "score"])

    scored = ready.select("lang", "phrase", "a", "n", "cuts").mapInArrow(score, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    first = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # the first of each part hold the first of a language, so no task sees all phrases of one
    dealt = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    inside = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*first))
    few = dealt.withColumn("_place", inside).where(F.col("_place") <= top)
    order = Window.partitionBy("lang").orderBy(*first)
    return few.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH w AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)
), spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f
  FROM spots, (SELECT unnest([1, 2, 3, 4, 5]) AS size) AS sizes WHERE i + size - 1 <= len(w) GROUP BY ALL
), f AS (SELECT * FROM g WHERE f >= 100),
n AS (SELECT lang, sum(f) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(list_slice(w, i, i + size - 2), ' ') AS phrase FROM c, (SELECT unnest([1, 2]) AS i) AS two WHERE size > 2) GROUP BY ALL
), cut AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(list_slice(w, 1, k), ' ') AS left_part, array_to_string(list_slice(w, k + 1, size), ' ') AS right_part
  FROM c LEFT JOIN held USING (lang, phrase), (SELECT unnest([1, 2, 3, 4]) AS k) AS ks WHERE k < size AND (longer IS NULL OR longer < a)
), s AS (
  SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n, CAST(CAST(1000 AS HUGEINT) * a * CAST(n AS HUGEINT) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = left_part JOIN f AS r ON r.lang = cut.lang AND r.phrase = right_part JOIN n ON n.lang = cut.lang
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
