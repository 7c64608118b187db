"""Periodic runs of words by seeds on diagonals.

A run of period q and at least ``min_periods`` periods repeats its words at lag q over
``least_overlap(q)`` words at least. So grams of that many words, or fewer, meet in it: a
gram of the document and its next occurrence are a seed on the diagonal of their lag. A
seed is extended to both sides along its diagonal, unless the furthest place that the lag
has covered lies beyond it. A document needs no other document, so nothing is shuffled.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .columns import SPACE
from .runs import slices

# Words of a run at least, and periods.
MIN_WORDS, MIN_PERIODS = 6, 4
# Bytes of texts whose grams are indexed together, and of a text that is cut into words
# at once.
PART, STEP = 2 << 20, 1 << 20

RUN = "struct<start: long, length: long, period: long>"


# --- grams

def least_overlap(period: int, min_words: int, min_periods: int) -> int:
    """Words that a run of this period has in common with itself one period on, at least."""
    return max(min_words, min_periods * period) - period


def gram_lengths(longest: int, min_words: int, min_periods: int) -> Iterator[tuple[int, int, int]]:
    """``(gram, least, most)``: grams of this length find the runs with a period from
    ``least`` to ``most``, up to those that ``longest`` words can hold.

    Such a run holds the gram one period apart, as ``gram <= least_overlap(period)``. The
    two are next to each other among the gram's occurrences, as ``gram >= period``: an
    occurrence between them would give the run a smaller period.
    """
    least = 1
    while max(min_words, least * min_periods) <= longest:
        gram = min(
            least_overlap(q, min_words, min_periods) for q in range(least, least + min_words + 1)
        )
        yield gram, least, gram
        least = gram + 1


class Grams:
    """The repeated grams of one length in the texts of a part: ``name`` tells them apart,
    and is -1 where a gram doesn't occur again in its document. Names are ranks of pairs of
    shorter names, so equal names are equal words."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, length: int):
        self.doc, self.length = doc, 1
        self.name = np.full(len(words), -1)
        at = np.arange(max(0, len(words) - length + 1))
        at = at[doc[at] == doc[at + length - 1]]
        # Most grams occur once. A hash, which may take two grams for one, leaves them out
        # before names are given to the rest.
        mixed = doc[at].astype(np.uint64)
        for t in range(length):
            mixed = (mixed ^ words[at + t].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        at = at[_repeated(mixed)]
        key = doc[at]
        for t in range(length):
            key = _ranks(key * (int(words.max(initial=0)) + 1) + words[at + t])
        self.length = length
        self._put(at, key)

    def _put(self, at: np.ndarray, key: np.ndarray) -> None:
        self.name[:] = -1
        again = _repeated(key)
        self.at, self.name[at[again]] = at[again], key[again]

    def lengthen(self, length: int) -> None:
        """Go on to grams of ``length`` words, each of two shorter ones that may overlap."""
        while self.length < length and len(self.at):
            step = min(length - self.length, self.length)
            at = self.at[self.at + step < len(self.name)]
            both = (self.name[at + step] >= 0) & (self.doc[at] == self.doc[at + step])
            at = at[both]
            key = _ranks(self.name[at] * (int(self.name.max()) + 1) + self.name[at + step])
            self.length += step
            self._put(at, key)
        self.length = length

    def seeds(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """``(place, lag)`` of every gram and its next occurrence in the document whose lag
        is from ``least`` to ``most``, by place; of seeds side by side on a diagonal the
        first, since it covers the others."""
        order = np.lexsort((self.at, self.name[self.at]))
        at = self.at[order]
        lag = at[1:] - at[:-1]
        found = (self.name[at[1:]] == self.name[at[:-1]]) & (lag >= least) & (lag <= most)
        at, lag = at[:-1][found], lag[found]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        at, lag = at[first], lag[first]
        order = np.argsort(at, kind="stable")
        return at[order], lag[order]


def _ranks(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


# --- diagonals

def _matches(words: np.ndarray, at: int, lag: int, stop: int) -> int:
    """How many words from ``at`` to ``stop`` equal those ``lag`` further on, one by one."""
    start, block = at, 64
    while at < stop:
        to = min(stop, at + block)
        differ = words[at:to] != words[at + lag:to + lag]
        if differ.any():
            return at + int(differ.argmax()) - start
        at, block = to, block * 2
    return at - start


def _matches_back(words: np.ndarray, at: int, lag: int, stop: int) -> int:
    """How many words before ``at``, down to ``stop``, equal those ``lag`` further on."""
    count = 0
    while at - count > stop and words[at - count - 1] == words[at - count - 1 + lag]:
        count += 1
    return count


def find_runs(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS,
              min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each document, by start and period.
    ``words`` are the numbers of all words, those of document d before ``ends[d]``."""
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    sizes = ends - starts
    doc = np.repeat(np.arange(len(ends)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    grams = None
    for gram, least, most in gram_lengths(int(sizes.max(initial=0)), min_words, min_periods):
        if grams is None:
            grams = Grams(words, doc, gram)
        grams.lengthen(gram)
        if not len(grams.at):
            break
        covered: dict[tuple[int, int], int] = {}
        for place, lag in zip(*(seeds.tolist() for seeds in grams.seeds(least, most))):
            d = int(doc[place])
            before = covered.get((d, lag), int(starts[d]))
            if place < before:
                continue
            # The names say that the gram's words match.
            right = place + gram
            right += _matches(words, right, lag, int(ends[d]) - lag)
            left = place - _matches_back(words, place, lag, before)
            covered[d, lag] = right
            length = right + lag - left
            if length >= max(min_words, min_periods * lag):
                found[d].append((left - int(starts[d]), length, lag))
    return [sorted(runs) for runs in found]


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``count`` words stay when each run is cut to its first period."""
    steps = np.zeros(count + 1, int)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


# --- the operator

def _numbered(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of ``texts`` as numbers, where each text ends, and the distinct words."""
    numbers: dict[bytes, int] = {}
    parts, ends, count = [np.empty(0, np.int64)], [], 0
    for text in texts:
        at = 0
        while at < len(text):
            to = _word_end(text, at + STEP)
            part = [numbers.setdefault(w, len(numbers)) for w in text[at:to].split()]
            parts.append(np.array(part, np.int64))
            count += len(part)
            at = to
        ends.append(count)
    return np.concatenate(parts), np.array(ends, np.int64), list(numbers)


def _word_end(text: bytes, at: int) -> int:
    while at < len(text) and text[at] not in b" \t\n\v\f\r":
        at += 1
    return min(at, len(text))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: doc_id, n_words, runs, collapsed.

    Words stand between ASCII white space and are compared byte by byte. ``runs`` holds
    ``(start, length, period)`` of every stretch of at least ``min_words`` words and
    ``min_periods`` times its smallest period that can't be made longer with that period,
    by start and period. ``collapsed`` is the text without the words that lie in a run
    behind its first period, joined by single spaces.

    A null or empty text has no words, no runs, and '' as its collapsed text. Rows are
    taken one by one: repeated rows and rows without id have a row each, in an empty table
    there is none, and other columns are not read. A task holds the word numbers of about
    ``PART`` bytes of texts or of one longer text.
    """
    if min_words < 2 or min_periods < 2:
        raise ValueError("a run has two words and two periods at least")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                     ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ])

    def search(batches):
        for part in slices(batches, 1, PART):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            words, ends, distinct = _numbered(texts)
            runs = find_runs(words, ends, min_words, min_periods)
            sizes = np.diff(ends, prepend=0)
            collapsed = []
            for own, end, size in zip(runs, ends.tolist(), sizes.tolist()):
                ids = words[end - size:end]
                if own:
                    ids = ids[kept_words(size, own)]
                collapsed.append(b" ".join([distinct[w] for w in ids.tolist()]))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(sizes),
                pa.array([[dict(zip(("start", "length", "period"), run)) for run in own]
                          for own in runs], schema.field("runs").type),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ], schema=schema)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(search, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with runs put into a tenth of the texts, chosen by the hash of the id: from
    a place on, the words repeat the first of them. A row without id stays as it is."""
    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"([^{SPACE}]+)"))
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    n = F.size("words")

    def of(entry: Column) -> Column:
        count, start, period = entry["n"], entry["a"], entry["p"]
        place = F.sequence(F.lit(0), count - 1)
        return F.array_join(F.transform(place, lambda i: F.get(
            F.col("words"), F.when(i < start, i).otherwise(start + (i - start) % period).cast("int")
        )), " ")

    planted = docs.withColumn("words", F.when(h % 10 == 0, words))
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = planted.withColumn(
        "at", F.when(n > 0, F.struct(n.alias("n"), a.alias("a"), p.alias("p")))
    )
    return planted.withColumn(
        text_col, F.when(n > 0, of(F.col("at"))).otherwise(F.col(text_col))
    ).select(*docs.columns)


def summary(found: DataFrame) -> DataFrame:
    """``found``, the rows of ``periodic_runs``, as counts, the run of most periods, and
    digests. Of runs with equally many periods that with the smallest start, then the
    smallest period, is taken: the first one in their order."""
    none = F.lit(None).cast(RUN)
    best = F.reduce("runs", none, lambda held, run: F.when(
        held.isNull() | (run["length"] * held["period"] > held["length"] * run["period"]), run
    ).otherwise(held))
    line = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")
    ))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
