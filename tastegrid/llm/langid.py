"""Language identification by interpolated Kneser-Ney character models.

For each language the probabilities of character sequences are estimated from all
labelled texts. A text gets the language with the lowest cross-entropy per character.
What no language explains as well as the texts it was learned from is marked as rejected.

No sequence is dropped, and every model takes the same way. Spark estimates it; the
sequences found most often, as many as fit in HELD bytes, go to the executors as sorted
arrays of hashes that all languages share, with a column of log-probabilities for each.
Of the others a table of bits of fixed size tells that a hash is surely none of them. A
place whose probability the arrays and the bits don't settle is handed back, and looked
up by a join with the model's files in the shared folder.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import remainder
from .runs import slices
from .stages import staged

# Characters of a sequence, and the discount of its count.
ORDER, DISCOUNT = 4, 0.75
UNKNOWN = "und"
# The part of a language's unseen texts that its rejection level lets pass, and one in
# how many labelled texts is kept out of a model's counts to stand for unseen ones.
PASS, KEPT_OUT = 0.995, 10
# Bytes of the sequences held as arrays, and of their contexts; few enough that a look-up
# stays in a processor's cache. Bits that tell which other sequences there are: a power
# of 2, 32,768 at least.
HELD, BITS = 4 << 20, 1 << 25
# Characters of texts that are taken at once; a longer text is taken in parts.
PART = 1 << 17
# The least probability of a character, spread over an alphabet of this size.
ALPHABET = 1 << 16

_SPACE = ord(" ")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


_fold_table = None


def _folded() -> np.ndarray:
    """For each code point: the letter in lower case, or a space for what is no letter."""
    global _fold_table
    if _fold_table is None:
        table = np.full(0x110000, _SPACE, np.uint32)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _fold_table = table
    return _fold_table


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, before, last)``: the folded characters of all texts, words between
    single spaces and texts between as many as a context has, so that no text is seen
    from another; the place before each text, and that of the space that ends it. For a
    text without letters the last place is not behind the one before."""
    parts = ["" if text is None else text for text in texts.to_pylist()]
    data = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.fromiter((len(part) + 1 for part in parts), np.int64, len(parts)))
    codes = _folded()[data]
    space = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    place = (np.cumsum(keep) - 1)[np.concatenate([[0], ends])]
    codes = codes[keep]
    times = np.ones(len(codes), np.int64)
    times[place] = ORDER - 1
    until = np.cumsum(times)
    return np.repeat(codes, times), until[place[:-1]] - 1, until[place[1:]] - (ORDER - 1)


def parts_of(texts: pa.Array, most: int | None = None) -> Iterator[tuple]:
    """``(rows, codes, before, last)`` as of ``letters_of`` for some of the texts after
    the others: short texts together, one of more than ``most`` characters in parts, each
    behind the characters before it. What is held at once doesn't follow a text's length."""
    most = PART if most is None else most
    rows, part, held = [], [], 0
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        if len(text) > most:
            yield from ((np.array([row]), *cut) for cut in _cuts(text, most))
            continue
        rows.append(row)
        part.append(text)
        held += len(text)
        if held >= most:
            yield np.array(rows), *letters_of(pa.array(part, pa.string()))
            rows, part, held = [], [], 0
    if part:
        yield np.array(rows), *letters_of(pa.array(part, pa.string()))


def _cuts(text: str, most: int) -> Iterator[tuple]:
    context = np.full(ORDER - 1, _SPACE, np.uint32)
    for at in range(0, len(text), most):
        piece = text[at:at + most] + "\n" * (at + most >= len(text))
        codes = _folded()[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)]
        space = codes == _SPACE
        after = np.concatenate([[context[-1] == _SPACE], space[:-1]])
        codes = np.concatenate([context, codes[~(space & after)]])
        yield codes, np.array([ORDER - 2]), np.array([len(codes) - 1])
        context = codes[1 - ORDER:]


def _places(before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts and the places of all their characters."""
    length = np.maximum(last - before, 0)
    owner = np.repeat(np.arange(len(before)), length)
    skipped = np.repeat(np.cumsum(length) - length, length)
    return owner, np.arange(len(owner)) - skipped + before[owner] + 1


def sequence_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` characters that end at each place; a sequence that
    would start before the first character starts with zeros."""
    out = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        moved = np.zeros(len(codes), np.uint64)
        moved[back:] = codes[:len(codes) - back]
        out = (out + moved + np.uint64(1)) * _FACTOR
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return (out ^ (out >> np.uint64(29))) | np.uint64(order - 1)  # lowest bits: the order


# --- counting

def sequence_counts(texts: DataFrame) -> DataFrame:
    """``(lang, part, gram, n)``: how often each sequence of ORDER characters is found in
    the texts ``(text, lang, part)``, all of them."""
    def count(batches):
        for batch in slices(batches, 0):
            kinds: dict[tuple, list[int]] = {}
            for row, kind in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                kinds.setdefault(kind, []).append(row)
            for (lang, part), rows in kinds.items():
                for _, codes, before, last in parts_of(
                        batch.column(0).take(pa.array(rows)), 8 * PART):
                    grams, n = _count_grams(codes, _places(before, last)[1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array([part] * len(grams), pa.int32()),
                        pa.array(grams, pa.string()), pa.array(n, pa.int64()),
                    ], names=["lang", "part", "gram", "n"])

    return (
        texts.select("text", "lang", F.col("part").cast("int"))
        .mapInArrow(count, "lang string, part int, gram string, n long")
        .groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))
    )


def _count_grams(codes: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct sequences of ORDER characters that end at ``ends``, and their counts."""
    hashes = sequence_hashes(codes, ORDER)[ends]
    ordered = np.sort(hashes)
    new = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
    # One place of each: a look-up is cheaper than a sort that keeps the places.
    _, which = _Places(ordered[new])(hashes)
    end = np.empty(len(new), np.int64)
    end[which] = ends
    joined = codes.tobytes().decode("utf-32-le")
    return [joined[i - ORDER + 1:i + 1] for i in end], np.diff(np.append(new, len(ordered)))


# --- the model

@dataclass
class Model:
    """Sorted hashes of sequences of all orders, and for each language their natural
    log-probabilities; the same for contexts and the weight of what follows them unseen.
    ``others`` has the bits of sequences and contexts that the model has elsewhere."""

    langs: list[str]
    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    logback: np.ndarray
    others: np.ndarray | None = None

    def __post_init__(self):
        self._gram_at, self._context_at = _Places(self.grams), _Places(self.contexts)

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
        """``(sums, n, (rows, grams, times))``: the log-probabilities of each text summed
        for each language, and its characters. Those that the model doesn't settle are
        left out of the sums, and given as the sequences that end there."""
        total = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts), np.int64)
        left = [[], [], []]
        for rows, codes, before, last in parts_of(texts):
            scores, unsettled = self.scores(codes)
            n = np.maximum(last - before, 0)
            bounds = np.stack([before + 1, last + 1], axis=1).ravel()
            scores = np.concatenate([scores, np.zeros((1, len(self.langs)))])
            own = np.add.reduceat(scores, bounds, axis=0)[::2]
            total[rows] += np.where(n[:, None] > 0, own, 0.0)
            size[rows] += n
            owner, place = _places(before, last)
            chosen = unsettled[place]
            for column, more in zip(left, _per_text(codes, rows[owner[chosen]], place[chosen])):
                column.extend(more)
        return total, size, tuple(left)

    def entropies(self, texts: pa.Array) -> np.ndarray:
        """Cross-entropy per character of each text under each language, by a model that
        is held whole; NaN for a text without letters."""
        total, n, _ = self.sums(texts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n[:, None] > 0, -total / n[:, None], np.nan)

    def scores(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each character after those before it, per language, and
        the places that aren't settled. Places whose sequence no language knows go on
        with a shorter one."""
        unsettled = np.zeros(len(codes), bool)
        hashes = sequence_hashes(codes, ORDER)
        found, at = self._gram_at(hashes)
        todo = np.flatnonzero(~found)
        if len(self.grams):
            at[todo] = 0
            out = np.take(self.logp, at, axis=0)
            out[todo] = 0
        else:
            out = np.zeros((len(codes), len(self.langs)))
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                found, at = self._gram_at(hashes[todo])
                out[todo[found]] += self.logp[at[found]]
                todo = todo[~found]
            elsewhere = self._elsewhere(gram_slots, hashes[todo])
            unsettled[todo[elsewhere]] = True
            todo = todo[~elsewhere]
            if order == 1:
                out[todo] += -np.log(ALPHABET)
            if order == 1 or not len(todo):
                break
            # The context is the sequence that ends one place before.
            hashes = sequence_hashes(codes, order - 1)
            context = np.concatenate([[np.uint64(0)], hashes[:-1]])[todo]
            known, at = self._context_at(context)
            out[todo[known]] += self.logback[at[known]]
            elsewhere = ~known & self._elsewhere(context_slots, context)
            unsettled[todo[elsewhere]] = True
            todo = todo[~elsewhere]
        out[unsettled] = 0
        return out, unsettled

    def _elsewhere(self, slots_of, hashes: np.ndarray) -> np.ndarray:
        if self.others is None:
            return np.zeros(len(hashes), bool)
        slots = slots_of(hashes, 8 * len(self.others))
        return (self.others[slots >> 3] >> (slots & 7)) & 1 == 1


def gram_slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of sequences, by their hashes."""
    return (hashes >> np.uint64(4)).astype(np.int64) & (bits - 1)


def context_slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of contexts."""
    return (hashes >> np.uint64(32)).astype(np.int64) & (bits - 1)


def _per_text(codes: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> tuple[list, list, list]:
    """Rows, distinct sequences of each row that end at ``ends``, and how often."""
    if not len(ends):
        return [], [], []
    _, first, which = np.unique(
        sequence_hashes(codes, ORDER)[ends], return_index=True, return_inverse=True)
    pairs, n = np.unique(rows * len(first) + which, return_counts=True)
    joined = codes.tobytes().decode("utf-32-le")
    texts = [joined[i - ORDER + 1:i + 1] for i in ends[first]]
    own, gram = np.divmod(pairs, len(first))
    return own.tolist(), [texts[i] for i in gram], n.tolist()


class _Places:
    """Places of hashes in a sorted array. As hashes are spread evenly, their leading
    bits lead to within a few places, and no search from the middle is needed."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.shift = np.uint64(64 - bits)
        starts = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(table, starts)
        # Behind the last place lies a value that no search passes.
        self.table = np.append(table, np.uint64(0xFFFFFFFFFFFFFFFF))

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes the array has, and their places."""
        at = self.first[hashes >> self.shift]
        there = self.table[at]
        behind = np.flatnonzero(there < hashes)
        while len(behind):
            at[behind] += 1
            there[behind] = self.table[at[behind]]
            behind = behind[there[behind] < hashes[behind]]
        return (there == hashes) & (at < len(self.table) - 1), at


def build_model(counts: dict[str, dict[str, int]]) -> Model:
    """A model held whole, of interpolated Kneser-Ney estimates from the counts of the
    longest sequences, few enough for one machine (``spread_model`` takes any number).
    Shorter ones are counted by the distinct characters before them, as the method has it."""
    langs = sorted(counts)
    if not langs:
        none = np.empty(0, np.uint64)
        return Model([], none, np.empty((0, 0)), none, np.empty((0, 0)))
    tables, weights = [], []
    for lang in langs:
        level = [None] * (ORDER + 1)
        level[ORDER] = counts[lang]
        for order in range(ORDER - 1, 0, -1):
            shorter: dict[str, int] = {}
            for gram in level[order + 1]:
                shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
            level[order] = shorter
        tables.append(level)
        weights.append(_context_weights(level))
    # Every sequence known to any language gets its probability in all of them.
    known = {order: sorted({g for level in tables for g in level[order]})
             for order in range(1, ORDER + 1)}
    logp = {order: np.empty((len(known[order]), len(langs))) for order in known}
    for k, (level, (total, back)) in enumerate(zip(tables, weights)):
        lower: dict[str, float] = {}
        for order in range(1, ORDER + 1):
            probs = {}
            for i, gram in enumerate(known[order]):
                context = gram[:-1]
                below = lower.get(gram[1:], 1 / ALPHABET) if order > 1 else 1 / ALPHABET
                seen = level[order].get(gram, 0)
                whole = total.get(context, 0)
                p = below * back.get(context, 1.0)
                if whole:
                    p += max(seen - DISCOUNT, 0) / whole
                probs[gram] = p
                logp[order][i, k] = np.log(p)
            lower = probs
    contexts = sorted({c for _, back in weights for c in back if c})
    logback = np.array([[np.log(back.get(c, 1.0)) for _, back in weights] for c in contexts])
    grams = np.concatenate([_hash_all(known[order], order) for order in known])
    order = np.argsort(grams)
    hashes = np.array([_hash_all([c], len(c))[0] for c in contexts], np.uint64)
    by_hash = np.argsort(hashes)
    return Model(
        langs, grams[order], np.concatenate(list(logp.values()))[order],
        hashes[by_hash], logback.reshape(-1, len(langs))[by_hash],
    )


def _context_weights(level) -> tuple[dict[str, int], dict[str, float]]:
    """For each context: the sum of what follows it, and the weight of the shorter one."""
    total: dict[str, int] = {}
    kinds: dict[str, int] = {}
    for order in range(1, ORDER + 1):
        for gram, n in level[order].items():
            context = gram[:-1]
            total[context] = total.get(context, 0) + n
            kinds[context] = kinds.get(context, 0) + 1
    return total, {c: DISCOUNT * kinds[c] / total[c] for c in total}


def _hash_all(grams: list[str], order: int) -> np.ndarray:
    if not grams:
        return np.empty(0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
    return sequence_hashes(codes, order)[order - 1::order]


# --- models estimated by Spark

def spread_model(counted: DataFrame, langs: list[str]) -> tuple[dict, dict]:
    """The model of ``build_model`` from ``counted (lang, gram, n)``, as tables by order:
    ``(gram, p, weight)``, the probabilities of each sequence in order of ``langs``, and
    ``(gram, logback, weight)``, the log-weights of what follows it as a context unseen.
    The weight is how often it is found."""
    names = F.array(*[F.lit(lang) for lang in langs])
    level = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        shorter = level[order + 1].groupBy("lang", F.substring("gram", 2, order).alias("gram"))
        level[order] = staged(shorter.agg(F.count("*").alias("n")), f"char-counts-{order}")
    probs, backs = {}, {}
    for order in range(1, ORDER + 1):
        context = F.substring("gram", 1, order - 1)
        after = (
            level[order].groupBy("lang", context.alias("context"))
            .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            .withColumn("back", DISCOUNT * F.col("kinds") / F.col("total"))
        )
        weights = staged(
            after.groupBy("context")
            .agg(_by_lang("total"), _by_lang("back"), F.sum("total").alias("weight")),
            "char-weights",
        )
        rows = level[order].groupBy("gram").agg(_by_lang("n"), F.sum("n").alias("weight"))
        if order == 1:
            # The only context is the empty one.
            rows = rows.crossJoin(F.broadcast(weights.drop("weight"))).withColumn(
                "below", F.array_repeat(F.lit(1 / ALPHABET), len(langs)))
        else:
            backs[order - 1] = weights.select(F.col("context").alias("gram"), F.transform(
                names, lambda lang: F.ln(F.coalesce(F.try_element_at("back", lang), F.lit(1.0)))
            ).alias("logback"), "weight")
            below = probs[order - 1].select(F.col("gram").alias("end"), F.col("p").alias("below"))
            rows = (
                rows.withColumn("context", context).withColumn("end", F.substring("gram", 2, order))
                .join(weights.drop("weight"), "context").join(below, "end")
            )
        probs[order] = staged(
            rows.select("gram", F.transform(names, _probability).alias("p"), "weight"),
            f"char-probabilities-{order}")
    return probs, backs


def _by_lang(name: str) -> Column:
    return F.map_from_entries(F.collect_list(F.struct("lang", name))).alias(name)


def _probability(lang: Column, place: Column) -> Column:
    seen = F.coalesce(F.try_element_at("n", lang), F.lit(0))
    own = F.greatest(seen - DISCOUNT, F.lit(0.0)) / F.try_element_at("total", lang)
    back = F.coalesce(F.try_element_at("back", lang), F.lit(1.0))
    return F.get("below", place) * back + F.coalesce(own, F.lit(0.0))


def spread_scores(asked: DataFrame, probs: dict, backs: dict, n_langs: int,
                  order: int = ORDER) -> DataFrame:
    """``(gram, logp)`` for the distinct sequences ``asked (gram)`` of ``order``
    characters: the log-probability of the last one in each language. Those that no
    language knows go on with a shorter one."""
    asked = staged(asked, f"char-asked-{order}")
    known = asked.join(
        probs[order].select("gram", F.transform("p", F.ln).alias("known")), "gram", "left")
    none = F.array_repeat(F.lit(0.0), n_langs)
    if order == 1:
        lower = F.array_repeat(F.lit(float(-np.log(ALPHABET))), n_langs)
        return known.select("gram", F.coalesce("known", lower).alias("logp"))
    end, context = F.substring("gram", 2, order), F.substring("gram", 1, order - 1)
    unknown = staged(known.where("known is null").select("gram"), f"char-unknown-{order}")
    shorter = spread_scores(unknown.select(end.alias("gram")).distinct(), probs, backs, n_langs,
                            order - 1)
    lower = (
        unknown.withColumn("end", end).withColumn("context", context)
        .join(shorter.select(F.col("gram").alias("end"), "logp"), "end")
        .join(backs[order - 1].select(F.col("gram").alias("context"), "logback"), "context", "left")
    )
    add = F.zip_with(F.coalesce("logback", none), "logp", lambda a, b: a + b)
    return known.where("known is not null").select("gram", F.col("known").alias("logp")).union(
        lower.select("gram", add.alias("logp"))
    )


def held_model(probs: dict, backs: dict, langs: list[str]) -> Model:
    """The part of a spread model that goes to the executors: at most HELD bytes of
    sequences and of contexts, those found most often, and the bits of all others."""
    def known(tables, value):
        rows = [table.select(_hash("gram", order).alias("hash"), value.alias("value"), "weight")
                for order, table in tables.items()]
        out = rows[0]
        for more in rows[1:]:
            out = out.union(more)
        return staged(out, "char-hashes")

    def held(rows, slots):
        most = max(1, HELD // (8 * (1 + len(langs))))
        first = staged(
            rows.orderBy(F.desc("weight"), "hash").limit(most).select("hash", "value"), "char-held")
        # At most HELD bytes.
        rest = rows.join(F.broadcast(first.select("hash")), "hash", "left_anti")
        table = first.toArrow()
        hashes = table["hash"].to_numpy().view(np.uint64)
        values = np.array(table["value"].combine_chunks().flatten(), float)
        order = np.argsort(hashes)
        size = BITS
        slot = F.pandas_udf(
            lambda hashes: pd.Series(slots(hashes.to_numpy().view(np.uint64), size)), "long")
        return hashes[order], values.reshape(-1, len(langs))[order], rest.select(
            slot("hash").alias("slot"))

    grams, logp, more = held(known(probs, F.transform("p", F.ln)), gram_slots)
    contexts, logback, others = held(known(backs, F.col("logback")), context_slots)
    # Spark numbers bits from 1 and buckets from 1, 32,768 bits in each.
    slot = F.col("slot") + 1
    found = (
        more.union(others).groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for row in found:
        at = (row["bucket"] - 1) * len(row["bits"])
        bits[at:at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return Model(langs, grams, logp, contexts, logback, bits)


def _hash(gram: str, order: int) -> Column:
    """The hash of sequences of ``order`` characters, as a signed number."""
    @F.pandas_udf("long")
    def hashed(grams: pd.Series) -> pd.Series:
        return pd.Series(_hash_all(grams.tolist(), order).view(np.int64))

    return hashed(gram)


def spread_entropies(docs: DataFrame, counted: DataFrame, langs: list[str]) -> DataFrame:
    """``docs`` with a column h in place of text: the cross-entropies by the model of
    ``counted (lang, gram, n)``, in order of ``langs``; null for a text without letters."""
    probs, backs = spread_model(counted, langs)
    model = held_model(probs, backs, langs)
    others = [name for name in docs.columns if name != "text"]
    docs = docs.select(*others, F.monotonically_increasing_id().alias("row"), "text")
    kept = docs.drop("text")
    schema = T.StructType([
        *kept.schema.fields,
        *T.StructType.fromDDL(
            "sums array<double>, n long, rest array<struct<gram: string, times: long>>").fields,
    ])

    def score(batches):
        for batch in slices(batches, len(schema) - 3):
            sums, n, (rows, grams, times) = model.sums(batch.column(len(schema) - 3))
            # A long text's parts may name a row more than once.
            order = np.argsort(rows, kind="stable")
            ends = np.cumsum(np.bincount(np.array(rows, np.int64), minlength=len(batch)))
            rest = pa.StructArray.from_arrays(
                [pa.array(grams, pa.string()).take(pa.array(order)),
                 pa.array(times, pa.int64()).take(pa.array(order))], names=["gram", "times"])
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array(list(sums), pa.list_(pa.float64())), pa.array(n),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), rest),
            ], names=schema.names)

    scored = staged(docs.mapInArrow(score, schema), "text-scores")
    rest = scored.select("row", F.inline("rest"))
    sums = F.transform("sums", lambda own: -own / F.col("n"))
    if rest.isEmpty():
        return scored.select(*others, F.when(F.col("n") > 0, sums).alias("h"))
    logp = staged(
        spread_scores(rest.select("gram").distinct(), probs, backs, len(langs)), "char-scores")
    more = rest.join(logp, "gram").groupBy("row").agg(F.array(*[
        F.sum(F.col("times") * F.get("logp", F.lit(k))) for k in range(len(langs))
    ]).alias("more"))
    none = F.array_repeat(F.lit(0.0), len(langs))
    h = F.zip_with("sums", F.coalesce("more", none), lambda a, b: -(a + b) / F.col("n"))
    return scored.drop("rest").join(more, "row", "left").select(
        *others, F.when(F.col("n") > 0, h).alias("h"))


# --- the operator

def cross_entropies(text: Column, model: Model) -> Column:
    """Cross-entropy per character under each language, in order of ``model.langs``."""
    @F.pandas_udf("array<double>")
    def entropies(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.entropies(pa.array(texts, pa.string()))))

    return entropies(text)


def entropies_of(docs: DataFrame, texts: DataFrame) -> tuple[list[str], DataFrame]:
    """``(langs, judged)``: the languages of the labelled ``texts (text, lang)``, and
    ``docs`` with a column h in place of text: the cross-entropies in order of langs, by
    a model that counts all labelled texts and keeps every sequence."""
    langs, counted = counts_of(texts.withColumn("part", F.lit(0)))
    return langs, judge(docs, counted, langs)


def counts_of(texts: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages of ``texts (text, lang, part)``, and their sequences counted."""
    texts = texts.where("text is not null and lang is not null")
    counted = staged(sequence_counts(texts), "char-counts")
    return sorted(row["lang"] for row in counted.select("lang").distinct().collect()), counted


def judge(docs: DataFrame, counted: DataFrame, langs: list[str]) -> DataFrame:
    """``docs`` with a column h in place of text: the cross-entropies by a model of
    ``counted (lang, part, gram, n)``; null where there is no language."""
    if not langs:
        return docs.drop("text").withColumn("h", F.lit(None).cast("array<double>"))
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return staged(spread_entropies(docs, staged(sums, "char-counts"), langs), "entropies")


def rejection_levels(docs: DataFrame, counted: DataFrame) -> dict[str, float]:
    """For each language the cross-entropy that PASS of its texts stay below that the
    model doesn't know: those of ``docs (text, lang)``, by a model of ``counted``. None
    for a language that has no such text, so that nothing is rejected for it."""
    langs = sorted(row["lang"] for row in counted.select("lang").distinct().collect())
    if not langs:
        return {}
    place = F.array_position(F.array(*[F.lit(lang) for lang in langs]), F.col("lang"))
    rows = (
        judge(docs, counted, langs).where(place > 0)
        .select("lang", F.get("h", (place - 1).cast("int")).alias("h")).where("h is not null")
        .groupBy("lang").agg(F.percentile_approx("h", PASS, 10_000).alias("level"))
    )
    return {row["lang"]: row["level"] for row in rows.collect()}


def decide(h: Column, langs: list[str], levels: dict[str, float]) -> Column:
    """A struct of lang_pred, score and rejected from cross-entropies. The score is the
    certainty among the languages: how much more likely the chosen one makes the text,
    per character and scaled to 0..1. Without them a text is UNKNOWN with a score of 0."""
    names = np.array([*langs, UNKNOWN], object)
    level = np.array([levels.get(lang, np.inf) for lang in langs] or [np.inf])

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def choose(found: pd.Series) -> pd.DataFrame:
        empty = np.full(max(len(langs), 1), np.nan)
        h = np.array([empty if own is None else own for own in found], float).reshape(-1, len(empty))
        none = np.isnan(h).any(axis=1)
        best = np.where(none, 0, np.nan_to_num(h, nan=0.0).argmin(axis=1))
        low = h[np.arange(len(h)), best]
        with np.errstate(invalid="ignore", over="ignore"):
            share = 1 / np.exp(np.clip(5 * (low[:, None] - h), -50, 0)).sum(axis=1)
            out = ~(low <= level[best])
        return pd.DataFrame({
            "lang_pred": names[np.where(none, len(names) - 1, best)],
            "score": np.where(none, 0.0, share), "rejected": none | out,
        })

    return choose(h)


def identify_documents(docs: DataFrame, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs (doc_id, text,
    lang)``.

    The model learns from the text and lang of rows whose crc32(doc_id as text) modulo
    ``folds`` is not ``held_out_fold`` (a row without id or lang is not learned from);
    a prediction is made from the text alone. ``rejected`` marks texts that fit even
    the best language worse than nearly all of its texts fit a model that hasn't counted
    them: one labelled text in KEPT_OUT, for a second model of the others. Their
    lang_pred is still the best one. Without a labelled row every text is UNKNOWN.
    Repeated rows are judged each; other columns are not read.
    """
    held = remainder(F.col("doc_id"), folds) == held_out_fold
    learned = ~held & F.col("text").isNotNull() & F.col("lang").isNotNull()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(KEPT_OUT)).cast("int")
    docs = docs.select("doc_id", "text", "lang", F.coalesce(held, F.lit(False)).alias("held_out"),
                       F.when(learned, part).alias("part"))
    kept_out = docs.where("part = 0").select("text", "lang")
    langs, counted = counts_of(
        docs.where("part is not null").select("text", "lang", (F.col("part") == 0).alias("part")))
    levels = rejection_levels(kept_out, counted.where("part = 0"))
    judged = judge(docs.select("doc_id", "held_out", "text"), counted, langs)
    found = decide(F.col("h"), langs, levels)
    return judged.select("doc_id", "held_out", found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected"
    )
